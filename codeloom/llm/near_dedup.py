"""Near-duplicate classes: fast similarity sketches, banding, verification on full sets.

Plan (every table between steps is written to the shared folder):

1. One pass over the texts gives each document the digest of its shingle set
   and a sketch, whose bands are its bucket keys.  Documents of equal sets form a class, which
   is one vertex, so copies never meet in pairs.  A vertex is its class, not an id: rows that share an id are each classed by their own text.
2. Every bucket elects one centre, the member that shares most with others, by
   map-side combined aggregates: a star of candidate links instead of all pairs.
   Each vertex's best star link is verified on full sets.
3. A bucket whose members all hang on one centre is done, whatever its size.
   In the others, members of *different* centres are compared by their sketches in blocks of
   bounded size.  Members of the bucket's commonest centre are not compared with each other, so a bucket of ``n`` with ``m`` other
   members makes about ``n + m * n / BLOCK`` rows.  Where that is more than a bucket's members
   times the length of a prefix, the bucket is split first: two sketches that agree often enough share one of
   the first few of their coordinates in an order that puts the centre's values last.
   Members with a partner that agrees often enough meet again, with
   their full sets: each candidate pair is checked in the first bucket (and part) it
   shares, unless it is connected by then, and only links found are put out.
   No pair is ever a row, and no link between documents of different components is lost.
4. Components of all links; the smallest id of each goes back to the rows.

Joins on buckets, centres, labels and digests broadcast the few keys that hold over a thousandth of the rows.

With 32 bands of 4 rows a pair of similarity 0.75 misses all buckets with
probability 5e-6; the sketch filter (agreement in less than 72 of 128
coordinates) drops such a pair with probability 1e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from codeloom.llm.bitset import marked
from codeloom.llm.bytewords import U64, VISIBLE, mix, seeds, shingles, slices, text_buffers, words
from codeloom.llm.components import components
from codeloom.llm.sketch import sketches
from codeloom.llm.skew import hot_keys, skew_join
from codeloom.llm.worker import release, small_batches
from codeloom.storage import materialize, remove
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
COORDINATES = 128
BAND_ROWS = 4
LEAST_PERCENT = 75
#: Least number of agreeing coordinates of a pair that is verified.
LEAST_AGREEMENT = 72
#: Coordinates of which two sketches that agree often enough share one, in any order.
PREFIX = COORDINATES - LEAST_AGREEMENT + 1
#: Rows that comparing blocks may make of each member of a bucket; else the bucket is split, which makes ``PREFIX`` of each.
MOST_ROWS = PREFIX
#: Members of a block when a bucket is compared, and shingles of their sets on average.
BLOCK = 512
BLOCK_SHINGLES = 2 << 20


def _digest(values: np.ndarray) -> bytes | None:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


def _sketch_batches(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            buf, offs = text_buffers(batch.column(1))
            for i, j in slices(offs):
                values, bounds = shingles(words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], VISIBLE), k)
                sk = sketches(values, bounds, COORDINATES)
                short = (sk & U64(0xFFFF)).astype("<u2")
                sizes = np.diff(bounds)
                digest = [_digest(values[bounds[d] : bounds[d + 1]]) for d in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(sizes, pa.int64()),
                        pa.array(digest, pa.binary()),
                        pa.array([short[d].tobytes() if sizes[d] else None for d in range(j - i)], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "digest", "sketch"],
                )

    return run


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """Bucket keys of sketches of 16-bit coordinates: a band of four is one 64-bit word."""
    bands = np.ascontiguousarray(sketch).view("<u8").astype(U64)
    return mix(mix(bands) + seeds(COORDINATES // BAND_ROWS, 31)[None, :]).view(np.int64)


def _sketch_array(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, COORDINATES)


def _bucket_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, size, sketch) to one row per band: key, rep, size."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            part = batch.slice(lo, 2048)
            keys = band_keys(_sketch_array(part.column(2)))
            reps, sizes = (np.repeat(part.column(c).to_numpy(zero_copy_only=False), keys.shape[1]) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(reps), pa.array(sizes)], names=["key", "rep", "size"])


def prefixes(sketch: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Which ``PREFIX`` coordinates of each sketch come first: those unlike the centre's, each kind by a hash of coordinate and value."""
    order = mix(sketch.astype(U64) + (np.arange(COORDINATES, dtype=U64) << U64(20))) >> U64(1)
    order |= (sketch == centre).astype(U64) << U64(63)
    first = np.argpartition(order, PREFIX - 1, axis=1)[:, :PREFIX]
    out = np.zeros(sketch.shape, dtype=bool)
    np.put_along_axis(out, first, True, axis=1)
    return out


def _part_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, rep, size, label, sketch, centre's sketch) to one row per coordinate of the prefix: a key for the part, band, coord, mask."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            key, rep, size, label = (part.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            sketch = _sketch_array(part.column(4))
            first = prefixes(sketch, _sketch_array(part.column(5)))
            row, coord = np.nonzero(first)
            masks = pa.array([m.tobytes() for m in np.packbits(first, axis=1)], pa.binary()).take(pa.array(row))
            part_key = mix(mix(key[row].astype(np.int64).view(U64)) + (coord.astype(U64) << U64(16)) + sketch[row, coord].astype(U64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part_key), pa.array(rep[row]), pa.array(size[row]), pa.array(label[row]), pa.array(key[row]), pa.array(coord.astype(np.int32)), masks],
                names=["key", "rep", "size", "label", "band", "coord", "mask"],
            )


def _set_batches(k: int):
    """Texts to digest and set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffers(batch.column(0))
            for i, j in slices(offs):
                values, bounds = shingles(words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], VISIBLE), k)
                sets = [values[bounds[d] : bounds[d + 1]] for d in range(j - i)]
                digests = pa.array([_digest(x) for x in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([digests, pa.array([x.tobytes() for x in sets], pa.binary())], names=["digest", "set"])

    return run


def _digest_batches(k: int, column: int):
    """Rows with the digest of the text in ``column`` after their other columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffers(batch.column(column))
            for i, j in slices(offs):
                values, bounds = shingles(words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], VISIBLE), k)
                digests = pa.array([_digest(values[bounds[d] : bounds[d + 1]]) for d in range(j - i)], pa.binary())
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, digests], names=[*part.schema.names, "digest"])

    return run


def _agreement_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sketch_a, sketch_b) to (a, b, agree) for pairs that agree often enough."""
    for batch in batches:
        agree = (_sketch_array(batch.column(2)) == _sketch_array(batch.column(3))).sum(axis=1)
        keep = np.flatnonzero(agree >= LEAST_AGREEMENT)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(agree[keep], pa.int32())], names=["a", "b", "agree"])


def _verify_batches(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for row, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                if _similar(np.frombuffer(x.as_buffer(), dtype=U64), np.frombuffer(y.as_buffer(), dtype=U64), percent):
                    keep.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)], names=["a", "b"])

    return run


def _similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have ``percent`` per cent in common."""
    if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
        return False
    both = np.sort(np.concatenate([s, t]))
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal first three columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)], axis=1)
        cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            this = tuple(ids[lo])
            if this != last and held:
                yield from _joined(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = this
    if held:
        yield from _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if len(parts) == 1:
        yield parts[0]
    else:
        yield from pa.Table.from_batches(parts).combine_chunks().to_batches()


class _Task:
    """The members of blocks ``x`` and ``y`` of a bucket or part: key, x, y, rep, label, block, band, coord, mask, sketch[, set]."""

    def __init__(self, rows: pa.RecordBatch) -> None:
        self.x, self.y, self.band, self.coord = (rows.column(c)[0].as_py() for c in (1, 2, 6, 7))
        self.rep, self.label, self.block = (rows.column(c).to_numpy(zero_copy_only=False) for c in (3, 4, 5))
        self.sketch = _sketch_array(rows.column(9))
        self.bands = self.sketch.view("<u8")
        self.keys = band_keys(self.sketch)
        if self.coord >= 0:
            self.mask = np.unpackbits(np.frombuffer(b"".join(rows.column(8).to_pylist()), dtype=np.uint8).reshape(-1, COORDINATES // 8), axis=1).astype(bool)

    def candidates(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each member with its partners: other centre, enough agreement, and no bucket or part shared before this one."""
        one = self.x == self.y
        left = np.flatnonzero(self.block == self.x)
        right = np.flatnonzero(self.block == self.y)
        for n, i in enumerate(left.tolist()):
            other = right[n + 1 :] if one else right
            other = other[self.label[other] != self.label[i]]
            if not len(other):
                continue
            other = other[(self.sketch[other] == self.sketch[i]).sum(axis=1) >= LEAST_AGREEMENT]
            if len(other):
                first = (self.bands[other] == self.bands[i]).argmax(axis=1)
                other = other[self.keys[i][first] == self.band]
            if len(other) and self.coord >= 0:
                first = ((self.sketch[other] == self.sketch[i]) & self.mask[other] & self.mask[i]).argmax(axis=1)
                other = other[first == self.coord]
            if len(other):
                yield i, other


def _involved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of members that are in a candidate pair."""
    for rows in _groups(batches):
        if rows.num_rows > 1:
            seen = np.zeros(rows.num_rows, dtype=bool)
            for i, other in _Task(rows).candidates():
                seen[i] = seen[other] = True
            if seen.any():
                yield rows.filter(pa.array(seen))


def _block_links(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            task = _Task(rows)
            sets = [np.frombuffer(x.as_buffer(), dtype=U64) for x in rows.column(10)]
            above = {x: x for x in task.label.tolist()}

            def root(x: int, above: dict = above) -> int:
                while above[x] != x:
                    above[x] = above[above[x]]
                    x = above[x]
                return x

            a, b = [], []
            for i, other in task.candidates():
                for j in other.tolist():
                    r, t = root(task.label[i]), root(task.label[j])
                    if r != t and _similar(sets[i], sets[j], percent):
                        above[r] = t
                        a.append(task.rep[i])
                        b.append(task.rep[j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


class _Job:
    """One run over ``docs``: keeps the paths of its tables and the settings."""

    def __init__(self, docs: DataFrame, k: int, percent: int) -> None:
        self.docs = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
        self.k, self.percent = k, percent
        self.spark = docs.sparkSession
        self.paths: list[str] = []
        small_batches(self.spark)

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """``df`` written, until ``clean``."""
        out, path = materialize(df, label)
        self.paths.append(path)
        return out

    def clean(self) -> None:
        remove(self.spark, *self.paths)
        self.paths.clear()

    def vertices(self, sketched: DataFrame) -> DataFrame:
        """One row per set: rep (a number of its own), digest, first (smallest id), rows, size, sketch."""
        grouped = sketched.filter("digest is not null and doc_id is not null").groupBy("digest")
        made = grouped.agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"))
        # numbers that depend on how rows are dealt are fixed by writing them
        return self.keep(made.select(F.monotonically_increasing_id().alias("rep"), "*"), "vertices")

    def buckets(self, reps: DataFrame) -> tuple[DataFrame, list[int]]:
        """key, rep, size, centre of every bucket with two or more members, and the hot keys."""
        rows = self.keep(reps.select("rep", "size", "sketch").mapInArrow(_bucket_rows, "key long, rep long, size long"), "bands")
        hot = hot_keys(rows, "key")
        shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        full = self.keep(skew_join(rows, shared, "key", hot), "shared-bands")
        weight = full.groupBy("rep").agg(F.sum("n").alias("weight"))
        weighed = self.keep(full.drop("n").join(weight, "rep"), "weighed-bands")
        centre = weighed.groupBy("key").agg(F.max(F.struct("weight", "rep"))["rep"].alias("centre"))
        return self.keep(skew_join(weighed.drop("weight"), centre, "key", hot), "buckets"), hot

    def star(self, buckets: DataFrame, reps: DataFrame) -> DataFrame:
        """The best verified link of each vertex to a centre of its buckets: a, b."""
        near = self.keep(buckets.filter("rep <> centre").select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct(), "near")
        left = reps.select(F.col("rep").alias("a"), F.col("sketch").alias("sketch_a"))
        right = reps.select(F.col("rep").alias("b"), F.col("sketch").alias("sketch_b"))
        hot = hot_keys(near, "b")
        pairs = skew_join(near.join(left, "a"), right, "b", hot).select("a", "b", "sketch_a", "sketch_b")
        agree = pairs.mapInArrow(_agreement_batches, "a long, b long, agree int")
        best = self.keep(agree.groupBy("a").agg(F.max(F.struct("agree", "b"))["b"].alias("b")), "star")
        sets = self.keep(self.sets(best.select(F.col("a").alias("rep")).union(best.select("b")).distinct(), reps), "sets")
        left = sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a"))
        right = sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b"))
        # sets are too large to broadcast: a hot centre's are dealt by Spark's own splitting of skewed partitions
        both = best.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
        return self.keep(both.mapInArrow(_verify_batches(self.percent), "a long, b long"), "links")

    def sets(self, ids: DataFrame, reps: DataFrame) -> DataFrame:
        """The full shingle sets of the vertices ``ids(rep)``: rep, set."""
        wanted = self.keep(reps.select("rep", "digest", "first").join(ids, "rep"), "wanted")
        texts = marked(self.docs, F.col("doc_id"), wanted.select("first"), "maybe").filter("maybe").select("text")
        # the exact join comes after the map: the optimizer would move it below the filter, and shuffle all texts
        made = texts.mapInArrow(_set_batches(self.k), "digest binary, set binary")
        return made.join(wanted.select("digest", "rep"), "digest").select("rep", "set").dropDuplicates(["rep"])

    def mixed(self, rows: DataFrame) -> DataFrame:
        """Per key of ``rows`` with members of two or more centres: its commonest label, other members, blocks of both."""
        sizes = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("load"))
        most = sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"), F.sum("load").alias("load"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
        unit = F.greatest(F.lit(1.0), F.least(F.lit(float(BLOCK)), F.col("n") * F.lit(float(BLOCK_SHINGLES)) / F.col("load")))
        few = F.col("n") <= unit  # all in one block
        others = F.col("n") - F.col("most.n")
        out = most.select(
            "key", F.col("most.label").alias("major"), "n",
            F.when(few, 1).otherwise(F.ceil(others / unit)).cast("long").alias("minors"), F.when(few, 0).otherwise(F.ceil(F.col("most.n") / unit)).cast("long").alias("majors"),
            others.alias("others"),
        )
        return out.withColumn("cost", F.col("others") * (F.col("minors") + F.col("majors")) + (F.col("n") - F.col("others")) * F.col("minors"))

    def tasks(self, rows: DataFrame, reps: DataFrame) -> DataFrame:
        """Rows of ``mixed`` buckets with the tasks they are in: every block of other members meets all blocks."""
        minor = F.col("majors").cast("boolean") & (F.col("label") == F.col("major"))
        place = F.xxhash64("rep")
        rows = rows.withColumn("block", F.when(minor, F.col("minors") + F.pmod(place, F.greatest(F.lit(1), "majors"))).otherwise(F.pmod(place, "minors")).cast("long"))
        zero = F.lit(0).cast("long")
        other = F.transform(F.sequence(zero, F.col("minors") - 1), lambda o: F.struct(o.alias("x"), F.col("block").alias("y")))
        every = F.transform(F.sequence(zero, F.col("minors") + F.col("majors") - 1), lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y")))
        dealt = rows.join(reps.select("rep", "sketch"), "rep").withColumn("task", F.explode(F.when(minor, other).otherwise(every)))
        return self.by_task(dealt.select("key", "task.x", "task.y", "rep", "label", "block", "band", "coord", "mask", "sketch"))

    def rest(self, buckets: DataFrame, hot: list[int], star: DataFrame, reps: DataFrame) -> DataFrame:
        """Links between vertices that share a bucket and hang on different centres: a, b."""
        up = star.select(F.col("a").alias("rep"), F.col("b").alias("label"))
        upper = star.select(F.col("a").alias("label"), F.col("b").alias("top"))
        above = skew_join(self.keep(up, "up"), upper, "label", hot_keys(up, "label"), "left").select("rep", F.coalesce("top", "label").alias("label"))
        labelled = self.keep(buckets.join(above, "rep", "left").select("key", "rep", "size", "centre", F.coalesce("label", "rep").alias("label")), "labelled")
        mixed = self.keep(self.mixed(labelled), "mixed")
        split = F.col("cost") > F.lit(MOST_ROWS) * F.col("n")
        whole = skew_join(labelled, mixed.filter(~split), "key", hot).withColumns({"band": F.col("key"), "coord": F.lit(-1), "mask": F.lit(None).cast("binary")})
        kinds = "key long, x long, y long, rep long, label long, block long, band long, coord int, mask binary, sketch binary"
        involved = self.tasks(whole, reps).mapInArrow(_involved, kinds)
        if mixed.filter(split).limit(1).count():
            parted = skew_join(labelled, mixed.filter(split).select("key"), "key", hot).join(reps.select("rep", "sketch"), "rep")
            centres = reps.select(F.col("rep").alias("centre"), F.col("sketch").alias("middle"))
            parted = skew_join(parted, centres, "centre", hot_keys(labelled, "centre")).select("key", "rep", "size", "label", "sketch", "middle")
            parts = self.keep(parted.mapInArrow(_part_rows, "key long, rep long, size long, label long, band long, coord int, mask binary"), "parts")
            involved = involved.unionByName(self.tasks(skew_join(parts, self.mixed(parts), "key", hot_keys(parts, "key")), reps).mapInArrow(_involved, kinds))
        involved = self.keep(involved, "involved")
        sets = self.sets(involved.select("rep").distinct(), reps)
        full = involved.join(sets, "rep").select(*involved.columns, "set")
        return self.keep(self.by_task(full).mapInArrow(_block_links(self.percent), "a long, b long"), "links")

    def by_task(self, rows: DataFrame) -> DataFrame:
        """Rows of a task together; tasks are of bounded size, so no partition gets a hot key."""
        return rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def run(self) -> DataFrame:
        """Every row's class: doc_id, n_shingles, digest, component_id, and the digest of the class's first row."""
        sketched = self.keep(self.docs.mapInArrow(_sketch_batches(self.k), "doc_id long, n_shingles long, digest binary, sketch binary"), "sketches")
        reps = self.vertices(sketched)
        buckets, hot = self.buckets(reps)
        star = self.star(buckets, reps)
        labels = self.keep(components(star.union(self.rest(buckets, hot, star, reps))), "components")
        named = self.keep(labels.withColumnRenamed("v", "rep").join(reps.select("rep", "digest", "first"), "rep"), "named")
        lowest = named.groupBy("label").agg(F.min(F.struct("first", "digest")).alias("lowest"))
        large = hot_keys(named, "label")
        linked = skew_join(named, lowest, "label", large).select("digest", F.col("lowest.first").alias("component_id"), F.col("lowest.digest").alias("lead"))
        alone = reps.filter("rows > 1").join(named.select("rep"), "rep", "left_anti").select("digest", F.col("first").alias("component_id"), F.col("digest").alias("lead"))
        classes = self.keep(linked.unionByName(alone), "classes")
        rows = sketched.select("doc_id", "n_shingles", "digest")
        found = skew_join(rows.filter("digest is not null and doc_id is not null"), classes, "digest", hot_keys(reps.filter("rows > 1").select("digest", "rows"), "digest", "rows"), "left")
        none = rows.filter("digest is null or doc_id is null").select(*rows.columns, F.lit(None).cast("long").alias("component_id"), F.lit(None).cast("binary").alias("lead"))
        every = found.unionByName(none).select("doc_id", "n_shingles", "digest", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("lead", "digest").alias("lead"))
        out, _ = materialize(every, "near-classes")
        self.clean()
        return out


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = LEAST_PERCENT) -> DataFrame:
    """Every document's near-duplicate class: ``doc_id, n_shingles, component_id, kept``.

    Words are runs of anything but ASCII white space, A-Z folded.  Two documents
    are linked when their sets of distinct ``k``-word shingles have at least
    ``percent`` per cent in common (intersection over union); classes are the
    components of the links, named by their smallest id, whose row is kept.

    A document of fewer than ``k`` words has one shingle, all its words.  Null
    or empty texts, and texts of white space, have no shingles and are never
    linked, so they are kept.  Rows that repeat an id are each classed by their own
    text.  Rows with a null id
    are not linked; their ``component_id`` is null and they are kept.  Other
    columns are not read.  An empty table gives no rows.
    """
    rows = _Job(docs, k, percent).run()
    return rows.select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one_per_class(docs: DataFrame, k: int = SHINGLE, percent: int = LEAST_PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: of each class the row of the smallest id.

    Decisions are by row, that is by id and set of shingles: a text stays even if its id repeats that of
    another's copy.  Rows that repeat both are one document, and stay or go together.  Where a class has two texts of its
    smallest id, one stays.  Only rows whose id is among those that go are looked at again; the others are not shuffled.
    """
    rows = _Job(docs, k, percent).run()
    stays = F.col("digest").isNull() | F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")) & (F.col("digest") == F.col("lead"))
    gone, _ = materialize(rows.filter(~stays).select(F.col("doc_id").alias("g_id"), F.col("digest").alias("g_digest")).distinct(), "gone")
    names = [f"c{n}" for n in range(len(docs.columns))]  # names of its own clash with no column
    own_id, own_text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    own = marked(docs.toDF(*names), F.col(own_id).cast("long"), gone.select("g_id"), "maybe")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.select(*names).schema)
    again = own.filter("maybe").select(*names).mapInArrow(_digest_batches(k, names.index(own_text)), f"{schema}, digest binary")
    again = again.join(gone, (F.col(own_id).cast("long") == F.col("g_id")) & (F.col("digest") == F.col("g_digest")), "left_anti")
    return own.filter("not maybe").select(*names).unionAll(again.select(*names)).toDF(*docs.columns)
