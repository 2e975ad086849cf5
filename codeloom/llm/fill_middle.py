"""Fill-in-the-middle examples over an index of distinct texts.

1. SHA-256 digests are counted; a digest with one row is a text that no other row has.
2. Rows whose digest may repeat (a broadcast bit set of bounded size tells) are grouped by digest *and* whole text,
   first within each task, then by salt, then globally.  Each distinct text is written once, with the
   Elias-Fano list of its line ends.
3. Rows find their text in this index by digest.  Grouping has compared all texts of a digest, so a digest
   with one text stands for it; rows of a digest with several texts do not use the index.
   Texts are not shuffled for this: a row brings its id and digest only.  Digests with over a thousandth of the rows
   in the index are dealt over as many tasks as they have thousandths.
4. Each row's seeded numbers select two ends from the list, and the text is cut there.

A text of its own has its list made where it is read; nothing of it is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from codeloom.llm import elias_fano
from codeloom.llm.bitset import marked
from codeloom.llm.bytewords import slices, text_buffers
from codeloom.llm.worker import small_batches
from codeloom.storage import materialize
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signs before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A text with over one in so many rows of the index is hot.
HOT_SHARE = 1000


def line_ends(text: np.ndarray) -> np.ndarray:
    """Ends of the lines of a text in UTF-8: after each line feed, and the end of an unfinished last line."""
    ends = np.flatnonzero(text == 10) + 1
    return ends if not len(text) or (len(ends) and ends[-1] == len(text)) else np.append(ends, len(text))


def _index_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the list of line ends to ``digest, body, rows``."""
    for batch in batches:
        buf, offs = text_buffers(batch.column(1))
        lists = [elias_fano.encode(line_ends(buf[a:b]), int(b - a)) for a, b in zip(offs[:-1], offs[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.binary())], names=["digest", "body", "rows", "ends"])


def _cut(buf: np.ndarray, offs: np.ndarray, first: list, second: list, forms: list, lists: list) -> Iterator[tuple[int, int | None, int | None, bytes]]:
    """Lines, characters of prefix and middle, and output of each text."""
    prefix, suffix, middle = (sign.encode() for sign in (PREFIX, SUFFIX, MIDDLE))
    view = memoryview(buf)
    for i, (form, ends) in enumerate(zip(forms, lists, strict=True)):
        a, b = int(offs[i]), int(offs[i + 1])
        if ends is None:
            ends = elias_fano.encode(line_ends(buf[a:b]), b - a)
        n = elias_fano.size(ends)
        if form == "plain":
            yield n, None, None, bytes(view[a:b])
            continue
        lo, hi = sorted((first[i] % (n + 1), second[i] % (n + 1)))
        lo, hi = (a + elias_fano.select(ends, k - 1) if k else a for k in (lo, hi))
        p, s, m = view[a:lo], view[hi:b], view[lo:hi]
        chars = [int(np.count_nonzero((part & 0xC0) != 0x80)) for part in (buf[a:lo], buf[lo:hi])]
        yield n, *chars, b"".join([prefix, p, suffix, s, middle, m] if form == "psm" else [suffix, s, prefix, p, middle, m])


def _cut_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, n, form, prefix_chars, middle_chars, output`` of ``id, first, second, form, body, ends``."""
    for batch in batches:
        buf, offs = text_buffers(batch.column("body"))
        for i, j in slices(offs):
            part = batch.slice(i, j - i)
            columns = [part.column(c).to_pylist() for c in ("first", "second", "form", "ends")]
            n, prefixes, middles, outputs = zip(*_cut(buf, offs[i : j + 1], *columns), strict=True)
            counts = [pa.array(x, pa.int64()) for x in (n, prefixes, middles)]
            yield pa.RecordBatch.from_arrays([part.column("id"), counts[0], part.column("form"), *counts[1:], pa.array(outputs, pa.string())], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])


def _seeded(doc_id: Column, seed: int, k: int) -> Column:
    """The ``k``-th group of eight hex digits of SHA-256 of seed and id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _form(doc_id: Column, body: Column, seed: int, fim_percent: int, spm_percent: int) -> Column:
    marked_up = F.contains(body, F.lit(PREFIX)) | F.contains(body, F.lit(SUFFIX)) | F.contains(body, F.lit(MIDDLE))
    plain = (body == "") | marked_up | (_seeded(doc_id, seed, 2) % 100 >= fim_percent)
    return F.when(plain, "plain").when(_seeded(doc_id, seed, 3) % 100 < spm_percent, "spm").otherwise("psm")


def distinct_texts(rows: DataFrame, salts: int = 16) -> DataFrame:
    """``digest, body, rows, ends``: each distinct text of ``rows(digest, body)``, how many rows have it, and its line ends.

    Texts are equal only if all their bytes are; empty texts are one.  The table is written.
    """
    keyed = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = keyed.groupBy("digest", "salt", "body").agg(F.count(F.lit(1)).alias("rows"))
    merged = salted.groupBy("digest", "body").agg(F.sum("rows").alias("rows")).select("digest", "body", "rows")
    return materialize(merged.mapInArrow(_index_batches, "digest string, body string, rows long, ends binary"), "text-index")[0]


def _indexed(rows: DataFrame, index: DataFrame) -> DataFrame:
    """``rows(id, first, second, form, digest)`` with ``body, ends`` of their text."""
    limit = max(1, (index.agg(F.sum("rows")).first()[0] or 0) // HOT_SHARE)
    parts = F.ceil(F.col("rows") / limit).cast("int")
    hot = F.broadcast(index.filter(F.col("rows") > limit).select(F.col("digest").alias("h_digest"), parts.alias("h_parts")))  # fewer than HOT_SHARE
    spread = F.pmod(F.xxhash64("id") + F.spark_partition_id(), F.coalesce("h_parts", F.lit(1)))
    rows = rows.join(hot, F.col("digest") == F.col("h_digest"), "left").withColumn("part", spread.cast("int")).drop("h_digest", "h_parts")
    dealt = index.select("digest", "body", "ends", F.explode(F.sequence(F.lit(0), F.when(F.col("rows") > limit, parts - 1).otherwise(F.lit(0)))).alias("part"))
    return rows.join(dealt, ["digest", "part"]).select("id", "first", "second", "form", "body", "ends")


def fill_in_middle(docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's training text: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    ``n`` is the number of lines, which end at a line feed or the text's end.  Numbers seeded by the id choose the two lines
    ends at which the text is cut, whether it is cut at all (``fim_percent``) and the order of its parts: ``psm`` or ``spm``.

    A null text counts as empty; an empty text and one that contains a sign is ``plain``: it stays as it is, and both counts
    of characters are null.  A null id is seeded as no digits.  Repeated rows give their row each; equal texts with
    other ids are cut at places of their own.  Other columns are not read, whatever their names.  An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), body.alias("body")).withColumn("digest", F.sha2("body", 256))
    repeated, _ = materialize(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest"), "repeated-texts")
    flagged = marked(rows, F.col("digest"), repeated, "maybe")
    own = [F.col("id"), _seeded(F.col("id"), seed, 0).alias("first"), _seeded(F.col("id"), seed, 1).alias("second"), _form(F.col("id"), F.col("body"), seed, fim_percent, spm_percent).alias("form")]
    no_list = F.lit(None).cast("binary").alias("ends")
    cut = flagged.filter(~F.col("maybe")).select(*own, "body", no_list)
    index = distinct_texts(flagged.filter("maybe").select("digest", "body"))
    shared = flagged.filter("maybe").select(*own, "digest", "body")
    unclear = index.groupBy("digest").count().filter("count > 1").select("digest")
    if not unclear.isEmpty():  # texts that share a SHA-256 digest
        cut = cut.unionAll(shared.join(unclear, "digest", "left_semi").select("id", "first", "second", "form", "body", no_list))
        shared, index = shared.join(unclear, "digest", "left_anti"), index.join(unclear, "digest", "left_anti")
    cut = cut.unionAll(_indexed(shared.drop("body"), index))
    kind = rows.schema["id"].dataType.simpleString()
    return cut.mapInArrow(_cut_batches, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", "doc_id")


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of."""
    rest = F.substring(output, len(PREFIX) + 1, 2**31 - 1)

    def part(text: Column, sign: str, which: int) -> Column:
        return F.substring_index(text, sign, which)

    psm = F.concat(part(rest, SUFFIX, 1), part(rest, MIDDLE, -1), part(part(rest, SUFFIX, -1), MIDDLE, 1))
    spm = F.concat(part(part(rest, PREFIX, -1), MIDDLE, 1), part(rest, MIDDLE, -1), part(rest, PREFIX, 1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
