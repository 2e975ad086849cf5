"""Source trees as tables ``path, content, bytes``."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from codeloom.functions.text import language
from codeloom.operators.prefix import scan
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders and kinds of files that hold no source code.
SKIPPED_FOLDERS = ("target", ".git", "node_modules", "dist", "build", "__pycache__")
SKIPPED_KINDS = ("o", "d", "rmeta", "rlib", "bin", "exe", "lock", "a", "dll", "so", "dylib", "timestamp", "png", "jpg", "jpeg", "gif", "webp", "ico", "pdf", "zip", "gz", "7z", "db", "sqlite", "sqlite3", "woff", "woff2", "ttf", "otf")
FILE_BYTES, TOTAL_BYTES, FILES = 1 << 20, 16 << 20, 2000


def skipped(path: Column) -> Column:
    """Whether a path lies in a skipped or hidden folder, or is of a skipped kind."""
    parts = F.split(path, "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") & ~p.isin(".", ".."))
    return F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED_FOLDERS))) | hidden | F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*SKIPPED_KINDS)


def ignored(path: Column, patterns: list[str], nested: dict[str, list[str]] | None = None) -> Column:
    """Whether git-ignore patterns exclude a path; the last one that fits decides.

    ``nested`` has the patterns of folders, which hold below them only and decide over those of the folders above.
    """
    out = _last_fitting(path, patterns, F.lit(False))
    for folder in sorted(nested or {}, key=lambda x: (x.count("/"), x)):
        below = F.substring(path, len(folder) + 2, 1 << 20)
        out = F.when(path.startswith(folder + "/"), _last_fitting(below, nested[folder], out)).otherwise(out)
    return out


def _last_fitting(path: Column, patterns: list[str], out: Column) -> Column:
    for line in patterns:
        p = line.strip()
        if p and not p.startswith("#"):
            negated, p = p.startswith("!"), p.lstrip("!")
            rooted, folder = "/" in p.rstrip("/"), p.endswith("/")
            body = fnmatch.translate(p.strip("/")).removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z").replace(".*", "[^/]*").replace(r"[^/]*[^/]*/", "(?:.*/)?")
            regex = ("^" if rooted else "(?:^|/)") + body + ("/" if folder else "(?:/|$)")
            out = F.when(path.rlike(regex), F.lit(not negated)).otherwise(out)
    return out


def _store(where: str) -> tuple[fs.FileSystem, str]:
    """File system of a qualified path, and the path in it."""
    if where.startswith("file:"):
        return fs.LocalFileSystem(), "/" + where.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(where)


def _walk(where: str) -> tuple[list[str], dict[str, list[str]]]:
    """Files that Spark's listing leaves out, as a name on their path begins with an underscore, and the ignore patterns of each folder.

    Skipped and hidden folders are not entered, links not followed.
    """
    store, top = _store(where)
    unlisted, patterns, todo = [], {}, [""]
    while todo:
        folder = todo.pop()
        for info in store.get_file_info(fs.FileSelector(f"{top}/{folder}".rstrip("/"))):
            name, path = info.base_name, f"{folder}/{info.base_name}".lstrip("/")
            if where.startswith("file:") and os.path.islink(info.path):
                continue
            if info.type == fs.FileType.Directory:
                if not name.startswith(".") and name not in SKIPPED_FOLDERS:
                    todo.append(path)
            elif name == ".gitignore":
                with store.open_input_stream(info.path) as f:
                    patterns[folder] = f.read().decode("utf-8", "replace").splitlines()
            elif any(p.startswith("_") and "=" not in p for p in path.split("/")):
                unlisted.append(path)
    return unlisted, patterns


def _read_batches(where: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(where)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(f"{top}/{path}") as f:
                    content = f.read()
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(content)], pa.int64()), pa.array([content], pa.binary())], names=["path", "length", "content"])

    return run


def read_tree(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """Files below ``root``: ``path`` relative to it, ``content`` (null if no UTF-8), ``bytes``.

    ``ignore`` and the ``.gitignore`` files of the tree exclude paths; the driver holds their patterns.
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    at = F.instr("path", base.split("://")[-1].rstrip("/") + "/")
    path = F.expr("substring(path, {} + {})".format("instr(path, '" + base.split("://")[-1].replace("'", "\\'") + "/')", len(base.split("://")[-1]) + 1))
    where = spark._jvm.org.apache.hadoop.fs.Path(base)
    where = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    unlisted, nested = _walk(where)
    rows = raw.filter(at > 0).select(path.alias("path"), "length", "content")
    if unlisted:
        names = spark.createDataFrame([(p,) for p in unlisted], "path string")
        rows = rows.unionByName(names.repartition(min(len(unlisted), spark.sparkContext.defaultParallelism)).mapInArrow(_read_batches(where), rows.schema))
    patterns = nested.pop("", []) + (ignore or [])
    rows = rows.filter(~skipped(F.col("path")) & ~ignored(F.col("path"), patterns, nested))
    return rows.select("path", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("content"), F.col("length").alias("bytes"))


def within_budget(files: DataFrame, file_bytes: int = FILE_BYTES, total_bytes: int = TOTAL_BYTES, count: int = FILES) -> tuple[DataFrame, DataFrame]:
    """Files in path order up to the limits of an interactive run, and the rest with reasons.

    The totals are prefix sums over sizes, which are joined back to the files: texts are not sorted.
    """
    fits = F.col("content").isNotNull() & (F.col("bytes") <= file_bytes)
    sizes = files.select("path", fits.cast("long").alias("__one"), F.when(fits, F.col("bytes")).otherwise(0).alias("__size"))
    marked = files.join(scan(sizes, [], [F.col("path")], {"__n": ("sum", F.col("__one")), "__b": ("sum", F.col("__size"))}).drop("__one", "__size"), "path")
    reason = F.when(F.col("content").isNull(), "not UTF-8").when(F.col("bytes") > file_bytes, "file too large").when(F.col("__n") > count, "too many files").when(F.col("__b") > total_bytes, "too many bytes")
    marked = marked.withColumn("reason", reason).drop("__n", "__b")
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null").select("path", "reason")


def only_paths(files: DataFrame, paths: DataFrame) -> DataFrame:
    """Files of an explicit list, each once."""
    return files.join(paths.select("path").distinct(), "path", "left_semi").dropDuplicates(["path"])


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", language(F.col("path")))
