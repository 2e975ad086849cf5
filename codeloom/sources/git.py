"""Git as a source: changed paths, trees and blobs of a commit.  No checkout is made."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import DataFrame, SparkSession

_HASH = re.compile(r"(?:[0-9a-f]{40}|[0-9a-f]{64})")


def _git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True, timeout=120).stdout


def resolve_ref(repo: str, ref: str) -> str:
    """The commit that a name stands for."""
    got = _git(repo, "rev-parse", "--verify", "--end-of-options", f"{ref}^{{commit}}").decode().strip()
    if not _HASH.fullmatch(got):
        raise ValueError(f"{ref!r} is no commit")
    return got


def changes(spark: SparkSession, repo: str, base: str | None = None, staged: bool = True, unstaged: bool = True, untracked: bool = True) -> DataFrame:
    """``path, status`` (changed or deleted) of the work tree against a base, the index or the last commit."""
    found: dict[str, str] = {}

    def note(*args: str) -> None:
        parts = _git(repo, "diff", "--name-status", "-z", "--no-renames", *args).decode("utf-8", "surrogateescape").split("\0")
        for status, path in zip(parts[::2], parts[1::2], strict=False):
            found[path] = "deleted" if status == "D" else "changed"

    if base is not None:
        note(resolve_ref(repo, base))
    else:
        if staged:
            note("--cached")
        if unstaged:
            note()
    if untracked:
        for path in _git(repo, "ls-files", "--others", "--exclude-standard", "-z").decode("utf-8", "surrogateescape").split("\0"):
            if path:
                found[path] = "changed"
    return spark.createDataFrame(sorted(found.items()), "path string, status string")


#: Blobs that one process reads, and that a task holds at once.
_BATCH = 256


def _blobs(repo: str, names: list[str]) -> list[bytes]:
    """Contents of blobs, by one process for all."""
    out = subprocess.run(["git", "-C", repo, "cat-file", "--batch"], check=True, capture_output=True, timeout=600, input="".join(f"{n}\n" for n in names).encode()).stdout
    found, at = [], 0
    for name in names:
        end = out.index(b"\n", at)
        head = out[at:end].split()
        if len(head) != 3 or head[1] != b"blob":
            raise ValueError(f"{name} is no blob")
        size = int(head[2])
        found.append(out[end + 1 : end + 1 + size])
        at = end + size + 2
    return found


def tree_at(spark: SparkSession, repo: str, ref: str) -> DataFrame:
    """``version, path, content, bytes`` of the plain files of a commit; blobs are read by the tasks.

    The repository must be readable under the same path on the workers.
    """
    commit = resolve_ref(repo, ref)
    rows = []
    for entry in _git(repo, "ls-tree", "-r", "-z", commit).decode("utf-8", "surrogateescape").split("\0"):
        if entry:
            meta, path = entry.split("\t", 1)
            mode, _, blob = meta.split()
            if mode in ("100644", "100755"):
                rows.append((commit, path, blob))

    def read(batches):
        import pyarrow as pa

        for part in (batch.slice(lo, _BATCH) for batch in batches for lo in range(0, batch.num_rows, _BATCH)):
            version, path, blob = (part.column(c).to_pylist() for c in range(3))
            data = _blobs(repo, blob)
            texts = []
            for d in data:
                try:
                    texts.append(d.decode())
                except UnicodeDecodeError:
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(version, pa.string()), pa.array(path, pa.string()), pa.array(texts, pa.string()), pa.array(map(len, data), pa.int64())], names=["version", "path", "content", "bytes"])

    listed = spark.createDataFrame(rows, "version string, path string, blob string")
    return listed.mapInArrow(read, "version string, path string, content string, bytes long")
