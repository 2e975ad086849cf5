"""Tables that every operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import pytest

WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were her all".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str(x % 97))
    return " ".join(out)


@pytest.fixture(scope="session")
def odd_rows():
    base = prose(1, 60)
    return [
        (1, base), (2, base), (2, base), (3, base.upper()), (4, base + " tail"), (5, None), (6, ""), (7, "  \n\t "),
        (8, "word"), (9, "WORD"), (10, "x" * 5000 + " y" * 5000), (11, prose(2, 20000)), (None, base), (None, None),
        (12, "Éa éA 中文 \U0001f600 é   z"), (13, "one two three"), (14, "one two three"), (-5, prose(3, 40)),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The rows with columns whose names operators use inside."""
    rows = [(i, t, "en", "s", None, "d", 1, 2) for i, t in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, rep int, label int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
