"""Small tables with everything odd: nulls, empty and very long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, _row string, kept string, code string, shard int, _stats string"


def filler(*rows) -> list[tuple]:
    return [(*r, 0, 1, "x", "y", "z", 7, "w") for r in rows]


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple]:
    words = " ".join(f"word{i % 97} and{i % 89}" for i in range(30_000))
    prose = "The quick brown fox jumps over the lazy dog while a small bird sings in the old tree near the river bank today"
    return filler(
        (1, prose, "en", "a"), (2, prose, "en", "a"), (2, prose, "en", "a"), (3, prose + " again", "en", None), (4, None, "en", "b"),
        (5, "", None, "b"), (6, " \t\n", "de", "c"), (7, "x" * 150_000, "de", "c"), (8, words, "fr", "c"), (9, "short one", "fr", "d"),
        (None, prose, None, None), (None, None, None, None), (10, "mail a.b@c.de ip 1.2.3.4 +49 (89) 1234 5678 4111 1111 1111 1111 é😀 x@y.org", "es", "d"),
        (11, "#$%| " * 40, "es", "e"), (12, "same line here\n" * 30, "es", "e"), (13, "\u00a0 ünï  cödé ▁ \r\n\u2028 z\u0000", "de", "f"), (9, "other text under a used id", "fr", "d"),
    )


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents) -> list[tuple[int, str]]:
    return sorted((r.doc_id, r.text or "") for r in documents.select("doc_id", "text").collect())
