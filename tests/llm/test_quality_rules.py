from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from wayfind.llm.quality_rules import choose_cutoff, judge_documents, keep_documents, upper_bound

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text: str) -> tuple:
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen: dict = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    hit = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 5)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in lines
            lines.add(line)
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


def base(rows) -> list:
    return sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_base_counts(spark, documents, texts):
    rows = judge_documents(documents, spark.read.parquet("/root/testdata/sf0.001/labels.parquet")).collect()
    assert base(rows) == sorted((str(d), *brute(t)) for d, t in texts)
    assert not any(r.kept for r in rows if r.base_failed)


def test_bound_is_exact():
    n, k, level = 40, 3, 0.05
    p = upper_bound(k, n, level)
    assert sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) == pytest.approx(level)
    assert upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100))
    assert upper_bound(5, 5, 0.05) == 1.0


def test_cutoff_stops_at_the_first_that_fails():
    assert choose_cutoff([0.0, 1.0, 2.0], [1000, 0, 0], 0.05, 0.05) == 1.0
    assert choose_cutoff([0.0, 1.0, 2.0], [960, 39, 1], 0.05, 0.05) == 2.0 or upper_bound(40, 1000, 0.05) > 0.05
    assert choose_cutoff([0.0], [5], 0.05, 0.05) is None
    assert choose_cutoff([], [], 0.05, 0.05) is None


def test_false_rejection_stays_below_the_limit(spark):
    rng = random.Random(11)
    rows, quality = [], []
    for i in range(3000):
        bad = i % 4 == 0
        words = ["".join(rng.choice("abcdefgh") for _ in range(6)) + ("%%%" if bad and rng.random() < 0.6 else "") for _ in range(30)]
        rows.append((i, " ".join(words), "en" if i % 3 else "de"))
        quality.append((i, int(not bad), 0) if i % 2 else (i + 3000, 1, 0))
    quality += [(2 * i, int(2 * i % 4 != 0), 0) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in judge_documents(docs, labels(spark, quality)).collect()}
    good, bad = [i for i in kept if i % 4], [i for i in kept if i % 4 == 0]
    assert sum(not kept[i] for i in good) <= 0.05 * len(good)
    assert sum(not kept[i] for i in bad) >= 0.9 * len(bad)


def test_odd_rows(spark, odd, odd_rows, empty):
    some = labels(spark, [(1, 1, 0), (1, 0, None), (11, None, 1), (None, 1, 1), (99, 1, 0)])
    rows = judge_documents(odd, some).collect()
    assert base(rows) == sorted((str(r[0]), *brute(r[1] or "")) for r in odd_rows)
    kept = keep_documents(odd, some)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in rows)
    assert judge_documents(empty, some).count() == 0
    assert keep_documents(odd, some.limit(0)).count() == sum(not r.base_failed for r in rows)
    assert judge_documents(odd.withColumn("lang", F.lit(None).cast("string")), some).count() == len(odd_rows)
