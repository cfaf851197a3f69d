from __future__ import annotations

import random

import numpy as np
import pytest

from wayfind.llm.suffix_dedup import Anchors, Run, common_prefix, merge_runs, remove_repeats


def brute(docs: list[tuple]) -> list[tuple]:
    first: dict[bytes, int] = {}
    for d, x in docs:
        for i in range(len(x) - 49 if d is not None else 0):
            first[x[i : i + 50]] = min(first.get(x[i : i + 50], d), d)
    out = []
    for d, x in docs:
        gone = bytearray(len(x) + 1)
        for i in range(len(x) - 49 if d is not None else 0):
            if first[x[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        gone = gone[: len(x)]
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((str(d), len(x), sum(gone), spans, bytes(c for c, g in zip(x, gone, strict=True) if not g)))
    return sorted(out)


def got(frame, **options) -> list[tuple]:
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(frame, **options).collect())


@pytest.mark.parametrize("block_bytes", [1 << 24, 1 << 16])
def test_documents_of_the_test_table(documents, texts, block_bytes):
    assert got(documents, block_bytes=block_bytes) == brute([(d, t.encode()) for d, t in texts])


@pytest.mark.parametrize("block_bytes", [1 << 20, 3000])
def test_shared_passages_overlaps_and_periods(spark, block_bytes):
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    passages = [make(n) for n in (49, 50, 51, 90, 400)] + ["=" * 120, "ab" * 90, "\u0000" * 60]
    docs = []
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else make(rng.randint(0, 80)) for _ in range(rng.randint(0, 6))]
        docs.append((i // 2 * 3 % 150, "".join(parts)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got(frame, block_bytes=block_bytes) == brute([(d, t.encode()) for d, t in docs])


def test_long_texts_cross_segments(spark):
    rng = np.random.default_rng(0)
    long = bytes(rng.integers(97, 101, 1_200_000, dtype=np.uint8)).decode()
    docs = [(5, long), (1, long[1_048_500:1_048_700]), (9, "z" + long[600_000:600_200])]
    assert got(spark.createDataFrame(docs, "doc_id long, text string")) == brute([(d, t.encode()) for d, t in docs])


def test_every_window_has_one_anchor():
    data = bytes(np.random.default_rng(3).integers(97, 100, 5000, dtype=np.uint8))
    anchors = Anchors([data[:3000], b"short", data[1000:]])
    for text, n in ((0, 3000 - 49), (2, 4000 - 49)):
        own = anchors.text == text
        windows = np.concatenate([np.arange(a, b + 1) for a, b in zip(anchors.first[own], anchors.last[own], strict=True)])
        assert windows.tolist() == list(range(n))
        assert ((anchors.place[own] >= anchors.last[own]) & (anchors.place[own] + 24 <= anchors.first[own] + 50)).all()


def test_merge_never_needs_more_than_the_front_codes():
    rng = random.Random(6)
    runs = []
    for _ in range(7):
        strings = sorted("".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(rng.randint(0, 40)))
        runs.append((strings, [0, *(common_prefix(a, b, 0) for a, b in zip(strings, strings[1:], strict=False))][: len(strings)]))
    run, place, lcp = merge_runs(runs)
    merged = [runs[r][0][p] for r, p in zip(run, place, strict=True)]
    assert merged == sorted(s for strings, _ in runs for s in strings)
    assert lcp[1:] == [common_prefix(a, b, 0) for a, b in zip(merged, merged[1:], strict=False)]


def test_front_coded_runs_round_trip():
    strings = sorted([b"abc", b"abd", b"ab\0", b"ab", b"", b"zz"])
    size = np.array([len(s) for s in strings])
    right = np.array([list(s.ljust(50, b"\0")) for s in strings], np.uint8)
    n = np.arange(len(strings))
    run = Run(Run.pack(n, n, n, n, n * 0, right, size, np.tile(np.arange(26, dtype=np.uint8), (len(strings), 1))), 26)
    assert run.suffixes == strings and run.low.tolist() == n.tolist()
    assert all(run.left[i, 26 - i :].tolist() == list(range(26 - i, 26)) for i in n)


def test_odd_rows(odd, odd_rows, empty):
    assert got(odd) == brute([(r[0], (r[1] or "").encode()) for r in odd_rows])
    assert remove_repeats(empty).count() == 0
