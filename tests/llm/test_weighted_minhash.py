from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from wayfind.llm.common import components
from wayfind.llm.weighted_minhash import BUCKETS, Sampler, drop_near_duplicates, near_duplicates, shingles, weighted_jaccard


def bag(text: str) -> Counter:
    w = text.encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def classes(texts: list[tuple[int, str]], level: float) -> dict[int, int]:
    parent = {d: d for d, _ in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [(d, bag(t)) for d, t in texts]
    for i, (d, a) in enumerate(bags):
        for e, b in bags[:i]:
            if a and b and sum((a & b).values()) >= level * sum((a | b).values()):
                p, q = find(d), find(e)
                parent[max(p, q)] = min(p, q)
    return {d: find(d) for d in parent}


def test_documents_of_the_test_table(documents, texts):
    rows = near_duplicates(documents).collect()
    assert {r.doc_id: r.class_id for r in rows} == classes(texts, 0.8)
    assert all(r.kept == (r.doc_id == r.class_id) for r in rows)


def planted(seed: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(120, 300))]
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("chunk", [1024, 3])
def test_planted_copies(spark, chunk):
    texts = planted(2)
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), chunk=chunk).collect()}
    assert got == classes(texts, 0.8)


def test_samples_estimate_the_weighted_similarity():
    rng = np.random.default_rng(4)
    sampler = Sampler(np.zeros(BUCKETS, np.int64))
    for share in (0.3, 0.6, 0.9):
        hits = []
        for _ in range(40):
            keys = np.unique(rng.integers(0, 1 << 62, 900).astype(np.uint64))
            times = rng.integers(1, 5, len(keys))
            both = rng.random(len(keys)) < share
            a, b = both | (rng.random(len(keys)) < 0.5), both | (rng.random(len(keys)) < 0.5)
            steps = sampler.steps(keys, times)
            drawn = [sampler.sketch(np.zeros(m.sum(), np.int64), keys[m], steps[m], 1)[0] for m in (a, b)]
            weights = 2 ** (steps / 16)
            hits.append(((drawn[0] == drawn[1]).mean(), weighted_jaccard((keys[a], weights[a]), (keys[b], weights[b]))))
        estimate, exact = np.mean(hits, axis=0)
        assert estimate == pytest.approx(exact, abs=0.04)


def test_common_shingles_weigh_less():
    levels = np.zeros(BUCKETS, np.int64)
    _, keys, times, _ = shingles([b"a b c d e f"])
    assert (Sampler(levels - 5).steps(keys, times) < Sampler(levels).steps(keys, times)).all()
    assert weighted_jaccard((np.array([1, 2], np.uint64), np.array([1.0, 2.0])), (np.array([2, 3], np.uint64), np.array([1.0, 1.0]))) == pytest.approx(1 / 4)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201), (201, 202), (202, 200), (5, 5), (300, 250)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 140), 100), **dict.fromkeys((200, 201, 202), 200), **dict.fromkeys((250, 300), 250)}


def test_odd_rows(odd, odd_rows, empty):
    rows = near_duplicates(odd).collect()
    assert len(rows) == len(odd_rows)
    assert {r.doc_id: r.class_id for r in rows if r.doc_id in (1, 2, 3, 4, 5, 6)} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    assert all(r.kept and r.class_id is None for r in rows if r.doc_id is None)
    kept = drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted([*map(str, (1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13)), "None", "None"])
    assert near_duplicates(empty).count() == 0 and drop_near_duplicates(empty).count() == 0
