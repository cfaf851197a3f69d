from __future__ import annotations

import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from wayfind.llm.piece_lattice import _merge, _viterbi, decode_documents, encode_documents, lattice, load_model, make_model, merge_long, viterbi_long

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return load_model(PATH)


def check(encoded, texts, model) -> None:
    rows = decode_documents(encoded, model).collect()
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in rows) == sorted((str(d), LIBRARY.encode(t), LIBRARY.decode(LIBRARY.encode(t))) for d, t in texts)


@pytest.mark.parametrize("block_bytes", [32 << 20, 20_000])
def test_ids_equal_the_library(documents, texts, model, block_bytes):
    check(encode_documents(documents, model, block_bytes=block_bytes), texts, model)


@pytest.mark.parametrize("block_bytes", [32 << 20, 1000])
def test_odd_rows(odd, odd_rows, empty, model, block_bytes):
    texts = [(r[0], r[1] or "") for r in odd_rows]
    encoded = encode_documents(odd, model, block_bytes=block_bytes)
    assert encoded.columns == [*odd.columns, "ids"]
    check(encoded, texts, model)
    assert encode_documents(odd, model, "kept").columns == [c for c in odd.columns if c != "kept"] + ["kept"]
    assert encode_documents(empty, model).count() == 0


def test_folds_equal_their_plain_twins(spark, model):
    rng = random.Random(3)
    units = sorted({"▁" + "".join(rng.choice("abcdefthersing,.é😀") for _ in range(rng.randint(1, 60))) for _ in range(150)} | {"▁▁▁", "é", "x" * 80})
    frame = lattice(spark.createDataFrame([(u,) for u in units], "unit string").distinct(), model)
    got = {r.unit: r.ids for r in frame.select("unit", _merge(F.col("unit"), F.col("edges"), model).alias("ids")).collect()}
    assert got == {u: merge_long(u, model) for u in units}


def best_path(unit: str, pieces: dict) -> float:
    best = [0.0] + [-1e18] * len(unit)
    for end in range(1, len(unit) + 1):
        for start in range(end):
            if unit[start:end] in pieces:
                best[end] = max(best[end], best[start] + pieces[unit[start:end]][1])
    return best[-1]


def test_viterbi_finds_the_best_path(spark):
    rng = random.Random(8)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(60)} | set("abc▁"))
    pieces = {p: (i + 1, -rng.uniform(1, 9) * len(p) ** 0.7) for i, p in enumerate(names)}
    model = make_model(pieces, (b"", *(p.encode() for p in names)), (), 0, "unigram")
    units = sorted({"▁" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 25))) for _ in range(80)} | {"▁axb"})
    frame = lattice(spark.createDataFrame([(u,) for u in units], "unit string").distinct(), model)
    back = {i: p for p, (i, _) in pieces.items()}
    for r in frame.select("unit", _viterbi(F.col("unit"), F.col("edges"), model).alias("ids")).collect():
        assert r.ids == viterbi_long(r.unit, model)
        if "x" not in r.unit:
            assert "".join(back[i] for i in r.ids) == r.unit
            assert sum(pieces[back[i]][1] for i in r.ids) == pytest.approx(best_path(r.unit, pieces))
        else:
            assert 0 in r.ids
