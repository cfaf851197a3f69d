from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wayfind.llm.token_counts import ArrayMerger, _count_column, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def expected(rows, library):
    return sorted(((str(d), len(t.encode()), n, n > 1024) for (d, t), n in zip(rows, library([t for _, t in rows]), strict=True)), key=str)


def test_equal_to_the_library_on_the_table(documents, texts, library):
    out = count_tokens(documents, PATH, 1024)
    assert sorted(((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()), key=str) == expected(texts, library)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_odd_rows_and_empty_tables(odd, odd_rows, empty, library):
    rows = [(r[0], r[1] or "") for r in odd_rows]
    out = count_tokens(odd, PATH, 1024).collect()
    assert sorted(((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in out), key=str) == expected(rows, library)
    assert count_tokens(empty, PATH, 1024).collect() == []


def test_random_texts_cut_into_small_blocks(library):
    """White space of all kinds, contractions, marks, scripts, added tokens and parts of them; long runs; places a block may end."""
    rng = random.Random(7)
    parts = ["a", "s", "'", "t", "re", "ve", "ll", " ", "  ", "\n", "　", " ", " ", "1", "2²", "é", "日本", "😀", "!", "#'",
             "<|endoftext|>", "<|", "\x1c", "\x85", "'S", "́", "\t", "\r\n", "x" * 30, "\0", "Ᲊ", "Ɤ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += ["", "x" * 100_000, "ab" * 4000, "".join(rng.choice("acgt") for _ in range(9000)), " " * 3000, "<|endoftext|>" * 3]
    own = ArrayMerger(PATH)
    want = library(texts)
    for block in (1 << 30, 500):
        sizes, tokens = _count_column(own, pa.array(texts), block)
        assert tokens.tolist() == want and sizes.tolist() == [len(t.encode()) for t in texts]


def test_hash_collisions_change_nothing(library):
    own = ArrayMerger(PATH)
    own.weights = np.zeros(1 << 16, np.uint64)  # all pre-tokens share one hash
    texts = ["some words of some length", "other words", "", "some other words"]
    assert _count_column(own, pa.array(texts), 1 << 20)[1].tolist() == library(texts)


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        ArrayMerger(public_tokenizers.path("word_bpe_49k.json"))
