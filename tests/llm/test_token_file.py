from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayfind.llm.token_file import Encoder, Table, decode_block, encode_block, read_tokens, token_digests, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(texts) -> dict:
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for d, t in texts:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_documents_of_the_test_table(documents, texts):
    out = token_digests(documents, PATH, 2).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out) == expected(texts)


def test_small_segments_and_reading_ids(spark, documents, texts, tmp_path):
    path = f"file://{tmp_path}/tokens"
    write_tokens(documents.repartition(3), path, PATH, 2, segment=5000)
    tokenizer = Tokenizer.from_file(PATH)
    got = {r.doc_id: r.ids for r in read_tokens(spark, path).collect()}
    assert got == {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for d, t in texts}


@pytest.mark.parametrize("n", [1, 2, 63, 1000, 70_001])
@pytest.mark.parametrize("symbols", [1, 3, 5000])
def test_blocks_round_trip_and_start_at_checkpoints(n, symbols):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % symbols * 7).astype(np.uint32)
    table = Table.unpack(Table.count(ids).pack())
    assert table.freqs.sum() == 1 << 20
    data = encode_block(ids, table, lanes=64, every=8)
    assert (decode_block(data, table) == ids).all()
    marks = int.from_bytes(data[16:20], "little")
    for c in range(marks):
        rest = decode_block(data, table, checkpoint=c)
        assert len(rest) < n and (rest == ids[-len(rest) :]).all()
    if n > 1000 and symbols == 5000:
        assert marks > 2
        counts = np.bincount(ids)[np.bincount(ids) > 0] / n
        assert len(data) < 1.1 * n * -(counts * np.log2(counts)).sum() / 8 + 64 * 8 * (marks + 1) + 200


def test_damage_is_noticed():
    ids = np.arange(1000, dtype=np.uint32) % 17
    table = Table.count(ids)
    data = bytearray(encode_block(ids, table))
    data[len(data) // 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        decode_block(bytes(data), table)


def test_memo_gives_the_ids_of_whole_texts():
    texts = [
        "", " ", "  ", "a b", " a b ", "a  b", "a\n b", "a \nb", "a\n\nb c", "x  y z", "don't we'll  go\t now", "é ü\r\n z", "a b\r", "a b\n", "1 2 3 %%% ...",
        "end ", "<|endoftext|> x", "tab\t x", "　 a b", "a ​ b", "a\x1c b",
    ]
    coder = Encoder(PATH)
    for _ in range(2):  # unknown, then from the memo
        flat, sizes = coder.encode(pa.array(texts))
        parts = np.split(flat, np.cumsum(sizes)[:-1])
        for t, ids in zip(texts, parts, strict=True):
            assert ids.tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_added_tokens_in_texts_keep_their_ids():
    texts = ["end of page <|endoftext|> next page", "<|endoftext|>", "a<|endoftext|><|endoftext|>b c\n d", "no end here", "<|endoftext |> x", "<| endoftext|> x"]
    plain, coder = Tokenizer.from_file(PATH), Encoder(PATH)
    for _ in range(2):
        flat, sizes = coder.encode(pa.array(texts))
        parts = [p.tolist() for p in np.split(flat, np.cumsum(sizes)[:-1])]
        assert parts == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [p.count(50256) for p in parts] == [1, 1, 2, 0, 0, 0]


def test_other_tokenizers_get_whole_texts():
    coder = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert coder.cutter is None
    flat, _ = coder.encode(pa.array(["Hello  World again"]))
    assert flat.tolist() == coder.tokenizer.encode("Hello  World again", add_special_tokens=False).ids


def test_odd_rows(odd, odd_rows, empty):
    tokenizer = Tokenizer.from_file(PATH)
    rows = token_digests(odd, PATH, 2).orderBy("start").collect()
    assert len(rows) == len(odd_rows)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    assert [r.doc_id is None for r in rows] == [True, True] + [False] * (len(rows) - 2)
    assert sorted(r.n_tokens for r in rows) == sorted(1 + len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) for r in odd_rows)
    assert token_digests(empty, PATH, 2).count() == 0
    assert token_digests(odd.withColumn("text", F.lit(None).cast("string")), PATH, 2).agg(F.sum("n_tokens")).first()[0] == len(odd_rows)
