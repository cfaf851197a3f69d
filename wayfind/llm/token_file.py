"""Token files: static range asymmetric numeral system (rANS) over token ids.

A file is a Parquet folder whose rows are segments of whole documents in ascending id order, about ``SEGMENT`` tokens each.
A segment has one frequency table that its blocks share.  A block codes up to ``BLOCK`` ids with many interleaved lanes
(id ``i`` belongs to lane ``i mod lanes``), one 64-bit state per lane and 32-bit words, so that coding and decoding are
numpy operations over all lanes.  Every ``CHECKPOINT`` steps the lane states and the place in the words are stored, from
where decoding may start as well; a CRC-32 guards each block.  Blocks are independent of each other.

    block: "RNS1", lanes u32, ids u64, checkpoints u32, words u32, states u64[lanes],
           per checkpoint (step u32, place u32, states u64[lanes]), words u32[], crc32 u32
    table: zlib of symbols u32[] and frequencies u32[]; the frequencies sum to 2^20

Segments are made in one pass: Spark orders the texts by id over range partitions, and a task keeps one segment at a time.

Null text is empty; every document gets the end id, so an empty one has one token.  Null ids come first.  Rows that repeat
an id stay separate, ordered by text.  A very long document makes a longer segment.  Further columns are not stored.  An
empty table gives an empty file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfind.llm.common import shared_folder
from wayfind.llm.texts import slices
from wayfind.llm.token_counts import ArrayMerger, flat_bytes

SCALE = 20
LOWEST = 1 << 31
LANES, BLOCK, SEGMENT, CHECKPOINT = 4096, 1 << 20, 1 << 22, 128
MEMO_WORDS, MEMO_BYTES = 1_000_000, 32 << 20
FILE_SCHEMA = "shard int, part int, n_tokens long, table binary, blocks array<binary>, doc_ids array<long>, doc_tokens array<long>"
_U = np.uint64


class Table:
    """Frequencies scaled to ``2^SCALE``; every symbol that occurs has at least 1."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray) -> None:
        self.symbols, self.freqs = symbols.astype(np.uint32), freqs.astype(np.uint64)
        self.starts = np.concatenate([np.zeros(1, _U), np.cumsum(self.freqs)[:-1]]).astype(np.uint64)
        self.index = np.zeros(int(symbols.max()) + 1, np.int64)
        self.index[symbols] = np.arange(len(symbols))

    @classmethod
    def count(cls, ids: np.ndarray) -> Table:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        room = (1 << SCALE) - len(symbols)
        if room < 0:
            raise ValueError("more distinct ids than the table has slots")
        freqs = 1 + counts[symbols] * room // len(ids)
        freqs[np.argmax(freqs)] += (1 << SCALE) - freqs.sum()
        return cls(symbols, freqs)

    def pack(self) -> bytes:
        return zlib.compress(self.symbols.tobytes() + self.freqs.astype(np.uint32).tobytes(), 6)

    @classmethod
    def unpack(cls, data: bytes) -> Table:
        both = np.frombuffer(zlib.decompress(data), np.uint32)
        return cls(both[: len(both) // 2], both[len(both) // 2 :])

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.symbols), dtype=np.uint32), self.freqs.astype(np.int64))


def lanes_for(n: int, lanes: int = LANES) -> int:
    return max(1, min(lanes, 1 << max(0, n.bit_length() - 7)))


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = CHECKPOINT) -> bytes:
    n = len(ids)
    lanes = lanes_for(n, lanes)
    steps = -(-n // lanes)
    at = table.index[ids]
    freq, start = table.freqs[at], table.starts[at]
    limit = freq << _U(63 - SCALE)
    state = np.full(lanes, LOWEST, _U)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    for step in range(steps - 1, -1, -1):
        row = slice(step * lanes, min(n, (step + 1) * lanes))
        f = freq[row]
        x = state[: len(f)]
        over = x >= limit[row]
        out = x[over]
        words.append(out.astype(np.uint32))
        x[over] = out >> _U(32)
        q = x // f
        x[:] = (q << _U(SCALE)) + (x - q * f) + start[row]
        if step and step % every == 0:
            marks.append((step, state.copy()))
    words.reverse()
    places = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    body = [struct.pack("<4sIQII", b"RNS1", lanes, n, len(marks), int(places[-1])), state.tobytes()]
    for step, kept in reversed(marks):
        body += [struct.pack("<II", step, int(places[step])), kept.tobytes()]
    data = b"".join([*body, *(w.tobytes() for w in words)])
    return data + struct.pack("<I", zlib.crc32(data))


def decode_block(data: bytes, table: Table, slots: np.ndarray | None = None, checkpoint: int | None = None) -> np.ndarray:
    """All ids of the block, or those from the given checkpoint on."""
    if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("a block is damaged: its checksum differs")
    slots = table.slots() if slots is None else slots
    _, lanes, n, marks, n_words = struct.unpack_from("<4sIQII", data)
    step, place, at = 0, 0, 24
    if checkpoint is not None:
        at += 8 * lanes + checkpoint * (8 + 8 * lanes)
        step, place = struct.unpack_from("<II", data, at)
        at += 8
    state = np.frombuffer(data, np.uint64, lanes, at).copy()
    words = np.frombuffer(data, np.uint32, n_words, 24 + 8 * lanes + marks * (8 + 8 * lanes)).astype(np.uint64)
    out = np.empty(n - step * lanes, np.uint32)
    mask, first = _U((1 << SCALE) - 1), step * lanes
    for low in range(first, n, lanes):
        x = state[: min(lanes, n - low)]
        slot = x & mask
        symbol = slots[slot]
        out[low - first : low - first + len(x)] = symbol
        x[:] = table.freqs[symbol] * (x >> _U(SCALE)) + slot - table.starts[symbol]
        under = np.flatnonzero(x < _U(LOWEST))
        x[under] = (x[under] << _U(32)) | words[place : place + len(under)]
        place += len(under)
    return table.symbols[out]


class Encoder:
    """Encodes texts with a tokenizers file.

    With plain byte-level pre-tokenising, a text is the sequence of its pre-tokens; they are found on arrays (see
    ``token_counts``), made distinct per slice, and encoded by the library once: those seen before are looked up in a memo
    whose number and bytes are bounded.  Other tokenizers get whole texts.

    Added tokens (such as an end-of-text mark) found in a text get their own ids, as in a plain call of the library.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        try:
            self.cutter: ArrayMerger | None = ArrayMerger(path)
        except ValueError:  # not a plain byte-level model
            self.cutter = None
        self.reset()

    def reset(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.memo_bytes = 0
        self.flat, self.ends = array("I"), array("Q", [0])

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _known(self, words: list[bytes]) -> np.ndarray:
        """The memo's numbers of distinct pre-tokens; new ones are encoded."""
        at = np.fromiter(map(self.memo.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0).tolist()
        for low in range(0, len(new), 20_000):
            some = new[low : low + 20_000]
            for i, ids in zip(some, self._ids([words[i].decode(errors="replace") for i in some]), strict=True):
                at[i] = self.memo[words[i]] = len(self.memo)
                self.memo_bytes += len(words[i])
                self.flat.extend(ids)
                self.ends.append(len(self.flat))
        return at

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids of each text); null is empty"""
        if self.cutter is None:
            each = self._ids(["" if t is None else t for t in column.to_pylist()])
            return np.fromiter((i for x in each for i in x), np.uint32), np.array([len(x) for x in each], np.int64)
        data, edges = flat_bytes(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        if len(self.memo) > MEMO_WORDS or self.memo_bytes > MEMO_BYTES:
            self.reset()
        starts, sizes, chosen, group, _ = self.cutter.split(data, edges[:-1])
        raw = data.tobytes()
        low, high = starts[chosen].tolist(), (starts[chosen] + sizes[chosen]).tolist()
        at = self._known([raw[a:b] for a, b in zip(low, high, strict=True)])[group]
        ends, flat = np.frombuffer(self.ends, np.uint64).astype(np.int64), np.frombuffer(self.flat, np.uint32)
        size, begin = ends[at + 1] - ends[at], ends[at]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        del flat, ends  # their buffers must be free before the arrays grow again
        return ids, np.diff(total[np.searchsorted(starts, edges)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def segment_row(shard: int, part: int, ids: np.ndarray, doc_ids: list, lengths: np.ndarray) -> pa.RecordBatch:
    table = Table.count(ids)
    blocks = [encode_block(ids[i : i + BLOCK], table) for i in range(0, len(ids), BLOCK)]
    columns = [
        pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([table.pack()], pa.binary()),
        pa.array([blocks], pa.list_(pa.binary())), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths.tolist()], pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "part", "n_tokens", "table", "blocks", "doc_ids", "doc_tokens"])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, segment: int = SEGMENT) -> None:
    """Encodes ``text`` of all documents and writes the token file."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part, held = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        doc_ids: list = []
        lengths: list[np.ndarray] = []
        coder = encoder(tokenizer)
        for batch in batches:
            for some in slices(batch, "text", 4096):
                flat, sizes = coder.encode(some.column(1))
                ends = np.cumsum(sizes)
                ids.append(np.insert(flat, ends, end_id).astype(np.uint32))
                doc_ids += some.column(0).to_pylist()
                lengths.append(sizes + 1)
                held += len(ids[-1])
                if held >= segment:
                    yield segment_row(shard, part, np.concatenate(ids), doc_ids, np.concatenate(lengths))
                    part, held, ids, doc_ids, lengths = part + 1, 0, [], [], []
        if doc_ids:
            yield segment_row(shard, part, np.concatenate(ids), doc_ids, np.concatenate(lengths))

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(segments, FILE_SCHEMA).write.parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def decode_segment(table: bytes, blocks: list[bytes]) -> np.ndarray:
    own = Table.unpack(table)
    slots = own.slots()
    return np.concatenate([decode_block(b, own, slots) for b in blocks])


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
            yield row, decode_segment(row["table"], row["blocks"]), np.cumsum([0, *row["doc_tokens"]])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of every document of the file."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids, edge in _decoded(batches):
            lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids.astype(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), lists], names=["doc_id", "ids"])

    return read_segments(spark, path).mapInArrow(rows, "doc_id long, ids array<long>")


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the file: doc_id, start, n_tokens, ids_crc32."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids, edge in _decoded(batches):
            raw, n = ids.astype("<u4").tobytes(), len(row["doc_ids"])
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            columns = [
                pa.array([row["shard"]] * n, pa.int32()), pa.array([row["part"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                pa.array(edge[:-1], pa.int64()), pa.array(row["doc_tokens"], pa.int64()), pa.array(sums, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "part", "doc_id", "at", "n_tokens", "ids_crc32"])

    segments = read_segments(spark, path)
    sizes = segments.select("shard", "part", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("all"))  # one row per file
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("_shard_start"))
    inside = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "part", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("_start")).join(shards, "shard")
    decoded = segments.mapInArrow(rows, "shard int, part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    start = F.col("at") + F.col("_start") + F.col("_shard_start")
    return decoded.join(starts, ["shard", "part"]).select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")


def token_digests(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> DataFrame:
    """Writes the token file (into the shared folder unless a path is given) and reads its documents back."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, end_id)
    return document_digests(spark, path)
