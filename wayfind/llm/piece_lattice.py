"""SentencePiece encoding and decoding as a relational lattice.

Texts fall into units between which no piece of the model can reach: two characters that no piece has side by side part.
Only distinct units are encoded.  Their substrings up to the longest piece are exploded and joined with the piece table; the
edges found are grouped by unit, and a higher-order ``aggregate`` folds them into pieces:

* for BPE models the fold visits the edges by rank and place and joins what is adjacent at that moment; the state is one number
  with a bit per place where a symbol starts.  That equals merging the best adjacent pair until none is left as long as no
  piece becomes possible after its turn; which pieces can is known of the model, since a piece is always made as it is made
  alone.  Units with such a piece (runs of spaces), with characters that are no piece, or above ``PASS`` characters are folded
  pair by pair.  A Viterbi fold over BPE scores gives other ids than the library, because the scores are merge ranks and not
  log probabilities, so it can't be used for them;
* for unigram models the fold is Viterbi: the best score to every position, then the way back.

Characters without a piece become their UTF-8 bytes' pieces (or the unknown id if the model has none).  Units above
``LONG`` characters, for which a fold over arrays would be quadratic, are merged with a heap instead (BPE) or folded the same
way in numpy (unigram); results are equal.

Documents travel as blocks: a task packs consecutive rows, all columns, into compressed record batches of about ``BLOCK_BYTES``
of text.  A block asks for the ids of its distinct units, packed per part (a hash of the unit); parts make their units distinct,
encode them through the lattice and answer in the order of the question; blocks look their units up in the answers.  So neither
words nor ids cross a shuffle once per occurrence, nothing is gathered on the driver, and the two uses of the blocks and of the
questions share their exchanges.  Units stay dealt by part from their distinct to the answer, so their ids cross no shuffle.

Null and empty texts have no pieces.  Repeated rows are encoded one by one.  Models that normalise texts beyond escaping
spaces and one space in front are refused.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfind.llm.personal_data import bind

SPACE = "▁"
LONG, PASS = 120, 60
BLOCK_BYTES, PART_BYTES, WINDOW = 6 << 20, 16 << 20, 1 << 18  # of text
PARTS = 128  # as many if there is a megabyte for each, so that the parts of a task are even
SEED = 42
STEP = 64  # an edge is numbered start * STEP + length; longer than any piece
LOWEST = -1e300
ID_BITS, ID_MASK = 20, (1 << 20) - 1
# an edge is one number: late (1 bit), rank, start (7 bits), length (7 bits) and id (20 bits), so that numbers sort by rank and start
SIZE_AT, START_AT, RANK_AT, LATE = 20, 27, 34, 1 << 60
APART = 1 << 30  # rank of a pair that is no piece


@dataclass(frozen=True)
class Model:
    """What the lattice needs of a model file."""

    pieces: dict[str, tuple[int, float]]  # ordinary pieces: id, score
    bytes_of: tuple[bytes, ...]  # of every id, for decoding
    byte_ids: tuple[int, ...]  # of the 256 bytes, or empty
    unknown: int
    kind: str  # "bpe" or "unigram"
    pairs: str  # the pairs of characters that some piece has side by side, one after another
    late: frozenset[str]  # pieces that merging may make after their rank's turn

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces))

    @property
    def scores(self) -> list[float]:
        """The distinct scores, best first; a piece's rank is the place of its score."""
        return sorted({s for _, s in self.pieces.values()}, reverse=True)


def make_model(pieces: dict[str, tuple[int, float]], bytes_of: tuple[bytes, ...], byte_ids: tuple[int, ...], unknown: int, kind: str) -> Model:
    if max(map(len, pieces)) >= STEP or any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
        raise ValueError("pieces of 64 characters or with an inner space are not supported")
    pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
    late = frozenset(p for p in pieces if len(p) > 2 and _is_late(p, pieces)) if kind == "bpe" else frozenset()
    return Model(pieces, bytes_of, byte_ids, unknown, kind, "".join(sorted(pairs)), late)


def _is_late(piece: str, pieces: dict[str, tuple[int, float]]) -> bool:
    """Whether merging the piece's own characters makes any step that is not after the one before, by rank and place.

    Inside any unit a piece is made by the same steps: until it is whole, nothing across its ends was joined.
    """
    symbols, before = list(piece), (-np.inf, 0)
    while len(symbols) > 1:
        known = [pieces.get(a + b) for a, b in zip(symbols, symbols[1:], strict=False)]
        ways = [(-x[1], sum(map(len, symbols[:i])), i) for i, x in enumerate(known) if x]
        if not ways:
            return False  # never made
        cost, start, i = min(ways)
        if (cost, start) <= before:
            return True
        before, symbols[i : i + 2] = (cost, start), [symbols[i] + symbols[i + 1]]
    return False


_MODELS: dict[tuple[str, str], Model] = {}


def load_model(path: str, kind: str = "bpe") -> Model:
    """Reads the piece table of a SentencePiece model; ``kind`` is how it was trained.  One per worker."""
    if (path, kind) not in _MODELS:
        import sentencepiece

        reader = sentencepiece.SentencePieceProcessor(model_file=path)
        for probe in ("  a  b ", "ﬁ ½\tÅ"):
            if reader.normalize(probe) != SPACE + probe.replace(" ", SPACE):
                raise ValueError("the model normalises texts; only escaped spaces and one space in front are supported")
        pieces, raw, single = {}, [], {}
        for i in range(reader.vocab_size()):
            name = reader.id_to_piece(i)
            if reader.is_byte(i):
                single[int(name[3:5], 16)] = i
                raw.append(bytes([int(name[3:5], 16)]))
            elif reader.is_control(i) or reader.is_unknown(i):
                raw.append(" ⁇ ".encode() if reader.is_unknown(i) else b"")
            else:
                pieces[name] = (i, reader.get_score(i))
                raw.append(name.replace(SPACE, " ").encode())
        byte_ids = tuple(single[b] for b in range(256)) if len(single) == 256 else ()
        _MODELS[path, kind] = make_model(pieces, tuple(raw), byte_ids, reader.unk_id(), kind)
    return _MODELS[path, kind]


class _Cut:
    """Cuts texts into units."""

    def __init__(self, pairs: str) -> None:
        number = {c: i for i, c in enumerate(sorted(set(pairs)), 1)}
        self.kind, self.kinds = np.zeros(0x110000, np.int32), len(number) + 1
        self.kind[[ord(c) for c in number]] = list(number.values())
        self.linked = np.zeros(self.kinds**2, bool)
        self.linked[[number[a] * self.kinds + number[b] for a, b in zip(pairs[::2], pairs[1::2], strict=True)]] = True

    def units(self, texts: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
        """The units of all texts one after another, and where each text begins among them."""
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), " ", SPACE).combine_chunks()
        whole = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        space, nothing = pa.scalar(SPACE, pa.large_string()), pa.scalar("", pa.large_string())
        whole = pc.if_else(pc.equal(pc.binary_length(whole), 0), nothing, pc.binary_join_element_wise(space, whole, nothing))
        edge = np.append(0, np.cumsum(pc.binary_length(whole).to_numpy(zero_copy_only=False).astype(np.int64)))
        data = whole.buffers()[2] or pa.py_buffer(b"")
        octets, starts, low, last = np.frombuffer(data, np.uint8), [], 0, 0
        while low < edge[-1]:
            high = int(min(low + WINDOW, edge[-1]))
            while high < edge[-1] and octets[high] & 0xC0 == 0x80:
                high -= 1
            codes = np.frombuffer(str(octets[low:high], "utf-8").encode("utf-32-le"), np.uint32)
            at = np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))
            at = np.append(low, low + at[:-1])
            kind = self.kind[codes]
            first = ~self.linked[np.append(last, kind[:-1]) * self.kinds + kind]
            first[np.searchsorted(at, edge[np.searchsorted(edge, low) : np.searchsorted(edge, high)])] = True
            starts.append(at[first])
            low, last = high, kind[-1]
        starts = np.concatenate([*starts, edge[-1:]])
        units = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), data)
        return units, np.searchsorted(starts, edge)


cut = cache(_Cut)


def _fallback_ids(model: Model, char: Column) -> Column:
    """Ids of a character that is no piece."""
    if not model.byte_ids:
        return F.array(F.lit(model.unknown))
    codes = F.hex(F.encode(char, "UTF-8"))
    table = F.array(*[F.lit(i) for i in model.byte_ids])
    at = F.sequence(F.lit(1), F.length(codes), F.lit(2))
    return F.transform(at, lambda i: F.get(table, F.conv(F.substring(codes, i, F.lit(2)), 16, 10).cast("int")))


def _known_id(found: Column, start: Column, size: Column) -> Column:
    return F.try_element_at(found, start * STEP + size).bitwiseAND(ID_MASK).cast("int")


def _field(edge: Column, at: int, bits: int) -> Column:
    return F.shiftright(edge, at).bitwiseAND((1 << bits) - 1)


def _by_place(edges: Column) -> Column:
    """The edges as a map from start * STEP + length to rank and id in one number."""

    def entry(e: Column) -> Column:
        key = (_field(e, START_AT, 7) * STEP + _field(e, SIZE_AT, 7)).cast("int")
        return F.struct(key, F.shiftleft(_field(e, RANK_AT, 26), ID_BITS) + e.bitwiseAND(ID_MASK))

    return F.map_from_entries(F.transform(edges, entry))


def _merge(unit: Column, edges: Column, model: Model) -> Column:
    """Ids by merging: in one pass over the edges if that is the same, else pair by pair."""
    regular = (F.length(unit) <= PASS) & (F.element_at(edges, -1) < LATE)
    return F.coalesce(F.when((F.size(edges) > 0) & regular, _pass(unit, edges)), _pairs(unit, _by_place(edges), model))


def _pass(unit: Column, edges: Column) -> Column:
    """Ids by one pass over the edges in their order; null if a character is no piece.

    The state has bit i set if a symbol starts at place i, and the bit behind the last place.
    """
    one = F.lit(1).cast("long")

    def left(value: Column, places: Column) -> Column:
        return F.call_function("shiftleft", value, places)

    def ends(e: Column) -> Column:
        return left(left(one, _field(e, SIZE_AT, 7).cast("int")) + 1, _field(e, START_AT, 7).cast("int"))

    def inside(state: Column, e: Column) -> Column:  # the bits from the edge's start to its end
        full = left(left(one, _field(e, SIZE_AT, 7).cast("int") + 1) - 1, _field(e, START_AT, 7).cast("int"))
        return state.bitwiseAND(full)

    def step(state: Column, e: Column) -> Column:
        both = state.bitwiseAND(ends(e)) == ends(e)
        return F.when((F.bit_count(inside(state, e)) == 3) & both, state.bitwiseXOR(inside(state, e)).bitwiseOR(ends(e))).otherwise(state)

    def ids(b: Column) -> Column:
        symbols = F.filter(b["edges"], lambda e: inside(b["state"], e) == ends(e))
        ordered = F.transform(F.sort_array(F.transform(symbols, lambda e: e.bitwiseAND((1 << RANK_AT) - 1))), lambda e: e.bitwiseAND(ID_MASK).cast("int"))
        return F.struct(F.when(F.size(symbols) == F.bit_count(b["state"]) - 1, ordered).alias("ids"))

    begin = left(one, F.length(unit) + 2) - 2
    return bind(F.struct(edges.alias("edges"), F.aggregate(edges, begin, step).alias("state")), ids)["ids"]


def _pairs(unit: Column, edges: Column, model: Model) -> Column:
    """Ids by merging: every step joins the adjacent pair whose piece scores best, the leftmost of equals.

    A symbol is one number: the rank of the piece it makes with its successor, where it starts (9 bits) and its length
    (7 bits).  So the least number is the pair to join, and the state is a plain array.
    """

    def run(bound: Column) -> Column:
        text, found = bound["unit"], bound["edges"]

        def symbol(start: Column, size: Column, pair: Column) -> Column:
            known = F.shiftright(F.try_element_at(found, start * STEP + pair), ID_BITS)
            return F.shiftleft(F.coalesce(known, F.lit(APART)), 16) + start * 128 + size

        n = F.length(text)
        first = F.transform(F.sequence(F.lit(1), n), lambda i: symbol(i, F.lit(1), F.when(i < n, 2)))

        def step(acc: Column, _: Column) -> Column:
            def join(b: Column) -> Column:
                symbols, best, place = b["s"], b["best"], b["place"]
                start = F.shiftright(best, 7).bitwiseAND(511).cast("int")
                size = (best.bitwiseAND(127) + F.get(symbols, place).bitwiseAND(127)).cast("int")
                before, after = F.get(symbols, place - 2), F.get(symbols, place + 1)
                new = symbol(start, size, size + after.bitwiseAND(127).cast("int"))
                at, length = F.shiftright(before, 7).bitwiseAND(511).cast("int"), before.bitwiseAND(127).cast("int")
                both = F.array_compact(F.array(symbol(at, length, length + size), new))  # without a predecessor the first is null
                return F.concat(F.slice(symbols, 1, F.greatest(place - 2, F.lit(0))), both, F.slice(symbols, place + 2, F.size(symbols)))

            best = F.array_min(acc)
            chosen = F.struct(acc.alias("s"), best.alias("best"), F.array_position(acc, best).cast("int").alias("place"))
            return F.when(best >= (APART << 16), acc).otherwise(bind(chosen, join))

        symbols = F.aggregate(F.sequence(F.lit(1), n), first, step)

        def ids(x: Column) -> Column:
            start, size = F.shiftright(x, 7).bitwiseAND(511).cast("int"), x.bitwiseAND(127).cast("int")
            known = _known_id(found, start, size)
            return F.when(known.isNotNull(), F.array(known)).otherwise(_fallback_ids(model, F.substring(text, start, size)))

        return F.flatten(F.transform(symbols, ids))

    return bind(F.struct(unit.alias("unit"), edges.alias("edges")), run)


def _viterbi(unit: Column, edges: Column, model: Model) -> Column:
    """Ids of the best path: to every position the best (score, start), then back from the end.

    A character without a piece costs more than any piece, as in the library.
    """
    lowest = model.scores[-1] - 10.0
    scores = F.array(*[F.lit(float(x)) for x in model.scores])

    def run(bound: Column) -> Column:
        text, found = bound["unit"], bound["edges"]
        zero = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("start")))

        def score(start: Column, size: Column) -> Column:
            return F.get(scores, F.shiftright(F.try_element_at(found, start * STEP + size), ID_BITS).cast("int"))

        def reach(acc: Column, end: Column) -> Column:
            starts = F.sequence(F.greatest(F.lit(1), end - model.longest + 1), end)
            rated = F.transform(
                starts,
                lambda s: F.struct(
                    (
                        F.get(acc, s - 1)["score"]
                        + F.coalesce(score(s, end - s + 1), F.when(s == end, lowest).otherwise(LOWEST))
                    ).alias("score"),
                    s.alias("start"),
                ),
            )
            return F.array_append(acc, F.array_max(rated))

        def back(b: Column) -> Column:
            best = b["best"]
            begin = F.struct(F.length(text).alias("end"), F.array().cast("array<struct<start:int,size:int>>").alias("path"))

            def step(acc: Column, _: Column) -> Column:
                start = F.get(best, acc["end"])["start"]
                one = F.array(F.struct(start.alias("start"), (acc["end"] - start + 1).alias("size")))
                on = F.struct((start - 1).alias("end"), F.concat(one, acc["path"]).alias("path"))
                return F.when(acc["end"] > 0, on).otherwise(acc)

            return F.aggregate(F.sequence(F.lit(1), F.length(text)), begin, step, lambda acc: acc["path"])

        path = bind(F.struct(F.aggregate(F.sequence(F.lit(1), F.length(text)), zero, reach).alias("best")), back)

        def ids(x: Column) -> Column:
            known = _known_id(found, x["start"], x["size"])
            return F.when(known.isNotNull(), F.array(known)).otherwise(_fallback_ids(model, F.substring(text, x["start"], x["size"])))

        return F.flatten(F.transform(path, ids))

    return bind(F.struct(unit.alias("unit"), _by_place(edges).alias("edges")), run)


def merge_long(unit: str, model: Model) -> list[int]:
    """The same merges with a heap, for units too long for a fold."""
    size, after = [1] * len(unit), list(range(1, len(unit) + 1))
    before, heap = list(range(-1, len(unit) - 1)), []

    def offer(i: int) -> None:
        if i >= 0 and size[i] and after[i] < len(unit):
            piece = unit[i : i + size[i] + size[after[i]]]
            if piece in model.pieces:
                heapq.heappush(heap, (-model.pieces[piece][1], i, len(piece)))

    for i in range(len(unit)):
        offer(i)
    while heap:
        _, i, length = heapq.heappop(heap)
        j = after[i]
        if not size[i] or j >= len(unit) or size[i] + size[j] != length:
            continue
        size[i], size[j], after[i] = length, 0, after[j]
        if after[i] < len(unit):
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return _path_ids(unit, [(i, s) for i, s in enumerate(size) if s], model)


def viterbi_long(unit: str, model: Model) -> list[int]:
    lowest, best, start = min(s for _, s in model.pieces.values()) - 10.0, [0.0], [0]
    for end in range(1, len(unit) + 1):
        ways = []
        for s in range(max(0, end - model.longest), end):
            found = model.pieces.get(unit[s:end])
            ways.append((best[s] + (found[1] if found else lowest if s == end - 1 else LOWEST), s))
        score, s = max(ways)
        best.append(score), start.append(s)
    path, end = [], len(unit)
    while end:
        path.append((start[end], end - start[end]))
        end = start[end]
    return _path_ids(unit, path[::-1], model)


def _path_ids(unit: str, path: list[tuple[int, int]], model: Model) -> list[int]:
    out: list[int] = []
    for i, s in path:
        piece = unit[i : i + s]
        if piece in model.pieces:
            out.append(model.pieces[piece][0])
        else:
            out += [model.byte_ids[b] for b in piece.encode()] if model.byte_ids else [model.unknown]
    return out


_ZSTD = {"compression": pa.Codec("zstd", compression_level=3)}


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(**_ZSTD)) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _planes(numbers: np.ndarray) -> bytes:
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _zipped(sizes: np.ndarray, body: bytes) -> bytes:
    """The sizes and their items as compressed bytes, without the schema that would be most of a short record batch."""
    raw = _planes(sizes) + body
    return np.array([len(sizes), len(raw)], "<i8").tobytes() + _ZSTD["compression"].compress(raw, asbytes=True)


def _unzipped(data: bytes) -> tuple[np.ndarray, bytes]:
    n, size = np.frombuffer(data, "<i8", 2).tolist()
    raw = _ZSTD["compression"].decompress(data[16:], size, asbytes=True)
    return _numbers(raw[: 4 * n]), raw[4 * n :]


def _strings(packs: list[bytes]) -> tuple[pa.Array, list[int]]:
    """The strings of all packs one after another, and how many each has."""
    parts = [_unzipped(x) for x in packs]
    offsets = np.append(0, np.cumsum(np.concatenate([sizes for sizes, _ in parts])))
    data = b"".join(body for _, body in parts)
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data)), [len(sizes) for sizes, _ in parts]


def pack_blocks(block_bytes: int):
    """Rows (block, rows): consecutive rows of a task, together about ``block_bytes`` of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, kept = TaskContext.get().partitionId(), 0, 0, []

        def out() -> pa.RecordBatch:
            data = _packed(pa.Table.from_batches(kept).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + number], pa.int64()), pa.array([data], pa.binary())], names=["block", "rows"])

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
            edges = np.flatnonzero(np.diff(np.cumsum(lengths) // block_bytes, prepend=0)).tolist()
            for low, high in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if low == high:
                    continue
                kept.append(batch.slice(low, high - low))
                held += int(lengths[low:high].sum())
                if held >= block_bytes:
                    yield out()
                    number, held, kept = number + 1, 0, []
        if kept:
            yield out()

    return run, "block long, rows binary"


class _Block:
    """The rows of a block, the number of every unit in its texts, and its questions per part."""

    def __init__(self, table: pa.Table, pairs: str, parts: int) -> None:
        self.rows = pa.concat_tables([_unpacked(x) for x in table.column("rows").to_pylist()])
        units, self.edge = cut(pairs).units(self.rows.column("text"))
        coded = units.dictionary_encode()
        self.which, self.units = coded.indices.to_numpy(), coded.dictionary
        names = self.units.cast(pa.large_binary()).to_pylist()
        part = np.fromiter(map(xxhash.xxh64_intdigest, names, repeat(SEED)), np.uint64, len(names)) % np.uint64(parts)
        self.order = pc.sort_indices(pa.table({"part": part, "unit": self.units}), [("part", "ascending"), ("unit", "ascending")]).to_numpy()
        part = part[self.order].astype(np.int64)
        low = np.flatnonzero(np.diff(part, prepend=-1))
        self.asked = list(zip(part[low].tolist(), low.tolist(), np.append(low[1:], len(part)).tolist(), strict=True))


def ask(pairs: str, parts: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        block = _Block(table, pairs, parts)
        units = block.units.take(pa.array(block.order))
        sizes = pc.binary_length(units).to_numpy()
        edge, data = np.append(0, np.cumsum(sizes)), memoryview(units.buffers()[2] or b"")
        packs = [_zipped(sizes[i:j], bytes(data[edge[i] : edge[j]])) for _, i, j in block.asked]
        number = pa.array([key[0].as_py()] * len(packs), pa.int64())
        out = pa.table({"part": pa.array([p for p, _, _ in block.asked], pa.int32()), "block": number, "units": pa.array(packs, pa.binary())})
        del block, units, data
        pa.default_memory_pool().release_unused()
        return out

    return run, "part int, block long, units binary"


def distinct_units():
    """(part, unit) of one part, once each."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        units = _strings(table.column("units").to_pylist())[0].unique().cast(pa.string())
        return pa.table({"part": pa.array(np.full(len(units), key[0].as_py(), np.int32)), "unit": units})

    return run, "part int, unit string"


def answer(model: Model):
    """Ids of the asked units, in the order of the question; units too long for a fold are encoded here."""
    slow = merge_long if model.kind == "bpe" else viterbi_long

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        units = known.column("unit").cast(pa.large_string()).combine_chunks()
        units = units.chunk(0) if isinstance(units, pa.ChunkedArray) else units
        ids = known.column("ids").combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        ids = ids.cast(pa.list_(pa.int32()))
        place = np.arange(len(units))
        open_ = np.flatnonzero(pc.is_null(ids).to_numpy(zero_copy_only=False))
        if len(open_):
            place[open_] = len(units) + np.arange(len(open_))
            ids = pa.concat_arrays([ids, pa.array([slow(units[i].as_py(), model) for i in open_.tolist()], pa.list_(pa.int32()))])
        wanted, counts = _strings(asked.column("units").to_pylist())
        found = ids.take(pa.array(place[pc.index_in(wanted, value_set=units).to_numpy()]))
        sizes = pc.list_value_length(found).to_numpy()
        edge, flat = np.append(0, np.cumsum(sizes)), found.flatten().to_numpy()
        upto = np.cumsum(counts).tolist()
        out = [_zipped(sizes[i:j], _planes(flat[edge[i] : edge[j]])) for i, j in zip([0, *upto], upto, strict=False)]
        return pa.table({"block": asked.column("block"), "part": asked.column("part"), "ids": pa.array(out, pa.binary())})

    return run, "block long, part int, ids binary"


def look_up(pairs: str, parts: int, column: str):
    """The rows of a block with the ids of their texts."""

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        block = _Block(table, pairs, parts)
        del table
        found = dict(zip(replies.column("part").to_pylist(), replies.column("ids").to_pylist(), strict=True))
        lists = [_unzipped(found[p]) for p, _, _ in block.asked]
        size = np.concatenate([x for x, _ in lists]) if lists else np.zeros(0, np.int64)
        flat = np.concatenate([_numbers(x) for _, x in lists]).astype(np.int32) if lists else np.zeros(0, np.int32)
        begin = np.append(0, np.cumsum(size))
        at = np.empty(len(block.order), np.int64)
        at[block.order] = np.arange(len(block.order))
        at = at[block.which]
        total = np.append(0, np.cumsum(size[at]))
        where = np.repeat((begin[at] - total[:-1]).astype(np.int32), size[at])  # a block has less than 2^31 ids
        where += np.arange(total[-1], dtype=np.int32)
        ids = flat[where]
        del where, at, flat, lists, replies, found
        pa.default_memory_pool().release_unused()
        rows = pa.LargeListArray.from_arrays(pa.array(total[block.edge], pa.int64()), pa.array(ids, pa.int32())).cast(pa.list_(pa.int32()))
        return block.rows.append_column(column, rows)

    return run


def lattice(units: DataFrame, model: Model) -> DataFrame:
    """The rows of ``units`` with ``edges``: the pieces found among the substrings of ``unit``, as sorted numbers."""
    spark = units.sparkSession
    rank = {x: i for i, x in enumerate(model.scores)}
    values = [(p in model.late) * LATE + (rank[x] << RANK_AT) + (len(p) << SIZE_AT) + i for p, (i, x) in model.pieces.items()]
    pieces = spark.createDataFrame(pa.table({"piece": list(model.pieces), "value": values}))  # one row per piece of the vocabulary
    # a unit above LONG has no substrings here, and one row of every unit stays even if nothing is found
    n = F.length("unit")
    starts = units.select(*units.columns, n.alias("n"), F.explode_outer(F.when(n <= LONG, F.sequence(F.lit(1), n))).alias("start"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(model.longest), F.col("n") - F.col("start") + 1))
    spans = starts.select(*units.columns, "start", F.explode_outer(F.when(F.col("start").isNotNull(), sizes)).alias("size"))
    edges = spans.select(*units.columns, "start", "size", F.substring("unit", F.col("start"), F.col("size")).alias("piece"))
    first = F.coalesce((F.col("start") == 1) & (F.col("size") == 1), F.lit(True))
    met = edges.join(F.broadcast(pieces), "piece", "left").where(F.col("value").isNotNull() | first)
    found = F.col("value") + F.shiftleft(F.col("start").cast("long"), START_AT)
    return met.groupBy(*units.columns).agg(F.sort_array(F.collect_list(found)).alias("edges"))


def encode_documents(docs: DataFrame, model: Model, column: str = "ids", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with the piece ids of ``text`` in ``column``, which replaces a column of that name."""
    docs = docs.drop(column)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(max(min(PARTS, size >> 20), -(-size // PART_BYTES), 1))
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.ArrayType(T.IntegerType()))])
    blocks = docs.mapInArrow(*pack_blocks(block_bytes)).groupBy("block")
    # questions and units are dealt by part into a fixed number of tasks, once each: the grouping of the edges and the
    # meeting of questions and ids need no further exchange
    tasks = max(parts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = blocks.applyInArrow(*ask(model.pairs, parts)).repartition(tasks, "part")
    units = asked.groupBy("part").applyInArrow(*distinct_units()).repartition(tasks, "part")
    fold = _merge if model.kind == "bpe" else _viterbi
    ids = F.when(F.length("unit") <= LONG, fold(F.col("unit"), F.col("edges"), model))
    known = lattice(units, model).select("part", "unit", ids.alias("ids"))
    replies = asked.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(*answer(model))
    return blocks.cogroup(replies.groupBy("block")).applyInArrow(look_up(model.pairs, parts, column), schema)


def decode_documents(encoded: DataFrame, model: Model, column: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the text of the ids; bytes that are no UTF-8 become the replacement character."""
    encoded = encoded.drop(text)
    names, table = encoded.columns, pa.array(model.bytes_of, pa.large_binary())
    schema = T.StructType([*encoded.schema.fields, T.StructField(text, T.StringType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
            lists = batch.column(names.index(column))
            pieces = table.take(lists.flatten())
            edge = np.append(0, np.cumsum(pc.binary_length(pieces).to_numpy()))
            edge = edge[np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy()))].tolist()
            data = memoryview(pieces.buffers()[2] or b"")
            raw = (data[i + (data[i : i + 1] == b" ") : j] for i, j in zip(edge, edge[1:], strict=False))
            out = pa.array([str(x, "utf-8", "replace") for x in raw], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*names, text])

    return encoded.mapInArrow(rows, schema)
