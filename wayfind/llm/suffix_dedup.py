"""Exact removal of repeated passages by a distributed merge sort of suffixes that knows its common prefixes.

A byte goes if a string of ``length`` (50) bytes over it also starts in a document with a smaller id.  Texts are dealt to
blocks by hash.  Of every ``length``-byte window the leftmost smallest ``GRAM``-byte hash is its anchor; equal windows have
anchors at the same place inside them, and about one position in fourteen is an anchor.

1. Blocks send the 32-bit codes of their anchors, once each, to parts; a part answers which codes other blocks have too.
   Codes only narrow the search: what collides is told apart later.
2. Blocks take the suffixes of the anchors that may repeat, sort them, and front-code them as sorted runs.  Of suffixes that are
   equal with what lies to their left, a block sends only the one with the smallest id, and decides the others itself; so a passage
   in a third of all documents crosses the shuffle once per block.
3. A part merges its runs with a loser tree.  Every contender keeps the length of the prefix it shares with the last winner, so
   known prefixes are never compared again; the order comes out with the common prefixes of all neighbours.  From these, and the
   bytes left of the anchors, windows fall into classes of equal strings, and each class learns its smallest id.
4. Blocks mark the windows of larger ids and cut the marked bytes.

The texts are shuffled once: the three uses by block share one exchange.  Memory per task is bounded by a block or a part
(each about ``BLOCK_BYTES`` of text, or one document if that is longer).

Null text is empty.  Rows without id keep all their bytes and take none from others.  Rows that repeat an id are no smaller than
each other.  Further columns are not returned.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.texts import octets, scramble

LENGTH, GRAM = 50, 24
BLOCK_BYTES = 16 << 20
SEGMENT = 1 << 20
_PLACE = 24  # bits for a position inside a segment batch
_U = np.uint64
_BYTE = np.random.default_rng(17).integers(0, 1 << 62, 256).astype(np.uint64)
_STEP = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)]


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` (24) bytes from every place on, by doubling; 8 + 16."""
    h = _BYTE[data]
    sizes = {1: h}
    for k, n in enumerate((1, 2, 4, 8)):
        low = sizes[n]
        sizes[2 * n] = scramble(low[:-n] * _STEP[k] + low[n:])
    eight, sixteen = sizes[8], sizes[16]
    n = len(data) - gram + 1
    return scramble(sixteen[:n] * _STEP[0] + eight[16 : 16 + n])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class Anchors:
    """Anchors of a list of texts: text number, place, first and last window start, and hash, in text order."""

    def __init__(self, texts: list[bytes], length: int = LENGTH) -> None:
        found: list[tuple[np.ndarray, ...]] = []
        batch: list[tuple[int, int, bytes]] = []
        held = 0
        for number, text in enumerate(texts):
            for at in range(0, max(0, len(text) - length + 1), SEGMENT):
                part = text[at : at + SEGMENT + length - 1] if len(text) > SEGMENT else text
                batch.append((number, at, part))
                held += len(part)
                if held >= SEGMENT:
                    found.append(self._of(batch, length))
                    batch, held = [], 0
        if batch:
            found.append(self._of(batch, length))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, _U)]
        self.text, self.place, self.first, self.last, self.hash = columns

    @staticmethod
    def _of(batch: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
        sizes = np.array([len(p) for _, _, p in batch], np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(p for _, _, p in batch), np.uint8)
        hashes = gram_hashes(data)
        low = np.arange(len(hashes), dtype=_U)
        mask = _U((1 << _PLACE) - 1)
        least = _sliding_min((hashes & ~mask) | low, length - GRAM + 1)
        owner = np.repeat(np.arange(len(batch)), np.maximum(0, sizes - length + 1))
        starts = np.arange(len(owner)) - np.repeat(np.cumsum(np.maximum(0, sizes - length + 1)) - np.maximum(0, sizes - length + 1), np.maximum(0, sizes - length + 1)) + begins[owner]
        anchor = (least[starts] & mask).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        part = owner[first]
        shift = np.array([at for _, at, _ in batch], np.int64)[part] - begins[:-1][part]
        numbers = np.array([n for n, _, _ in batch], np.int64)[part]
        return numbers, anchor[first] + shift, starts[first] + shift, starts[last] + shift, scramble(hashes[anchor[first]])


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> _U(32)) % _U(parts)).astype(np.int64)


def _ordered(table: pa.Table) -> tuple[list, list[bytes]]:
    """Ids and texts of a block in an order that each use reproduces: by id, then text; rows without id last."""
    texts = octets(table.column("text").combine_chunks()) if table.num_rows else []
    rows = sorted(zip(table.column("doc_id").to_pylist(), texts, strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return [r[0] for r in rows], [r[1] for r in rows]


def _block_anchors(ids: list, texts: list[bytes]) -> Anchors:
    return Anchors(texts[: sum(i is not None for i in ids)])


def _codes(anchors: Anchors, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, code) once each in ascending order as one number, which of them each anchor has, and which lie in several texts."""
    both = (part_of(anchors.hash, parts).astype(_U) << _U(32)) | (anchors.hash & _U(0xFFFFFFFF))
    unique, which = np.unique(both, return_inverse=True)
    lowest, highest = np.full(len(unique), 1 << 62), np.full(len(unique), -1)
    np.minimum.at(lowest, which, anchors.text)
    np.maximum.at(highest, which, anchors.text)
    return unique, which, lowest != highest


def _table(schema: str, **columns) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = dict(f.split() for f in schema.split(", "))
    return pa.table({n: pa.array(columns[n], kinds[k]) for n, k in fields.items()})


def send_codes(parts: int):
    schema = "part int, block int, codes binary"

    def run(key: tuple, table: pa.Table) -> pa.Table:
        unique, _, _ = _codes(_block_anchors(*_ordered(table)), parts)
        part = (unique >> _U(32)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
        ends = np.append(edge[1:], len(part))
        low = unique.astype(np.uint32)
        return _table(schema, part=part[edge], block=[key[0].as_py()] * len(edge), codes=[low[i:j].tobytes() for i, j in zip(edge, ends, strict=True)])

    return run, schema


def answer_codes():
    schema = "block int, part int, shared binary"

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, np.uint32) for x in table.column("codes").to_pylist()]
        unique, which, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        shared = np.split((counts > 1)[which], np.cumsum([len(x) for x in lists])[:-1])
        return _table(schema, block=table.column("block").to_pylist(), part=[key[0].as_py()] * len(lists), shared=[np.packbits(x).tobytes() for x in shared])

    return run, schema


class Run:
    """Suffixes from anchors on, sorted and front-coded, with the bytes to their left and where they come from."""

    FIELDS = (("ids", np.int64), ("text", np.uint32), ("place", np.int64), ("low", np.uint8), ("high", np.uint8), ("size", np.uint8), ("lcp", np.uint8))

    @staticmethod
    def pack(ids: np.ndarray, text: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, right: np.ndarray, size: np.ndarray, left: np.ndarray) -> bytes:
        """Rows are sorted by ``right`` (zero-padded matrix of ``size`` bytes); ``left`` is right-aligned, ``low`` bytes long."""
        lcp = np.zeros(len(size), np.int64)
        if len(size) > 1:
            differ = right[1:] != right[:-1]
            same = np.where(differ.any(1), differ.argmax(1), right.shape[1])
            lcp[1:] = np.minimum(same, np.minimum(size[1:], size[:-1]))
        column = np.arange(right.shape[1])[None, :]
        tails = right[(column >= lcp[:, None]) & (column < size[:, None])]
        lefts = left[np.arange(left.shape[1])[None, :] >= left.shape[1] - low[:, None]]
        values = {"ids": ids, "text": text, "place": place, "low": low, "high": high, "size": size, "lcp": lcp}
        head = np.array([len(size), len(tails), len(lefts)], np.int64).tobytes()
        return zlib.compress(head + b"".join(values[n].astype(k).tobytes() for n, k in Run.FIELDS) + tails.tobytes() + lefts.tobytes(), 1)

    def __init__(self, data: bytes, width: int) -> None:
        raw = zlib.decompress(data)
        n, tails, lefts = (int(x) for x in np.frombuffer(raw, np.int64, 3))
        at = 24
        for name, kind in self.FIELDS:
            setattr(self, name, np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        rest, suffix, self.suffixes = memoryview(raw)[at : at + tails], b"", []
        place = 0
        for lcp, size in zip(self.lcp.tolist(), self.size.tolist(), strict=True):
            suffix = suffix[:lcp] + bytes(rest[place : place + size - lcp])
            place += size - lcp
            self.suffixes.append(suffix)
        self.left = np.zeros((n, width), np.uint8)
        low = self.low.astype(np.int64)
        self.left[np.arange(width)[None, :] >= width - low[:, None]] = np.frombuffer(raw, np.uint8, lefts, at + tails)


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    most = min(len(a), len(b))
    while known + 8 <= most and a[known : known + 8] == b[known : known + 8]:
        known += 8
    while known < most and a[known] == b[known]:
        known += 1
    return known


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """(run, place in it, common prefix with the one before) in sorted order; runs give strings and their own common prefixes.

    A loser tree: a node holds the run that lost there and the prefix it shares with the winner.  The next string of the
    winner's run shares with it what its front code says, so only bytes after a known common prefix are ever read.
    """
    width = 1
    while width < len(runs):
        width *= 2
    at = [0] * width
    lengths = [len(s) for s, _ in runs] + [0] * (width - len(runs))
    strings = [s for s, _ in runs] + [[]] * (width - len(runs))
    prefixes = [p for _, p in runs] + [[]] * (width - len(runs))
    loser, shared = [0] * width, [0] * width

    def play(a: int, la: int, b: int, lb: int) -> tuple[int, int, int, int]:
        """Winner and what it shares with the last winner, loser and what it shares with this winner."""
        if at[a] >= lengths[a]:
            return b, lb, a, 0
        if at[b] >= lengths[b] or la > lb:
            return a, la, b, lb
        if la < lb:
            return b, lb, a, la
        x, y = strings[a][at[a]], strings[b][at[b]]
        both = common_prefix(x, y, la)
        if both == len(x) == len(y):
            first = a < b
        else:
            first = both == len(x) or (both < len(y) and x[both] < y[both])
        return (a, la, b, both) if first else (b, lb, a, both)

    def build(node: int) -> tuple[int, int]:
        if node >= width:
            return node - width, 0
        a, la = build(2 * node)
        b, lb = build(2 * node + 1)
        win, lw, loser[node], shared[node] = play(a, la, b, lb)
        return win, lw

    run, place, lcp = [], [], []
    win, known = build(1) if width > 1 else (0, 0)
    for _ in range(sum(lengths)):
        run.append(win)
        place.append(at[win])
        lcp.append(known)
        at[win] += 1
        known = prefixes[win][at[win]] if at[win] < lengths[win] else 0
        node = (win + width) // 2
        while node:
            win, known, loser[node], shared[node] = play(win, known, loser[node], shared[node])
            node //= 2
    return run, place, lcp


def send_runs(parts: int, length: int = LENGTH):
    """Sorted runs for the parts, and what the block decides itself (part 0 passes it on)."""
    schema = "part int, block int, run boolean, payload binary"
    width = length - GRAM

    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts = _ordered(table)
        anchors = _block_anchors(ids, texts)
        unique, which, several = _codes(anchors, parts)
        part = (unique >> _U(32)).astype(np.int64)
        for p, bits in zip(answers.column("part").to_pylist(), answers.column("shared").to_pylist(), strict=True):
            low, high = np.searchsorted(part, [p, p + 1])
            several[low:high] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=high - low).astype(bool)
        chosen = np.flatnonzero(several[which])
        block = table.column("block")[0].as_py() if table.num_rows else None
        if not len(chosen):
            return _table(schema, part=[], block=[], run=[], payload=[])
        text, place = anchors.text[chosen], anchors.place[chosen]
        low, high = place - anchors.first[chosen], place - anchors.last[chosen]
        size = length - high
        begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        data = np.frombuffer(b"".join(texts) + bytes(length), np.uint8)
        where = begins[text] + place
        right = np.zeros((len(chosen), length), np.uint8)
        left = np.zeros((len(chosen), width), np.uint8)
        for k in range(length):
            right[:, k] = np.where(k < size, data[where + k], 0)
        for k in range(1, width + 1):
            left[:, width - k] = np.where(k <= low, data[np.maximum(where - k, 0)], 0)
        doc = np.array(ids[: int(text.max()) + 1], np.int64)[text]
        mine = part_of(anchors.hash[chosen], parts)
        # one row of bytes: part, suffix, its size, what lies left and how far, the windows it owns; then the id
        row = np.concatenate([
            mine.astype(">u4").view(np.uint8).reshape(-1, 4), right, size[:, None].astype(np.uint8), left,
            low[:, None].astype(np.uint8), high[:, None].astype(np.uint8),
        ], axis=1)
        packed = np.ascontiguousarray(row).view(f"V{row.shape[1]}").ravel()
        order = np.lexsort((place, doc))
        order = order[np.argsort(packed[order], kind="stable")]
        same = np.zeros(len(order), bool)
        same[1:] = (row[order][1:] == row[order][:-1]).all(1)
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        decided = doc[order] > doc[order][head]
        out = {"part": [], "block": [], "run": [], "payload": []}
        done = order[decided]
        if len(done):
            every = _masks(low[done], high[done])
            out = {"part": [block % parts], "block": [block], "run": [False], "payload": [pack_marks(text[done], place[done], every)]}
        keep = order[~decided]
        edge = np.flatnonzero(np.concatenate([[True], mine[keep][1:] != mine[keep][:-1]]))
        for i, j in zip(edge, np.append(edge[1:], len(keep)), strict=True):
            k = keep[i:j]
            out["part"].append(int(mine[k[0]])), out["block"].append(block), out["run"].append(True)
            out["payload"].append(Run.pack(doc[k], text[k], place[k], low[k], high[k], right[k], size[k], left[k]))
        return _table(schema, **out)

    return run, schema


def _masks(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Bit o stands for the window that starts o bytes before the anchor."""
    return ((np.int64(2) << low) - (np.int64(1) << high)).astype(np.int64)


def pack_marks(text: np.ndarray, place: np.ndarray, mask: np.ndarray) -> bytes:
    return zlib.compress(np.stack([text.astype(np.int64), place.astype(np.int64), mask.astype(np.int64)]).tobytes(), 1)


def unpack_marks(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.int64).reshape(3, -1)


def repeated_windows(ids: np.ndarray, low: np.ndarray, high: np.ndarray, left: np.ndarray, lcp: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Masks of the windows that also start in a document with a smaller id; rows in sorted order of their suffixes."""
    masks = np.zeros(len(ids), np.int64)
    before = np.zeros(len(ids), _U)
    for o in range(left.shape[1] + 1):
        if o:
            before = scramble(before * _STEP[1] + _BYTE[left[:, left.shape[1] - o]])
        rows = np.flatnonzero((high <= o) & (o <= low))
        if len(rows) < 2:
            continue
        alike = np.cumsum(lcp < length - o)[rows]  # equal from the anchor to the end of the window
        key = scramble(alike.astype(_U) * _STEP[2] + before[rows])
        order = np.lexsort((ids[rows], key))
        new = np.ones(len(rows), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        least = ids[rows][order][np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        masks[rows[order[ids[rows][order] > least]]] |= np.int64(1) << o
    return masks


def merge_parts(length: int = LENGTH):
    schema = "block int, marks binary"

    def run(key: tuple, table: pa.Table) -> pa.Table:
        blocks, kinds, payloads = (table.column(c).to_pylist() for c in ("block", "run", "payload"))
        out_blocks = [b for b, k in zip(blocks, kinds, strict=True) if not k]
        out_marks = [p for p, k in zip(payloads, kinds, strict=True) if not k]
        sources = [b for b, k in zip(blocks, kinds, strict=True) if k]
        runs = [Run(p, length - GRAM) for p, k in zip(payloads, kinds, strict=True) if k]
        if runs:
            which, place, lcp = (np.array(x, np.int64) for x in merge_runs([(r.suffixes, r.lcp.tolist()) for r in runs]))
            at = np.concatenate([[0], np.cumsum([len(r.suffixes) for r in runs])])[which] + place
            column = {n: np.concatenate([getattr(r, n) for r in runs])[at].astype(np.int64) for n in ("ids", "text", "place", "low", "high")}
            masks = repeated_windows(column["ids"], column["low"], column["high"], np.concatenate([r.left for r in runs])[at], lcp, length)
            hit = np.flatnonzero(masks)
            for r in np.unique(which[hit]):
                own = hit[which[hit] == r]
                out_blocks.append(sources[r])
                out_marks.append(pack_marks(column["text"][own], column["place"][own], masks[own]))
        return _table(schema, block=out_blocks, marks=out_marks)

    return run, schema


def cut_blocks(length: int = LENGTH):
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"

    def run(key: tuple, table: pa.Table, marks: pa.Table) -> pa.Table:
        ids, texts = _ordered(table)
        found = [unpack_marks(m) for m in marks.column("marks").to_pylist()]
        text, place, mask = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        bits = [(mask >> o) & 1 == 1 for o in range(length - GRAM + 1)]
        number = np.concatenate([text[b] for b in bits])
        start = np.concatenate([place[b] - o for o, b in enumerate(bits)])
        order = np.argsort(number, kind="stable")
        edge = np.searchsorted(number[order], np.arange(len(texts) + 1))
        columns: dict[str, list] = {"doc_id": ids, "n_bytes": [len(t) for t in texts], "n_removed": [], "n_spans": [], "kept": []}
        for i, data in enumerate(texts):
            own = start[order[edge[i] : edge[i + 1]]]
            gone = np.zeros(len(data) + 1, np.int32)
            np.add.at(gone, own, 1)
            np.add.at(gone, own + length, -1)
            removed = np.cumsum(gone)[:-1] > 0
            columns["n_removed"].append(int(removed.sum()))
            columns["n_spans"].append(int((removed[1:] & ~removed[:-1]).sum() + removed[:1].sum()))
            columns["kept"].append(np.frombuffer(data, np.uint8)[~removed].tobytes() if len(own) else data)
        return _table(schema, **columns)

    return run, schema


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    texts = rows.select(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)).cast("int").alias("block"), "doc_id", "text")
    parts = int(blocks)
    by_block = texts.groupBy("block")
    codes = by_block.applyInArrow(*send_codes(parts))
    answers = codes.groupBy("part").applyInArrow(*answer_codes())
    runs = by_block.cogroup(answers.groupBy("block")).applyInArrow(*send_runs(parts))
    marks = runs.groupBy("part").applyInArrow(*merge_parts())
    return by_block.cogroup(marks.groupBy("block")).applyInArrow(*cut_blocks())

