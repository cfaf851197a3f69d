"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of a block of texts are one byte array with the places where they start.  Every sequence finds its pair of
lowest rank (a minimum per segment), all sequences merge theirs at once, at all its places from the left, and finished
sequences leave the arrays; what is left of a sequence are its tokens.  That is the order of the byte-pair model: every merge
makes a new symbol, so no later pair can have a lower rank than the one that made a part of it.  Ranks are looked up again
only beside a merge.  Equal pre-tokens of a block go through once; they are grouped by a 64-bit hash and compared byte by
byte.  A sequence is also cut between two bytes that are neighbours in no token, because no merge crosses such a place.

Pre-tokens are found on arrays too: character classes of all bytes, runs of one class, the last white space of a run goes to
what follows, English contractions stand alone.  Classes of characters beyond ASCII are asked from the library itself.

There is no shuffle: a task reads texts, block by block of about ``BLOCK`` bytes, whatever the length of a text; a longer text
is cut before single spaces between visible ASCII characters, where a pre-token starts in any case.  Only a text without such
places is held whole.

Null text is empty and has no tokens.  Added tokens (such as an end-of-text mark) found in a text count as one, as in a plain
call of the library.  Ids may be null or repeat: every row has its own result.  Further columns are not returned.  An empty
table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.texts import scramble, slices

BLOCK = 2 << 20
NONE = np.int32(2**31 - 1)
LETTER, NUMBER, SPACE, OTHER, UNKNOWN = 0, 1, 2, 3, 255
#: Fixed values of the byte-level pre-tokenizer: what may follow an apostrophe in one pre-token.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_SPLIT = re.compile(rb"[!-~](?= [!-~])")


def byte_symbols() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: visible Latin-1 ones for themselves, then 256 and up."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ArrayMerger:
    """Counts tokens of byte-level BPE models given as a tokenizers file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        spec = json.loads(tokenizer.to_str())
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec["normalizer"]
        bent = model["dropout"] or model.get("ignore_merges") or model["continuing_subword_prefix"] or model["end_of_word_suffix"]
        if model["type"] != "BPE" or not plain or bent or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("only plain byte-level BPE models are merged by arrays")
        self.pre = tokenizer.pre_tokenizer
        added = sorted((t["content"].encode() for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        self.splittable = not any(b" " in t for t in added)
        vocab, octet = model["vocab"], byte_symbols()
        self.first = np.zeros(256, np.int32)
        for symbol, b in octet.items():
            self.first[b] = vocab[symbol]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]
        self.byte_ranks = self._ranks(np.repeat(self.first, 256), np.tile(self.first, 256)).reshape(256, 256)
        self.inside = np.zeros((256, 256), bool)
        for token in vocab:
            raw = [octet[c] for c in token]
            self.inside[raw[:-1], raw[1:]] = True
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self._ask(np.arange(128))
        self.ascii = self.classes[:256].copy()
        self.weights = np.zeros(0, np.uint64)

    def _ask(self, points: np.ndarray) -> None:
        """Classes of characters: the one that joins a letter, a digit or a mark into one pre-token."""
        for point in points.tolist():
            joins = [len(self.pre.pre_tokenize_str(x + chr(point))) == 1 for x in ("a", "1", "!")]
            self.classes[point] = joins.index(True) if joins[0] or joins[1] else OTHER if joins[2] else SPACE

    def _class_of_bytes(self, data: np.ndarray) -> np.ndarray:
        """The class of the character that each byte belongs to."""
        kinds = self.ascii[data]
        wide = np.flatnonzero(data >= 0xC0)
        lead = data[wide]
        for width, low, high, mask in ((2, 0xC0, 0xE0, 0x1F), (3, 0xE0, 0xF0, 0x0F), (4, 0xF0, 0x100, 0x07)):
            at = wide[(lead >= low) & (lead < high)]
            point = data[at].astype(np.int64) & mask
            for k in range(1, width):
                point = point << 6 | (data[at + k] & 0x3F)
            found = self.classes[point]
            if (found == UNKNOWN).any():
                self._ask(np.unique(point[found == UNKNOWN]))
                found = self.classes[point]
            for k in range(width):
                kinds[at + k] = found
        return kinds

    def _starts(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where pre-tokens start; ``edges`` are the starts of the texts, which nothing crosses."""
        n = len(data)
        kinds = self._class_of_bytes(data)
        edge = np.zeros(n + 3, bool)
        edge[edges] = True
        edge[n:] = True
        cut = np.empty(n, bool)
        cut[0] = True
        np.not_equal(kinds[1:], kinds[:-1], out=cut[1:])
        cut |= edge[:n]
        run = np.flatnonzero(cut)
        end = np.append(run[1:], n)
        kind = kinds[run]
        # white space before something else: its last character starts anew and, if it is a blank, takes in what follows
        spaces = (kind == SPACE) & ~edge[end]
        last = end[spaces] - 1
        for _ in range(2):
            last = last - ((data[last] & 0xC0) == 0x80)
        cut[last] = True
        cut[end[spaces][data[last] == 0x20]] = False
        # an apostrophe that starts a pre-token takes one of a few endings
        single = run[(kind == OTHER) & (data[run] == 0x27) & (end - run == 1)]
        single = single[cut[single] & ~edge[single + 1]]
        padded = np.append(data, np.zeros(3, np.uint8))
        for ending in CONTRACTIONS:
            fits = np.ones(len(single), bool)
            for k, letter in enumerate(ending.encode(), 1):
                fits &= (padded[single + k] == letter) & ~edge[single + k]
            at = single[fits]
            cut[at + 1] = False
            after = at + 1 + len(ending)
            cut[after[after < n]] = True
        return np.flatnonzero(cut)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NONE)

    def merge(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Symbols that survive in each of the byte sequences that start at ``starts`` (none is empty)."""
        symbols = self.first[data]
        counts = np.zeros(len(starts), np.int64)
        owner = np.arange(len(starts))
        sizes = np.diff(np.append(starts, len(symbols)))
        rank = np.append(self.byte_ranks[data[:-1], data[1:]], NONE)
        rank[starts + sizes - 1] = NONE
        while len(owner):
            lowest = np.minimum.reduceat(rank, starts)
            live = lowest < NONE
            if not live.all():
                counts[owner[~live]] = sizes[~live]
                kept = np.repeat(live, sizes)
                symbols, rank, owner, sizes, lowest = symbols[kept], rank[kept], owner[live], sizes[live], lowest[live]
                starts = np.cumsum(sizes) - sizes
                if not len(owner):
                    break
            at = np.flatnonzero(rank == np.repeat(lowest, sizes))
            # places that overlap (a symbol three times) merge every other, from the left
            place = np.arange(len(at))
            head = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, place, 0))
            at = at[(place - head) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            sizes = sizes - np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=len(sizes))
            kept = np.ones(len(symbols), bool)
            kept[at + 1] = False
            symbols, rank = symbols[kept], rank[kept]
            starts = np.cumsum(sizes) - sizes
            at = at - np.arange(len(at))
            beside = np.concatenate([at, at[at > 0] - 1])
            beside = beside[beside < len(symbols) - 1]
            rank[beside] = self._ranks(symbols[beside], symbols[beside + 1])
            rank[starts + sizes - 1] = NONE
        return counts

    def _count_distinct(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token of a list without repeats."""
        total = np.cumsum(sizes) - sizes
        flat = data[np.repeat(starts - total, sizes) + np.arange(int(sizes.sum()))]
        begins = np.zeros(len(flat), bool)
        begins[total] = True
        cut = begins.copy()
        cut[1:] |= ~self.inside[flat[:-1], flat[1:]]
        parts = np.flatnonzero(cut)
        counts = self.merge(flat, parts)
        return np.add.reduceat(counts, np.searchsorted(parts, total))

    def split(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pre-tokens of the texts that start at ``edges`` in ``data`` (not empty): where each starts, its size, the places of a list
        without repeats among them, which of that list each one is, and the places of added tokens."""
        inner = edges[edges < len(data)]
        marks = np.zeros((0, 2), np.int64)
        if self.added and self.added.search(data):
            bounds = np.append(np.unique(inner), len(data)).tolist()
            raw = data.tobytes()
            marks = np.array([m.span() for a, b in zip(bounds, bounds[1:], strict=False) for m in self.added.finditer(raw, a, b)], np.int64).reshape(-1, 2)
            inner = np.concatenate([inner, marks[:, 0], marks[marks[:, 1] < len(data), 1]])
        starts = self._starts(data, inner)
        # a mark is one token, whatever its characters are
        if len(marks):
            low, high = np.searchsorted(starts, marks[:, 0]), np.searchsorted(starts, marks[:, 1])
            drop = np.zeros(len(starts) + 1, np.int64)
            np.add.at(drop, low + 1, 1)
            np.add.at(drop, high, -1)
            starts = starts[np.cumsum(drop)[:-1] == 0]
        sizes = np.diff(np.append(starts, len(data)))
        if int(sizes.max()) > len(self.weights):
            self.weights = scramble(np.arange(1, 2 * int(sizes.max()) + 1, dtype=np.uint64)) | np.uint64(1)
        place = np.arange(len(data)) - np.repeat(starts, sizes)
        code = np.add.reduceat((data + np.uint64(1)) * self.weights[place], starts)
        _, first, group = np.unique(code, return_index=True, return_inverse=True)
        # a hash that two pre-tokens share does no harm: those that differ from the first one stand for themselves
        like = np.minimum(np.repeat(starts[first[group]], sizes) + place, len(data) - 1)
        same = np.logical_and.reduceat(data == data[like], starts) & (sizes == sizes[first[group]])
        other = np.flatnonzero(~same)
        group[other] = len(first) + np.arange(len(other))
        return starts, sizes, np.concatenate([first, other]), group, np.searchsorted(starts, marks[:, 0])

    def count(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Tokens of the texts that start at ``edges`` in ``data`` (UTF-8 bytes; texts may be empty)."""
        if not len(data):
            return np.zeros(len(edges), np.int64)
        starts, sizes, chosen, group, marks = self.split(data, edges)
        tokens = self._count_distinct(data, starts[chosen], sizes[chosen])[group]
        tokens[marks] = 1
        total = np.concatenate([[0], np.cumsum(tokens)])
        place = np.searchsorted(starts, np.append(edges, len(data)))
        return np.diff(total[place])


_MERGERS: dict[str, ArrayMerger] = {}


def merger(path: str) -> ArrayMerger:
    """One per Python worker."""
    if path not in _MERGERS:
        _MERGERS[path] = ArrayMerger(path)
    return _MERGERS[path]


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, where each starts and the last ends) without copies; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _count_column(own: ArrayMerger, column: pa.Array, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, tokens) of every text."""
    data, offsets = flat_bytes(column)
    sizes = np.diff(offsets)
    if len(data) <= 2 * block or not own.splittable:
        return sizes, own.count(data, offsets[:-1])
    tokens = np.zeros(len(sizes), np.int64)
    for i in range(len(sizes)):
        low = int(offsets[i])
        while low < offsets[i + 1]:
            found = _SPLIT.search(data, min(low + block, int(offsets[i + 1])), int(offsets[i + 1]))
            high = found.end() if found else int(offsets[i + 1])
            tokens[i] += own.count(data[low:high], np.zeros(1, np.int64))[0]
            low = high
    return sizes, tokens


def count_tokens(docs: DataFrame, tokenizer: str, limit: int, id_column: str = "doc_id", text_column: str = "text", block: int = BLOCK) -> DataFrame:
    """Per row: the id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(tokenizer)
        for batch in batches:
            for some in slices(batch, "_text", 4096, block):
                sizes, tokens = _count_column(own, some.column(1), block)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], names=names)

    narrow = docs.select(F.col(f"`{id_column}`"), F.col(f"`{text_column}`").alias("_text"))
    names = [id_column, "n_bytes", "n_tokens", "over_limit"]
    kind = narrow.schema[0].dataType.simpleString()
    return narrow.mapInArrow(rows, f"`{id_column}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
