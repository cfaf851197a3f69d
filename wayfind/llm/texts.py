"""Words and shingles of Arrow text batches as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

ONE = np.uint64(1)
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def slices(batch: pa.RecordBatch, column: str, rows: int = 512, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of the batch of at most ``rows`` rows and about ``size`` bytes of text, so that memory stays even."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    filled = np.cumsum(lengths)
    low = 0
    while low < batch.num_rows:
        before = filled[low] - lengths[low]
        high = min(low + rows, int(np.searchsorted(filled, before + size, "right")))
        high = max(high, low + 1)
        yield batch.slice(low, high - low)
        low = high


def octets(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of every text; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words one after another, words of each text); words are separated by ASCII white space."""
    codes: list[np.ndarray] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        words = text.split()
        counts[i] = len(words)
        codes.append(np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)))
    return (np.concatenate(codes) if codes else np.zeros(0, np.uint64)), counts


def window_codes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; the last ``width - 1`` places are missing."""
    n = max(0, len(codes) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = out * MIX[1] + scramble(codes[k : k + n] + MIX[k % len(MIX)])
    return scramble(out)


def window_owner(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For every place of ``window_codes``: the text it starts in, and whether it stays inside that text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    n = max(0, len(owner) - width + 1)
    return owner[:n], owner[:n] == owner[width - 1 :][:n]
