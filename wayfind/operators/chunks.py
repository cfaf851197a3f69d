"""Text chunks for vector indexing.

All places where a text may be cut come from one pattern pass per kind of boundary; a chunk then ends at the last place of the
best kind that its window holds.  Where a chunk starts depends on where the previous one ended, so the places of a document are
walked inside an Arrow batch; Spark distributes the documents.  No text is left out: what is too short to be a chunk of its own
lengthens the one before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind import constants as C
from wayfind.functions.text import normalized_text

#: (length of the boundary, characters of it that stay with the chunk, pattern), best kind first.
BOUNDARIES = tuple((len(m), len(m.strip()), re.compile(re.escape(m))) for m in C.SPLIT_MARKERS)
FULL_STOP = re.compile(r"\.")
LATE = 200


class Places:
    """Where one text may be cut, per kind of boundary, in ascending order."""

    def __init__(self, text: str) -> None:
        self.kinds = [(size, keep, self._found(pattern, text)) for size, keep, pattern in BOUNDARIES]
        self.stops = self._found(FULL_STOP, text)

    @staticmethod
    def _found(pattern: re.Pattern, text: str) -> np.ndarray:
        return np.array([m.start() for m in pattern.finditer(text)], np.int64)

    def last(self, begin: int, end: int) -> int | None:
        """The cut for the window from ``begin`` to ``end``, if it has one."""
        for size, keep, places in self.kinds:
            i = int(places.searchsorted(end - size, "right")) - 1
            if i >= 0 and places[i] > begin:
                return int(places[i]) + keep
        i = int(self.stops.searchsorted(end, "left")) - 1
        return int(self.stops[i]) + 1 if i >= 0 and self.stops[i] >= begin + LATE else None


def chunk_spans(text: str, max_chars: int, overlap: int, min_chars: int) -> list[tuple[int, int]]:
    """Begin and end of the chunks of one normalised text."""
    spans: list[tuple[int, int]] = []
    places = Places(text) if len(text) > max_chars else None
    at, end = 0, 0
    while text and end < len(text):
        end = min(len(text), at + max_chars)
        cut = places.last(at, end) if places and end < len(text) else None
        if cut is not None and cut - at >= min_chars:
            end = cut
        if spans and len(text[at:end].strip()) < min_chars:
            spans[-1] = (spans[-1][0], end)
        else:
            spans.append((at, end))
        at = max(end - overlap, at + 1)
    return spans


def chunk_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", max_chars: int = C.CHUNK_MAX_CHARS,
    overlap: int = C.CHUNK_OVERLAP_CHARS, min_chars: int = C.CHUNK_MIN_CHARS,
) -> DataFrame:
    """(key, chunk_id, order, text): document columns are not copied, join them on the key."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("t").to_pylist()
            found = [chunk_spans(t, max_chars, overlap, min_chars) for t in texts]
            owner = np.repeat(np.arange(len(texts)), [len(s) for s in found])
            order = np.concatenate([np.arange(len(s)) for s in found]) if found else owner
            bodies = [t[b:e].strip() for t, s in zip(texts, found, strict=True) for b, e in s]
            columns = [batch.column("k").take(pa.array(owner, pa.int64())), pa.array(order, pa.int32()), pa.array(bodies, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "order", "text"])

    key_type = dict(docs.dtypes)[key]
    ready = docs.select(F.col(key).alias("k"), normalized_text(F.col(text)).alias("t")).where(F.col("t") != "")
    chunks = ready.mapInArrow(spans, f"k {key_type}, order int, text string")
    chunk_id = F.concat(F.col("k").cast("string"), F.lit("::chunk::"), F.col("order").cast("string"))
    return chunks.select(F.col("k").alias(key), chunk_id.alias("chunk_id"), "order", "text")
