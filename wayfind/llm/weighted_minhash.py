"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

Shingles are runs of five words; a text of fewer words is one shingle, a text without words has none and is never linked.  A
shingle weighs its count in the text times its inverse document frequency ``ln(documents / df) / ln(10)``, held between
``LEAST_IDF`` and 1, so that shingles in up to a tenth of all texts count fully and boilerplate counts less.  The document
frequency is kept per hash bucket of shingles (``BUCKETS`` counters over all distinct texts, a table of fixed size).  Weights
lie on a logarithmic grid; the similarity of two texts is the weighted Jaccard similarity of these weights.

A sketch holds ``BANDS * ROWS`` consistent weighted samples.  Each sample needs three random variates per shingle; they come
from tables addressed by a hash of the shingle, ties between shingles go to the smaller hash.  Texts that agree in a whole
band meet in a bucket.  Buckets compare sketches and report a spanning forest of the pairs whose estimate is at least
``ESTIMATE`` (over four standard errors below the threshold); within the components of that, pairs are verified exactly on the
shingles of the whole texts, best estimates first, skipping pairs that verified links have joined already.

Equal word sequences are one text with copies.  Buckets and components are cut into chunks of ``CHUNK`` texts; whatever is
compared with a chunk streams past it.  So neither pairs nor a whole group are ever gathered.

Null text counts as empty.  Documents without id are never linked.  Rows that repeat an id belong to one class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfind.llm.common import components, free_name, written
from wayfind.llm.texts import MIX, octets, scramble, slices, window_codes, window_owner, word_codes

WIDTH, THRESHOLD, ESTIMATE = 5, 0.8, 0.6
BANDS, ROWS = 14, 4
SAMPLES = BANDS * ROWS
BUCKETS, LEAST_IDF, FULL_SHARE = 1 << 16, 0.8, 0.1
GRID = 16  # weight steps per doubling
TABLE_BITS = 13
CHUNK = 1024
_U = np.uint64


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) sorted by text and shingle, and two columns that identify the word sequences."""
    codes, counts = word_codes(texts)
    owner, inside = window_owner(counts, WIDTH)
    owners, keys = owner[inside], window_codes(codes, WIDTH)[inside]
    edge = np.concatenate([[0], np.cumsum(counts)])
    place = np.arange(len(codes)) - np.repeat(edge[:-1], counts)
    prints = np.zeros((len(texts), 2), _U)
    some = np.flatnonzero(counts)
    if len(some):
        for k in (0, 1):
            mixed = scramble(codes * MIX[k] + scramble(place.astype(_U) + MIX[k + 2]))
            prints[some, k] = np.add.reduceat(mixed, edge[some])
    short = np.flatnonzero((counts > 0) & (counts < WIDTH))
    owners, keys = np.concatenate([owners, short]), np.concatenate([keys, scramble(prints[short, 0])])
    order = np.lexsort((keys, owners))
    owners, keys = owners[order], keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    at = np.flatnonzero(first)
    times = np.diff(np.append(at, len(keys)))
    return owners[at], keys[at], times, np.column_stack([prints[:, 0], prints[:, 1], counts.astype(_U)])


def bucket_of(keys: np.ndarray) -> np.ndarray:
    return (scramble(keys ^ MIX[4]) >> _U(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


class Sampler:
    """Weights and sketches; ``levels`` holds the grid step of the inverse document frequency of every bucket."""

    def __init__(self, levels: np.ndarray) -> None:
        rng = np.random.default_rng(91)
        size = 1 << TABLE_BITS
        self.levels = levels.astype(np.int64)
        self.r = rng.gamma(2, 1, (SAMPLES, size))
        self.c = np.log(rng.gamma(2, 1, (SAMPLES, size)))
        self.beta = rng.random((SAMPLES, size))
        self.odd = rng.integers(0, 1 << 62, SAMPLES).astype(_U) * _U(2) + _U(1)
        self.lowest, self.ready = int(levels.min()), int(levels.max()) - int(levels.min()) + 1
        steps = np.arange(self.lowest, self.lowest + self.ready) * (math.log(2) / GRID)
        self.tables = np.stack([self._log_a(k, np.arange(size)[None, :], steps[:, None])[0].astype(np.float32).ravel() for k in range(SAMPLES)])

    def _log_a(self, k: int, at: np.ndarray, log_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r, beta = self.r[k][at], self.beta[k][at]
        t = np.floor(log_w / r + beta)
        return self.c[k][at] - r * (t - beta) - r, t

    def steps(self, keys: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Grid step of the weight of every shingle."""
        return self.levels[bucket_of(keys)] + np.rint(np.log2(times) * GRID).astype(np.int64)

    def sketch(self, owners: np.ndarray, keys: np.ndarray, steps: np.ndarray, texts: int) -> np.ndarray:
        """uint32[texts, SAMPLES]; rows of texts without shingles are zero."""
        out = np.zeros((texts, SAMPLES), np.uint32)
        if not len(keys):
            return out
        starts = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
        sizes = np.diff(np.append(starts, len(owners)))
        usual = steps - self.lowest < self.ready
        base = (np.where(usual, steps - self.lowest, 0) << TABLE_BITS).astype(np.int64)
        rare = np.flatnonzero(~usual)
        for k in range(SAMPLES):
            at = ((keys * self.odd[k]) >> _U(64 - TABLE_BITS)).astype(np.int64)
            a = self.tables[k][base + at]
            if len(rare):
                a[rare] = self._log_a(k, at[rare], steps[rare] * (math.log(2) / GRID))[0]
            least = np.repeat(np.minimum.reduceat(a, starts), sizes)
            hit = np.flatnonzero(a == least)
            if len(hit) > len(starts):
                hit = hit[np.lexsort((keys[hit], owners[hit]))]
                hit = hit[np.concatenate([[True], owners[hit][1:] != owners[hit][:-1]])]
            _, t = self._log_a(k, at[hit], steps[hit] * (math.log(2) / GRID))
            mark = scramble(keys[hit] + scramble(t.astype(np.int64).astype(_U) + MIX[k % 5]))
            out[owners[hit], k] = (mark >> _U(32)).astype(np.uint32)
        return out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two (sorted shingles, weights)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    both = np.minimum(a[1][same], b[1][at[same]]).sum()
    either = a[1].sum() + b[1].sum() - both
    return float(both / either) if either > 0 else 0.0


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples for all rows of a against all rows of b."""
    equal = np.zeros((len(a), len(b)), np.uint8)
    for k in range(a.shape[1]):
        equal += a[:, k, None] == b[None, :, k]
    return equal / np.float32(a.shape[1])


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for part in slices(batch, "text", rows):
            yield part, octets(part.column("text"))


def _prints(docs: DataFrame) -> DataFrame:
    """(doc_id, p, q, n_words): what identifies the word sequence of every document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _parts(batches):
            prints = shingles(texts)[3].view(np.int64)
            columns = [part.column("doc_id"), *(pa.array(np.ascontiguousarray(prints[:, k]), pa.int64()) for k in range(3))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "p", "q", "n_words"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, p long, q long, n_words long")


def frequency_levels(docs: DataFrame) -> np.ndarray:
    """Grid step of the inverse document frequency per bucket, from all documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(BUCKETS, np.int64), 0
        for _, texts in _parts(batches):
            owners, keys, _, _ = shingles(texts)
            total += len(np.unique(owners))
            seen += np.bincount(np.unique(owners * BUCKETS + bucket_of(keys)) % BUCKETS, minlength=BUCKETS)
        some = np.flatnonzero(seen)
        columns = [pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(seen[some], total), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "n"])

    counts = docs.select("text").mapInArrow(rows, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # at most BUCKETS + 1 rows
    bucket, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    df = np.zeros(BUCKETS)
    df[bucket[bucket >= 0]] = n[bucket >= 0]
    total = max(1, int(n[bucket < 0].sum()))
    idf = np.clip(np.log(total / np.maximum(df, 1)) / math.log(1 / FULL_SHARE), LEAST_IDF, 1)
    return np.rint(np.log2(idf) * GRID).astype(np.int64)


def sketches(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """(doc_id, p, q, n_words, sketch) of every document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sampler(levels)
        for part, texts in _parts(batches):
            owners, keys, times, prints = shingles(texts)
            drawn = own.sketch(owners, keys, own.steps(keys, times), len(texts))
            prints = prints.view(np.int64)
            columns = [
                part.column("doc_id"), *(pa.array(np.ascontiguousarray(prints[:, k]), pa.int64()) for k in range(3)),
                pa.array([x.tobytes() for x in drawn], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "p", "q", "n_words", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, p long, q long, n_words long, sketch binary")


def _bands(reps: DataFrame) -> DataFrame:
    """(key, rep) for every band of every representative."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS)
            keys = np.zeros(drawn.shape[:2], _U) + np.arange(BANDS).astype(_U)
            for r in range(ROWS):
                keys = scramble(keys * MIX[1] + drawn[:, :, r])
            columns = [pa.array(keys.view(np.int64).ravel(), pa.int64()), pa.array(np.repeat(batch.column("rep").to_numpy(), BANDS), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "rep"])

    return reps.select("rep", "sketch").mapInArrow(rows, "key long, rep long")


def _spread(rows: DataFrame, group: str, chunk: int) -> DataFrame:
    """Deals the rows of every group of two or more to (group, chunk); a row is a target (role 0) in its own chunk and is
    compared (role 1) with the chunks before it."""
    crowd = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    dealt = rows.join(crowd, group).withColumn("_own", F.pmod(F.xxhash64("rep"), F.ceil(F.col("_n") / chunk)).cast("int"))
    dealt = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_own"))))
    return dealt.withColumn("role", (F.col("chunk") != F.col("_own")).cast("int")).drop("_n", "_own")


class _Group:
    """Texts of one chunk; ``meet`` gives the links of new texts that join what was apart.

    ``labels`` are the local components; targets compare among themselves as they come.
    """

    def __init__(self, verify: bool) -> None:
        self.verify, self.ids, self.labels = verify, [], np.zeros(0, np.int64)
        self.sketches: list[np.ndarray] = []
        self.vectors: list[tuple[np.ndarray, np.ndarray]] = []

    def meet(self, rep: int, sketch: np.ndarray, vector: tuple[np.ndarray, np.ndarray] | None, estimates: np.ndarray, target: bool) -> list[int]:
        own, joined = -1, []
        for at in np.argsort(-estimates, kind="stable"):
            if estimates[at] < ESTIMATE:
                break
            if self.labels[at] == own or self.ids[at] == rep:
                continue
            if self.verify and weighted_jaccard(vector, self.vectors[at]) < THRESHOLD:
                continue
            joined.append(self.ids[at])
            old, new = self.labels[at], own if own >= 0 else self.labels[at]
            self.labels[self.labels == old] = new
            own = new
        if target:
            self.labels = np.append(self.labels, own if own >= 0 else len(self.labels))
            self.ids.append(rep)
            self.sketches.append(sketch)
            if self.verify:
                self.vectors.append(vector)
        return joined


def _compare(group: str, verify: bool):
    """Edges (a, b) of the rows of (group, chunk), sorted by role."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (group, "chunk")])
            role, reps = batch.column("role").to_numpy(), batch.column("rep").to_numpy()
            drawn = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(batch.num_rows, SAMPLES)
            a: list[int] = []
            b: list[int] = []
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for low, high in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if low == high:
                    continue
                if (now := tuple(keys[:, low])) != current:
                    current, held = now, _Group(verify)
                for start in range(low, high, 256):
                    stop = min(high, start + 256)
                    block = drawn[start:stop]
                    known = np.stack(held.sketches) if held.sketches else np.zeros((0, SAMPLES), np.uint32)
                    targets = role[start:stop] == 0
                    estimates = _agreement(block, np.concatenate([known, block[targets]]))
                    for i in range(start, stop):
                        vector = None
                        if verify:
                            vector = tuple(np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in (("keys", _U), ("weights", np.float64)))
                        met = held.meet(int(reps[i]), drawn[i], vector, estimates[i - start, : len(held.ids)], bool(targets[i - start]))
                        a += [int(reps[i])] * len(met)
                        b += met
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows


def _edges(spread: DataFrame, group: str, verify: bool) -> DataFrame:
    return spread.repartition(group, "chunk").sortWithinPartitions(group, "chunk", "role").mapInArrow(_compare(group, verify), "a long, b long")


def _vectors(texts: DataFrame, levels: np.ndarray) -> DataFrame:
    """(component, rep, sketch, keys, weights): shingles and weights of whole texts."""
    grid = 2.0 ** (1 / GRID)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sampler(levels)
        for part, some in _parts(batches, 64):
            owners, keys, times, _ = shingles(some)
            weights = grid ** own.steps(keys, times).astype(np.float64)
            edge = np.searchsorted(owners, np.arange(len(some) + 1))
            cut = list(zip(edge[:-1], edge[1:], strict=True))
            columns = [
                *(part.column(c) for c in ("component", "rep", "sketch")),
                pa.array([keys[i:j].tobytes() for i, j in cut], pa.binary()), pa.array([weights[i:j].tobytes() for i, j in cut], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["component", "rep", "sketch", "keys", "weights"])

    return texts.mapInArrow(rows, "component long, rep long, sketch binary, keys binary, weights binary")


def near_duplicates(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per document: doc_id, class_id (smallest id of its class), kept (whether it is that one)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    levels = frequency_levels(docs)
    drawn = written(sketches(docs, levels), "minhash-sketches")
    reps = drawn.where("doc_id is not null and n_words > 0").groupBy("p", "q", "n_words").agg(F.min("doc_id").alias("rep"), F.min("sketch").alias("sketch"))
    reps = written(reps, "minhash-texts")
    bands = written(_bands(reps), "minhash-bands")
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    met = bands.join(shared, "key").join(reps.select("rep", "sketch"), "rep")
    likely = components(_edges(_spread(met, "key", chunk), "key", verify=False))
    likely = written(likely.withColumnRenamed("node", "rep"), "minhash-likely")
    texts = docs.join(likely.withColumnRenamed("rep", "doc_id"), "doc_id").withColumnRenamed("doc_id", "rep")
    texts = texts.join(reps.select("rep", "sketch"), "rep")
    links = written(_edges(_spread(_vectors(texts, levels), "component", chunk), "component", verify=True), "minhash-links")
    copies = drawn.where("doc_id is not null and n_words > 0").join(reps.select("p", "q", "n_words", "rep"), ["p", "q", "n_words"])
    copies = copies.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    named = components(links.select("a", "b").unionByName(copies))
    out = drawn.select("doc_id").join(named, drawn["doc_id"] == named["node"], "left")
    class_id = F.coalesce("component", "doc_id")
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce(class_id == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of every class, with its columns; documents without id stay."""
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    rows = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    turn = free_name(rows, "_turn")
    order = F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if not t.startswith(("map", "variant"))])
    numbered = rows.withColumn(turn, F.row_number().over(Window.partitionBy("doc_id").orderBy(order)))
    return numbered.where((F.col(turn) == 1) | F.col("doc_id").isNull()).drop(turn)
