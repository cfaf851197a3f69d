"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one for each half of the unit vectors, span a product grid of cells; every vector lies in one cell of its
label.  A vector visits the cells around its own by multi-sequence traversal, in order of the distance from the vector to the
cell (squared distances to the bisecting planes of both halves, added), until ``reach``.  ``reach`` is calibrated so that a
partner at the similarity threshold in a random direction lies in a visited cell with probability ``target_recall``; of two
cells only the one with the smaller number visits the other, so that a pair is met once.  Every pair met is verified by
cosine in double precision, so no pair below the threshold is linked.

The codebooks are fitted on at most ``SAMPLE`` vectors (those with the lowest hash); all vectors are indexed and queried.
Equal vectors are one representative with a count.  A cell is cut into chunks of about ``CHUNK`` representatives, and what
is compared with a chunk streams past it, so that a crowded cell is spread over tasks with bounded memory.  A chunk reports the
number of links per vector and a spanning forest of its links, never the pairs.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do vectors without label or
id.  Vectors of another length than most share one cell per label and length.  Repeated rows count as separate vectors; where
an id repeats with other vectors, the links of its vectors add up and they share a component.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import components, written

THRESHOLD = 0.98
CENTROIDS, SAMPLE, TRIALS, CHUNK = 64, 16384, 2000, 1024
TARGET_RECALL = 0.999


def usable(embedding: Column) -> Column:
    """Whether a vector can be compared."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)[None, :])


def _fit(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of one half (Lloyd); starting points are spread over the sample."""
    distinct = np.unique(x, axis=0)
    centroids = distinct[np.linspace(0, len(distinct) - 1, min(k, len(distinct))).astype(int)].copy()
    for _ in range(rounds):
        home = _squares(x, centroids).argmin(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, x)
        counts = np.bincount(home, minlength=len(centroids))
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return np.unique(centroids, axis=0)


class Grid:
    """The product grid of two codebooks."""

    def __init__(self, sample: np.ndarray, centroids: int = CENTROIDS, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL) -> None:
        unit = sample / np.linalg.norm(sample, axis=1)[:, None]
        self.half = unit.shape[1] // 2
        self.books = [_fit(unit[:, : self.half], centroids), _fit(unit[:, self.half :], centroids)]
        self.apart = [np.sqrt(_squares(b, b)) for b in self.books]
        self.reach = self._calibrate(unit[:TRIALS], threshold, target_recall)

    def bounds(self, unit: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per half: the home centroid of every vector, and its squared distance to the region of every centroid."""
        homes, lows = [], []
        for part, book, apart in zip((unit[:, : self.half], unit[:, self.half :]), self.books, self.apart, strict=True):
            squares = _squares(part, book)
            home = squares.argmin(1)
            gap = np.maximum(apart[home], 1e-12)
            low = np.maximum(0, squares - squares[np.arange(len(part)), home][:, None]) / (2 * gap)
            low[np.arange(len(part)), home] = 0
            homes.append(home)
            lows.append(low * low)
        return homes, lows

    def _calibrate(self, unit: np.ndarray, threshold: float, target: float) -> float:
        """The distance within which a partner's cell lies with probability ``target``."""
        rng = np.random.default_rng(5)
        noise = rng.normal(size=unit.shape)
        noise -= (noise * unit).sum(1)[:, None] * unit
        noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-12)[:, None]
        partner = threshold * unit + np.sqrt(1 - threshold**2) * noise
        _, lows = self.bounds(unit)
        homes, _ = self.bounds(partner)
        rows = np.arange(len(unit))
        return float(np.quantile(lows[0][rows, homes[0]] + lows[1][rows, homes[1]], target))

    def visits(self, low1: np.ndarray, low2: np.ndarray) -> list[int]:
        """Cells in the order of multi-sequence traversal, up to ``reach``."""
        width = len(self.books[1])
        first, second = np.flatnonzero(low1 <= self.reach), np.flatnonzero(low2 <= self.reach)
        first, second = first[np.argsort(low1[first], kind="stable")], second[np.argsort(low2[second], kind="stable")]
        heap, out = [(0.0, 0, 0)], []
        while heap:
            bound, i, j = heapq.heappop(heap)
            if bound > self.reach:
                break
            out.append(int(first[i]) * width + int(second[j]))
            if j + 1 < len(second):
                heapq.heappush(heap, (low1[first[i]] + low2[second[j + 1]], i, j + 1))
            if j == 0 and i + 1 < len(first):
                heapq.heappush(heap, (low1[first[i + 1]] + low2[second[0]], i + 1, 0))
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _fit_grid(reps: DataFrame, dim: int, **options) -> Grid:
    rows = reps.where(F.col("dim") == dim).orderBy(F.xxhash64("rep")).limit(SAMPLE).select("embedding").toArrow()
    return Grid(_matrix(rows.column(0).combine_chunks()), **options)


def _place(reps: DataFrame, grid: Grid, dim: int) -> DataFrame:
    """(label, dim, cell, home, rep, n, embedding): every representative at home and in the cells it visits."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                cells, source, home = [], [], []
                inside = np.flatnonzero(part.column("dim").to_numpy() == dim)
                for i in np.flatnonzero(part.column("dim").to_numpy() != dim):
                    cells.append(-1), source.append(i), home.append(True)
                if len(inside):
                    x = _matrix(part.column("embedding").take(pa.array(inside)))
                    x /= np.linalg.norm(x, axis=1)[:, None]
                    homes, lows = grid.bounds(x)
                    own = homes[0] * len(grid.books[1]) + homes[1]
                    for k, i in enumerate(inside):
                        for cell in grid.visits(lows[0][k], lows[1][k]):
                            if cell > own[k]:
                                cells.append(cell), source.append(i), home.append(False)
                        cells.append(own[k]), source.append(i), home.append(True)
                taken = part.take(pa.array(source, pa.int64()))
                columns = [taken.column("label"), taken.column("dim"), pa.array(cells, pa.int32()), pa.array(home), *(taken.column(c) for c in ("rep", "n", "embedding"))]
                yield pa.RecordBatch.from_arrays(columns, names=["label", "dim", "cell", "home", "rep", "n", "embedding"])

    kind = reps.schema["embedding"].dataType.simpleString()
    return reps.select("label", "dim", "rep", "n", "embedding").mapInArrow(rows, f"label int, dim int, cell int, home boolean, rep long, n long, embedding {kind}")


def _spread(placed: DataFrame, chunk: int) -> DataFrame:
    """Rows dealt to (label, dim, cell, chunk): targets are the chunk's own rows, the rest is compared with them.

    A row that lives in chunk c of a cell is a target there and is compared with the chunks before it; visitors are compared
    with all chunks.
    """
    cell = ["label", "dim", "cell"]
    crowd = placed.where("home").groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    rows = placed.join(crowd, cell)  # a cell without residents has nothing to compare
    own = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    last = F.when(F.col("home"), own).otherwise(F.col("chunks") - 1)
    rows = rows.withColumn("own", own).withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    target = F.col("home") & (F.col("chunk") == F.col("own"))
    return rows.select(*cell, "chunk", (~target).cast("int").alias("role"), "rep", "n", "embedding")


class _Chunk:
    """Links of one chunk: sums per vector, and the edges that join what was apart."""

    def __init__(self, threshold: float) -> None:
        self.threshold, self.targets, self.ids, self.n = threshold, [], [], []
        self.ready = None

    def add(self, ids: np.ndarray, n: np.ndarray, x: np.ndarray) -> None:
        self.ids.append(ids), self.n.append(n), self.targets.append(x / np.linalg.norm(x, axis=1)[:, None])

    def close(self) -> Iterator[tuple[np.ndarray, ...]]:
        """The links among the targets."""
        if self.ready is None:
            self.x, self.ids, self.n = np.concatenate(self.targets), np.concatenate(self.ids), np.concatenate(self.n)
            self.label = np.arange(len(self.ids))
            self.links = np.zeros(len(self.ids), np.int64)
            self.ready = True
            for low in range(0, len(self.x), 1024):
                hits = self.x[low : low + 1024] @ self.x.T >= self.threshold
                hits &= np.arange(len(self.x))[None, :] > np.arange(low, low + len(hits))[:, None]
                self.links[low : low + 1024] += hits @ self.n
                self.links += self.n[low : low + 1024] @ hits
                yield self._edges(self.ids[low : low + 1024], hits, np.arange(low, low + len(hits)))

    def meet(self, ids: np.ndarray, n: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        hits = (x / np.linalg.norm(x, axis=1)[:, None]) @ self.x.T >= self.threshold
        self.links += n @ hits
        a, b, zero = self._edges(ids, hits, None)
        links = hits @ self.n
        some = np.flatnonzero(links)
        return np.concatenate([a, ids[some]]), np.concatenate([b, ids[some]]), np.concatenate([zero, links[some]])

    def _edges(self, ids: np.ndarray, hits: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, ...]:
        a, b = [], []
        for row in np.flatnonzero(hits.any(1)):
            met = np.unique(self.label[hits[row]])
            if own is not None:
                met = met[met != self.label[own[row]]]
            a += [ids[row]] * len(met)
            b += self.ids[met].tolist()
            joined = met if own is None else np.append(met, self.label[own[row]])
            if len(joined) > 1:
                self.label[np.isin(self.label, joined)] = joined.min()
        return np.array(a, np.int64), np.array(b, np.int64), np.zeros(len(a), np.int64)

    def sums(self) -> tuple[np.ndarray, ...]:
        some = np.flatnonzero(self.links)
        return self.ids[some], self.ids[some], self.links[some]


def _compare(threshold: float):
    """Rows (a, b, links): an edge where links is 0, else the links that a has in one chunk."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, chunk = None, None

        def out(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "links"])

        def finish() -> Iterator[pa.RecordBatch]:
            if chunk is not None and chunk.targets:
                for found in chunk.close():
                    yield out(found)
                yield out(chunk.sums())

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("label", "dim", "cell", "chunk", "role")])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if low == high:
                    continue
                if current != (now := tuple(keys[:4, low])):
                    yield from finish()
                    current, chunk = now, _Chunk(threshold)
                part = batch.slice(low, high - low)
                columns = part.column("rep").to_numpy(), part.column("n").to_numpy(), _matrix(part.column("embedding"))
                if keys[4, low] == 0:
                    chunk.add(*columns)
                elif chunk.targets:
                    for found in chunk.close():
                        yield out(found)
                    yield out(chunk.meet(*columns))
        yield from finish()

    return rows


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, centroids: int = CENTROIDS, target_recall: float = TARGET_RECALL, chunk: int = CHUNK) -> DataFrame:
    """Per row of ``vectors`` (vec_id, label, embedding): vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "embedding")
    fit = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    good = rows.where(fit)
    reps = written(
        good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("dim", F.size("embedding")), "vectors"
    )
    dims = reps.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not dims:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    dim = dims[0][0]
    grid = _fit_grid(reps, dim, centroids=centroids, threshold=threshold, target_recall=target_recall)
    spread = _spread(_place(reps, grid, dim), chunk)
    key = ["label", "dim", "cell", "chunk"]
    found = spread.repartition(*key).sortWithinPartitions(*key, "role").mapInArrow(_compare(threshold), "a long, b long, links long")
    found = written(found, "vector-links")
    links = found.where("links > 0").groupBy("a").agg(F.sum("links").alias("links"))
    own = good.join(reps.select("label", "embedding", "rep", "n"), ["label", "embedding"])
    same = own.where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    named = components(found.where("links = 0").select("a", "b").unionByName(same))
    counted = own.join(links, own["rep"] == links["a"], "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    rest = rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"))
    everything = counted.unionByName(rest)
    out = everything.join(named, everything["vec_id"] == named["node"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", "n_links", component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
