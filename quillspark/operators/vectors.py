"""Exact cosine search: blocks of queries are broadcast, chunk vectors are read where they lie, and cells of near vectors
are skipped where none of them can reach a query's threshold or k-th best.

A query block holds QUERY_ROWS vectors at most, so what is broadcast is bounded; chunks don't move. Each task keeps the k
best of each query of the block, and only these leave it. Similarities are in double precision; null vectors take no
part, a zero vector has similarity 0 with all."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.corpus import written

#: Queries of a block, vectors multiplied at once, vectors of a saved cell block.
QUERY_ROWS, BATCH_ROWS, CELL_ROWS = 2048, 4096, 512
#: Cells, and the vectors that they are fitted on at most.
CELLS, SAMPLE = 64, 16_384
#: By what a bound is enlarged against the last bits of a product.
SLACK = 1e-9

SCORES = "query_id long, chunk_id long, vector_score double"


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def matrix(lists: pa.Array) -> np.ndarray:
    """A list column, without nulls and of one length, as rows."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(lists), -1)


class Best:
    """The k best of each query so far (all, without k) among those above the threshold."""

    def __init__(self, queries: np.ndarray, k: int | None, threshold: float | None, digits: int | None) -> None:
        self.queries, self.k, self.digits = queries, k, digits
        self.threshold = -np.inf if threshold is None else threshold
        self.floor = np.full(len(queries), -np.inf)
        self.scores = [np.zeros(0)] * len(queries)
        self.ids = [np.zeros(0, np.int64)] * len(queries)

    def rounded(self, s: np.ndarray) -> np.ndarray:
        return s if self.digits is None else np.round(s, self.digits) + 0.0

    def reach(self, bound: np.ndarray) -> np.ndarray:
        """Queries, of those that some vector may be as near to as ``bound``, that it matters to."""
        b = self.rounded(bound + SLACK)
        return np.flatnonzero((b > self.threshold) & (b >= self.floor))

    def add(self, some: np.ndarray, s: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Takes in similarities of some queries (rows) and chunks. Without k they are given back at once."""
        s = self.rounded(s)
        keep = (s > self.threshold) & (s >= self.floor[some, None])
        if self.k is None:
            i, j = np.nonzero(keep)
            return some[i], ids[j], s[i, j]
        if s.shape[1] > self.k:  # of many only those that reach the k-th are sorted
            masked = np.where(keep, s, -np.inf)
            keep &= masked >= np.partition(masked, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k, None]
        for r in np.flatnonzero(keep.any(axis=1)).tolist():
            q, at = some[r], keep[r]
            scores, own = np.append(self.scores[q], s[r, at]), np.append(self.ids[q], ids[at])
            first = np.lexsort((own, -scores))[: self.k]
            self.scores[q], self.ids[q] = scores[first], own[first]
            if len(first) == self.k:
                self.floor[q] = self.scores[q][-1]
        return None

    def batch(self, found: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> pa.RecordBatch:
        if found is None:
            n = [len(x) for x in self.ids]
            found = np.repeat(np.arange(len(n)), n), np.concatenate([*self.ids, np.zeros(0, np.int64)]), np.concatenate([*self.scores, np.zeros(0)])
        q, ids, s = found
        return pa.RecordBatch.from_arrays([pa.array(self.queries[q]), pa.array(ids), pa.array(s)], names=["query_id", "chunk_id", "vector_score"])


def _each_block(queries: DataFrame, run: Callable) -> DataFrame:
    """``run`` on each block of queries (ids and unit vectors, broadcast), together."""
    spark = queries.sparkSession
    q = queries.where(F.col("vec").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col("vec").cast("array<double>").alias("vec"))
    n, out = max(1, -(-q.count() // QUERY_ROWS)), None
    for i in range(n):
        rows = q.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).collect()
        if rows:
            block = spark.sparkContext.broadcast((np.array([r["query_id"] for r in rows], np.int64), unit(np.array([r["vec"] for r in rows], float))))
            some = run(block)
            out = some if out is None else out.unionByName(some)
    return spark.createDataFrame([], SCORES) if out is None else out


def vector_scores(queries: DataFrame, chunks: DataFrame, threshold: float | None = None, k: int | None = None, digits: int | None = None) -> DataFrame:
    """Cosine similarity, in double precision, of each query's vector with every chunk's, above a threshold.

    ``queries``: query_id, vec; ``chunks``: chunk_id, vec. Rounding (``digits``), the threshold and, with ``k``, the cut to
    the k best of a query and task (ties to the smaller chunk) are done where the chunks are read."""
    c = chunks.where(F.col("vec").isNotNull()).select(F.col("chunk_id").cast("long").alias("chunk_id"), "vec")

    def over(block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, u = block.value
            best = Best(ids, k, threshold, digits)
            for b in batches:
                for i in range(0, b.num_rows, BATCH_ROWS):
                    part = b.slice(i, BATCH_ROWS)
                    found = best.add(np.arange(len(ids)), u @ unit(matrix(part.column(1))).T, part.column(0).to_numpy())
                    if found is not None:
                        yield best.batch(found)
            if k is not None:
                yield best.batch()

        return c.mapInArrow(run, SCORES)

    return _each_block(queries, over)


def centres(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Directions that vectors of a sample lie around."""
    x = unit(sample)
    x = x[np.linalg.norm(x, axis=1) > 0]
    if not len(x):
        return np.zeros((0, sample.shape[1] if sample.ndim == 2 else 0))
    c = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, unit(sums), c)
    return c


def build_cells(chunks: DataFrame, cells: int = CELLS, sample: int = SAMPLE) -> DataFrame:
    """A saved table of blocks of near vectors: the direction they lie around, the least cosine any has with it, their
    ids and vectors as they are. Directions come from a sample of ``sample`` vectors at most; every vector is in a block.
    Tasks make blocks of what they read, so nothing is shuffled and no cell is too large."""
    c = chunks.where(F.col("vec").isNotNull()).select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("vec").cast("array<float>").alias("vec"))
    every = max(1, -(-c.count() // sample))
    some = c.where(F.pmod(F.xxhash64("chunk_id"), F.lit(every)) == 0).limit(sample).select("vec").collect()
    around = chunks.sparkSession.sparkContext.broadcast(centres(np.array([r["vec"] for r in some], float), cells) if some else np.zeros((0, 0)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size: dict[int, int] = {}

        def out(cell: int) -> pa.RecordBatch:
            ids, x = (np.concatenate(p) for p in zip(*held.pop(cell), strict=True))
            size.pop(cell)
            direction = around.value[cell] if cell >= 0 else np.zeros(x.shape[1])
            near = float((unit(x.astype(float)) @ direction).min()) if cell >= 0 else 0.0
            return pa.RecordBatch.from_arrays([pa.array([direction.tolist()]), pa.array([near]), pa.array([ids]), pa.array([x.astype(np.float32).ravel()])], names=["direction", "near", "ids", "vectors"])

        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1))
            u, ids = unit(x), b.column(0).to_numpy()
            own = (u @ around.value.T).argmax(axis=1) if len(around.value) else np.full(len(x), -1)
            own[~u.any(axis=1)] = -1
            for cell in np.unique(own).tolist():
                at = np.flatnonzero(own == cell)
                for i in range(0, len(at), CELL_ROWS):
                    part = at[i : i + CELL_ROWS]
                    held.setdefault(cell, []).append((ids[part], x[part]))
                    size[cell] = size.get(cell, 0) + len(part)
                    if size[cell] >= CELL_ROWS:
                        yield out(cell)
        for cell in list(held):
            yield out(cell)

    return written(c.mapInArrow(build, "direction array<double>, near double, ids array<long>, vectors array<float>"))


def search_cells(queries: DataFrame, cells: DataFrame, threshold: float | None = None, k: int | None = None, digits: int | None = None, counter=None) -> DataFrame:
    """``vector_scores`` over saved cells. A vector whose cosine with its cell's direction is ``near`` or more can be no
    nearer to a query than the angle between query and direction, less that of ``near``, allows; where that doesn't reach
    the threshold and the k-th best so far, the cell isn't multiplied. ``counter``: a Spark accumulator of the products of
    query and vector that are computed."""

    def over(block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, u = block.value
            best = Best(ids, k, threshold, digits)
            for b in batches:
                direction, near = matrix(b.column(0)), b.column(1).to_numpy()
                angle = np.arccos(np.clip(u @ direction.T, -1, 1)) - np.arccos(np.clip(near, -1, 1))
                bound = np.where(direction.any(axis=1), np.cos(np.maximum(angle, 0)), 0.0)
                # cells that most queries are near come first, so that the k-th best is soon a good one
                for j in np.argsort(-bound.mean(axis=0)).tolist():
                    some = best.reach(bound[:, j])
                    if not len(some):
                        continue
                    own = b.column(2)[j].values.to_numpy()
                    if counter is not None:
                        counter.add(len(some) * len(own))
                    x = unit(b.column(3)[j].values.to_numpy().astype(float).reshape(len(own), -1))
                    found = best.add(some, u[some] @ x.T, own)
                    if found is not None:
                        yield best.batch(found)
            if k is not None:
                yield best.batch()

        return cells.select("direction", "near", "ids", "vectors").mapInArrow(run, SCORES)

    return _each_block(queries, over)
