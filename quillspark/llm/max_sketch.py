"""Ranked lexical search over hashed max-sketches.

``build_index`` reads every text once and writes a row for it: its words by 64-bit hash with their counts (the exact
list) and a sketch of them. A sketch has 2**b coordinates, ``SPREAD`` for each different word or more; a word falls on
that of its hash's first b bits, and a coordinate keeps the largest count that falls on it, as one of sixteen grades
rounded up (four bits). A word's impact grows with its count, so that is the coordinatewise maximum of the impacts,
whatever weights and lengths come to be; impacts are taken from it when queries are.

``search`` takes queries in blocks. For a block it counts the documents that hold each of its words; looks the words of
all queries up in the sketches, which bounds every score from above, as a product of matrices; scores the documents of
the highest bounds exactly, which gives each query a threshold, the k-th best score among those; and then goes through
the index once more, in each batch by descending bound, scoring exactly until the bounds fall below the threshold, which
grows meanwhile. Every document whose bound reaches the threshold is scored, so results are exact. A task holds the k best
of each query of the block, and only these leave it.

Terms, weights and scores are those of the function ``search``; all arithmetic of scores is in 64-bit integers. Bounds are
in single precision, and enlarged by more than their error.

Defined results: null texts and texts without terms are no documents and no queries; terms of long texts all count; equal
rows are documents of their own, each with its own rank; equal scores are in ascending order of id, null first; items
with the same id and text count once, with the same id and different texts are ranked each by itself; extra columns take
no part; an empty table of either kind gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quillspark.llm.store import written
from quillspark.llm.textops import ALNUM, chunks, map_texts, span_hash, words

#: Coordinates for each different word, at least, and in all.
SPREAD, LEAST_BITS = 8, 4
#: Counts that a coordinate can say; the last stands for any.
GRADES = np.array([0, 1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 64, 128, np.iinfo(np.int64).max])
#: Queries and terms of a block, about; numbers of a matrix in a task.
BLOCK_QUERIES, BLOCK_TERMS, CELLS = 256, 1 << 14, 1 << 22
#: Documents by query that give the first threshold, and those that a task names for it.
SEEDS, TASK_SEEDS = 64, 8


def counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of each different word of each text, in order, and the words of each text."""
    data, starts, ends, first = words(texts, ALNUM)
    h, n = span_hash(data, starts, ends), np.diff(first)
    doc = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h))), n


def sketches(doc: np.ndarray, h: np.ndarray, tf: np.ndarray, n: int) -> list[bytes]:
    """The sketch of each of n texts."""
    different = np.bincount(doc, minlength=n)
    bits = np.maximum(np.ceil(np.log2(np.maximum(different * SPREAD, 1))).astype(np.int64), LEAST_BITS)
    wide = np.where(different > 0, 1 << bits, 0)
    base = np.concatenate([[0], np.cumsum(wide)])
    out = np.zeros(base[-1], np.uint8)
    np.maximum.at(out, base[doc] + (h >> (64 - bits[doc]).astype(np.uint64)).astype(np.int64), np.searchsorted(GRADES, tf).astype(np.uint8))
    packed = out[0::2] | out[1::2] << 4
    return [packed[a // 2 : b // 2].tobytes() for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("sketch", T.BinaryType()), T.StructField("terms", T.BinaryType()), T.StructField("counts", T.BinaryType())]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index, written: a row for each text that has a word, numbered."""

    def make():
        def run(texts: list[bytes]) -> list:
            out: list[list] = [[], [], [], []]
            for i, j in chunks(texts):
                doc, h, tf, n = counted(texts[i:j])
                cut = np.searchsorted(doc, np.arange(j - i + 1)).tolist()
                out[0] += n.tolist()
                out[1] += sketches(doc, h, tf, j - i)
                out[2] += [h[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
                out[3] += [tf[a:b].astype(np.uint32).tobytes() for a, b in zip(cut, cut[1:], strict=False)]
            return out

        return run

    some = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    rows = map_texts(some, "t", make, FIELDS, ["id"]).where("n_words > 0")
    return written(rows.withColumn("row", F.monotonically_increasing_id()), compression="zstd")


class Block:
    """Queries of a block: their terms in order of hash, weights by term, and the part of each query."""

    def __init__(self, queries: list[tuple[bytes, bytes]]) -> None:
        own = [(np.frombuffer(t, np.uint64), np.frombuffer(c, np.uint32).astype(np.int64)) for t, c in queries]
        self.vocabulary = np.unique(np.concatenate([t for t, _ in own]))
        self.parts = [(np.searchsorted(self.vocabulary, t), c) for t, c in own]
        self.weights = np.zeros(len(self.vocabulary), np.int64)
        self.n = self.length = 0
        self.floor = np.ones(len(own), np.int64)

    def weigh(self, df: np.ndarray, n: int, length: int) -> None:
        self.n, self.length = n, length
        self.weights = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms are some query's, and their places."""
        at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == terms
        return known, at[known]

    @cached_property
    def weighted(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and weights, with repeats, of each query's terms."""
        return [(at, c * self.weights[at]) for at, c in self.parts]

    @cached_property
    def _matrices(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        return {}

    def lookups(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates that the terms fall on in sketches of 2**bits, and their weights by query."""
        if bits not in self._matrices:
            coordinates, of = np.unique((self.vocabulary >> np.uint64(64 - bits)).astype(np.int64), return_inverse=True)
            m = np.zeros((len(coordinates), len(self.parts)))
            for q, (at, w) in enumerate(self.weighted):
                np.add.at(m[:, q], of[at], w)
            # single precision is off by less, as all is nonnegative: an eighth of a millionth for each number of a sum
            self._matrices[bits] = coordinates, (m * (1 + (len(coordinates) + 8) * 2.0**-23)).astype(np.float32)
        return self._matrices[bits]

    def damping(self, n_words: np.ndarray) -> np.ndarray:
        return 75 + 25 * n_words * self.n // self.length

    def rows(self) -> int:
        """Documents whose matrices a task holds at once."""
        return max(8, CELLS // max(len(self.vocabulary), len(self.parts)))

    def bounds(self, same: list[bytes], n_words: np.ndarray) -> np.ndarray:
        """Upper bound of the score of each document and query; sketches of one length."""
        at, m = self.lookups(len(same[0]).bit_length())
        packed = np.frombuffer(b"".join(same), np.uint8).reshape(len(same), -1)
        grades = packed[:, at >> 1] >> ((at & 1) * 4).astype(np.uint8) & 15
        finite = GRADES[:-1]
        damping = 12 * self.damping(n_words)
        impact = np.full((len(same), len(GRADES)), 10**6, np.float32)
        impact[:, :-1] = 10**9 * finite // (1000 * finite + damping[:, None])
        return np.take_along_axis(impact, grades.astype(np.intp), 1) @ m

    def impacts(self, terms: list[bytes], counts: list[bytes], n_words: np.ndarray) -> np.ndarray:
        """Exact impact of each of the block's terms in each document."""
        size = np.array([len(t) // 8 for t in terms])
        known, at = self.find(np.frombuffer(b"".join(terms), np.uint64))
        doc = np.repeat(np.arange(len(terms)), size)[known]
        tf = np.frombuffer(b"".join(counts), np.uint32).astype(np.int64)[known]
        out = np.zeros((len(terms), len(self.vocabulary)), np.int32)
        out[doc, at] = 10**9 * tf // (1000 * tf + 12 * self.damping(n_words)[doc])
        return out


def _alike(sketch: list[bytes], most: int) -> Iterator[np.ndarray]:
    """Places of sketches of the same length, ``most`` at a time."""
    size = np.array([len(s) for s in sketch])
    for x in np.unique(size):
        at = np.flatnonzero(size == x)
        for i in range(0, len(at), most):
            yield at[i : i + most]


def _frequencies(index: DataFrame, block) -> dict[int, int]:
    """Documents that hold each term of a block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        n = np.zeros(len(b.vocabulary), np.int64)
        for x in batches:
            if x.num_rows:
                _, at = b.find(np.frombuffer(b"".join(x.column(0).to_pylist()), np.uint64))
                n += np.bincount(at, minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["term", "n"])

    rows = index.select("terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in rows.collect()}  # a row for each term of the block at most


def _seeds(index: DataFrame, block) -> DataFrame:
    """(query, row) of the highest bounds."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        top = np.zeros((TASK_SEEDS, len(b.parts)), np.float32)
        rows = np.full(top.shape, -1, np.int64)
        for x in batches:
            row, n_words, sketch = x.column(0).to_numpy(), x.column(1).to_numpy(), x.column(2).to_pylist()
            for at in _alike(sketch, b.rows()):
                both = np.concatenate([top, b.bounds([sketch[i] for i in at], n_words[at])])
                of = np.concatenate([rows, np.repeat(row[at][:, None], top.shape[1], 1)])
                keep = np.argpartition(-both, TASK_SEEDS - 1, axis=0)[:TASK_SEEDS]
                top, rows = np.take_along_axis(both, keep, 0), np.take_along_axis(of, keep, 0)
        i, q = np.nonzero((rows >= 0) & (top > 0))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(rows[i, q]), pa.array(top[i, q].astype(float))], names=["query", "row", "bound"])

    named = index.select("row", "n_words", "sketch").mapInArrow(best, "query long, row long, bound double")
    w = W.partitionBy("query").orderBy(F.desc("bound"), "row")
    return named.withColumn("r", F.row_number().over(w)).where(F.col("r") <= SEEDS).select("query", "row")


def _thresholds(index: DataFrame, seeds: DataFrame, block, k: int) -> dict[int, int]:
    """The k-th best exact score of each query's seeds, of queries that have as many."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        for x in batches:
            n_words, terms, counts, queries = x.column(0).to_numpy(), x.column(1).to_pylist(), x.column(2).to_pylist(), x.column(3).to_pylist()
            q, s = [], []
            for i in range(0, x.num_rows, b.rows()):
                e = b.impacts(terms[i : i + b.rows()], counts[i : i + b.rows()], n_words[i : i + b.rows()])
                for j, qs in enumerate(queries[i : i + b.rows()]):
                    for own in qs:
                        at, w = b.weighted[own]
                        q.append(own)
                        s.append(int(e[j, at].astype(np.int64) @ w))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(s, pa.int64())], names=["query", "score"])

    # SEEDS rows for each query of the block at most
    wanted = written(seeds.groupBy("row").agg(F.collect_list("query").alias("queries")))
    scored = index.join(wanted.hint("broadcast"), "row").select("n_words", "terms", "counts", "queries").mapInArrow(score, "query long, score long")
    kth = scored.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score")))).where(F.col("r") == k)
    return {r["query"]: r["score"] for r in kth.collect()}  # a row for each query of the block at most


def _best(index: DataFrame, block, k: int) -> DataFrame:
    """(query, id, score) of the k best of each query and task among those that reach the threshold."""
    kind = index.schema["id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        floor = b.floor.copy()
        top: list[list[tuple]] = [[] for _ in b.parts]
        id_type = None
        for x in batches:
            id_type = x.column(0).type
            ids, n_words, sketch, terms, counts = x.column(0).to_pylist(), x.column(1).to_numpy(), *(x.column(j).to_pylist() for j in (2, 3, 4))
            for at in _alike(sketch, b.rows()):
                bound = b.bounds([sketch[i] for i in at], n_words[at])
                reach = bound >= floor
                some = np.flatnonzero(reach.any(axis=1))
                if not len(some):
                    continue
                e = b.impacts([terms[at[i]] for i in some], [counts[at[i]] for i in some], n_words[at[some]])
                for q in np.flatnonzero(reach.any(axis=0)).tolist():
                    own = np.flatnonzero(reach[some, q])
                    own = own[np.argsort(-bound[some[own], q], kind="stable")]
                    term, w = b.weighted[q]
                    i, step = 0, 16
                    while i < len(own) and bound[some[own[i]], q] >= floor[q]:  # by descending bound
                        few = own[i : i + step]
                        s = e[np.ix_(few, term)].astype(np.int64) @ w
                        top[q] += [(-v, (y := ids[at[some[d]]]) is not None, y) for d, v in zip(few.tolist(), s.tolist(), strict=True) if v >= floor[q]]
                        if len(top[q]) >= k:
                            top[q] = sorted(top[q])[:k]
                            floor[q] = max(floor[q], -top[q][-1][0])
                        i, step = i + step, 2 * step
        rows = [(q, y, -v) for q, found in enumerate(top) for v, _, y in sorted(found)[:k]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], id_type), pa.array([r[2] for r in rows], pa.int64())], names=["query", "id", "score"])

    return index.select("id", "n_words", "sketch", "terms", "counts").mapInArrow(score, f"query long, id {kind}, score long")


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", k: int = 20) -> DataFrame:
    """Each item's k highest-scoring documents with a score above 0: item_id, rank, doc_id, score.

    N documents have a term, L is the number of all their terms, n that of one document's, df the documents that hold a
    term, tf its count in one. A term's weight is floor(1000 * ln((2 N + 2) / (2 df + 1))), its impact 10^9 tf div
    (1000 tf + 12 m) with m = 75 + 25 n N div L; a score is the sum of weight times impact over the item's terms, repeats
    included."""
    sc = index.sparkSession.sparkContext
    same = items.select(F.col(f"`{item_id}`").alias("id"), F.col(f"`{item_text}`").alias("text")).where(F.col("text").isNotNull()).distinct()
    queries = build_index(same, "id", "text")
    size = queries.agg(F.count("*").alias("n"), F.sum(F.length("terms") / 8).alias("terms")).first()
    total = index.agg(F.count("*").alias("n"), F.sum("n_words").alias("length")).first()
    blocks = max(1, math.ceil(size["n"] / BLOCK_QUERIES), math.ceil((size["terms"] or 0) / BLOCK_TERMS))
    out = None
    for number in range(blocks if total["n"] else 0):
        mine = queries.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == number).select("row", "terms", "counts").collect()
        if not mine:
            continue
        b = Block([(r["terms"], r["counts"]) for r in mine])
        plain = sc.broadcast(b)
        df = _frequencies(index, plain)
        b.weigh(np.array([df.get(i, 0) for i in range(len(b.vocabulary))], np.int64), total["n"], total["length"])
        weighed = sc.broadcast(b)
        for q, s in _thresholds(index, _seeds(index, weighed), weighed, k).items():
            b.floor[q] = max(s, 1)
        ready = sc.broadcast(b)
        w = W.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_first())
        found = _best(index, ready, k).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        rows = F.element_at(F.lit([r["row"] for r in mine]), (F.col("query") + 1).cast("int"))
        found = written(found.select(rows.alias("row"), "rank", F.col("id").alias("doc_id"), "score"))
        for x in (plain, weighed, ready):
            x.destroy()
        out = found if out is None else out.unionByName(found)
    if out is None:
        kinds = dict(index.dtypes), dict(queries.dtypes)
        return index.sparkSession.createDataFrame([], f"{item_id} {kinds[1]['id']}, rank int, doc_id {kinds[0]['id']}, score long")
    names = queries.select("row", F.col("id").alias(item_id))
    return out.join(names, "row").select(item_id, "rank", "doc_id", "score")
