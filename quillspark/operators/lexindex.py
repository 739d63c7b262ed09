"""A saved inverted index and exact top-k retrieval over it.

Chunks are dealt to segments of up to SEGMENT_ROWS where they are read, without a shuffle. A segment has a row for each of
its terms: the chunks (by their place in the segment) and counts, in blocks of BLOCK, with the largest count and the
shortest chunk of each block; and one row of its own with chunk ids, documents and lengths. Rows lie in folders by
generation and by hash of the term, so a query table reads the folders of its own terms (dynamic partition pruning), and
those of the segments' own rows.

A search goes segment by segment. Terms of a query are added up in order of the most they can give. As soon as what is
left can't lift a new chunk to the k-th score so far, only chunks already met go on, and blocks in which none of them
can reach it aren't opened. A task emits the k best of each query and segment at most; other pairs never leave it. The
document filter and the vector scores of a hybrid search take part in the same step, so bounds hold for the fused score.

Changed documents are written as a new generation, beside a list of the places where older ones had them; those places
count no more, in scores as in statistics, and ``compact_index`` writes the index anew without them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.functions.text import tokens
from quillspark.sources.corpus import small_batches, written

#: Chunks and tokens of a segment at most, postings of a block, folders by term.
SEGMENT_ROWS, SEGMENT_TOKENS, BLOCK, BUCKETS = 4096, 1 << 21, 64, 64
#: Queries of a block: they are held by the driver and broadcast.
QUERY_ROWS = 2048
#: Of as many segments one goes first, and gives the others a k-th score to begin with.
FIRST_SHARE = 16
#: The folder of the segments' own rows.
OWN = -1

ROW = "segment long, term string, at array<int>, tf array<int>, block_tf array<int>, block_length array<int>, chunk_ids array<long>, documents array<string>, lengths array<int>"


class Index(NamedTuple):
    """Rows of all generations, and the places (generation, segment, at, n, length) that count no more."""

    rows: DataFrame
    dead: DataFrame
    buckets: int

    @property
    def segments(self) -> DataFrame:
        """A row for each segment, with the places in it that are dead."""
        dead = self.dead.groupBy("generation", "segment").agg(F.flatten(F.collect_list("at")).alias("dead"))
        own = self.rows.where(F.col("bucket") == OWN).select("generation", "segment", "chunk_ids", "documents", "lengths")
        return own.join(dead, ["generation", "segment"], "left")  # both sides are saved tables


def _lists(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(values.astype(np.int32)))


class Part(NamedTuple):
    """What a segment keeps of some chunks until it is full: copies, so that no batch of texts stays in memory for it."""

    ids: pa.Array
    documents: pa.Array
    length: np.ndarray
    words: pa.DictionaryArray

    @classmethod
    def of(cls, b: pa.RecordBatch) -> Part:
        rows = pa.array(np.arange(b.num_rows))
        return cls(b.column(0).take(rows), b.column(1).take(rows), np.diff(b.column(2).offsets.to_numpy()), b.column(2).flatten().dictionary_encode())


def _segment(number: int, parts: list[Part]) -> pa.RecordBatch:
    ids, documents = (pa.concat_arrays(x) for x in list(zip(*parts, strict=True))[:2])
    n, length = len(ids), np.concatenate([x.length for x in parts])
    words = pa.chunked_array([x.words for x in parts]).unify_dictionaries()
    parts.clear()
    key = np.concatenate([x.indices.to_numpy(zero_copy_only=False) for x in words.chunks], dtype=np.int64)
    words = words.chunk(0).dictionary
    key *= n
    key += np.repeat(np.arange(n), length)
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    new = np.flatnonzero(new)
    key, tf = key[new], np.diff(np.append(new, len(key)))
    code, at = key // max(n, 1), key % max(n, 1)
    first = np.flatnonzero(np.diff(code, prepend=-1))
    cut = np.append(first, len(key))
    blocks = -(-np.diff(cut) // BLOCK)
    edges = np.concatenate([[0], np.cumsum(blocks)])
    starts = np.repeat(first, blocks) + BLOCK * (np.arange(edges[-1]) - np.repeat(edges[:-1], blocks))
    none = lambda kind, m: pa.nulls(m, kind)
    some, terms = len(first), words.take(pa.array(code[first]))
    reduced = [x.reduceat(y, starts) if some else np.zeros(0, int) for x, y in ((np.maximum, tf), (np.minimum, length[at]))]
    ints, longs, strings = pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string())
    whole = lambda c, kind: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), c.cast(kind))
    columns = [
        pa.array(np.full(some + 1, number)),
        pa.concat_arrays([terms.cast(pa.string()), none(pa.string(), 1)]),
        *(pa.concat_arrays([x.cast(ints), none(ints, 1)]) for x in (_lists(at, cut), _lists(tf, cut), _lists(reduced[0], edges), _lists(reduced[1], edges))),
        pa.concat_arrays([none(longs, some), whole(ids, pa.int64()).cast(longs)]),
        pa.concat_arrays([none(strings, some), whole(documents, pa.string()).cast(strings)]),
        pa.concat_arrays([none(ints, some), _lists(length, np.array([0, n])).cast(ints)]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["segment", "term", "at", "tf", "block_tf", "block_length", "chunk_ids", "documents", "lengths"])


def segment_rows(chunks: DataFrame, chunk: str, text: str, document: str | None = None, most: int = SEGMENT_ROWS) -> DataFrame:
    """Rows of the segments, of ``most`` chunks at most, that the chunks are dealt to."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, rows, size = TaskContext.get().partitionId() << 32, [], 0, 0
        for b in batches:
            per = np.diff(b.column(2).offsets.to_numpy())
            at = 0
            while at < b.num_rows:
                upto = at + int(np.searchsorted(np.cumsum(per[at:]), max(SEGMENT_TOKENS - size, 1), side="right"))
                upto = min(max(upto, at + (not rows)), at + most - rows, b.num_rows)
                if upto > at:
                    held.append(Part.of(b.slice(at, upto - at)))
                    rows, size = rows + upto - at, size + int(per[at:upto].sum())
                full = rows >= most or upto < b.num_rows
                at = upto
                if full and held:
                    yield _segment(number, held)
                    number, held, rows, size = number + 1, [], 0, 0
        if held:
            yield _segment(number, held)

    small_batches(chunks.sparkSession)
    some = chunks.select(F.col(chunk).cast("long").alias("chunk_id"), (F.col(document) if document else F.lit(None)).cast("string").alias("document"), tokens(F.col(text)).alias("ts"))
    return some.mapInArrow(build, ROW)


def _bucket(term: str, buckets: int):
    return F.when(F.col(term).isNull(), OWN).otherwise(F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int"))


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows with their bucket, which is spread over up to four files."""
    return rows.withColumn("bucket", _bucket("term", buckets)).repartition("bucket", F.pmod("segment", F.lit(4)))


def _save_new(rows: DataFrame, path: str, buckets: int) -> None:
    """Rows as the first generation, over all that was there."""
    _dealt(rows, buckets).withColumn("generation", F.lit(0)).write.mode("overwrite").partitionBy("generation", "bucket").parquet(f"{path}/index")
    rows.sparkSession.createDataFrame([], DEAD + ", generation int").write.mode("overwrite").partitionBy("generation").parquet(f"{path}/dead")


DEAD = "of long, segment long, at array<int>, n long, length long"


def write_index(chunks: DataFrame, path: str, chunk: str, text: str, document: str | None = None, buckets: int = BUCKETS, most: int = SEGMENT_ROWS) -> Index:
    """A new index at ``path``, over what was there."""
    _save_new(segment_rows(chunks, chunk, text, document, most), path, buckets)
    return open_index(chunks.sparkSession, path, buckets)


def open_index(spark: SparkSession, path: str, buckets: int = BUCKETS, before: int | None = None) -> Index:
    """The index at ``path``, as it was ``before`` a generation."""
    rows = spark.read.schema(ROW + ", generation int, bucket int").parquet(f"{path}/index")
    dead = spark.read.schema(DEAD + ", generation int").parquet(f"{path}/dead")
    if before is not None:
        rows, dead = rows.where(F.col("generation") < before), dead.where(F.col("generation") < before)
    return Index(rows, dead.select(F.col("of").cast("int").alias("generation"), "segment", "at", "n", "length"), buckets)


def refresh_index(spark: SparkSession, path: str, changed: DataFrame, chunk: str, text: str, document: str, removed: DataFrame | None = None, generation: int | None = None, buckets: int = BUCKETS) -> Index:
    """The documents of ``changed`` get these chunks instead of those they had, those of ``removed`` (a column named as
    ``document``) get none. Their old places are found in the segments' own rows; no text and no posting is read.

    A generation that is given (a stream's batch number, above those that are there) can be written again after a failure.
    One writer at a time."""
    if generation is None:
        generation = open_index(spark, path, buckets).rows.where(F.col("bucket") == OWN).agg(F.coalesce(F.max("generation"), F.lit(-1))).first()[0] + 1
    index = open_index(spark, path, buckets, generation)
    ids = changed.select(F.col(document).cast("string").alias("document"))
    ids = written((ids if removed is None else ids.unionByName(removed.select(F.col(document).cast("string").alias("document")))).distinct())
    old = index.segments.select("generation", "segment", F.coalesce("dead", F.array().cast("array<int>")).alias("dead"), F.posexplode(F.arrays_zip("documents", "lengths")).alias("p", "c"))
    old = old.select("generation", "segment", "p", F.col("c.documents").alias("document"), F.col("c.lengths").alias("length"), F.array_contains("dead", F.col("p")).alias("gone")).where("NOT gone")
    gone = old.join(ids.hint("merge"), "document", "left_semi").groupBy("generation", "segment")
    gone = gone.agg(F.collect_list("p").alias("at"), F.count_if(F.col("length") > 0).alias("n"), F.sum("length").alias("length"))
    gone = written(gone.select(F.col("generation").cast("long").alias("of"), "segment", "at", "n", F.col("length").cast("long").alias("length")))
    _dealt(segment_rows(changed, chunk, text, document), buckets).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/index/generation={generation}")
    gone.write.mode("overwrite").parquet(f"{path}/dead/generation={generation}")
    return open_index(spark, path, buckets)


def compact_index(index: Index, path: str) -> Index:
    """The index written anew at another path as one generation, without the dead places. Segments keep their chunks."""
    spark = index.rows.sparkSession
    gone = index.segments.select("generation", "segment", F.coalesce("dead", F.array().cast("array<int>")).alias("dead"), F.col("lengths").alias("all_lengths"))
    rows = index.rows.join(gone.hint("merge"), ["generation", "segment"])
    live = lambda c, places: F.transform(F.filter(F.arrays_zip(F.col(places).alias("p"), F.col(c).alias("v")), lambda x: ~F.array_contains("dead", x["p"])), lambda x: x["v"])
    every = rows.withColumn("every", F.sequence(F.lit(0), F.size("all_lengths") - 1))
    # a place moves down by the dead places before it
    moved = F.transform(F.array_except("at", "dead"), lambda a: (a - F.size(F.filter("dead", lambda d: d < a))).cast("int"))
    out = every.select(
        F.xxhash64("generation", "segment").alias("segment"), "term", moved.alias("at"), live("tf", "at").alias("tf"), "block_tf", "block_length",
        *(live(c, "every").alias(c) for c in ("chunk_ids", "documents", "lengths")),
    ).where("term IS NULL OR size(at) > 0")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the bounds of the old blocks hold for what is left of a list, though they may be loose
        for b in batches:
            cols = {c: b.column(i).to_pylist() for i, c in enumerate(("at", "block_tf", "block_length"))}
            tf, length = [], []
            for at, t, n in zip(*cols.values(), strict=True):
                m = 0 if at is None else -(-len(at) // BLOCK)
                tf.append(None if at is None else [max(t)] * m)
                length.append(None if at is None else [min(n)] * m)
            names = b.schema.names
            arrays = [pa.array(tf, pa.list_(pa.int32())) if c == "block_tf" else pa.array(length, pa.list_(pa.int32())) if c == "block_length" else b.column(names.index(c)) for c in names]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = [x.split()[0] for x in ROW.split(", ")]
    order = ["at", "block_tf", "block_length", *(c for c in names if c not in ("at", "block_tf", "block_length"))]
    kinds = dict(x.split() for x in ROW.split(", "))
    compacted = out.select(*order).mapInArrow(blocks, ", ".join(f"{c} {kinds[c]}" for c in order)).select(*names)
    _save_new(compacted, path, index.buckets)
    return open_index(spark, path, index.buckets)


def matching(index: Index, terms: DataFrame) -> DataFrame:
    """Postings of some terms (a column ``term``, as many as can be broadcast). Only the folders of their buckets are
    read: the comparison tells Spark that the terms select some of them."""
    wanted = terms.select("term").where(F.col("term") > "").distinct().withColumn("bucket", _bucket("term", index.buckets))
    return index.rows.join(wanted.hint("broadcast"), ["bucket", "term"])


def frequencies(index: Index, terms: DataFrame) -> DataFrame:
    """(term, df): live chunks that have each term."""
    dead = index.dead.groupBy("generation", "segment").agg(F.flatten(F.collect_list("at")).alias("dead"))
    n = F.when(F.col("dead").isNull(), F.size("at")).otherwise(F.size(F.array_except("at", "dead")))
    return matching(index, terms).select("generation", "segment", "term", "at").join(dead, ["generation", "segment"], "left").groupBy("term").agg(F.sum(n).alias("df"))


def index_size(index: Index) -> DataFrame:
    """One row, n and mean: live chunks that have a token, and their mean length; and the number of segments."""
    own = index.rows.where(F.col("bucket") == OWN).agg(F.count("*").alias("segments"), F.sum(F.size(F.filter("lengths", lambda x: x > 0))).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)).alias("t"))
    dead = index.dead.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("dn"), F.coalesce(F.sum("length"), F.lit(0)).alias("dt"))
    return own.crossJoin(F.broadcast(dead)).select((F.col("n") - F.col("dn")).alias("n"), ((F.col("t") - F.col("dt")) / (F.col("n") - F.col("dn"))).alias("mean"), "segments")  # one row each


def round_half_up(x: np.ndarray, digits: int | None) -> np.ndarray:
    return x if digits is None else np.floor(x * 10.0**digits + 0.5) / 10.0**digits


@dataclass(frozen=True)
class Scoring:
    """BM25's parameters, the digits that its score (mapped to s / (s + 1)) is rounded to, one after the other, and those
    of the fused score; hits per query (None: every pair with a score)."""

    k: int | None
    k1: float = 1.2
    b: float = 0.75
    lexical_digits: tuple[int, ...] = ()
    digits: int | None = None

    def lexical(self, s: np.ndarray) -> np.ndarray:
        x = s / (s + 1)
        for d in self.lexical_digits:
            x = round_half_up(x, d)
        return x

    def fused(self, s: np.ndarray, v: np.ndarray, w: tuple[float, float]) -> np.ndarray:
        return round_half_up(w[0] * self.lexical(s) + w[1] * v, self.digits)

    def part(self, tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / mean))


class Query(NamedTuple):
    query_id: int
    terms: list[tuple[str, float]]
    weights: tuple[float, float]
    documents: frozenset[str] | None
    floor: float


@dataclass
class Segment:
    """A segment's rows in arrays."""

    ids: np.ndarray
    lengths: np.ndarray
    documents: list
    live: np.ndarray
    lists: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    parts: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def part(self, t: str, scoring: Scoring, mean: float) -> tuple[np.ndarray, np.ndarray]:
        """A term's impacts, but for its idf, and the bounds of its blocks; kept for the next query."""
        if t not in self.parts:
            at, tf, block_tf, block_length = self.lists[t]
            self.parts[t] = scoring.part(tf, self.lengths[at], mean), scoring.part(block_tf, block_length, mean)
        return self.parts[t]

    @classmethod
    def of(cls, postings: pa.Table, own: pa.Table) -> Segment:
        lengths = own.column("lengths")[0].values.to_numpy(zero_copy_only=False)
        live = np.ones(len(lengths), bool)
        if (dead := own.column("dead")[0]).is_valid:
            live[dead.values.to_numpy(zero_copy_only=False)] = False
        parts = []
        for c in ("at", "tf", "block_tf", "block_length"):
            for a in (postings.column(c).chunks if postings.num_rows else []):
                parts.append((c, a.offsets.to_numpy(), a.values.to_numpy(zero_copy_only=False)))
        by: dict[str, list] = {c: [v[x:y] for p, o, v in parts if p == c for x, y in zip(o, o[1:], strict=False)] for c in ("at", "tf", "block_tf", "block_length")}
        lists = dict(zip(postings.column("term").to_pylist(), zip(*by.values(), strict=True), strict=True)) if postings.num_rows else {}
        return cls(own.column("chunk_ids")[0].values.to_numpy(zero_copy_only=False), lengths, own.column("documents")[0].as_py(), live, lists)

    def allowed(self, documents: frozenset[str] | None) -> np.ndarray:
        return self.live if documents is None else self.live & np.array([d in documents for d in self.documents], bool)

    def best(self, q: Query, scoring: Scoring, mean: float, near: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places, lexical sums, vector scores and fused scores of the query's best chunks here."""
        own = [(idf, self.lists[t][0], *self.part(t, scoring, mean)) for t, idf in q.terms if t in self.lists]
        k, n = scoring.k, len(self.ids)
        s, v, alive = np.zeros(n), np.zeros(n), self.allowed(q.documents)
        if near is not None:
            v[near[0]] = near[1]
        own.sort(key=lambda x: -x[0] * float(x[3].max()))
        left = np.append(np.cumsum([idf * float(bounds.max()) for idf, _, _, bounds in reversed(own)])[::-1], 0.0)
        floor, some, check = q.floor, None, 1
        none = np.zeros(1)
        for j, (idf, at, parts, bounds) in enumerate(own):
            if some is None and floor > 0 and scoring.fused(none + left[j], none, q.weights)[0] < floor:
                some = np.flatnonzero(alive & ((s > 0) | (v > 0)))  # no other chunk can come up to the floor
            if some is None:
                s[at] += idf * parts
            else:
                # what this list can give a chunk: at most the bound of the block it would be in
                block = np.maximum(np.searchsorted(at[::BLOCK], some, side="right") - 1, 0)
                some = some[scoring.fused(s[some] + idf * bounds[block] + left[j + 1], v[some], q.weights) >= floor]
                where = np.minimum(np.searchsorted(at, some), len(at) - 1)
                met = at[where] == some
                s[some[met]] += idf * parts[where[met]]
            if k is not None and (j + 1 == check or some is not None):
                check *= 2
                known = np.flatnonzero(alive & (s > 0)) if some is None else some
                if len(known) >= k:
                    f = scoring.fused(s[known], v[known], q.weights)
                    floor = max(floor, float(np.partition(f, len(f) - k)[len(f) - k]))
        found = np.flatnonzero(alive & ((s > 0) | (v > 0))) if some is None else some
        f = scoring.fused(s[found], v[found], q.weights)
        keep = (q.weights[0] * s[found] + q.weights[1] * v[found] > 0) & (f >= floor)
        found, f = found[keep], f[keep]
        if k is not None and len(found) > k:
            first = np.lexsort((self.ids[found], -f))[:k]
            found, f = found[first], f[first]
        return found, s[found], v[found], f

    def with_all(self, q: Query) -> np.ndarray:
        """Places of the chunks that have all terms of the query, by its shortest list first."""
        if not q.terms or any(t not in self.lists for t, _ in q.terms):
            return np.zeros(0, int)
        lists = sorted((self.lists[t][0] for t, _ in q.terms), key=len)
        found = lists[0]
        for at in lists[1:]:
            where = np.minimum(np.searchsorted(at, found), len(at) - 1)
            found = found[at[where] == found]
        return found[self.allowed(q.documents)[found]]


HITS = "query_id long, chunk_id long, bm25_score double, vector_score double, combined_score double"


def _over_segments(index: Index, terms: DataFrame, segments: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` on each segment's postings of some terms and its own row."""
    postings = matching(index, terms).select(F.col("generation").alias("g"), F.col("segment").alias("s"), "term", "at", "tf", "block_tf", "block_length")
    return postings.groupBy("g", "s").cogroup(segments.groupBy("generation", "segment")).applyInArrow(run, schema)


def _blocks(queries: DataFrame) -> Iterator[list]:
    """Rows of the queries, QUERY_ROWS or so at a time."""
    n = max(1, -(-queries.count() // QUERY_ROWS))
    for i in range(n):
        if rows := queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).collect():
            yield rows


def _terms_of(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame([(t,) for t in sorted({t for r in rows for t in r["terms"]})], "term string")


def match_queries(index: Index, queries: DataFrame, text: str) -> DataFrame:
    """Pairs of query (query_id and a text) and chunk that has all its terms; a query without terms matches none."""
    spark, out = index.rows.sparkSession, None
    schema = "query_id long, chunk_id long"

    def among(block) -> Callable:
        def run(postings: pa.Table, own: pa.Table) -> pa.Table:
            found = []
            if own.num_rows and postings.num_rows:
                s = Segment.of(postings, own)
                found = [(q.query_id, s.ids[x]) for q in block.value if len(x := s.with_all(q))]
            ids = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
            return pa.table({"query_id": np.repeat(np.array([q for q, _ in found], np.int64), [len(x) for _, x in found]), "chunk_id": ids.astype(np.int64)})

        return run

    for rows in _blocks(queries.select("query_id", F.array_distinct(tokens(F.col(text))).alias("terms"))):
        block = spark.sparkContext.broadcast([Query(r["query_id"], [(t, 0.0) for t in r["terms"]], (1.0, 0.0), None, 0.0) for r in rows])
        some = _over_segments(index, _terms_of(spark, rows), index.segments, among(block), schema)
        out = some if out is None else out.unionByName(some)
    return spark.createDataFrame([], schema) if out is None else out


def segment_hits(index: Index, queries: DataFrame, text: str, scoring: Scoring, vectors: DataFrame | None = None) -> DataFrame:
    """The k best chunks of each query and segment, before they meet: query_id, chunk_id, bm25_score, vector_score,
    combined_score. See ``search_index``."""
    spark = index.rows.sparkSession
    have = set(queries.columns)
    asked = queries.select(
        "query_id", F.array_distinct(tokens(F.col(text))).alias("terms"), *((F.col(c) if c in have else F.lit(x)).cast("double").alias(c) for c, x in (("w_lexical", 1.0), ("w_vector", 0.0 if vectors is None else 1.0))),
        (F.col("documents") if "documents" in have else F.lit(None)).cast("array<string>").alias("documents"),
    )
    size = index_size(index).first()
    segments, outside = index.segments, None
    if vectors is not None:
        at = index.rows.where(F.col("bucket") == OWN).select("generation", "segment", F.posexplode("chunk_ids").alias("p", "chunk_id"))
        dead = index.dead.select("generation", "segment", F.explode("at").alias("p"))
        at = at.join(dead.hint("merge"), ["generation", "segment", "p"], "left_anti")
        # scores of queries that aren't asked would be held by every segment
        vectors = vectors.join(asked.select("query_id").distinct().hint("merge"), "query_id", "left_semi")
        vectors = vectors if "document_id" in vectors.columns else vectors.withColumn("document_id", F.lit(None))
        placed = written(vectors.select("query_id", "chunk_id", "vector_score", F.col("document_id").cast("string").alias("document")).join(at.hint("merge"), "chunk_id", "left"))
        inside, outside = placed.where(F.col("segment").isNotNull()), placed.where(F.col("segment").isNull())
    many = size["segments"] > 2 * FIRST_SHARE and scoring.k is not None
    out = None
    for rows in _blocks(asked):
        terms, held = _terms_of(spark, rows), segments
        if vectors is not None:  # a segment holds vector scores of one block of queries at a time
            ids = spark.createDataFrame([(r["query_id"],) for r in rows], "query_id long").distinct()
            near = inside.join(ids.hint("broadcast"), "query_id", "left_semi").groupBy("generation", "segment").agg(F.collect_list(F.struct("query_id", "p", "vector_score")).alias("near"))
            held = segments.join(near.hint("merge"), ["generation", "segment"], "left")
        df = {r["term"]: r["df"] for r in frequencies(index, terms).collect()}  # a row for each term of the block at most
        idf = {t: float(np.log(1 + (size["n"] - n + 0.5) / (n + 0.5))) for t, n in df.items() if n}

        def over(some: DataFrame, floors: dict[int, float], rows=rows, idf=idf, terms=terms) -> DataFrame:
            block = spark.sparkContext.broadcast([Query(r["query_id"], [(t, idf[t]) for t in r["terms"] if t in idf], (r["w_lexical"], r["w_vector"]), None if r["documents"] is None else frozenset(r["documents"]), floors.get(r["query_id"], 0.0)) for r in rows])

            def run(postings: pa.Table, own: pa.Table) -> pa.Table:
                cols: list[list] = [[], [], [], [], []]
                if own.num_rows:
                    s = Segment.of(postings, own)
                    by: dict[int, tuple] = {}
                    if "near" in own.column_names and own.column("near")[0].is_valid:
                        ids, places, scores = (x.to_numpy(zero_copy_only=False) for x in own.column("near")[0].values.flatten())
                        order = np.argsort(ids, kind="stable")
                        cut = np.flatnonzero(np.diff(ids[order])) + 1
                        by = {int(ids[x[0]]): (places[x], scores[x]) for x in np.split(order, cut)}
                    for q in block.value:
                        near = by.get(q.query_id)
                        at, sums, v, f = s.best(q, scoring, size["mean"], near)
                        for c, x in zip(cols, (np.full(len(at), q.query_id), s.ids[at], scoring.lexical(sums), v, f), strict=True):
                            c.append(x)
                kinds = (np.int64, np.int64, float, float, float)
                return pa.table({name: np.concatenate(c).astype(kind) if c else np.zeros(0, kind) for name, c, kind in zip(("query_id", "chunk_id", "bm25_score", "vector_score", "combined_score"), cols, kinds, strict=True)})

            return _over_segments(index, terms, some, run, HITS)

        first = F.pmod(F.xxhash64("generation", "segment"), F.lit(FIRST_SHARE)) == 0
        if many:
            early = written(over(held.where(first), {}))
            kth = early.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("combined_score")))).where(F.col("r") == scoring.k)
            some = early.unionByName(over(held.where(~first), {r["query_id"]: r["combined_score"] for r in kth.collect()}))
        else:
            some = over(held, {})
        out = some if out is None else out.unionByName(some)
    if out is None:
        return spark.createDataFrame([], HITS)
    if outside is not None:  # chunks that the index doesn't have: their lexical score is 0
        d = scoring.digits
        fused = F.col("w_vector") * F.col("vector_score")
        o = outside.join(asked.select("query_id", "w_vector", "documents").hint("merge"), "query_id").where(F.col("documents").isNull() | F.coalesce(F.array_contains("documents", F.col("document")), F.lit(False)))
        o = o.select("query_id", "chunk_id", F.lit(0.0).alias("bm25_score"), "vector_score", (fused if d is None else F.round(fused, d)).alias("combined_score")).where("combined_score > 0")
        out = out.unionByName(o)
    return out


def search_index(index: Index, queries: DataFrame, text: str, scoring: Scoring, vectors: DataFrame | None = None) -> DataFrame:
    """The k best chunks of each query by BM25, or by the weighted sum of it and a vector score, with their rank; equal
    scores in order of chunk id. Scores are those of ``search.lexical_scores`` and ``search.fuse``.

    ``queries``: query_id, a text, and where wanted w_lexical, w_vector and documents (a query with a list takes chunks of
    these alone, by both scores). ``vectors``: query_id, chunk_id, vector_score of the chunks that are near enough, one row
    a pair, scores not negative; chunks that the index doesn't know take part with a lexical score of 0 (under a query's
    document list only where a column document_id says that they are in it). Ties and repeated queries are as in the tables; an empty index or query table gives no rows."""
    hits = segment_hits(index, queries, text, scoring, vectors)
    if scoring.k is None:
        return hits
    w = W.partitionBy("query_id").orderBy(F.desc("combined_score"), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= scoring.k)
