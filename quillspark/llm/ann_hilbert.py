"""Approximate nearest neighbours by shifted Hilbert curves.

Each curve projects the vectors at random to ``DIMS`` dimensions, shifts the grid by a random offset and orders the
cells along a Hilbert curve. The order is cut into ``RANGES`` equal key ranges. A query looks at its own range and
its neighbours on every curve; exact inner products in double precision rank what it meets there, and the best of
all curves are merged.

The window is a share of the index (three of ``RANGES`` ranges a curve), because neighbours of nearly isotropic
vectors are spread along any curve: so recall stays the same at every size, and the work is a share of brute force.
With clustered vectors more ranges and fewer curves serve as well; both are parameters. A range holds at least four
times the vectors asked for, so that a table of few vectors has fewer ranges and a query meets enough of them.

Nearness is by inner product, so a vector of the index gets one more dimension, by which all are as long as the
longest (in a query it is 0), and lengths count in the order. If few vectors are far longer than all others, the
others fall into few cells: then more of them are looked at, up to all. A key shared by many vectors is one range.

Equal vectors are indexed once: of their ids only the k + 1 smallest can ever be among the k nearest of a query, and
those are kept with the vector, so no group of copies meets in one task. Large ranges are cut into blocks by hash
on both sides, by the rows and queries that meet there; every query block meets every vector block of its ranges.

Defined results: vectors that are null, zero, empty or hold null or non-finite values take no part, nor do vectors
whose length is not the commonest; null ids take no part; of repeated ids with one vector one counts, with several
vectors all count; ties go to the smaller id; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.llm.store import written

CURVES, DIMS, BITS, RANGES, BLOCK_ROWS, SPARE = 12, 6, 4, 24, 8192, 8


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of integer cells (Skilling's transform, over all rows at once)."""
    x = np.ascontiguousarray(cells.T.astype(np.int64))
    n = len(x)
    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(hit, p, swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] & (1 << b), (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(vectors: np.ndarray, curve: int, longest: float | None = None, dims: int = DIMS, bits: int = BITS, seed: int = 17) -> np.ndarray:
    """Hilbert keys of the rows on one shifted curve. Without ``longest``, as queries: the unit vector and 0. With it,
    as members of the index: the vector / longest and what it lacks to length 1, so that the largest inner product
    with a query is the smallest angle."""
    rng = np.random.default_rng([seed, curve, vectors.shape[1]])
    project, shift, lift = rng.standard_normal((vectors.shape[1], dims)), rng.random(dims), rng.standard_normal(dims)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    spread = vectors / length @ project  # about standard normal in every dimension
    if longest is not None:
        share = np.minimum(np.nan_to_num(length / longest, nan=1.0), 1)
        spread = spread * share + np.sqrt(1 - share**2) * lift
    cells = np.clip((spread + 4 + 2 * shift) / 10 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
    return hilbert_key(cells, bits)


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) in double precision, without what takes no part."""
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    return v.where(F.col("id").isNotNull() & (F.size("vec") > 0) & ~bad & F.exists("vec", lambda x: x != 0))


def nearest(
    vectors: DataFrame, id_col: str, vec_col: str, is_query: str, k: int = 20, curves: int = CURVES, ranges: int = RANGES, neighbours: int = 1
) -> DataFrame:
    """For each row for which the SQL condition ``is_query`` (on ``id``) holds: its k nearest other rows.

    Returns query_id, rank (from 1), vec_id, score; largest inner product first, ties to the smaller id.
    """
    spark = vectors.sparkSession
    rows = valid_vectors(vectors, id_col, vec_col)
    commonest = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if commonest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = commonest["n"]
    rows = rows.where(F.size("vec") == dim).dropDuplicates(["id", "vec"])
    by_vec = W.partitionBy("vec").orderBy("id")
    # row_number <= k + 1 is cut on the map side, so a group of copies sends k + 1 ids a task
    kept = rows.withColumn("r", F.row_number().over(by_vec)).where(F.col("r") <= k + 1)
    groups = kept.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    asked = rows.where(is_query).groupBy("vec").agg(F.lit(True).alias("asked"))
    index = written(groups.join(asked.hint("merge"), "vec", "left").select(F.col("ids")[0].alias("rep"), "vec", "ids", F.coalesce("asked", F.lit(False)).alias("asked")))

    squares = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    n, longest = index.agg(F.count("*"), F.sqrt(F.max(squares))).first()

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, asked = np.stack(b["vec"].to_numpy()), b["asked"].to_numpy(bool)
                for c in range(curves):
                    at = pd.Series(pd.NA, index=b.index, dtype="Int64")
                    at[asked] = curve_keys(x[asked], c)
                    yield pd.DataFrame({"rep": b["rep"], "curve": c, "key": curve_keys(x, c, longest), "at": at})

    keyed = written(index.select("rep", "vec", "asked").mapInPandas(keys, "rep long, curve int, key long, at long"))
    # equal cuts of each curve; a value that fills several ranges is one cut, so that neighbouring numbers hold rows
    ranges = max(1, min(ranges, n // (4 * (k + 1))))
    cuts = keyed.groupBy("curve").agg(F.array_distinct(F.percentile_approx("key", [i / ranges for i in range(1, ranges)] or [1.0], 10_000)).alias("cuts"))
    place = lambda key: F.size(F.filter("cuts", lambda c: c < F.col(key)))
    placed = keyed.join(F.broadcast(cuts), "curve").select("rep", "curve", place("key").alias("range"), F.when(F.col("at").isNotNull(), place("at")).alias("spot"), F.size("cuts").alias("last"))
    near = F.sequence(F.greatest(F.col("spot") - neighbours, F.lit(0)), F.least(F.col("spot") + neighbours, F.col("last")))
    asks, members = placed.where("spot IS NOT NULL").select("rep", "curve", F.explode(near).alias("range")), placed.select("rep", "curve", "range")
    # how many rows and queries meet in each range, by which both are cut into blocks
    blocks_of = lambda rows: F.ceil(F.col(rows) / BLOCK_ROWS).cast("int")
    met = members.groupBy("curve", "range").agg(F.count("*").alias("held")).join(F.broadcast(asks.groupBy("curve", "range").agg(F.count("*").alias("asks"))), ["curve", "range"])
    met = F.broadcast(met.select("curve", "range", blocks_of("held").alias("blocks"), blocks_of("asks").alias("qblocks")))
    part = lambda of: F.pmod(F.xxhash64("rep"), of).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    ask = asks.join(met, ["curve", "range"]).select("rep", "curve", "range", part("qblocks").alias("qblock"), each("blocks").alias("block"))
    ask = index.select("rep", "vec").join(ask.hint("merge"), "rep")
    held = members.join(met, ["curve", "range"]).select("rep", F.col("curve").alias("c"), F.col("range").alias("r"), part("blocks").alias("b"), each("qblocks").alias("qb"))
    held = index.select("rep", "vec").join(held.hint("merge"), "rep").select("c", "r", "b", "qb", F.col("rep").alias("member"), F.col("vec").alias("x"))
    pairs = ask.groupBy("curve", "range", "block", "qblock").cogroup(held.groupBy("c", "r", "b", "qb"))

    def best(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(v):
            v = v.sort_values("member")
            x, reps = np.stack(v["x"].to_numpy()), v["member"].to_numpy()
            take = min(k + 1 + SPARE, len(v))
            for i in range(0, len(q), 512):
                part = q.iloc[i : i + 512]
                scores = np.stack(part["vec"].to_numpy()) @ x.T
                top = np.argpartition(-scores, take - 1, axis=1)[:, :take]
                floor = np.take_along_axis(scores, top, 1).min(axis=1)
                # ties with the last place: all that reach it, best first, smaller ids first
                for j, rep in enumerate(part["rep"]):
                    hit = top[j] if (scores[j] >= floor[j]).sum() <= take else np.flatnonzero(scores[j] >= floor[j])
                    hit = hit[np.lexsort((reps[hit], -scores[j, hit]))][:take]
                    out.append(pd.DataFrame({"q": rep, "rep": reps[hit], "s": scores[j, hit]}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "rep": [], "s": []}).astype({"q": "int64", "rep": "int64"})

    found = pairs.applyInPandas(best, "q long, rep long, s double").groupBy("q", "rep").agg(F.max("s").alias("s"))
    # the merge; SPARE more than needed, as the last bits of a matrix product depend on its blocks
    found = found.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("s"), "rep"))).where(F.col("r") <= k + 1 + SPARE).select("q", "rep")
    # exact scores in a fixed order of addition, on original vectors, then ids of equal vectors
    a, b = index.select(F.col("rep").alias("q"), F.col("vec").alias("qvec")), index.select("rep", "vec", "ids")
    scored = found.join(a.hint("merge"), "q").join(b.hint("merge"), "rep")
    dot = F.aggregate(F.zip_with("qvec", "vec", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = scored.select("q", "qvec", dot.alias("score"), F.explode("ids").alias("vec_id"))
    top = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    ranked = scored.withColumn("r", top).where(F.col("r") <= k + 1).groupBy("q", "qvec").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("hits"))
    queries = rows.where(is_query).select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    own = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    return queries.join(ranked.hint("merge"), "qvec").select("query_id", F.posexplode(own).alias("p", "h")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "h.vec_id", "h.score")
