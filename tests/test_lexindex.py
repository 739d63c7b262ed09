"""The saved index: top k with bounds against scoring every pair, folders read, changed documents, the document filter."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.operators import lexindex as L


def tok(text):
    return [t for t in re.split(r"[\W_]+", (text or "").lower()) if t]


def made(n, seed, words=300):
    r = random.Random(seed)
    return [(i, f"d{i % 17}", " ".join(f"w{min(int(r.paretovariate(0.6)), words)}" for _ in range(r.choice([0, 3, 20, 20, 60, 150])))) for i in range(n)]


def scores(chunks, queries):
    """Okapi BM25 of every pair with a common term, mapped to s / (s + 1)."""
    bags = {c: Counter(t) for c, _, x in chunks if (t := tok(x))}
    n, mean = len(bags), sum(sum(b.values()) for b in bags.values()) / max(len(bags), 1)
    df = Counter(t for b in bags.values() for t in b)
    out = {}
    for q, text in queries:
        for c, b in bags.items():
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for t in set(tok(text)) if t in b)
            if s > 0:
                out[q, c] = s / (s + 1)
    return out


def best(pairs, k):
    by = defaultdict(list)
    for (q, c), s in pairs.items():
        by[q].append((-s, c))
    return {(q, c): (r, -s) for q, x in by.items() for r, (s, c) in enumerate(sorted(x)[:k], 1)}


def same(got, want, digits=9):
    """Equal ranks and scores; scores that differ in the last bits may change places."""
    assert len(got) == len(want)
    a, b = (sorted((q, r, round(s, digits)) for (q, _), (r, s) in x.items()) for x in (got, want))
    assert a == b
    floor = {q: min(s for (p, _), (_, s) in want.items() if p == q) for q, _ in want}
    for (q, c), (_, s) in got.items():
        assert (q, c) in want or abs(s - floor[q]) < 1e-9


def collected(df):
    return {(r["query_id"], r["chunk_id"]): (r["rank"], r["combined_score"]) for r in df.collect()}


@pytest.fixture(scope="module")
def chunks():
    return made(1500, 1)


@pytest.fixture(scope="module")
def queries():
    return [(100 + i, x) for i, _, x in made(30, 2)] + [(500, "neverseen w1"), (501, "neverseen"), (502, "")]


@pytest.fixture(scope="module")
def saved(spark, chunks, tmp_path_factory):
    return L.write_index(chunk_table(spark, chunks), str(tmp_path_factory.mktemp("index") / "a"), "c", "t", "d", most=40)


def chunk_table(spark, rows):
    return spark.createDataFrame(rows, "c long, d string, t string").repartition(3)


def query_table(spark, rows):
    return spark.createDataFrame(rows, "query_id long, t string")


def test_top_k(spark, saved, chunks, queries):
    want = scores(chunks, queries)
    for k in (1, 7):
        same(collected(L.search_index(saved, query_table(spark, queries), "t", L.Scoring(k))), best(want, k))
    every = L.segment_hits(saved, query_table(spark, queries), "t", L.Scoring(None))
    got = {(r["query_id"], r["chunk_id"]): r["bm25_score"] for r in every.collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)


def test_only_the_best_leave_a_task(spark, saved, chunks, queries, monkeypatch):
    n = L.index_size(saved).first()
    assert n["segments"] >= 3 * 12 > 2 * L.FIRST_SHARE  # so a first share of the segments sets the floor for the others
    hits = L.segment_hits(saved, query_table(spark, queries), "t", L.Scoring(5)).count()
    pairs = len(scores(chunks, queries))
    assert hits <= 5 * len(queries) * n["segments"] and hits < pairs / 5
    monkeypatch.setattr(L, "FIRST_SHARE", n["segments"])
    alone = L.segment_hits(saved, query_table(spark, queries), "t", L.Scoring(5)).count()
    assert hits < alone / 2  # the floor of the first share keeps more than half of the others' at home


def test_scoring_touches_less(saved):
    """Beside a strong term the blocks of a weak one aren't all opened."""
    import numpy as np

    n = 4000
    at = np.arange(n, dtype=np.int32)
    weak = (at, np.ones(n, int), np.ones(-(-n // L.BLOCK), int), np.full(-(-n // L.BLOCK), 10))
    strong = (at[::500], np.full(8, 9), np.full(1, 9), np.full(1, 10))
    s = L.Segment(at.astype(np.int64), np.full(n, 10), [], np.ones(n, bool), {"weak": weak, "strong": strong})
    found, sums, _, _ = s.best(L.Query(1, [("weak", 0.01), ("strong", 5.0)], (1.0, 0.0), None, 0.0), L.Scoring(3), 10.0, None)
    assert sorted(found.tolist()) == [0, 500, 1000] and (sums > 5).all()


def test_blocks_of_queries(spark, saved, chunks, queries, monkeypatch):
    monkeypatch.setattr(L, "QUERY_ROWS", 4)
    same(collected(L.search_index(saved, query_table(spark, queries), "t", L.Scoring(3))), best(scores(chunks, queries), 3))


def test_all_terms(spark, saved, chunks):
    asked = [(1, "w1 w2"), (2, "w1 w1 w5 w9"), (3, "w1 neverseen"), (4, ""), (5, "w7")]
    bags = {c: set(tok(x)) for c, _, x in chunks}
    want = {(q, c) for q, x in asked if tok(x) for c, b in bags.items() if set(tok(x)) <= b}
    assert {tuple(r) for r in L.match_queries(saved, query_table(spark, asked), "t").collect()} == want


def test_hybrid_and_filter(spark, saved, chunks, queries):
    r = random.Random(3)
    near = {(q, c): round(r.random(), 3) for q, _ in queries for c in r.sample(range(1600), 60)}  # some chunks aren't in the index
    rows = [(q, x, 0.1 * (q % 11), 1 - 0.1 * (q % 11), None if q % 2 else ["d3", "d5", "nowhere"]) for q, x in queries]
    table = spark.createDataFrame(rows, "query_id long, t string, w_lexical double, w_vector double, documents array<string>")
    vectors = spark.createDataFrame([(q, c, s, f"d{c % 17}") for (q, c), s in near.items()], "query_id long, chunk_id long, vector_score double, document_id string")
    lexical, fused = scores(chunks, queries), {}
    for q, _, wl, wv, only in rows:
        for c in range(1600):
            s = wl * lexical.get((q, c), 0) + wv * near.get((q, c), 0)
            if s > 0 and (only is None or f"d{c % 17}" in only):
                fused[q, c] = s
    same(collected(L.search_index(saved, table, "t", L.Scoring(8), vectors)), best(fused, 8))
    # without the filter's column, chunks that aren't in the index can't be in a document
    got = L.search_index(saved, table, "t", L.Scoring(8), vectors.drop("document_id"))
    assert got.where("query_id % 2 = 0 AND chunk_id >= 1500").count() == 0 < got.where("chunk_id >= 1500").count()


def scans(spark, df):
    """Partitions read by the scans of an executed plan."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(p.plan())
        else:
            if name.startswith("Scan parquet"):
                m = p.metrics()
                out.append(m.apply("numPartitions").value() if m.contains("numPartitions") else None)
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return out


def test_reads_only_the_folders_of_its_terms(spark, saved):
    terms = spark.createDataFrame([("w1",), ("w2",), ("w30",)], "term string")
    folders = {r["bucket"] for r in terms.select(L._bucket("term", saved.buckets).alias("bucket")).collect()}
    found = L.matching(saved, terms)
    read = [n for n in scans(spark, found) if n is not None]
    assert read and max(read) <= len(folders) < 10 < saved.rows.select("bucket").distinct().count()
    assert {r["term"] for r in found.collect()} == {"w1", "w2", "w30"}


def test_changed_documents(spark, tmp_path, queries):
    rows, path = made(300, 5), str(tmp_path / "i")
    index = L.write_index(chunk_table(spark, rows), path, "c", "t", "d", most=30)
    state = list(rows)
    for step in range(2):
        docs = {f"d{step}", f"d{step + 5}"}
        new = [(1000 * (step + 1) + i, f"d{step}", x) for i, _, x in made(40, 20 + step)]
        gone = spark.createDataFrame([(f"d{step + 5}",), ("unknown",)], "d string")
        for _ in range(2 - step):  # a generation can be written again
            index = L.refresh_index(spark, path, chunk_table(spark, new), "c", "t", "d", gone, generation=step + 1)
        state = [x for x in state if x[1] not in docs] + new
        same(collected(L.search_index(index, query_table(spark, queries), "t", L.Scoring(5))), best(scores(state, queries), 5))
        n = L.index_size(index).first()
        assert n["n"] == sum(bool(tok(x)) for _, _, x in state) and abs(n["mean"] * n["n"] - sum(len(tok(x)) for _, _, x in state)) < 1e-6
    df = {r["term"]: r["df"] for r in L.frequencies(index, spark.createDataFrame([("w1",), ("w2",), ("w9",)], "term string")).collect()}
    assert df == {t: sum(t in tok(x) for _, _, x in state) for t in ("w1", "w2", "w9")}

    small = L.compact_index(index, str(tmp_path / "j"))
    same(collected(L.search_index(small, query_table(spark, queries), "t", L.Scoring(5))), best(scores(state, queries), 5))
    own = small.rows.where("bucket = -1").select(F.explode("chunk_ids").alias("c"))
    assert sorted(r["c"] for r in own.collect()) == sorted(c for c, _, _ in state) and small.dead.isEmpty()
    held = small.rows.where("term IS NOT NULL").agg(F.sum(F.size("at"))).first()[0]
    assert held == sum(len(set(tok(x))) for _, _, x in state)  # the old postings are gone


def test_empty_and_long(spark, tmp_path, queries):
    empty = L.write_index(chunk_table(spark, []), str(tmp_path / "e"), "c", "t")
    assert L.search_index(empty, query_table(spark, queries), "t", L.Scoring(5)).collect() == []
    rows = [(1, "a", None), (2, "a", "x " * 300_000 + "y"), (3, None, "y y"), (4, "a", "...")]
    index = L.write_index(chunk_table(spark, rows), str(tmp_path / "f"), "c", "t", "d")
    same(collected(L.search_index(index, query_table(spark, [(1, "x y")]), "t", L.Scoring(5))), best(scores(rows, [(1, "x y")]), 5))
    assert L.search_index(index, query_table(spark, []), "t", L.Scoring(5)).collect() == []
    index = L.write_index(chunk_table(spark, rows[:2]), str(tmp_path / "f"), "c", "t", "d")  # over what was there
    assert L.index_size(index).first()["n"] == 1


def test_vector_scores_of_asked_queries_alone(spark, saved, chunks, monkeypatch):
    """A segment gets the vector scores of a block's queries, and none of queries that nobody asks for."""
    monkeypatch.setattr(L, "QUERY_ROWS", 1)
    held = []
    own = L._over_segments
    monkeypatch.setattr(L, "_over_segments", lambda index, terms, segments, run, schema: held.append(segments) or own(index, terms, segments, run, schema))
    vectors = spark.createDataFrame([(q, c, 0.5) for q in range(40) for c in range(0, 60, 3)] + [(q, 10**6, 0.4) for q in range(40)], "query_id long, chunk_id long, vector_score double")
    asked = query_table(spark, [(3, "w1 w2"), (4, None), (77, "w1")])
    got = L.segment_hits(saved, asked, "t", L.Scoring(None), vectors).collect()
    assert {r.query_id for r in got if r.vector_score > 0} == {3, 4}
    assert sum(r.vector_score > 0 for r in got) == 2 * 21
    each = [{x.query_id for r in s.select("near").collect() for x in r.near or []} for s in held if "near" in s.columns]
    assert set().union(*each) == {3, 4} and max(map(len, each)) < 3


def test_a_segment_holds_no_batch_of_texts(spark, tmp_path):
    """Until it is full, a segment keeps ids and codes of words: a word that comes again takes four bytes."""
    import pyarrow as pa

    rows = [(i, f"d{i}", "longwordlongwordlongword " * 200) for i in range(3000)]
    b = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([tok(r[2]) for r in rows])], names=["chunk_id", "document", "ts"])
    before, size = pa.total_allocated_bytes(), b.nbytes
    part = L.Part.of(b.slice(100, 2000))
    assert pa.total_allocated_bytes() - before < size / 4
    assert part.ids.to_pylist() == list(range(100, 2100)) and part.documents[0].as_py() == "d100" and part.length.tolist() == [200] * 2000
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    x = L.write_index(chunk_table(spark, rows[:50]), str(tmp_path / "x"), "c", "t", "d")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1024
    assert x.rows.where("term IS NOT NULL").selectExpr("sum(aggregate(tf, 0, (s, v) -> s + v)) AS n").first().n == 50 * 200
