"""Cells of vectors, MinHash bands, value buckets, sequential balance, sketched percentiles, metric streams: each against a
plain computation on small tables."""

from __future__ import annotations

import datetime
import json
import math
import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import dedup as P
from quillspark.operators import evaluate as E
from quillspark.operators import search as R
from quillspark.operators import vectors as V
from quillspark.operators import verify as G
from quillspark.sources import corpus as S
from quillspark.streaming import events as T


def vector_table(spark, ids, x, key):
    return spark.createDataFrame([(int(i), None if v is None else [float(y) for y in v]) for i, v in zip(ids, x, strict=True)], f"{key} long, vec array<double>")


def nearest(q, x, ids, k, threshold, digits=None):
    u = lambda a: a / np.maximum(np.linalg.norm(a, axis=-1, keepdims=True), 1e-300)
    s = u(q) @ u(x).T
    s = s if digits is None else np.round(s, digits)
    return {(i, int(ids[j])) for i in range(len(q)) for j in sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:k] if s[i, j] > threshold}


def test_cells_give_the_same_with_less_work(spark):
    r = np.random.default_rng(1)
    middle = r.normal(size=(20, 16))
    x = np.repeat(middle, 150, axis=0) + 0.15 * r.normal(size=(3000, 16))
    x = np.round(x, 2).astype(np.float32).astype(float)
    x[5] = 0
    q = np.round(middle[:8] + 0.1 * r.normal(size=(8, 16)), 2)
    queries, chunks = vector_table(spark, range(8), q, "query_id"), vector_table(spark, [*range(3000), 9000], [*x, None], "chunk_id").repartition(2)
    cells = V.build_cells(chunks, 24)
    assert sorted(i for row in cells.collect() for i in row["ids"]) == list(range(3000))
    count = spark.sparkContext.accumulator(0)
    for k, threshold in ((10, 0.5), (10, None), (None, 0.9)):
        before = count.value
        got = {(a["query_id"], a["chunk_id"]) for a in (lambda d: (d if k is None else R.top_k(d, k, "vector_score")).collect())(V.search_cells(queries, cells, threshold, k, 6, count))}
        assert got == nearest(q, x, np.arange(3000), 3000 if k is None else k, -2 if threshold is None else threshold, 6)
        assert 0 < count.value - before < 8 * 3000 / 3
    plain = R.top_k(V.vector_scores(queries, chunks, 0.5, 10, 6), 10, "vector_score")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, R.top_k(V.search_cells(queries, cells, 0.5, 10, 6), 10, "vector_score").collect()))


def test_cells_of_odd_tables(spark, monkeypatch):
    one = vector_table(spark, [1, 2, 3], [[1, 0], [0, 0], [1, 0]], "chunk_id")
    queries = vector_table(spark, [7, 8, 9], [[1, 1], [0, 0], None], "query_id")
    got = {(r["query_id"], r["chunk_id"], r["vector_score"]) for r in R.top_k(V.search_cells(queries, V.build_cells(one), None, 2, 6), 2, "vector_score").collect()}
    assert got == {(7, 1, 0.707107), (7, 3, 0.707107), (8, 1, 0.0), (8, 2, 0.0)}  # ties go to the smaller id
    assert V.search_cells(queries, V.build_cells(one.where("false")), None, 2).count() == 0
    assert V.search_cells(queries.where("false"), V.build_cells(one), None, 2).count() == 0
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 8))
    chunks, many = vector_table(spark, range(300), x, "chunk_id"), vector_table(spark, range(50), x[:50], "query_id")
    monkeypatch.setattr(V, "QUERY_ROWS", 7)  # several blocks of queries
    for found in (V.search_cells(many, V.build_cells(chunks), 0.1, 3), V.vector_scores(many, chunks, 0.1, 3)):
        assert {(a["query_id"], a["chunk_id"]) for a in R.top_k(found, 3, "vector_score").collect()} == nearest(x[:50], x, np.arange(300), 3, 0.1)


def near_texts(n, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    out = []
    for i in range(n):
        base = [r.choice(words) for _ in range(r.choice([6, 30, 120]))]
        out.append(base)
        for _ in range(r.choice([0, 1, 2])):
            out.append([w if r.random() > 0.06 else r.choice(words) for w in base])
    return [(i, " ".join(x)) for i, x in enumerate(out)]


def test_bands_find_near_duplicates(spark):
    rows = near_texts(250, 3) + [(9001, None), (9002, ""), (9003, "same text"), (9004, "text SAME"), (9005, "x " * 50_000)]
    docs = spark.createDataFrame(rows, "id long, t string").repartition(3)
    exact, classes = P.near_duplicates(docs, "t", "id")
    near, same = P.near_duplicates(docs, "t", "id", exact=False)
    want, got = ({(r["a"], r["b"]): r["similarity"] for r in d.collect()} for d in (exact, near))
    assert len(want) > 100 and got.items() <= want.items()  # none is wrong
    assert len(got) >= 0.95 * len(want)
    assert sorted(map(tuple, classes.collect())) == sorted(map(tuple, same.collect()))
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "AS df#" not in plan  # no list of a word
    assert P.near_classes(docs, "t", "id", exact=False).count() == len(rows)
    assert P.near_duplicates(docs.where("false"), "t", "id", exact=False)[0].count() == 0


UNITS = [(r"\b(\d+(?:\.\d+)?)\s*(ksi|mm|%)", 1, 2)]


def test_grounding_by_topic(spark):
    from quillspark.plans.answers import QTY

    r = random.Random(4)
    texts = lambda n: [" ".join(r.choice(["10 the", "250.5 de", "11 %", "7 en", "12.004 the", "12.0 th", "300 ,", "nothing", "0.5 the"]) for _ in range(r.randrange(5))) for _ in range(n)]
    answers = [(i, i % 7 if i % 11 else None, t) for i, t in enumerate(texts(150))] + [(500, 99, "10 the"), (501, 1, None)]
    sources = [(i % 7, t) for i, t in enumerate(texts(40))] + [(None, "10 the"), (3, None)]
    a, s = spark.createDataFrame(answers, "answer_id long, topic int, text string"), spark.createDataFrame(sources, "topic int, text string")
    got = G.ground_by_topic(a, s, QTY)
    spread = a.select("answer_id", "topic").join(s, "topic").select("answer_id", "text")
    want = G.ground_answers(a.select("answer_id", "text"), spread, QTY).drop("ungrounded")
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect())) and got.where("grounded > 0 AND grounded < n").count() > 5


def test_value_buckets_at_their_edges(spark):
    from quillspark.plans.answers import QTY

    a = spark.createDataFrame([(i, 1, f"{x} the") for i, x in enumerate((1, 3, 5, 7))], "answer_id long, topic int, text string")
    s = spark.createDataFrame([(1, "2 the 5 the 8 the")], "topic int, text string")
    for tolerance in (0.01, 1.0, 1.0000001, 2.5):
        got = {r["answer_id"]: r["grounded"] for r in G.ground_by_topic(a, s, QTY, tolerance).collect()}
        assert got == {i: int(any(abs(x - y) < tolerance for y in (2, 5, 8))) for i, x in enumerate((1, 3, 5, 7))}


def plain_balance(final, candidates, wanted):
    rows = list(final)
    have = {d for _, _, d, _ in rows}
    if len(wanted) >= 2:
        for d in [d for d in wanted if d not in have]:
            own = sorted((-s, c) for c, x, s in candidates if x == d)
            if own:
                low = min(range(len(rows)), key=lambda i: (rows[i][3], i))
                rows[low] = (rows[low][0], own[0][1], d, -own[0][0])
    return rows


def test_balance_in_sequence(spark):
    r = random.Random(5)
    final, candidates, required, want = [], [], [], []
    for q in range(60):
        c = [(i, r.randrange(6), round(r.random(), 1)) for i in range(r.randrange(1, 25))]
        top = [(p, *x) for p, x in enumerate(sorted(((i, d, s) for i, d, s in c), key=lambda x: (-x[2], x[0]))[:3], 1)]
        wanted = r.sample(range(8), r.randrange(5))
        final += [(q, *x) for x in top]
        candidates += [(q, *x) for x in c]
        required.append((q, wanted))
        want += [(q, p, c_, d, s) for p, c_, d, s in plain_balance(top, c, wanted)]
    names = "chunk_id long, document_id int, combined_score double"
    got = R.balance_sequential(spark.createDataFrame(final, f"query_id long, place int, {names}"), spark.createDataFrame(candidates, f"query_id long, {names}"), spark.createDataFrame(required, "query_id long, documents array<int>"))
    assert sorted(map(tuple, got.drop("injected").collect())) == sorted(want)
    # one that was put in is evicted by the next: both documents can't stay in a list of one hit
    f = spark.createDataFrame([(1, 1, 10, 0, 0.9)], f"query_id long, place int, {names}")
    c = spark.createDataFrame([(1, 10, 0, 0.9), (1, 11, 1, 0.2), (1, 12, 2, 0.1)], f"query_id long, {names}")
    w = spark.createDataFrame([(1, [1, 2])], "query_id long, documents array<int>")
    assert [tuple(r) for r in R.balance_sequential(f, c, w).collect()] == [(1, 1, 12, 2, 0.1, True)]


def at_place(values, p, convention):
    n = len(values)
    place = max(math.ceil(n * p) - 1, 0) if convention == "ceil" else math.floor(n * p) if convention == "offset" else min(math.floor(n * p), n - 1)
    return sorted(values)[place] if place < n else None


@pytest.mark.parametrize("allowed", [3, 1e-6])
def test_percentiles(spark, monkeypatch, allowed):
    """A group larger than its sketch, small ones, a null one; and bounds so narrow that places lie outside."""
    monkeypatch.setattr(E, "SKETCH", 64)
    monkeypatch.setattr(E, "ALLOWED", allowed)
    r = random.Random(6)
    rows = [("hot", r.choice([r.gauss(0, 1), 0.25, 7.0])) for _ in range(5000)] + [("few", float(i % 3)) for i in range(7)] + [(None, r.random()) for _ in range(200)] + [("one", 3.0), ("none", None), ("hot", None)]
    by = defaultdict(list)
    for g, v in rows:
        if v is not None:
            by[g].append(v)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    ps = {"a": 0.0, "b": 0.5, "c": 0.95, "d": 0.999, "e": 1.0}
    for convention in ("floor", "ceil", "offset"):
        got = {x["g"]: tuple(x)[1:] for x in E.percentiles(df, ["g"], "v", ps, convention).collect()}
        assert got == {g: (len(v), *(at_place(v, p, convention) for p in ps.values())) for g, v in by.items()}
    every = E.percentiles(df, [], "v", {"m": 0.5}).collect()
    values = [v for x in by.values() for v in x]
    assert [tuple(x) for x in every] == [(len(values), at_place(values, 0.5, "floor"))]
    assert E.percentiles(df.where("false"), ["g"], "v", ps).count() == 0
    assert E.percentiles(df.where("false"), [], "v", ps).count() == 0


def test_metric_stream_and_sketches(spark, tmp_path):
    """Metric files as they come: means by window and component equal the table's; sketches of windows add up."""
    r = random.Random(7)
    at = datetime.datetime(2024, 1, 1)
    rows = [{"id": i, "run_id": 1, "component": r.choice(["llm", "search"]), "operation": "x", "duration_ms": int(r.expovariate(0.01)), "success": True, "timestamp": (at + datetime.timedelta(seconds=60 * i)).strftime("%Y-%m-%dT%H:%M:%S")} for i in range(600)]
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"m{k}.json").write_text("\n".join(map(json.dumps, rows[200 * k : 200 * k + 200])) + ("\nnot a row" if k == 1 else ""))
    table = S.read_metrics(spark, str(tmp_path / "in"), "component_metrics").where("id IS NOT NULL")
    assert table.count() == 600 and [f.name for f in table.schema] == [x.split()[0] for x in S.METRICS["component_metrics"].split(", ")] and table.where("metadata IS NULL").count() == 600
    stream = S.read_metrics(spark, str(tmp_path / "in"), "component_metrics", True, files=1).where("id IS NOT NULL")

    def drain(f, name):
        q = f(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    means = lambda d: T.component_means(d, "timestamp", "2 hours", "component", "duration_ms", 90.0)
    got, want = ({(x["start"], x["component"]): x for x in d.collect()} for d in (drain(means, "means"), means(table)))
    assert got.keys() == want.keys() and len(want) == 10
    for k, x in want.items():
        assert (got[k]["n"], got[k]["slow"]) == (x["n"], x["slow"]) and got[k]["mean_ms"] == pytest.approx(x["mean_ms"]) and got[k]["p95"] == x["p95"]
    kept = drain(lambda d: T.latency_sketches(d, "timestamp", "2 hours", ["component"], "duration_ms"), "kept")
    assert kept.count() == 10
    merged = {x["component"]: x for x in T.merged_latencies(kept, ["component"], [0.5, 0.95]).collect()}
    for c in ("llm", "search"):
        own = sorted(x["duration_ms"] for x in rows if x["component"] == c)
        assert merged[c]["n"] == len(own) and merged[c]["mean_ms"] == pytest.approx(sum(own) / len(own))
        assert own[int(0.93 * len(own))] <= merged[c]["p95"] <= own[min(int(0.97 * len(own)), len(own) - 1)]
    some = T.merged_latencies(kept.where(F.col("start") < at + datetime.timedelta(hours=4)), ["component"], [0.5])
    assert sum(x["n"] for x in some.collect()) == 240


def test_export(spark, tmp_path):
    rows = [(i, f"d{i % 3}", 10 - i, "p", [1.0, 2.0]) for i in range(10)] + [(11, None, 1, "p", [0.5])]
    df = spark.createDataFrame(rows, "id long, name string, page int, preview string, embedding array<double>").repartition(4)
    S.write_embeddings(df, str(tmp_path / "x"), "name", "page", "id")
    lines = [json.loads(x) for f in sorted((tmp_path / "x" / "embeddings").glob("part-*")) for x in f.read_text().splitlines()]
    assert [(x.get("name") or "", x["page"]) for x in lines] == sorted((x[1] or "", x[2]) for x in rows) and lines[1]["embedding"] == [1.0, 2.0]
    counts = [json.loads(x) for f in sorted((tmp_path / "x" / "counts").glob("part-*")) for x in f.read_text().splitlines()]
    assert [(x.get("name"), x["chunks"]) for x in counts] == [("d0", 4), ("d1", 3), ("d2", 3), (None, 1)]


def test_near_duplicates_in_groups(spark, monkeypatch):
    """Word sets go once to each group of pairs, not along with every pair; groups of near copies are split."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    base = [r.choice(words) for _ in range(80)]
    rows = near_texts(60, 5) + [(1000 + i, " ".join(w if r.random() > 0.04 else r.choice(words) for w in base)) for i in range(40)]
    monkeypatch.setattr(P, "HELD", 7)
    monkeypatch.setattr(P, "HELD_PAIRS", 50)
    pairs, classes = P.near_duplicates(spark.createDataFrame(rows, "id long, t string").repartition(3), "t", "id")
    sets = {i: set(t.lower().split()) for i, t in rows}
    reps = sorted({c.class_id for c in classes.collect()})
    sim = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in reps for b in reps if a < b}
    assert {(p["a"], p["b"]): p["similarity"] for p in pairs.collect()} == {k: v for k, v in sim.items() if v > 0.8}
    assert len([1 for (a, b), v in sim.items() if v > 0.8 and a >= 1000]) > 200
    assert "array_intersect" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_near_duplicates_write_little(spark, monkeypatch):
    """Sets of all sizes, near copies at every border of sizes and sketches, exact copies; no table of all word sets is written."""
    r = random.Random(12)
    rare, common = [f"r{i}" for i in range(60_000)], [f"c{i}" for i in range(700)]
    sizes = [1, 2, 3, 5, 6, 11, 30, 90, 300, 500, 520, 600, 1000, 1030, 1300]
    bases = [r.sample(common, n // 2) + r.sample(rare, n - n // 2) for n in sizes for _ in range(8)]
    texts = [" ".join(b) for b in bases]
    for b in bases:
        for share in (0.04, 0.09, 0.1, 0.11, 0.13):  # about the limit of 0.8, as a ninth of the words
            k = max(1, round(share * len(b)))
            texts.append(" ".join(b[k:] + r.sample(rare, k)))
            texts.append(" ".join(b[: -2 * k]))
    texts += [" ".join(reversed(t.split())).upper() for t in texts[:40]]
    rows, tables = list(enumerate(texts)), []
    monkeypatch.setattr(P, "written", lambda df, f=P.written: tables.append(f(df)) or tables[-1])
    for name, n in (("GROUP_WORDS", 5000), ("LOOKED_AT", 300)):
        monkeypatch.setattr(P, name, n, raising=False)
    got = {(x["a"], x["b"]): x["similarity"] for x in P.near_duplicates(spark.createDataFrame(rows, "id long, t string").repartition(4), "t", "id")[0].collect()}
    first, sets = {}, {i: frozenset(t.lower().split(" ")) for i, t in rows}
    for i in sets:
        first.setdefault(sets[i], i)
    classes = [(i, s) for s, i in first.items()]
    near = [(a, b, len(x & y) / len(x | y)) for a, x in classes for b, y in classes if a < b and 0.8 * max(len(x), len(y)) <= min(len(x), len(y))]
    assert got == {(a, b): v for a, b, v in near if v > 0.8} and len(got) > 800
    written = sum(os.path.getsize(f.removeprefix("file://").removeprefix("file:")) for t in tables for f in t.inputFiles())
    assert written < sum(map(len, texts)) / 8 and not any(k.startswith("array") for t in tables for _, k in t.dtypes)


@pytest.mark.parametrize("exact", [True, False])
def test_near_classes_count_links_of_copies(spark, monkeypatch, exact):
    """Exact copies take their class's links; no word set is written on the way."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(90)]
    texts = [" ".join(base[:-2] + [f"x{i}", f"y{i}"]) for i in range(12)]
    rows = list(enumerate([*texts, *(t.upper() for t in r.sample(texts, 5)), "", None, "alone"]))
    tables = []
    monkeypatch.setattr(P, "written", lambda df, f=P.written: tables.append(f(df)) or tables[-1])
    got = {x["id"]: (x["class_id"], x["links"]) for x in P.near_classes(spark.createDataFrame(rows, "id long, t string").repartition(3), "t", "id", exact=exact).collect()}
    first = {}
    for i, t in rows:
        first.setdefault((t or "").lower(), i)
    assert got == {i: (first[(t or "").lower()], 11 if (t or "").lower() in texts else 0) for i, t in rows}
    assert not any(k.startswith("array") for t in tables for _, k in t.dtypes)


def test_postings_without_shuffle(spark, monkeypatch):
    from quillspark.operators import search as R

    monkeypatch.setattr(R, "SLICE_TOKENS", 5)
    rows = [(1, "a b a, C"), (2, None), (3, ""), (4, "b " * 9 + "a"), (5, "c a")]
    docs = spark.createDataFrame(rows, "id long, t string").repartition(2)
    got = R.build_postings(docs, "id", "t", ["c"])
    assert "Exchange" not in got.select("term")._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobin", "").replace("REPARTITION_BY_NUM", "")
    want = {(1, "a", 2, (0, 2), 4), (1, "b", 1, (1,), 4), (4, "a", 1, (9,), 10), (4, "b", 9, tuple(range(9)), 10), (5, "a", 1, (1,), 2)}
    assert {(r.chunk_id, r.term, r.tf, tuple(r.positions), r.length) for r in got.collect()} == want
    assert R.build_postings(docs.where("false"), "id", "t", positions=False).columns == ["chunk_id", "term", "tf", "length"]


def test_cover_scores_where_chunks_lie(spark, monkeypatch):
    from quillspark.operators import search as R

    monkeypatch.setattr(R, "SLICE_TOKENS", 6)
    monkeypatch.setattr(R, "QUERY_ROWS", 2)
    docs = spark.createDataFrame([(1, "a x b a b"), (2, "a c"), (3, None), (4, "b b A"), (5, "")], "id long, t string").coalesce(1)
    queries = spark.createDataFrame([(7, "a b a"), (8, "c"), (9, "z a"), (10, ""), (11, None), (12, "B")], "q long, t string")
    got = R.cover_scores(queries, "q", "t", docs, "id", "t")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    # of chunk 1 the spans a x b, b a and a b
    want = {(7, 1): 2.5 / 3.5, (7, 4): 1 / 2, (8, 2): 1 / 2, (12, 1): 2 / 3, (12, 4): 2 / 3}
    assert {(r.query_id, r.chunk_id): r.bm25_score for r in got.collect()} == want
    assert R.cover_scores(queries.where("false"), "q", "t", docs, "id", "t").count() == 0


def test_resolved_documents_are_not_expanded(spark):
    """A list of documents is made once for each list of codes, and isn't taken apart for each query."""
    from quillspark.operators import extract as X

    index = spark.createDataFrame([("A312", [2, 1]), ("A999", [3, 2])], "code string, docs array<long>")
    q = spark.createDataFrame([(1, "yield of A312"), (2, "A312 and A999"), (3, "A999, A312"), (4, "nothing"), (None, "A312"), (6, "A111"), (1, "A999")], "k long, t string")
    got = X.resolve_documents(q, "t", "k", index)
    assert sorted((str(r.k), r.t, r.documents) for r in got.collect()) == sorted(
        [("1", "yield of A312", [1, 2]), ("2", "A312 and A999", [1, 2, 3]), ("3", "A999, A312", [1, 2, 3]), ("4", "nothing", None), ("None", "A312", [1, 2]), ("6", "A111", None), ("1", "A999", [2, 3])]
    )
    assert "explode(docs" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_answers_of_few_cases_are_not_gathered(spark, monkeypatch):
    from quillspark.operators import evaluate as E

    answers = spark.createDataFrame([(i % 3, f"ten {i} of", i % 5 == 0) for i in range(60)] + [(9, "no case", False), (None, "ten", False), (0, None, False)], "case_id int, text string, false_refusal boolean")
    cases = spark.createDataFrame([(0, ["ten"], ["7"], []), (1, ["x"], None, ["OF"]), (2, None, None, ["no"])], "case_id int, expected array<string>, forbidden array<string>, citations array<string>")
    rows = lambda: sorted((r.case_id, str(r.text), r.matched or [], r.passed) for r in E.score_patterns(answers, cases).collect())
    monkeypatch.setattr(E, "BROADCAST_CASES", 0)
    salted, plan = rows(), E.score_patterns(answers, cases)._jdf.queryExecution().executedPlan().toString()
    assert "salt_" in plan
    monkeypatch.setattr(E, "BROADCAST_CASES", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in E.score_patterns(answers, cases)._jdf.queryExecution().executedPlan().toString()
        assert rows() == salted and len(salted) == 61
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tasks_by_query_grow_with_the_pairs(spark, monkeypatch):
    """Windows by query run in as many tasks as the compared pairs ask for, whatever spark.sql.shuffle.partitions says."""
    monkeypatch.setattr(R, "TASK_PAIRS", 400)
    hits = spark.range(60 * 200).select((F.col("id") % 60).alias("query_id"), F.floor(F.col("id") / 60).alias("chunk_id"), (F.col("id") * 7919 % 1009 / 1009).alias("combined_score"))
    dealt = R.dealt_by_query(hits.withColumn("document_id", F.col("chunk_id") % 5).withColumn("page_number", F.col("chunk_id") % 3), 60 * 200)
    need = spark.range(60).select(F.col("id").alias("query_id"), F.explode(F.array(F.lit(1), F.lit(2)).cast("array<long>")).alias("document_id")).where("query_id % 2 = 0")
    balanced, pages = R.balance_documents(dealt, need, 5), R.dedup_pages(R.ranked(dealt, "combined_score"))
    assert balanced.rdd.getNumPartitions() == pages.rdd.getNumPartitions() == 30
    rows = {}
    for r in dealt.collect():
        rows.setdefault(r.query_id, []).append((-r.combined_score, r.chunk_id, r.document_id, r.page_number))
    want = set()
    for q, own in rows.items():
        own.sort()
        first = [next(x for x in own if x[2] == d) for d in (1, 2)] if q % 2 == 0 else []
        want |= {(q, x[1], x in first, i + 1) for i, x in enumerate([*sorted(first), *(x for x in own if x not in first)][:5])}
    assert {(r.query_id, r.chunk_id, r.reserved, r.place) for r in balanced.collect()} == want
    best = {(q, x[1], i + 1) for q, own in rows.items() for i, x in enumerate(own) if x[2:] not in {y[2:] for y in own[:i]}}
    assert {(r.query_id, r.chunk_id, r.place) for r in pages.collect()} == best
