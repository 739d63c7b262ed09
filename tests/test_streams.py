"""Streams give what their batch twins give."""

from __future__ import annotations

import datetime
import os
import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillspark.operators import prepare as D
from quillspark.sources.corpus import read_chunks, store_chunks
from quillspark.streaming import events as S
from quillspark.streaming import stateful as SF


def slices(spark, sf_dir, tmp_path, n=4):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts")
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = e.count()
    numbered = e.withColumn("r", F.row_number().over(__import__("pyspark").sql.Window.orderBy("ts", "event_id")))
    for i in range(n):
        numbered.where((F.col("r") > i * rows // n) & (F.col("r") <= (i + 1) * rows // n)).drop("r").coalesce(1).write.parquet(str(tmp_path / "in" / f"part{i}"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    return e, stream


def drain(spark, stream, name, mode, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted(map(repr, spark.table(name).collect()))


def test_windows_and_quota(spark, sf_dir, tmp_path):
    e, s = slices(spark, sf_dir, tmp_path)
    for name, f in (("w", lambda d: S.rate_limit_windows(d, "event_type", "ts", "6 hours", 4)), ("q", lambda d: S.quota_use(d, "user_id", "ts", 5))):
        assert drain(spark, f(s), name, "complete", tmp_path) == sorted(map(repr, f(e).collect()))


@pytest.fixture
def rocksdb(spark):
    names = (SF.ROCKSDB[0], "spark.sql.shuffle.partitions")
    was = [spark.conf.get(n) for n in names]
    for n, x in zip(names, (SF.ROCKSDB[1], "2"), strict=True):
        spark.conf.set(n, x)
    yield
    for n, x in zip(names, was, strict=True):
        spark.conf.set(n, x)


FAR = datetime.datetime(2030, 1, 1)


def shuffled(spark, rows, schema, tmp_path, end, batches=5, seed=1):
    """A stream of rows in a random order that strays by up to a fifth of them, and at last ``end`` (far later), which
    moves the watermark past all others; and the same rows as a table."""
    r = random.Random(seed)
    rows = sorted(rows, key=lambda x: x[1])
    mixed = [x for _, x in sorted(enumerate(rows), key=lambda p: p[0] + r.random() * len(rows) / batches)]
    size = -(-len(mixed) // batches)
    for i in range(0, len(mixed), size):
        spark.createDataFrame(mixed[i : i + size], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i:06d}"))
    spark.createDataFrame([end], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "z"))
    for i, p in enumerate(sorted((tmp_path / "in").iterdir())):  # files are taken by the time of their last change
        for f in p.glob("*.parquet"):
            os.utime(f, (1e9 + i, 1e9 + i))
    table = spark.createDataFrame(rows, schema)
    return table, spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def requests(n=300, keys=4, seed=2):
    r = random.Random(seed)
    at = datetime.datetime(2024, 1, 1)
    return [(r.choice([*"abcd"[:keys], None]), at + datetime.timedelta(seconds=r.randrange(6 * 3600), microseconds=r.choice([0, 0, 1, 999_999])), i, round(r.expovariate(0.1), 2)) for i in range(n)]


def results(df):
    return sorted(repr(r) for r in df.collect() if r["key" if "key" in df.columns else "k"] != "zz")


def test_anchored_and_repeats(spark, tmp_path, rocksdb):
    table, s = shuffled(spark, requests(), "k string, ts timestamp, i long, v double", tmp_path, ("zz", FAR, 0, 0.0))
    for name, batch, stream in (
        ("a", lambda d: S.rate_limit_anchored(d, "k", "ts", 1800.0, 3), lambda d: S.rate_limit_anchored_stream(d, "k", "ts", 1800.0, 3, "3 hours")),
        ("r", lambda d: S.repeat_queries(d, F.col("k"), "ts", 900.0), lambda d: S.repeat_queries_stream(d, F.col("k"), "ts", 900.0, watermark="3 hours")),
        ("x", lambda d: S.repeat_queries(d, F.col("k"), "ts", 900.0, False), lambda d: S.repeat_queries_stream(d, F.col("k"), "ts", 900.0, False, "3 hours")),
    ):
        drain(spark, stream(s), name, "append", tmp_path)
        got, want = results(spark.table(name)), results(batch(table))
        assert got == want and len(want) == 300


def plain_anchored(times, seconds, limit):
    begin, n, out = None, 0, []
    for t in times:
        if begin is None or (t - begin).total_seconds() >= seconds:
            begin, n = t, 0
        ok = n < limit
        n += ok
        out.append((t, ok, limit - n, 0.0 if ok else seconds - (t - begin).total_seconds()))
    return out


def test_batch_by_brute_force(spark):
    rows = requests(400, 3, 5)
    table = spark.createDataFrame(rows, "k string, ts timestamp, i long, v double").repartition(4)
    by = defaultdict(list)
    for k, t, _, _ in rows:
        by[k].append(t)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")  # state goes from batch to batch
    try:
        got = sorted(((r["key"], r["ts"], r["decision"], r["remaining"], round(r["retry_after"], 6)) for r in S.rate_limit_anchored(table, "k", "ts", 1000.0, 2).collect()), key=repr)
        assert got == sorted(((k, t, ok, left, round(wait, 6)) for k, ts in by.items() for t, ok, left, wait in plain_anchored(sorted(ts), 1000.0, 2)), key=repr)
        for inclusive in (True, False):
            want = []
            for k, ts in by.items():
                stored = None
                for t in sorted(ts):
                    age = None if stored is None else (t - stored).total_seconds()
                    hit = age is not None and (age <= 600 if inclusive else age < 600)
                    stored = stored if hit else t
                    want.append((k, t, hit))
            assert sorted(map(tuple, S.repeat_queries(table, F.col("k"), "ts", 600.0, inclusive).collect()), key=repr) == sorted(want, key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert S.rate_limit_anchored(table.where("false"), "k", "ts", 1.0, 1).count() == 0


def test_idle_keys_leave_the_state(spark, tmp_path, rocksdb):
    """Only the last row's key is left once the watermark has passed all windows; rows behind the watermark are dropped."""
    rows = requests(120)
    _, s = shuffled(spark, rows, "k string, ts timestamp, i long, v double", tmp_path, ("zz", FAR, 0, 0.0))


    def run():
        q = S.rate_limit_anchored_stream(s, "k", "ts", 600.0, 3, "3 hours").writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "idle")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run() == 120
    held = spark.read.format("statestore").option("path", str(tmp_path / "idle")).option("stateVarName", "held").load()
    assert held.count() == 0
    waiting = spark.read.format("statestore").option("path", str(tmp_path / "idle")).option("stateVarName", "waiting").load()
    assert waiting.count() == 1  # the far one's
    spark.createDataFrame([("a", datetime.datetime(2024, 1, 1), -5, 0.0)], "k string, ts timestamp, i long, v double").write.parquet(str(tmp_path / "in" / "late"))
    assert run() == 120


def test_audit_feed(spark, tmp_path, rocksdb):
    """A feed of plain new values gives what two snapshots give, change by change."""
    r = random.Random(7)
    at = datetime.datetime(2024, 1, 1)
    rows = [(r.choice("abcde"), at + datetime.timedelta(seconds=r.randrange(20_000)), i, r.choice([True, True, False, None]), r.random() < 0.2) for i in range(200)]
    schema = "k string, ts timestamp, i long, active boolean, gone boolean"
    table, s = shuffled(spark, rows, schema, tmp_path, ("zz", FAR, 0, True, False))
    args = ("k", "ts", "i", "active", "gone")
    drain(spark, S.audit_feed_stream(s, *args, "3 hours"), "feed", "append", tmp_path)
    got = results(spark.table("feed"))
    assert got == results(S.audit_feed(table, *args)) and len(got) > 50
    held, want = {}, []
    for k, t, i, active, gone in sorted(rows, key=lambda x: (x[1], x[2])):
        before, held = dict(held), {**held, k: bool(active)}
        if gone:
            held.pop(k)
        snaps = [spark_free_audit(before, held)]
        want += [(k, t, i, a) for x, a in snaps[0] if x == k]
    assert got == sorted(repr(Row(key=k, ts=t, tie=i, action=a)) for k, t, i, a in want)


def spark_free_audit(before, after):
    for k in before.keys() | after.keys():
        if k not in before:
            yield k, "insert"
        elif k not in after:
            yield k, "delete"
        elif before[k] and not after[k]:
            yield k, "revoke"


def test_ranked():
    r, held = random.Random(3), []
    x = SF.Ranked()
    x.WIDE = 4
    for step in range(3000):
        if held and r.random() < 0.45:
            v = r.choice(held)
            held.remove(v)
            x.take(v)
        else:
            v = float(r.randrange(40))
            held.append(v)
            x.add(v)
        want = sorted(held)
        assert [x.at(i) for i in range(0, len(want), 7)] == want[::7]
        assert all(len(c) <= 8 for c in x.chunks)


def test_caches_slo_and_audit(spark, sf_dir, tmp_path):
    e, s = slices(spark, sf_dir, tmp_path)
    live = lambda d: S.cache_evictions(d, "user_id", "ts", "1 day", 5)
    q = live(s).writeStream.format("memory").queryName("live").outputMode("complete").option("checkpointLocation", str(tmp_path / "live")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got, want = ({r.start: r.live for r in d.collect()} for d in (spark.table("live"), live(e)))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 0.02 * want[k] + 1 for k in want)
    slo = lambda d: S.windowed_slo(d, "ts", "6 hours", "value", F.col("event_type") == "error", 50.0, 20.0)
    assert drain(spark, slo(s), "slo", "complete", tmp_path) == sorted(map(repr, slo(e).collect()))
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    feed = lambda d: S.audit_stream(d.select(F.col("event_id").alias("key"), op.alias("op"), (F.col("event_id") % 2 == 0).alias("was_active"), (F.col("event_id") % 3 == 0).alias("now_active")))
    assert drain(spark, feed(s), "audit", "append", tmp_path) == sorted(map(repr, feed(e).collect()))


def test_rolling_latency(spark, sf_dir, tmp_path, rocksdb):
    table, s = shuffled(spark, requests(400), "k string, ts timestamp, i long, v double", tmp_path, ("zz", FAR, 0, 0.0))
    rows = lambda d: {r["i"]: (r["k"], r["p50"], r["p95"], r["p99"], r["mean"]) for r in d.collect() if r["k"] != "zz"}
    same = lambda a, b: a.keys() == b.keys() and all(a[k][:4] == b[k][:4] and a[k][4] == pytest.approx(b[k][4]) for k in a)
    by = defaultdict(list)
    for k, t, i, v in requests(400):
        by[k].append((t, i, v))
    for n in (1, 5, 100):
        want = {}
        for k, x in by.items():
            x = sorted(x)
            for j in range(len(x)):
                last = sorted(v for _, _, v in x[max(0, j - n + 1) : j + 1])
                want[x[j][1]] = (k, *(last[min(int(len(last) * p), len(last) - 1)] for p in (0.5, 0.95, 0.99)), sum(last) / len(last))
        a, b = (rows(S.rolling_latency(table, "k", "ts", "i", "v", n, size)) for size in (7, 20_000))
        assert same(a, want) and same(b, want)  # however a key's samples are cut
        if n != 5:
            continue
        q = S.rolling_latency_stream(s, "k", "ts", "i", "v", n, "3 hours", 3600 * 24 * 365 * 10).writeStream.format("memory").queryName(f"l{n}").outputMode("append").option("checkpointLocation", str(tmp_path / f"l{n}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert same(rows(spark.table(f"l{n}")), want)


def test_rolling_latency_of_many():
    """Ten thousand samples in the window cost little more a row than a hundred."""
    v = np.random.default_rng(1).random(30_000)
    took = []
    for n in (100, 10_000):
        t = time.process_time()
        mean, _, p95, _ = SF.rolled([], v, n)
        took.append(time.process_time() - t)
        last = np.sort(v[-n:])
        assert p95[-1] == last[int(n * 0.95)] and mean[-1] == pytest.approx(last.mean())
    assert took[1] < 8 * took[0] + 1


def test_index_refresh(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Z]{3,}"), F.lit(0)))
    for k in range(2):
        s = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "docs"))
        S.index_refresh(s, found, "doc_id", str(tmp_path / "index"), str(tmp_path / f"i{k}")).awaitTermination(120)
    want = docs.select("doc_id", F.explode(found).alias("code"))
    got = read_chunks(spark, str(tmp_path / "index")).select("doc_id", "code")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_batch_run_again(spark, tmp_path):
    """A batch that is run again with the same name leaves each row once, also after a part of it was written."""
    rows = spark.createDataFrame([(i, f"c{j}") for i in range(40) for j in range(3)], "doc_id long, content string")
    path = str(tmp_path / "s")
    store_chunks(rows.where("doc_id < 20"), path, ["doc_id"], "x-0")
    store_chunks(rows.where("doc_id >= 20 AND content = 'c0'"), path, ["doc_id"], "x-1")  # only some rows came through
    store_chunks(rows.where("doc_id >= 20"), path, ["doc_id"], "x-1")
    store_chunks(rows, path, ["doc_id"], "y-0")
    assert sorted(map(tuple, read_chunks(spark, path).collect())) == sorted(map(tuple, rows.collect()))


def test_semantic_ingest_once(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit(1).alias("page"), "text")
    docs.repartition(3).write.parquet(str(tmp_path / "d"))
    chunk = lambda p: D.semantic_chunks(p, "doc_id", "page", "text", r"\n")
    for k in range(2):
        s = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "d"))
        S.ingest_stream(s, chunk, str(tmp_path / "sc"), "doc_id", str(tmp_path / f"sc{k}")).awaitTermination(120)
    got, want = read_chunks(spark, str(tmp_path / "sc")).select("doc_id", "chunk_no", "content"), chunk(docs).select("doc_id", "chunk_no", "content")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_ingest_once(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages.repartition(3).write.parquet(str(tmp_path / "pages"))
    chunk = lambda p: D.window_chunks(p, "html", ["page_id"])
    for k in range(2):  # run again with a new checkpoint: nothing is added twice
        s = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "pages"))
        S.ingest_stream(s, chunk, str(tmp_path / "chunks"), "page_id", str(tmp_path / f"c{k}")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == chunk(pages).count()


def test_stored_documents_are_not_chunked_again(spark, tmp_path):
    """Each document of two batches that overlap is chunked once."""
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string")
    n = spark.sparkContext.accumulator(0)

    def chunk(p):
        def run(batches):
            for b in batches:
                n.add(b.num_rows)
                yield b

        return p.mapInArrow(run, "doc_id long, text string")

    path = "file://" + str(tmp_path / "once")
    S.ingest_batch(pages.where("doc_id % 3 > 0"), chunk, path, "doc_id", "a-0")
    S.ingest_batch(pages, chunk, path, "doc_id", "a-1")
    assert n.value == 30
    S.ingest_batch(pages, chunk, path, "doc_id", "a-1")
    assert read_chunks(spark, path).groupBy("doc_id").agg(F.count("*").alias("n")).where("n = 1").count() == 30
