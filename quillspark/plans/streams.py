"""Batch twins of the streaming operators (T) over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.plans.corpus import SEMANTIC_SQL, new_folder, semantic, semantic_pages
from quillspark.sources.corpus import read_chunks
from quillspark.sources.corpus import read_table as T
from quillspark.sources.corpus import written
from quillspark.streaming import events as S

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def at(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm").alias("start")


@query("""WITH RECURSIVE e AS (SELECT user_id || '/' || event_type AS key, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS i FROM events),
w AS (SELECT key, i, ts, ts AS since FROM e WHERE i = 1 UNION ALL SELECT e.key, e.i, e.ts, CASE WHEN epoch(e.ts) - epoch(since) >= 86400 THEN e.ts ELSE since END FROM w JOIN e ON e.key = w.key AND e.i = w.i + 1),
n AS (SELECT *, row_number() OVER (PARTITION BY key, since ORDER BY i) AS nth FROM w)
SELECT key, epoch_us(ts) AS t, nth <= 2 AS decision, greatest(2 - nth, 0)::INT AS remaining, CASE WHEN nth <= 2 THEN 0 ELSE round(86400 - (epoch_us(ts) - epoch_us(since)) / 1e6, 6) END AS retry_after FROM n""")
def t1_rate_limit_anchored(spark, d):
    r = S.rate_limit_anchored(T(spark, d, "events"), F.concat_ws("/", "user_id", "event_type"), "ts", 86_400.0, 2)
    return r.select("key", F.unix_micros("ts").alias("t"), "decision", "remaining", F.round("retry_after", 6).alias("retry_after"))


@query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, count(*) > 4 AS over FROM events GROUP BY 1, 2")
def t2_rate_limit_windows(spark, d):
    return S.rate_limit_windows(T(spark, d, "events"), "event_type", "ts", "1 hour", 4).select(at("start"), "event_type", "n", "over")


@query("SELECT event_id, count(*) OVER w AS n, count(*) OVER w > 2 AS over FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '6 hours' PRECEDING AND CURRENT ROW)")
def t2_rate_limit_sliding(spark, d):
    return S.rate_limit_sliding(T(spark, d, "events"), "user_id", "ts", 21_600, 2).select("event_id", "n", "over")


@query("""WITH RECURSIVE e AS (SELECT user_id || '/' || event_type AS key, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS i FROM events),
w AS (SELECT key, i, ts, ts AS since, false AS hit FROM e WHERE i = 1 UNION ALL SELECT e.key, e.i, e.ts, CASE WHEN epoch(e.ts) - epoch(since) > 43200 THEN e.ts ELSE since END, epoch(e.ts) - epoch(since) <= 43200 FROM w JOIN e ON e.key = w.key AND e.i = w.i + 1)
SELECT key, epoch_us(ts) AS t, hit FROM w""")
def t3_repeat_queries(spark, d):
    key = F.concat_ws("/", "user_id", "event_type")
    return S.repeat_queries(T(spark, d, "events"), key, "ts", 43_200.0).select("key", F.unix_micros("ts").alias("t"), "hit")


@query("SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d %H:%M') AS start, count(DISTINCT user_id) AS live, greatest(count(DISTINCT user_id) - 100, 0)::BIGINT AS evicted FROM events GROUP BY 1")
def t4_cache_evictions(spark, d):
    return S.cache_evictions(T(spark, d, "events"), "user_id", "ts", "1 day", 100).select(at("start"), "live", "evicted")


@query("""WITH e AS (SELECT event_type, event_id, list_sort(list(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) AS a FROM events WHERE value IS NOT NULL)
SELECT event_type, event_id, round(list_sum(list_transform(a, lambda x: x::DECIMAL(18, 6))) / len(a), 6) AS mean, a[least(floor(len(a) * 0.5), len(a) - 1)::INT + 1] AS p50, a[least(floor(len(a) * 0.95), len(a) - 1)::INT + 1] AS p95, a[least(floor(len(a) * 0.99), len(a) - 1)::INT + 1] AS p99 FROM e""")
def t5_rolling_latency(spark, d):
    return S.rolling_latency(T(spark, d, "events"), "event_type", "ts", "event_id", "value").withColumn("mean", F.round("mean", 6))


@query("""SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n, quantile_disc(value, 0.95) AS p95, round(100 * avg((event_type = 'error')::INT), 6) AS error_percent, quantile_disc(value, 0.95) > 50 AS slow, 100 * avg((event_type = 'error')::INT) > 20 AS failing FROM events GROUP BY 1""")
def t6_windowed_slo(spark, d):
    s = S.windowed_slo(T(spark, d, "events"), "ts", "6 hours", "value", F.col("event_type") == "error", 50.0, 20.0)
    return s.select(at("start"), "n", "p95", F.round("error_percent", 6).alias("error_percent"), "slow", "failing")


@query("""SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(value) AS n, round(avg(value) * count(value), 2) AS total_ms, quantile_disc(value, 0.95) AS p95, avg(value) > 50 AS slow FROM events GROUP BY 1, 2""")
def t6_component_means(spark, d):
    c = S.component_means(T(spark, d, "events"), "ts", "1 day", "event_type", "value", 50.0)
    return c.select(at("start"), "event_type", "n", F.round(F.col("mean_ms") * F.col("n"), 2).alias("total_ms"), "p95", "slow")


@query("""WITH e AS (SELECT event_type, value FROM events WHERE value IS NOT NULL), q AS (SELECT event_type, count(*) AS n, round(sum(value), 2) AS total_ms FROM e GROUP BY 1) SELECT event_type, n, total_ms, true AS p95_within FROM q""")
def t6_merged_latencies(spark, d):
    """Statistics of all days from the sketches of each, and whether P95 lies within a hundredth of its place."""
    e = T(spark, d, "events")
    m = S.merged_latencies(written(S.latency_sketches(e, "ts", "1 day", ["event_type"], "value")), ["event_type"], [0.95])
    j = e.where("value IS NOT NULL").join(m.hint("broadcast"), "event_type").groupBy("event_type", "n", "mean_ms")  # a row for each type
    under, upto = F.avg((F.col("value") < F.col("p95")).cast("int")), F.avg((F.col("value") <= F.col("p95")).cast("int"))
    return j.agg(((under <= 0.96) & (upto >= 0.94)).alias("p95_within")).select("event_type", "n", F.round(F.col("mean_ms") * F.col("n"), 2).alias("total_ms"), "p95_within")


@query(f"WITH x AS (WITH {SEMANTIC_SQL}" + """) SELECT doc_id, kind, count(*) AS chunks, sum(chars)::BIGINT AS chars FROM x GROUP BY 1, 2""")
def t7_ingest(spark, d):
    """The work of the ingest stream on two batches of documents that overlap: semantic chunks, each document once."""
    path, pages = new_folder(spark), semantic_pages(spark, d)
    chunk = lambda p: semantic(p).withColumn("chars", F.length("content")).select("doc_id", "block_no", "chunk_no", "kind", "chars")
    S.ingest_batch(pages.where("doc_id % 3 > 0"), chunk, path, "doc_id", "a-0")
    S.ingest_batch(pages, chunk, path, "doc_id", "a-1")
    return read_chunks(spark, path).groupBy("doc_id", "kind").agg(F.count("*").alias("chunks"), F.sum("chars").alias("chars"))


@query("SELECT user_id, strftime(date_trunc('month', ts), '%Y-%m') AS period, count(*) AS used, count(*) > 60 AS over FROM events GROUP BY 1, 2")
def t8_quota_use(spark, d):
    return S.quota_use(T(spark, d, "events"), "user_id", "ts", 60).select("user_id", F.date_format("period", "yyyy-MM").alias("period"), "used", "over")


@query("SELECT event_id AS key, CASE WHEN event_type = 'signup' THEN 'insert' WHEN event_type = 'error' THEN 'delete' ELSE 'revoke' END AS action FROM events WHERE event_type IN ('signup', 'error') OR (event_id % 2 = 0 AND event_id % 3 > 0)")
def t9_audit_stream(spark, d):
    e = T(spark, d, "events")
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    return S.audit_stream(e.select(F.col("event_id").alias("key"), op.alias("op"), (F.col("event_id") % 2 == 0).alias("was_active"), (F.col("event_id") % 3 == 0).alias("now_active")))


@query("""WITH f AS (SELECT user_id::VARCHAR AS key, epoch_us(ts) AS t, event_id AS tie, event_type = 'error' AS gone, event_id % 3 > 0 AS active FROM events),
p AS (SELECT *, lag(gone) OVER w AS was_gone, lag(active) OVER w AS was_active FROM f WINDOW w AS (PARTITION BY key ORDER BY t, tie)),
a AS (SELECT key, t, tie, CASE WHEN gone AND NOT coalesce(was_gone, true) THEN 'delete' WHEN NOT gone AND coalesce(was_gone, true) THEN 'insert' WHEN NOT gone AND was_active AND NOT active THEN 'revoke' END AS action FROM p)
SELECT * FROM a WHERE action IS NOT NULL""")
def t9_audit_feed(spark, d):
    f = T(spark, d, "events").select("user_id", "ts", "event_id", (F.col("event_id") % 3 > 0).alias("active"), (F.col("event_type") == "error").alias("gone"))
    return S.audit_feed(f, "user_id", "ts", "event_id", "active", "gone").select("key", F.unix_micros("ts").alias("t"), "tie", "action")


@query(r"SELECT DISTINCT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '\b[A-Z]{3,}\b')) AS code FROM documents")
def t10_index_pairs(spark, d):
    from quillspark.operators.extract import codes

    c = F.array_distinct(codes(F.col("text"), [("(?-i)" + r"\b[A-Z]{3,}\b", 0)]))
    path, docs = new_folder(spark), T(spark, d, "documents")
    S.index_batch(docs.where("doc_id % 2 = 0"), c, "doc_id", path, "a-0")
    S.index_batch(docs, c, "doc_id", path, "a-1")
    return read_chunks(spark, path)
