"""Streaming operators over an event stream, each with a batch twin that gives the same rows.

Event time is a TIMESTAMP column (NTZ columns are cast); watermarks bound the state. Stateful ones keep their state by
key in Spark's state store; the batch twins are windows, or one ordered pass for each key where the rule is sequential.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.functions.order import numbered
from quillspark.streaming import stateful as S


def with_time(df: DataFrame, ts: str, watermark: str = "10 minutes") -> DataFrame:
    d = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return d.withWatermark(ts, watermark) if df.isStreaming else d


def rate_limit_windows(df: DataFrame, key: str, ts: str, window: str, limit: int, slide: str | None = None) -> DataFrame:
    """Requests by key in tumbling or sliding windows, and whether they are over the limit. Batch or stream."""
    g = with_time(df, ts).groupBy(F.window(ts, window, slide) if slide else F.window(ts, window), key).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), key, "n", (F.col("n") > limit).alias("over"))


def rate_limit_sliding(df: DataFrame, key: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """Exact sliding count before and at each request (batch)."""
    t = F.col(ts).cast("timestamp").cast("double")
    w = W.partitionBy(key).orderBy(t).rangeBetween(-seconds, 0)
    return df.withColumn("n", F.count("*").over(w)).withColumn("over", F.col("n") > limit)


ANCHORED = "key string, t long, decision boolean, remaining int, retry_after double"


def _timed(out: DataFrame) -> DataFrame:
    """Times of day in place of microseconds."""
    return out.select("key", F.timestamp_micros("t").alias("ts"), *[c for c in out.columns if c not in ("key", "t")])


def rate_limit_anchored(df: DataFrame, key: Column | str, ts: str, seconds: float, limit: int) -> DataFrame:
    """Decision, remaining calls and seconds to wait for each request; batch twin of ``rate_limit_anchored_stream``."""
    return _timed(S.in_order(S.rows_of(df, F.col(key) if isinstance(key, str) else key, ts), S.anchored_limit(seconds, limit), ANCHORED))


def rate_limit_anchored_stream(df: DataFrame, key: Column | str, ts: str, seconds: float, limit: int, watermark: str = "10 minutes") -> DataFrame:
    """The same for a stream, whose rows may come out of order within the watermark. Windows that have ended leave the state."""
    rows = S.rows_of(df, F.col(key) if isinstance(key, str) else key, ts)
    return _timed(S.stream_in_order(rows, S.anchored_limit(seconds, limit), ANCHORED, "begin bigint, n bigint", watermark))


REPEATS = "key string, t long, hit boolean"


def repeat_queries(df: DataFrame, key: Column, ts: str, ttl: float, inclusive: bool = True) -> DataFrame:
    """Whether each query's key was stored at most ``ttl`` seconds ago; batch twin of ``repeat_queries_stream``."""
    return _timed(S.in_order(S.rows_of(df, key, ts), S.stored_repeats(ttl, inclusive), REPEATS))


def repeat_queries_stream(df: DataFrame, key: Column, ts: str, ttl: float, inclusive: bool = True, watermark: str = "10 minutes") -> DataFrame:
    """The same for a stream, whose rows may come out of order within the watermark. Entries that have expired leave the
    state."""
    return _timed(S.stream_in_order(S.rows_of(df, key, ts), S.stored_repeats(ttl, inclusive), REPEATS, "stored bigint", watermark))


def cache_evictions(df: DataFrame, key: str, ts: str, window: str, capacity: int) -> DataFrame:
    """Distinct keys in each window beside a cache's capacity; counted exactly in batch, approximately in a stream."""
    n = F.approx_count_distinct(key, 0.01) if df.isStreaming else F.count_distinct(key)
    g = with_time(df, ts).groupBy(F.window(ts, window)).agg(n.alias("live"))
    return g.select(F.col("window.start").alias("start"), "live", F.greatest(F.col("live") - capacity, F.lit(0)).alias("evicted"))


#: Samples of a key that one group sorts through.
SAMPLES = 20_000


def rolling_latency(df: DataFrame, by: str, ts: str, tie: str, value: str, n: int = 100, samples: int = SAMPLES) -> DataFrame:
    """Mean and percentiles of the last n samples at each event; batch twin of ``rolling_latency_stream``.

    A key's samples are numbered in order and cut into stretches; each goes to a task led by the n - 1 samples before it,
    which lie in one stretch, as a stretch has n samples at least. There the samples go in and out of a sorted structure
    one by one."""
    size = max(samples, n)
    d = df.where(F.col(value).isNotNull()).select(F.col(by).alias("by_"), F.col(ts).alias("ts_"), F.col(tie).cast("long").alias("tie_"), F.col(value).cast("double").alias("v_"))
    d = numbered(d, ["by_"], ["ts_", "tie_"])
    home, leads = F.expr(f"pos div {size}L"), F.col("pos") % size >= size - (n - 1)
    d = d.withColumn("block_", F.explode(F.when(leads, F.array(home, home + 1)).otherwise(F.array(home))))
    kind = dict(d.dtypes)["by_"]

    def stretch(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        pos, v = t.column("pos").to_numpy(), t.column("v_").to_numpy()
        lead = int(np.searchsorted(pos, t.column("block_")[0].as_py() * size))
        mean, p50, p95, p99 = S.rolled(v[:lead].tolist(), v[lead:], n)
        own = t.slice(lead)
        return pa.table({by: own.column("by_"), tie: own.column("tie_"), "mean": mean, "p50": p50, "p95": p95, "p99": p99})

    return d.groupBy("by_", "block_").applyInArrow(stretch, f"`{by}` {kind}, `{tie}` long, mean double, p50 double, p95 double, p99 double")


def rolling_latency_stream(df: DataFrame, by: str, ts: str, tie: str, value: str, n: int = 100, watermark: str = "10 minutes", idle_seconds: int | None = 86_400) -> DataFrame:
    """The same for a stream, whose rows may come out of order within the watermark: a key's state is its last n - 1
    samples, and goes when nothing has come for ``idle_seconds`` (None: it stays). Keys come as string."""
    rows = S.rows_of(df.where(F.col(value).isNotNull()), F.col(by), ts, F.col(tie), F.col(value))
    step = S.rolling_step(n, None if idle_seconds is None else 1000 * idle_seconds)
    out = S.stream_in_order(rows, step, "key string, o long, mean double, p50 double, p95 double, p99 double", "last array<double>", watermark)
    return out.withColumnsRenamed({"key": by, "o": tie})


def windowed_slo(df: DataFrame, ts: str, window: str, value: str, failed: Column, p95_above: float, errors_above: float) -> DataFrame:
    """P95 (exact in batch, approximate in a stream), error percentage and alerts by window."""
    d = with_time(df, ts)
    p95 = F.percentile_approx(value, 0.95, 10_000) if df.isStreaming else F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})")
    g = d.groupBy(F.window(ts, window)).agg(F.count("*").alias("n"), p95.alias("p95"), (100 * F.avg(failed.cast("int"))).alias("error_percent"))
    return g.select(F.col("window.start").alias("start"), "n", "p95", "error_percent", (F.col("p95") > p95_above).alias("slow"), (F.col("error_percent") > errors_above).alias("failing"))


def component_means(df: DataFrame, ts: str, window: str, component: str, ms: str, slow_above: float) -> DataFrame:
    """Samples, mean time, P95 (from a sketch in a stream) and alert of each component and window; batch or stream."""
    d = with_time(df, ts)
    p95 = F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(F.col(ms).cast("double"), F.lit(SLO_SKETCH)), F.lit(0.95)) if df.isStreaming else F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {ms})")
    g = d.groupBy(F.window(ts, window), component).agg(F.count(ms).alias("n"), F.avg(ms).alias("mean_ms"), p95.alias("p95"))
    return g.select(F.col("window.start").alias("start"), component, "n", "mean_ms", "p95", (F.col("mean_ms") > slow_above).alias("slow"))


#: Size of the sketches kept by window.
SLO_SKETCH = 4096


def latency_sketches(df: DataFrame, ts: str, window: str, by: list[str], ms: str) -> DataFrame:
    """Count, sum and a KLL sketch of the times of each group and window; batch or stream. Rows of this kind are kept and
    added up: ``merged_latencies`` gives statistics of any windows without their events."""
    g = with_time(df.where(F.col(ms).isNotNull()), ts).groupBy(F.window(ts, window), *by)
    g = g.agg(F.count("*").alias("n"), F.sum(F.col(ms).cast("double")).alias("total"), F.kll_sketch_agg_double(F.col(ms).cast("double"), F.lit(SLO_SKETCH)).alias("sketch"))
    return g.select(F.col("window.start").alias("start"), *by, "n", "total", "sketch")


def merged_latencies(sketches: DataFrame, by: list[str], ps: list[float]) -> DataFrame:
    """Count, mean and percentiles of all windows of each group, from their sketches (places off by about 2.3 in
    SLO_SKETCH of the count)."""
    g = sketches.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean_ms"), F.kll_merge_agg_double("sketch", F.lit(SLO_SKETCH)).alias("sketch"))
    return g.select(*by, "n", "mean_ms", *[F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(f"p{round(100 * p)}") for p in ps])


def quota_use(df: DataFrame, tenant: str, ts: str, limit: int) -> DataFrame:
    """Use of each tenant and month, and whether it is over the limit. Batch, or a stream in update mode."""
    d = with_time(df, ts)
    return d.groupBy(tenant, F.date_trunc("month", ts).alias("period")).agg(F.count("*").alias("used")).withColumn("over", F.col("used") > limit)


def audit_stream(changes: DataFrame) -> DataFrame:
    """Audit rows of a change feed that brings old values (key, op, was_active, now_active); stateless, batch or stream."""
    action = F.when(F.col("op") == "insert", "insert").when(F.col("op") == "delete", "delete").when(F.col("was_active") & ~F.col("now_active"), "revoke")
    return changes.select("key", action.alias("action")).where("action IS NOT NULL")


AUDIT = "key string, t long, o long, action int"


def _changes(feed: DataFrame, key: str, ts: str, tie: str, active: str, deleted: str) -> DataFrame:
    value = F.when(F.coalesce(F.col(deleted), F.lit(False)), S.DELETED).when(F.coalesce(F.col(active), F.lit(False)), S.ACTIVE).otherwise(S.INACTIVE)
    return S.rows_of(feed, F.col(key), ts, F.col(tie), value)


def _actions(out: DataFrame) -> DataFrame:
    action = F.element_at(F.array(*map(F.lit, ("insert", "delete", "revoke"))), F.when(F.col("action") > 0, F.col("action")).otherwise(1))
    return out.where("action > 0").select("key", F.timestamp_micros("t").alias("ts"), F.col("o").alias("tie"), action.alias("action"))


def audit_feed(feed: DataFrame, key: str, ts: str, tie: str, active: str, deleted: str) -> DataFrame:
    """Audit rows of a feed of plain new values: each row says that a key is active or not, or deleted. What it was before
    is the last row of its key. A null counts as not active, and as not deleted. Batch twin of ``audit_feed_stream``."""
    return _actions(S.in_order(_changes(feed, key, ts, tie, active, deleted), S.audit_step, AUDIT))


def audit_feed_stream(feed: DataFrame, key: str, ts: str, tie: str, active: str, deleted: str, watermark: str = "10 minutes") -> DataFrame:
    """The same for a stream, whose rows may come out of order within the watermark. The state is the last value of each
    key that isn't deleted."""
    return _actions(S.stream_in_order(_changes(feed, key, ts, tie, active, deleted), S.audit_step, AUDIT, "last double", watermark))


def batch_name(checkpoint: str, n: int) -> str:
    """A name that only this batch of this stream has."""
    return f"{zlib.crc32(checkpoint.encode()):08x}-{n}"


def ingest_batch(pages: DataFrame, chunk, path: str, key: str, batch: str | None = None) -> None:
    """Chunk the documents of a micro-batch that the sink doesn't have yet, and append them. For foreachBatch: a batch
    that is run again adds nothing. Documents that the sink has are left out before they are chunked, and nothing is
    chunked twice."""
    from quillspark.sources.corpus import append_chunks, not_stored

    append_chunks(chunk(not_stored(pages, path, [key], batch)), path, [key], batch)


def ingest_stream(pages: DataFrame, chunk, path: str, key: str, checkpoint: str):
    """Start a stream of pages into a chunk store; batches hold whole documents."""
    return pages.writeStream.foreachBatch(lambda b, n: ingest_batch(b, chunk, path, key, batch_name(checkpoint, n))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_batch(docs: DataFrame, codes: Column, doc: str, path: str, batch: str | None = None) -> None:
    """Add the (code, document) pairs of some documents to an index that doesn't have them."""
    from quillspark.sources.corpus import store_chunks

    store_chunks(docs.select(doc, F.explode(codes).alias("code")).distinct(), path, [doc, "code"], batch)


def index_refresh(docs: DataFrame, codes: Column, doc: str, path: str, checkpoint: str, trigger: dict | None = None):
    """Keep (code, document) pairs of all documents seen so far; readers group them by code."""
    return docs.writeStream.foreachBatch(lambda b, n: index_batch(b, codes, doc, path, batch_name(checkpoint, n))).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
