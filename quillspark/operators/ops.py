"""Service metrics, alerts, quotas, usage and audit tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.functions import catalogues as cat
from quillspark.functions.text import cascade, has_any
from quillspark.operators.evaluate import percentiles


def request_percentiles(m: DataFrame, by: list[str], value: str, ps: list[float], convention: str = "offset") -> DataFrame:
    """A column for each percentile; absent ones are 0."""
    names = {f"p{round(100 * p)}": p for p in ps}
    return percentiles(m, by, value, names, convention).select(*by, *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def error_rate(m: DataFrame, by: str, failed: Column) -> DataFrame:
    """Percent of failed requests of each value, and of all (null)."""
    return m.rollup(by).agg(F.count("*").alias("n"), F.coalesce(100 * F.avg(failed.cast("int")), F.lit(0.0)).alias("percent"))


def component_breakdown(m: DataFrame, component: str, ms: str, warn: float = 0.3, critical: float = 0.7) -> DataFrame:
    """Mean time of each component, its share of their sum, flags, and the slowest."""
    g = m.groupBy(component).agg(F.floor(F.avg(ms) + 0.5).alias("mean_ms"))
    every = W.partitionBy()
    g = g.withColumn("share", F.col("mean_ms") / F.nullif(F.sum("mean_ms").over(every), F.lit(0)))
    return g.withColumn("flag", F.when(F.col("share") > critical, "warning").when(F.col("share") > warn, "bottleneck")).withColumn("slowest", F.col("mean_ms") == F.max("mean_ms").over(every))


def rate_limit_usage(m: DataFrame, kind: str, ts: str, limits: dict[str, int], as_of: Column, seconds: int = 60) -> DataFrame:
    """Calls of the last minute before a given time as a percentage of each kind's limit."""
    t = m.sparkSession.createDataFrame(list(limits.items()), f"{kind} string, allowed int")
    recent = m.where((F.col(ts) >= as_of - F.expr(f"INTERVAL {seconds} SECONDS")) & (F.col(ts) <= as_of)).groupBy(kind).agg(F.count("*").alias("calls"))
    return t.join(recent, kind, "left").na.fill(0, ["calls"]).withColumn("percent", 100 * F.col("calls") / F.col("allowed"))


#: metric, limit, severity above it; of two that fit the more severe counts.
THRESHOLDS = [("p95_ms", 10_000.0, "WARNING"), ("error_percent", 5.0, "WARNING"), ("error_percent", 10.0, "CRITICAL"), ("usage_percent", 80.0, "WARNING"), ("usage_percent", 90.0, "CRITICAL")]


def check_alerts(long: DataFrame, thresholds: list[tuple] | None = None) -> DataFrame:
    """long: scope, metric, value."""
    t = F.broadcast(long.sparkSession.createDataFrame(thresholds or THRESHOLDS, "metric string, above double, severity string"))
    j = long.join(t, "metric").where(F.col("value") > F.col("above"))
    return j.groupBy("scope", "metric", "value").agg(F.min("severity").alias("severity"))


def regression_check(base: DataFrame, current: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """base, current: metric, value. Change in percent (a base of 0 counts as 1 for the error rate)."""
    j = base.select("metric", F.col("value").alias("was")).join(current.select("metric", F.col("value").alias("now")), "metric")
    below = F.when((F.col("metric") == "error_percent") & (F.col("was") == 0), F.lit(1.0)).otherwise(F.col("was"))
    return j.withColumn("change", (F.col("now") - F.col("was")) / F.nullif(below, F.lit(0.0)) * 100).withColumn("regressed", F.coalesce(F.col("change") > tolerance, F.lit(False)))


def latency_stats(m: DataFrame, by: list[str], value: str, convention: str = "ceil") -> DataFrame:
    stats = m.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return stats.join(request_percentiles(m, by, value, [0.5, 0.95, 0.99], convention).hint("merge"), by)


def categorize_errors(message: Column, rules: list[tuple[str, list[str]]] | None = None) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return cascade([(has_any(low, ws, False), code) for code, ws in (cat.ERRORS if rules is None else rules)], "INTERNAL_ERROR")


def quota_check(quotas: DataFrame, requests: DataFrame, key: str, kinds: list[str]) -> DataFrame:
    """quotas: key, and used_K and limit_K of each kind; requests: key, kind, increment. An unknown key is an error."""
    long = None
    for k in kinds:
        one = quotas.select(key, F.lit(k).alias("kind"), F.col(f"used_{k}").alias("used"), F.col(f"limit_{k}").alias("allowed"))
        long = one if long is None else long.unionByName(one)
    j = requests.join(long, [key, "kind"], "left")
    return j.withColumn("verdict", F.when(F.col("allowed").isNull(), "unknown").when(F.col("used") + F.col("increment") <= F.col("allowed"), "allowed").otherwise("exceeded"))


def quota_usage(quotas: DataFrame, usage: DataFrame, key: str, as_of: Column) -> DataFrame:
    """quotas: key, used, period_end; usage: key, n. Past periods start anew for a month; then usage is added."""
    add = usage.groupBy(key).agg(F.sum("n").alias("add"))
    over = F.col("period_end") < as_of
    j = quotas.join(add, key, "left").na.fill(0, ["add"])
    return j.select(key, (F.when(over, 0).otherwise(F.col("used")) + F.col("add")).alias("used"), F.when(over, F.add_months(as_of.cast("date"), 1).cast("timestamp")).otherwise(F.col("period_end")).alias("period_end"))


def usage_cost(usage: DataFrame, by: list[str], ts: str, period: str, cost: str) -> DataFrame:
    return usage.groupBy(*by, F.date_trunc(period, ts).alias("period")).agg(F.count("*").alias("n"), F.sum(F.col(cost).cast("decimal(18,4)")).alias("cost"))


def audit_events(before: DataFrame, after: DataFrame, key: str, active: str) -> DataFrame:
    """Inserts, deletes and revocations (active to inactive) between two snapshots."""
    j = before.select(key, F.col(active).alias("was"), F.lit(True).alias("b_")).join(after.select(key, F.col(active).alias("now"), F.lit(True).alias("a_")), key, "full")
    kind = F.when(F.col("b_").isNull(), "insert").when(F.col("a_").isNull(), "delete").when(F.col("was") & ~F.col("now"), "revoke")
    return j.select(key, kind.alias("action")).where("action IS NOT NULL")


def tenant_scope(df: DataFrame, members: DataFrame, tenant: str, user: str, roles: list[str] | None = None) -> DataFrame:
    """Rows of the tenants of a user (members: user, tenant, role), of given roles only for administration."""
    m = members.where(F.col("user") == user)
    m = m if roles is None else m.where(F.col("role").isin(roles))
    return df.join(m.select(F.col("tenant").alias(tenant)).distinct(), tenant, "left_semi")


def clean_leads(df: DataFrame, order: str) -> DataFrame:
    """Leads with a name and a good e-mail, cut to length, the first of each address; others with a reason."""
    bad = cascade([(F.trim(F.coalesce("name", F.lit(""))) == "", "no name"), (~F.coalesce(F.col("email").rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.lit(False)), "bad email"), (F.length("email") > 254, "long email")], F.lit(None).cast("string"))
    d = df.withColumn("reason", bad).withColumn("name", F.substring("name", 1, 50))
    r = F.row_number().over(W.partitionBy(F.lower("email"), F.col("reason").isNull()).orderBy(order))
    return d.withColumn("reason", F.coalesce("reason", F.when(r > 1, "repeated email")))


def workspace_slugs(email: Column, order: Column) -> Column:
    """Local part with other characters than a-z, 0-9 as '-' (capitals too), then lower case; later ones numbered."""
    base = F.lower(F.regexp_replace(F.substring_index(email, "@", 1), r"[^a-z0-9]", "-"))
    r = F.row_number().over(W.partitionBy(base).orderBy(order))
    return F.when(r == 1, base).otherwise(F.concat(base, F.lit("-"), (r - 1).cast("string")))


def initial_quotas(workspaces: DataFrame, existing: DataFrame, key: str, as_of: Column) -> DataFrame:
    new = workspaces.select(key).distinct().join(existing.select(key), key, "left_anti")
    return new.select(key, F.lit(10).alias("queries"), F.lit(1).alias("documents"), F.lit(100).alias("api_calls"), F.add_months(as_of, 1).alias("period_end"))
