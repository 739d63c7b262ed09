"""Feedback, operations and relationship queries (F, O, G) over events, orders, customers and the part graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import feedback as B
from quillspark.operators import graph as G
from quillspark.operators import ops as O
from quillspark.sources.corpus import read_table as T

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


FB = """fb AS (SELECT conv_id, turn, coalesce(text, '') AS response, CASE conv_id % 5 WHEN 0 THEN 'correct' WHEN 1 THEN 'partial' WHEN 2 THEN 'incorrect' WHEN 3 THEN 'good' END AS rating,
 CASE turn % 6 WHEN 0 THEN 'false_refusal' WHEN 1 THEN 'wrong_source' WHEN 2 THEN 'wrong_data' WHEN 3 THEN 'missing_info' END AS issue_type, conv_id * 7 % 100 AS grounding, conv_id * 11 % 100 AS retrieval, CASE WHEN conv_id % 4 > 0 THEN conv_id * 13 % 100 END AS overall FROM conversations)"""


def fb(spark, d):
    return T(spark, d, "conversations").selectExpr(
        "conv_id", "turn", "text AS query", "coalesce(text, '') AS response", "CASE conv_id % 5 WHEN 0 THEN 'correct' WHEN 1 THEN 'partial' WHEN 2 THEN 'incorrect' WHEN 3 THEN 'good' END AS rating",
        "CASE turn % 6 WHEN 0 THEN 'false_refusal' WHEN 1 THEN 'wrong_source' WHEN 2 THEN 'wrong_data' WHEN 3 THEN 'missing_info' END AS issue_type",
        "conv_id * 7 % 100 AS grounding", "conv_id * 11 % 100 AS retrieval", "CASE WHEN conv_id % 4 > 0 THEN conv_id * 13 % 100 END AS overall",
    )


@query(f"WITH {FB} SELECT conv_id, turn, CASE WHEN trim(response) = '' THEN 'no query' WHEN rating IS NULL THEN 'no rating' WHEN rating = 'good' THEN 'bad rating' END AS reason, length(left(response, 10000))::INT AS chars FROM fb")
def f1_clean_feedback(spark, d):
    return B.clean_feedback(fb(spark, d)).select("conv_id", "turn", "reason", F.length("response").alias("chars"))


@query("SELECT event_id, event_type, value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50")
def f2_recent_feedback(spark, d):
    return B.recent_feedback(T(spark, d, "events"), "ts", "event_id", F.col("event_type") == "error").select("event_id", "event_type", "value")


@query("SELECT event_type, count(*) AS n, floor(100 * count(*) / sum(count(*)) OVER () + 0.5)::INT AS percent FROM events GROUP BY 1")
def f3_rating_summary(spark, d):
    return B.rating_summary(T(spark, d, "events"), "event_type")


@query(f"WITH {FB} SELECT issue_type, count(*) AS n FROM fb WHERE issue_type IS NOT NULL GROUP BY 1")
def f4_issue_breakdown(spark, d):
    return B.issue_breakdown(fb(spark, d), "issue_type")


@query(f"""WITH {FB} SELECT conv_id, turn, CASE WHEN issue_type = 'false_refusal' OR regexp_matches(response, 'I cannot (provide|answer|find)', 'i') THEN 'FALSE_REFUSAL' WHEN issue_type = 'wrong_source' THEN 'WRONG_SOURCE' WHEN issue_type = 'wrong_data' AND grounding > 80 THEN 'WRONG_DATA_GROUNDED'
 WHEN issue_type = 'wrong_data' THEN 'WRONG_DATA' WHEN issue_type = 'missing_info' AND retrieval < 50 THEN 'MISSING_INFO_RETRIEVAL' WHEN issue_type = 'missing_info' THEN 'MISSING_INFO' WHEN overall < 40 THEN 'LOW_CONFIDENCE' ELSE 'UNKNOWN' END AS cause FROM fb""")
def f5_root_cause(spark, d):
    c = B.root_cause(F.col("issue_type"), F.col("response"), F.col("grounding"), F.col("retrieval"), F.col("overall"))
    return fb(spark, d).select("conv_id", "turn", c.alias("cause"))


@query(f"WITH {FB} SELECT conv_id, turn, CASE WHEN length(response) > 150 THEN left(response, 150) || '...' ELSE response END AS response FROM fb WHERE rating <> 'correct'")
def f6_failure_detail(spark, d):
    return B.failure_detail(fb(spark, d).na.fill("", ["query"]), "rating", "query", "response", F.array(F.col("issue_type"))).select("conv_id", "turn", "response")


@query(f"""WITH {FB}, n AS (SELECT count(*) FILTER (issue_type = 'false_refusal' OR regexp_matches(response, 'I cannot|not (?:available|found)|unable to', 'i')) AS a, count(*) FILTER (issue_type = 'wrong_source') AS b, count(*) FILTER (retrieval < 40) AS c FROM fb)
SELECT 'anti_refusal' AS remedy, a::BIGINT AS n FROM n WHERE a > 0 UNION ALL SELECT 'document_mapping', b FROM n WHERE b > 0 UNION ALL SELECT 'retrieval', c FROM n WHERE c > 0""")
def f7_recommendations(spark, d):
    return B.recommendations(fb(spark, d), "response", "issue_type", "retrieval")


def pct(at, p):
    return f"max(value) FILTER (r = {at.format(p=p)})"


RANKED = "s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)"


@query(f"WITH {RANKED} SELECT event_type, coalesce({pct('floor(n * {p})', 0.5)}, 0) AS p50, coalesce({pct('floor(n * {p})', 0.95)}, 0) AS p95, coalesce({pct('floor(n * {p})', 0.99)}, 0) AS p99 FROM s GROUP BY 1")
def o1_request_percentiles(spark, d):
    return O.request_percentiles(T(spark, d, "events"), ["event_type"], "value", [0.5, 0.95, 0.99])


@query("SELECT user_id % 10 AS endpoint, count(*) AS n, round(100 * avg((event_type = 'error')::INT), 6) AS percent FROM events GROUP BY ROLLUP (user_id % 10)")
def o2_error_rate(spark, d):
    m = T(spark, d, "events").withColumn("endpoint", F.col("user_id") % 10)
    return O.error_rate(m, "endpoint", F.col("event_type") == "error").withColumn("percent", F.round("percent", 6))


@query("""WITH g AS (SELECT event_type, floor(avg(value) + 0.5) AS mean_ms FROM events GROUP BY 1), w AS (SELECT *, mean_ms / sum(mean_ms) OVER () AS share, mean_ms = max(mean_ms) OVER () AS slowest FROM g)
SELECT event_type, mean_ms::BIGINT AS mean_ms, round(share, 6) AS share, CASE WHEN share > 0.7 THEN 'warning' WHEN share > 0.2 THEN 'bottleneck' END AS flag, slowest FROM w""")
def o3_component_breakdown(spark, d):
    return O.component_breakdown(T(spark, d, "events"), "event_type", "value", 0.2).withColumn("share", F.round("share", 6)).withColumn("mean_ms", F.col("mean_ms").cast("long"))


@query("""WITH l(event_type, allowed) AS (VALUES ('click', 1000), ('view', 10), ('none', 10)), c AS (SELECT event_type, count(*) AS calls FROM events WHERE ts >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 3600 SECONDS AND ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1)
SELECT event_type, allowed, coalesce(calls, 0) AS calls, round(100 * coalesce(calls, 0) / allowed, 6) AS percent FROM l LEFT JOIN c USING (event_type)""")
def o4_rate_limit_usage(spark, d):
    m = T(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return O.rate_limit_usage(m, "event_type", "ts", {"click": 1000, "view": 10, "none": 10}, F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"), 3600).withColumn("percent", F.round("percent", 6))


LONG = f"""{RANKED}, lo AS (SELECT event_type AS scope, 'p95_ms' AS metric, max(value) FILTER (r = floor(n * 0.95)) AS value FROM s GROUP BY 1 UNION ALL SELECT 'user' || user_id % 10, 'error_percent', round(100 * avg((event_type = 'error')::INT), 6) FROM events GROUP BY 1)"""


def long_metrics(spark, d):
    e = T(spark, d, "events")
    p = O.request_percentiles(e, ["event_type"], "value", [0.95]).select(F.col("event_type").alias("scope"), F.lit("p95_ms").alias("metric"), F.col("p95").alias("value"))
    r = e.groupBy(F.concat(F.lit("user"), (F.col("user_id") % 10).cast("string")).alias("scope")).agg(F.round(100 * F.avg((F.col("event_type") == "error").cast("int")), 6).alias("value"))
    return p.unionByName(r.select("scope", F.lit("error_percent").alias("metric"), "value"))


@query(f"WITH {LONG} SELECT scope, metric, value, CASE WHEN metric = 'error_percent' AND value > 10 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM lo WHERE (metric = 'p95_ms' AND value > 50) OR (metric = 'error_percent' AND value > 5)")
def o5_check_alerts(spark, d):
    return O.check_alerts(long_metrics(spark, d), [("p95_ms", 50.0, "WARNING"), ("error_percent", 5.0, "WARNING"), ("error_percent", 10.0, "CRITICAL")])


@query("""WITH h AS (SELECT event_id % 2 AS half, event_type AS metric, avg(value) AS v FROM events GROUP BY 1, 2), j AS (SELECT a.metric, a.v AS was, b.v AS now FROM h a JOIN h b ON a.metric = b.metric AND a.half = 0 AND b.half = 1)
SELECT metric, round((now - was) / was * 100, 6) AS change, (now - was) / was * 100 > 10 AS regressed FROM j""")
def o6_regression_check(spark, d):
    half = lambda k: T(spark, d, "events").where(F.col("event_id") % 2 == k).groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    return O.regression_check(half(0), half(1)).select("metric", F.round("change", 6).alias("change"), "regressed")


@query(f"WITH {RANKED}, p AS (SELECT event_type, {pct('greatest(ceil(n * {p}) - 1, 0)', 0.5)} AS p50, {pct('greatest(ceil(n * {p}) - 1, 0)', 0.95)} AS p95, {pct('greatest(ceil(n * {p}) - 1, 0)', 0.99)} AS p99 FROM s GROUP BY 1) SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, p50, p95, p99 FROM events JOIN p USING (event_type) GROUP BY ALL")
def o7_latency_stats(spark, d):
    return O.latency_stats(T(spark, d, "events"), ["event_type"], "value").withColumn("mean", F.round("mean", 6))


@query("SELECT CASE WHEN regexp_matches(lower(coalesce(text, '')), '404|the and') THEN 'NOT_FOUND' WHEN contains(lower(coalesce(text, '')), 'timeout') THEN 'TIMEOUT' WHEN contains(lower(coalesce(text, '')), 'idiot') THEN 'VALIDATION_ERROR' ELSE 'INTERNAL_ERROR' END AS code, count(*) AS n FROM documents GROUP BY 1")
def o8_categorize_errors(spark, d):
    c = O.categorize_errors(F.col("text"), [("NOT_FOUND", ["404", "the and"]), ("TIMEOUT", ["timeout"]), ("VALIDATION_ERROR", ["idiot"])])
    return T(spark, d, "documents").groupBy(c.alias("code")).agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT o_custkey AS k, count(*) AS used FROM orders GROUP BY 1), q AS (SELECT c_custkey AS k, coalesce(used, 0) AS used FROM customer LEFT JOIN u ON k = c_custkey WHERE c_custkey % 10 > 0)
SELECT c_custkey AS k, CASE WHEN q.k IS NULL THEN 'unknown' WHEN used + c_custkey % 3 <= 12 THEN 'allowed' ELSE 'exceeded' END AS verdict FROM customer LEFT JOIN q ON k = c_custkey""")
def o9_quota_check(spark, d):
    used = T(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("used_queries"))
    q = T(spark, d, "customer").where("c_custkey % 10 > 0").select(F.col("c_custkey").alias("k")).join(used, "k", "left").na.fill(0).withColumn("limit_queries", F.lit(12))
    r = T(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("queries").alias("kind"), (F.col("c_custkey") % 3).alias("increment"))
    return O.quota_check(q, r, "k", ["queries"]).select("k", "verdict")


@query("""WITH u AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey AS k, (CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 5 END + coalesce(n, 0))::BIGINT AS used, CASE WHEN c_custkey % 2 = 0 THEN '2024-02-15' ELSE '2024-01-20' END AS period_end FROM customer LEFT JOIN u ON k = c_custkey""")
def o10_quota_usage(spark, d):
    q = T(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit(5).alias("used"), F.when(F.col("c_custkey") % 2 == 0, F.lit("2024-01-10")).otherwise("2024-01-20").cast("timestamp").alias("period_end"))
    u = T(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.lit(1).alias("n"))
    return O.quota_usage(q, u, "k", F.lit("2024-01-15").cast("timestamp")).select("k", "used", F.date_format("period_end", "yyyy-MM-dd").alias("period_end"))


@query("SELECT o_orderpriority, strftime(date_trunc('month', o_orderdate), '%Y-%m') AS period, count(*) AS n, sum(o_totalprice::DECIMAL(18,4))::DECIMAL(28,4) AS cost FROM orders GROUP BY 1, 2")
def o11_usage_cost(spark, d):
    u = O.usage_cost(T(spark, d, "orders"), ["o_orderpriority"], "o_orderdate", "month", "o_totalprice")
    return u.select("o_orderpriority", F.date_format("period", "yyyy-MM").alias("period"), "n", F.col("cost").cast("decimal(28,4)").alias("cost"))


@query("""WITH b AS (SELECT o_orderkey AS k, o_orderkey % 5 > 0 AS was FROM orders WHERE o_orderkey % 7 > 0), a AS (SELECT o_orderkey AS k, o_orderkey % 3 > 0 AS now FROM orders WHERE o_orderkey % 11 > 0), j AS (SELECT coalesce(b.k, a.k) AS k, CASE WHEN b.k IS NULL THEN 'insert' WHEN a.k IS NULL THEN 'delete' WHEN was AND NOT now THEN 'revoke' END AS action FROM b FULL JOIN a ON a.k = b.k)
SELECT * FROM j WHERE action IS NOT NULL""")
def o12_audit_events(spark, d):
    o = T(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return O.audit_events(o.where("k % 7 > 0").withColumn("live", F.col("k") % 5 > 0), o.where("k % 11 > 0").withColumn("live", F.col("k") % 3 > 0), "k", "live")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def o13_tenant_scope(spark, d):
    m = T(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("user"), F.col("c_custkey").alias("tenant"), F.lit("member").alias("role"))
    return O.tenant_scope(T(spark, d, "orders"), m, "o_custkey", "3").select("o_orderkey", "o_custkey")


@query("""WITH l AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 9 = 0 THEN 'bad' ELSE 'u' || c_custkey % 400 || '@x.org' END AS email FROM customer), r AS (SELECT *, CASE WHEN email = 'bad' THEN 'bad email' END AS b FROM l)
SELECT k, CASE WHEN b IS NOT NULL THEN b WHEN row_number() OVER (PARTITION BY email, b IS NULL ORDER BY k) > 1 THEN 'repeated email' END AS reason FROM r""")
def o14_clean_leads(spark, d):
    leads = T(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 9 == 0, "bad").otherwise(F.concat(F.lit("u"), (F.col("c_custkey") % 400).cast("string"), F.lit("@x.org"))).alias("email"))
    return O.clean_leads(leads, "k").select("k", "reason")


@query("""WITH e AS (SELECT c_custkey, left(c_name, 12) || '@x.org' AS email FROM customer), b AS (SELECT c_custkey, lower(regexp_replace(split_part(email, '@', 1), '[^a-z0-9]', '-', 'g')) AS s FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY c_custkey) AS r FROM b)
SELECT c_custkey, CASE WHEN r = 1 THEN s ELSE s || '-' || (r - 1) END AS slug FROM r""")
def o15_workspace_slugs(spark, d):
    c = T(spark, d, "customer").withColumn("email", F.concat(F.substring("c_name", 1, 12), F.lit("@x.org")))
    return c.select("c_custkey", O.workspace_slugs(F.col("email"), F.col("c_custkey")).alias("slug"))


@query("SELECT c_custkey, 10 AS queries, 1 AS documents, 100 AS api_calls, '2024-02-15' AS period_end FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-02-01')")
def o16_initial_quotas(spark, d):
    month = (F.col("o_orderdate") >= F.lit("1996-01-01").cast("date")) & (F.col("o_orderdate") < F.lit("1996-02-01").cast("date"))
    have = T(spark, d, "orders").where(month).select(F.col("o_custkey").alias("c_custkey")).distinct()
    q = O.initial_quotas(T(spark, d, "customer"), have, "c_custkey", F.lit("2024-01-15").cast("date"))
    return q.withColumn("period_end", F.date_format("period_end", "yyyy-MM-dd"))


def part_edges(spark, d):
    return T(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("standard")).distinct()


@query("SELECT p_partkey AS id, list_sort(list(DISTINCT l_suppkey)) AS standards FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def g1_standards_for_material(spark, d):
    return G.standards_for_material(T(spark, d, "part").select(F.col("p_partkey").alias("id")), part_edges(spark, d))


@query("""WITH m AS (SELECT p_partkey::VARCHAR AS id, p_partkey AS ord, p_brand AS name FROM part), k AS (SELECT p_brand AS key FROM part UNION SELECT (p_partkey * 2)::VARCHAR FROM part), j AS (SELECT key, 0 AS how, ord, id FROM k JOIN m ON id = key UNION ALL SELECT key, 1, ord, id FROM k JOIN m ON name = key)
SELECT key, arg_min(id, (how, ord, id)) AS id FROM j GROUP BY key""")
def g2_material_lookup(spark, d):
    p = T(spark, d, "part")
    m = p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("ord"), F.array("p_brand").alias("names"))
    k = p.select(F.col("p_brand").alias("key")).unionByName(p.select((F.col("p_partkey") * 2).cast("string").alias("key"))).distinct()
    return G.material_lookup(k, m)


@query("SELECT DISTINCT p_brand AS family, s_suppkey AS requirement FROM part JOIN supplier ON s_suppkey % 20 = p_partkey % 20")
def g3_requirements_for_family(spark, d):
    p = T(spark, d, "part").select((F.col("p_partkey") % 20).alias("m"), F.col("p_brand").alias("b")).groupBy("m").agg(F.collect_set("b").alias("families"))
    r = T(spark, d, "supplier").select(F.col("s_suppkey").alias("requirement"), (F.col("s_suppkey") % 20).alias("m")).join(p, "m")
    return G.requirements_for_family(T(spark, d, "part").select(F.col("p_brand").alias("family")).distinct(), r).select("family", "requirement").distinct()


@query("""WITH e AS (SELECT l_partkey AS key, l_suppkey AS dst, min((CASE WHEN l_linenumber = 1 THEN 0 ELSE 1 END) * 1000000000000 + l_orderkey) AS a FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) AND l_partkey IN (SELECT p_partkey FROM part) GROUP BY 1, 2) SELECT key, dst, row_number() OVER (PARTITION BY key ORDER BY a, dst)::INT AS place FROM e""")
def g4_related_standards(spark, d):
    e = T(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.when(F.col("l_linenumber") == 1, "related").otherwise("references").alias("kind"), F.col("l_orderkey").alias("ord"))
    return G.related_standards(T(spark, d, "part").select(F.col("p_partkey").alias("key")), e, T(spark, d, "supplier").select(F.col("s_suppkey").alias("key")))


@query("SELECT p_partkey, p_brand || ': PREN ' || p_size || '-' || (p_size + 5) AS guidance FROM part")
def g5_pren_guidance(spark, d):
    return T(spark, d, "part").select("p_partkey", G.pren_guidance(F.col("p_brand"), F.col("p_size"), F.col("p_size") + 5).alias("guidance"))


@query("SELECT p_partkey AS id, p_partkey % 100 + 1 AS standard, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_suppkey = p_partkey % 100 + 1) AS covered FROM part")
def g6_is_covered(spark, d):
    pairs = T(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 100 + 1).alias("standard"))
    return G.is_covered(pairs, part_edges(spark, d)).select("id", "standard", "covered")


@query("""WITH s AS (SELECT l_partkey AS id, string_agg(DISTINCT l_suppkey::VARCHAR, ', ' ORDER BY l_suppkey::VARCHAR) AS st FROM lineitem GROUP BY 1) SELECT p_partkey AS id, CASE WHEN st IS NULL THEN [p_partkey || ': ' || p_brand] ELSE [p_partkey || ': ' || p_brand, 'Covered by: ' || st] END AS insights FROM part LEFT JOIN s ON id = p_partkey""")
def g7_knowledge_insights(spark, d):
    p = T(spark, d, "part")
    m = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.lit(None).cast("int").alias("pren_low"), F.lit(None).cast("int").alias("pren_high"))
    e = part_edges(spark, d).withColumn("standard", F.col("standard").cast("string"))
    return G.knowledge_insights(p.select(F.col("p_partkey").alias("id")), m, e)
