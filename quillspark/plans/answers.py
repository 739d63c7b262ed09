"""Verification and evaluation queries (V, E): conversations as answers, benchmark texts as claims, labels as verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.operators import evaluate as E
from quillspark.operators import verify as V
from quillspark.sources.corpus import read_table as T

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


QTY = [(r"\b(\d+)\s*(%|the|th|en|de|,|\.)", 1, 2)]


def pairs(spark, d):
    """Documents as answers, the documents before them as their sources."""
    docs = T(spark, d, "documents").select("doc_id", "text")
    return docs.select(F.col("doc_id").alias("answer_id"), "text"), docs.select((F.col("doc_id") + 1).alias("answer_id"), "text")


@query(r"""WITH a AS (SELECT doc_id AS answer_id, coalesce(text, '') AS text FROM documents), s AS (SELECT doc_id + 1 AS answer_id, coalesce(text, '') AS text FROM documents),
q AS (SELECT DISTINCT answer_id, unnest(regexp_extract_all(text, '\b(\d+)\s*(%|the|th|en|de|,|\.)', 1, 'i'))::DOUBLE AS value, unnest(regexp_extract_all(text, '\b(\d+)\s*(%|the|th|en|de|,|\.)', 2, 'i')) AS unit FROM a),
sv AS (SELECT DISTINCT answer_id, unnest(regexp_extract_all(text, '\b(\d+)\s*(%|the|th|en|de|,|\.)', 1, 'i'))::DOUBLE AS sv FROM s), nb AS (SELECT DISTINCT answer_id, unnest(regexp_extract_all(text, '\b\d+(?:\.\d+)?\b')) AS shown FROM s),
e AS (SELECT q.*, EXISTS (SELECT 1 FROM sv WHERE sv.answer_id = q.answer_id AND abs(sv - value) < 0.01) OR (value > 10 AND EXISTS (SELECT 1 FROM nb WHERE nb.answer_id = q.answer_id AND shown = value::BIGINT::VARCHAR)) AS ok FROM q),
g AS (SELECT answer_id, count(*) AS n, count(*) FILTER (ok)::BIGINT AS grounded FROM e GROUP BY 1), r AS (SELECT answer_id, coalesce(n, 0) AS n, coalesce(grounded, 0) AS grounded FROM a LEFT JOIN g USING (answer_id))
SELECT *, CASE WHEN n = 0 THEN 70 ELSE floor(100 * grounded / n + 0.5)::INT END AS score, CASE WHEN n = 0 THEN true ELSE floor(100 * grounded / n + 0.5) >= 50 END AS passed FROM r""")
def v1_ground_answers(spark, d):
    return V.ground_answers(*pairs(spark, d), QTY).drop("ungrounded")


@query(r"""WITH k AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract(source, '(\d+)', 1)::INT AS topic FROM documents), a AS (SELECT doc_id AS answer_id, topic, text FROM k), s AS (SELECT (topic + 1) % 20 AS topic, text FROM k),
q AS (SELECT DISTINCT answer_id, topic, unnest(regexp_extract_all(text, '\b(\d+)\s*(%|the|th|en|de|,|\.)', 1, 'i'))::DOUBLE AS value, unnest(regexp_extract_all(text, '\b(\d+)\s*(%|the|th|en|de|,|\.)', 2, 'i')) AS unit FROM a),
sv AS (SELECT DISTINCT topic, unnest(regexp_extract_all(text, '\b(\d+)\s*(%|the|th|en|de|,|\.)', 1, 'i'))::DOUBLE AS sv FROM s), nb AS (SELECT DISTINCT topic, unnest(regexp_extract_all(text, '\b\d+(?:\.\d+)?\b')) AS shown FROM s),
e AS (SELECT q.*, EXISTS (SELECT 1 FROM sv WHERE sv.topic = q.topic AND abs(sv - value) < 0.01) OR (value > 10 AND EXISTS (SELECT 1 FROM nb WHERE nb.topic = q.topic AND shown = value::BIGINT::VARCHAR)) AS ok FROM q),
g AS (SELECT answer_id, count(*) AS n, count(*) FILTER (ok)::BIGINT AS grounded FROM e GROUP BY 1), r AS (SELECT answer_id, coalesce(n, 0) AS n, coalesce(grounded, 0) AS grounded FROM a LEFT JOIN g USING (answer_id))
SELECT *, CASE WHEN n = 0 THEN 70 ELSE floor(100 * grounded / n + 0.5)::INT END AS score, CASE WHEN n = 0 THEN true ELSE floor(100 * grounded / n + 0.5) >= 50 END AS passed FROM r""")
def v1_ground_by_topic(spark, d):
    """All documents of a source as answers, those of the source before it as what they share."""
    topic = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    k = T(spark, d, "documents").select("doc_id", "text", topic.alias("topic"))
    return V.ground_by_topic(k.withColumnRenamed("doc_id", "answer_id"), k.withColumn("topic", (F.col("topic") + 1) % 20), QTY)


@query(r"""WITH a AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, conv_id % 3 = 0 AS structured, CASE WHEN conv_id % 3 = 0 THEN 2 ELSE len(list_filter(regexp_split_to_array(t, '\n\n+'), lambda p: regexp_matches(p, '\[\d+\]'))) END::INT AS claims,
 CASE WHEN conv_id % 3 = 0 THEN t ELSE coalesce(list_filter(regexp_split_to_array(t, '\n\n+'), lambda p: regexp_matches(p, '\[\d+\]'))[1][1:200], '-') END AS first_claim, CASE WHEN conv_id % 3 = 0 THEN CASE conv_id % 2 WHEN 0 THEN 'high' ELSE 'medium' END END AS level, CASE WHEN conv_id % 3 = 0 THEN turn::DOUBLE END AS number FROM a""")
def v2_parse_structured(spark, d):
    """A third of the conversations answer in JSON, made from their text; a confidence of no known level is 'medium'."""
    t = F.coalesce("text", F.lit(""))
    claim = lambda ref, level, numbers: F.struct(t.alias("claim"), F.lit(ref).alias("source_ref"), level.alias("confidence"), numbers.alias("numerical_values"))
    number = F.array(F.struct(F.concat(F.col("turn").cast("string"), F.lit(" ksi")).alias("value")))
    claims = F.array(claim("[1]", F.when(F.col("conv_id") % 2 == 0, "HIGH").otherwise("sure"), number), claim("[2]", F.lit("low"), F.slice(number, 1, 0)))
    text = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("Here: "), F.to_json(F.struct(t.alias("answer"), claims.alias("claims"))))).otherwise(t)
    a = V.parse_structured(T(spark, d, "conversations").where("role = 'assistant'").withColumn("text", text), "text")
    return a.select("conv_id", "turn", "structured", F.size("claims").alias("claims"), F.coalesce(F.get("claims", F.lit(0))["claim"], F.lit("-")).alias("first_claim"), F.when(F.col("structured"), F.get("claims", F.lit(0))["confidence"]).alias("level"), F.when(F.col("structured"), F.get("claims", F.lit(0))["numerical_values"][0]["value"]).alias("number"))


PLAIN = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"


#: 0 to 100 for the plain quote q and the plain source s.
MATCH = """CASE WHEN contains({s}, {q}) THEN 100 WHEN length({q}) > 50 THEN CASE WHEN len(list_distinct(list_filter(string_split({q}, ' '), lambda x: length(x) > 2))) > 0
 THEN floor(100 * len(list_intersect(list_distinct(list_filter(string_split({q}, ' '), lambda x: length(x) > 2)), string_split({s}, ' '))) / len(list_distinct(list_filter(string_split({q}, ' '), lambda x: length(x) > 2))) + 0.5) ELSE 0 END
 ELSE greatest(0, floor(100.5 - 100 * levenshtein(left({q}, 200), left({s}, 200)) / length({q}))) END::INT"""


@query(f"""WITH n AS (SELECT count(*) AS n FROM benchmark), p AS (SELECT item_id, doc_id, {PLAIN.format("b.text")} AS q, {PLAIN.format("d.text")} AS s FROM documents d, n JOIN benchmark b ON d.doc_id % n = b.item_id)
SELECT item_id, doc_id, {MATCH.format(q="q", s="s")} AS score FROM p""")
def v3_quote_match(spark, d):
    """Whole benchmark texts as quotes of whole documents, each document with one of them."""
    b = T(spark, d, "benchmark").select("item_id", F.col("text").alias("q"))
    n = T(spark, d, "benchmark").agg(F.count("*").alias("n"))
    j = T(spark, d, "documents").select("doc_id", "text").crossJoin(F.broadcast(n)).withColumn("item_id", F.col("doc_id") % F.col("n")).join(b, "item_id")
    return j.select("item_id", "doc_id", V.quote_match(F.col("q"), F.col("text")).alias("score"))


def claim_results(spark, d):
    """Whole texts as quotes; of ten answers' sources some are missing, some texts are another's, some lack the number."""
    b = T(spark, d, "benchmark")
    ref = lambda n: F.format_string("[%d]", n)
    claims = b.select((F.col("item_id") % 10).alias("answer_id"), F.col("item_id").alias("claim_no"), ref(F.col("item_id") * 3 % 8).alias("source_ref"), F.col("text").alias("exact_quote"), F.when(F.col("item_id") % 3 == 0, F.array((F.col("item_id") % 4).cast("double"))).alias("numbers"))
    src = b.select((F.col("item_id") % 10).alias("answer_id"), ref(F.col("item_id") % 8).alias("ref"), F.concat("text", F.lit(" "), (F.col("item_id") % 5).cast("string")).alias("content"))
    return V.verify_claims(claims, src.groupBy("answer_id", "ref").agg(F.max("content").alias("content")))


CLAIMS = rf"""c AS (SELECT item_id % 10 AS answer_id, item_id AS claim_no, item_id * 3 % 8 AS r, text AS quote, item_id % 3 = 0 AS num, (item_id % 4)::DOUBLE AS number FROM benchmark), s AS (SELECT item_id % 10 AS answer_id, item_id % 8 AS r, max(text || ' ' || item_id % 5) AS content FROM benchmark GROUP BY 1, 2),
j AS (SELECT c.*, content, content IS NOT NULL AS found, {PLAIN.format("quote")} AS q, {PLAIN.format("content")} AS p FROM c LEFT JOIN s USING (answer_id, r)),
v AS (SELECT *, CASE WHEN NOT found THEN 0 WHEN quote = '' THEN 100 ELSE {MATCH.format(q="q", s="p")} END::INT AS quote_score, found AND (NOT num OR len(list_filter(regexp_extract_all(coalesce(content, ''), '\d+(?:\.\d+)?'), lambda x: abs(x::DOUBLE - number) < 0.01)) > 0) AS number_ok FROM j), k AS (SELECT *, found AND quote_score >= 60 AND number_ok AS verified FROM v)"""


@query(f"WITH {CLAIMS} SELECT answer_id, claim_no, found, quote_score, verified, CASE WHEN NOT found THEN 'source not found' WHEN quote_score < 60 THEN 'quote not in source' WHEN NOT number_ok THEN 'number not in source' END AS discrepancy FROM k")
def v4_verify_claims(spark, d):
    return claim_results(spark, d).select("answer_id", "claim_no", "found", "quote_score", "verified", "discrepancy")


SUMMARY = f"""{CLAIMS}, g AS (SELECT answer_id, count(*) AS claims, count(*) FILTER (verified)::BIGINT AS verified, count(*) FILTER (num)::BIGINT AS numeric, count(*) FILTER (num AND number_ok)::BIGINT AS numeric_ok FROM k GROUP BY 1),
r AS (SELECT *, CASE WHEN claims = 0 THEN 100.0 ELSE 100.0 * verified / claims END AS cr, CASE WHEN numeric = 0 THEN 100.0 ELSE 100.0 * numeric_ok / numeric END AS nr FROM g),
su AS (SELECT answer_id, claims, verified, numeric, numeric_ok, floor(0.6 * cr + 0.4 * nr + 0.5)::INT AS confidence, 0.6 * cr + 0.4 * nr >= 70 AND numeric = numeric_ok AS passed FROM r)"""


@query(f"WITH {SUMMARY} SELECT * FROM su")
def v5_verification_summary(spark, d):
    return V.verification_summary(claim_results(spark, d)).drop("claim_rate", "number_rate")


@query(f"WITH {SUMMARY} SELECT answer_id, CASE WHEN passed THEN 'return' WHEN confidence < 30 THEN 'refuse' ELSE 'regenerate' END AS action FROM su")
def v6_guardrail(spark, d):
    return V.guardrail(V.verification_summary(claim_results(spark, d))).select("answer_id", "action")


@query("""SELECT conv_id, turn, regexp_matches(coalesce(text, ''), 'the and|une le', 'i') AS refusal, NOT regexp_matches(coalesce(text, ''), 'the and|une le', 'i') AND regexp_matches(coalesce(text, ''), 'tion', 'i') AS partial_refusal, regexp_matches(coalesce(text, ''), 'the and|une le', 'i') AND conv_id % 2 = 0 AS false_refusal FROM conversations WHERE role = 'assistant'""")
def v7_refusals(spark, d):
    a = T(spark, d, "conversations").where("role = 'assistant'")
    return V.refusals(a, "text", F.col("conv_id") % 2 == 0, ["the and", "une le"], ["tion"]).select("conv_id", "turn", "refusal", "partial_refusal", "false_refusal")


@query(r"""WITH s AS (SELECT doc_id AS answer_id, coalesce(text, '') || ' [1] x [2] y [3][9]' AS text FROM documents) SELECT answer_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\[([04-9]|\d\d+)\]', '', 'g'), '\[1\]', '[a]', 'g'), '\[2\]', '[b]', 'g'), '\[3\]', '[a]', 'g'), '\[a\]', '[1]', 'g').replace('[b]', '[2]')) AS digest FROM s""")
def v8_remap_citations(spark, d):
    docs = T(spark, d, "documents").select(F.col("doc_id").alias("answer_id"), F.concat(F.coalesce("text", F.lit("")), F.lit(" [1] x [2] y [3][9]")).alias("text"))
    src = docs.select("answer_id", F.inline(F.array(*[F.struct(F.lit(n).alias("no"), F.lit(p).alias("document"), F.lit(1).alias("page")) for n, p in ((1, "a"), (2, "b"), (3, "a"))])))
    return V.remap_citations(docs, src).select("answer_id", F.md5("text").alias("digest"))


def sources(spark, d):
    o = T(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("answer_id"), F.col("o_orderkey").alias("no"), F.concat(F.lit("["), (F.col("o_orderkey") % 9).cast("string"), F.when(F.col("o_orderkey") % 11 == 0, "x").otherwise(""), F.lit("]")).alias("ref"), F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(".pdf")).alias("document"),
        (F.col("o_orderkey") % 130).cast("double").alias("page"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 50).alias("char_offset_start"), F.lit(25).alias("char_offset_end"), F.when(F.col("o_orderkey") % 4 > 0, F.lit("https://x")).alias("document_url"), F.lit("a longer preview").alias("content_preview"))


SRC = """s AS (SELECT o_custkey AS answer_id, o_orderkey AS no, '[' || o_orderkey % 9 || CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE '' END || ']' AS ref, o_orderkey % 130 AS page, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 50 END AS st, o_orderkey % 5 <> 0 AS pdf, o_orderkey % 4 > 0 AS url FROM orders),
e AS (SELECT *, (contains(ref, 'x'))::INT + (page < 1)::INT + coalesce(st >= 25, false)::INT AS errors, (NOT pdf)::INT + (page > 100)::INT + (st IS NULL)::INT + (NOT url)::INT AS warnings FROM s)"""


@query(f"WITH {SRC} SELECT no, errors::INT AS errors, warnings::INT AS warnings, errors = 0 AS valid FROM e")
def v9_validate_citations(spark, d):
    return V.validate_citations(sources(spark, d)).select("no", F.size("errors").alias("errors"), F.size("warnings").alias("warnings"), "valid")


@query(r"""SELECT doc_id, list_sort(list_filter(list_distinct(regexp_extract_all(coalesce(text, '') || '[1]', '\[\d+\]')), lambda x: x NOT IN ('[2]', '[3]'))) AS missing, false AS consistent FROM documents""")
def v10_citation_consistency(spark, d):
    c = V.citation_consistency(F.concat(F.coalesce("text", F.lit("")), F.lit("[1]")), F.array(F.lit("[2]"), F.lit("[3]")))
    return T(spark, d, "documents").select("doc_id", c.alias("c")).select("doc_id", "c.missing", "c.consistent")


@query(f"WITH {SRC} SELECT count(*) AS n, round(100 * avg((errors = 0)::INT), 6) AS rate, 100 * avg((errors = 0)::INT) >= 95 AS passed FROM e")
def v11_citation_rate(spark, d):
    return V.citation_rate(V.validate_citations(sources(spark, d))).withColumn("rate", F.round("rate", 6))


EV = "SELECT event_id, (floor(abs(coalesce(value, 0)))::BIGINT % 100)::INT AS r, (event_id * 7 % 100)::INT AS g, (event_id * 13 % 100)::INT AS c FROM events"


@query(f"""WITH e AS ({EV}), o AS (SELECT *, floor((35 * r + 25 * g + 40 * c + 50) / 100)::INT AS overall FROM e) SELECT event_id, overall, overall < 55 AS gate, CASE WHEN overall < 55 THEN CASE WHEN r < 50 THEN 'retrieval' WHEN g < 50 THEN 'grounding' WHEN c < 50 THEN 'coherence' ELSE 'general' END END AS guidance FROM o""")
def v12_confidence(spark, d):
    e = T(spark, d, "events").select("event_id", (F.floor(F.abs(F.coalesce("value", F.lit(0.0)))) % 100).alias("retrieval"), (F.col("event_id") * 7 % 100).alias("grounding"), (F.col("event_id") * 13 % 100).alias("coherence"))
    return V.confidence(e).select("event_id", "overall", "gate", "guidance")


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 0.0 ELSE greatest(0, least(100, coalesce(CASE WHEN event_id % 7 > 0 THEN value END, 50.0))) END AS score, CASE WHEN event_id % 10 = 0 THEN false ELSE greatest(0, least(100, coalesce(CASE WHEN event_id % 7 > 0 THEN value END, 50.0))) >= 60 END AS passed FROM events")
def v13_normalize_judgement(spark, d):
    j = V.normalize_judgement(F.when(F.col("event_id") % 7 > 0, F.col("value")), "retrieval", F.col("event_id") % 10)
    return T(spark, d, "events").select("event_id", j.alias("j")).select("event_id", "j.score", "j.passed")


@query("SELECT p_partkey, p_size || ' ksi [' || floor(p_size * 6.895 + 0.5)::BIGINT || ' MPa] and ' || p_size || ' ksi [x]' AS text FROM part")
def v14_standardize_units(spark, d):
    t = F.concat(F.col("p_size").cast("string"), F.lit(" ksi and "), F.col("p_size").cast("string"), F.lit(" ksi [x]"))
    return T(spark, d, "part").select("p_partkey", V.standardize_units(t).alias("text"))


@query(r"""WITH c AS (SELECT doc_id, text, list_transform(regexp_extract_all(coalesce(text, ''), '\[(\d+)\]', 1), lambda x: x::INT) AS n FROM documents) SELECT doc_id, len(list_filter(n, lambda x: x < 1 OR x > 3)) > 0 AS unknown_source FROM c""")
def v15_refinement_warnings(spark, d):
    w = V.refinement_warnings(F.coalesce("text", F.lit("")), F.lit(3))
    return T(spark, d, "documents").select("doc_id", F.array_contains(w, "unknown source cited").alias("unknown_source"))


@query(r"""WITH c AS (SELECT item_id % 25 AS answer_id, item_id AS claim_no, regexp_split_to_array(trim(lower(text)), '\s+') AS ws FROM benchmark), s AS (SELECT doc_id % 25 AS answer_id, doc_id AS source_no, lower(coalesce(text, '')) AS t FROM documents),
h AS (SELECT answer_id, claim_no, source_no, len(list_filter(ws, lambda w: length(w) > 3 AND contains(t, w))) / len(ws) AS share FROM c JOIN s USING (answer_id)), f AS (SELECT * FROM h WHERE share > 0.4 QUALIFY row_number() OVER (PARTITION BY answer_id, claim_no ORDER BY source_no) = 1)
SELECT answer_id, claim_no, source_no, round(share, 6) AS share, source_no IS NOT NULL AS supported FROM c LEFT JOIN f USING (answer_id, claim_no)""")
def v16_support_claims(spark, d):
    c = T(spark, d, "benchmark").select((F.col("item_id") % 25).alias("answer_id"), F.col("item_id").alias("claim_no"), F.col("text").alias("claim"))
    s = T(spark, d, "documents").select((F.col("doc_id") % 25).alias("answer_id"), F.col("doc_id").alias("source_no"), F.col("text").alias("content"))
    return V.support_claims(c, s, 0.4).withColumn("share", F.round("share", 6))


@query(r"""WITH b AS (SELECT item_id, coalesce(text, '') AS text, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: length(w) > 3)) AS ws FROM benchmark),
s AS (SELECT *, unnest(range(0, greatest(length(text) - 100, 0) + 1)) AS start FROM b), n AS (SELECT *, len(list_filter(ws, lambda w: contains(lower(text)[start + 1:start + 100], w)))::INT AS score FROM s)
SELECT item_id, score, start::INT AS start, text[start + 1:start + 100] AS "window" FROM n QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, start) = 1""")
def v17_best_window(spark, d):
    """The densest window of a whole text, by all of its words."""
    t = F.coalesce("text", F.lit(""))
    return T(spark, d, "benchmark").select("item_id", V.best_window(t, t).alias("w")).select("item_id", "w.*")


@query(r"""SELECT conv_id, turn, regexp_matches(coalesce(text, ''), '\[\d+\]') AS has_citation, regexp_matches(coalesce(text, ''), 'tion', 'i') AS is_refusal, regexp_matches(coalesce(text, ''), 'tion', 'i') AND turn % 4 <> 1 AS false_refusal FROM conversations WHERE role = 'assistant'""")
def v18_answer_flags(spark, d):
    a = T(spark, d, "conversations").where("role = 'assistant'")
    return V.answer_flags(a, "text", F.col("turn") % 4 == 1, ["tion"]).select("conv_id", "turn", "has_citation", "is_refusal", "false_refusal")


def scored(spark, d, variant):
    a = T(spark, d, "documents").select((F.col("doc_id") % 3).alias("case_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 13 == 0).alias("false_refusal"))
    s = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    cases = a.select("case_id").distinct().select("case_id", F.when(F.col("case_id") == 0, s("thon", r"(?<!\w)und(?!\w)")).when(F.col("case_id") == 1, s("tion", "ñ", "keit")).otherwise(s()).alias("expected"), F.when(F.col("case_id") == 1, s(r"\d{4}")).otherwise(s()).alias("forbidden"), F.when(F.col("case_id") == 0, s("THE")).otherwise(s()).alias("citations"))
    return E.score_patterns(a, cases, variant)


M = {0: ["thon", r"\bund\b"], 1: ["tion", "ñ", "keit"]}
SCORE = r"""a AS (SELECT doc_id, doc_id % 3 AS case_id, coalesce(text, '') AS text, doc_id % 13 = 0 AS fr FROM documents),
m AS (SELECT *, CASE case_id WHEN 0 THEN (regexp_matches(text, 'thon', 'i'))::INT + (regexp_matches(text, '\bund\b', 'i'))::INT WHEN 1 THEN (regexp_matches(text, 'tion', 'i'))::INT + (regexp_matches(text, 'ñ', 'i'))::INT + (regexp_matches(text, 'keit', 'i'))::INT ELSE 0 END AS hit,
 CASE case_id WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END AS n, case_id = 1 AND regexp_matches(text, '\d{4}') AS bad, case_id <> 0 OR contains(lower(text), 'the') AS cited FROM a)"""


@query(f"WITH {SCORE} SELECT doc_id, hit::INT AS matched, hit >= 0.5 * n AND NOT bad AND cited AS passed FROM m")
def e1_score_patterns(spark, d):
    return scored(spark, d, "golden").select("doc_id", F.size("matched").alias("matched"), "passed")


@query(f"WITH {SCORE} SELECT doc_id, hit >= 0.5 * n AND NOT bad AND NOT fr AS passed FROM m")
def e2_score_readiness(spark, d):
    return scored(spark, d, "readiness").select("doc_id", "passed")


@query("""WITH f AS (SELECT o_custkey AS answer_id, arg_min(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1) SELECT c_custkey AS answer_id, left(p, 1) AS code, coalesce(left(p, 1) = '1', false) AS source_ok FROM customer LEFT JOIN f ON c_custkey = answer_id""")
def e3_source_accuracy(spark, d):
    s = T(spark, d, "orders").select(F.col("o_custkey").alias("answer_id"), F.col("o_orderkey").alias("no"), F.col("o_orderpriority").alias("document"))
    e = T(spark, d, "customer").select(F.col("c_custkey").alias("answer_id"), F.lit("1").alias("expected_code"))
    return E.source_accuracy(s, e, F.substring("document", 1, 1)).select("answer_id", "code", "source_ok")


@query("""WITH g AS (SELECT l_orderkey AS k, list(DISTINCT l_quantity::DOUBLE) AS e, list(DISTINCT l_linenumber * 7.0) AS a FROM lineitem GROUP BY 1)
SELECT k, round(len(list_filter(e, lambda x: len(list_filter(a, lambda y: abs(y - x) <= x * 10 / 100)) > 0)) / len(e), 6) AS accuracy FROM g""")
def e4_numeric_accuracy(spark, d):
    g = T(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set(F.col("l_quantity").cast("double")).alias("e"), F.collect_set(F.col("l_linenumber") * 7.0).alias("a"))
    return g.select("k", F.round(E.numeric_accuracy(F.col("e"), F.col("a"), 10.0), 6).alias("accuracy"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN NOT regexp_matches(coalesce(text, ''), 'tion', 'i') ELSE regexp_matches(coalesce(text, ''), 'keit') END AS hallucinated FROM conversations")
def e5_hallucinations(spark, d):
    t = F.coalesce("text", F.lit(""))
    return T(spark, d, "conversations").select("conv_id", "turn", E.hallucination(t, F.col("turn") % 2 == 1, t.contains("keit").cast("int"), ["tion"]).alias("hallucinated"))


@query(f"WITH {SRC}, g AS (SELECT answer_id, bool_and(page >= 1)::INT AS pages, bool_and(st IS NOT NULL)::INT AS offsets FROM s GROUP BY 1) SELECT answer_id, round((pages + offsets + 1) / 3 * 100, 6) AS percent FROM g")
def e6_citation_quality(spark, d):
    return E.citation_quality(sources(spark, d)).select("answer_id", F.round("percent", 6).alias("percent"))


def systems(spark, d):
    lab = T(spark, d, "labels")
    return E.compare_systems(lab.select("doc_id", (F.col("quality") == 1).alias("passed")), lab.select("doc_id", (F.col("toxic") == 1).alias("passed")), "doc_id")


PAIR = "cs AS (SELECT doc_id, quality = 1 AS a, toxic = 1 AS b, CASE WHEN quality = 1 AND toxic = 0 THEN 'improvement' WHEN quality = 0 AND toxic = 1 THEN 'regression' WHEN quality = 1 THEN 'both correct' ELSE 'both wrong' END AS outcome FROM labels)"


@query(f"WITH {PAIR} SELECT * FROM cs")
def e7_compare_systems(spark, d):
    return systems(spark, d)


def with_more(spark, d):
    docs = T(spark, d, "documents").select("doc_id", "n_chars", "lang", "source")
    return systems(spark, d).join(docs, "doc_id").select("*", (F.col("n_chars") % 7 == 0).alias("hallucinated"), (F.col("lang") == "de").alias("refusal_case"), (F.col("n_chars") % 2 == 0).alias("refused"), (F.col("n_chars") % 100).alias("citation_percent"), F.col("n_chars").alias("latency_ms"))


@query(f"""WITH {PAIR}, r AS (SELECT cs.*, n_chars, lang FROM cs JOIN documents USING (doc_id)), s AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS rn, count(*) OVER () AS n FROM r)
SELECT count(*) AS n, 100 * avg(a::INT) AS accuracy_a, 100 * avg(b::INT) AS accuracy_b, 100 * avg((n_chars % 7 = 0)::INT) AS hallucination, count(*) FILTER (lang = 'de' AND n_chars % 2 = 0)::BIGINT AS refused, avg(n_chars % 100) AS citations, avg(n_chars) AS mean_ms,
 count(*) FILTER (outcome = 'improvement')::BIGINT AS improvement, count(*) FILTER (outcome = 'regression')::BIGINT AS regression, count(*) FILTER (outcome = 'both correct')::BIGINT AS both_correct, count(*) FILTER (outcome = 'both wrong')::BIGINT AS both_wrong,
 (SELECT max(n_chars) FROM s WHERE rn = least(floor(n * 0.95), n - 1)) AS p95_ms FROM r""")
def e8_aggregate_metrics(spark, d):
    return E.aggregate_metrics(with_more(spark, d))


@query("WITH c AS (SELECT DISTINCT source FROM documents) SELECT source, chr((64 + row_number() OVER (ORDER BY source))::INT) AS letter FROM c")
def e9_category_letters(spark, d):
    """Letters by place among the categories; the distinct categories are few, so one window orders them."""
    c = T(spark, d, "documents").select("source").distinct()
    return c.select("source", E.category_letter(F.row_number().over(W.orderBy("source"))).alias("letter"))


@query(f"""WITH {PAIR}, r AS (SELECT cs.*, lang, source FROM cs JOIN documents USING (doc_id)), g AS (SELECT lang, source, grouping(lang) AS gl, grouping(source) AS gs, count(*) AS total, count(*) FILTER (a)::BIGINT AS passed FROM r GROUP BY GROUPING SETS ((lang), (source), ()))
SELECT CASE WHEN gl = 0 THEN 'lang' WHEN gs = 0 THEN 'source' ELSE 'all' END AS dim, coalesce(lang, source) AS value, total, passed, 100 * passed / total AS percent FROM g""")
def e10_breakdown(spark, d):
    return E.breakdown(with_more(spark, d), ["lang", "source"], "a")


def percentile_sql(at):
    return f"""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(n) AS n, max(value) FILTER (r = {at}) AS percentile FROM s GROUP BY 1"""


@query(percentile_sql("least(floor(n * 0.95), n - 1)"))
def e11_percentiles_floor(spark, d):
    return E.percentile_rank(T(spark, d, "events"), ["event_type"], "value", 0.95, "floor")


@query(percentile_sql("greatest(ceil(n * 0.95) - 1, 0)"))
def e11_percentiles_ceil(spark, d):
    return E.percentile_rank(T(spark, d, "events"), ["event_type"], "value", 0.95, "ceil")


@query(percentile_sql("floor(n * 0.95)"))
def e11_percentiles_offset(spark, d):
    return E.percentile_rank(T(spark, d, "events"), ["event_type"], "value", 0.95, "offset")


def judged(spark, d):
    lab = T(spark, d, "labels").join(T(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    x = lab.select("source", (F.col("quality") == 1).alias("supported"), F.when(F.col("doc_id") % 2 == 0, F.col("toxic") == 0).alias("relevant"), F.when(F.col("source") > "src5", F.col("quality") == 1).alias("covered"), (F.col("doc_id") % 3).alias("relevancy"))
    return E.judge_metrics(x, ["source"])


JUDGE = """x AS (SELECT source, quality = 1 AS supported, CASE WHEN doc_id % 2 = 0 THEN toxic = 0 END AS relevant, CASE WHEN source > 'src5' THEN quality = 1 END AS covered, doc_id % 3 AS relevancy FROM labels JOIN documents USING (doc_id)),
jm AS (SELECT source, coalesce(avg(supported::INT), 1.0) AS faithfulness, coalesce(avg(relevant::INT), 0.0) AS "precision", avg(covered::INT) AS recall, greatest(0, least(1, coalesce(avg(relevancy), 0))) AS relevancy, 1 - coalesce(avg(supported::INT), 1.0) AS hallucination FROM x GROUP BY 1)"""


@query(f"WITH {JUDGE} SELECT * FROM jm")
def e12_judge_metrics(spark, d):
    return judged(spark, d)


@query(f"""WITH {JUDGE} SELECT source, round(CASE WHEN recall IS NULL THEN (0.3 * faithfulness + 0.3 * relevancy + 0.2 * "precision") / 0.8 ELSE 0.3 * faithfulness + 0.3 * relevancy + 0.2 * "precision" + 0.2 * recall END, 6) AS composite FROM jm""")
def e13_composite(spark, d):
    return judged(spark, d).select("source", F.round(E.composite(F.col("faithfulness"), F.col("relevancy"), F.col("precision"), F.col("recall")), 6).alias("composite"))


@query(f"""WITH {JUDGE} SELECT left(source, 4) AS category, count(*) AS n, round(avg(faithfulness), 6) AS faithfulness, round(avg(relevancy), 6) AS relevancy, round(avg("precision"), 6) AS "precision", round(avg(recall), 6) AS recall FROM jm GROUP BY ROLLUP (left(source, 4))""")
def e14_judge_summary(spark, d):
    m = E.judge_summary(judged(spark, d).withColumn("category", F.substring("source", 1, 4)), "category")
    return m.select("category", "n", *[F.round(c, 6).alias(c) for c in ("faithfulness", "relevancy", "precision", "recall")])


@query(f"""WITH {PAIR}, m AS (SELECT 100 * avg(a::INT) AS accuracy, 100 * avg(b::INT) AS hallucination, 97.0 AS citations FROM cs) SELECT round(accuracy, 1) AS accuracy, round(hallucination, 1) AS hallucination, citations, CASE WHEN accuracy >= 90 THEN 'PASS' ELSE 'FAIL' END AS verdict,
 list_filter([CASE WHEN accuracy < 90 THEN 'raise accuracy' END, CASE WHEN hallucination > 5 THEN 'lower hallucination' END], lambda x: x IS NOT NULL) AS recommendations FROM m""")
def e15_verdict(spark, d):
    m = systems(spark, d).agg((100 * F.avg(F.col("a").cast("int"))).alias("accuracy"), (100 * F.avg(F.col("b").cast("int"))).alias("hallucination"), F.lit(97.0).alias("citations"))
    return E.verdict(m)


@query(f"""WITH {PAIR}, l AS (SELECT 'accuracy' AS metric, 100 * avg(a::INT) AS value FROM cs UNION ALL SELECT 'source', 50.0 UNION ALL SELECT 'forbidden', count(*) FILTER (b)::DOUBLE FROM cs),
t AS (SELECT *, CASE metric WHEN 'accuracy' THEN value >= 75 WHEN 'source' THEN value >= 80 ELSE value <= 0 END AS met FROM l) SELECT metric, value, met, (SELECT bool_and(met) FROM t WHERE metric <> 'source') AS ready FROM t""")
def e16_readiness(spark, d):
    s = systems(spark, d)
    rows = s.agg((100 * F.avg(F.col("a").cast("int"))).alias("accuracy"), F.lit(50.0).alias("source"), F.count_if("b").cast("double").alias("forbidden"))
    return E.readiness(rows.unpivot([], ["accuracy", "source", "forbidden"], "metric", "value")).select("metric", "value", "met", "ready")


@query(f"WITH {SCORE} SELECT doc_id FROM m WHERE NOT (hit >= 0.5 * n AND NOT bad AND NOT fr)")
def e17_failures(spark, d):
    return E.failures(scored(spark, d, "readiness").withColumn("case_id", F.col("doc_id"))).select(F.col("case_id").alias("doc_id"))


@query("""WITH w(difficulty) AS (VALUES ('click'), ('view'), ('none')), g AS (SELECT event_type AS difficulty, count(*) AS n, avg((event_id % 3 = 0)::INT) AS accuracy, avg(value) AS mean_ms, avg(user_id % 5) AS sources FROM events GROUP BY 1)
SELECT difficulty, coalesce(n, 0) AS n, round(coalesce(accuracy, 0), 6) AS accuracy, round(coalesce(mean_ms, 0), 6) AS mean_ms, round(coalesce(sources, 0), 6) AS sources FROM w LEFT JOIN g USING (difficulty)""")
def e18_kpi_report(spark, d):
    r = T(spark, d, "events").select(F.col("event_type").alias("difficulty"), (F.col("event_id") % 3 == 0).alias("passed"), F.col("value").alias("latency_ms"), (F.col("user_id") % 5).alias("sources"))
    return E.kpi_report(r, ["click", "view", "none"]).select("difficulty", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "mean_ms", "sources")])


@query("""SELECT quality, count(*) FILTER (toxic = 0)::BIGINT AS "0", count(*) FILTER (toxic = 1)::BIGINT AS "1" FROM labels GROUP BY 1""")
def e19_confusion(spark, d):
    return E.confusion(T(spark, d, "labels"), "quality", "toxic", [0, 1])


@query("""SELECT doc_id, round(((contains(lower(coalesce(text, '')), 'the'))::INT + (contains(lower(coalesce(text, '')), 'une'))::INT) / 2, 6) AS share, contains(coalesce(text, ''), '7') AS number_ok, doc_id % 3 = 0 AS refusal_ok FROM documents""")
def e20_score_values(spark, d):
    a = T(spark, d, "documents").select("doc_id", F.lit(1).alias("case_id"), F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 3 > 0).alias("is_refusal"))
    c = T(spark, d, "region").where("r_regionkey = 0").select(F.lit(1).alias("case_id"), F.array(F.lit("THE"), F.lit("une")).alias("values"), F.lit(7).alias("number"), F.lit(False).alias("expect_refusal"))
    return E.score_values(a, c).select("doc_id", "share", "number_ok", "refusal_ok")


@query("""SELECT 'lang' AS dim, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'tag', t, count(*) FROM (SELECT unnest([left(source, 4), lang]) AS t FROM documents) GROUP BY 2""")
def e21_case_stats(spark, d):
    docs = T(spark, d, "documents").select("lang", "source", F.array(F.substring("source", 1, 4), F.col("lang")).alias("tags"))
    return E.case_stats(docs, ["lang", "source"], "tags")


@query("""SELECT event_type, count(*) AS n, round(100 * avg((event_id % 3 = 0)::INT), 6) AS pass_rate, round(coalesce(avg(value) FILTER (value > 0), 0), 6) AS mean_ms FROM events GROUP BY 1""")
def e22_smoke_summary(spark, d):
    r = T(spark, d, "events").select("event_type", (F.col("event_id") % 3 == 0).alias("passed"), F.col("value").alias("latency_ms"))
    return E.smoke_summary(r, ["event_type"]).select("event_type", "n", F.round("pass_rate", 6).alias("pass_rate"), F.round("mean_ms", 6).alias("mean_ms"))

