"""Query-log queries (Q) over the conversations' user turns."""

from __future__ import annotations


from pyspark.sql import functions as F

from quillspark.operators import queries as Q
from quillspark.sources.corpus import read_table

QUERIES, SQL = {}, {}
WORDS = ["tion", "th", "en"]
CAT = {"numbers": [(r"\b\d{2,}\b", 0)], "capitals": [(r"\b[A-Z]{2}\b", 0)]}
BAD = [r"ignore\s+all", r"stion\s+the", "ündel"]
INTENT = {"lookup": [r"\bthe\b", r"\bof\b"], "comparison": [r"\band\b", "vs"], "synthesis": ["tion"], "list": [r"\ball\b"], "explanation": ["how", "why"], "verification": ["is"]}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def log(spark, d):
    return read_table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")


K = ["conv_id", "turn"]
LOG = "q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user')"
BAD_SQL = "|".join(BAD)


@query(rf"""WITH {LOG}, t AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM q),
r AS (SELECT *, CASE WHEN text IS NULL THEN 'not a string' WHEN length(t) < 3 THEN 'too short' WHEN length(t) > 300 THEN 'too long' WHEN regexp_matches(t, '{BAD_SQL}', 'i') THEN 'invalid pattern' END AS reason FROM t)
SELECT conv_id, turn, reason, CASE WHEN reason IS NULL THEN regexp_replace(t, '\s+', ' ', 'g') END AS cleaned FROM r""")
def q1_validate_queries(spark, d):
    return Q.validate_queries(log(spark, d), "text", most=300, injections=BAD).select(*K, "reason", "cleaned")


@query(rf"WITH {LOG} SELECT conv_id, turn, regexp_replace(regexp_replace(text, '\bthe\b', 'the TH', 'gi'), '\bund\b', 'und UN', 'gi') AS expanded FROM q")
def q2_expand_elements(spark, d):
    return log(spark, d).select(*K, Q.expand_elements(F.col("text"), {"the": "TH", "und": "UN"}).alias("expanded"))


@query(rf"WITH {LOG} SELECT conv_id, turn, concat_ws(' ', text, CASE WHEN contains(lower(text), 'tion') THEN 'ation ition' END, CASE WHEN contains(lower(text), 'keit') THEN 'heit' END) AS expanded FROM q")
def q3_expand_synonyms(spark, d):
    return log(spark, d).select(*K, Q.expand_synonyms(F.col("text"), {"tion": ["ation", "ition"], "keit": ["heit"]}).alias("expanded"))


@query(rf"""WITH {LOG}, w AS (SELECT conv_id, turn, text, regexp_split_to_array(lower(text), '[\s,;?]+') AS a FROM q)
SELECT conv_id, turn, concat_ws(' ', text, CASE WHEN list_contains(a, 'the') AND NOT contains(lower(text), 's111') THEN 'S111' END, CASE WHEN list_contains(a, 'en') AND NOT contains(lower(text), 'entire') THEN 'entire' END) AS expanded FROM w""")
def q4_expand_grades(spark, d):
    q = log(spark, d).withColumn("k", F.concat_ws("-", *K))
    return Q.expand_grades(q, "k", "text", {"the": "S111"}, {"en": "entire"}).select(*K, "expanded")


@query(rf"""WITH {LOG} SELECT conv_id, turn, concat_ws(' ', text, CASE WHEN regexp_matches(text, '\bthe\b', 'i') THEN 'pipe' END, CASE WHEN contains(lower(text), 'tion') THEN 'Requirements' END) AS enhanced FROM q""")
def q5_enhance_queries(spark, d):
    return Q.enhance_queries(log(spark, d), "text", {"the": "pipe"}, {"tion": "Requirements"}).select(*K, "enhanced")


@query(rf"""WITH {LOG}, m AS (SELECT *, (regexp_matches(text, '\b\d{{2,}}\b'))::INT + (regexp_matches(text, '\b[A-Z]{{2}}\b', 'i'))::INT AS kinds, regexp_matches(lower(text), '{"|".join(WORDS)}') AS prop,
 regexp_matches(text, '\b(?:section|clause|para(?:graph)?|subsection)\s*\d+(?:\.\d+)+', 'i') OR (regexp_matches(text, '\b(?:scope|about|says?|describes?|covers?|regarding|refers?\s+to|meaning\s+of|details?\s+of)\b', 'i') AND regexp_matches(text, '\b\d{{1,2}}\.\d+')) AS refs FROM q),
w AS (SELECT *, CASE WHEN refs OR kinds >= 2 THEN 0.7 WHEN kinds = 1 THEN 0.6 WHEN prop THEN 0.55 ELSE 0.3 END::DOUBLE AS w_lexical FROM m)
SELECT conv_id, turn, kinds AS code_kinds, (refs OR prop OR kinds > 0) AS boost, w_lexical, round(1 - w_lexical, 2) AS w_vector FROM w""")
def q6_search_weights(spark, d):
    return Q.search_weights(log(spark, d), "text", words=WORDS, catalogue=CAT).select(*K, "code_kinds", "boost", "w_lexical", "w_vector")


@query(rf"""WITH {LOG}, f AS (SELECT *, regexp_matches(text, 'compare|vs\.?|versus|differ', 'i') AS c, regexp_matches(text, 'list|all|which|what are', 'i') AS l, regexp_matches(text, 'explain|why|how does|describe', 'i') AS e,
 len(regexp_extract_all(text, '\b\d+\b')) > 1 AS s, regexp_matches(text, 'what is|yield|tensile|hardness|composition', 'i') AS p, len(regexp_split_to_array(text, '\s+')) <= 10 AS short FROM q),
k AS (SELECT *, CASE WHEN p AND NOT c AND NOT l AND short AND NOT s THEN 'simple' WHEN c OR l OR s OR e THEN 'complex' ELSE 'moderate' END AS complexity FROM f)
SELECT conv_id, turn, complexity, complexity <> 'complex' AS skip_decomposition, complexity = 'complex' AS use_parallel, CASE complexity WHEN 'simple' THEN 2000 WHEN 'moderate' THEN 4000 ELSE 8000 END AS estimated_ms FROM k""")
def q7_query_complexity(spark, d):
    return Q.query_complexity(log(spark, d), "text", r"\b\d+\b").select(*K, "complexity", "skip_decomposition", "use_parallel", "estimated_ms")


@query(rf"WITH {LOG} SELECT conv_id, turn, regexp_matches(lower(text), 'compare|difference|vs|versus|better|worse|list|all|which|what are') OR regexp_matches(text, '\band\b|\bor\b', 'i') AS needed FROM q")
def q8_needs_decomposition(spark, d):
    return log(spark, d).select(*K, Q.needs_decomposition(F.col("text")).alias("needed"))


def score_sql(k):
    base = " + ".join(f"(regexp_matches(text, '{p}', 'i'))::INT" for p in INTENT[k])
    more = {"comparison": r" + CASE WHEN len(list_distinct(list_transform(regexp_extract_all(text, '\bF\d{2}\b', 0, 'i'), lambda x: lower(x)))) >= 2 THEN 2 ELSE 0 END"}
    return f"({base}{more.get(k, '')})"


INTENT_SQL = f"""WITH {LOG}, s AS (SELECT conv_id, turn, [{", ".join(score_sql(k) for k in INTENT)}] AS sc FROM q), b AS (SELECT *, list_max(sc) AS best FROM s)
SELECT conv_id, turn, (list_value({", ".join(repr(k) for k in INTENT)}))[list_position(sc, best)] AS intent, best AS intent_score, least(best / 3.0, 1.0)::DOUBLE AS intent_confidence FROM b"""


@query(INTENT_SQL)
def q9_classify_intent(spark, d):
    return Q.classify_intent(log(spark, d), "text", INTENT, r"\bF\d{2}\b", "(?!)", "(?!)").select(*K, "intent", "intent_score", "intent_confidence")


@query(f"""WITH i AS ({INTENT_SQL}) SELECT conv_id, turn, intent, CASE intent WHEN 'lookup' THEN 0.7 WHEN 'comparison' THEN 0.5 WHEN 'synthesis' THEN 0.3 WHEN 'explanation' THEN 0.2 ELSE 0.5 END::DOUBLE AS w_lexical,
 CASE intent WHEN 'lookup' THEN 0.3 WHEN 'comparison' THEN 0.5 WHEN 'synthesis' THEN 0.7 WHEN 'explanation' THEN 0.8 ELSE 0.5 END::DOUBLE AS w_vector, intent IN ('comparison', 'synthesis') AS rerank FROM i""")
def q10_search_config(spark, d):
    return Q.search_config(q9_classify_intent(spark, d)).select(*K, "intent", "w_lexical", "w_vector", "rerank")


@query("""WITH u AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'lookup' WHEN 1 THEN 'list' ELSE 'other' END AS intent FROM conversations),
e AS (SELECT item_id, CASE item_id % 2 WHEN 0 THEN 'lookup' ELSE 'list' END AS kind FROM benchmark), t AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY item_id)::INT AS example_no FROM e)
SELECT conv_id, turn, intent, item_id, example_no FROM u JOIN t ON t.kind = CASE WHEN intent = 'other' THEN 'lookup' ELSE intent END WHERE example_no <= 2""")
def q11_few_shot(spark, d):
    q = read_table(spark, d, "conversations").select(*K, F.expr("CASE turn % 3 WHEN 0 THEN 'lookup' WHEN 1 THEN 'list' ELSE 'other' END").alias("intent"))
    e = read_table(spark, d, "benchmark").select("item_id", F.expr("CASE item_id % 2 WHEN 0 THEN 'lookup' ELSE 'list' END").alias("kind"))
    return Q.few_shot(q, "conv_id", "intent", e, "item_id").select(*K, "intent", "item_id", "example_no")


@query(rf"""WITH {LOG} SELECT conv_id, turn, CASE WHEN regexp_matches(text, '\bAPI[\s-]+(?:SPEC(?:IFICATION)?\s+)?\d{{1,2}}[A-Z]{{1,4}}\b', 'i') OR len(list_distinct(list_transform(regexp_extract_all(text, '\b(?:ASTM\s*)?A\d{{3,4}}(?:[/-]\d{{2,4}})?\b', 0, 'i'), lambda x: upper(x)))) >= 2 THEN 8 ELSE 5 END AS k FROM q""")
def q12_dynamic_topk(spark, d):
    return log(spark, d).select(*K, Q.dynamic_topk(F.col("text")).alias("k"))


@query(rf"""WITH {LOG}, n AS (SELECT conv_id, turn, regexp_replace(trim(lower(coalesce(text, ''))), '\s+', ' ', 'g') AS plain FROM q) SELECT conv_id, turn, regexp_replace(plain, '[?.!]+$', '') AS normal, md5(plain) AS key FROM n""")
def q13_normalize_query(spark, d):
    plain = Q.normalize_query(F.col("text"), False)
    return log(spark, d).select(*K, Q.normalize_query(F.col("text")).alias("normal"), F.md5(plain).alias("key"))


@query(rf"""WITH {LOG} SELECT conv_id, turn, (len(regexp_extract_all(text, '(?:section|table|clause|annex|appendix)\s+\w+', 0, 'i')) + 2 * ({" + ".join(f"(regexp_matches(text, '{p}', 'i'))::INT" for p in (r'heat\s*treat', 'mechanic', 'chemic', 'hardness', 'impact|charpy', 'scope'))}))::INT AS n FROM q""")
def q14_section_keywords(spark, d):
    return log(spark, d).select(*K, F.size(Q.section_keywords(F.col("text"))).alias("n"))


@query(rf"""WITH {LOG}, p AS (SELECT conv_id, turn, text, list_filter(regexp_split_to_array(text, '\n'), lambda x: trim(x) <> '') AS a FROM q), b AS (SELECT conv_id, turn, CASE WHEN len(a) > 0 THEN a ELSE [text] END AS a FROM p)
SELECT conv_id, turn, ceil(40.0 / len(a))::INT AS budget, unnest(range(0, len(a)))::INT AS sub_no, unnest(a) AS subquery FROM b""")
def q15_explode_subqueries(spark, d):
    q = log(spark, d).withColumn("k", F.struct(*K))
    return Q.explode_subqueries(q, "k", "text", F.split("text", "\n")).select("k.*", "budget", "sub_no", "subquery")


