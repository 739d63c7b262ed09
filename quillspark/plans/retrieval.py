"""Retrieval and duplicates (R, P) over documents, benchmark texts as queries, and embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.operators import dedup as P
from quillspark.operators import lexindex as L
from quillspark.operators import search as R
from quillspark.sources.corpus import read_table as T
from quillspark.sources.corpus import shared_folder, written

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def index(spark, d):
    """The saved index of all documents; every tenth is said to be of one document."""
    docs = T(spark, d, "documents").withColumn("document", F.col("doc_id") % 10)
    return L.write_index(docs, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", "doc_id", "text", "document")


def asked(spark, d):
    return T(spark, d, "benchmark").withColumnRenamed("item_id", "query_id")


TOK = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
LEX = f"""dt AS (SELECT doc_id AS chunk_id, {TOK} AS ts FROM documents), po AS (SELECT chunk_id, unnest(ts) AS term, len(ts) AS length FROM dt),
pp AS (SELECT chunk_id, term, count(*) AS tf, any_value(length) AS length FROM po GROUP BY 1, 2),
qt AS (SELECT item_id AS query_id, unnest(list_distinct({TOK})) AS term FROM benchmark)"""
BM = f"""{LEX}, sz AS (SELECT count(*) AS n, avg(length) AS mean FROM (SELECT chunk_id, any_value(length) AS length FROM pp GROUP BY 1)), df AS (SELECT term, count(*) AS df FROM pp GROUP BY 1),
sc AS (SELECT query_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS s FROM qt JOIN df USING (term) CROSS JOIN sz JOIN pp USING (term) GROUP BY 1, 2),
lx AS (SELECT query_id, chunk_id, s / (s + 1) AS bm25_score FROM sc)"""


@query(f"""WITH {LEX}, ix AS (SELECT chunk_id, unnest(range(0, len(ts))) AS p, unnest(ts) AS term, len(ts) AS length FROM dt)
SELECT chunk_id, term, count(*) AS tf, any_value(length)::INT AS length, string_agg(p::VARCHAR, ',' ORDER BY p) AS positions FROM ix GROUP BY 1, 2""")
def r1_build_postings(spark, d):
    p = R.build_postings(T(spark, d, "documents"), "doc_id", "text")
    return p.select("chunk_id", "term", "tf", "length", F.array_join("positions", ",").alias("positions"))


@query(f"WITH {LEX}, nd AS (SELECT query_id, count(*) AS need FROM qt GROUP BY 1), hv AS (SELECT query_id, chunk_id, count(*) AS have FROM qt JOIN pp USING (term) GROUP BY 1, 2) SELECT query_id, chunk_id FROM hv JOIN nd USING (query_id) WHERE have = need")
def r2_match_all(spark, d):
    return L.match_queries(index(spark, d), asked(spark, d), "text")


@query(f"WITH {BM} SELECT query_id, chunk_id, round(bm25_score, 6) AS bm25_score FROM lx")
def r3_lexical_scores(spark, d):
    every = L.segment_hits(index(spark, d), asked(spark, d), "text", L.Scoring(None))
    return every.select("query_id", "chunk_id", F.round("bm25_score", 6).alias("bm25_score"))


@query(f"""WITH {LEX}, nd AS (SELECT query_id, count(*) AS need FROM qt GROUP BY 1), mp AS (SELECT query_id, chunk_id, need FROM (SELECT query_id, chunk_id, count(*) AS have FROM qt JOIN pp USING (term) GROUP BY 1, 2) JOIN nd USING (query_id) WHERE have = need),
ix AS (SELECT chunk_id, unnest(range(0, len(ts))) AS p, unnest(ts) AS term FROM dt), w AS (SELECT mp.query_id, mp.chunk_id, need, qt.term, p FROM mp JOIN qt USING (query_id) JOIN ix ON ix.chunk_id = mp.chunk_id AND ix.term = qt.term),
la AS (SELECT x.query_id, x.chunk_id, x.need, x.p, y.term, max(y.p) AS last FROM w x JOIN w y ON x.query_id = y.query_id AND x.chunk_id = y.chunk_id AND y.p <= x.p GROUP BY 1, 2, 3, 4, 5),
lo AS (SELECT query_id, chunk_id, need, p, min(last) AS low FROM la GROUP BY 1, 2, 3, 4 HAVING count(*) = need), sp AS (SELECT query_id, chunk_id, need, low, min(p) AS p FROM lo GROUP BY 1, 2, 3, 4),
su AS (SELECT query_id, chunk_id, sum(1 / (p - low - need + 2)) AS r FROM sp GROUP BY 1, 2) SELECT query_id, chunk_id, r / (r + 1) AS bm25_score FROM su""")
def r3_cover_scores(spark, d):
    return R.cover_scores(T(spark, d, "benchmark"), "item_id", "text", T(spark, d, "documents"), "doc_id", "text")


TOPK = "row_number() OVER (PARTITION BY query_id ORDER BY {s} DESC, chunk_id)::INT"


@query(f"WITH {BM}, rk AS (SELECT query_id, chunk_id, round(bm25_score, 6) AS bm25_score FROM lx), tk AS (SELECT *, {TOPK.format(s='bm25_score')} AS rank FROM rk) SELECT * FROM tk WHERE rank <= 5")
def r4_lexical_search(spark, d):
    return lexical(spark, d, 5)


def lexical(spark, d, k):
    return L.search_index(index(spark, d), asked(spark, d), "text", L.Scoring(k, lexical_digits=(6,))).select("query_id", "chunk_id", "bm25_score", "rank")


def vectors(spark, d):
    e = T(spark, d, "embeddings")
    return e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))


COS = """cs AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS vector_score FROM embeddings q, embeddings c
WHERE q.vec_id % 25 = 0 AND q.embedding IS NOT NULL AND c.embedding IS NOT NULL)"""


def scored(spark, d, t, k=None, only=None):
    """Vector scores; ``only`` those of the queries in a table where others aren't asked for."""
    q, c = vectors(spark, d)
    return R.vector_scores(q if only is None else q.join(only.select("query_id").hint("merge"), "query_id", "left_semi"), c, t, k, 6)


def scored_by_query(spark, d, t):
    """Vector scores, a query's in one task, for windows by query: pairs grow with the square of the embeddings, and so
    do the tasks that sort them."""
    q, c = vectors(spark, d)
    return R.dealt_by_query(R.vector_scores(q, c, t, None, 6), q.count() * c.count())


@query(f"WITH {COS}, k AS (SELECT *, {TOPK.format(s='vector_score')} AS rank FROM cs WHERE vector_score > 0.2) SELECT * FROM k WHERE rank <= 10")
def r5_vector_search(spark, d):
    return R.vector_search(*vectors(spark, d), 10, 0.2, 6)


@query(f"WITH {COS}, k AS (SELECT *, {TOPK.format(s='vector_score')} AS rank FROM cs WHERE vector_score > 0.2) SELECT * FROM k WHERE rank <= 10")
def r5_cell_search(spark, d):
    return R.cell_search(*vectors(spark, d), 10, 0.2, 6)


@query(f"WITH {COS} SELECT * FROM cs WHERE vector_score > 0.3")
def r6_vector_candidates(spark, d):
    return scored(spark, d, 0.3)


HY = f"""{BM}, {COS}, q AS (SELECT item_id AS query_id, CASE item_id % 2 WHEN 0 THEN 0.3 ELSE 0.7 END::DOUBLE AS wl FROM benchmark), vs AS (SELECT * FROM cs WHERE vector_score > 0.2 AND query_id IN (SELECT item_id FROM benchmark)),
fu AS (SELECT query_id, chunk_id, round(round(coalesce(bm25_score, 0), 6), 3) AS bm25_score, round(coalesce(vector_score, 0), 3) AS vector_score FROM lx FULL JOIN vs USING (query_id, chunk_id)),
hy AS (SELECT query_id, chunk_id, bm25_score, vector_score, round(wl * bm25_score + (1 - wl) * vector_score, 4) AS combined_score FROM fu JOIN q USING (query_id) WHERE wl * bm25_score + (1 - wl) * vector_score > 0),
top AS (SELECT *, {TOPK.format(s='combined_score')} AS rank FROM hy)"""


def hybrid(spark, d, k, documents=None):
    w = F.when(F.col("query_id") % 2 == 0, 0.3).otherwise(0.7)
    q = asked(spark, d).withColumn("w_lexical", w).withColumn("w_vector", 1 - w)
    q = q if documents is None else q.withColumn("documents", documents)
    vector = scored(spark, d, 0.2, only=q).withColumn("vector_score", F.round("vector_score", 3)).withColumn("document_id", F.col("chunk_id") % 10)
    return L.search_index(index(spark, d), q, "text", L.Scoring(k, lexical_digits=(6, 3), digits=4), vector)


@query(f"WITH {HY} SELECT query_id, chunk_id, bm25_score, vector_score, combined_score, rank FROM top WHERE rank <= 10")
def r7_hybrid_search(spark, d):
    return hybrid(spark, d, 10).select("query_id", "chunk_id", "bm25_score", "vector_score", "combined_score", "rank")


def with_meta(spark, d, hits):
    m = T(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), (F.col("n_chars") % 2 == 0).alias("has_codes"), F.when(F.col("lang") == "en", "table").otherwise("text").alias("chunk_type"), F.col("source").alias("section_title"), F.col("lang").alias("section_number"))
    return hits.join(m.hint("merge"), "chunk_id")


META = "JOIN (SELECT doc_id AS chunk_id, n_chars % 2 = 0 AS hc, lang = 'en' AS tb, source, lang FROM documents) m USING (chunk_id)"


@query(f"WITH {HY} SELECT query_id, chunk_id, round(combined_score + CASE WHEN hc THEN 0.1 ELSE 0 END + CASE WHEN tb THEN 0.05 ELSE 0 END, 6) AS combined_score FROM top {META} WHERE rank <= 20")
def r8_boost_v1(spark, d):
    return R.boost(with_meta(spark, d, hybrid(spark, d, 20)), "v1").select("query_id", "chunk_id", F.round("combined_score", 6).alias("combined_score"))


@query(f"WITH {HY} SELECT query_id, chunk_id, round(combined_score * CASE WHEN query_id % 3 = 0 AND tb THEN 1.25 ELSE 1 END + CASE WHEN hc THEN 0.1 ELSE 0 END + CASE WHEN query_id % 3 <> 0 AND tb THEN 0.05 ELSE 0 END, 6) AS combined_score FROM top {META} WHERE rank <= 20")
def r9_boost_v2(spark, d):
    return R.boost(with_meta(spark, d, hybrid(spark, d, 20)), "v2", F.col("query_id") % 3 == 0).select("query_id", "chunk_id", F.round("combined_score", 6).alias("combined_score"))


@query(f"WITH {HY} SELECT query_id, chunk_id, round(combined_score + CASE WHEN hc THEN 0.1 ELSE 0 END + CASE WHEN tb THEN 0.05 ELSE 0 END + CASE WHEN starts_with(source, 'src1') OR lang = 'fr' THEN 0.5 ELSE 0 END, 6) AS combined_score FROM top {META} WHERE rank <= 20")
def r10_boost_v3(spark, d):
    h = with_meta(spark, d, hybrid(spark, d, 20)).withColumn("refs", F.array(F.lit("SRC1"), F.lit("fr")))
    return R.boost(h, "v3", refs="refs").select("query_id", "chunk_id", F.round("combined_score", 6).alias("combined_score"))


@query(rf"""WITH {HY}, t AS (SELECT query_id, chunk_id, combined_score, regexp_matches(text, '\|\s*\w+\s*\||\b(?:min|max|Min|Max|MIN|MAX)\b.*\b(?:ksi|MPa|%|psi)\b|\t\s*\d+(?:\.\d+)?\s*\t') OR regexp_matches(text, '(?i)TABLE\s+\d+|\bTABLE\s+[A-Z]\d*|(?:Mechanical|Chemical|Physical)\s+(?:Requirements|Properties)|(?:Grade|Type|Class)\s+(?:Designation|UNS)')
 OR regexp_matches(text, '\b\d+(?:\.\d+)?\s*(?:ksi|MPa)\b.*\b\d+(?:\.\d+)?\s*(?:ksi|MPa)\b') OR len(regexp_extract_all(text, '\d+(?:\.\d+)?')) / len(regexp_split_to_array(text, '\s+')) > 0.2 AS tb FROM top JOIN documents ON doc_id = chunk_id WHERE rank <= 20)
SELECT query_id, chunk_id, CASE WHEN tb THEN greatest(combined_score, least(1.0, round(combined_score + 0.15, 6))) ELSE combined_score END AS combined_score FROM t""")
def r11_table_content_boost(spark, d):
    h = hybrid(spark, d, 20).join(T(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text").hint("merge"), "chunk_id")
    return R.table_content_boost(h, "text").select("query_id", "chunk_id", F.round("combined_score", 6).alias("combined_score"))


@query(f"""WITH {HY}, al AS (SELECT * FROM hy WHERE query_id % 2 = 1 OR chunk_id % 10 IN (1, 2, 3)), ak AS (SELECT *, {TOPK.format(s='combined_score')} AS rank FROM al)
SELECT query_id, chunk_id, combined_score, rank FROM ak WHERE rank <= 20""")
def r12_document_filter(spark, d):
    only = F.when(F.col("query_id") % 2 == 0, F.array(*map(F.lit, "123")))
    return hybrid(spark, d, 20, only).select("query_id", "chunk_id", "combined_score", "rank")


@query(f"WITH {COS}, hb AS (SELECT *, vector_score AS combined_score, 0.5::DOUBLE AS bm25_score FROM cs WHERE vector_score > 0.45 AND query_id <> chunk_id) SELECT query_id, chunk_id, bm25_score, combined_score FROM hb UNION ALL SELECT query_id, chunk_id, 0.0, vector_score FROM cs WHERE vector_score > 0.3 AND query_id NOT IN (SELECT query_id FROM hb)")
def r13_vector_fallback(spark, d):
    s = scored(spark, d, 0.3)
    h = s.where("vector_score > 0.45 AND query_id <> chunk_id").select("query_id", "chunk_id", F.lit(0.5).alias("bm25_score"), F.col("vector_score").alias("combined_score"))
    return R.with_vector_fallback(h, s)


SUB = f"{COS}, sub AS (SELECT query_id % 100 AS query_id, (query_id // 100)::INT AS sub_no, chunk_id, vector_score, row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, chunk_id)::INT AS rank FROM cs WHERE vector_score > 0.3)"


def subhits(spark, d):
    h = R.ranked(scored_by_query(spark, d, 0.3), "vector_score")
    return h.select((F.col("query_id") % 100).alias("query_id"), F.floor(F.col("query_id") / 100).cast("int").alias("sub_no"), "chunk_id", "vector_score", "rank")


@query(f"WITH {SUB}, m AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY sub_no, rank) AS r FROM sub) SELECT query_id, sub_no, chunk_id, rank FROM m WHERE r = 1")
def r14_merge_subqueries(spark, d):
    return R.merge_subqueries(subhits(spark, d)).select("query_id", "sub_no", "chunk_id", "rank")


COV = """al AS (SELECT DISTINCT vec_id % 100 AS query_id, (vec_id // 100)::INT AS sub_no FROM embeddings WHERE vec_id % 25 = 0), n AS (SELECT query_id, sub_no, count(*) AS hits FROM sub WHERE rank > 1 GROUP BY 1, 2),
c AS (SELECT query_id, sub_no, coalesce(hits, 0) AS hits FROM al LEFT JOIN n USING (query_id, sub_no)), w AS (SELECT *, max(hits) OVER p AS most, sum((hits > 0)::INT) OVER p AS covered, count(*) OVER p AS n FROM c WINDOW p AS (PARTITION BY query_id)),
cov AS (SELECT query_id, sub_no, hits, hits = 0 AS missing, covered >= 2 AND hits > 0 AND hits < greatest(3, floor(0.2 * most)) AS thin, covered / n AS ratio FROM w)"""


def covered(spark, d):
    al = T(spark, d, "embeddings").where("vec_id % 25 = 0").select((F.col("vec_id") % 100).alias("query_id"), F.floor(F.col("vec_id") / 100).cast("int").alias("sub_no")).distinct()
    return R.coverage(al, subhits(spark, d).where("rank > 1"))


@query(f"WITH {SUB}, {COV} SELECT * FROM cov")
def r15_coverage(spark, d):
    return covered(spark, d)


@query(f"""WITH {SUB}, {COV}, k AS (SELECT s.* FROM sub s JOIN cov USING (query_id, sub_no) WHERE rank <= CASE WHEN missing OR thin THEN 10 ELSE 5 END),
m AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank > 5, sub_no, rank) AS r FROM k) SELECT query_id, sub_no, chunk_id, rank FROM m WHERE r = 1""")
def r16_gap_fill(spark, d):
    return R.gap_fill(subhits(spark, d), covered(spark, d), 5).select("query_id", "sub_no", "chunk_id", "rank")


@query(f"""WITH {HY}, w AS (SELECT item_id AS query_id, unnest(list_slice(list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: length(x) > 6)), 1, 1000)) AS entity FROM benchmark),
e AS (SELECT * FROM w QUALIFY count(*) OVER (PARTITION BY query_id) >= 2), h AS (SELECT query_id, upper(text) AS t FROM top JOIN documents ON doc_id = chunk_id WHERE rank <= 5)
SELECT query_id, entity FROM e LEFT JOIN h USING (query_id) GROUP BY 1, 2 HAVING NOT coalesce(bool_or(contains(t, upper(entity))), false)""")
def r17_missing_entities(spark, d):
    ents = F.array_distinct(F.filter(F.split("text", r"\s+"), lambda x: F.length(x) > 6))
    q = T(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), ents.alias("e"))
    h = hybrid(spark, d, 5).join(T(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text").hint("merge"), "chunk_id")
    return R.missing_entities(q, "e", h, "text")


def reranked(spark, d, none):
    h = R.top_k(scored(spark, d, 0.3, 20), 20, "vector_score").withColumnRenamed("vector_score", "combined_score")
    s = T(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("label") / 10.0).alias("score"))
    s = h.select("query_id", "chunk_id").join(s.hint("merge"), "chunk_id").where("query_id % 50 = 0" if none else "true")
    return R.rerank_select(h.drop("rank"), s, 5).select("query_id", "chunk_id", "rerank", "rank")


def rerank_sql(cond):
    return f"""WITH {COS}, h AS (SELECT * FROM (SELECT *, {TOPK.format(s='vector_score')} AS rk FROM cs WHERE vector_score > 0.3) WHERE rk <= 20),
j AS (SELECT h.*, CASE WHEN {cond} THEN label / 10.0 END AS score FROM h JOIN embeddings ON vec_id = chunk_id), k AS (SELECT *, count(*) OVER p AS n, count(score) OVER p AS sc FROM j WINDOW p AS (PARTITION BY query_id)),
r AS (SELECT *, CASE WHEN n <= 5 THEN 8.0 WHEN sc = 0 THEN 7.0 ELSE round(coalesce(score, 0) * 10, 2) END::DOUBLE AS rerank FROM k), b AS (SELECT *, max(rerank) OVER (PARTITION BY query_id) AS best FROM r),
o AS (SELECT query_id, chunk_id, rerank, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, vector_score DESC, chunk_id)::INT AS rank FROM b WHERE rerank >= 4 OR best < 4) SELECT * FROM o WHERE rank <= 5"""


@query(rerank_sql("true"))
def r18_rerank_select(spark, d):
    return reranked(spark, d, False)


@query(rerank_sql("query_id % 50 = 0"))
def r19_rerank_fallback(spark, d):
    return reranked(spark, d, True)


@query(f"""WITH {COS}, c AS (SELECT query_id, chunk_id, vector_score AS s, chunk_id % 10 AS document_id FROM cs WHERE vector_score > 0.2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY s DESC, chunk_id) = 1 AND document_id IN (1, 2) AS first FROM c),
p AS (SELECT query_id, chunk_id, first AS reserved, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN first THEN 0 ELSE 1 END, s DESC, chunk_id)::INT AS place FROM r) SELECT * FROM p WHERE place <= 5""")
def r20_balance_documents(spark, d):
    c = scored_by_query(spark, d, 0.2).select("query_id", "chunk_id", F.col("vector_score").alias("combined_score"), (F.col("chunk_id") % 10).alias("document_id"))
    need = scored(spark, d, 0.2).select("query_id").distinct().select("query_id", F.explode(F.array(F.lit(1), F.lit(2)).cast("array<long>")).alias("document_id"))
    return R.balance_documents(c, need, 5).select("query_id", "chunk_id", "reserved", "place")


@query(f"""WITH RECURSIVE {COS}, c AS (SELECT query_id, chunk_id, vector_score AS s, chunk_id % 10 AS d FROM cs WHERE vector_score > 0.2), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS place FROM c QUALIFY place <= 2),
f AS (SELECT query_id, list({{'s': s, 'c': chunk_id, 'd': d, 'i': false}} ORDER BY place) AS hits FROM k GROUP BY 1), b AS (SELECT query_id, d, max(s) AS s, min(chunk_id) FILTER (s = best) AS chunk_id FROM (SELECT *, max(s) OVER (PARTITION BY query_id, d) AS best FROM c WHERE d IN (7, 1, 2, 5)) GROUP BY 1, 2),
m AS (SELECT b.*, row_number() OVER (PARTITION BY b.query_id ORDER BY list_position([7, 1, 2, 5], d)) AS j FROM b JOIN f ON f.query_id = b.query_id AND NOT list_contains(list_transform(hits, lambda h: h.d), d)),
r AS (SELECT query_id, hits, 0 AS j FROM f UNION ALL SELECT r.query_id, list_transform(hits, lambda h, i: CASE WHEN i = list_position(list_transform(hits, lambda y: y.s), list_min(list_transform(hits, lambda y: y.s))) THEN {{'s': m.s, 'c': m.chunk_id, 'd': m.d, 'i': true}} ELSE h END), r.j + 1 FROM r JOIN m ON m.query_id = r.query_id AND m.j = r.j + 1),
l AS (SELECT query_id, hits, unnest(range(1, len(hits) + 1)) AS place FROM r QUALIFY j = max(j) OVER (PARTITION BY query_id))
SELECT query_id, place::INT AS place, hits[place].c AS chunk_id, hits[place].d AS document_id, hits[place].s AS combined_score, hits[place].i AS injected FROM l""")
def r20_balance_sequential(spark, d):
    """Two hits and up to four documents that are put in, so that later ones take earlier ones' places."""
    c = written(scored(spark, d, 0.2).select("query_id", "chunk_id", F.col("vector_score").alias("combined_score"), (F.col("chunk_id") % 10).alias("document_id")))
    final = R.top_k(c, 2, "combined_score").withColumnRenamed("rank", "place")
    need = c.select("query_id").distinct().withColumn("documents", F.array(*map(F.lit, (7, 1, 2, 5))).cast("array<long>"))
    return R.balance_sequential(final, c, need)


@query("""WITH a AS (SELECT user_id AS query_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS attempt_no, event_type AS strategy, (floor(abs(value)) % 100)::INT AS confidence FROM events),
m AS (SELECT *, max(confidence) OVER (PARTITION BY query_id ORDER BY attempt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM a WHERE attempt_no <= 2), k AS (SELECT * FROM m WHERE b IS NULL OR b < 60),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, attempt_no) AS r, count(*) OVER (PARTITION BY query_id) AS tried FROM k) SELECT query_id, strategy, confidence, tried FROM r WHERE r = 1""")
def r21_best_strategy(spark, d):
    e = T(spark, d, "events")
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return R.best_strategy(e.select(F.col("user_id").alias("query_id"), n.alias("attempt_no"), F.col("event_type").alias("strategy"), (F.floor(F.abs("value")) % 100).cast("int").alias("confidence")))


@query(f"""WITH {COS}, h AS (SELECT *, {TOPK.format(s='vector_score')} AS rank, chunk_id % 7 AS document_id, chunk_id % 3 AS page_number FROM cs WHERE vector_score > 0.2),
p AS (SELECT *, min(rank) OVER w AS place, row_number() OVER (PARTITION BY query_id, document_id, page_number ORDER BY vector_score DESC, rank) AS r FROM h WINDOW w AS (PARTITION BY query_id, document_id, page_number)) SELECT query_id, chunk_id, place FROM p WHERE r = 1""")
def r22_dedup_pages(spark, d):
    h = R.ranked(scored_by_query(spark, d, 0.2), "vector_score").withColumnRenamed("vector_score", "combined_score")
    h = h.withColumn("document_id", F.col("chunk_id") % 7).withColumn("page_number", F.col("chunk_id") % 3)
    return R.dedup_pages(h).select("query_id", "chunk_id", "place")


def texts_of_hits(spark, d, k):
    docs = T(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "source")
    return hybrid(spark, d, k).join(docs.hint("merge"), "chunk_id").withColumn("document_id", F.col("source")).withColumn("page_number", F.col("chunk_id") % 5)


@query(f"""WITH RECURSIVE {HY}, h AS (SELECT query_id, source, chunk_id, rank, list_distinct(regexp_split_to_array(lower(coalesce(text, '')), '\\s+')) AS ws, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS i FROM top JOIN documents ON doc_id = chunk_id WHERE rank <= 20),
k AS (SELECT query_id, source, i, [ws] AS kept, true AS good FROM h WHERE i = 1 UNION ALL
 SELECT query_id, source, i, CASE WHEN ok THEN list_append(kept, ws) ELSE kept END, ok FROM (SELECT h.*, kept, len(list_filter(kept, lambda o: len(list_intersect(h.ws, o)) > 0.8 * (len(h.ws) + len(o) - len(list_intersect(h.ws, o))))) = 0 AS ok FROM k JOIN h ON h.query_id = k.query_id AND h.source = k.source AND h.i = k.i + 1))
SELECT query_id, chunk_id, rank FROM h JOIN k USING (query_id, source, i) WHERE good""")
def r23_suppress_overlap(spark, d):
    return R.suppress_overlap(texts_of_hits(spark, d, 20), "content").select("query_id", "chunk_id", "rank")


@query(f"""WITH {HY}, h AS (SELECT query_id, rank, '[' || rank || '] From ' || source || '.pdf (Page ' || chunk_id % 5 || ')' || CASE WHEN bm25_score > 0 THEN ' [keyword match]' ELSE '' END || ':' || chr(10) || coalesce(text, '') AS p FROM top JOIN documents ON doc_id = chunk_id WHERE rank <= 5)
SELECT query_id, md5(string_agg(p, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS digest FROM h GROUP BY query_id""")
def r24_assemble_context(spark, d):
    docs = T(spark, d, "documents").select(F.col("source").alias("document_id")).distinct().withColumn("filename", F.concat("document_id", F.lit(".pdf")))
    return R.assemble_context(texts_of_hits(spark, d, 5).withColumn("content", F.coalesce("content", F.lit(""))), docs).select("query_id", F.md5("context").alias("digest"))


@query(f"""WITH {HY}, h AS (SELECT query_id, chunk_id, rank, length(text) AS n FROM top JOIN documents ON doc_id = chunk_id WHERE rank <= 10), u AS (SELECT *, sum(n + 7) OVER w - 7 AS upto, row_number() OVER w = 1 AS first FROM h WINDOW w AS (PARTITION BY query_id ORDER BY rank))
SELECT query_id, chunk_id, least(n, 6000)::INT AS chars, ceil(least(n, 6000) / 4.0)::BIGINT AS token_estimate FROM u WHERE upto <= 6000 OR first""")
def r25_pack_context(spark, d):
    return R.pack_context(texts_of_hits(spark, d, 10), "content", 6000).select("query_id", "chunk_id", F.length("content").alias("chars"), "token_estimate")


@query(r"""WITH o AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents), f AS (SELECT doc_id, CASE WHEN regexp_matches(t, '[.!?] ') THEN regexp_extract(t, '^(.*?[.!?]) ', 1) ELSE t END AS x FROM o)
SELECT doc_id, CASE WHEN length(x) > 150 THEN left(x, 147) || '...' ELSE x END AS preview FROM f""")
def r26_citation_preview(spark, d):
    return T(spark, d, "documents").select("doc_id", R.citation_preview(F.col("text")).alias("preview"))


@query(f"""WITH {HY}, n AS (SELECT query_id, count(*) AS results, max(combined_score) AS best FROM top WHERE rank <= 10 GROUP BY 1)
SELECT query_id, coalesce(results, 0) AS results, best, CASE WHEN wl > 0.5 THEN 'keyword-focused (70/30)' ELSE 'semantic-focused (30/70)' END AS strategy FROM q LEFT JOIN n USING (query_id)""")
def r27_search_summary(spark, d):
    q = T(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, 0.3).otherwise(0.7).alias("w_lexical")).withColumn("w_vector", 1 - F.col("w_lexical"))
    return R.search_summary(q, hybrid(spark, d, 10)).select("query_id", "results", "best", "strategy")


@query(f"""WITH {HY}, l AS (SELECT *, {TOPK.format(s='bm25_score')} AS r FROM (SELECT query_id, chunk_id, round(bm25_score, 6) AS bm25_score FROM lx)), a AS (SELECT query_id, chunk_id, combined_score AS sa FROM top WHERE rank <= 10), b AS (SELECT query_id, chunk_id, bm25_score AS sb FROM l WHERE r <= 10)
SELECT query_id, count(*) FILTER (sa IS NOT NULL AND sb IS NOT NULL)::BIGINT AS "both", count(*) FILTER (sb IS NULL)::BIGINT AS only_a, count(*) FILTER (sa IS NULL)::BIGINT AS only_b, round(avg(sa - sb), 4) AS mean_delta FROM a FULL JOIN b USING (query_id, chunk_id) GROUP BY query_id""")
def r28_compare_rankings(spark, d):
    a = hybrid(spark, d, 10).withColumnRenamed("combined_score", "score")
    b = lexical(spark, d, 10).withColumnRenamed("bm25_score", "score")
    return R.compare_rankings(a, b, 10).withColumn("mean_delta", F.round("mean_delta", 4))


@query("""WITH c AS (SELECT vec_id AS doc_id, count(*) AS chunks FROM embeddings GROUP BY 1), j AS (SELECT doc_id, lower(trim(source)) AS key, n_chars, coalesce(chunks, 0) AS chunks FROM documents LEFT JOIN c USING (doc_id))
SELECT doc_id, key, CASE WHEN row_number() OVER (PARTITION BY key ORDER BY chunks DESC, n_chars DESC, doc_id) = 1 THEN 'keep' ELSE 'delete' END AS decision, count(*) OVER (PARTITION BY key) AS group_size FROM j""")
def p1_dedup_by_key(spark, d):
    return decisions(spark, d).select("doc_id", "key", "decision", "group_size")


def decisions(spark, d):
    chunks = T(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return P.dedup_by_key(T(spark, d, "documents").drop("text"), chunks, "source", "doc_id", "n_chars")


@query("SELECT md5(coalesce(text, '')) AS digest, max(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def p2_dedup_exact(spark, d):
    return P.dedup_exact(T(spark, d, "documents"), "text", "doc_id")


@query("WITH k AS (SELECT max(doc_id) AS doc_id FROM documents GROUP BY md5(coalesce(text, ''))) SELECT 'documents' AS part, doc_id FROM documents WHERE doc_id IN (FROM k) UNION ALL SELECT 'chunks', vec_id FROM embeddings WHERE vec_id IN (FROM k)")
def p3_apply_dedup(spark, d):
    docs, chunks = T(spark, d, "documents"), T(spark, d, "embeddings").withColumn("doc_id", F.col("vec_id"))
    a, b = P.apply_dedup(docs, chunks, P.dedup_exact(docs, "text", "doc_id"), "doc_id")
    return a.select(F.lit("documents").alias("part"), "doc_id").unionByName(b.select(F.lit("chunks").alias("part"), "doc_id"))


@query(f"""WITH x AS ({SQL["p1_dedup_by_key"]}), c AS (SELECT vec_id AS doc_id, count(*) AS chunks FROM embeddings GROUP BY 1)
SELECT count(*) FILTER (decision = 'delete')::BIGINT AS removed_documents, coalesce(sum(coalesce(chunks, 0)) FILTER (decision = 'delete'), 0)::BIGINT AS removed_chunks, coalesce(sum(n_chars) FILTER (decision = 'delete'), 0)::BIGINT AS removed_chars,
 round(100 * count(*) FILTER (decision = 'delete') / count(*), 4) AS percent FROM x JOIN documents USING (doc_id) LEFT JOIN c USING (doc_id)""")
def p4_dedup_savings(spark, d):
    return P.dedup_savings(decisions(spark, d), "n_chars")


NEAR = r"""s AS (SELECT doc_id AS id, list_sort(list_distinct(regexp_split_to_array(trim(lower(coalesce(text, ''))), '\s+'))) AS ws FROM documents), g AS (SELECT ws, min(id) AS id FROM s GROUP BY ws),
p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.ws, b.ws)) AS n, len(a.ws) AS na, len(b.ws) AS nb FROM g a JOIN g b ON a.id < b.id AND least(len(a.ws), len(b.ws)) >= 0.8 * greatest(len(a.ws), len(b.ws)))"""


@query(f"WITH {NEAR} SELECT a, b, round(n / (na + nb - n), 6) AS similarity FROM p WHERE n / (na + nb - n) > 0.8")
def p5_near_duplicates(spark, d):
    return P.near_duplicates(T(spark, d, "documents"), "text", "doc_id")[0].withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {NEAR}, l AS (SELECT unnest([a, b]) AS class_id FROM p WHERE n / (na + nb - n) > 0.8), c AS (SELECT class_id, count(*) AS links FROM l GROUP BY 1)
SELECT s.id AS doc_id, g.id AS class_id, coalesce(links, 0) AS links FROM s JOIN g ON s.ws = g.ws LEFT JOIN c ON c.class_id = g.id""")
def p5_near_classes(spark, d):
    return P.near_classes(T(spark, d, "documents"), "text", "doc_id")


@query(f"WITH {NEAR} SELECT count(*) FILTER (n / (na + nb - n) > 0.8) AS links, true AS found, 0 AS wrong FROM p")
def p5_near_approximate(spark, d):
    """Links of the exact join, whether the bands of MinHash signatures find 95 of 100 of them, and wrong ones among those."""
    docs = T(spark, d, "documents")
    exact, near = (written(P.near_duplicates(docs, "text", "doc_id", exact=x)[0].select("a", "b")).withColumn(name, F.lit(1)) for x, name in ((True, "e"), (False, "f")))
    both = exact.join(near.hint("merge"), ["a", "b"], "full").agg(F.count("e").alias("links"), F.count_if(F.col("e").isNotNull() & F.col("f").isNotNull()).alias("n"), F.count_if(F.col("e").isNull()).cast("int").alias("wrong"))
    return both.select("links", (F.col("n") >= 0.95 * F.col("links")).alias("found"), "wrong")
