"""Corpus queries: scans, preparation, extraction (S, D, X). Catalogues that match the tables are passed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.functions import catalogues as cat
from quillspark.functions.text import count_of, squeeze
from quillspark.operators import extract as X
from quillspark.operators import prepare as D
from quillspark.sources import corpus as S

T = S.read_table
MARK = r"\n"
MAIL = r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"
CATALOGUE = {"mail": [(MAIL, 0)], "ip": [(r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 0)], "license": [(r"\b(?:MIT|Apache|GNU) ?[A-Za-z]*\b", 0)]}
QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def strip_tags(html):
    return squeeze(F.regexp_replace(F.coalesce(html, F.lit("")), r"<[^>]*>", " "))


TAGS = r"trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en'")
def s1_corpus_scan(spark, d):
    return S.read_corpus(spark, d, ["doc_id", "lang", "n_chars"], F.col("lang") == "en")


@query(rf"""WITH p AS (SELECT page_id, regexp_split_to_array(coalesce(html, ''), '</p>') AS a FROM pages)
SELECT page_id, i::INT AS page_number, a[i] AS text FROM p, range(1, 1000000) r(i) WHERE i <= len(a)""")
def s2_explode_pages(spark, d):
    return S.explode_pages(T(spark, d, "pages"), F.split(F.coalesce("html", F.lit("")), "</p>"), ["page_id"])


@query(r"""WITH p AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '\n'), lambda x: trim(x) <> '') AS a FROM documents),
q AS (SELECT doc_id, CASE WHEN len(a) = 0 THEN [t] ELSE a END AS a FROM p)
SELECT doc_id, unnest(range(1, len(a) + 1))::INT AS page_number, unnest(a) AS text FROM q""")
def s3_split_pages(spark, d):
    return S.split_pages(T(spark, d, "documents"), "text", ["doc_id"], MARK)


@query("""WITH p AS (SELECT source, length(trim(coalesce(text, ''))) AS n, n_chars FROM documents)
SELECT source, sum(n)::BIGINT AS chars, CASE WHEN max(n) = 0 THEN 'empty' WHEN max(n) <= 20000 AND max(n_chars) >= 1000 THEN 'ocr' WHEN sum(n) < 100 THEN 'ocr' ELSE 'text' END AS action FROM p GROUP BY source""")
def s4_triage(spark, d):
    return S.triage_extraction(T(spark, d, "documents"), "source", "text", "n_chars", 20000)


@query(r"""SELECT vec_id, label, lang, trim(regexp_replace(left(coalesce(text, ''), 200), '\s+', ' ', 'g')) AS preview, len(embedding)::INT AS dims
FROM embeddings JOIN documents ON doc_id = vec_id WHERE embedding IS NOT NULL""")
def s8_export_embeddings(spark, d):
    chunks = T(spark, d, "embeddings").withColumn("doc_id", F.col("vec_id"))
    return S.export_embeddings(chunks, T(spark, d, "documents"), "doc_id").select("vec_id", "label", "lang", "preview", F.size("embedding").alias("dims"))


@query(r"""WITH e AS (SELECT vec_id, label, lang, trim(regexp_replace(left(coalesce(text, ''), 200), '\s+', ' ', 'g')) AS preview, list_sum(embedding::DOUBLE[]) AS total FROM embeddings JOIN documents ON doc_id = vec_id WHERE embedding IS NOT NULL), c AS (SELECT lang, count(*) AS chunks FROM e GROUP BY 1)
SELECT vec_id, label, lang, preview, round(total, 4) AS total, chunks, dense_rank() OVER (ORDER BY chunks DESC, lang)::INT AS place FROM e JOIN c USING (lang)""")
def s8_write_embeddings(spark, d):
    """The export as it is read back from its JSON lines, with the counts by document (languages stand for them)."""
    chunks = T(spark, d, "embeddings").withColumn("doc_id", F.col("vec_id"))
    export = S.export_embeddings(chunks, T(spark, d, "documents"), "doc_id").select("vec_id", "label", "lang", "preview", "embedding")
    path = new_folder(spark)
    S.write_embeddings(export, path, "lang", "label", "vec_id")
    back = spark.read.schema("vec_id long, label int, lang string, preview string, embedding array<double>").json(f"{path}/embeddings")
    counts = spark.read.schema("lang string, chunks long").json(f"{path}/counts").withColumn("place", F.dense_rank().over(W.orderBy(F.desc("chunks"), "lang")))  # a row for each document
    return back.join(counts, "lang").select("vec_id", "label", "lang", "preview", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), "chunks", "place")


@query("""WITH m AS (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)
SELECT was, event_type AS now, count(*) AS n, (was || '>' || event_type) IN ('view>click', 'click>purchase', 'signup>view') AS legal FROM m WHERE was IS NOT NULL GROUP BY 1, 2""")
def s10_status_funnel(spark, d):
    return S.status_funnel(T(spark, d, "events"), "user_id", "event_type", "ts", "event_id", {"view": ["click"], "click": ["purchase"], "signup": ["view"]})


@query("""WITH c AS (SELECT vec_id AS doc_id, count(*) AS chunks, count(embedding) AS embedded FROM embeddings GROUP BY 1)
SELECT doc_id, coalesce(chunks, 0) AS chunks, CASE WHEN coalesce(chunks, 0) = 0 OR chunks <> embedded THEN 'error' ELSE 'indexed' END AS status FROM documents LEFT JOIN c USING (doc_id)""")
def s10_ingest_outcome(spark, d):
    chunks = T(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return S.ingest_outcome(T(spark, d, "documents").select("doc_id"), chunks, "doc_id").select("doc_id", "chunks", "status")


@query("SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def s12_metric_events(spark, d):
    return S.read_corpus(spark, d, ["event_type", "value"], name="events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


PARAGRAPHS = r"""p AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\n') AS a FROM documents),
b0 AS (SELECT doc_id, unnest(range(0, len(a)))::INT AS block_no, unnest(a) AS x FROM p),
b AS (SELECT doc_id, block_no, trim(regexp_replace(x, '^\s+|\s+$', '', 'g')) AS block FROM b0 WHERE trim(regexp_replace(x, '^\s+|\s+$', '', 'g')) <> '')"""


@query(f"WITH {PARAGRAPHS} SELECT * FROM b")
def d1_paragraphs(spark, d):
    return D.paragraphs(T(spark, d, "documents"), "text", ["doc_id"], r"\n")


#: One text is a block of three lines here, so that the block tests on several lines have something to do.
THREE = r"""l AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\n'), lambda x: trim(x) <> '') AS ls FROM documents)"""


def any_of(c, patterns, flags):
    return "(" + " OR ".join(f"regexp_matches({c}, '{p}', '{flags}')" for p in patterns) + ")"


IS_TABLE = rf"""(len(ls) >= 2 AND ((len(list_filter(ls, lambda x: contains(x, '|'))) >= 2 AND len(list_filter(ls, lambda x: regexp_matches(x, '^[\s|:-]+$'))) > 0)
 OR len(list_filter(ls, lambda x: len(string_split(x, chr(9))) >= 3)) >= 0.7 * len(ls) OR {{headers}}
 OR (len(ls) >= 3 AND len(list_filter(ls, lambda x: len(regexp_extract_all(x, '{cat.NUMBER_OR_RANGE}')) >= 2)) >= 0.5 * len(ls))))"""


@query(rf"""WITH {THREE} SELECT l.doc_id, {IS_TABLE.format(headers=any_of("text", cat.TABLE_HEADERS, "i"))} AS is_table, len(ls) >= 3 AND len(list_filter(ls, lambda x: len(regexp_extract_all(x, '{cat.NUMBER_OR_RANGE}')) >= 2)) >= 0.5 * len(ls) AS numeric_columns FROM l JOIN documents USING (doc_id)""")
def d2_table_tests(spark, d):
    from quillspark.functions.text import lines

    c = F.coalesce("text", F.lit(""))
    return T(spark, d, "documents").select("doc_id", D.is_table(c).alias("is_table"), D.numeric_columns(lines(c)).alias("numeric_columns"))


@query(rf"""WITH {THREE} SELECT doc_id, CASE WHEN len(ls) >= 2 THEN CASE WHEN len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-•*◦▪]\s+'))) >= 0.6 * len(ls) THEN 'bullet'
 WHEN len(list_filter(ls, lambda x: regexp_matches(x, '^\s*\d+[.)]\s+'))) >= 0.6 * len(ls) THEN 'numbered' END END AS kind FROM l""")
def d2_list_kind(spark, d):
    return T(spark, d, "documents").select("doc_id", D.list_kind(F.col("text")).alias("kind"))


#: Four documents are the pages of one here: a list, a table with a footnote, and two of paragraphs.
MANUAL = r"""m AS (SELECT doc_id // 4 AS doc_id, (doc_id % 4)::INT AS page, CASE doc_id % 4 WHEN 0 THEN '- ' || replace(text, chr(10), chr(10) || '- ') WHEN 1 THEN text || chr(10) || chr(10) || 'Note 1: as above.' ELSE replace(text, chr(10), chr(10) || chr(10)) END AS text FROM documents)"""
HEADERS = [r"\bthe\b.*\band\b"]


def semantic_pages(spark, d):
    t, nl = F.col("text"), F.lit("\n")
    text = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("- "), F.replace(t, nl, F.lit("\n- ")))).when(F.col("doc_id") % 4 == 1, F.concat(t, F.lit("\n\nNote 1: as above."))).otherwise(F.replace(t, nl, F.lit("\n\n")))
    return T(spark, d, "documents").select(F.floor(F.col("doc_id") / 4).alias("doc_id"), (F.col("doc_id") % 4).cast("int").alias("page"), text.alias("text"))


BLOCKS_SQL = rf"""{MANUAL}, c0 AS (SELECT doc_id, page, regexp_split_to_array(coalesce(text, ''), '\n\n+') AS a FROM m WHERE length(trim(coalesce(text, ''))) >= 50), c1 AS (SELECT doc_id, page, unnest(range(0, len(a)))::INT AS block_no, unnest(a) AS x FROM c0),
c2 AS (SELECT doc_id, page, block_no, trim(regexp_replace(x, '^\s+|\s+$', '', 'g')) AS block FROM c1), c3 AS (SELECT *, list_filter(string_split(block, chr(10)), lambda x: trim(x) <> '') AS ls FROM c2 WHERE block <> ''),
c4 AS (SELECT *, {IS_TABLE.format(headers=any_of("block", HEADERS, "i"))} AS tb, len(ls) BETWEEN 1 AND 10 AND len(list_filter(ls, lambda x: {any_of("x", cat.FOOTNOTES_CASED, "c")} OR {any_of("x", cat.FOOTNOTES, "i")})) >= 0.5 * len(ls) AS fn,
 len(ls) >= 2 AND (len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-•*◦▪]\s+'))) >= 0.6 * len(ls) OR len(list_filter(ls, lambda x: regexp_matches(x, '^\s*\d+[.)]\s+'))) >= 0.6 * len(ls)) AS li,
 coalesce({", ".join(f"nullif(trim(regexp_extract(block, '{p}', {g})), '')" for p, g in cat.HEADINGS)}) AS st FROM c3),
c5 AS (SELECT *, sum(tb::INT) OVER (PARTITION BY doc_id ORDER BY page, block_no) AS tables FROM c4),
bl AS (SELECT doc_id, page, block_no, block, CASE WHEN tb THEN 'table' WHEN tables > 0 AND fn THEN 'footnote' WHEN li THEN 'list' WHEN length(block) < 100 AND st IS NOT NULL THEN 'heading' ELSE 'text' END AS kind, CASE WHEN NOT tb AND NOT (tables > 0 AND fn) AND NOT li AND length(block) < 100 THEN st END AS title FROM c5),
f1 AS (SELECT *, max(CASE WHEN kind = 'table' THEN page * 1000000 + block_no END) OVER (PARTITION BY doc_id ORDER BY page, block_no) AS lt FROM bl),
f2 AS (SELECT *, CASE WHEN kind = 'footnote' AND lt // 1000000 = page THEN lt % 1000000 ELSE block_no END AS own FROM f1),
ab AS (SELECT doc_id, page, own::INT AS block_no, string_agg(block, chr(10) || chr(10) ORDER BY block_no) AS block, arg_min(kind, block_no) AS kind, arg_min(title, block_no) FILTER (block_no = own) AS title, count(*) > 1 AS has_footnotes FROM f2 GROUP BY 1, 2, 3)"""

SEMANTIC_SQL = rf"""{BLOCKS_SQL}, s1 AS (SELECT doc_id, page, arg_max(title, block_no) FILTER (title IS NOT NULL) AS own, max(title) AS title, string_agg(block, chr(10) || chr(10) ORDER BY block_no) FILTER (kind NOT IN ('table', 'list')) AS rest FROM ab GROUP BY 1, 2),
s2 AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page) AS section FROM s1),
u AS (SELECT doc_id, page, block_no, block, kind, NULL AS title, has_footnotes AS notes FROM ab WHERE kind IN ('table', 'list') UNION ALL SELECT doc_id, page, -1, rest, 'text', title, false FROM s2 WHERE length(rest) >= 800),
v AS (SELECT *, kind IN ('table', 'list') AND length(block) <= CASE kind WHEN 'table' THEN 3500 ELSE 2500 END AS whole, list_filter(string_split(block, chr(10)), lambda x: trim(x) <> '') AS ls FROM u),
h AS (SELECT *, list_transform(ls[1:5], lambda x: trim(x)) AS five FROM v), h1 AS (SELECT *, list_min(list_filter(range(2, len(five) + 1), lambda i: regexp_matches(five[i], '{cat.DATA_ROW}'))) AS cut FROM h),
h2 AS (SELECT *, CASE WHEN kind = 'table' AND NOT whole AND len(ls) >= 3 THEN array_to_string(CASE WHEN cut IS NOT NULL THEN five[1:cut - 1] ELSE five END, chr(10)) ELSE '' END AS head FROM h1),
w AS (SELECT *, CASE kind WHEN 'table' THEN greatest(1500 - length(head) - 1, 300) ELSE 1500 END AS width FROM h2),
x1 AS (SELECT *, unnest(range(0, CASE WHEN NOT whole AND length(block) > width THEN ceil((length(block) - width) / (width - 200))::INT + 1 ELSE 1 END))::INT AS chunk_no FROM w),
x2 AS (SELECT *, CASE WHEN whole THEN block ELSE trim(substring(block, (chunk_no * (width - 200) + 1)::INT, width::INT)) END AS piece FROM x1),
x3 AS (SELECT *, CASE WHEN NOT whole AND chunk_no > 0 AND head <> '' THEN head || chr(10) || piece ELSE piece END AS content FROM x2 WHERE whole OR length(piece) > 50)
SELECT x3.doc_id, x3.page, block_no, chunk_no, CASE WHEN kind = 'text' AND x3.title IS NOT NULL AND length(content) < 150 THEN 'heading' ELSE kind END AS kind,
 CASE WHEN kind = 'text' THEN 0.75 WHEN kind = 'table' AND whole THEN CASE WHEN notes THEN 0.98 ELSE 0.95 END WHEN kind = 'table' THEN 0.85 WHEN whole THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence, length(content)::INT AS chars, md5(content) AS digest, section, {{flag}} AS has_codes FROM x3 JOIN s2 USING (doc_id, page)"""


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, page, block_no, kind, title FROM bl")
def d2_classify_blocks(spark, d):
    blocks = D.paragraphs(semantic_pages(spark, d).where(F.length(F.trim("text")) >= 50), "text", ["doc_id", "page"])
    return D.classify_blocks(blocks, "doc_id", "page", HEADERS).select("doc_id", "page", "block_no", "kind", "title")


@query(rf"""WITH {PARAGRAPHS}, h AS (SELECT *, CASE WHEN length(block) < 100 AND block_no % 3 = 0 THEN left(block, 20) END AS title, block_no // 5 AS page FROM b),
pg AS (SELECT doc_id, page, max_by(title, block_no) FILTER (title IS NOT NULL) AS own FROM h GROUP BY 1, 2)
SELECT doc_id, page::INT AS page, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page) AS section FROM pg""")
def d4_carry_section(spark, d):
    b = D.paragraphs(T(spark, d, "documents"), "text", ["doc_id"], r"\n")
    title = F.when((F.length("block") < 100) & (F.col("block_no") % 3 == 0), F.substring("block", 1, 20))
    return D.carry_section(b.withColumn("title", title).withColumn("page", F.floor(F.col("block_no") / 5).cast("int")), "doc_id", "page")


def windows(size, overlap, keep):
    step = size - overlap
    return f"""WITH t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
w AS (SELECT doc_id, n, text, unnest(range(0, CASE WHEN n > {size} THEN ceil((n - {size}) / {step}.0)::INT + 1 ELSE 1 END)) AS i FROM t),
c AS (SELECT doc_id, i::INT AS chunk_no, (i * {step})::INT AS start, trim(substring(text, (i * {step} + 1)::INT, {size})) AS content, least(i * {step} + {size}, n)::INT AS "end", n FROM w)
SELECT doc_id, chunk_no, start, content, "end" FROM c WHERE length(content) > 50{f" OR (n <= {size} AND length(content) > 0)" if keep else ""}"""


@query(windows(1500, 200, False))
def d5_window_chunks(spark, d):
    return D.window_chunks(T(spark, d, "documents"), "text", ["doc_id"])


@query(windows(1000, 200, True))
def d6_legacy_chunks(spark, d):
    return D.window_chunks(T(spark, d, "documents"), "text", ["doc_id"], 1000, 200, keep_single=True)


FLAG = r"""(regexp_matches(coalesce(text, ''), '\bUNS\s+[A-Z]\d{5}\b|\bASTM\s+[A-Z]\d{2,4}\b|\bAPI\s+\d+[A-Z]?\b|\bNACE\s+[A-Z]{2}\d{4}\b', 'i') OR regexp_matches(coalesce(text, ''), '\b[A-Z]{2,4}\s*\d{3,4}[A-Z]?\b|\b\d{3}[A-Z]?L?\b'))"""


SEMANTIC_SQL = SEMANTIC_SQL.replace("{flag}", FLAG.replace("text", "content"))


def semantic(pages):
    return D.semantic_chunks(pages, "doc_id", "page", "text", headers=HEADERS)


@query(f"WITH {SEMANTIC_SQL}")
def d9_semantic_chunks(spark, d):
    return semantic(semantic_pages(spark, d)).select("doc_id", "page", "block_no", "chunk_no", "kind", "confidence", F.length("content").alias("chars"), F.md5("content").alias("digest"), "section", "has_codes")


@query(f"WITH x AS (WITH {SEMANTIC_SQL}) SELECT doc_id, page, block_no, count(*) AS pieces, sum(chars)::BIGINT AS chars FROM x WHERE kind = 'table' AND confidence = 0.85 GROUP BY 1, 2, 3")
def d7_split_tables(spark, d):
    """Tables too long for one chunk: their pieces, each under the header."""
    c = semantic(semantic_pages(spark, d)).where("kind = 'table' AND confidence = 0.85")
    return c.groupBy("doc_id", "page", "block_no").agg(F.count("*").alias("pieces"), F.sum(F.length("content")).alias("chars"))


@query(f"WITH x AS (WITH {SEMANTIC_SQL}) SELECT doc_id, page, block_no, confidence, count(*) AS pieces, sum(chars)::BIGINT AS chars FROM x WHERE kind = 'list' GROUP BY 1, 2, 3, 4")
def d8_list_chunks(spark, d):
    c = semantic(semantic_pages(spark, d)).where("kind = 'list'")
    return c.groupBy("doc_id", "page", "block_no", "confidence").agg(F.count("*").alias("pieces"), F.sum(F.length("content")).alias("chars"))


@query(f"SELECT doc_id, {FLAG} AS has_codes FROM documents")
def d10_flag_codes(spark, d):
    return T(spark, d, "documents").select("doc_id", D.has_codes(F.col("text")).alias("has_codes"))


@query(f"""SELECT source, lang, count(*) AS chunks, (count(*) FILTER ({FLAG}))::BIGINT AS with_codes, avg(length(text)) AS mean_chars FROM documents GROUP BY ROLLUP (source, lang)""")
def d11_chunk_stats(spark, d):
    return D.chunk_stats(T(spark, d, "documents"), "source", "lang", "text")


@query(f"""WITH c AS ({windows(400, 150, False)}), o AS (SELECT *, lag("end") OVER (PARTITION BY doc_id ORDER BY start) - start AS overlap FROM c)
SELECT doc_id, chunk_no, overlap::INT AS overlap FROM o WHERE overlap > 100""")
def d12_overlap_audit(spark, d):
    chunks = D.window_chunks(T(spark, d, "documents"), "text", ["doc_id"], 400, 150)
    return D.overlap_audit(chunks, ["doc_id"]).select("doc_id", "chunk_no", "overlap")


@query(r"""WITH p AS (SELECT source, coalesce(text, '') AS t FROM documents)
SELECT source, count(*) AS pages, sum(len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')))::BIGINT AS words, sum(length(t))::BIGINT AS chars, sum(len(regexp_extract_all(t, '=\s*%?\w+\s*[+\-*/]')))::BIGINT AS formulas,
 sum(len(regexp_extract_all(t, '(?i)TABLE\s+\d+')))::BIGINT AS tables, floor(sum(length(t)) / count(*) + 0.5)::BIGINT AS chars_per_page FROM p GROUP BY source""")
def d13_document_stats(spark, d):
    return D.document_stats(T(spark, d, "documents"), "source", "text")


@query(r"""WITH g AS (SELECT source, unnest(regexp_extract_all(coalesce(text, ''), '\b[A-Z][a-z]{1,2}\b')) AS g FROM documents), n AS (SELECT source, count(DISTINCT g) AS grades FROM g GROUP BY 1)
SELECT source, coalesce(grades, 0) AS grades FROM (SELECT DISTINCT source FROM documents) LEFT JOIN n USING (source)""")
def d13_grades(spark, d):
    """Short capitalised words stand for grades."""
    return D.grade_counts(T(spark, d, "documents"), "source", "text", r"\b[A-Z][a-z]{1,2}\b")


def x1_sql(table, key):
    parts = [
        f"SELECT DISTINCT {key}, '{k}' AS code_type, upper(unnest(regexp_extract_all(coalesce(text, ''), '{p}', {g}, 'i'))) AS code FROM {table}" for k, ps in CATALOGUE.items() for p, g in ps
    ]
    return " UNION ALL ".join(parts)


@query(x1_sql("documents", "doc_id"))
def x1_extract_codes(spark, d):
    return X.extract_codes(T(spark, d, "documents"), "text", ["doc_id"], CATALOGUE)


@query(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS code_type, list_sort(list_distinct(list_transform({' || '.join(f"regexp_extract_all(coalesce(text, ''), '{p}', {g}, 'i')" for p, g in ps)}, lambda x: upper(x)))) AS codes FROM documents" for k, ps in CATALOGUE.items()))
def x1_pivot_codes(spark, d):
    t = X.pivot_codes(T(spark, d, "documents"), "text", CATALOGUE)
    return t.select("doc_id", F.inline(F.array(*[F.struct(F.lit(k).alias("code_type"), F.array_sort(k).alias("codes")) for k in CATALOGUE])))


STOP = "the and that with this have from for was are not you".split()


@query(rf"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\w\s-]', ' ', 'g'), '\s+')) AS w FROM documents)
SELECT DISTINCT doc_id, upper(w) AS keyword FROM w WHERE length(w) >= 3 AND w NOT IN ({", ".join(repr(w) for w in STOP)})""")
def x3_keywords(spark, d):
    return T(spark, d, "documents").select("doc_id", F.explode(X.keywords(F.col("text"), STOP)).alias("keyword"))


@query(r"""WITH c AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(upper(coalesce(source, '')), 'SRC\d'))) AS code FROM documents) SELECT code, list_sort(list(DISTINCT doc_id)) AS docs FROM c GROUP BY code""")
def x4_code_index_names(spark, d):
    return X.code_index(T(spark, d, "documents"), "doc_id", X.codes(F.col("source"), [(r"SRC\d", 0)]))


@query(rf"""WITH t AS ({windows(500, 50, True)}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no) AS r FROM t),
c AS (SELECT doc_id, unnest(regexp_extract_all(content, '{MAIL}')) AS m FROM r WHERE r <= 5
 UNION ALL SELECT doc_id, unnest(regexp_extract_all(source, 'src\d')) FROM documents)
SELECT upper(m) AS code, list_sort(list(DISTINCT doc_id)) AS docs FROM c GROUP BY 1""")
def x5_code_index_chunks(spark, d):
    docs = T(spark, d, "documents")
    chunks = D.window_chunks(docs, "text", ["doc_id"], 500, 50, keep_single=True)
    return X.code_index(docs, "doc_id", X.codes(F.col("source"), [(r"src\d", 0)]), chunks, X.codes(F.col("content"), [(MAIL, 0)]))


MEASURED = "coalesce(text, '') || ' of ' || n_chars || ' MPa, ' || doc_id % 90 || '.5 HRC and 1,' || 100 + doc_id % 7 || ' psi at ' || doc_id % 300 || ' °F, 3/4 in, ' || doc_id % 50 || ' - 60 ksi'"


def measured(spark, d):
    """Documents with a clause of measured values from their own columns."""
    n = lambda c: c.cast("string")
    i, w = F.col("doc_id"), F.lit
    t = F.concat(F.coalesce("text", w("")), w(" of "), n(F.col("n_chars")), w(" MPa, "), n(i % 90), w(".5 HRC and 1,"), n(i % 7 + 100), w(" psi at "), n(i % 300), w(" °F, 3/4 in, "), n(i % 50), w(" - 60 ksi"))
    return T(spark, d, "documents").select("doc_id", t.alias("text"))


def found_sql(p, v, u):
    return f"SELECT doc_id, regexp_extract(replace(unnest(regexp_extract_all(t, '{p}', {v}, 'i')), ',', ''), '^\\d+(?:\\.\\d+)?')::DOUBLE AS value, unnest(regexp_extract_all(t, '{p}', {u}, 'i')) AS unit FROM e"


@query(f"WITH e AS (SELECT doc_id, {MEASURED} AS t FROM documents) SELECT DISTINCT * FROM ({' UNION ALL '.join(found_sql(*x) for x in X.QUANTITIES)})")
def x8_quantities(spark, d):
    return X.extract_quantities(measured(spark, d), "text", ["doc_id"]).select("doc_id", "value", "unit")


@query(f"""WITH e AS (SELECT doc_id, {MEASURED} AS t FROM documents), q AS ({' UNION ALL '.join(f"SELECT doc_id, '{k}' AS kind, value, upper(unit) AS unit FROM ({found_sql(*x)})" for k, *x in X.MEASUREMENTS)}) SELECT doc_id, kind, value, unit, count(*) AS n FROM q GROUP BY 1, 2, 3, 4""")
def x9_measurements(spark, d):
    return X.measurements(measured(spark, d), "text", ["doc_id"]).groupBy("doc_id", "kind", "value", "unit").agg(F.count("*").alias("n"))


@query(r"""WITH n AS (SELECT count(*) AS n FROM benchmark), h AS (SELECT doc_id % n AS item_id, bool_or(regexp_matches(coalesce(text, '') || CASE WHEN doc_id % 400 = 1 THEN ' PREN = Cr' ELSE '' END, '=\s*%?\w+\s*[+\-*/]|formula:|equation:|PREN\s*=', 'i')) AS seen FROM documents, n GROUP BY 1)
SELECT item_id, item_id % 3 > 0 AND NOT coalesce(seen, false) AS guard FROM benchmark LEFT JOIN h USING (item_id)""")
def x10_formula_guard(spark, d):
    b = T(spark, d, "benchmark").select("item_id", F.concat("text", F.when(F.col("item_id") % 3 > 0, " Calculate it.").otherwise("")).alias("text"))
    n = b.agg(F.count("*").alias("n"))
    hits = T(spark, d, "documents").crossJoin(F.broadcast(n)).select((F.col("doc_id") % F.col("n")).alias("item_id"), F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 400 == 1, " PREN = Cr").otherwise("")).alias("content"))
    return X.formula_guard(b, hits, "item_id").select("item_id", "guard")


@query(r"""SELECT doc_id, regexp_matches(coalesce(text, ''), '=\s*%?\w+\s*[+\-*/]|formula:|equation:|PREN\s*=', 'i') AS has_formula, regexp_matches(lower(coalesce(text, '')), '\b(formula|equation|calculation|calculate|compute|derive)\b') AS asks FROM documents""")
def x10_formulas(spark, d):
    return T(spark, d, "documents").select("doc_id", X.has_formula(F.col("text")).alias("has_formula"), X.asks_formula(F.col("text")).alias("asks"))


@query(r"""WITH s AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '[.!?]+') AS a FROM documents), e AS (SELECT doc_id, unnest(range(0, len(a)))::INT AS sentence_no, unnest(a) AS x FROM s)
SELECT doc_id, sentence_no, trim(regexp_replace(x, '^\s+|\s+$', '', 'g')) AS sentence FROM e WHERE regexp_matches(x, '\d+%|must|shall|min', 'i')""")
def x11_claim_sentences(spark, d):
    return X.claim_sentences(T(spark, d, "documents"), "text", ["doc_id"], [r"\d+%", "must|shall|min"])


@query(r"""SELECT item_id, CASE WHEN contains(lower(text), 'yield') OR contains(lower(text), 'ys') THEN 'yield_strength' WHEN regexp_matches(lower(text), 'tensile|uts|ultimate') THEN 'tensile_strength' WHEN contains(lower(text), 'elong') THEN 'elongation'
 WHEN regexp_matches(lower(text), 'hardness|hrc|hbw') THEN 'hardness' WHEN contains(lower(text), 'pren') THEN 'pren' WHEN regexp_matches(lower(text), 'impact|charpy') THEN 'impact' WHEN regexp_matches(lower(text), 'temperature|anneal') THEN 'temperature'
 WHEN regexp_matches(lower(text), 'composition|carbon|chromium') THEN 'composition' ELSE 'other' END AS property FROM benchmark""")
def x13_claim_property(spark, d):
    return T(spark, d, "benchmark").select("item_id", X.claim_property(F.col("text")).alias("property"))


@query(rf"""WITH t AS (SELECT page_id, {TAGS} AS t FROM pages) SELECT page_id, length(t)::INT AS chars, len(regexp_extract_all(t, '\d+'))::INT AS numbers FROM t""")
def s2_page_texts(spark, d):
    return T(spark, d, "pages").select("page_id", strip_tags(F.col("html")).alias("t")).select("page_id", F.length("t").alias("chars"), count_of(F.col("t"), r"\d+").alias("numbers"))


@query(r"""WITH e AS (SELECT doc_id, coalesce(text, '') || ' Section ' || n_chars % 20 || '.' || doc_id % 10 || CASE WHEN doc_id % 2 = 0 THEN ' says 4.' || doc_id % 7 ELSE '' END AS t FROM documents), x AS (SELECT doc_id, list_concat(regexp_extract_all(t, '\b(?:section|clause|para(?:graph)?|subsection)\s*(\d+(?:\.\d+)+)', 1, 'i'),
 CASE WHEN regexp_matches(t, '\b(?:scope|about|says?|describes?|covers?|regarding|refers?\s+to|meaning\s+of|details?\s+of)\b', 'i') THEN list_filter(regexp_extract_all(t, '\b(\d+\.\d+(?:\.\d+)*)\b', 1), lambda v: coalesce(try_cast(split_part(v, '.', 1) AS INT), 100) < 100) ELSE [] END) AS r FROM e)
SELECT doc_id, list_sort(list_distinct(r)) AS refs FROM x WHERE len(r) > 0""")
def x2_section_refs(spark, d):
    n = lambda c, m: (F.col(c) % m).cast("string")
    t = F.concat(F.coalesce("text", F.lit("")), F.lit(" Section "), n("n_chars", 20), F.lit("."), n("doc_id", 10), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" says 4."), n("doc_id", 7))).otherwise(""))
    return T(spark, d, "documents").select("doc_id", F.array_sort(X.section_refs(t)).alias("refs")).where(F.size("refs") > 0)


@query("""WITH q AS (SELECT conv_id, turn, 'A' || (700 + conv_id % 12) AS code FROM conversations), i AS (SELECT 'A' || (700 + doc_id % 9) AS code, list_sort(list(DISTINCT doc_id)) AS docs FROM documents GROUP BY 1) SELECT conv_id, turn, docs AS documents FROM q LEFT JOIN i USING (code)""")
def x6_resolve_documents(spark, d):
    docs = T(spark, d, "documents").select("doc_id", F.concat(F.lit("A"), (F.col("doc_id") % 9 + 700).cast("string")).alias("name"))
    q = T(spark, d, "conversations").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("k"), F.concat(F.lit("yield per A"), (F.col("conv_id") % 12 + 700).cast("string")).alias("t"))
    return X.resolve_documents(q, "t", "k", X.code_index(docs, "doc_id", X.filename_codes(F.col("name")))).select("conv_id", "turn", "documents")


@query(r"""WITH u AS (SELECT doc_id, upper(coalesce(text, '')) AS t FROM documents) SELECT doc_id, coalesce(nullif(regexp_extract(t, '(A\d{3,4})(?:[^M\d]|$)', 1), ''), nullif(regexp_extract(t, '(?:API|SPEC)[\s-]+(?:SPEC\s+)?(\d{1,2}[A-Z]{1,4})', 1), ''), nullif(regexp_extract(t, '(\d{1,2}(?:CT|CRA|[A-Z]))', 1), '')) AS code FROM u""")
def x7_spec_code(spark, d):
    return T(spark, d, "documents").select("doc_id", X.spec_code(F.col("text")).alias("code"))


@query(r"""SELECT DISTINCT doc_id, 'short' AS code_type, lower(unnest(regexp_extract_all(coalesce(text, ''), '\bth[a-z]{2}\b', 0, 'i'))) AS code FROM documents UNION ALL SELECT DISTINCT doc_id, 'number', unnest(regexp_extract_all(coalesce(text, ''), '\b\d{2,3}\b')) FROM documents""")
def x12_entities(spark, d):
    return X.extract_codes(T(spark, d, "documents"), "text", ["doc_id"], {"short": [(r"\bth[a-z]{2}\b", 0)], "number": [(r"\b\d{2,3}\b", 0)]}, upper=False)


@query("""SELECT p_partkey AS standard, p_brand AS grade, 'size' AS property, p_size::VARCHAR AS value, p_size::DOUBLE AS low, p_size::DOUBLE AS high FROM part UNION ALL SELECT p_partkey, p_brand, 'band', p_size || '-' || (p_size + 5), p_size::DOUBLE, (p_size + 5)::DOUBLE FROM part""")
def s7_spec_facts(spark, d):
    size = F.col("p_size").cast("string")
    props = F.create_map(F.lit("size"), size, F.lit("band"), F.concat(size, F.lit("-"), (F.col("p_size") + 5).cast("string")))
    return S.spec_facts(T(spark, d, "part").select(F.col("p_partkey").alias("standard"), F.to_json(F.create_map("p_brand", props)).alias("grades")))


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, page, block_no, kind, title, has_footnotes, md5(block) AS digest FROM ab")
def d3_attach_footnotes(spark, d):
    blocks = D.paragraphs(semantic_pages(spark, d).where(F.length(F.trim("text")) >= 50), "text", ["doc_id", "page"])
    a = D.attach_footnotes(D.classify_blocks(blocks, "doc_id", "page", HEADERS), "doc_id", "page")
    return a.select("doc_id", "page", "block_no", "kind", "title", "has_footnotes", F.md5("block").alias("digest"))


@query(r"""WITH f AS (SELECT page_id, url, length(coalesce(html, '')) AS n FROM pages) SELECT page_id, CASE WHEN trim(coalesce(url, '')) = '' THEN 'no name' WHEN page_id % 5 = 0 THEN 'content type' WHEN n > 3000 THEN 'too large' WHEN page_id % 3 = 0 THEN 'not a pdf' END AS reason,
 CASE WHEN trim(coalesce(url, '')) <> '' AND page_id % 5 > 0 AND n <= 3000 AND page_id % 3 > 0 THEN '1000-' || regexp_replace(url, '[^a-zA-Z0-9.-]', '_', 'g') END AS storage_name FROM f""")
def s5_ingest_gate(spark, d):
    f = T(spark, d, "pages").select("page_id", F.col("url").alias("name"), F.length(F.coalesce("html", F.lit(""))).alias("length"), F.when(F.col("page_id") % 5 == 0, "text/html").otherwise("application/pdf").alias("content_type"), F.concat(F.when(F.col("page_id") % 3 == 0, "<html").otherwise("%PDF-"), "html").cast("binary").alias("content"), F.timestamp_seconds(F.lit(1)).alias("at"))
    return S.ingest_gate(f, 3000).select("page_id", "reason", "storage_name")


CASES = """b AS (SELECT item_id::VARCHAR AS id, text AS query, [left(text, 5), right(text, 4)] AS expected, CASE WHEN item_id % 2 = 0 THEN ['none'] END AS forbidden, 'c' || item_id % 3 AS category, CASE WHEN item_id % 5 > 0 THEN 'easy' END AS difficulty FROM benchmark)"""


@query(f"""WITH {CASES} SELECT 'cases' AS layout, * FROM b UNION ALL SELECT 'pairs', id, query, expected, NULL, NULL, difficulty FROM b UNION ALL SELECT 'stress', id, query, expected, NULL, NULL, difficulty FROM b UNION ALL SELECT 'prompts', id, query, NULL, NULL, category, difficulty FROM b""")
def s6_golden_cases(spark, d):
    """The benchmark nested into each of the four layouts, by source file, and read back as cases."""
    i, t = F.col("item_id"), F.col("text")
    values = {
        "id": i.cast("string"), "query": t, "question": t, "expectedPatterns": F.array(F.substring(t, 1, 5), F.expr("right(text, 4)")), "forbiddenPatterns": F.when(i % 2 == 0, F.array(F.lit("none"))),
        "category": F.concat(F.lit("c"), (i % 3).cast("string")), "difficulty": F.when(i % 5 > 0, "easy"),
    }
    values["expected_values"] = values["expectedPatterns"]
    fields = {"cases": ["id", "query", "expectedPatterns", "forbiddenPatterns", "category", "difficulty"], "pairs": ["id", "question", "expected_values", "difficulty"], "stress": ["id", "question", "expected_values", "difficulty"], "prompts": ["id", "query", "category", "difficulty"]}
    files, out = T(spark, d, "benchmark").groupBy((i % 4).alias("file")), None
    for layout, names in fields.items():
        rows = F.collect_list(F.struct(*[values[n].alias(n) for n in names]))
        top = {"cases": "testCases", "pairs": "qa_pairs", "prompts": "prompts"}.get(layout)
        raw = files.agg(rows.alias(top)) if top else files.agg(F.array(F.struct(rows.alias("queries"))).alias("datasets"))
        one = S.cases_of(raw, layout).select(F.lit(layout).alias("layout"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def new_folder(spark):
    """A new folder beside the written tables."""
    return f"{S.shared_folder(spark)}/store-{uuid.uuid4().hex}"


@query(f"SELECT doc_id, count(*) AS chunks, sum(length(content))::BIGINT AS chars FROM ({windows(1500, 200, False)}) GROUP BY 1")
def s9_chunk_store(spark, d):
    """Chunks appended to a store twice over, some of them again: each stays once."""
    path, chunks = new_folder(spark), D.window_chunks(T(spark, d, "documents"), "text", ["doc_id"])
    S.store_chunks(chunks.where("doc_id % 2 = 0"), path, ["doc_id"])
    S.store_chunks(chunks, path, ["doc_id"])
    return S.read_chunks(spark, path).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"))


@query("SELECT 'summary' AS part, 'all' AS name, count(*) AS n FROM events UNION ALL SELECT 'detail', event_type, count(*) FROM events GROUP BY 2")
def s11_report(spark, d):
    """A report written, its one-row summary and its detail read back."""
    path, e = new_folder(spark), T(spark, d, "events")
    S.write_report(e.agg(F.lit("all").alias("name"), F.count("*").alias("n")), e.groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n")), path)
    part = lambda p: spark.read.schema("name string, n long").json(f"{path}/{p}").select(F.lit(p).alias("part"), "name", "n")
    return part("summary").unionByName(part("detail"))
