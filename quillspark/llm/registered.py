"""Queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

import os
import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import ann_hilbert, bpe_dp, chat_format, decontaminate, html_text, license_scan, lm_mixing, max_sketch, merkle, ngram_join, quality_knn, token_count, toxicity


def tokenizer_path() -> str:
    """The vocabulary file used by the queries; operators take a path."""
    if d := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(d, "byte_bpe_50k.json")
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql("SELECT -7L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    part = F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units"))
    messages = given.unionByName(more).select("conv_id", "turn", "role", F.array(part).alias("parts"))
    back = chat_format.read_back(chat_format.format_conversations(messages))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("turns", lambda t: F.coalesce(t["under_loss"], F.lit(""))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )


OP1_SQL = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(role) + length(text) + length(regexp_replace(role || text, '[^\\<\[]', '', 'g'))
    + length('<|turn|>') + length('<|text|>') + length('<|end|>') + 1 AS chars
  FROM m)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op2_ann_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_hilbert.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "id % 20 = 0", 20)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_mixing.score_texts(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return toxicity.score_toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return quality_knn.score_quality(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.count_tokens(docs, tokenizer_path()).drop("text")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), "doc_id", "text", 3, 90, 100)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op10_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_dp.encode_texts(docs, tokenizer_path(), ids=False).drop("text")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = [F.translate("text", "\n", "") if c == "text" else F.col(c) for c in columns]
    return merkle.merkle_manifest(docs, columns, tampered=changed, where=F.crc32(F.col("doc_id").cast("string")) % 2 == 0)


def op12_max_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = max_sketch.build_index(table(spark, sf_dir, "documents"))
    return max_sketch.search(index, table(spark, sf_dir, "benchmark"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


LOWER_SQL = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

OP7_SQL = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
g AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw CROSS JOIN (SELECT DISTINCT n FROM p))),
h AS (SELECT doc_id, i, n, item FROM g JOIN p USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM dw LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP8_SQL = rf"""
WITH RECURSIVE dw AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWER_SQL}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM dw WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT r.doc_id, b FROM r JOIN e ON a = root)
SELECT r.doc_id, any_value(coalesce(n, 0))::BIGINT AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY 1
"""

OP11_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, {" || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars"))} AS head, text,
  list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)::UBIGINT[]), lambda c, _: xor(c >> 1, 3988292384::UBIGINT * (c & 1)))) AS crc FROM documents),
l AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN (xor(crc, 4294967295::UBIGINT) & 1) = 0 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS other FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
t AS (SELECT source, 0 AS l, pos, leaf AS h, n FROM p UNION ALL SELECT source, l + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY source, l, pos // 3, n),
s AS (SELECT source, l AS deep, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS l, pos, h, n FROM s UNION ALL SELECT l + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY l, pos // 3, n),
r AS (SELECT h AS root FROM u WHERE n = 1),
b AS (SELECT p.doc_id, p.source, p.pos AS leaf_no, p.leaf, t.l AS k, t.pos, t.h FROM p JOIN t ON t.source IS NOT DISTINCT FROM p.source AND t.n > 1 AND t.pos // 3 = (p.pos // (3 ** t.l)::BIGINT) // 3
  UNION ALL SELECT p.doc_id, p.source, p.pos, p.leaf, 1000 + u.l, u.pos, u.h FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source JOIN u ON u.n > 1 AND u.pos // 3 = (s.pos // (3 ** u.l)::BIGINT) // 3),
w AS (SELECT b.source, b.leaf_no, k, b.pos, b.h, b.pos = CASE WHEN k < 1000 THEN b.leaf_no // (3 ** k)::BIGINT ELSE s.pos // (3 ** (k - 1000))::BIGINT END AS own FROM b JOIN s ON s.source IS NOT DISTINCT FROM b.source),
g AS (SELECT source, leaf_no, list({{'a': a, 'b': b}} ORDER BY k) AS steps, string_agg(a || b, '' ORDER BY k) AS proof FROM
  (SELECT source, leaf_no, k, coalesce(string_agg(h, '' ORDER BY pos) FILTER (NOT own AND pos < mine), '') AS a, coalesce(string_agg(h, '' ORDER BY pos) FILTER (NOT own AND pos > mine), '') AS b FROM (SELECT *, max(pos) FILTER (own) OVER (PARTITION BY source, leaf_no, k) AS mine FROM w) GROUP BY source, leaf_no, k) GROUP BY source, leaf_no),
f AS (SELECT p.source, p.pos AS leaf_no, coalesce(other, leaf) AS h, coalesce(steps, []) AS steps FROM p LEFT JOIN g ON g.source IS NOT DISTINCT FROM p.source AND g.leaf_no = p.pos
  UNION ALL SELECT source, leaf_no, sha256(steps[1].a || h || steps[1].b), steps[2:] FROM f WHERE len(steps) > 0)
SELECT p.doc_id, leaf, s.h AS subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source CROSS JOIN r LEFT JOIN g ON g.source IS NOT DISTINCT FROM p.source AND g.leaf_no = p.pos JOIN f ON f.source IS NOT DISTINCT FROM p.source AND f.leaf_no = p.pos AND len(f.steps) = 0
"""

OP12_SQL = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT row_number() OVER () AS r, doc_id, w, len(w) AS n FROM dw WHERE len(w) > 0),
z AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM d),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY 1, 2),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY 1, 2),
qw AS (SELECT item_id, t, c * floor(1000 * ln((2 * big_n + 2) / (2 * df + 1)))::BIGINT AS w FROM q JOIN df USING (t) CROSS JOIN z),
m AS (SELECT r, doc_id, 100 - 25 + (25 * n * big_n) // big_l AS m FROM d CROSS JOIN z),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM qw JOIN tf USING (t) JOIN m USING (r) GROUP BY 1, 2, 3)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST, r)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_format, op2_ann_hilbert, op3_lm_scoring, op4_toxicity, op5_quality, op6_token_count, op7_decontaminate, op8_ngram_join, op9_license_scan, op10_bpe_encode, op11_merkle_manifest, op12_max_sketch, op13_html_text)
}
SQL: dict[str, str] = {"op1_chat_format": OP1_SQL, "op7_decontaminate": OP7_SQL, "op8_ngram_join": OP8_SQL, "op11_merkle_manifest": OP11_SQL, "op12_max_sketch": OP12_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
