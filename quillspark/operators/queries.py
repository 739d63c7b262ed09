"""Enrichment of a query log: every function takes a table of queries and adds columns, or gives rows where said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.functions import catalogues as cat
from quillspark.functions.text import BOUNDARY, cascade, find_all, has, has_any, hits
from quillspark.operators.extract import codes, section_refs


def validate_queries(q: DataFrame, text: str, least: int = 3, most: int = 2000, injections: list[str] | None = None) -> DataFrame:
    """``reason`` for which a query is turned away, else ``cleaned``. Lengths are those before cleaning."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    reason = cascade(
        [(F.col(text).isNull(), "not a string"), (F.length(t) < least, "too short"), (F.length(t) > most, "too long"), (has_any(t, cat.INJECTIONS if injections is None else injections), "invalid pattern")], F.lit(None).cast("string")
    )
    clean = F.regexp_replace(F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), r"\s+", " ")
    return q.withColumn("reason", reason).withColumn("cleaned", F.when(F.col("reason").isNull(), clean))


def expand_elements(c: Column, elements: dict[str, str] | None = None) -> Column:
    for name, symbol in (cat.ELEMENTS if elements is None else elements).items():
        c = F.regexp_replace(c, f"(?i){BOUNDARY}{name}{BOUNDARY}", f"{name} {symbol}")
    return c


def expand_synonyms(c: Column, synonyms: dict[str, list[str]] | None = None) -> Column:
    low = F.lower(c)
    more = [F.when(low.contains(t), F.lit(" ".join(s))) for t, s in (cat.SYNONYMS if synonyms is None else synonyms).items()]
    return F.concat_ws(" ", c, *more)


def expand_grades(q: DataFrame, key: str, text: str, grades: dict[str, str] | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """Append the designations of grades and the full names of abbreviations that aren't there yet, in order."""
    spark = q.sparkSession
    rows = [(k, v, 0) for k, v in (cat.GRADE_TO_UNS if grades is None else grades).items()] + [(k, v, 1) for k, v in (cat.ABBREVIATIONS if names is None else names).items()]
    table = spark.createDataFrame(rows, "word string, more string, kind int")
    words = q.select(key, F.lower(text).alias("low"), F.posexplode(F.split(F.lower(text), r"[\s,;?]+")).alias("i", "word"))
    found = words.join(F.broadcast(table), "word").where(~F.col("low").contains(F.lower("more")))
    first = found.groupBy(key, "more").agg(F.min(F.struct("kind", "i")).alias("at"))
    each = first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "more"))), lambda x: x["more"]), " ").alias("more"))
    return q.join(each.hint("merge"), key, "left").withColumn("expanded", F.concat_ws(" ", text, "more")).drop("more")


def enhance_queries(q: DataFrame, text: str, products: dict[str, str], expansions: dict[str, str]) -> DataFrame:
    """Append the product of each document named and the first expansion of each property named, where a query names a
    document, a property or a designation; ``strategies`` says what was done."""
    t = F.col(text)
    docs = [F.when(has(t, rf"\b{d}\b"), F.lit(p)) for d, p in products.items()]
    props = [F.when(F.lower(t).contains(w), F.lit(e)) for w, e in expansions.items()]
    return q.withColumn("enhanced", F.concat_ws(" ", t, *docs, *props)).withColumn("strategies", F.array_compact(F.array(F.when(F.coalesce(*docs, F.lit(None)).isNotNull(), "document"), F.when(F.coalesce(*props, F.lit(None)).isNotNull(), "property"))))


def search_weights(q: DataFrame, text: str, match: str = "substring", words: list[str] | None = None, catalogue=None) -> DataFrame:
    """Weights of lexical and vector search by the codes, references and property words of a query."""
    t = F.col(text)
    by = {k: F.size(codes(t, p)) > 0 for k, p in (catalogue or cat.CODES).items()}
    kinds = sum((b.cast("int") for b in by.values()), F.lit(0))
    words = cat.PROPERTY_WORDS if words is None else words
    prop = has_any(F.lower(t), words, False) if match == "substring" else has(t, r"\b(?:" + "|".join(words) + r")\b")
    refs = F.size(section_refs(t)) > 0
    boost = refs | prop
    for k, b in by.items():
        if k != "api":
            boost = boost | b
    lexical = cascade([(refs, 0.7), (kinds >= 2, 0.7), (kinds == 1, 0.6), (boost, 0.55)], 0.3)
    return q.withColumn("code_kinds", kinds).withColumn("boost", boost).withColumn("w_lexical", lexical).withColumn("w_vector", F.round(1 - F.col("w_lexical"), 2))


def query_complexity(q: DataFrame, text: str, entity: str = r"S\d{5}|A\d{3,4}") -> DataFrame:
    t = F.col(text)
    compares, lists, explains = (has(t, cat.COMPLEXITY[k]) for k in ("compares", "lists", "explains"))
    several = F.size(find_all(t, entity)) > 1
    direct = has(t, cat.COMPLEXITY["direct"]) & ~compares & ~lists
    short = F.size(F.split(t, r"\s+")) <= 10
    kind = cascade([(direct & short & ~several, "simple"), (compares | lists | several | explains, "complex")], "moderate")
    out = q.withColumn("complexity", kind)
    return out.withColumn("skip_decomposition", F.col("complexity") != "complex").withColumn("use_parallel", F.col("complexity") == "complex").withColumn("estimated_ms", cascade([(F.col("complexity") == "simple", 2000), (F.col("complexity") == "moderate", 4000)], 8000))


def needs_decomposition(c: Column) -> Column:
    low = F.lower(c)
    return has_any(low, cat.DECOMPOSED, False) | has(c, cat.JOINED)


def classify_intent(q: DataFrame, text: str, patterns: dict[str, list[str]] | None = None, grades=r"\bF\d{2,3}[A-Z]?\b", uns=r"\b(?:S|J)\d{5}\b", standards=r"\bA\d{3,4}(?:/A\d{3,4}M)?\b") -> DataFrame:
    """Intent with the most patterns (ties to the one named first) and confidence."""
    t = F.col(text)
    n = {k: F.size(F.array_distinct(F.transform(find_all(t, p), lambda x: F.lower(x)))) for k, p in (("g", grades), ("u", uns), ("s", standards))}
    score = {k: hits(t, ps) for k, ps in (cat.INTENTS if patterns is None else patterns).items()}
    if "comparison" in score:
        score["comparison"] = score["comparison"] + F.when((n["g"] >= 2) | (n["u"] >= 2), 2).otherwise(0)
    if "synthesis" in score:
        score["synthesis"] = score["synthesis"] + F.when(n["s"] >= 2, 1).otherwise(0)
    best = F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("intent")) for i, (k, s) in enumerate(score.items())]))
    entities = (n["g"] + n["u"] + n["s"]) > 0
    out = q.withColumn("best_", best)
    conf = F.when((F.col("best_.score") == 0) & entities, 0.5).otherwise(F.least(F.col("best_.score") / 3, F.lit(1.0)))
    return out.withColumn("intent", F.col("best_.intent")).withColumn("intent_score", F.col("best_.score")).withColumn("intent_confidence", conf).drop("best_")


#: Lexical and vector weights and rerank by intent.
CONFIGS = [("lookup", 0.7, 0.3, False), ("comparison", 0.5, 0.5, True), ("synthesis", 0.3, 0.7, True), ("explanation", 0.2, 0.8, False)]


def search_config(q: DataFrame, intent: str = "intent") -> DataFrame:
    table = q.sparkSession.createDataFrame(CONFIGS, f"{intent} string, w_lexical double, w_vector double, rerank boolean")
    return q.join(F.broadcast(table), intent, "left").na.fill(0.5, ["w_lexical", "w_vector"]).na.fill(False, ["rerank"])


def few_shot(q: DataFrame, key: str, intent: str, examples: DataFrame, order: str, n: int = 2, fallback: str = "lookup") -> DataFrame:
    """Up to n examples of each query's intent, or of the fallback intent where it has none."""
    top = examples.withColumn("r_", F.row_number().over(W.partitionBy("kind").orderBy(order))).where(F.col("r_") <= n)
    have = top.select(F.col("kind").alias(intent)).distinct()
    q = q.join(have.withColumn("have_", F.lit(True)), intent, "left")
    q = q.withColumn("kind", F.when(F.col("have_"), F.col(intent)).otherwise(F.lit(fallback))).drop("have_")
    return q.join(top, "kind").withColumnRenamed("r_", "example_no")


def dynamic_topk(c: Column) -> Column:
    return F.when((F.size(codes(c, cat.CODES["api"])) > 0) | (F.size(codes(c, cat.CODES["astm"])) >= 2), 8).otherwise(5)


def normalize_query(c: Column, strip_punctuation: bool = True) -> Column:
    out = F.regexp_replace(F.trim(F.lower(F.coalesce(c, F.lit("")))), r"\s+", " ")
    return F.regexp_replace(out, r"[?.!]+$", "") if strip_punctuation else out


def section_keywords(c: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(find_all(c, cat.SECTION_NAMED), *[F.when(has(c, p), F.array(*map(F.lit, ws))).otherwise(none) for p, ws in cat.SECTION_TOPICS])


def explode_subqueries(q: DataFrame, key: str, text: str, parts: Column, budget: int = 40) -> DataFrame:
    """A row for each sub-query with its share of the budget; the query itself where the list is missing or empty."""
    some = F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda p: F.trim(F.coalesce(p, F.lit(""))) != "")
    ps = F.when(F.size(some) > 0, some).otherwise(F.array(F.col(text)))
    return q.select(key, ps.alias("ps_")).select(key, F.ceil(F.lit(budget) / F.size("ps_")).cast("int").alias("budget"), F.posexplode("ps_").alias("sub_no", "subquery"))


