"""Verification of answers against their sources: tables of answers, sources and claims in, verdicts out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.functions import catalogues as cat
from quillspark.functions.text import bound, cascade, clip, find_all, has, has_any, pattern
from quillspark.operators.extract import quantities
from quillspark.sources.corpus import written


def ground_answers(answers: DataFrame, sources: DataFrame, patterns: list | None = None, tolerance: float = 0.01, passing: int = 50) -> DataFrame:
    """Share of an answer's quantities that its sources have. answers, sources: answer_id, text.

    A quantity is grounded by a source quantity within the tolerance; else, if above 10 or not whole, by its number
    standing in a source. Without quantities the score is 70. Each text is scanned once for quantities; the quantities
    and numbers of an answer's sources meet the answer as arrays in one join."""
    q = answers.select("answer_id", quantities(F.col("text"), patterns).alias("q"))
    found = sources.select("answer_id", F.transform(quantities(F.col("text"), patterns), lambda x: x["value"]).alias("sv"), F.array_distinct(find_all(F.col("text"), r"\b\d+(?:\.\d+)?\b")).alias("nb"))
    found = found.groupBy("answer_id").agg(F.array_distinct(F.flatten(F.collect_list("sv"))).alias("sv"), F.array_distinct(F.flatten(F.collect_list("nb"))).alias("nb"))
    q = q.groupBy("answer_id").agg(F.flatten(F.collect_list("q")).alias("q")).join(found.hint("merge"), "answer_id", "left")
    shown = lambda v: F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(F.format_string("%.2f", v))
    near = lambda v: F.exists("sv", lambda x: F.abs(v - x) < tolerance)
    bare = lambda v: ((v > 10) | (v != F.floor(v))) & F.array_contains("nb", shown(v))
    ok = lambda x: F.coalesce(near(x["value"]) | bare(x["value"]), F.lit(False))
    out = q.withColumn("n", F.size("q").cast("long")).withColumn("bad_", F.filter("q", lambda x: ~ok(x)))
    out = out.select("answer_id", "n", (F.col("n") - F.size("bad_")).alias("grounded"), F.array_sort(F.transform("bad_", lambda x: F.struct(x["value"].alias("value"), x["unit"].alias("unit")))).alias("ungrounded"))
    out = out.withColumn("score", F.when(F.col("n") == 0, 70).otherwise(F.floor(100 * F.col("grounded") / F.col("n") + 0.5)).cast("int"))
    return out.withColumn("passed", F.col("score") >= passing)


def ground_by_topic(answers: DataFrame, sources: DataFrame, patterns: list | None = None, tolerance: float = 0.01, passing: int = 50) -> DataFrame:
    """``ground_answers`` where many answers share their sources: answers (answer_id, topic, text), sources (topic, text).

    A topic's values are never on one row. Different values of answers and of sources meet by topic and bucket of value,
    twice the tolerance wide, so a value looks into its bucket and the two beside it; numbers meet by topic and number.
    Either join only says whether there is a match, and hot topics are spread by their values. An answer of a topic
    without sources is grounded in nothing; a null topic has none."""
    q = written(answers.select("answer_id", "topic", F.posexplode_outer(quantities(F.col("text"), patterns)).alias("no", "q")).select("answer_id", "topic", "q.value", "q.unit", F.col("no").isNotNull().alias("is")))
    width, shown = 2 * tolerance, F.when(F.col("value") == F.floor("value"), F.floor("value").cast("string")).otherwise(F.format_string("%.2f", F.col("value")))
    asked = q.where("is").select("topic", "value").distinct()
    had = sources.select("topic", F.explode(F.array_distinct(F.transform(quantities(F.col("text"), patterns), lambda x: x["value"]))).alias("has")).distinct()
    had = had.select("topic", "has", F.floor(F.col("has") / width).alias("bucket"))
    near = asked.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("value") / width) - 1, F.floor(F.col("value") / width) + 1)))
    had = had.select(F.col("topic").alias("t_"), "has", F.col("bucket").alias("b_"))
    near = near.join(had.hint("merge"), (F.col("topic") == F.col("t_")) & (F.col("bucket") == F.col("b_")) & (F.abs(F.col("value") - F.col("has")) < tolerance), "left_semi").select("topic", "value")
    numbers = sources.select("topic", F.explode(F.array_distinct(find_all(F.col("text"), r"\b\d+(?:\.\d+)?\b"))).alias("shown")).distinct()
    bare = asked.where((F.col("value") > 10) | (F.col("value") != F.floor("value"))).withColumn("shown", shown).join(numbers.hint("merge"), ["topic", "shown"], "left_semi").select("topic", "value")
    good = near.unionByName(bare).distinct().select("topic", "value", F.lit(True).alias("ok"))
    j = q.join(good.hint("merge"), ["topic", "value"], "left")
    out = j.groupBy("answer_id").agg(F.count_if("is").alias("n"), F.count_if(F.col("is") & F.coalesce("ok", F.lit(False))).alias("grounded"))
    out = out.withColumn("score", F.when(F.col("n") == 0, 70).otherwise(F.floor(100 * F.col("grounded") / F.col("n") + 0.5)).cast("int"))
    return out.withColumn("passed", F.col("score") >= passing)


CLAIM = "struct<answer:string,claims:array<struct<claim:string,source_ref:string,exact_quote:string,confidence:string,numerical_values:array<struct<value:string,unit:string,property:string>>>>>"


def parse_structured(answers: DataFrame, text: str) -> DataFrame:
    """Claims of an answer: of the JSON object in it, else of its paragraphs that cite a source."""
    j = F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), CLAIM)
    paras = F.filter(F.split(text, r"\n\n+"), lambda p: p.rlike(r"\[\d+\]"))
    rough = F.transform(paras, lambda p: F.struct(F.substring(p, 1, 200).alias("claim"), F.regexp_extract(p, r"\[\d+\]", 0).alias("source_ref"), F.lit("").alias("exact_quote"), F.lit("low").alias("confidence"), F.array().cast("array<struct<value:double,unit:string,property:string>>").alias("numerical_values")))
    level = lambda c: F.when(F.lower(c).isin("high", "medium", "low"), F.lower(c)).otherwise("medium")
    number = lambda v: F.coalesce(F.regexp_extract(v, r"^\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(0.0))
    nums = lambda c: F.transform(F.coalesce(c["numerical_values"], F.array().cast("array<struct<value:string,unit:string,property:string>>")), lambda v: F.struct(number(v["value"]).alias("value"), F.coalesce(v["unit"], F.lit("")).alias("unit"), F.coalesce(v["property"], F.lit("")).alias("property")))
    given = F.transform(j["claims"], lambda c: F.struct(F.coalesce(c["claim"], F.lit("")).alias("claim"), F.coalesce(c["source_ref"], F.lit("[?]")).alias("source_ref"), F.coalesce(c["exact_quote"], F.lit("")).alias("exact_quote"), level(c["confidence"]).alias("confidence"), nums(c).alias("numerical_values")))
    ok = j["answer"].isNotNull()
    return answers.withColumn("structured", ok).withColumn("answer", F.when(ok, j["answer"]).otherwise(F.col(text))).withColumn("claims", F.when(ok, F.coalesce(given, F.slice(rough, 1, 0))).otherwise(rough))


def plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\w\s]", " "), r"\s+", " "))


def quote_match(quote: Column, source: Column) -> Column:
    """0 to 100: contained; else for long quotes the share of their words in the source, for short ones by edits."""
    q, s = plain(quote), plain(source)
    words = F.array_distinct(F.filter(F.split(q, " "), lambda w: F.length(w) > 2))
    share = F.when(F.size(words) > 0, F.floor(100 * F.size(F.array_intersect(words, F.split(s, " "))) / F.size(words) + 0.5)).otherwise(0)
    edits = F.levenshtein(F.substring(q, 1, 200), F.substring(s, 1, 200))
    return F.when(s.contains(q), 100).when(F.length(q) > 50, share).otherwise(F.greatest(F.lit(0), F.floor(100.5 - 100 * edits / F.length(q)))).cast("int")


def verify_claims(claims: DataFrame, sources: DataFrame, least: int = 60, tolerance: float = 0.01) -> DataFrame:
    """claims: answer_id, claim_no, source_ref, exact_quote, numbers array<double>; sources: answer_id, ref, content."""
    nums = F.transform(F.coalesce(find_all(F.col("content"), r"\d+(?:\.\d+)?"), F.array().cast("array<string>")), lambda x: x.cast("double"))
    j = claims.join(sources.select("answer_id", F.col("ref").alias("source_ref"), "content").hint("merge"), ["answer_id", "source_ref"], "left").withColumn("found", F.col("content").isNotNull())
    j = j.withColumn("quote_score", F.when(~F.col("found"), 0).when(F.coalesce("exact_quote", F.lit("")) == "", 100).otherwise(quote_match(F.col("exact_quote"), F.col("content"))))
    ok = F.forall(F.coalesce("numbers", F.array().cast("array<double>")), lambda n: F.exists(nums, lambda x: F.abs(x - n) < tolerance))
    j = j.withColumn("numbers_ok", F.col("found") & ok).withColumn("verified", F.col("found") & (F.col("quote_score") >= least) & F.col("numbers_ok"))
    note = cascade([(~F.col("found"), "source not found"), (F.col("quote_score") < least, "quote not in source"), (~F.col("numbers_ok"), "number not in source")], F.lit(None).cast("string"))
    return j.withColumn("discrepancy", note).drop("content")


def verification_summary(results: DataFrame, passing: float = 70.0) -> DataFrame:
    """By answer: rates of verified claims and of numeric claims (100 where there are none), confidence, verdict."""
    numeric = F.size(F.coalesce("numbers", F.array().cast("array<double>"))) > 0
    g = results.groupBy("answer_id").agg(F.count("claim_no").alias("claims"), F.count_if("verified").alias("verified"), F.count_if(numeric).alias("numeric"), F.count_if(numeric & F.col("numbers_ok")).alias("numeric_ok"))
    rate = lambda a, b: F.when(F.col(b) == 0, 100.0).otherwise(100 * F.col(a) / F.col(b))
    g = g.withColumn("claim_rate", rate("verified", "claims")).withColumn("number_rate", rate("numeric_ok", "numeric"))
    raw = 0.6 * F.col("claim_rate") + 0.4 * F.col("number_rate")
    return g.withColumn("confidence", F.floor(raw + 0.5).cast("int")).withColumn("passed", (raw >= passing) & (F.col("numeric") == F.col("numeric_ok")))


def guardrail(summary: DataFrame, refuse_below: int = 30) -> DataFrame:
    action = cascade([(F.col("passed"), "return"), (F.col("confidence") < refuse_below, "refuse")], "regenerate")
    return summary.withColumn("action", action)


def refusals(answers: DataFrame, text: str, relevant: Column, full: list[str] | None = None, partial: list[str] | None = None) -> DataFrame:
    f = has_any(F.col(text), cat.FULL_REFUSALS if full is None else full)
    p = has_any(F.col(text), cat.PARTIAL_REFUSALS if partial is None else partial)
    return answers.withColumn("refusal", f).withColumn("partial_refusal", ~f & p).withColumn("false_refusal", f & F.coalesce(relevant, F.lit(False)))


def rebuild(text: Column, p: str, new: Column) -> Column:
    """Text with each occurrence of a pattern replaced by the entry of ``new`` for it, all at once."""
    joined = lambda cut, ws: F.array_join(F.transform(cut, lambda x, i: F.concat(x, F.coalesce(F.get(ws, i), F.lit("")))), "")
    return bound(F.split(text, p, -1), lambda cut: bound(new, lambda ws: joined(F.slice(cut, 1, F.size(ws) + 1), ws)))


def remap_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Renumber references after sources of one (document, page) are merged; unknown references go.

    answers: answer_id, text; sources: answer_id, no, document, page. All are mapped at once, so a new number is never
    mapped again."""
    w = W.partitionBy("answer_id")
    s = sources.withColumn("first", F.min("no").over(W.partitionBy("answer_id", "document", "page"))).withColumn("new", F.dense_rank().over(w.orderBy("first")))
    m = s.groupBy("answer_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("no").cast("string").alias("k"), F.col("new").cast("string").alias("v"))))).alias("m"), F.max("new").alias("n_sources"))
    refs = find_all(F.col("text"), r"\[(\d+)\]", 1)
    j = answers.join(m.hint("merge"), "answer_id", "left")
    new = F.transform(refs, lambda r: F.coalesce(F.concat(F.lit("["), F.try_element_at(F.coalesce("m", F.create_map().cast("map<string,string>")), r), F.lit("]")), F.lit("")))
    return j.withColumn("text", rebuild(F.col("text"), r"\[\d+\]", new)).drop("m")


def validate_citations(sources: DataFrame) -> DataFrame:
    """sources: ref, document, page double, char_offset_start, char_offset_end, document_url, content_preview."""
    e = F.array_compact(F.array(
        F.when(~has(F.col("ref"), r"^\[\d+\]$"), "bad ref"), F.when(F.trim(F.coalesce("document", F.lit(""))) == "", "no document"), F.when(~F.coalesce((F.col("page") >= 1) & (F.col("page") == F.floor("page")), F.lit(False)), "bad page"),
        F.when(F.col("char_offset_start") >= F.col("char_offset_end"), "bad offsets"), F.when(F.col("document_url").isNotNull() & ~F.col("document_url").rlike("^https?://"), "bad url"),
    ))
    w = F.array_compact(F.array(
        F.when(~F.lower(F.coalesce("document", F.lit(""))).endswith(".pdf"), "not a pdf"), F.when(F.col("page") > 100, "high page"), F.when(F.col("char_offset_start").isNull() | F.col("char_offset_end").isNull(), "no offsets"),
        F.when(F.col("document_url").isNull(), "no url"), F.when(F.length(F.coalesce("content_preview", F.lit(""))) < 10, "short preview"),
    ))
    return sources.withColumn("errors", e).withColumn("warnings", w).withColumn("valid", F.size("errors") == 0)


def citation_consistency(text: Column, refs: Column) -> Column:
    """struct<missing, unused, consistent> of the references of a text and of its sources."""
    used = F.array_distinct(find_all(text, r"\[\d+\]"))
    have = F.array_distinct(F.coalesce(refs, F.array().cast("array<string>")))
    missing, unused = F.array_sort(F.array_except(used, have)), F.array_sort(F.array_except(have, used))
    return F.struct(missing.alias("missing"), unused.alias("unused"), ((F.size(missing) == 0) & (F.size(unused) == 0)).alias("consistent"))


def citation_rate(valid: DataFrame, least: float = 95.0) -> DataFrame:
    return valid.agg(F.count("*").alias("n"), F.coalesce(100 * F.avg(F.col("valid").cast("int")), F.lit(0.0)).alias("rate")).withColumn("passed", F.col("rate") >= least)


def confidence(df: DataFrame, least: int = 55) -> DataFrame:
    """Blend of retrieval, grounding and coherence scores (0 to 100), the gate, and what to look at."""
    # in hundredths, so that halves are exact
    c = F.floor((35 * F.col("retrieval") + 25 * F.col("grounding") + 40 * F.col("coherence") + 50) / 100).cast("int")
    guide = cascade([(F.col("retrieval") < 50, "retrieval"), (F.col("grounding") < 50, "grounding"), (F.col("coherence") < 50, "coherence")], "general")
    return df.withColumn("overall", c).withColumn("gate", F.col("overall") < least).withColumn("guidance", F.when(F.col("gate"), guide))


def normalize_judgement(score: Column, kind: str, chunks: Column | None = None, passing: int = 60) -> Column:
    """struct<score, passed>: clamped; missing counts as 70 for coherence and 50 for retrieval; no chunks as 0."""
    s = clip(F.coalesce(score.cast("double"), F.lit(70.0 if kind == "coherence" else 50.0)), 0, 100)
    if chunks is not None:
        s = F.when(chunks == 0, 0.0).otherwise(s)
    return F.struct(s.alias("score"), (s >= passing).alias("passed"))


def standardize_units(c: Column) -> Column:
    """'x ksi' and 'x °F' with the metric value in brackets, where no bracket follows."""
    for p, unit, value in ((r"(\d+(?:\.\d+)?)\s*ksi(?!\s*[\[(])", "MPa", lambda v: F.floor(v * 6.895 + 0.5)), (r"(\d+(?:\.\d+)?)\s*°F(?!\s*[\[(])", "°C", lambda v: F.floor((v - 32) * 5 / 9 + 0.5))):
        found, nums = find_all(c, p), find_all(c, p, 1)
        new = _with_unit(found, nums, value, unit)
        c = rebuild(c, pattern(p, True), new)
    return c


def _with_unit(found: Column, nums: Column, value, unit: str) -> Column:
    return F.zip_with(found, nums, lambda f, n: F.concat(f, F.lit(" ["), value(n.cast("double")).cast("string"), F.lit(f" {unit}]")))


def refinement_warnings(text: Column, n_sources: Column) -> Column:
    cited = F.transform(find_all(text, r"\[(\d+)\]", 1), lambda x: x.cast("int"))
    return F.array_compact(F.array(F.when(F.exists(cited, lambda x: (x < 1) | (x > n_sources)), "unknown source cited"), F.when(has(text, "cannot answer") & (F.size(cited) > 0), "refusal with citations")))


def support_claims(claims: DataFrame, sources: DataFrame, least: float = 0.85) -> DataFrame:
    """claims: answer_id, claim_no, claim; sources: answer_id, source_no, content. The first source that has more than
    ``least`` of a claim's words (longer than three letters; of all its words), null if none."""
    c = claims.select("answer_id", "claim_no", F.split(F.trim(F.lower("claim")), r"\s+").alias("ws"))
    s = sources.select("answer_id", "source_no", F.lower("content").alias("t"))
    share = F.size(F.filter("ws", lambda w: (F.length(w) > 3) & F.contains("t", w))) / F.size("ws")
    hit = c.join(s.hint("merge"), "answer_id").select("answer_id", "claim_no", "source_no", share.alias("share")).where(F.col("share") > least)
    first = hit.groupBy("answer_id", "claim_no").agg(F.min(F.struct("source_no", "share")).alias("f")).select("answer_id", "claim_no", "f.source_no", "f.share")
    return claims.select("answer_id", "claim_no").join(first.hint("merge"), ["answer_id", "claim_no"], "left").withColumn("supported", F.col("source_no").isNotNull())


def best_window(text: Column, claim: Column, width: int = 100, step: int = 1) -> Column:
    """struct<score, start, window>: the first window with most of the claim's words (longer than three letters)."""
    ws = F.array_distinct(F.filter(F.split(F.lower(claim), r"\s+"), lambda w: F.length(w) > 3))
    low = F.lower(text)
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - width, F.lit(0)), F.lit(step))
    scored = F.transform(starts, lambda s: F.struct(F.size(F.filter(ws, lambda w: F.contains(low.substr(s + 1, F.lit(width)), w))).alias("score"), (-s).alias("s")))
    best = F.array_max(scored)
    return F.struct(best["score"].alias("score"), (-best["s"]).alias("start"), text.substr(1 - best["s"], F.lit(width)).alias("window"))


def answer_flags(answers: DataFrame, text: str, expected_refusal: Column, refusal: list[str] | None = None) -> DataFrame:
    r = has_any(F.col(text), cat.REFUSAL_ANSWERS if refusal is None else refusal)
    return answers.withColumn("has_citation", has(F.col(text), r"\[\d+\]")).withColumn("is_refusal", r).withColumn("false_refusal", r & ~expected_refusal)
