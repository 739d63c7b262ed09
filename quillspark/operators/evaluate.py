"""Evaluation of answers: pattern scores, paired systems, roll-ups, percentiles, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.functions import catalogues as cat
from quillspark.functions.text import BOUNDARY, cascade, clip, has_any
from quillspark.sources.corpus import written


#: Cases that are broadcast at most, and the tasks that a case's answers are spread over beyond that.
BROADCAST_CASES, SALTS = 10_000, 64


def _with_cases(answers: DataFrame, cases: DataFrame) -> DataFrame:
    """Answers beside their cases. Few cases may have all answers, so texts don't meet by case: cases are broadcast, or
    joined by salts of the texts where they are many."""
    if cases.limit(BROADCAST_CASES + 1).count() <= BROADCAST_CASES:
        return answers.join(cases.hint("broadcast"), "case_id")
    spread = cases.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return answers.withColumn("salt_", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int")).join(spread.hint("merge"), ["case_id", "salt_"]).drop("salt_")


def score_patterns(answers: DataFrame, cases: DataFrame, variant: str = "golden") -> DataFrame:
    """answers: case_id, text, false_refusal; cases: case_id, expected, forbidden, citations (arrays of patterns, the
    last of substrings). Passed with half the expected patterns, none forbidden and, in the golden variant, one of the
    citations where some are required; in the readiness variant also no false refusal. Case is ignored."""
    j = _with_cases(answers, cases)
    none = F.array().cast("array<string>")
    arr = lambda c: F.coalesce(F.col(c), none)
    match = lambda p: F.rlike(F.col("text"), F.concat(F.lit("(?iu)"), F.replace(p, F.lit(r"\b"), F.lit(BOUNDARY))))
    j = j.withColumn("matched", F.filter(arr("expected"), match)).withColumn("missed", F.array_except(arr("expected"), F.col("matched"))).withColumn("forbidden_hits", F.filter(arr("forbidden"), match))
    j = j.withColumn("cited", F.filter(arr("citations"), lambda c: F.contains(F.lower("text"), F.lower(c))))
    ok = (F.size("matched") >= 0.5 * F.size(arr("expected"))) & (F.size("forbidden_hits") == 0)
    if variant == "golden":
        ok = ok & ((F.size(arr("citations")) == 0) | (F.size("cited") > 0))
    elif variant == "readiness":
        ok = ok & ~F.coalesce("false_refusal", F.lit(False))
    return j.withColumn("passed", ok)


def source_accuracy(sources: DataFrame, expected: DataFrame, code: Column) -> DataFrame:
    """Whether the code of each answer's first source (answer_id, no, document) is the expected one."""
    first = sources.withColumn("r_", F.row_number().over(W.partitionBy("answer_id").orderBy("no"))).where("r_ = 1")
    return expected.join(first.select("answer_id", code.alias("code")), "answer_id", "left").withColumn("source_ok", F.coalesce(F.col("code") == F.col("expected_code"), F.lit(False)))


def numeric_accuracy(expected: Column, actual: Column, tolerance: float = 2.0) -> Column:
    """Share of expected values with an actual one within a percentage of them; null where none is expected."""
    near = F.filter(expected, lambda e: F.exists(actual, lambda a: F.abs(a - e) <= F.abs(e) * tolerance / 100))
    return F.when(F.size(expected) > 0, F.size(near) / F.size(expected))


def hallucination(text: Column, refusal_case: Column, forbidden_hits: Column, refusals: list[str] | None = None) -> Column:
    return F.when(refusal_case, ~has_any(text, cat.REFUSAL_ANSWERS if refusals is None else refusals)).otherwise(forbidden_hits > 0)


def citation_quality(sources: DataFrame) -> DataFrame:
    """By answer: pages right, offsets there, names there; their share in percent."""
    ok = lambda c: F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(False)).cast("int")
    g = sources.groupBy("answer_id").agg(ok((F.col("page") >= 1) & (F.col("page") == F.floor("page"))).alias("pages"), ok(F.col("char_offset_start").isNotNull() & F.col("char_offset_end").isNotNull()).alias("offsets"), ok(F.trim("document") != "").alias("names"))
    return g.withColumn("percent", (F.col("pages") + F.col("offsets") + F.col("names")) / 3 * 100)


def compare_systems(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Outcome of each query for system a beside baseline b (key, passed)."""
    j = a.select(key, F.col("passed").alias("a")).join(b.select(key, F.col("passed").alias("b")), key)
    kind = cascade([(F.col("a") & ~F.col("b"), "improvement"), (~F.col("a") & F.col("b"), "regression"), (F.col("a") & F.col("b"), "both correct")], "both wrong")
    return j.withColumn("outcome", kind)


def aggregate_metrics(results: DataFrame, p95: float = 0.95) -> DataFrame:
    """results: a, b, outcome, hallucinated, refusal_case, refused, citation_percent, latency_ms. All 0 when empty."""
    pct = lambda c: F.coalesce(100 * F.count_if(c) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0))
    out = results.agg(
        F.count("*").alias("n"), pct(F.col("a")).alias("accuracy_a"), pct(F.col("b")).alias("accuracy_b"), pct(F.col("hallucinated")).alias("hallucination"), F.count_if(F.col("refusal_case") & F.col("refused")).alias("refused"),
        F.coalesce(F.avg("citation_percent"), F.lit(0.0)).alias("citations"), F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("mean_ms"),
        *[F.count_if(F.col("outcome") == o).alias(o.replace(" ", "_")) for o in ("improvement", "regression", "both correct", "both wrong")],
    )
    tail = percentile_rank(results, [], "latency_ms", p95, "floor").select(F.col("percentile").alias("p95_ms"))
    return out.join(tail.agg(F.max("p95_ms").alias("p95_ms")), how="left", on=F.lit(True)).na.fill(0)


def category_letter(order: Column) -> Column:
    """Letters A, B, ... by place."""
    return F.char(F.lit(64) + order)


def breakdown(results: DataFrame, dims: list[str], passed: str) -> DataFrame:
    """Totals and passes of each value of each dimension by itself, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims], F.struct(F.lit("all").alias("dim"), F.lit(None).cast("string").alias("value"))))
    long = results.select(F.col(passed).alias("ok"), pairs.alias("p")).select("ok", "p.*")
    return long.groupBy("dim", "value").agg(F.count("*").alias("total"), F.count_if("ok").alias("passed"), (100 * F.count_if("ok") / F.count("*")).alias("percent"))


#: Size of a group's sketch (of KLL, whose places are off by about 2.3 in so many), how many times that is allowed for,
#: and groups whose bounds are broadcast at most.
SKETCH, ALLOWED, BROADCAST_GROUPS = 4096, 3, 10_000


def percentiles(df: DataFrame, by: list[str], value: str, ps: dict[str, float], convention: str = "floor") -> DataFrame:
    """Exact percentiles by group in two scans: n and a column for each name of ``ps``.

    floor: place floor(n p), the last at most; ceil: ceil(n p) - 1; offset: floor(n p), null if there is none. Places
    count from 0; nulls don't count, a null group is one. The first scan makes a sketch of each group, which says between
    which two values a place lies. The second counts what lies under, between and over the bounds, and keeps the values
    between them, each once with its count; only these are sorted. Where a sketch was off by more than is allowed for, its
    groups' places aren't found, and the second scan runs again with wider bounds, at last with none."""
    keyed = [f"k{i}_" for i in range(len(by))]
    d = df.where(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keyed, strict=True)], F.col(value).alias("v_"), F.col(value).cast("double").alias("x_"))
    groups = written(d.groupBy(*keyed).agg(F.count("*").alias("n"), F.kll_sketch_agg_double("x_", F.lit(SKETCH)).alias("sketch_")).where("n > 0"))
    how = "broadcast" if groups.count() <= BROADCAST_GROUPS else "merge"
    n = F.col("n")
    if convention == "ceil":
        place = lambda p: F.greatest(F.ceil(n * p) - 1, F.lit(0))
    else:
        place = lambda p: F.floor(n * p) if convention == "offset" else F.least(F.floor(n * p), n - 1)
    done = groups.select(*keyed, "n", *[place(p).alias(f"at{i}_") for i, p in enumerate(ps.values())])
    for slack in (ALLOWED * 2.3 / SKETCH, 10 * ALLOWED * 2.3 / SKETCH, 1.0):
        found = written(_between(d, groups, keyed, [(p, place(p)) for p in ps.values()], slack, how))
        if slack == 1.0 or found.where(" OR ".join(f"missed{i}_" for i in range(len(ps)))).isEmpty():
            break
    same = reduce(lambda a, c: a & done[c].eqNullSafe(found[c]), keyed, F.lit(True))
    out = done.join(found.hint(how), same)
    return out.select(*[done[k].alias(c) for c, k in zip(by, keyed, strict=True)], "n", *[F.col(f"p{i}_").alias(k) for i, k in enumerate(ps)])


def _between(d: DataFrame, groups: DataFrame, keyed: list[str], places: list[tuple[float, Column]], slack: float, how: str) -> DataFrame:
    """By group (NaN is the largest number) the values at the places (p0_, ...), and which of them don't lie within the sketch's bounds (missed0_, ...)."""
    # small groups are kept whole; in others a place is off n p by less than the slack
    end = lambda r, open_: F.when(F.lit(not 0 < r < 1) | (F.col("n") <= SKETCH), open_).otherwise(F.kll_sketch_get_quantile_double("sketch_", F.lit(min(max(r, 0.0), 1.0))))
    ends = [F.array(end(p - slack, F.lit(float("-inf"))), end(p + slack, F.lit(float("nan")))) for p, _ in places]
    places = [at for _, at in places]
    bounds = groups.select(*[F.col(k).alias(f"{k}b") for k in keyed], F.array(*ends).alias("ends_"))
    same = reduce(lambda a, c: a & d[c].eqNullSafe(bounds[f"{c}b"]), keyed, F.lit(True))
    j = d.join(bounds.hint(how), same) if keyed else d.crossJoin(F.broadcast(bounds))  # one row of bounds
    one = lambda i, k: F.col("ends_")[i][k]
    x, m = F.col("x_"), range(len(places))
    region = sum(((x >= one(i, 0)).cast("int") + (x > one(i, 1)).cast("int") for i in m), F.lit(0))
    inside = reduce(lambda a, b: a | b, [(x >= one(i, 0)) & (x <= one(i, 1)) for i in m])
    counts = written(j.groupBy(*keyed, region.alias("r_"), F.when(inside, F.col("v_")).alias("v_")).agg(F.count("*").alias("c_")))
    whole = counts.groupBy(*keyed, "r_").agg(F.sum("c_").alias("c_"))
    w = W.partitionBy(*keyed).orderBy("r_")
    before = whole.select(*[F.col(k).alias(f"{k}r") for k in keyed], F.col("r_").alias("rr_"), (F.sum("c_").over(w) - F.col("c_")).alias("from_"), F.sum("c_").over(W.partitionBy(*keyed)).alias("n"))
    same = reduce(lambda a, c: a & counts[c].eqNullSafe(before[f"{c}r"]), keyed, counts["r_"] == before["rr_"])
    ranked = counts.join(before.hint(how), same).withColumn("upto_", F.col("from_") + F.sum("c_").over(W.partitionBy(*keyed, "r_").orderBy("v_")))
    hit = lambda at: (at < F.col("upto_")) & (at >= F.col("upto_") - F.col("c_"))
    return ranked.groupBy(*keyed).agg(*[F.max(F.when(hit(at), F.col("v_"))).alias(f"p{i}_") for i, at in enumerate(places)], *[F.coalesce(F.bool_or(hit(at) & F.col("v_").isNull()), F.lit(False)).alias(f"missed{i}_") for i, at in enumerate(places)])


def percentile_rank(df: DataFrame, by: list[str], value: str, p: float, convention: str = "floor") -> DataFrame:
    """One percentile by group, as ``percentiles`` gives it."""
    return percentiles(df, by, value, {"percentile": p}, convention).select(*by, "n", "percentile")


def judge_metrics(labels: DataFrame, by: list[str]) -> DataFrame:
    """labels: supported (of a claim), relevant (of a chunk), covered (of a statement), each null where it is no such
    thing. Without claims faithfulness is 1, without chunks precision is 0, without statements recall is null."""
    share = lambda c, none: F.coalesce(F.avg(F.col(c).cast("int").cast("double")), none)
    g = labels.groupBy(*by).agg(share("supported", F.lit(1.0)).alias("faithfulness"), share("relevant", F.lit(0.0)).alias("precision"), share("covered", F.lit(None).cast("double")).alias("recall"), clip(F.coalesce(F.avg("relevancy"), F.lit(0.0)), 0, 1).alias("relevancy"))
    return g.withColumn("hallucination", 1 - F.col("faithfulness"))


def composite(faithfulness: Column, relevancy: Column, precision: Column, recall: Column) -> Column:
    """Weights 0.3, 0.3, 0.2 and 0.2, spread over the others where recall is null."""
    base = 0.3 * faithfulness + 0.3 * relevancy + 0.2 * precision
    return F.when(recall.isNull(), base / 0.8).otherwise(base + 0.2 * recall)


def judge_summary(metrics: DataFrame, category: str) -> DataFrame:
    return metrics.rollup(category).agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in ("faithfulness", "relevancy", "precision", "recall")])


def verdict(metrics: DataFrame, target: float = 90.0) -> DataFrame:
    """metrics: accuracy, hallucination, citations in percent."""
    advice = F.array_compact(F.array(F.when(F.col("accuracy") < target, "raise accuracy"), F.when(F.col("hallucination") > 5, "lower hallucination"), F.when(F.col("citations") < 95, "complete citations")))
    return metrics.select(*[F.round(c, 1).alias(c) for c in ("accuracy", "hallucination", "citations")], F.when(F.col("accuracy") >= target, "PASS").otherwise("FAIL").alias("verdict"), advice.alias("recommendations"))


#: metric, target, whether more is better, whether it is in the gate of the larger suite.
TARGETS = [("accuracy", 75.0, True, True), ("source", 80.0, True, False), ("p95_ms", 10_000.0, False, True), ("false_refusals", 0.0, False, True), ("forbidden", 0.0, False, True)]


def readiness(long: DataFrame, targets: list[tuple] | None = None, all_in_gate: bool = False) -> DataFrame:
    """long: metric, value. Each metric against its target, and whether all that gate are met."""
    t = long.sparkSession.createDataFrame(TARGETS if targets is None else targets, "metric string, target double, more boolean, gates boolean")
    j = long.join(F.broadcast(t), "metric")
    met = F.when(F.col("more"), F.col("value") >= F.col("target")).otherwise(F.when(F.col("metric") == "p95_ms", F.col("value") < F.col("target")).otherwise(F.col("value") <= F.col("target")))
    j = j.withColumn("met", met)
    gate = F.lit(True) if all_in_gate else F.col("gates")
    return j.withColumn("ready", F.bool_and(F.col("met") | ~gate).over(W.partitionBy()))


def failures(scored: DataFrame) -> DataFrame:
    """What fails and why: the first two patterns missed, forbidden ones, a false refusal."""
    why = F.concat_ws("; ", F.when(F.size("missed") > 0, F.concat(F.lit("missed: "), F.array_join(F.slice("missed", 1, 2), ", "))), F.when(F.size("forbidden_hits") > 0, F.concat(F.lit("forbidden: "), F.array_join("forbidden_hits", ", "))), F.when(F.coalesce("false_refusal", F.lit(False)), "false refusal"))
    return scored.where(~F.col("passed")).select("case_id", why.alias("why"))


def kpi_report(results: DataFrame, difficulties: list[str]) -> DataFrame:
    """By difficulty, all of those given always shown: totals, accuracy, mean time, sources an answer."""
    want = results.sparkSession.createDataFrame([(d,) for d in difficulties], "difficulty string")
    g = results.groupBy("difficulty").agg(F.count("*").alias("n"), F.avg(F.col("passed").cast("int")).alias("accuracy"), F.avg("latency_ms").alias("mean_ms"), F.avg("sources").alias("sources"))
    return want.join(g, "difficulty", "left").na.fill(0)


def confusion(df: DataFrame, expected: str, actual: str, values: list) -> DataFrame:
    return df.groupBy(expected).pivot(actual, values).count().na.fill(0)


def score_values(answers: DataFrame, cases: DataFrame) -> DataFrame:
    """answers: case_id, text, is_refusal; cases: case_id, values array, number, expect_refusal. Share of expected
    values present, the number present, refusal as expected."""
    j = answers.join(cases, "case_id")
    low = F.lower("text")
    share = F.when(F.size("values") > 0, F.size(F.filter("values", lambda v: F.contains(low, F.lower(v)))) / F.size("values"))
    return j.withColumn("share", share).withColumn("number_ok", F.when(F.col("number").isNotNull(), F.contains(low, F.col("number").cast("string")))).withColumn("refusal_ok", F.col("is_refusal") == F.coalesce("expect_refusal", F.lit(False)))


def case_stats(cases: DataFrame, dims: list[str], tags: str) -> DataFrame:
    parts = [cases.select(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims] + [cases.select(F.lit("tag").alias("dim"), F.explode(F.col(tags).cast("array<string>")).alias("value"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("dim", "value").agg(F.count("*").alias("n"))


def smoke_summary(results: DataFrame, by: list[str]) -> DataFrame:
    return results.groupBy(*by).agg(F.count("*").alias("n"), (100 * F.avg(F.col("passed").cast("int"))).alias("pass_rate"), F.coalesce(F.avg(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))), F.lit(0.0)).alias("mean_ms"))
