"""User feedback: cleaning, report tables, root causes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.functions.text import cascade, has

RATINGS, ISSUES = ["correct", "partial", "incorrect"], ["false_refusal", "wrong_source", "hallucination", "wrong_data", "missing_info", "other"]


def clean_feedback(df: DataFrame, ratings: list[str] | None = None, issues: list[str] | None = None) -> DataFrame:
    """``reason`` for which a row is turned away; texts cut to 2000, 10000, 1000 and 100 characters."""
    missing = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    bad_issue = F.col("issue_type").isNotNull() & ~F.col("issue_type").isin(issues or ISSUES)
    reason = cascade([(missing("query"), "no query"), (missing("response"), "no response"), (missing("rating"), "no rating"), (~F.col("rating").isin(ratings or RATINGS), "bad rating"), (bad_issue, "bad issue")], F.lit(None).cast("string"))
    cut = {"query": 2000, "response": 10000, "comment": 1000, "flagged_by": 100}
    return df.withColumn("reason", reason).withColumns({c: F.substring(c, 1, n) for c, n in cut.items() if c in df.columns})


def recent_feedback(df: DataFrame, order: str, tie: str, condition: Column | None = None, limit: int = 50) -> DataFrame:
    """Newest rows first; the limit (200 at most) is the feature."""
    return (df if condition is None else df.where(condition)).orderBy(F.desc(order), tie).limit(min(limit, 200))


def rating_summary(df: DataFrame, rating: str) -> DataFrame:
    n = df.groupBy(rating).agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.floor(100 * F.col("n") / F.sum("n").over(W.partitionBy()) + 0.5).cast("int"))


def issue_breakdown(df: DataFrame, issue: str) -> DataFrame:
    return df.where(F.col(issue).isNotNull()).groupBy(issue).agg(F.count("*").alias("n")).orderBy(F.desc("n"), issue)


def root_cause(issue: Column, response: Column, grounding: Column, retrieval: Column, overall: Column) -> Column:
    """First cause that fits; a missing sub-score counts as 0, a missing overall score as unknown."""
    g, r = F.coalesce(grounding, F.lit(0)), F.coalesce(retrieval, F.lit(0))
    return cascade(
        [
            (F.coalesce(issue == "false_refusal", F.lit(False)) | has(response, "I cannot (provide|answer|find)"), "FALSE_REFUSAL"),
            (issue == "wrong_source", "WRONG_SOURCE"), (issue == "hallucination", "HALLUCINATION"), ((issue == "wrong_data") & (g > 80), "WRONG_DATA_GROUNDED"), (issue == "wrong_data", "WRONG_DATA"),
            ((issue == "missing_info") & (r < 50), "MISSING_INFO_RETRIEVAL"), (issue == "missing_info", "MISSING_INFO"), (overall < 40, "LOW_CONFIDENCE"),
        ],
        "UNKNOWN",
    )


def failure_detail(df: DataFrame, rating: str, query: str, response: str, sources: Column, good: str = "correct") -> DataFrame:
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(F.col(c))
    return df.where(F.col(rating) != good).withColumns({query: cut(query, 100), response: cut(response, 150), "source_list": F.array_join(sources, ", ")})


def recommendations(df: DataFrame, response: str, issue: str, retrieval: str) -> DataFrame:
    """How many rows call for each remedy; those that none calls for don't appear."""
    n = df.agg(
        F.count_if(F.coalesce(F.col(issue) == "false_refusal", F.lit(False)) | has(F.col(response), "I cannot|not (?:available|found)|unable to")).alias("anti_refusal"),
        F.count_if(F.col(issue) == "wrong_source").alias("document_mapping"), F.count_if(F.col(issue) == "hallucination").alias("grounding"), F.count_if(F.col(retrieval) < 40).alias("retrieval"),
    )
    return n.unpivot([], ["anti_refusal", "document_mapping", "grounding", "retrieval"], "remedy", "n").where("n > 0")
