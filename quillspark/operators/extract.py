"""Codes, references, keywords and quantities in texts; every function takes a table and returns one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.functions import catalogues as cat
from quillspark.functions.text import bound, cascade, find_all, has, has_any, pattern

Catalogue = dict[str, list[tuple[str, int]]]


def codes(c: Column, patterns: list[tuple[str, int]], upper: bool = True) -> Column:
    """Distinct codes in a text, in order of pattern and place."""
    found = F.flatten(F.array(*[find_all(c, p, g) for p, g in patterns]))
    return F.array_distinct(F.transform(found, lambda x: F.upper(x) if upper else F.lower(x)))


def extract_codes(df: DataFrame, text: str, keys: list[str], catalogue: Catalogue | None = None, upper: bool = True) -> DataFrame:
    """A row for each distinct (keys, code_type, code)."""
    kinds = [F.struct(F.lit(k).alias("code_type"), codes(F.col(text), p, upper).alias("codes")) for k, p in (catalogue or cat.CODES).items()]
    long = df.select(*keys, F.explode(F.array(*kinds)).alias("k"))
    return long.select(*keys, "k.code_type", F.explode("k.codes").alias("code"))


def pivot_codes(df: DataFrame, text: str, catalogue: Catalogue | None = None) -> DataFrame:
    """An array column for each kind of code."""
    return df.withColumns({k: codes(F.col(text), p) for k, p in (catalogue or cat.CODES).items()})


def section_refs(c: Column) -> Column:
    bare = F.filter(find_all(c, r"\b(\d+\.\d+(?:\.\d+)*)\b", 1), lambda x: F.coalesce(F.substring_index(x, ".", 1).try_cast("int"), F.lit(100)) < 100)
    return F.array_distinct(F.array_union(find_all(c, cat.SECTION, 1), F.when(has(c, cat.SECTION_CONTEXT), bare).otherwise(F.array().cast("array<string>"))))


def keywords(c: Column, stop_words: list[str] | None = None, more: Column | None = None) -> Column:
    """Upper-case distinct words of three letters at least that aren't stop words, and given codes."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\w\s-]", " "), r"\s+")
    words = F.array_except(F.filter(words, lambda w: F.length(w) >= 3), F.array(*map(F.lit, cat.STOP_WORDS if stop_words is None else stop_words)))
    if more is not None:
        words = F.concat(words, more)
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.upper(w)), lambda w: F.length(w) > 1))


def filename_codes(c: Column) -> Column:
    """Codes in a file name, where words may stand close together."""
    up = F.upper(F.coalesce(c, F.lit("")))
    api = F.filter(find_all(up, cat.FILENAME_API, 1), lambda x: x.rlike(cat.API_CODE))
    return F.array_distinct(F.concat(find_all(up, cat.FILENAME_ASTM), find_all(up, cat.FILENAME_UNS), api))


def code_index(names: DataFrame, doc: str, name_codes: Column, chunks: DataFrame | None = None, chunk_codes: Column | None = None, order: str = "chunk_no", first: int = 5) -> DataFrame:
    """code -> sorted documents: codes of the names, and of each document's first chunks."""
    rows = names.select(doc, F.explode(name_codes).alias("code"))
    if chunks is not None:
        head = chunks.withColumn("r_", F.row_number().over(W.partitionBy(doc).orderBy(order))).where(F.col("r_") <= first)
        rows = rows.unionByName(head.select(doc, F.explode(chunk_codes).alias("code")))
    return rows.groupBy("code").agg(F.sort_array(F.collect_set(doc)).alias("docs"))


#: Tasks that queries with the same codes are spread over.
SALTS = 8


def resolve_documents(queries: DataFrame, text: str, key: str, index: DataFrame) -> DataFrame:
    """Documents that a query names, null if it names none that is indexed (search all)."""
    t = F.col(text)

    def one(p: str) -> Column:
        found = F.upper(F.regexp_extract(t, pattern(p, True), 1))
        return F.when(found != "", F.array(found))

    astm = codes(t, cat.CODES["astm"])
    astm = F.transform(astm, lambda a: F.regexp_extract(a, r"(A\d{3,4})", 1))
    named = F.coalesce(F.when(F.size(astm) > 0, F.array_distinct(astm)), *map(one, cat.NAMED_DOCUMENTS))
    # a list of documents is made once for each list of codes; queries with the same codes take it as it is
    asked = queries.withColumn("codes_", F.array_sort(F.array_distinct(named)))
    lists = asked.select("codes_").where(F.size("codes_") > 0).distinct()
    found = lists.select("codes_", F.explode("codes_").alias("code")).join(index.hint("merge"), "code").groupBy("codes_")
    found = found.agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("docs")))).alias("documents"))
    found = found.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = asked.withColumn("salt_", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    return salted.join(found.hint("merge"), ["codes_", "salt_"], "left").drop("codes_", "salt_")


def spec_code(c: Column) -> Column:
    up = F.upper(F.coalesce(c, F.lit("")))
    nth = lambda p: F.nullif(F.regexp_extract(up, p, 1), F.lit(""))
    return F.coalesce(*map(nth, cat.SPEC_CODES))


QUANTITIES, MEASUREMENTS = cat.QUANTITIES, cat.MEASUREMENTS


def quantities(c: Column, patterns: list | None = None) -> Column:
    """array<struct<value, unit, original>>: numbers with units, in order of pattern and place; commas go, and of a
    fraction or a range the first number counts. Of equal (value, unit) the first stays."""

    def of(p: str, v: int, u: int) -> Column:
        """The text is scanned once; number and unit are taken from each short match."""
        part = lambda x, g: F.regexp_extract(x, pattern(p, True), g)
        number = lambda x: F.regexp_extract(F.replace(part(x, v), F.lit(","), F.lit("")), r"^\d+(?:\.\d+)?", 0).cast("double")
        return F.transform(find_all(c, p), lambda x: F.struct(number(x).alias("value"), part(x, u).alias("unit"), x.alias("original")))

    found = [of(*x) for x in patterns or QUANTITIES]
    key = lambda x: F.struct(x["value"], x["unit"])
    first = lambda every, seen: F.filter(every, lambda x, i: F.array_position(seen, key(x)) == i + 1)
    return bound(F.flatten(F.array(*found)), lambda every: bound(F.transform(every, key), lambda seen: first(every, seen)))


def extract_quantities(df: DataFrame, text: str, keys: list[str], patterns: list | None = None) -> DataFrame:
    return df.select(*keys, F.inline(quantities(F.col(text), patterns)))


def measurements(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """A row for each measured value: kind, value, unit (upper case)."""

    def of(kind: str, p: str, v: int, u: int) -> Column:
        part = lambda x, g: F.regexp_extract(x, pattern(p, True), g)
        return F.transform(find_all(F.col(text), p), lambda x: F.struct(F.lit(kind).alias("kind"), part(x, v).cast("double").alias("value"), F.upper(part(x, u)).alias("unit")))

    return df.select(*keys, F.inline(F.flatten(F.array(*[of(*m) for m in MEASUREMENTS]))))


def asks_formula(c: Column) -> Column:
    return has(c, cat.FORMULA_ASKED)


def has_formula(c: Column) -> Column:
    return has(c, cat.FORMULA_SHOWN)


def formula_guard(queries: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Whether a query asks for a formula that none of its hits has."""
    seen = hits.groupBy(key).agg(F.bool_or(has_formula(F.col("content"))).alias("seen"))
    return queries.join(seen.hint("merge"), key, "left").withColumn("guard", asks_formula(F.col("text")) & ~F.coalesce("seen", F.lit(False))).drop("seen")


def claim_sentences(df: DataFrame, text: str, keys: list[str], patterns: list[str] | None = None) -> DataFrame:
    cut = df.select(*keys, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"[.!?]+")).alias("sentence_no", "sentence"))
    return cut.where(has_any(F.col("sentence"), cat.CLAIMS if patterns is None else patterns)).withColumn("sentence", F.trim(F.regexp_replace("sentence", r"^\s+|\s+$", "")))


def claim_property(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return cascade([(has_any(low, ws, False), k) for k, ws in cat.CLAIM_PROPERTIES], "other")
