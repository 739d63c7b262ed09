"""From page texts to structured, overlapping chunks; all in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.functions import catalogues as cat
from quillspark.functions.text import bound, cascade, count_of, find_all, has, has_any, lines


def paragraphs(df: DataFrame, text: str, keys: list[str], sep: str = r"\n\n+") -> DataFrame:
    """Trimmed paragraphs that aren't blank, numbered in order from 0 (numbers of blank ones are left out)."""
    cut = F.posexplode(F.split(F.coalesce(text, F.lit("")), sep)).alias("block_no", "block")
    return df.select(*keys, cut).withColumn("block", F.trim(F.regexp_replace("block", r"^\s+|\s+$", ""))).where("block != ''")


def numeric_columns(ls: Column) -> Column:
    many = F.filter(ls, lambda x: F.regexp_count(x, F.lit(cat.NUMBER_OR_RANGE)) >= 2)
    return (F.size(ls) >= 3) & (F.size(many) >= 0.5 * F.size(ls))


def is_table(c: Column, headers: list[str] | None = None) -> Column:
    def of(ls: Column) -> Column:
        piped = (F.size(F.filter(ls, lambda x: x.contains("|"))) >= 2) & F.exists(ls, lambda x: x.rlike(cat.TABLE_RULE))
        tabbed = F.size(F.filter(ls, lambda x: F.size(F.split(x, "\t")) >= 3)) >= 0.7 * F.size(ls)
        return (F.size(ls) >= 2) & (piped | tabbed | has_any(c, cat.TABLE_HEADERS if headers is None else headers) | numeric_columns(ls))

    return bound(lines(c), of)


def is_footnote(c: Column) -> Column:
    def of(ls: Column) -> Column:
        some = F.filter(ls, lambda x: has_any(x, cat.FOOTNOTES_CASED, False) | has_any(x, cat.FOOTNOTES))
        return F.size(ls).between(1, 10) & (F.size(some) >= 0.5 * F.size(ls))

    return bound(lines(c), of)


def list_kind(c: Column) -> Column:
    def of(ls: Column) -> Column:
        share = lambda p: F.size(F.filter(ls, lambda x: x.rlike(p))) >= 0.6 * F.size(ls)
        return F.when(F.size(ls) >= 2, F.when(share(cat.BULLET), "bullet").when(share(cat.NUMBERED), "numbered"))

    return bound(lines(c), of)


def section_title(c: Column) -> Column:
    """The heading in a block, without its number."""
    found = [F.nullif(F.trim(F.regexp_extract(c, p, g)), F.lit("")) for p, g in cat.HEADINGS]
    return F.coalesce(*found)


def section_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, cat.SECTION_NUMBER, 1), F.lit(""))


def classify_blocks(blocks: DataFrame, doc: str, page: str, headers: list[str] | None = None) -> DataFrame:
    """Kind of each block: table, footnote (a table came before in the document), list, heading or text."""
    b = F.col("block")
    order = W.partitionBy(doc).orderBy(page, "block_no")
    out = blocks.withColumn("table_", is_table(b, headers)).withColumn("tables_", F.sum(F.col("table_").cast("int")).over(order))
    kind = cascade([(F.col("table_"), "table"), ((F.col("tables_") > 0) & is_footnote(b), "footnote"), (list_kind(b).isNotNull(), "list"), ((F.length(b) < 100) & section_title(b).isNotNull(), "heading")], "text")
    return out.withColumn("kind", kind).withColumn("title", F.when(F.col("kind") == "heading", section_title(b))).drop("table_", "tables_")


def attach_footnotes(blocks: DataFrame, doc: str, page: str) -> DataFrame:
    """Tables with the footnotes that follow them on their page appended; other blocks as they are."""
    order = W.partitionBy(doc).orderBy(page, "block_no")
    last = F.last(F.when(F.col("kind") == "table", F.struct(F.col(page).alias("p"), F.col("block_no").alias("b"))), True).over(order)
    b = blocks.withColumn("t_", last).withColumn("own_", (F.col("kind") == "footnote") & (F.col("t_.p") == F.col(page)))
    b = b.withColumn("to_", F.when(F.col("own_"), F.col("t_.b")).otherwise(F.col("block_no")))
    parts = F.array_sort(F.collect_list(F.struct("block_no", "block", "kind", "title")))
    g = b.groupBy(doc, page, F.col("to_").alias("block_no")).agg(parts.alias("ps"))
    return g.select(doc, page, "block_no", F.array_join("ps.block", "\n\n").alias("block"), F.col("ps.kind")[0].alias("kind"), F.col("ps.title")[0].alias("title"), (F.size("ps") > 1).alias("has_footnotes"))


def carry_section(blocks: DataFrame, doc: str, page: str, least_chars: int = 0) -> DataFrame:
    """Section of each page: its last heading, else that of an earlier page."""
    pages = blocks.groupBy(doc, page).agg(F.max_by("title", F.when(F.col("title").isNotNull(), F.col("block_no"))).alias("own"))
    return pages.select(doc, page, F.last("own", True).over(W.partitionBy(doc).orderBy(page)).alias("section"))


def window_chunks(df: DataFrame, text: str, keys: list[str], size: int = 1500, overlap: int = 200, least: int = 50, keep_single: bool = False) -> DataFrame:
    """Overlapping windows of a text, trimmed; those of at most ``least`` characters go. ``keep_single``: a text that
    fits one window is one chunk however short."""
    if not 0 <= overlap < size or (keep_single and size < 100):
        raise ValueError("size must be at least 100, and overlap below it")
    step, n = size - overlap, F.length(text)
    last = F.when(n > size, F.ceil((n - size) / step) * step).otherwise(0).cast("int")
    rows = df.where(n > 0).select(*keys, F.col(text).alias("t_"), F.posexplode(F.sequence(F.lit(0), last, F.lit(step))).alias("chunk_no", "start"))
    rows = rows.withColumn("content", F.trim(F.expr(f"substring(t_, start + 1, {size})"))).withColumn("end", F.least(F.col("start") + size, F.length("t_")))
    keep = F.length("content") > least
    if keep_single:
        keep = keep | ((F.length("t_") <= size) & (F.length("content") > 0))
    return rows.where(keep).drop("t_")


def table_header(c: Column) -> Column:
    """Up to five first lines of a table before its first data row; none for fewer than three lines."""
    def of(every: Column) -> Column:
        ls = F.transform(F.slice(every, 1, 5), lambda x: F.trim(x))
        # the first data row after the first line ends the header
        cut = lambda ls: F.aggregate(F.sequence(F.lit(2), F.greatest(F.size(ls), F.lit(2))), F.lit(0), lambda a, i: F.when((a == 0) & has(F.get(ls, i - 1), cat.DATA_ROW, False), i).otherwise(a))
        head = bound(ls, lambda ls: bound(cut(ls), lambda n: F.when(n > 0, F.slice(ls, 1, n - 1)).otherwise(ls)))
        return F.when(F.size(every) >= 3, F.array_join(head, "\n"))

    return bound(lines(c), of)


def semantic_chunks(
    pages: DataFrame, doc: str, page: str, text: str, sep: str = r"\n\n+", least: int = 800, most: int = 2500, target: int = 1500, overlap: int = 200, least_page: int = 50, headers: list[str] | None = None
) -> DataFrame:
    """Chunks of tables (with their footnotes; long ones split under their header), lists and remaining text.

    One pass: the blocks of a page come together once, are made into units (each table, each list, and the rest of the
    page), and each unit into its windows. All groupings follow the first, by document."""
    some = pages.where(F.length(F.trim(F.coalesce(text, F.lit("")))) >= least_page)
    blocks = attach_footnotes(classify_blocks(paragraphs(some, text, [doc, page], sep), doc, page, headers), doc, page)
    whole = blocks.groupBy(doc, page).agg(F.array_sort(F.collect_list(F.struct("block_no", "block", "kind", "title", "has_footnotes"))).alias("bs"))
    titles = F.filter(F.col("bs.title"), lambda t: t.isNotNull())
    whole = whole.withColumn("section", F.last(F.try_element_at(titles, F.lit(-1)), True).over(W.partitionBy(doc).orderBy(page)))
    apart = lambda b: b["kind"].isin("table", "list")
    unit = lambda no, block, kind, title, notes: F.struct(no.alias("block_no"), block.alias("block"), kind.alias("kind"), title.alias("title"), notes.alias("notes"))
    own = F.transform(F.filter("bs", apart), lambda b: unit(b["block_no"], b["block"], b["kind"], F.lit(None).cast("string"), b["has_footnotes"]))
    rest = F.array_join(F.transform(F.filter("bs", lambda b: ~apart(b)), lambda b: b["block"]), "\n\n")
    rest = F.when(F.length(rest) >= least, F.array(unit(F.lit(-1), rest, F.lit("text"), F.array_max(titles), F.lit(False))))
    units = whole.select(doc, page, "section", F.explode(F.concat(own, F.coalesce(rest, F.slice(own, 1, 0)))).alias("u")).select(doc, page, "section", "u.*")
    n, table = F.length("block"), F.col("kind") == "table"
    units = units.withColumn("whole", F.col("kind").isin("table", "list") & (n <= F.when(table, most + 1000).otherwise(most)))
    # each piece of a table but the first begins with the header, so its windows are shorter by as much
    units = units.withColumn("head", F.when(table & ~F.col("whole"), F.coalesce(table_header(F.col("block")), F.lit(""))).otherwise(""))
    units = units.withColumn("width", F.when(table, F.greatest(target - F.length("head") - 1, F.lit(overlap + 100))).otherwise(target))
    step = F.col("width") - overlap
    end = F.when(~F.col("whole") & (n > F.col("width")), F.ceil((n - F.col("width")) / step) * step).otherwise(0).cast("int")
    cut = units.select("*", F.posexplode(F.sequence(F.lit(0), end, step.cast("int"))).alias("chunk_no", "start"))
    cut = cut.withColumn("piece", F.when(F.col("whole"), F.col("block")).otherwise(F.trim(F.expr("substring(block, start + 1, width)")))).where(F.col("whole") | (F.length("piece") > 50))
    cut = cut.withColumn("content", F.when(~F.col("whole") & (F.col("chunk_no") > 0) & (F.col("head") != ""), F.concat("head", F.lit("\n"), "piece")).otherwise(F.col("piece")))
    kind = F.when((F.col("kind") == "text") & F.col("title").isNotNull() & (F.length("content") < 150), "heading").otherwise(F.col("kind"))
    sure = cascade([(F.col("kind") == "text", 0.75), (table & F.col("whole"), F.when(F.col("notes"), 0.98).otherwise(0.95)), (table, 0.85), (F.col("whole"), 0.9)], 0.8)
    return cut.select(doc, page, "block_no", "chunk_no", "content", kind.alias("kind"), sure.alias("confidence"), "section", has_codes(F.col("content")).alias("has_codes"))


def has_codes(c: Column) -> Column:
    return has_any(c, cat.CODE_FLAGS) | has_any(c, cat.CODE_FLAGS_CASED, False)


def chunk_stats(chunks: DataFrame, doc: str, kind: str, content: str) -> DataFrame:
    """By document and kind, with totals: chunks, those with codes, mean length."""
    return chunks.rollup(doc, kind).agg(F.count("*").alias("chunks"), F.count_if(has_codes(F.col(content))).alias("with_codes"), F.avg(F.length(content)).alias("mean_chars"))


def overlap_audit(chunks: DataFrame, by: list[str], tolerance: int = 100) -> DataFrame:
    """Chunks that overlap the one before by more than ``tolerance`` characters."""
    over = F.lag("end").over(W.partitionBy(*by).orderBy("start")) - F.col("start")
    return chunks.withColumn("overlap", over).where(F.col("overlap") > tolerance)


def grade_counts(pages: DataFrame, doc: str, text: str, grade: str = r"\b(?:F\d{2,3}[A-Z]?|[SN]\d{5})\b") -> DataFrame:
    """Different grades that each document names on any page, 0 where it names none."""
    found = pages.select(doc, F.explode_outer(F.array_distinct(find_all(F.col(text), grade, 0, False))).alias("g"))
    return found.groupBy(doc).agg(F.count_distinct("g").alias("grades"))


def document_stats(pages: DataFrame, doc: str, text: str) -> DataFrame:
    t = F.coalesce(text, F.lit(""))
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    stats = pages.groupBy(doc).agg(F.count("*").alias("pages"), F.sum(words).alias("words"), F.sum(F.length(t)).alias("chars"), F.sum(count_of(t, r"=\s*%?\w+\s*[+\-*/]")).alias("formulas"), F.sum(count_of(t, r"(?i)TABLE\s+\d+")).alias("tables"))
    return stats.withColumn("chars_per_page", F.floor(F.col("chars") / F.col("pages") + 0.5).cast("long"))


