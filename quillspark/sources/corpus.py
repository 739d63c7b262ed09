"""Scans, gates and sinks of corpora."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share. In local mode, where they are one
    process, a new temporary folder does where none is named; on a cluster one has to be."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: it is computed once, its size is known to the
    planner, and lost executors don't matter."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch of whole texts.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Cuts the session's Arrow batches to BATCH_ROWS rows, where they are larger: a Python worker holds the texts of a batch
    at a time, and Spark has no such setting for one plan."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_corpus(spark: SparkSession, sf_dir: str, columns: list[str], condition: Column | None = None, name: str = "documents") -> DataFrame:
    """Columns of a table under a condition; both reach the Parquet scan."""
    df = read_table(spark, sf_dir, name)
    return (df if condition is None else df.where(condition)).select(*columns)


def explode_pages(df: DataFrame, pages: Column, keys: list[str]) -> DataFrame:
    """A row for each page of an array, numbered from 1."""
    return df.select(*keys, F.posexplode(pages).alias("i", "text")).select(*keys, (F.col("i") + 1).alias("page_number"), "text")


def split_pages(df: DataFrame, text: str, keys: list[str], marker: str) -> DataFrame:
    """Pages of an extracted text by a marker (case ignored); blank pages go, and without any other the text stays whole."""
    cut = F.filter(F.split(F.coalesce(text, F.lit("")), f"(?i){marker}"), lambda p: F.trim(p) != "")
    return explode_pages(df, F.when(F.size(cut) == 0, F.array(F.coalesce(text, F.lit("")))).otherwise(cut), keys)


def triage_extraction(pages: DataFrame, key: str, text: str, size: str, least_page: int = 100, least_total: int = 100, least_bytes: int = 1000) -> DataFrame:
    """What to do with an extraction: 'empty', 'ocr' where there is too little text for the file, or 'text'."""
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    doc = pages.groupBy(key).agg(F.sum(n).alias("chars"), F.max(n).alias("longest"), F.max(size).alias("bytes"))
    action = F.when(F.col("longest") == 0, "empty").when((F.col("longest") <= least_page) & (F.col("bytes") >= least_bytes), "ocr").when(F.col("chars") < least_total, "ocr").otherwise("text")
    return doc.select(key, "chars", action.alias("action"))


def ingest_gate(files: DataFrame, max_bytes: int = 50 * 1024 * 1024) -> DataFrame:
    """Files (name, content or head, length, content_type, at) with the reason for which they are turned away, or the
    name under which they are stored."""
    reason = (
        F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "no name")
        .when(F.col("content_type") != "application/pdf", "content type")
        .when(F.col("length") > max_bytes, "too large")
        .when(~F.coalesce(F.substring(F.col("content"), 1, 5).cast("string") == "%PDF-", F.lit(False)), "not a pdf")
    )
    stored = F.concat((F.unix_millis("at")).cast("string"), F.lit("-"), F.regexp_replace("name", r"[^a-zA-Z0-9.-]", "_"))
    return files.withColumn("reason", reason).withColumn("storage_name", F.when(F.col("reason").isNull(), stored))


def read_cases(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """Golden cases of a JSON file, or of a folder of them, as ``cases_of`` gives them."""
    return cases_of(spark.read.option("multiLine", True).json(path), layout)


def cases_of(raw: DataFrame, layout: str) -> DataFrame:
    """Cases nested in one of four layouts as (id, query, expected, forbidden, category, difficulty)."""
    at = {"cases": "testCases", "pairs": "qa_pairs", "prompts": "prompts"}
    if layout == "stress":
        rows = raw.select(F.explode("datasets").alias("d")).select(F.explode("d.queries").alias("c"))
    else:
        rows = raw.select(F.explode(at[layout]).alias("c"))
    have = set(rows.schema["c"].dataType.names)
    pick = lambda names, kind: F.coalesce(*[F.col(f"c.{n}").cast(kind) for n in names if n in have], F.lit(None).cast(kind))
    return rows.select(
        pick(["id"], "string").alias("id"), pick(["query", "question"], "string").alias("query"), pick(["expectedPatterns", "expected_values"], "array<string>").alias("expected"),
        pick(["forbiddenPatterns"], "array<string>").alias("forbidden"), pick(["category"], "string").alias("category"), pick(["difficulty"], "string").alias("difficulty"),
    )


def spec_facts(df: DataFrame, grades: str = "grades", key: str = "standard") -> DataFrame:
    """A nested catalogue, grade to property to value or 'low-high', as long facts."""
    long = df.select(key, F.explode(F.from_json(grades, "map<string,map<string,string>>")).alias("grade", "props")).select(key, "grade", F.explode("props").alias("property", "value"))
    ends = lambda i: F.nullif(F.regexp_extract("value", r"^\s*(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)\s*$", i), F.lit("")).cast("double")
    one = F.expr("try_cast(value AS double)")
    return long.select(key, "grade", "property", "value", F.coalesce(ends(1), one).alias("low"), F.coalesce(ends(2), one).alias("high"))


def export_embeddings(chunks: DataFrame, docs: DataFrame, key: str, preview: int = 200) -> DataFrame:
    """Chunks that have an embedding with their document's name and a preview on one line."""
    text = F.trim(F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, preview), r"\s+", " "))
    return chunks.where(F.col("embedding").isNotNull()).join(docs, key).withColumn("preview", text)


def write_embeddings(export: DataFrame, path: str, document: str, page: str, key: str) -> None:
    """An export as JSON lines in order of document, page and key over its files, and beside it the number of chunks of
    each document, most first."""
    export.repartitionByRange(document, page, key).sortWithinPartitions(document, page, key).write.mode("overwrite").json(f"{path}/embeddings")
    export.groupBy(document).agg(F.count("*").alias("chunks")).orderBy(F.desc("chunks"), document).write.mode("overwrite").json(f"{path}/counts")


#: Columns of the metric tables.
METRICS = {
    "test_runs": "id long, timestamp timestamp, scenario string, git_commit string, duration_ms long",
    "request_metrics": "id long, run_id long, endpoint string, method string, status_code int, duration_ms long, timestamp timestamp",
    "component_metrics": "id long, run_id long, component string, operation string, duration_ms long, success boolean, metadata string, timestamp timestamp",
    "resource_metrics": "id long, run_id long, cpu_percent double, memory_mb long, timestamp timestamp",
}


def read_metrics(spark: SparkSession, path: str, kind: str, stream: bool = False, form: str = "json", files: int | None = None) -> DataFrame:
    """A metric table that is only appended to, as files in ``path``: a table, or a stream of what is added (``files`` at
    a time). Columns that a file lacks are null; rows of no known form are null in all columns."""
    reader = (spark.readStream if stream else spark.read).format(form).schema(METRICS[kind])
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(path)


#: Folders of a chunk store; keys are dealt to them by hash.
STORE_PARTS = 64


def store_chunks(chunks: DataFrame, path: str, keys: list[str], batch: str | None = None) -> None:
    """Append chunks that the store doesn't have yet. The store is partitioned by a hash of the keys, and only the
    folders that the chunks fall in are read.

    With ``batch``, a name for a stream's micro-batch, the chunks are those of that batch alone: rows of other batches that
    the store has are left out, and the batch's own folders are replaced, so a batch that is run again after a failure
    leaves each row once. One writer at a time."""
    append_chunks(not_stored(chunks, path, keys, batch), path, keys, batch)


def _part(keys: list) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(STORE_PARTS)).cast("int")


def not_stored(rows: DataFrame, path: str, keys: list[str], batch: str | None = None) -> DataFrame:
    """Rows, such as documents that chunks are yet to be made of, whose keys the store doesn't have (from other batches,
    where ``batch`` is named)."""
    spark = rows.sparkSession
    if not exists(spark, path):
        return rows
    kinds = dict(spark.read.parquet(path).dtypes)  # keys are dealt by their hash as they are stored
    store = spark.read.schema(", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", batch_ string, part_ int").parquet(path)
    parts = [r["part_"] for r in rows.select(_part([F.col(k).cast(kinds[k]) for k in keys]).alias("part_")).distinct().collect()]  # STORE_PARTS at most
    have = store.where(F.col("part_").isin(parts))
    have = have if batch is None else have.where(F.col("batch_") != batch)
    return rows.join(have.select(*keys).distinct().hint("merge"), keys, "left_anti")


def append_chunks(chunks: DataFrame, path: str, keys: list[str], batch: str | None = None) -> None:
    """Write chunks of keys that the store doesn't have, in place of those of the same batch."""
    dealt = chunks.withColumn("part_", _part(keys)).withColumn("batch_", F.lit(batch or "-"))
    mode, option = ("append", "static") if batch is None else ("overwrite", "dynamic")
    dealt.write.mode(mode).option("partitionOverwriteMode", option).partitionBy("batch_", "part_").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """All chunks of a store."""
    return spark.read.parquet(path).drop("part_", "batch_")


def status_funnel(events: DataFrame, key: str, status: str, ts: str, tie: str, legal: dict[str, list[str]]) -> DataFrame:
    """Moves between states, their number, and whether they are legal."""
    before = F.lag(status).over(W.partitionBy(key).orderBy(ts, tie))
    moves = events.withColumn("was", before).where(F.col("was").isNotNull()).groupBy(F.col("was"), F.col(status).alias("now")).agg(F.count("*").alias("n"))
    pairs = [f"{a}>{b}" for a, bs in legal.items() for b in bs]
    return moves.withColumn("legal", F.concat_ws(">", "was", "now").isin(*pairs))


def ingest_outcome(docs: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """'error' where a document has no chunks or chunks without an embedding, else 'indexed'."""
    n = chunks.groupBy(key).agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"))
    d = docs.join(n, key, "left").na.fill(0, ["chunks", "embedded"])
    return d.withColumn("status", F.when((F.col("chunks") == 0) | (F.col("chunks") != F.col("embedded")), "error").otherwise("indexed"))


def write_report(summary: DataFrame, detail: DataFrame, path: str) -> None:
    """A one-row JSON summary beside the detail rows."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    detail.write.mode("overwrite").json(f"{path}/detail")
