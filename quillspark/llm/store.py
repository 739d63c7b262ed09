"""Tables written to the shared folder, to cut lineage where executors can be lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share. In local mode, where they are one
    process, a new temporary folder does where none is named; on a cluster one has to be."""
    if d := spark.conf.get("spark.checkpoint.dir", None):
        return d
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))


def written(df: DataFrame, *partition_by: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    (df.write.option("compression", compression) if compression else df.write).partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def most_frequent(df: DataFrame, count: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(rows with the largest counts, ``limit`` at most; all other rows).

    The cut lies between sixteenths of powers of two, whose sizes alone come to the driver: no sort, and no task
    sends it rows that the cut leaves out."""
    grade = F.floor(F.log2(F.col(count).cast("double")) * 16)
    sizes = df.where(F.col(count) > 0).groupBy(grade.alias("g")).count().collect()
    cut, total = float("inf"), 0
    for r in sorted(sizes, key=lambda r: -r["g"]):
        total += r["count"]
        if total > limit:
            break
        cut = r["g"]
    top = (F.col(count) > 0) & (grade >= F.lit(float(cut)))
    return df.where(top), df.where(~F.coalesce(top, F.lit(False)))
