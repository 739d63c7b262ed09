"""Labelled rows for the classifiers: which may be learned from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, m: int = 5) -> Column:
    """crc32 of the id's text, modulo m; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), F.lit(m)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y) of at most ``rows`` documents whose label may be learned, chosen by a hash of the id.

    Rows with a null or other label than 0 and 1 don't count; of repeated label rows the largest counts. At most
    ``rows`` ids are broadcast; documents aren't shuffled."""
    y = labels.where(F.col(f"`{label}`").isin(0, 1) & F.col(f"`{id_col}`").isNotNull() & (remainder(id_col) != 0))
    y = y.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(F.col(f"`{label}`")).cast("int").alias("y"))
    y = y.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.join(F.broadcast(y), "id").select("text", "y")
