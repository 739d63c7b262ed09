"""Vectorised text primitives that run on Arrow batches inside Spark tasks.

Texts arrive as UTF-8 bytes. A batch is cut into chunks of about ``CHUNK`` bytes (one longer text is a
chunk of its own), so memory does not depend on the batch size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CHUNK = 1 << 20
#: Rows of an Arrow batch: a worker holds the texts of one batch at a time.
BATCH_ROWS = 1024

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a word, after lower-casing: letters, digits and all of non-ASCII; or all but white space.
ALNUM = np.ones(256, bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False
NONSPACE = np.ones(256, bool)
NONSPACE[[0x20, 9, 10, 11, 12, 13]] = False


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, p in enumerate((_P, _P_INV)):
            a = np.full(size, p, np.uint64)
            a[0] = 1
            _powers[i] = np.multiply.accumulate(a)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def span_hash(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span units[start:end], from running sums alone."""
    up, down = powers(len(units) + 1)
    sums = np.zeros(len(units) + 1, np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * up[: len(units)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(texts: list[bytes], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, start and end of every word, and each text's first word (and a last bound)."""
    data = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    edge = np.diff(inside[data].astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    return data, starts, ends, np.searchsorted(starts, offsets)


def chunks(texts: list, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes."""
    i = total = 0
    for j, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield i, j
            i, total = j, 0
        total += len(t) + 1
    if i < len(texts):
        yield i, len(texts)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def per_segment(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i + 1]] for every i; empty segments give 0."""
    sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]


def map_texts(
    df: DataFrame,
    text_col: str,
    make: Callable[[], Callable[[list[bytes]], list]],
    fields: list[T.StructField],
    keep: list[str] | None = None,
) -> DataFrame:
    """Keep columns of ``df`` and add ``fields``, computed from whole texts batch by batch.

    ``make`` runs once in each task and gives the function that turns the texts of a batch into one list or
    array for each field. A kept column with the name of a new field is replaced, as withColumn does. The session's Arrow
    batches are cut to BATCH_ROWS rows, where they are larger, as whole texts are long: Spark has no such setting for
    one plan.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    schema = T.StructType([f for c in kept for f in df.select(f"`{c}`").schema.fields] + fields)
    arrow = to_arrow_schema(T.StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows:
                got = f(texts_of(b.column(b.num_columns - 1)))
                cols = [b.column(i) for i in range(len(kept))]
                cols += [x if isinstance(x, pa.Array) else pa.array(x, type=t.type) for x, t in zip(got, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=[*kept, *arrow.names])

    return df.select(*[df[f"`{c}`"] for c in kept], df[f"`{text_col}`"].alias("__text__")).mapInArrow(run, schema)
