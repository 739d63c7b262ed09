"""Places of rows in an order, without a task that sees a whole group."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.sources.corpus import written

#: Rows of a table of offsets that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows with ``pos``, their place in their group (nulls are a group) from 0. Ranges of (group, order) are sorted, and
    counts by group and range say where each range begins; rows equal in all of these may come in any order. The sorted
    rows are written, so places stay as they are when a task runs again."""
    dealt = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).select(*group, *[c for c in rows.columns if c not in group])
    g = len(group)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            for i in range(g):
                code = b.column(i).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            key = [b.column(i)[0].as_py() for i in range(g)]
            start = np.maximum.accumulate(np.where(new, np.arange(b.num_rows), 0))
            at = np.arange(b.num_rows) - start
            at[start == 0] += n if key == last else 0
            last, n = [b.column(i)[-1].as_py() for i in range(g)], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int64)), pa.array(at)], names=[*b.schema.names, "part_", "at_"])

    schema = ", ".join(f"`{c}` {t}" for c, t in dealt.dtypes)
    saved = written(dealt.mapInArrow(count, schema + ", part_ long, at_ long"))
    sizes = saved.groupBy(*group, "part_").agg(F.count("*").alias("n_"))
    before = F.sum("n_").over(W.partitionBy(*group).orderBy("part_")) - F.col("n_")
    offsets = written(sizes.select(*[F.col(c).alias(f"{c}__") for c in group], F.col("part_").alias("part__"), before.alias("before_")))
    how = "broadcast" if offsets.count() <= BROADCAST_ROWS else "merge"
    same = reduce(lambda a, c: a & saved[c].eqNullSafe(offsets[f"{c}__"]), group, saved["part_"] == offsets["part__"])
    return saved.join(offsets.hint(how), same).withColumn("pos", F.col("at_") + F.col("before_")).select(*rows.columns, "pos")
