"""Merkle manifest of a table: a tree for each group of rows, a tree over the groups, and proofs against its root.

Every node has three children, a last run fewer; its digest is the SHA-256 of its children's digests as hex text. A tree
is cut into aligned blocks, complete subtrees of ``HEIGHT`` levels of edges. A block's nodes lie in one array in van Emde
Boas order: the upper half of its levels first, then each of the lower subtrees, and every one of these is laid out the
same way. ``fill`` builds a block by that recursion (lower subtrees, then the upper one over their roots), ``addresses``
says where a node lies, and siblings are read through it; neither knows the size of a cache line or a page. Block roots
are the leaves of the next level's blocks, until a group has one block; the subroots of all groups are then the leaves of
one more tree, built the same way.

In Spark: leaves are hashed where they are read and written with their digests only. Ranges of (group, key) are sorted,
and counts by group and range give each leaf its place, so a group that holds a third of all rows is spread over ranges
and then over its blocks. A task holds one block at a time. Proofs go down again: a block joins the path of its own root
and emits the paths of its leaves.

Defined results: rows with equal keys are ordered by their digest (equal rows are interchangeable, each is a leaf); a
null key comes first in its group, a null group is a group of its own and the first; a group of one row has its leaf as
subroot, and a table of one row has its leaf as root and a proof of no siblings; an empty table gives no rows; texts
are hashed whole; columns that aren't named take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.llm.store import written

#: Children of a node, and levels of edges of a block.
ARITY, HEIGHT = 3, 6
#: Rows of a table of offsets that are broadcast at most; beyond that it is joined by a merge.
BROADCAST_ROWS = 1_000_000


def size(levels: int) -> int:
    """Nodes of a complete tree of so many levels of nodes."""
    return (ARITY**levels - 1) // (ARITY - 1)


@cache
def addresses(levels: int) -> list[np.ndarray]:
    """For each depth the place of every node of that depth in van Emde Boas order."""
    if levels == 1:
        return [np.zeros(1, np.int64)]
    upper = levels // 2
    below = addresses(levels - upper)
    base = size(upper) + size(levels - upper) * np.arange(ARITY**upper)
    return addresses(upper) + [(base[:, None] + a).ravel() for a in below]


def parent(digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def fill(nodes: bytearray, base: int, levels: int, row: list[bytes]) -> bytes:
    """Lays out the subtree of so many levels over a row of its deepest nodes; its root."""
    if levels == 1:
        nodes[32 * base : 32 * base + 32] = row[0]
        return row[0]
    upper = levels // 2
    lower = levels - upper
    width, first = ARITY ** (lower - 1), base + size(upper)
    roots = [fill(nodes, first + j * size(lower), lower, row[i : i + width]) for j, i in enumerate(range(0, len(row), width))]
    return fill(nodes, base, upper, [parent(roots[i : i + ARITY]) for i in range(0, len(roots), ARITY)])


def height(n: int, total: int, most: int) -> int:
    """Levels of edges of a block of n leaves: all of them, or in a group's only block as many as it takes."""
    if total > ARITY**most:
        return most
    h = 0
    while ARITY**h < n:
        h += 1
    return h


def paths(nodes: bytes, n: int, h: int) -> Iterator[bytes]:
    """For each leaf of a block its steps up: place in the run, number of siblings, siblings."""
    at = addresses(h + 1)
    counts = [-(-n // ARITY ** (h - d)) for d in range(h + 1)]
    node = lambda d, i: nodes[32 * at[d][i] : 32 * at[d][i] + 32]
    rows = [[node(d, i) for i in range(counts[d])] for d in range(h + 1)]
    steps = [[b""] * counts[d] for d in range(h + 1)]
    for d in range(1, h + 1):  # a step is that of the parent's, after the node's own
        for i in range(counts[d]):
            first = i - i % ARITY
            run = rows[d][first : first + ARITY]
            k = i - first
            steps[d][i] = bytes((k, len(run) - 1)) + b"".join(run[:k] + run[k + 1 :]) + steps[d - 1][i // ARITY]
    yield from steps[h]


def follow(leaf: bytes, path: bytes) -> bytes:
    """Root that a leaf and the steps up lead to."""
    at = 0
    while at < len(path):
        k, n = path[at], path[at + 1]
        siblings = path[at + 2 : at + 2 + 32 * n]
        leaf = hashlib.sha256((siblings[: 32 * k] + leaf + siblings[32 * k :]).hex().encode()).digest()
        at += 2 + 32 * n
    return leaf


def siblings_of(path: bytes) -> bytes:
    """Siblings along the steps, one after the other."""
    out, at = [], 0
    while at < len(path):
        n = 32 * path[at + 1]
        out.append(path[at + 2 : at + 2 + n])
        at += 2 + n
    return b"".join(out)


def encoded(c: Column) -> Column:
    """A value with its size in bytes, or - for null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def name_of(c: str) -> Column:
    """The value that ``encoded`` has put down."""
    return F.when(F.col(c) != "-", F.expr(f"substring({c}, instr({c}, ':') + 1)"))


def digest(columns: list[Column]) -> Column:
    """Leaf digest of a row, as hex text."""
    return F.sha2(F.concat(*map(encoded, columns)), 256)


def numbered(rows: DataFrame, order: list[Column], keep: list[str]) -> DataFrame:
    """Rows with ``pos``, their place in their group (column gk) from 0, and ``total``, the group's size. ``order`` begins
    with the group."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("gk", *keep)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            keys, at = b.column(0).to_pylist(), np.empty(b.num_rows, np.int64)
            for i, k in enumerate(keys):
                n = n + 1 if k == last else 0
                at[i], last = n, k
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int64)), pa.array(at)], names=[*b.schema.names, "part", "at"])

    kinds = dict(dealt.dtypes)
    found = written(dealt.mapInArrow(count, ", ".join([*(f"`{c}` {kinds[c]}" for c in ("gk", *keep)), "part long", "at long"])))
    sizes = found.groupBy("gk", "part").agg(F.count("*").alias("n"))
    w = W.partitionBy("gk")
    before = F.coalesce(F.sum("n").over(w.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = written(sizes.select("gk", "part", before.alias("before"), F.sum("n").over(w).alias("total")))
    how = "broadcast" if offsets.count() <= BROADCAST_ROWS else "merge"
    return found.join(offsets.hint(how), ["gk", "part"]).select("gk", (F.col("at") + F.col("before")).alias("pos"), "total", *keep)


RESULT = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
BLOCK = "gk string, block long, total long, n int, root binary, nodes binary"


def blocks_of(rows: DataFrame, carried: list[str], most: int) -> DataFrame:
    """A row for each block of leaves (gk, pos, total, digest): its nodes in van Emde Boas order and its root. Columns
    ``carried`` become arrays of the leaves' values."""
    kinds = dict(rows.dtypes)
    dealt = rows.withColumn("block", F.expr(f"pos div {ARITY**most}L")).repartition("gk", "block").sortWithinPartitions("gk", "block", "pos").select("gk", "block", "total", "digest", *carried)
    schema = BLOCK + "".join(f", `{c}` array<{kinds[c]}>" for c in carried)
    arrow = pa.schema([("gk", pa.string()), ("block", pa.int64()), ("total", pa.int64()), ("n", pa.int32()), ("root", pa.binary()), ("nodes", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(own: pa.Table) -> tuple[list, list]:
            row = own.column("digest").to_pylist()
            total = own.column("total")[0].as_py()
            levels = height(len(row), total, most) + 1
            nodes = bytearray(32 * size(levels))
            root = fill(nodes, 0, levels, row)
            return [own.column("gk")[0].as_py(), own.column("block")[0].as_py(), total, len(row), root, bytes(nodes)], [own.column(c).combine_chunks() for c in carried]

        def out(done: list) -> pa.RecordBatch:
            arrays = [pa.array(x, t) for x, t in zip(zip(*(d[0] for d in done), strict=True), arrow.types, strict=True)]
            for i in range(len(carried)):
                values = [x for d in done for x in ([d[1][i]] if isinstance(d[1][i], pa.Array) else d[1][i].chunks)]
                arrays.append(pa.ListArray.from_arrays(np.cumsum([0] + [len(d[1][i]) for d in done]).astype(np.int32), pa.concat_arrays(values)))
            return pa.RecordBatch.from_arrays(arrays, names=[*arrow.names, *carried])

        rest: pa.Table | None = None
        done: list = []
        for b in chain(batches, [None]):
            t = rest if b is None else pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if t is None:
                continue
            keys = list(zip(t.column("gk").to_pylist(), t.column("block").to_pylist(), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])] + ([len(keys)] if b is None else [])
            for x, y in zip(cuts, cuts[1:], strict=False):
                done.append(block(t.slice(x, y - x)))
                if len(done) == 64:
                    yield out(done)
                    done = []
            rest = t.slice(cuts[-1]) if b is not None else None
        if done:
            yield out(done)

    return dealt.mapInArrow(build, schema)


class Tree:
    """Blocks of all levels of the trees of all groups, lowest first, and each group's root."""

    def __init__(self, leaves: DataFrame, carried: list[str], most: int) -> None:
        self.most, width = most, ARITY**most
        self.levels, tops, rows = [], [], leaves
        while True:
            b = written(blocks_of(rows, carried if not self.levels else [], most))
            self.levels.append(b)
            tops.append(b.where(F.col("total") <= width).select("gk", F.col("root").alias("top")))
            if b.where(F.col("total") > width).isEmpty():
                break
            up = F.expr(f"(total + {width - 1}L) div {width}L")
            rows = b.where(F.col("total") > width).select("gk", F.col("block").alias("pos"), up.alias("total"), F.col("root").alias("digest"))
        self.tops = tops[0]
        for t in tops[1:]:
            self.tops = self.tops.unionByName(t)

    def lowest(self, above: DataFrame) -> DataFrame:
        """Blocks of the lowest level with ``path``, the steps from their root up. ``above``: gk, path (the steps from a
        group's root up) and what else is to be kept."""
        kept = [c for c in above.columns if c not in ("gk", "path")]
        up, width = None, ARITY**self.most
        for level in reversed(self.levels):
            mine = above.select("gk", F.lit(0).cast("long").alias("block"), "path", *kept)
            last = level.where(F.col("total") <= width).join(mine, ["gk", "block"])  # all tables are written ones
            b = last if up is None else last.unionByName(level.where(F.col("total") > width).join(up, ["gk", "block"]))
            if level is self.levels[0]:
                return b
            up = written(emitted(b, kept, self.most))
        raise AssertionError


def emitted(blocks: DataFrame, kept: list[str], most: int) -> DataFrame:
    """Steps up of every leaf of blocks: (gk, block: the leaf's place, path, kept)."""
    kinds = dict(blocks.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                gk, block, total, n, nodes, path = (one.column(j)[0].as_py() for j in range(6))
                own = [p + path for p in paths(nodes, n, height(n, total, most))]
                same = [pa.array([one.column(6 + j)[0].as_py()] * n, one.column(6 + j).type) for j in range(len(kept))]
                yield pa.RecordBatch.from_arrays([pa.array([gk] * n), pa.array(np.arange(n) + block * ARITY**most), pa.array(own, pa.binary()), *same], names=["gk", "block", "path", *kept])

    schema = "gk string, block long, path binary" + "".join(f", `{c}` {kinds[c]}" for c in kept)
    return blocks.select("gk", "block", "total", "n", "nodes", "path", *kept).mapInArrow(run, schema)


def merkle_manifest(docs: DataFrame, columns: list[str], key: str = "doc_id", group: str = "source", tampered: list[Column] | None = None, where: Column | None = None, most: int = HEIGHT) -> DataFrame:
    """Each row's key with leaf, subroot, root and proof_sha256 (digest of its siblings, from the leaf to the root), all as
    hex text, and what a check of the row against the root says: folded_root and verified. The row is checked as it is,
    or, where ``where`` holds, as ``tampered`` has it (a column for each of ``columns``). ``most``: levels of a block."""
    own = digest([F.col(f"`{c}`") for c in columns])
    other = F.when(where, digest(tampered)) if tampered else F.lit(None).cast("string")
    some = docs.select(F.col(f"`{key}`").cast("long").alias("id"), encoded(F.col(f"`{group}`")).alias("gk"), own.alias("own"), other.alias("other"))
    leaves = written(some.select("id", "gk", F.unhex("own").alias("digest"), F.unhex(F.when(F.col("other") != F.col("own"), F.col("other"))).alias("other"), F.monotonically_increasing_id().alias("row")))
    order = [name_of("gk").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("digest"), F.col("row")]
    trees = Tree(numbered(leaves, order, ["digest", "id", "other"]), ["id", "other"], most)

    subroots = written(trees.tops.select(F.lit("").alias("gk"), F.col("gk").alias("own"), F.col("top").alias("digest")))
    top = Tree(numbered(subroots, [name_of("own").asc_nulls_first()], ["digest", "own"]), ["own"], most)
    above = top.lowest(written(top.tops.select("gk", F.lit(b"").alias("path"), F.col("top").alias("whole"))))

    def of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for total, n, nodes, path, whole, names in zip(*(b.column(j).to_pylist() for j in range(6)), strict=True):
                h = height(n, total, most)
                own = [nodes[32 * a : 32 * a + 32] for a in addresses(h + 1)[h][:n]]
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([p + path for p in paths(nodes, n, h)], pa.binary()), pa.array(own, pa.binary()), pa.array([whole] * n, pa.binary())], names=["gk", "path", "subroot", "whole"])

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for total, n, nodes, path, subroot, whole, ids, others in zip(*(b.column(j).to_pylist() for j in range(8)), strict=True):
                h = height(n, total, most)
                own = [nodes[32 * a : 32 * a + 32] for a in addresses(h + 1)[h][:n]]
                up = [p + path for p in paths(nodes, n, h)]
                folded = [follow(d if o is None else o, p) for d, o, p in zip(own, others, up, strict=True)]
                proofs = [hashlib.sha256(siblings_of(p).hex().encode()).hexdigest() for p in up]
                cols = [pa.array(ids, pa.int64()), [d.hex() for d in own], [subroot.hex()] * n, [whole.hex()] * n, proofs, [d.hex() for d in folded], [d == whole for d in folded]]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], names=["id", *RESULT])

    by_group = written(above.select("total", "n", "nodes", "path", "whole", "own").mapInArrow(of_groups, "gk string, path binary, subroot binary, whole binary"))
    rows = trees.lowest(by_group).select("total", "n", "nodes", "path", "subroot", "whole", "id", "other")
    return rows.mapInArrow(of_rows, "id long, " + ", ".join(f"{c} {'boolean' if c == 'verified' else 'string'}" for c in RESULT)).withColumnRenamed("id", key)
