"""The Merkle manifest against a plain tree built level by level."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(row: list[str]) -> list[list[str]]:
    out = [row]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def runs(levels, i):
    for level in levels[:-1]:
        f = i - i % 3
        yield i - f, level[f : f + 3]
        i //= 3


def brute(rows, edit):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    top = levels_of([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            steps = [*runs(trees[s], i), *runs(top, k)]
            d, proof = leaf_of(edit(r)), ""
            for j, run in steps:
                proof += "".join(run[:j] + run[j + 1 :])
                d = sha("".join([*run[:j], d, *run[j + 1 :]]))
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], sha(proof), d, d == top[-1][0]))
    return sorted(out, key=repr)


def edit(r):
    return (*r[:4], r[4] and r[4].replace("\n", "")) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r


def run(spark, rows, more=None, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    df = df if more is None else more(df)
    changed = [F.translate("text", "\n", "") if c == "text" else F.col(c) for c in COLUMNS]
    got = merkle.merkle_manifest(df, COLUMNS, tampered=changed, where=F.crc32(F.col("doc_id").cast("string")) % 2 == 0, **options)
    assert got.columns == ["doc_id", *merkle.RESULT]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_addresses():
    for levels in range(1, 8):
        at = merkle.addresses(levels)
        assert [len(a) for a in at] == [3**d for d in range(levels)]
        assert sorted(x for a in at for x in a.tolist()) == list(range(merkle.size(levels)))
    # the upper half comes first, and each lower subtree is one stretch
    at = merkle.addresses(4)
    assert sorted([*at[0], *at[1]]) == [0, 1, 2, 3]
    for j in range(9):
        own = sorted([int(at[2][j]), *at[3][3 * j : 3 * j + 3].tolist()])
        assert own == list(range(4 + 4 * j, 8 + 4 * j))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 81, 200])
def test_block(n):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    h = merkle.height(n, n, 6)
    nodes = bytearray(32 * merkle.size(h + 1))
    root = merkle.fill(nodes, 0, h + 1, leaves)
    levels = levels_of([x.hex() for x in leaves])
    assert root.hex() == levels[-1][0] and len(levels) == h + 1
    for i, p in enumerate(merkle.paths(bytes(nodes), n, h)):
        assert merkle.follow(leaves[i], p) == root
        assert merkle.siblings_of(p).hex() == "".join("".join(r[:j] + r[j + 1 :]) for j, r in runs(levels, i))


def test_small_tables(spark):
    rows = [(1, "a", "en", 3, "x\ny"), (2, "a", None, None, "z\n\n"), (2, "a", None, None, "z\n\n"), (None, "a", "fr", 1, None), (3, None, "en", 0, ""), (4, "", "en", 5, "\n"), (9, "ß:1", "", 2, "é\n"), (10, "a", "en", 1, "q")]
    assert run(spark, rows) == brute(rows, edit)
    assert run(spark, rows[:1]) == brute(rows[:1], edit)
    assert run(spark, []) == []
    # columns that aren't named, and columns with a result's name, take no part
    assert run(spark, rows, lambda d: d.withColumn("leaf", F.lit("x")).withColumn("total", F.lit(1)).withColumn("verified", F.lit(2))) == brute(rows, edit)


def test_several_levels(spark):
    """Blocks of nine leaves: four levels in the hot source, two over the sources."""
    rows = [(i * 7 % 1000, "hot" if i % 3 else f"s{i % 30}", "en", i, f"text {i}\n" * (i % 4)) for i in range(900)] + [(5, "hot", "en", 1, "same\n")] * 40
    rows += [(-1, "long", "de", 1, "very long\n" * 200_000)]
    assert run(spark, rows, most=2) == brute(rows, edit)


def test_merge_join(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 0)
    rows = [(i, f"s{i % 3}", "en", i, f"text {i}\n") for i in range(50)]
    assert run(spark, rows) == brute(rows, edit)
