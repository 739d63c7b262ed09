"""Max-sketch search against a plain scan of all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import max_sketch

DOCS, ITEMS = "doc_id long, text string", "item_id string, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k=20):
    bags = [(i, Counter(t)) for i, x in docs if (t := terms(x))]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        scores = []
        for i, b in bags:
            m = 100 - 25 + 25 * sum(b.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t in terms(text) if t in b)
            if s > 0:
                scores.append((-s, i is not None, i))
        out += [(item, r, x[2], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, more=lambda d: d, **options):
    index = max_sketch.build_index(more(spark.createDataFrame(docs, DOCS)))
    got = max_sketch.search(index, spark.createDataFrame(items, ITEMS), **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def made(n, seed, vocabulary=400):
    r = random.Random(seed)
    word = lambda: f"w{min(int(r.paretovariate(0.7)), vocabulary)}é"
    return [(i, " ".join(word() for _ in range(r.choice([0, 1, 5, 40, 40, 200])))) for i in range(n)]


def test_sketch_is_an_upper_bound():
    texts = [x.encode() for _, x in made(300, 1)]
    doc, h, tf, n = max_sketch.counted(texts)
    grade = np.searchsorted(max_sketch.GRADES, tf)
    assert (max_sketch.GRADES[grade] >= tf).all()
    for i, s in enumerate(max_sketch.sketches(doc, h, tf, len(texts))):
        mine = doc == i
        assert n[i] == tf[mine].sum() and bool(s) == mine.any()
        if mine.any():
            cells = np.stack([np.frombuffer(s, np.uint8) & 15, np.frombuffer(s, np.uint8) >> 4], 1).ravel()
            assert len(cells) >= max_sketch.SPREAD * mine.sum()
            at = (h[mine] >> np.uint64(64 - int(len(cells)).bit_length() + 1)).astype(int)
            assert (cells[at] >= grade[mine]).all()
            assert (cells > 0).sum() == len(set(at.tolist())) and all(cells[a] == grade[mine][at == a].max() for a in at)


@pytest.mark.parametrize("seed", [2, 3])
def test_bounds_hold(seed):
    docs = [x.encode() for _, x in made(200, seed)]
    doc, h, tf, n = max_sketch.counted(docs)
    items = [x.encode() for _, x in made(30, seed + 10) if x]
    idoc, ih, itf, _ = max_sketch.counted(items)
    b = max_sketch.Block([(ih[idoc == i].tobytes(), itf[idoc == i].astype(np.uint32).tobytes()) for i in range(len(items))])
    df = Counter(h.tolist())
    b.weigh(np.array([df[int(t)] for t in b.vocabulary]), int((n > 0).sum()), int(n.sum()))
    sketch = max_sketch.sketches(doc, h, tf, len(docs))
    own = [i for i in range(len(docs)) if sketch[i]]
    for at in max_sketch._alike([sketch[i] for i in own], 50):
        rows = [own[i] for i in at]
        bound = b.bounds([sketch[i] for i in rows], n[rows])
        e = b.impacts([h[doc == i].tobytes() for i in rows], [tf[doc == i].astype(np.uint32).tobytes() for i in rows], n[rows])
        exact = np.stack([e[:, t].astype(np.int64) @ w for t, w in b.weighted], 1)
        assert (bound >= exact).all() and (bound <= 10 * exact + 1e9).any()


def test_by_brute_force(spark):
    docs = made(3000, 5) + [(9000 + i, "same words here again w3é") for i in range(60)] + [(5, "W1É w2é W2é")] * 30  # ties and repeated rows
    items = [(f"q{i}", x) for i, x in made(40, 6)] + [("q1", "w7é w7é w9é"), ("tie", "same WORDS"), ("none", "neverseen"), ("punct", "!!"), (None, "w5é w6é"), ("twice", "w2é"), ("twice", "w2é")]
    assert run(spark, docs, items) == brute(docs, items)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(max_sketch, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(max_sketch, "BLOCK_TERMS", 300)
    docs, items = made(500, 8), [(f"q{i}", x) for i, x in made(40, 9)]
    assert run(spark, docs, items, k=3) == brute(docs, items, 3)


def test_small_tables(spark):
    docs = [(1, "Alpha beta"), (2, None), (3, ""), (4, "--- ..."), (None, "alpha"), (6, "alpha beta gamma " * 3), (7, "long " * 300_000 + "alpha")]
    items = [("a", "alpha"), ("b", "BETA gamma"), ("c", None), ("d", "long long")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, lambda d: d.withColumn("n_words", F.lit("x")).withColumn("row", F.lit(1)).withColumn("terms", F.lit(2))) == brute(docs, items)
    assert run(spark, docs, []) == [] and run(spark, [], items) == [] and run(spark, [(1, None)], items) == []
