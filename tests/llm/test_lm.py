"""Context mixing: exact token counts and base, a proper distribution, better coding than the base on held-out texts."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import brute
import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import lm_mixing, registered
from quillspark.llm.labels import remainder


def base_of(rows):
    tokens = {k: brute.PLAIN.findall(brute.low(t)) + [None] for k, (_, t) in enumerate(rows)}
    train = [k for k, (i, _) in enumerate(rows) if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    c = Counter(w for k in train for w in tokens[k])
    n, v = sum(c.values()), len(c)
    return n, {k: (len(t), sum(w in c for w in t), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for k, t in tokens.items()}


def test_base_and_gain(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    n, want = base_of(rows)
    want = {rows[k][0]: w for k, w in want.items()}
    got = registered.op3_lm_scoring(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        t, known, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (t, known, n) and abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) and r.score < 0
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_rare_words_by_join_and_odd_rows(spark):
    rows = [(i, f"common word{i} common x{i % 3}") for i in range(40)] + [(3, None), (None, "common"), (7, ""), (8, " \t\n"), (9, "y" * 30000), (9, "y" * 30000), (11, "\0 é É")]
    n, want = base_of(rows)
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    for frequent in (0, 3, 1 << 19):
        got = lm_mixing.score_texts(df, frequent=frequent).collect()
        key = lambda x: (str(x[0]), x[1:3], round(x[3], 6))
        have = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got), key=key)
        need = sorted(((rows[k][0], *w) for k, w in want.items()), key=key)
        assert all(a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-9 * max(1, -b[3]) for a, b in zip(have, need, strict=True))
        first = first if frequent else sorted(r.score for r in got)
        assert np.allclose(sorted(r.score for r in got), first)
    assert lm_mixing.score_texts(df.limit(0)).count() == 0


def test_costs_follow_the_counts(spark):
    schema = "h long, w binary, c long"
    kinds = spark.createDataFrame([(1, bytearray(b"ab"), 5), (2, bytearray(b"abb"), 2), (3, bytearray(b""), 3)], schema)
    tables = spark.sparkContext.broadcast(lm_mixing.context_counts(kinds))
    asked = spark.createDataFrame([(i, bytearray([97, i]), 0) for i in range(256)] + [(256, bytearray(b""), 0), (257, bytearray(b"zz"), 0)], schema)
    cost = {r.h: 10**r.lp for r in lm_mixing.costs(asked, tables, lm_mixing.mixer(kinds, tables)).collect()}
    assert all(0 < x < 1 for x in cost.values()) and cost[98] > cost[120] and cost[256] > cost[257]
    assert sum(cost[i] for i in range(256)) < 1  # words that begin with one byte


def code_score(text, train, code, counts, start):
    """log10 of the probability of one text's codes, bit by bit in plain Python; counts by (predictor, context, node)."""
    L = lm_mixing
    ws = [*brute.PLAIN.findall(brute.low(text)), None]
    hs = [int(L.END) if w is None else int(L.tokens_of([w.encode()], code.keys).h[0]) for w in ws]
    ids = [list(code.keys).index(h) if h in code.keys else len(code.keys) for h in hs]
    paths = [[(int(code.node[k]), int(code.bit[k])) for k in range(code.first[i], code.first[i + 1])] for i in range(len(code.keys) + 1)]
    w = [list(map(float, g)) for g in start]
    total, local, pending, last_block = 0.0, Counter(), [], 0
    for place, i in enumerate(ids):
        block = place // L.BLOCK if place < L.EARLY else L.EARLY // L.BLOCK + (place - L.EARLY) // L.LATER
        if block != last_block:
            for g, k, d in pending:
                w[g][k] += d
            pending, last_block = [], block
        guess = next((ids[q] for q in range(place - 1, 0 if place else -1, -1) if place and hs[q - 1] == hs[place - 1]), None) if place else None
        for depth, (node, bit) in enumerate(paths[i]):
            x = []
            for key in contexts(ws, place):
                one, n = counts[(*key, node, 1)], counts[(*key, node, 0)] + counts[(*key, node, 1)]
                ones, zeros = one - (train and bit), n - one - (train and not bit)
                x.append(math.log((max(ones, 0) + L.PRIOR) / (max(zeros, 0) + L.PRIOR)))
            x.append(math.log((local[node, 1] + L.PRIOR) / (local[node, 0] + L.PRIOR)))
            fits = guess is not None and paths[guess][: depth + 1] and len(paths[guess]) > depth and paths[guess][depth][0] == node
            x.append((2 * paths[guess][depth][1] - 1) if fits else 0)
            g = min(depth // 4, 2) + 3 * bool(fits)
            p = 1 / (1 + math.exp(-min(max(sum(a * b for a, b in zip(w[g], x, strict=True)), -15), 15)))
            total += math.log10(p if bit else 1 - p)
            pending += [(g, k, L.STEP * (bit - p) * v) for k, v in enumerate(x)]
            local[node, bit] += 1
    return total


def contexts(ws, place):
    before = [ws[place - j] if place >= j else j for j in (1, 2)]
    short = next((ws[q] for q in range(place - 1, -1, -1) if len(ws[q]) <= lm_mixing.SHORT), 3)
    return (0,), (1, before[0]), (2, *before), (3, short)


def test_code_scores_by_brute_force(spark):
    import random

    L, r = lm_mixing, random.Random(4)
    vocab = ["a", "of", "the", "x1", "long", "longer", "words", "zz", "É"]
    texts = [" ".join(r.choices(vocab, range(1, 10), k=r.choice([0, 1, 3, 30, 700]))) for _ in range(30)] + ["a of a of a of", ""]
    train = np.array([k % 4 != 1 for k in range(len(texts))])
    h, c = np.unique(np.concatenate([L.tokens_of([t.encode()], np.zeros(0, np.uint64)).h for t, x in zip(texts, train, strict=True) if x]), return_counts=True)
    code = L.huffman(h[c > 20], c[c > 20], int(c[c <= 20].sum()))
    counts, tables = Counter(), [np.zeros((2, 1 << L.TABLE_BITS), np.float32) for _ in range(L.HASHED)]
    for t in (t for t, x in zip(texts, train, strict=True) if x):
        ws = [*brute.PLAIN.findall(brute.low(t)), None]
        tokens = L.tokens_of([t.encode()], code.keys)
        for place, i in enumerate(tokens.ids.tolist()):
            for k in range(code.first[i], code.first[i + 1]):
                for key in contexts(ws, place):
                    counts[(*key, int(code.node[k]), int(code.bit[k]))] += 1
        own, _, _, node, bit = L.code_bits(tokens, code, np.arange(len(tokens.h)))
        for table, x in zip(tables, L.word_contexts(tokens), strict=True):
            np.add.at(table[0], L.slots_of(x[own], node.view(np.uint32)), bit)
            np.add.at(table[1], L.slots_of(x[own], node.view(np.uint32)), 1 - bit)
    start = L.first_weights()
    got = L.Mixer.ready(code, tables, start).mixed([t.encode() for t in texts], train)[1]
    for k, t in enumerate(texts):
        want = code_score(t, bool(train[k]), code, counts, start)
        assert abs(got[k] - want) < 1e-3 * max(1, -want), t[:50]


def test_held_out_texts_teach_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    other = docs.withColumn("text", F.when(remainder("doc_id") == 1, F.concat(F.lit("quite other words "), F.reverse("text"))).otherwise(F.col("text")))
    a, b = ({r.doc_id: r for r in lm_mixing.score_texts(d).collect()} for d in (docs, other))
    kept = [i for i, r in a.items() if not r.held_out]
    assert len(kept) > 100 and all(abs(a[i].score - b[i].score) < 1e-5 * max(1, -a[i].score) for i in kept)
    held = [r for r in a.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert max(abs(a[i].score - b[i].score) for i, r in a.items() if r.held_out) > 1


def test_order_of_words_counts(spark):
    rows = [(i, "one two three four five six seven eight nine ten " * 3) for i in range(40)] + [(100, "one two three four five six"), (101, "six three one five two four")]
    got = {r.doc_id: r.score for r in lm_mixing.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] > got[101] + 1


def test_no_weight_comes_from_a_sample(spark, monkeypatch):
    """A text's score follows the counts of all training texts alone: texts are mixed once, each from the same constants."""
    L = lm_mixing
    tables, seen = [], L.code_counts
    monkeypatch.setattr(L, "code_counts", lambda *a: tables.append(seen(*a)) or tables[-1])
    texts = [f"some words of text {i % 7} and more of text {i % 5}" for i in range(60)]
    got = {r.doc_id: r.score for r in L.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    train = np.array([zlib.crc32(str(i).encode()) % 5 != 1 for i in range(60)])
    h, c = np.unique(np.concatenate([L.tokens_of([t.encode()], np.zeros(0, np.uint64)).h for t, x in zip(texts, train, strict=True) if x]), return_counts=True)
    code = L.huffman(h, c, max(int((c == 1).sum()), 0))
    want = L.Mixer.ready(code, tables[0], L.first_weights()).mixed([t.encode() for t in texts], train)[1]
    assert all(abs(got[i] - w) < 1e-4 * -w for i, w in enumerate(want.tolist()) if train[i])


def test_array_steps_by_plain_python():
    """Words are found by the first bits of their hash, bits are tallied at once, and log odds come ready for each slot."""
    L, r = lm_mixing, np.random.default_rng(3)
    h = r.integers(0, 1 << 64, 3000, dtype=np.uint64)
    for n in (0, 1, 2, 700, 2999):
        keys = np.unique(np.append(h[:n], np.uint64(7) if n else h[:0]))
        at = {int(k): i for i, k in enumerate(keys)}
        asked = np.append(h, [np.uint64(0), np.uint64(7), np.uint64(2**64 - 1)])
        assert L.places_of(keys, asked).tolist() == [at.get(int(x), len(keys)) for x in asked]
    slots, bit = r.integers(0, 16, 500).astype(np.int32), r.integers(0, 2, 500).astype(np.int8)
    table = np.ones((2, 16), np.int64)
    L.tally(table, slots, bit)
    assert table.tolist() == [[1 + sum(s == k and b == x for s, b in zip(slots, bit, strict=True)) for k in range(16)] for x in (1, 0)]
    counts = [r.integers(0, 3, (2, 1 << w)).astype(np.float16) for _, w in L.ORDERS]
    ws = [b"a", b"", b"abc", "É".encode()]
    slots, bit = L.bits(ws)
    assert "".join(map(str, bit.ravel())) == "".join(f"{x:08b}" for x in b" ".join(ws) + b" ")
    for left_out in (None, bit.ravel()):
        got = list(L.inputs_of(L.stretch(counts, left_out is not None), slots, left_out))
        for i, y in enumerate(bit.ravel().tolist()):
            kept = [[max(float(c[k][s.ravel()[i]]) - (left_out is not None and y == 1 - k), 0) for k in (0, 1)] for c, s in zip(counts, slots, strict=True)]
            seen = [min(int(math.log2(a + b + 1)), L.SEEN - 1) for a, b in kept]
            for o, (cell, odds) in enumerate(got):
                assert cell[i] == (seen[-1] * len(L.ORDERS) + o) * L.SEEN + seen[o]
                assert abs(odds[i] - math.log((kept[o][0] + L.DELTA) / (kept[o][1] + L.DELTA))) < 1e-5


def test_counts_in_parts_and_lanes(spark, monkeypatch):
    """Counts of 32 bits are given away before they could overflow and words before too many are held, with the same sums;
    texts mixed side by side score as each does alone, to the last bit."""
    L = lm_mixing
    docs = spark.createDataFrame([(i, f"word{i % 3} of text {i} and the words of it") for i in range(50)], "doc_id long, text string")
    counts, kinds = [], []
    code = spark.sparkContext.broadcast(L.huffman(L.tokens_of([b"the of word1 and text"], np.zeros(0, np.uint64)).h[:-1], np.array([9, 8, 5, 4, 3]), 7))
    for most, held in (((1 << 31) - 1, 1 << 20), (20, 3)):
        monkeypatch.setattr(L, "MOST_BITS", most)
        monkeypatch.setattr(L, "KINDS", held)
        counts.append(L.code_counts(docs, "doc_id", "text", code, 500))
        kinds.append(sorted((r.h, bytes(r.w), r.c) for r in L.kinds_of_words(docs, "doc_id", "text").collect()))
    assert all((a == b).all() for a, b in zip(*counts, strict=True)) and counts[0][0].sum() > 0 and kinds[0] == kinds[1]
    table = np.zeros((2, 4), np.int32)
    L.tally(table, np.array([1, 1, 3], np.int32), np.array([1, 0, 0], np.int8))
    assert table.tolist() == [[0, 1, 0, 0], [0, 1, 0, 1]] and table.dtype == np.int32
    texts = [b"the of word1 " * n for n in (1, 40, 3, 0, 700)]
    mixer = L.Mixer.ready(code.value, [c.astype(np.float16) for c in counts[0]], L.first_weights())
    train = np.array([True, False, True, True, False])
    assert mixer.mixed(texts, train)[1].tolist() == [mixer.mixed([t], train[i : i + 1])[1][0] for i, t in enumerate(texts)]
