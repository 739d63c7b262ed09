"""Classifiers: accuracy on held-out rows, and defined results for odd rows."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import quality_knn, registered, toxicity

BIG = "/root/testdata/sf0.1"


def held_out_scores(spark, query, label, sf):
    y = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = query(spark, sf).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    return rows, [(r.score, r.predicted, y[r.doc_id]) for r in rows if r.held_out and r.doc_id in y]


def auc(pairs):
    pos, neg = [s for s, _, y in pairs if y == 1], [s for s, _, y in pairs if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("query,label,at,least_auc,least_acc", [(registered.op4_toxicity, "toxic", 0.5, 0.93, 0.95), (registered.op5_quality, "quality", 0.3, 0.98, 0.97)])
def test_held_out(spark, query, label, at, least_auc, least_acc):
    rows, pairs = held_out_scores(spark, query, label, BIG)
    assert len(rows) == spark.read.parquet(f"{BIG}/documents.parquet").count()
    assert all(r.predicted == int(r.score >= at) for r in rows)
    assert auc(pairs) >= least_auc
    assert sum(p == y for _, p, y in pairs) >= least_acc * len(pairs)


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality_knn.score_quality])
def test_odd_rows(spark, score):
    texts = ["fine words here", "idiot scum", "a | b | c", None, "", "x " * 20000, "fine words here", "\0"]
    docs = spark.createDataFrame([(i, t, "s", 9) for i, t in enumerate(texts * 20)] + [(None, "z", "s", 9)], "doc_id long, text string, score string, y int")
    labels = spark.createDataFrame([(i, int(i % 8 not in (1, 2)), int(i % 8 == 1)) for i in range(0, 150)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = score(docs, labels).collect()
    assert len(got) == docs.count() and {len({r.score for r in got if r.text == t}) for t in set(texts)} == {1}
    assert score(docs.limit(0), labels).count() == 0
    assert len({r.score for r in score(docs, labels.limit(0)).collect()}) == 1


def test_shouts_of_whole_text():
    calm = b"a calm line of words, "
    late = calm * 4000 + b"NO TEA AT NOON " * 6000
    assert len(calm * 4000) > 1 << 16
    shouts = toxicity.occurrences([late, calm * 4000])[2][:, toxicity.PATTERNS.index("shouts")]
    assert shouts.tolist() == [True, False]


def test_every_term_votes():
    y = np.arange(600) % 2
    x = np.zeros((600, 200 + len(toxicity.PATTERNS)), bool)
    x[np.arange(200) * 2 + 1, np.arange(200)] = True  # each term in one toxic document of its own
    votes = toxicity.votes_of(x, 200, y)
    for k in range(200):
        assert (votes == x[:, k, None]).all(axis=0).any()
    assert ((q := toxicity.label_model(votes, y)) >= 0).all() and (q <= 1).all()


def test_one_mining_rule(spark):
    def lexicon(n_pos):
        texts = [("rareword thrice" if i < 3 else "oftenword" if i < 8 else f"bad{i}", 1) for i in range(n_pos)] + [(f"good{i}", 0) for i in range(9 * n_pos)]
        terms = toxicity.mine(spark.createDataFrame(texts, "text string, y int"), n_pos, 9 * n_pos)
        return [bool(toxicity.presence([t], terms)[0, : len(terms)].any()) for t in (b"thrice", b"oftenword")]

    assert lexicon(100) == lexicon(300) == [False, True]


def test_votes_by_brute_force(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    space = quality_knn.fit(docs, labels, "quality")
    got = {r.doc_id: r.score for r in registered.op5_quality(spark, sf_dir).collect()}
    sample = [[int(x) for x in v] for v in space.vectors]
    for r in docs.collect():
        v = [int(x) for x in space.vectors_of(quality_knn.features([r.text.encode()]))[0]]
        cos = [sum(a * b for a, b in zip(v, x, strict=True)) for x in sample]
        best = sorted(range(len(cos)), key=lambda i: (-cos[i], i))[: quality_knn.NEIGHBOURS]
        w = [max(cos[i] / quality_knn.GRID**2, 0) ** quality_knn.SHARPNESS for i in best]
        want = sum(x * space.labels[i] for x, i in zip(w, best, strict=True)) / sum(w) if sum(w) else space.labels.mean()
        assert abs(got[r.doc_id] - want) < 1e-9


def test_equal_texts_over_partitions(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    copies = docs.limit(40).selectExpr("doc_id", "text").crossJoin(spark.range(20)).withColumn("doc_id", F.col("doc_id") + 1000 * F.col("id") + 1000).repartition(7, "id")
    more = quality_knn.score_quality(docs.select("doc_id", "text").unionByName(copies.select("doc_id", "text")), labels)
    assert more.groupBy("text").agg(F.countDistinct("score").alias("n")).where("n > 1").count() == 0


def test_equal_texts_have_equal_scores():
    """Whatever rows stand beside them: the last bits of a product don't come through."""
    import numpy as np

    from quillspark.llm import toxicity
    from quillspark.llm.textops import ALNUM, span_hash, words

    texts = [f"word{i} word{i * 7 % 50} other{i % 11} SHOUTED {i}".encode() for i in range(400)]
    data, s, e, _ = words(texts, ALNUM)
    terms = np.unique(span_hash(data, s, e))[:300]
    tiers = np.zeros(len(terms), np.int64)
    wide = toxicity.with_tiers(toxicity.presence(texts[:1], terms), tiers).shape[1]
    model = toxicity.Model(terms, tiers, np.random.default_rng(1).normal(size=wide + 1))
    whole = model.score(texts)
    for n in (1, 3, 37):
        assert np.array_equal(np.concatenate([model.score(texts[i : i + n]) for i in range(0, 400, n)]), whole)
