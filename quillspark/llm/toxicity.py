"""Toxicity by weak supervision.

Voters: every term of a lexicon (words and word beginnings found in the labelled sample) votes toxic where it occurs;
groups of terms vote toxic where one occurs and clean where none does; patterns (runs of exclamation marks, capitals,
numbers, long texts) vote by the side on which they stand more often. A generative label model with the voters' rates
under each class is fitted to the votes alone by expectation-maximisation, from the majority of votes on; a voter
correlated with others within the classes counts for less, by the sum of its excess correlations. Its posterior labels
train a ridge-penalised logistic regression on the presence of terms and patterns, which scores every document.

What gold labels are for: the source of the lexicon and of the patterns' sides, the share of class 1, and at last the
scale and shift of the label model's log odds (two numbers), as dependent voters make it too sure all the same.

Learned from: at most ``SAMPLE`` labelled documents whose crc32(id) mod 5 is not 0, chosen by hash; only texts enter a
score. What is broadcast is bounded by ``TERMS``.

Defined results: null and empty texts get the score of a text without any term; without labelled rows of both classes
all scores are 0; repeated rows and extra columns are kept, columns named as a result are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.labels import remainder, sample
from quillspark.llm.store import written
from quillspark.llm.textops import ALNUM, chunks, map_texts, mix, span_hash, texts_of, words

SAMPLE, TERMS, GROUPS, TOXIC_AT = 16384, 512, 8, 0.5
#: Toxic documents of the sample that a term of the lexicon stands in at least, at every size.
LEAST = 4
#: Rows of a block of the label model.
BLOCK = 2048
STEMS = (4, 5, 6)
PATTERNS = ("exclaims", "shouts", "numbers", "long", "asks")


def occurrences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term hashes, the text each occurs in, and the patterns of each text."""
    data, s, e, first = words(texts, ALNUM)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(texts)), n)
    found, owner = [span_hash(data, s, e)], [doc]
    for size in STEMS:  # beginnings are terms of their own, apart from words
        long = e - s > size
        found.append(mix(span_hash(data, s[long], s[long] + size) + np.uint64(size)))
        owner.append(doc[long])
    p = np.zeros((len(texts), len(PATTERNS)), bool)
    for k, t in enumerate(texts):
        p[k, 0], p[k, 4] = b"!!" in t, b"?" in t
        p[k, 1] = len(t) > 40 and sum(t.count(c) for c in b"ETAONIS") > 0.05 * len(t)
        p[k, 2] = any(c in t for c in (b"0", b"1", b"2", b"5"))
        p[k, 3] = n[k] > 500
    return np.concatenate(found), np.concatenate(owner), p


def presence(texts: list[bytes], terms: np.ndarray) -> np.ndarray:
    """Which terms (sorted hashes) and patterns each text has."""
    h, owner, p = occurrences(texts)
    out = np.zeros((len(texts), len(terms) + len(PATTERNS)), bool)
    if len(terms):
        at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
        hit = terms[at] == h
        out[owner[hit], at[hit]] = True
    out[:, len(terms) :] = p
    return out


def mine(rows: DataFrame, n_pos: int, n_neg: int) -> np.ndarray:
    """Hashes of the lexicon: terms that stand mostly in toxic documents of the sample."""

    def count(batches):
        seen: list[pd.DataFrame] = []
        for b in batches:
            texts, y = texts_of(b.column(0)), b.column(1).to_numpy()
            for i, j in chunks(texts):
                h, owner, _ = occurrences(texts[i:j])
                u = pd.DataFrame({"h": h.view(np.int64), "d": owner}).drop_duplicates()
                pos = y[i:j][u["d"]] == 1
                g = pd.DataFrame({"h": u["h"], "pos": pos.astype(int), "neg": (~pos).astype(int)}).groupby("h").sum()
                seen.append(g)
            if len(seen) > 8:
                seen = [pd.concat(seen).groupby(level=0).sum()]
        if seen:
            import pyarrow as pa

            g = pd.concat(seen).groupby(level=0).sum()
            yield pa.RecordBatch.from_pandas(g.reset_index(), preserve_index=False)

    t = rows.mapInArrow(count, "h long, pos long, neg long").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / n_pos) - F.log((F.col("neg") + 0.5) / n_neg)
    sure = (F.col("pos") >= LEAST) & (F.col("pos") >= 4 * F.col("neg")) & (odds > 3)
    top = t.where(sure).orderBy(F.desc(F.col("pos") * odds), "h").limit(TERMS).select("h").toPandas()
    return np.sort(top["h"].to_numpy(np.int64).view(np.uint64))


def votes_of(x: np.ndarray, n_terms: int, y: np.ndarray) -> np.ndarray:
    """Voters by columns: 1 toxic, -1 clean, 0 silent."""
    terms, patterns = x[:, :n_terms], x[:, n_terms:]
    cols = [terms[:, k].astype(np.int8) for k in range(n_terms)]
    for g in range(min(GROUPS, n_terms)):
        cols.append(np.where(terms[:, g::GROUPS].any(axis=1), 1, -1).astype(np.int8))
    cols.append(np.where(terms.any(axis=1), 1, -1).astype(np.int8))
    for k in range(patterns.shape[1]):
        p = patterns[:, k]
        side = 1 if p[y == 1].mean() >= p[y == 0].mean() else -1
        cols.append(np.where(p, side, 0).astype(np.int8))
    return np.stack(cols, axis=1)


def label_model(votes: np.ndarray, y: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Posterior probability of class 1 of each row.

    Rows start by the majority of their votes and rates are fitted on the votes alone, the class share held fixed; voters
    count by 1 / (1 + the sum of their excess correlations with others within the classes). As dependent voters make
    it too sure all the same, its log odds are at last scaled and shifted to fit the labels.
    """
    n, n_voters = votes.shape
    blocks = [slice(i, i + BLOCK) for i in range(0, n, BLOCK)]
    share = float(np.clip(y.mean(), 0.01, 0.99))
    total = votes.astype(np.int32).sum(axis=1)
    q = np.where(total > total.mean(), 0.9, 0.02)
    for _ in range(rounds):
        w = np.stack([1 - q, q])
        # class, value, voter
        seen = sum(np.stack([w[:, b] @ (votes[b] == v) for v in (-1, 0, 1)], axis=1) for b in blocks)
        rates = (seen + 0.5) / (w.sum(axis=1) + 1.5)[:, None, None]
        mean = rates[:, 2] - rates[:, 0]
        total, products = np.zeros(n_voters), np.zeros((n_voters, n_voters))
        for b in blocks:
            centred = votes[b] - w[:, b].T @ mean
            total += centred.sum(axis=0)
            products += centred.T @ centred
        sd = np.sqrt(np.maximum(np.diag(products) / n - (total / n) ** 2, 0)) + 1e-9
        corr = products / n / np.outer(sd, sd)
        np.fill_diagonal(corr, 0)
        count = 1 / (1 + np.where(corr > 0.1, corr, 0).sum(axis=0))
        lift = (np.log(rates[1]) - np.log(rates[0])) * count
        z = np.log(share / (1 - share)) + np.concatenate([sum((votes[b] == v) @ lift[k] for k, v in enumerate((-1, 0, 1))) for b in blocks])
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    z = np.clip(z, -30, 30)
    w = logistic(z[:, None] / 10, y.astype(float), ridge=0.01)
    return 1 / (1 + np.exp(-np.clip(z / 10 * w[0] + w[1], -30, 30)))


def logistic(x: np.ndarray, q: np.ndarray, ridge: float = 1.0, steps: int = 15) -> np.ndarray:
    """Weights, the last for the constant, by Newton's method on soft labels."""
    x = np.hstack([x.astype(float), np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (q - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def tiers_of(x: np.ndarray, n_terms: int, y: np.ndarray) -> np.ndarray:
    """Tier of each term by its share of toxic documents: 2 nearly always, 1 mostly, 0 other."""
    n = x[:, :n_terms].sum(axis=0)
    share = (y @ x[:, :n_terms]) / np.maximum(n, 1) - 1 / (n + 10)
    return np.where(share > 0.93, 2, np.where(share > 0.8, 1, 0))


def with_tiers(x: np.ndarray, tiers: np.ndarray) -> np.ndarray:
    """Terms and patterns, and whether any, or two, of the terms of the upper tiers are there: one sure term is as
    good a sign as several, which single weights of words that go together do not show."""
    terms = x[:, : len(tiers)]
    top, mid = terms[:, tiers == 2].sum(axis=1), terms[:, tiers >= 1].sum(axis=1)
    return np.hstack([x, np.stack([top > 0, top > 1, mid > 0, mid > 1], axis=1)])


@dataclass
class Model:
    terms: np.ndarray
    tiers: np.ndarray
    weights: np.ndarray

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(texts))
        x = with_tiers(presence(texts, self.terms), self.tiers)
        # the last bits of a product depend on the rows beside, and equal texts have equal scores
        z = np.round(x.astype(np.float32) @ self.weights[:-1] + self.weights[-1], 9)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE) -> Model:
    some = written(sample(docs, labels, label, rows, id_col, text_col))
    n = {r["y"]: r["count"] for r in some.groupBy("y").count().collect()}
    if len(n) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0))
    terms = mine(some, n[1], n[0])

    def rows_of(batches):
        import pyarrow as pa

        for b in batches:
            texts = texts_of(b.column(0))
            for i, j in chunks(texts):
                x = np.packbits(presence(texts[i:j], terms), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x]), b.column(1).slice(i, j - i)], names=["x", "y"])

    got = some.mapInArrow(rows_of, "x binary, y int").toPandas().sort_values(["x", "y"])
    x = np.unpackbits(np.frombuffer(b"".join(got["x"]), np.uint8).reshape(len(got), -1), axis=1, count=len(terms) + len(PATTERNS)).astype(bool)
    y = got["y"].to_numpy()
    q = label_model(votes_of(x, len(terms), y), y)
    tiers = tiers_of(x, len(terms), q)
    return Model(terms, tiers, logistic(with_tiers(x, tiers), q))


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE, toxic_at: float = TOXIC_AT) -> DataFrame:
    """All columns of ``docs`` with held_out, score (0 to 1) and predicted (1 if score >= ``toxic_at``)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, id_col, text_col, rows))

    def make() -> Callable:
        def run(texts: list[bytes]) -> list:
            return [np.concatenate([model.value.score(texts[i:j]) for i, j in chunks(texts)])]

        return run

    scored = map_texts(docs, text_col, make, [T.StructField("score", T.DoubleType())])
    return scored.withColumn("held_out", remainder(id_col) == 0).withColumn("predicted", (F.col("score") >= toxic_at).cast("int"))
