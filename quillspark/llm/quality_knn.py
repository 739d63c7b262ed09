"""Quality by nearest-neighbour voting in a latent semantic space.

The terms of a text are its words (hashed to ``WORDS`` dimensions), trigrams of character classes (letters, digits,
blanks, line ends and each sign by itself), lengths of neighbouring words, and grades of its size, of the share of its
words that differ and of those that repeat the word before. Their damped counts, weighted by rarity, are projected to
``RANK`` latent dimensions, fitted on the labelled sample. The sample's vectors (``SAMPLE`` rows at most, ``RANK``
numbers each: 2 MB) are broadcast; the cosines of every document with all of them come from blocked matrix products,
and the ``NEIGHBOURS`` nearest vote with their labels, weighted by similarity.

Vectors are rounded to whole multiples of 1 / ``GRID``, so their products are whole numbers below 2**53: a cosine does
not depend on the block that a text stands in, and equal texts get equal scores.

Learned from: at most ``SAMPLE`` labelled documents whose crc32(id) mod 5 is not 0. Only texts enter a score.

Defined results: null and empty texts have the zero vector, whose score is the sample's mean label; without labelled
rows all scores are 0.5; equal cosines fall to the smaller place in the sample, which is ordered by features and label;
very long texts are read whole; rows (repeated ids and null ids too) and extra columns are kept, columns named as a
result are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.labels import remainder, sample
from quillspark.llm.textops import NONSPACE, chunks, map_texts, mix, span_hash, texts_of, words

SAMPLE, RANK, NEIGHBOURS, SHARPNESS, KEEP = 4096, 48, 15, 4, 0.3
DIMS, GRADES, WORDS, GRID = 1024, 256, 1024, 1 << 15

#: Classes of bytes: lower case, capital, digit, beyond ASCII, control, and each other ASCII sign by itself.
_SIGNS = [9, 10, 13, *(b for b in range(32, 127) if not chr(b).isalnum())]
_CLASS = np.full(256, 4, np.int32)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3
_CLASS[_SIGNS] = np.arange(5, 5 + len(_SIGNS))
_N = 5 + len(_SIGNS)
#: Dimension of each trigram of classes.
_TRIGRAM = (mix(np.arange(_N**3, dtype=np.uint64) + np.uint64(1)) % np.uint64(DIMS)).astype(np.int32)


def features(texts: list[bytes]) -> np.ndarray:
    """Damped counts of each text's terms, a row of DIMS + GRADES + WORDS numbers each."""
    m = len(texts)
    out = np.zeros((m, DIMS + GRADES + WORDS), np.float32)
    raw = np.frombuffer(b"\0\0".join(texts) + b"\0\0", np.uint8)
    c = _CLASS[raw]
    sizes = np.fromiter(map(len, texts), np.int64, m)
    at = np.arange(sizes.sum()) + 2 * np.repeat(np.arange(m), sizes)  # a trigram begins in its text; two ends follow each text
    tri = _TRIGRAM[(c[at] * _N + c[at + 1]) * _N + c[at + 2]]
    out[:, :DIMS] = np.bincount(np.repeat(np.arange(m), sizes) * DIMS + tri, minlength=m * DIMS).reshape(m, DIMS)
    data, s, e, first = words(texts, NONSPACE)
    h, n = span_hash(data, s, e), np.diff(first)
    doc = np.repeat(np.arange(m), n)
    size = np.minimum((e - s), 11)
    pair = np.bincount(doc[1:] * 144 + size[:-1] * 12 + size[1:], weights=doc[1:] == doc[:-1], minlength=m * 144).reshape(m, 144) if len(s) > 1 else np.zeros((m, 144))
    out[:, DIMS : DIMS + 144] = pair
    out[:, DIMS + GRADES :] = np.bincount(doc * WORDS + (h >> np.uint64(32)).astype(np.int64) % WORDS, minlength=m * WORDS).reshape(m, WORDS)
    out = np.log1p(out)
    again = np.bincount(doc[1:], weights=(h[1:] == h[:-1]) & (doc[1:] == doc[:-1]), minlength=m) if len(s) > 1 else np.zeros(m)
    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    kinds = np.bincount(doc[order][new], minlength=m)
    full = n > 0
    for at, share in ((144, kinds / np.maximum(n, 1)), (165, again / np.maximum(n, 1))):
        out[np.flatnonzero(full), DIMS + at + np.minimum((share * 20).astype(int), 20)[full]] = 4
    out[np.flatnonzero(full), DIMS + 186 + np.minimum(np.log2(np.maximum(n, 1)).astype(int), 20)[full]] = 2
    out[~full] = 0
    return out


@dataclass
class Space:
    weight: np.ndarray  # rarity of each term
    basis: np.ndarray  # terms x RANK
    vectors: np.ndarray  # of the sample, of length GRID or 0, whole numbers
    labels: np.ndarray

    def vectors_of(self, x: np.ndarray) -> np.ndarray:
        v = (x * self.weight).astype(float) @ self.basis
        return np.round(v * (GRID / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)))

    def vote(self, texts: list[bytes]) -> np.ndarray:
        n = len(self.labels)
        if not n:
            return np.full(len(texts), 0.5)
        out = []
        for i in range(0, len(texts), 256):
            cos = self.vectors_of(features(texts[i : i + 256])) @ self.vectors.T  # whole numbers, below RANK * GRID**2
            k = min(NEIGHBOURS, n)
            best = np.argpartition(np.arange(n) - cos * n, k - 1, axis=1)[:, :k]  # by cosine, then place: no two are equal
            best.sort(axis=1)
            w = np.maximum(np.take_along_axis(cos, best, 1) / GRID**2, 0) ** SHARPNESS
            total = w.sum(axis=1)
            score = (w * self.labels[best]).sum(axis=1) / np.maximum(total, 1e-12)
            out.append(np.where(total > 0, score, self.labels.mean()))
        return np.clip(np.concatenate(out), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE) -> Space:
    def rows_of(batches):
        for b in batches:
            texts = texts_of(b.column(0))
            for i, j in chunks(texts):
                x = features(texts[i:j]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x]), b.column(1).slice(i, j - i)], names=["x", "y"])

    got = sample(docs, labels, label, rows, id_col, text_col).mapInArrow(rows_of, "x binary, y int").toPandas()
    if not len(got):
        return Space(np.zeros(0), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0))
    got = got.sort_values(["x", "y"])
    x = np.frombuffer(b"".join(got["x"]), np.float16).reshape(len(got), -1).astype(np.float32)
    weight = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    weighted = x * weight
    values, vectors = np.linalg.eigh((weighted.T @ weighted).astype(float))
    s = Space(weight, np.ascontiguousarray(vectors[:, np.argsort(-values)[:RANK]]), np.zeros(0), got["y"].to_numpy(float))
    s.vectors = s.vectors_of(x)
    return s


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """All columns of ``docs`` with held_out, score (0 to 1) and predicted (1 if score >= ``keep``)."""
    space = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, id_col, text_col, rows))

    def make() -> Callable:
        def run(texts: list[bytes]) -> list:
            return [np.concatenate([space.value.vote(texts[i:j]) for i, j in chunks(texts)])]

        return run

    scored = map_texts(docs, text_col, make, [T.StructField("score", T.DoubleType())])
    return scored.withColumn("held_out", remainder(id_col) == 0).withColumn("predicted", (F.col("score") >= keep).cast("int"))
