"""Token counts by a two-tier lookup on the map side.

First tier: a broadcast hash table of the corpus's frequent pre-tokens and their token counts (``TABLE`` entries at
most, 16 bytes each). Second tier: each worker's cache of encoded misses, filled by the tokenizer library and emptied
when it holds ``CACHE`` entries. No pre-token is shuffled. To find the frequent ones every
task reads all of its texts and yields one row, a summary of its ``SUMMARY`` most frequent; summaries are merged
``FAN`` at a time, ``TABLE`` entries kept, until one is left, the only row that the driver gets. The table only spares
work: what a summary leaves out is encoded as a miss, and no count depends on it.

A pre-token is known by a 64-bit hash (chance of any mix-up among 10**8 kinds: about 3 in 10**4). Texts with code
points of unsure class go to the library whole.

Defined results: null and empty texts have 0 bytes and 0 tokens; rows are kept as they are, repeated ids too; extra
columns stay, and those named as a result are replaced; an empty table gives an empty table; very long texts are
counted whole.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.pretokens import hashes, pieces, specials, split
from quillspark.llm.store import written
from quillspark.llm.textops import chunks, map_texts, per_segment, texts_of

TABLE, SUMMARY, FAN, CACHE, LIMIT = 1 << 15, 1 << 13, 32, 1 << 17, 1024


def load(path: str):
    """The library's tokenizer, without truncation and padding, on one thread: Spark's tasks fill the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def lengths(tokenizer, texts: list[str]) -> np.ndarray:
    return np.fromiter((len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)), np.int64, len(texts))


def summary(h: np.ndarray, n: np.ndarray, w: list[str], size: int) -> pa.RecordBatch:
    """One row: the ``size`` entries of the largest counts, ties to the smaller hash."""
    top = np.lexsort((h, -n))[:size]
    cols = [pa.array([h[top].view(np.int64)], pa.list_(pa.int64())), pa.array([n[top]], pa.list_(pa.int64())), pa.array([[w[i] for i in top.tolist()]], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(cols, names=["h", "n", "w"])


def merged(hs: list[np.ndarray], ns: list[np.ndarray], ws: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Entries with the counts of equal hashes added."""
    h, at, back = np.unique(np.concatenate(hs), return_index=True, return_inverse=True)
    return h, np.bincount(back, np.concatenate(ns), len(h)).astype(np.int64), [ws[i] for i in at.tolist()]


def frequent(docs: DataFrame, text_col: str, path: str, size: int = TABLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and token counts of frequent pre-tokens of the whole corpus."""

    def count(batches):
        marks = [m for m, _ in specials(path)]
        hs, ns, ws = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
        for b in batches:
            texts = texts_of(b.column(0))
            for i, j in chunks(texts):
                cp, s, e, _, _ = split(pieces(texts[i:j], marks)[0])
                h, at, n = np.unique(hashes(cp, s, e), return_index=True, return_counts=True)
                top = np.argsort(-n, kind="stable")[:SUMMARY]
                hs.append(h[top]), ns.append(n[top])
                ws += [cp[x:y].tobytes().decode("utf-32-le", "surrogatepass") for x, y in zip(s[at[top]].tolist(), e[at[top]].tolist(), strict=True)]
                if len(ws) > 8 * SUMMARY:
                    h, n, w = merged(hs, ns, ws)
                    top = np.argsort(-n, kind="stable")[: 4 * SUMMARY]
                    hs, ns, ws = [h[top]], [n[top]], [w[i] for i in top.tolist()]
        yield summary(*merged(hs, ns, ws), min(size, SUMMARY))

    def merge(batches):
        hs, ns, ws = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
        for b in batches:
            for k in range(b.num_rows):
                hs.append(b.column("h")[k].values.to_numpy().view(np.uint64)), ns.append(b.column("n")[k].values.to_numpy())
                ws += b.column("w")[k].as_py()
        if len(hs) > 1:
            yield summary(*merged(hs, ns, ws), size)

    schema = "h array<long>, n array<long>, w array<string>"
    seen = written(docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(count, schema))
    m = seen.count()
    while m > 1:
        m = -(-m // FAN)
        seen = written(seen.repartition(m).mapInArrow(merge, schema))
    row = seen.first()
    if row is None or not row["h"]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, n = np.array(row["h"], np.int64).view(np.uint64), lengths(load(path), row["w"])
    order = np.argsort(h)
    return h[order], n[order]


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", limit: int = LIMIT, size: int = TABLE) -> DataFrame:
    """All columns of ``docs``, with n_bytes, n_tokens and over_limit of each whole text."""
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs, text_col, path, size))

    def make() -> Callable:
        known, n_known = table.value
        marks = [m for m, _ in specials(path)]
        tokenizer = load(path)
        cache: dict[int, int] = {}

        def tokens(texts: list[bytes]) -> np.ndarray:
            parts, first, n_marks = pieces(texts, marks)
            cp, s, e, at, hard = split(parts)
            h = hashes(cp, s, e)
            pos = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            hit = known[pos] == h if len(known) else np.zeros(len(h), bool)
            n = np.where(hit, n_known[pos], 0) if len(known) else np.zeros(len(h), np.int64)
            miss = np.flatnonzero(~hit)
            if len(miss):
                kinds, where, back = np.unique(h[miss], return_index=True, return_inverse=True)
                kinds = kinds.tolist()
                new = [i for i, x in enumerate(kinds) if x not in cache]
                if new:
                    if len(cache) + len(new) > CACHE:
                        cache.clear()
                        new = list(range(len(kinds)))
                    a, b = s[miss[where[new]]], e[miss[where[new]]]
                    got = lengths(tokenizer, [cp[x:y].tobytes().decode("utf-32-le") for x, y in zip(a, b, strict=True)])
                    cache.update(zip([kinds[i] for i in new], got.tolist(), strict=True))
                n[miss] = np.fromiter(map(cache.__getitem__, kinds), np.int64, len(kinds))[back]
            each = per_segment(n, at)
            if hard.any():
                each[hard] = lengths(tokenizer, [p for p, x in zip(parts, hard, strict=True) if x])
            return per_segment(each, first) + n_marks

        def run(texts: list[bytes]) -> list:
            n = np.concatenate([tokens(texts[i:j]) for i, j in chunks(texts)])
            return [np.fromiter(map(len, texts), np.int64, len(texts)), n, n > limit]

        return run

    return map_texts(docs, text_col, make, [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
