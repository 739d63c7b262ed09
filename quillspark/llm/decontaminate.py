"""Benchmark decontamination by Wu-Manber multi-pattern search.

Patterns are windows of ``WINDOW`` consecutive words of the test items (a shorter item is one window), written with
one space before, between and after the words; texts are normalised the same way. Patterns are grouped by length so
that a short one does not shrink the shifts of the others. In a group with shortest length m, every block of
``BLOCK`` bytes within the first m bytes of a pattern has a shift: its distance from position m. A probe at a position
of the text looks its block up in the shift table and skips that many bytes; a shift of 0 selects, by the hash of
those m bytes (the suffix hash with the prefix test of the method in one), a bucket of patterns, which are then
compared with the text byte by byte. All texts of a chunk are probed in lanes at once; a lane is a stretch of
``LANE`` bytes plus an overlap.

Items are dealt by hash into parts of about ``PART`` bytes of text. Only one part at a time comes to the driver, is
broadcast, and is let go after its pass over the documents; its tables are built once in each worker process. With several parts
the hits of each pass are written, and joined by row, so memory is bounded whatever the size of the benchmark.

Defined results: a text without words (or null) has 0 words and 0 hits and is not contaminated; null and empty items
hold no window; items with the same id count once, and windows of all their texts count; very long texts are read whole; rows of documents are kept, repeated ids too; extra columns stay,
and those named as a result are replaced; empty tables give empty or uncontaminated results.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.store import written
from quillspark.llm.textops import ALNUM, LOWER, chunks, map_texts, words

WINDOW, BLOCK, LANE, PART = 13, 8, 4096, 1 << 23
SHIFT_BITS = 20


def normal(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts' words with a space before each and one text apart by a NUL, the place of each word's
    space, and each text's first word (and a last bound)."""
    data, starts, ends, first = words(texts, ALNUM)
    size = ends - starts
    # a text takes: a NUL, then for each word a space and the word, then a last space
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    place = np.concatenate([[0], np.cumsum(size + 1)])[:-1] + 2 * owner + 1
    total = int(size.sum()) + len(size) + 2 * len(texts)
    out = np.full(total + 1, 32, np.uint8)
    keep = ALNUM[data]
    take = np.flatnonzero(keep)
    out[np.arange(len(take)) + np.repeat(place + 1 - (np.cumsum(size) - size), size)] = data[take]
    done = np.concatenate([[0], np.cumsum(size + 1)])[first]
    out[done[:-1] + 2 * np.arange(len(texts))] = 0
    out[-1] = 0
    return out, place, first


def block_codes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Slot in a shift table of the BLOCK bytes that begin at each place."""
    wide = np.lib.stride_tricks.sliding_window_view(data, BLOCK)[at]
    code = np.ascontiguousarray(wide).view(np.uint64)[:, 0]
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SHIFT_BITS)).astype(np.int64)


class ShiftTables:
    """Patterns of one length group: shortest length, shift table, buckets by hash of the first m bytes."""

    def __init__(self, patterns: dict[bytes, set[str]]) -> None:
        self.patterns = patterns
        self.m = min(map(len, patterns))
        far = self.m - BLOCK + 1 if self.m >= BLOCK else 1
        self.shift = np.full(1 << SHIFT_BITS, max(far, 1), np.int32)
        self.buckets: dict[bytes, list[bytes]] = defaultdict(list)
        for p in patterns:
            self.buckets[p[: self.m]].append(p)
        if self.m >= BLOCK:
            heads = np.frombuffer(b"".join(self.buckets), np.uint8).reshape(-1, self.m)
            for i in range(self.m - BLOCK + 1):
                codes = block_codes(heads.ravel(), np.arange(len(heads)) * self.m + i)
                np.minimum.at(self.shift, codes, self.m - BLOCK - i)

    def occurrences(self, data: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """Place and text of every occurrence."""
        n, m = len(data), self.m
        if n < m:
            return
        raw = data.tobytes()
        if m < BLOCK:  # shorter than a block: nothing can be skipped, each pattern is looked for by itself
            for p in self.patterns:
                x = raw.find(p)
                while x >= 0:
                    yield x, p
                    x = raw.find(p, x + 1)
            return
        # a probe at place x stands for an occurrence that begins at x
        at = np.arange(0, n - m + 1, LANE)
        stop = np.minimum(at + LANE, n - m + 1)
        found = []
        while len(at):
            step = self.shift[block_codes(data, at + m - BLOCK)]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        for x in np.concatenate(found).tolist():
            for p in self.buckets.get(raw[x : x + m], ()):
                if raw.startswith(p, x):
                    yield x, p


def item_windows(items: list[tuple[str, bytes]], window: int) -> dict[bytes, set[str]]:
    """Each window's text and the items that have it."""
    out: dict[bytes, set[str]] = defaultdict(set)
    for name, text in items:
        w = bytes(LOWER[np.frombuffer(text, np.uint8)]).translate(bytes(b if ALNUM[b] else 32 for b in range(256))).split(b" ")
        w = [x for x in w if x]
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            out[b" " + b" ".join(w[i : i + window]) + b" "].add(name)
    return out


def groups(patterns: dict[bytes, set[str]]) -> list[ShiftTables]:
    """Patterns by length, each group within a factor of two."""
    by: dict[int, dict] = defaultdict(dict)
    for p, names in patterns.items():
        by[len(p).bit_length()][p] = names
    return [ShiftTables(g) for _, g in sorted(by.items())]


def scan(texts: list[bytes], tables: list[ShiftTables]) -> Iterator[tuple[int, np.ndarray, set[str]]]:
    """For each text: its words, which of them are hit, the items found."""
    for i, j in chunks(texts):
        data, place, first = normal(texts[i:j])
        cover = np.zeros(len(place) + 1, np.int64)
        found: dict[int, set[str]] = defaultdict(set)
        for t in tables:
            for x, p in t.occurrences(data):
                w = int(np.searchsorted(place, x))
                cover[w] += 1
                cover[w + p.count(b" ") - 1] -= 1
                found[int(np.searchsorted(first, w, side="right")) - 1] |= t.patterns[p]
        hit = np.cumsum(cover)[:-1] > 0
        for k in range(j - i):
            yield int(first[k + 1] - first[k]), hit[first[k] : first[k + 1]], found.get(k, set())


#: The last part's broadcast and its tables, which a worker's tasks share.
_built: list = [None, None]


def _tables(part, window: int) -> list[ShiftTables]:
    """The tables of a broadcast part, made once in each worker process."""
    items = part.value
    if _built[0] is not items:
        _built[:] = [items, groups(item_windows(items, window))]
    return _built[1]


HITS = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("item_ids", T.ArrayType(T.StringType()))]


def _hits(docs: DataFrame, text_col: str, part, window: int, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_words, hit_spans and item_ids for the items of one broadcast part."""

    def make() -> Callable:
        tables = _tables(part, window)

        def run(texts: list[bytes]) -> list:
            found = list(scan(texts, tables))
            spans = [np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist() if hit.any() else [] for _, hit, _ in found]
            return [[n for n, _, _ in found], spans, [sorted(names) for _, _, names in found]]

        return run

    return map_texts(docs, text_col, make, HITS, keep)


def _merged(spans):
    """Sorted spans with those that meet or overlap made one."""
    spans = F.array_sort(spans)

    def add(done, x):
        last = F.try_element_at(done, F.lit(-1))
        more = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(last[0], F.greatest(last[1], x[1]))))
        return F.when(F.coalesce(last[1] >= x[0], F.lit(False)), more).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, F.array().cast("array<array<bigint>>"), add)


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, part_bytes: int | None = None) -> DataFrame:
    """All columns of ``docs`` with n_words, n_hit, item_ids (sorted as strings), hit_spans (word ranges, end
    excluded) and contaminated: some word is hit, and a twentieth of all words at least."""
    sc, part_bytes = docs.sparkSession.sparkContext, part_bytes or PART
    rows = items.where(F.col(f"`{item_text}`").isNotNull()).select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("i"), F.col(f"`{item_text}`").cast("string").alias("t"))
    parts = max(1, math.ceil((rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) / part_bytes))

    def broadcast(some: DataFrame):
        return sc.broadcast([(r["i"], r["t"].encode()) for r in some.distinct().toLocalIterator()])

    if parts == 1:
        out = _hits(docs, text_col, broadcast(rows), window)
    else:
        names = {f.name for f in HITS} | {"n_hit", "contaminated"}
        keyed = written(docs.drop(*names).withColumn("__row__", F.monotonically_increasing_id()) if text_col not in names else docs.withColumn("__row__", F.monotonically_increasing_id()))
        dealt = written(rows.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(parts))), "part")
        passes = []
        for k in range(parts):
            part = broadcast(dealt.where(F.col("part") == k))
            hits = _hits(keyed, text_col, part, window, ["__row__"])
            passes.append(written(hits if k == 0 else hits.where("size(item_ids) > 0")))  # the first has every row's words
            part.destroy()
        more = passes[1]
        for p in passes[2:]:
            more = more.unionByName(p)
        more = more.unionByName(passes[0].where("size(item_ids) > 0")).groupBy("__row__")
        more = more.agg(F.flatten(F.collect_list("hit_spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("names"))
        both = passes[0].select("__row__", "n_words").join(more.hint("merge"), "__row__", "left")
        both = both.select("__row__", "n_words", F.coalesce(_merged("spans"), F.array().cast("array<array<bigint>>")).alias("hit_spans"), F.coalesce("names", F.array().cast("array<string>")).alias("item_ids"))
        out = keyed.join(both.hint("merge"), "__row__").drop("__row__")
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0])
    return out.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def items_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
