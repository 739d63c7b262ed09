"""LM scoring by online logistic context mixing.

A text is the sequence of its lower-cased words and an end mark. Each token is written in bits: the ``VOCAB`` most
frequent words of the training texts, the end mark and an escape have a Huffman code; an escaped word is then spelled,
8 bits a byte, with a blank at its end. Every bit is predicted by several hashed contexts, combined by gated weights.

Code bits, token after token. Contexts, each with the node of the code tree: none (exact counts), the word before, the
two words before, the last short word before (of ``SHORT`` bytes at most, mostly a function word), how often the node's
branches were taken in this text, and the branch of the word that followed when the word before last stood in this
text. The first four have counts of zeros and ones over all training texts (hashed to 2**``TABLE_BITS`` slots). A logistic
mixer combines their log odds; its weights are gated by the depth in the code and by whether the last predictor still
fits, and are refined along each text, after every ``BLOCK`` tokens, and beyond the first ``EARLY`` after every ``LATER``. Texts of a chunk are mixed side by side, each with
weights of its own. All begin with the same constants (``first_weights``), so no weight comes from a sample of the texts.
A training text is predicted by what the others hold: of each context it meets, one occurrence is left out.

Spelled bits. Contexts: the last 1, 2, 3 and 4 bytes of the word, and all of it so far (``ORDERS``), with counts over
all kinds of training words, each counted once; their log odds are combined by a mixer gated by how often the whole
word so far was seen, refined online, batch by batch, over these kinds (each with itself left out); tasks' weights are
averaged. No context of these crosses the border of a word, so each kind of word has one
spelling cost, computed once in Spark; the ``FREQUENT`` commonest are broadcast, and the rest are joined by hash to the
words that documents have beyond these. Words are known by a 64-bit hash.

The total of both, in bits per byte, is in ``bits_per_byte``.

What is gathered from the corpus: all kinds of words and their counts, by shuffle; the context tables (bounded, hashed)
are summed by block. At very large inputs the hashed tables fill up, and rare contexts then share their slots.

Defined results: a null or empty text has one token, the end. Repeated ids and rows each get their row; a null id
counts as training; without training texts counts are 0, the base is log10(0.5 / 0.5) = 0 for each token, and all
bits are even; very long texts are read whole; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.labels import remainder
from quillspark.llm.store import most_frequent, written
from quillspark.llm.textops import NONSPACE, chunks, mix, per_segment, span_hash, texts_of, words

#: Context orders and the binary logarithm of their slots; 0 stands for the whole word so far.
ORDERS = ((1, 16), (2, 18), (3, 20), (4, 20), (0, 20))
BLOCK_BITS, FREQUENT, SEEN = 14, 1 << 18, 20
DELTA, RATE, BATCH = 0.05, 0.05, 1 << 13
VOCAB, TABLE_BITS, SHORT, BLOCK, EARLY, LATER = 1 << 16, 20, 3, 8, 256, 64
#: Kinds of words that a task holds before they are merged, kinds of a chunk each, and given away.
KINDS = 1 << 19
#: Of the code mixer: what is added to counts of zeros and ones, the rate of its steps, its inputs and gates.
PRIOR, STEP, INPUTS, GATES, HASHED = 0.4, 0.02, 6, 6, 3
#: Bytes of texts that are mixed side by side, and that a task counts for the tables at least; bits that it counts before it gives its tables away.
LANES, TASK_BYTES, MOST_BITS = 1 << 19, 1 << 26, (1 << 31) - 1
END = np.uint64(0xE17D)
INPUT = np.dtype([("odds", np.float32), ("cell", np.int32)])
#: Of each byte's eight bits, in order: the node that the bits before lead to, and the bit.
NODES = ((1 << np.arange(8)) | (np.arange(256)[:, None] >> (8 - np.arange(8)))).astype(np.uint32)
BITS = ((np.arange(256)[:, None] >> (7 - np.arange(8))) & 1).astype(np.int8)


@dataclass
class Code:
    """Huffman code of the vocabulary (in order of hashes) and, last, the escape: each one's path from the root."""

    keys: np.ndarray
    first: np.ndarray  # bounds of the paths
    node: np.ndarray
    bit: np.ndarray
    ones: np.ndarray  # of training tokens, by node
    total: np.ndarray


def huffman(keys: np.ndarray, counts: np.ndarray, others: int) -> Code:
    """Code of words with these counts, and of the escape for ``others`` tokens."""
    order = np.argsort(keys)
    keys, c = keys[order], np.append(counts[order], others).astype(np.int64)
    n = len(c)
    heap = [(max(x, 1), i) for i, x in enumerate(c.tolist())]
    heapq.heapify(heap)
    parent, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.uint8)
    for new in range(n, 2 * n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = new
        side[j] = 1
        heapq.heappush(heap, (a + b, new))
    root, at, steps = 2 * n - 2, np.arange(n), []
    while (at != root).any():
        steps.append((np.where(at == root, -1, parent[at] - n), side[at]))
        at = np.where(at == root, root, parent[at])
    nodes = np.array([x for x, _ in reversed(steps)], np.int64).reshape(len(steps), n).T
    bits_ = np.array([x for _, x in reversed(steps)], np.uint8).reshape(len(steps), n).T
    there = nodes >= 0  # a path ends at its leaf: shorter ones have their gap before the root
    size = there.sum(axis=1)
    node, bit = nodes[there], bits_[there]
    each = np.repeat(c, size)
    return Code(keys, np.concatenate([[0], np.cumsum(size)]), node.astype(np.int32), bit, np.bincount(node, each * bit, max(n - 1, 1)), np.bincount(node, each, max(n - 1, 1)))


@dataclass
class Tokens:
    """Tokens of some texts, one text after the other: hash, code id, text, and bytes of the word."""

    h: np.ndarray
    ids: np.ndarray
    doc: np.ndarray
    size: np.ndarray
    first: np.ndarray  # bounds of the texts
    data: np.ndarray = field(repr=False)


def places_of(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each hash among the sorted keys; their number where it isn't one. Hashes are even, so few keys share their
    first bits, and those are looked through."""
    shift = np.uint64(64 - max(len(keys).bit_length(), 1))
    first = np.searchsorted(keys >> shift, np.arange((1 << (64 - int(shift))) + 1, dtype=np.uint64))
    place, at = np.full(len(h), len(keys)), first[(h >> shift).astype(np.int64)]
    padded = np.append(keys, np.uint64(0))
    for j in range(int(np.diff(first).max(initial=0))):
        met = np.flatnonzero(padded[np.minimum(at + j, len(keys))] == h)
        place[met] = np.minimum(at[met] + j, len(keys))
    return place


def tokens_of(texts: list[bytes], keys: np.ndarray) -> Tokens:
    data, s, e, first = words(texts, NONSPACE)
    m, n = len(texts), np.diff(first)
    bounds = first + np.arange(m + 1)
    h, size = np.full(bounds[-1], END, np.uint64), np.zeros(bounds[-1], np.int64)
    inner = np.ones(bounds[-1], bool)
    inner[bounds[1:] - 1] = False
    h[inner], size[inner] = span_hash(data, s, e), e - s
    return Tokens(h, places_of(keys, h), np.repeat(np.arange(m), n + 1), size, bounds, data)


def word_contexts(t: Tokens) -> list[np.ndarray]:
    """A hash (32 bits) for each token of: the word before, the two words before, the last short word before; within its text."""
    at = np.arange(len(t.h))
    start = t.first[t.doc]

    def before(j: int) -> np.ndarray:
        return np.where(at - j >= start, t.h[np.maximum(at - j, 0)], np.uint64(j))

    last = np.maximum.accumulate(np.where((t.size <= SHORT) & (t.size > 0), at, -1))
    last = np.concatenate([[-1], last[:-1]]) if len(last) else last
    short = np.where(last >= start, t.h[np.maximum(last, 0)], np.uint64(3))
    one, two = before(1), before(2)
    return [(mix(c) >> np.uint64(32)).astype(np.uint32) for c in (one + np.uint64(1), one * np.uint64(0x9E3779B97F4A7C15) + two, short + np.uint64(2))]


def slots_of(context: np.ndarray, node: np.ndarray, width: int = TABLE_BITS) -> np.ndarray:
    """Slot of each context (32 bits) at a node, in a table of 2**width."""
    at = node * np.uint32(0x9E3779B1)
    at ^= context
    at *= np.uint32(0x85EBCA6B)
    at >>= np.uint32(32 - width)
    return at.view(np.int32)


def before_in_group(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the places by group (whole numbers), and whether each in that order begins its group."""
    shift = max(int(len(group)).bit_length(), 1)
    order = group.astype(np.uint64)
    order <<= np.uint64(shift)
    order |= np.arange(len(group), dtype=np.uint64)
    order.sort()
    places = (order & np.uint64((1 << shift) - 1)).view(np.int64)
    order >>= np.uint64(shift)
    new = np.ones(len(order), bool)
    new[1:] = order[1:] != order[:-1]
    return places, new


def code_bits(t: Tokens, code: Code, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the bits of the tokens at ``pick``: the token's place in ``pick``, path place, depth, node, bit."""
    size = np.diff(code.first)[t.ids[pick]]
    own = np.repeat(np.arange(len(pick), dtype=np.int32), size)
    at = np.arange(len(own), dtype=np.int32)
    depth = at - np.repeat((np.cumsum(size) - size).astype(np.int32), size)
    at = np.repeat(code.first[t.ids[pick]].astype(np.int32), size) + depth
    return own, at, depth, code.node.take(at, mode="clip"), code.bit.take(at, mode="clip")


def block_of(place: np.ndarray) -> np.ndarray:
    """Number of the block that a token's place in its text falls in."""
    return np.where(place < EARLY, place // BLOCK, EARLY // BLOCK + (place - EARLY) // LATER)


@dataclass
class Mixer:
    """The code and its tables, ready to score: log odds by slot, as they are, without a zero, without a one."""

    code: Code
    tables: list[np.ndarray]
    start: np.ndarray  # weights, gates x inputs

    @staticmethod
    def ready(code: Code, counts: list[np.ndarray], start: np.ndarray) -> Mixer:
        def odds(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
            out = [np.log((np.maximum(ones - o, 0) + PRIOR) / (np.maximum(zeros - z, 0) + PRIOR)) for z, o in ((0, 0), (1, 0), (0, 1))]
            return np.concatenate(out).astype(np.float32)

        return Mixer(code, [odds(code.ones, code.total - code.ones), *(odds(*c.astype(np.float32)) for c in counts)], start)

    def mixed(self, texts: list[bytes], train: np.ndarray) -> tuple[Tokens, np.ndarray, np.ndarray]:
        """Tokens of the texts, log10 of the probability of each text's codes, and the weights that each ends with."""
        code = self.code
        t = tokens_of(texts, code.keys)
        m, n = len(texts), np.diff(t.first)
        weights = np.repeat(self.start[None], m, axis=0)
        if not len(code.node):
            return t, np.zeros(m), weights
        # texts are lanes, the longest first, and their tokens are taken block by block
        lane = np.empty(m, np.int64)
        lane[np.argsort(-n, kind="stable")] = np.arange(m)
        block = block_of(np.arange(len(t.h)) - t.first[t.doc])
        pick, _ = before_in_group(block)
        own, _, depth, node, bit = code_bits(t, code, pick)
        size, text = np.diff(code.first), t.doc[pick]
        each = size[t.ids[pick]]  # bits of each token: what holds for all of them is repeated
        x = np.zeros((INPUTS, len(own)), np.float32)
        left_out = np.repeat(train[text].astype(np.int32), each)
        left_out *= bit + np.int32(1)
        np.take(self.tables[0], left_out * np.int32(len(code.total)) + node, out=x[0], mode="clip")
        left_out <<= TABLE_BITS
        for k, c in enumerate(word_contexts(t)):
            at = slots_of(np.repeat(c[pick], each), node.view(np.uint32))
            at += left_out
            np.take(self.tables[1 + k], at, out=x[1 + k], mode="clip")
        # branches taken at this node, in this text, before
        places, new = before_in_group(np.repeat(text.astype(np.uint64) * np.uint64(len(code.total)), each) + node.view(np.uint32))
        mine = bit[places]
        ones = np.cumsum(mine, dtype=np.int32)
        begin = np.flatnonzero(new)
        times = np.diff(np.append(begin, len(places)))
        nth = np.arange(len(places), dtype=np.int32) - np.repeat(begin.astype(np.int32), times)
        ones -= mine + np.repeat(ones[begin] - mine[begin], times)
        logs = np.log(np.arange(times.max(initial=0) + 1) + PRIOR).astype(np.float32)
        x[4, places] = logs[ones] - logs[nth - ones]
        # the word that followed when the word before was last there
        prior = np.where(np.arange(len(t.h)) > t.first[t.doc], np.concatenate([[0], t.h[:-1]]).astype(np.uint64), np.uint64(1))
        places, new = before_in_group(mix(prior + t.doc.astype(np.uint64)) >> np.uint64(max(int(len(t.h)).bit_length(), 1)))
        follows = np.full(len(t.h), -1)
        follows[places[1:][~new[1:]]] = t.ids[places[:-1][~new[1:]]]
        guess = follows[pick]
        far = np.repeat(np.where(guess >= 0, size[guess], 0).astype(np.int32), each)  # length of the guessed word's code
        maybe = np.flatnonzero(depth < far)
        where = code.first[guess[own[maybe]]] + depth[maybe]
        same = code.node[where] == node[maybe]
        maybe, where = maybe[same], where[same]
        x[5, maybe] = np.float32(2) * code.bit[where] - 1
        cell = np.repeat(lane[text] * GATES, each)
        cell += np.minimum(depth >> 2, 2)
        cell[maybe] += 3
        p = np.empty(len(own), np.float32)
        bounds = np.searchsorted(block[pick], np.arange(int(block.max()) + 2))
        ends = np.cumsum(each)
        bounds = np.concatenate([[0], ends])[bounds]
        lanes = m - np.searchsorted(np.sort(block_of(n - 1)), np.arange(len(bounds) - 1))
        w = np.ascontiguousarray(weights.reshape(m * GATES, INPUTS).T, dtype=np.float32)
        for i, j, active in zip(bounds[:-1].tolist(), bounds[1:].tolist(), (lanes * GATES).tolist(), strict=True):
            at_cell = cell[i:j]
            dot, part = p[i:j], np.empty(j - i, np.float32)
            dot[:] = 0
            for k in range(INPUTS):
                np.take(w[k], at_cell, out=part, mode="clip")
                part *= x[k, i:j]
                dot += part
            np.clip(dot, -15, 15, out=dot)
            np.negative(dot, out=dot)
            np.exp(dot, out=dot)
            dot += 1
            np.divide(1, dot, out=dot)  # of a one
            miss = np.subtract(bit[i:j], dot, out=part)
            miss *= np.float32(STEP)
            for k in range(INPUTS):
                w[k, :active] += np.bincount(at_cell, miss * x[k, i:j], active)
        np.subtract(1 - bit, p, out=p)  # its size is the probability of the bit that came
        token = np.multiply.reduceat(np.abs(p, out=p), ends - each, dtype=float)
        return t, np.bincount(text, np.log10(token), m), w.T.astype(float).reshape(m, GATES, INPUTS)[lane]


def bits(ws: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Slots of every bit under each order (8 bits a row), and the bits."""
    data = np.frombuffer(b" ".join(ws) + b" ", np.uint8)
    size = np.fromiter((len(w) + 1 for w in ws), np.int64, len(ws))
    start = np.repeat(np.cumsum(size) - size, size)
    at = np.arange(len(data))
    place = at - start
    node, bit = NODES[data], BITS[data]
    ctx, far, slots = np.zeros(len(data), np.uint64), 0, []
    for order, width in ORDERS:
        if order:
            for far in range(far + 1, order + 1):
                ctx = (ctx << np.uint64(8)) | np.where(place >= far, data[np.maximum(at - far, 0)], 0).astype(np.uint64)
            h = mix(ctx + np.uint64(order))
        else:
            h = span_hash(data, start, at)
        slots.append(slots_of((h >> np.uint64(32)).astype(np.uint32)[:, None], node, width))
    return slots, bit


def word_lists(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[bytes]]:
    """Words of (h, w, c) rows, in batches of about ``limit`` bytes."""
    for b in batches:
        ws = b.column(1).to_pylist()
        for i, j in chunks(ws, limit):
            yield ws[i:j]


def packed(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Bytes of the spans, one after the other."""
    size = e - s
    return data[np.repeat(s - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def kinds_of_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h, w, c): each kind of word of all texts and its count in training texts; the empty word is the end mark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            h, n, size, raw = map(np.concatenate, zip(*held, strict=True))
            held.clear()
            order = np.argsort(h, kind="stable")
            begin = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
            one, ends = order[begin], np.cumsum(size)
            w, bounds = packed(raw, ends[one] - size[one], ends[one]), np.concatenate([[0], np.cumsum(size[one])]).astype(np.int32)
            w = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(bounds), pa.py_buffer(w)])
            return pa.RecordBatch.from_arrays([pa.array(h[one].view(np.int64)), w, pa.array(np.add.reduceat(n[order], begin))], names=["h", "w", "c"])

        for b in batches:
            texts, train = texts_of(b.column(0)), b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in chunks(texts):
                data, s, e, first = words(texts[i:j], NONSPACE)
                h, at, back = np.unique(span_hash(data, s, e), return_index=True, return_inverse=True)
                n = np.bincount(back, np.repeat(train[i:j], np.diff(first)), len(h)).astype(np.int64)
                held.append((h, n, e[at] - s[at], packed(data, s[at], e[at])))
                held.append((np.array([END]), np.array([train[i:j].sum()]), np.zeros(1, np.int64), np.zeros(0, np.uint8)))
                if sum(len(x[0]) for x in held) > KINDS:
                    yield out()
        if held:
            yield out()

    rows = docs.select(F.col(f"`{text_col}`").cast("string"), remainder(id_col) != 1).mapInArrow(count, "h long, w binary, c long")
    return rows.groupBy("h", "w").agg(F.sum("c").alias("c"))


def tally(table: np.ndarray, slots: np.ndarray, bit: np.ndarray) -> None:
    """Adds bits to a table of (ones, zeros) by slot."""
    at = (1 - bit).astype(np.int64)
    at *= table.shape[1]
    at += slots
    np.add.at(table.reshape(-1), at, table.dtype.type(1))


def packed_entries(t: np.ndarray) -> bytes:
    """What is not 0 in a block of a table: the bytes of a count, then places, ones and zeros."""
    at = np.flatnonzero(t.any(axis=0))
    n = t[:, at]
    size = next(k for k in (1, 2, 4, 8) if n.max(initial=0) < 1 << (8 * k - 1))
    return bytes([size, 0]) + at.astype(np.uint16).tobytes() + n.astype(f"u{size}").tobytes()


def entries(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = raw[0]
    n = (len(raw) - 2) // (2 + 2 * size)
    return np.frombuffer(raw, np.uint16, n, 2), np.frombuffer(raw[2 + 2 * n :], f"u{size}").astype(np.int64).reshape(2, n)


def in_tasks_of(df: DataFrame, size: float) -> DataFrame:
    """``df``, of about ``size`` bytes, in tasks of TASK_BYTES at least, as each task yields tables of its own."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(cores, int(size / TASK_BYTES)))


def summed_tables(parts: DataFrame, widths: list[int]) -> list[np.ndarray]:
    """Tables of (ones, zeros), in half precision, both scaled down where one is large, from blocks (o, b, t), which Spark sums in two tiers: those of a few tasks, then these, so
    that no task gathers all tables of a block at once."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        t = np.zeros((2, 1 << BLOCK_BITS), np.int64)
        for x in rows["t"]:
            at, n = entries(x)
            t[:, at] += n
        return rows[["o", "b"]].iloc[:1].assign(t=[packed_entries(t)])

    some = parts.withColumn("s", F.spark_partition_id() % 16).groupBy("o", "b", "s").applyInPandas(add, "o int, b int, t binary")
    tables = [np.zeros((2, 1 << w), np.float32) for w in widths]
    for r in some.groupBy("o", "b").applyInPandas(add, "o int, b int, t binary").toLocalIterator():
        at, n = entries(r["t"])
        tables[r["o"]][:, (r["b"] << BLOCK_BITS) + at.astype(np.int64)] = n
    return [(t * np.minimum(1, 60_000 / np.maximum(t.max(axis=0), 1))).astype(np.float16) for t in tables]


def blocks_of(tables: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (o, b, t) of what is not empty in the tables."""
    for o, t in enumerate(tables):
        for b in range(t.shape[1] >> BLOCK_BITS):
            part = t[:, b << BLOCK_BITS : (b + 1) << BLOCK_BITS]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([o], pa.int32()), pa.array([b], pa.int32()), pa.array([packed_entries(part)])], names=["o", "b", "t"])


def code_counts(docs: DataFrame, id_col: str, text_col: str, code, tokens: int) -> list[np.ndarray]:
    """For each hashed word context: ones and zeros, by slot, over the code bits of all training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held = [np.zeros((2, 1 << TABLE_BITS), np.int32) for _ in range(HASHED)], 0
        for b in batches:
            texts = texts_of(b.column(0))
            for i, j in chunks(texts):
                t = tokens_of(texts[i:j], code.value.keys)
                _, _, _, node, bit = code_bits(t, code.value, np.arange(len(t.h)))
                node, each = node.view(np.uint32), np.diff(code.value.first)[t.ids]
                if held + len(bit) > MOST_BITS:  # before a count could grow beyond 32 bits
                    yield from blocks_of(tables)
                    tables, held = [np.zeros_like(x) for x in tables], 0
                held += len(bit)
                for table, c in zip(tables, word_contexts(t), strict=True):
                    tally(table, slots_of(np.repeat(c, each), node), bit)
        yield from blocks_of(tables)

    rows = docs.where(remainder(id_col) != 1).select(F.col(f"`{text_col}`").cast("string"))
    return summed_tables(in_tasks_of(rows, 8.0 * tokens).mapInArrow(count, "o int, b int, t binary"), [TABLE_BITS] * HASHED)


def first_weights() -> np.ndarray:
    """Weights that every text begins with: constants, whatever the texts. Where the last predictor doesn't fit, contexts of
    words count for more than what the node alone and the text itself say."""
    return np.repeat([[0.2, 0.45, 0.45, 0.5, 0.2, 1.0], [0.25, 0.35, 0.35, 0.25, 0.3, 1.0]], GATES // 2, axis=0)


def context_counts(rare: DataFrame, n: int = 0) -> list[np.ndarray]:
    """For each order: ones and zeros, by slot, over these ``n`` kinds of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros((2, 1 << w), np.int64) for _, w in ORDERS]
        for ws in word_lists(batches, 1 << 18):
            slots, bit = bits(ws)
            for t, s in zip(tables, slots, strict=True):
                tally(t, s.ravel(), bit.ravel())
        yield from blocks_of(tables)

    return summed_tables(in_tasks_of(rare, 32.0 * n).mapInArrow(count, "o int, b int, t binary"), [w for _, w in ORDERS])


def stretch(counts: list[np.ndarray], left_out: bool = False) -> list[np.ndarray]:
    """Of each order, by slot: log odds of a one, and the cell of the weights, by order and grade of how often the context
    was seen, side by side as ``INPUT``; with one zero left out, and then with one one left out, where that is asked for."""
    out = []
    for o, (ones, zeros) in enumerate(counts):
        ones, zeros = ones.astype(np.float32), zeros.astype(np.float32)
        both = [(ones, zeros)] if not left_out else [(ones, np.maximum(zeros - 1, 0)), (np.maximum(ones - 1, 0), zeros)]
        ones, zeros = map(np.concatenate, zip(*both, strict=True))
        x = np.empty(len(ones), INPUT)
        x["odds"] = np.log((ones + np.float32(DELTA)) / (zeros + np.float32(DELTA)))
        x["cell"] = o * SEEN + np.minimum(np.log2(ones + zeros + 1), SEEN - 1).astype(np.int32)
        out.append(x.view(np.int64))
    return out


def inputs_of(ready: list, slots: list[np.ndarray], left_out: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each order: the cell of the weights and the log odds of each bit. The gate is the grade of the last order."""
    found = []
    for s, x in zip(slots, ready, strict=True):
        found.append(x[s.ravel() if left_out is None else s.ravel() + left_out * np.int32(len(x) // 2)].view(INPUT))
    gate = (found[-1]["cell"] - (len(ORDERS) - 1) * SEEN).astype(np.int64) * (len(ORDERS) * SEEN)
    for x in found:
        yield gate + x["cell"], x["odds"]


def start_weights() -> np.ndarray:
    """Weights by gate, order and grade of seenness. The gate is the grade of the whole word so far: as it is seen
    more often, weight goes from the shorter contexts to it."""
    w = np.full((SEEN, len(ORDERS), SEEN), 0.3)
    trust = np.linspace(0.2, 1, SEEN)
    w[:, :-1] *= (1 - trust)[:, None, None]
    w[:, -1] = trust[:, None]
    w[:, :, 0] = 0
    return w


def refine(w: np.ndarray, square: np.ndarray, ws: list[bytes], ready: list) -> None:
    """One step of the mixer, in place, on a batch of kinds of words; each is predicted with itself left out."""
    slots, bit = bits(ws)
    y, flat, dot, ins = bit.ravel(), w.ravel().astype(np.float32), np.zeros(bit.size, np.float32), []
    for cell, odds in inputs_of(ready, slots, y):
        dot += flat[cell] * odds
        ins.append((cell, odds))
    miss = (y - 1 / (1 + np.exp(-np.clip(dot, -20, 20)))) / np.float32(len(y))
    slope = sum(np.bincount(cell, miss * odds, flat.size) for cell, odds in ins).reshape(w.shape)
    square += slope**2
    w += RATE * slope / np.sqrt(square + 1e-12)


def mixer(rare: DataFrame, tables) -> np.ndarray:
    """Weights for spelled words, refined online in each task over its kinds of words, averaged by words seen."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = start_weights()
        square, mass, ready = np.zeros(w.shape), 0, stretch(tables.value, left_out=True)
        for ws in word_lists(batches, BATCH):
            refine(w, square, ws, ready)
            mass += len(ws)
        if mass:
            yield pa.RecordBatch.from_arrays([pa.array([(w * mass).tobytes()]), pa.array([float(mass)])], names=["w", "mass"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        w = np.sum([np.frombuffer(x) for x in rows["w"]], axis=0)
        return pd.DataFrame({"w": [w.tobytes()], "mass": [rows["mass"].sum()]})

    got = rare.mapInArrow(learn, "w binary, mass double")
    got = got.withColumn("s", F.spark_partition_id() % 64).groupBy("s").applyInPandas(add, "w binary, mass double").toPandas()
    if not len(got):
        return start_weights()
    return (np.frombuffer(add(got)["w"].iloc[0]) / got["mass"].sum()).reshape(SEEN, len(ORDERS), SEEN)


def word_costs(ws: list[bytes], ready: list, weights: np.ndarray) -> np.ndarray:
    """log10 probability of each word, spelled, its ending blank included."""
    slots, bit = bits(ws)
    dot, flat = np.zeros(bit.size, np.float32), weights.ravel().astype(np.float32)
    for cell, odds in inputs_of(ready, slots):
        dot += flat[cell] * odds
    np.clip(dot, -20, 20, out=dot)
    dot[bit.ravel() == 1] *= -1
    p = np.multiply.reduce((1 / (1 + np.exp(dot))).reshape(-1, 8), axis=1, dtype=float)  # of each byte
    ends = np.concatenate([[0], np.cumsum([len(w) + 1 for w in ws])])
    return per_segment(np.log10(p), ends)


def costs(kinds: DataFrame, tables, weights: np.ndarray) -> DataFrame:
    """(h, c, lp): log10 of the probability of each kind of word, spelled."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = stretch(tables.value)
        for b in batches:
            ws = b.column(1).to_pylist()
            p = [word_costs(ws[i:j], ready, weights) for i, j in chunks(ws, 1 << 17)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.concatenate(p) if p else np.zeros(0))], names=["h", "c", "lp"])

    return kinds.mapInArrow(score, "h long, c long, lp double")


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, vocab: int = VOCAB) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every text."""
    sc = docs.sparkSession.sparkContext
    kinds = written(kinds_of_words(docs, id_col, text_col))
    total = kinds.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("once")).first()
    coded, spelled = most_frequent(kinds, "c", vocab)[0].select("h", "c").toPandas(), kinds.where("c > 0")
    others = max(total["n"] - int(coded["c"].sum()), total["once"])  # new words are as likely as those seen once
    code = sc.broadcast(huffman(coded["h"].to_numpy(np.int64).view(np.uint64), coded["c"].to_numpy(np.int64), others))
    tables = sc.broadcast(context_counts(spelled, total["v"]))
    cost = written(costs(kinds, tables, mixer(spelled, tables)))
    tables.destroy()
    counts = sc.broadcast(code_counts(docs, id_col, text_col, code, total["n"]))
    often, rare = most_frequent(cost, "c", frequent)
    top = often.toPandas()
    key = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    known = sc.broadcast((key[order], top["c"].to_numpy(np.int64)[order], top["lp"].to_numpy(float)[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Mixer.ready(code.value, counts.value, first_weights())
        keys, c, lp = known.value
        logs = np.log10(c + 0.5)
        for b in batches:
            texts, train = texts_of(b.column(3)), b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in chunks(texts, LANES):
                t, score, _ = model.mixed(texts[i:j], train[i:j])
                m, escaped = j - i, t.ids == len(code.value.keys)
                at = np.minimum(np.searchsorted(keys, t.h), max(len(keys) - 1, 0))
                hit = keys[at] == t.h if len(keys) else np.zeros(len(t.h), bool)
                on, at, spelled = t.doc[hit], at[hit], escaped[hit]
                if len(keys):
                    cols = [np.bincount(on, c[at] > 0, m).astype(np.int64), np.bincount(on, logs[at], m), score + np.bincount(on[spelled], lp[at[spelled]], m)]
                else:
                    cols = [np.zeros(m, np.int64), np.zeros(m), score]
                # the rest is joined: the hash, and whether the word is spelled
                bound = np.searchsorted(t.doc[~hit], np.arange(m + 1)).astype(np.int32)
                missed = pa.StructArray.from_arrays([pa.array(t.h[~hit].view(np.int64)), pa.array(escaped[~hit])], names=["h", "e"])
                cols = [b.column(0).slice(i, m), b.column(1).slice(i, m), np.diff(t.first), per_segment(t.size + 1, t.first), *cols, pa.ListArray.from_arrays(pa.array(bound), missed)]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], names=["rid", "id", "n", "size", "known", "base", "score", "missed"])

    id_type = docs.select(f"`{id_col}`").dtypes[0][1]
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("id"), (remainder(id_col) != 1).alias("train"), F.col(f"`{text_col}`").cast("string").alias("text"))
    part = written(rows.mapInArrow(run, f"rid long, id {id_type}, n long, size long, known long, base double, score double, missed array<struct<h: long, e: boolean>>"))
    counts.destroy(), known.destroy()
    more = part.select("rid", F.inline("missed")).join(rare.hint("merge"), "h")
    more = more.groupBy("rid").agg(F.count_if(F.col("c") > 0).alias("known_"), F.sum(F.log10(F.col("c") + 0.5)).alias("base_"), F.sum(F.when(F.col("e"), F.col("lp")).otherwise(0.0)).alias("score_"))
    both = part.drop("missed").join(more.hint("merge"), "rid", "left")
    both = both.select("id", "n", "size", *[(F.col(c) + F.coalesce(f"{c}_", F.lit(0))).alias(c) for c in ("known", "base", "score")])
    unit = float(np.log10(total["n"] + 0.5 * (total["v"] + 1)))
    return both.select(
        F.col("id").alias(id_col),
        (remainder("id") == 1).alias("held_out"),
        F.col("n").alias("n_tokens"),
        F.col("known").cast("long").alias("n_known"),
        F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n") * unit).alias("base_score"),
        F.col("score"),
        (-F.col("score") * float(np.log2(10)) / F.col("size")).alias("bits_per_byte"),
    )
