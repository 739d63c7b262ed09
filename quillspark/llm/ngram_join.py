"""N-gram Jaccard join by T-occurrence search, in the manner of DivideSkip.

A document is the set of its distinct word shingles. The inverted lists of a set are divided: with T the overlap that
any partner must reach, L = T - 1 lists are long, so that T - L = 1: a partner occurs in at least one short list. The
short lists are merged by Spark's sort-merge on the shingle, which yields candidates; the long lists are never read:
each is probed for a candidate by binary search, in the candidate's sorted set. Length and position filters, and sketches of the sets,
come before the probes. "Short" means early in a fixed global order: shingles that many documents share, counted over the
whole corpus, come last, by count; of the others those of rare words, counted likewise, come first. (Any fixed order
gives exact results; this one keeps shared passages, and what texts have in common by chance, out of the lists that
are read.)

Large groups of near copies share all their lists. They are linked without all pairs: first each member of a list is
tried against two leaders of the list only, one of them the member with the least of its own; what is linked then is one
component. After that only pairs of a list that lie in different components, one of them not that of the first leader,
are still tried. So no link between
different components is lost, and a group of n near copies takes about n probes.

Equal sets are one node from the start. Defined results: a text with fewer words than a shingle is one shingle of all
its words; null, empty and wordless texts have an empty set and are linked with nothing; rows with a null id take no
part, and come back with a null component; repeated ids come back as often as they came; ids must be whole numbers;
very long texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from quillspark.llm.components import components
from quillspark.llm.store import most_frequent, written
from quillspark.llm.textops import NONSPACE, chunks, map_texts, mix, per_segment, span_hash, texts_of, words

#: Shingles, and words, whose counts are broadcast for the order (16 bytes each); ids broadcast for a semi-join at most.
COMMON, COMMON_WORDS, BROADCAST_IDS = 1 << 18, 1 << 16, 1 << 20
#: Bits of a set's parity sketch, in longs of 64.
SKETCH = [f"b{i}" for i in range(4)]
_MULTIPLIERS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def lookup(keys: np.ndarray, values: np.ndarray, h: np.ndarray) -> np.ndarray:
    """values of h in sorted keys; 0 where there is none."""
    if not len(keys):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, values[at], 0)


def shingle_sets(texts: list[bytes], k: int, common_words: tuple[np.ndarray, np.ndarray] | None = None) -> tuple:
    """Hashes of each text's distinct shingles, sorted, and each text's first (and a last bound).

    With ``common_words`` also each shingle's commonness, the sum of the binary logarithms of its words' counts;
    without, the hashes of all words.
    """
    data, s, e, first = words(texts, NONSPACE)
    h = span_hash(data, s, e)
    n = np.diff(first)
    total = max(len(h) - k + 1, 0)
    acc = np.full(total, k, np.uint64)
    grade = np.zeros(total, np.int64)
    per_word = np.zeros(len(h), np.int64) if common_words is None else np.ceil(np.log2(lookup(*common_words, h) + 1)).astype(np.int64)
    for j in range(k if total else 0):
        acc += h[j : j + total] * _MULTIPLIERS[j]
        grade += per_word[j : j + total]
    owner = np.repeat(np.arange(len(texts)), n)
    whole = owner[:total] == owner[k - 1 :] if total else np.zeros(0, bool)
    acc, grade, doc = mix(acc[whole]), grade[whole], owner[:total][whole]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        more = np.array([int(n[d]) + sum(int(h[first[d] + j]) * int(_MULTIPLIERS[j]) for j in range(n[d])) & (1 << 64) - 1 for d in short], np.uint64)
        acc, doc, grade = np.concatenate([acc, mix(more)]), np.concatenate([doc, short]), np.concatenate([grade, np.zeros(len(short), np.int64)])
    order = np.lexsort((acc, doc))
    acc, doc = acc[order], doc[order]
    new = np.ones(len(acc), bool)
    new[1:] = (acc[1:] != acc[:-1]) | (doc[1:] != doc[:-1])
    doc = doc[new]
    return acc[new], np.searchsorted(doc, np.arange(len(texts) + 1)), h if common_words is None else grade[order][new]


def set_keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set, whatever the order of its shingles."""
    return per_segment(mix(h ^ np.uint64(0x5851F42D4C957F2D)), first).view(np.int64)


def sketches(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of SKETCH longs for each set: bit i is the parity of its shingles that fall on i.

    Each shingle that only one of two sets has turns one bit, so their sketches differ in no more bits than the sets in
    shingles: pairs with more different bits can't reach the overlap."""
    m, bits = len(first) - 1, 64 * len(SKETCH)
    doc = np.repeat(np.arange(m), np.diff(first))
    odd = np.bincount(doc * bits + (h >> np.uint64(40)).astype(np.int64) % bits, minlength=m * bits).reshape(m, bits) & 1
    return np.packbits(odd.astype(bool), axis=1).view(np.int64)


def common_counts(docs: DataFrame, text_col: str, k: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(COMMON shingles that most documents share, COMMON_WORDS most frequent words): hashes, sorted, and counts.

    Counted over all documents; a task reports what comes twice at least in a stretch of 2**22."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]

        def report(kind: int) -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held[kind]), return_counts=True)
            least = 2 if kind == 0 else max(2, len(h) and np.sort(n)[-min(len(n), 2 * COMMON_WORDS)])
            h, n = h[n >= least], n[n >= least]
            held[kind] = []
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h.view(np.int64)), pa.array(n)], names=["kind", "h", "n"])

        for b in batches:
            texts = texts_of(b.column(0))
            for i, j in chunks(texts):
                h, _, w = shingle_sets(texts[i:j], k)
                held[0].append(h), held[1].append(w)
                for kind in (0, 1):
                    if sum(map(len, held[kind])) > 1 << 22:
                        yield report(kind)
        for kind in (0, 1):
            if held[kind]:
                yield report(kind)

    seen = written(docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(count, "kind int, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n")))

    def table(kind: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        top = most_frequent(seen.where(F.col("kind") == kind), "n", size)[0].toPandas()
        h = top["h"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(h)
        return h[order], top["n"].to_numpy(np.int64)[order]

    return table(0, COMMON), table(1, COMMON_WORDS)


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """id, node (a 64-bit key of the set), set size n, its sketch, and the short lists' shingles in the global order."""
    table = docs.sparkSession.sparkContext.broadcast(common_counts(docs, text_col, k))

    def make():
        shingle_counts, word_counts = table.value

        def run(texts: list[bytes]) -> list:
            cols: list[list] = [[], [], []]
            lists: list[np.ndarray] = []
            for i, j in chunks(texts):
                h, first, grade = shingle_sets(texts[i:j], k, word_counts)
                n = np.diff(first)
                cols[0].append(set_keys(h, first))
                cols[1].append(n)
                cols[2].append(sketches(h, first))
                grade += lookup(*shingle_counts, h) << 12  # words' grades stay below: 64 words of at most 2**63
                h = h[np.lexsort((grade, np.repeat(np.arange(j - i), n)))]  # stable: by hash where grades are equal
                signed = h.view(np.int64)
                need = -(-n * num // den)
                lists += [signed[a : a + m] for a, m in zip(first[:-1].tolist(), np.where(n > 0, n - need + 1, 0).tolist(), strict=True)]
            return [*map(np.concatenate, cols[:2]), *np.ascontiguousarray(np.concatenate(cols[2]).T), pa.array(lists, pa.list_(pa.int64()))]

        return run

    fields = [T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), *(T.StructField(b, T.LongType()) for b in SKETCH), T.StructField("short", T.ArrayType(T.LongType()))]
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return map_texts(ids, "text", make, fields, keep=["id"])


def sets_of(docs: DataFrame, id_col: str, text_col: str, k: int, ids: DataFrame) -> DataFrame:
    """(node, set): sorted shingle hashes, as bytes, of the documents with these distinct ids."""
    ids = ids.hint("broadcast" if ids.count() <= BROADCAST_IDS else "merge")
    some = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(ids, "id", "left_semi")

    def make():
        def run(texts: list[bytes]) -> list:
            nodes, out = [], []
            for i, j in chunks(texts):
                h, first, _ = shingle_sets(texts[i:j], k)
                nodes.append(set_keys(h, first))
                out += [h[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            return [np.concatenate(nodes), out]

        return run

    return map_texts(some, "text", make, [T.StructField("node", T.LongType()), T.StructField("set", T.BinaryType())], keep=[]).dropDuplicates(["node"])


def probe(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose sets overlap enough: the smaller set's lists are probed by binary search in the larger."""
    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(den * both >= num * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    joined = pairs.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "sa", "sb")
    return joined.mapInArrow(test, "u long, v long")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """id, n_shingles and component_id of every row: documents link when den * overlap >= num * union."""
    sig = written(signatures(docs, id_col, text_col, k, num, den))
    live = sig.where("id IS NOT NULL AND n > 0")
    nodes = written(live.groupBy("node", "n").agg(F.min("id").alias("rep"), *[F.min(b).alias(b) for b in SKETCH], F.min_by("short", "id").alias("short")))
    posts = nodes.select("node", F.col("n").cast("int").alias("n"), F.posexplode("short").alias("i", "h"))
    # one exchange by shingle: each list's leaders, and lists of one member go. The first leader is the member with the
    # least before the shingle, so with the least that is its own: the middle of a group of near copies.
    by_list = W.partitionBy("h")
    lists = posts.withColumn("l", F.min(F.struct("i", "node", "n")).over(by_list)).withColumn("s", F.min(F.struct("node", "i", "n")).over(by_list))
    lists = lists.withColumn("size", F.count("*").over(by_list)).where("size > 1")
    names = [F.col(f"{a}.{b}").alias(c) for a, cs in (("l", ("lead", "li", "ln")), ("s", ("second", "si", "sn"))) for b, c in zip(("node", "i", "n"), cs, strict=True)]
    lists = written(lists.select("h", "node", "n", "i", F.col("size").cast("int").alias("size"), *names))

    def passes(i: str, n: str, j: str, m: str) -> str:
        """Length, and position: from the first shared shingle on, at places i and j, n - i and m - j can be shared.

        A later shared shingle may fail where the pair would link, but then its first one passes, in another list."""
        return f"({den}L * least({n}, {m}) >= {num}L * greatest({n}, {m}) AND {den + num}L * least({n} - {i}, {m} - {j}) >= {num}L * ({n} + {m}))"

    def alike(x: str, n: str, y: str, m: str):
        """Sketches differ in no more bits than sets with the overlap can."""
        bits = sum((F.bit_count(F.col(x + b).bitwiseXOR(F.col(y + b))) for b in SKETCH), F.lit(0))
        return (den + num) * bits <= (den - num) * (F.col(n).cast("long") + F.col(m))

    def sketch_of(prefix: str, key: str) -> DataFrame:
        return nodes.select(F.col("node").alias(key), *[F.col(b).alias(prefix + b) for b in SKETCH])

    star = lists.where("node != lead").where(passes("i", "n", "li", "ln")).select(F.col("lead").alias("a"), F.col("node").alias("b"), "ln", "n")
    star = star.unionByName(lists.where("node != second").where(passes("i", "n", "si", "sn")).select(F.col("second").alias("a"), F.col("node").alias("b"), F.col("sn").alias("ln"), "n")).distinct()
    star = star.join(sketch_of("x", "a").hint("merge"), "a").join(sketch_of("y", "b").hint("merge"), "b").where(alike("x", "ln", "y", "n"))
    star = written(star.select("a", "b"))

    def ids_of(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        return nodes.select("node", F.col("rep").alias("id")).join(ends.hint("merge"), "node", "left_semi").select("id").distinct()

    sets = written(sets_of(docs, id_col, text_col, k, ids_of(star)))
    linked = components(probe(star, sets, num, den))
    # a list of two has no other pair than that of its leader and its other member, which was tried
    named = lists.where("size > 2").join(linked.select("node", "component").hint("merge"), "node", "left").withColumn("c", F.coalesce("component", "node"))
    heads = named.where("node = lead").select("h", F.col("c").alias("lc"))
    # lists in which all are of the least member's component have nothing to try
    mixed = named.join(heads.hint("merge"), "h").withColumn("out", F.max((F.col("c") != F.col("lc")).cast("int")).over(by_list)).where("out = 1 AND node != lead")
    named = written(mixed.join(sketch_of("", "node").hint("merge"), "node").select("h", "node", "n", "i", "c", "lc", *SKETCH))
    x = named.where("c != lc").select("h", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("i").alias("pb"), F.col("c").alias("cb"), *[F.col(k).alias("x" + k) for k in SKETCH])
    y = named.select("h", F.col("node").alias("a"), F.col("n").alias("na"), F.col("i").alias("pa"), F.col("c").alias("ca"), *[F.col(k).alias("y" + k) for k in SKETCH])
    rest = x.join(y.hint("merge"), "h").where("ca != cb").where(passes("pa", "na", "pb", "nb")).where(alike("x", "nb", "y", "na"))
    rest = written(rest.select("a", "b", "ca", "cb").distinct())
    sets = written(sets_of(docs, id_col, text_col, k, ids_of(rest)))
    more = probe(rest.select("a", "b").distinct(), sets, num, den).select(F.col("u").alias("a"), F.col("v").alias("b")).join(rest.hint("merge"), ["a", "b"])
    merged = components(more.select(F.col("ca").alias("u"), F.col("cb").alias("v"))).select(F.col("node").alias("c"), F.col("component").alias("final"))
    # root of each node: of what its component was merged into, else its component, else itself
    roots = nodes.select("node", "n", "rep").join(linked.hint("merge"), "node", "left").withColumn("c", F.coalesce("component", "node"))
    roots = roots.join(merged.hint("merge"), "c", "left").select("node", "n", "rep", F.coalesce("final", "c").alias("root"))
    roots = written(roots)
    least = roots.groupBy("root").agg(F.min("rep").alias("least"))
    roots = roots.select("node", "n", "root").join(least.hint("merge"), "root").select("node", "n", "least")
    out = sig.select("id", "node", "n").join(roots.hint("merge"), ["node", "n"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without all but the smallest id of each component; rows with a null id stay."""
    drop = written(ngram_join(docs, id_col, text_col, k, num, den).where(f"`{id_col}` != component_id").select(id_col).distinct())
    return docs.join(drop.hint("broadcast" if drop.count() <= BROADCAST_IDS else "merge"), id_col, "left_anti").select(*docs.columns)
