"""Duplicate documents: by key, by content, and near ones by word sets."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.sources.corpus import small_batches, written


def dedup_by_key(docs: DataFrame, chunks: DataFrame, key: str, doc: str, created: str, keep: str = "most_chunks") -> DataFrame:
    """'keep' or 'delete' for each document of a group of one trimmed lower-case key: the one with most chunks stays
    (or the newest), then the newest, then the smallest id."""
    n = chunks.groupBy(doc).agg(F.count("*").alias("chunks"))
    d = docs.join(n, doc, "left").na.fill(0, ["chunks"]).withColumn("key", F.lower(F.trim(key)))
    order = ([F.desc("chunks")] if keep == "most_chunks" else []) + [F.desc(created), F.asc(doc)]
    w = W.partitionBy("key")
    return d.withColumn("decision", F.when(F.row_number().over(w.orderBy(*order)) == 1, "keep").otherwise("delete")).withColumn("group_size", F.count("*").over(w))


def dedup_exact(docs: DataFrame, text: str, doc: str, newest: bool = True) -> DataFrame:
    """The documents to keep, one for each content. Only ids and digests are shuffled, partly aggregated."""
    h = docs.select(doc, F.md5(F.coalesce(text, F.lit(""))).alias("digest"))
    return h.groupBy("digest").agg((F.max(doc) if newest else F.min(doc)).alias(doc), F.count("*").alias("copies"))


def apply_dedup(docs: DataFrame, chunks: DataFrame, keep: DataFrame, doc: str) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks of the documents to keep."""
    ids = keep.select(doc).distinct()
    return docs.join(ids, doc, "left_semi"), chunks.join(ids, doc, "left_semi")


def dedup_savings(decisions: DataFrame, size: str) -> DataFrame:
    gone = F.col("decision") == "delete"
    return decisions.agg(
        F.count_if(gone).alias("removed_documents"), F.coalesce(F.sum(F.when(gone, F.col("chunks"))), F.lit(0)).alias("removed_chunks"), F.coalesce(F.sum(F.when(gone, F.col(size))), F.lit(0)).alias("removed_chars"),
        F.round(100 * F.count_if(gone) / F.count("*"), 4).alias("percent"),
    )


#: Bands of a MinHash signature and hashes of a band: at a similarity of 0.8 one pair in 3,000 shares no band.
BANDS, ROWS = 20, 5


def band_keys(sets: DataFrame, bands: int = BANDS, rows: int = ROWS, seed: int = 1, of: DataFrame | None = None) -> DataFrame:
    """(id, n, band, key) of sets (id, n, h: hashes of the words): MinHash of each word set, a key for each band of its
    signature; of the ids in ``of`` alone, where it is given."""
    r = np.random.default_rng(seed)
    a, b = r.integers(0, 1 << 63, (2, bands * rows), dtype=np.uint64)
    a |= np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            hs = t.column(2)
            cut, flat = hs.offsets.to_numpy(), hs.values.to_numpy(zero_copy_only=False).astype(np.uint64)
            keys = np.zeros((t.num_rows, bands), np.uint64)
            for i in range(t.num_rows):
                h = flat[cut[i] : cut[i + 1]]
                # of a long set a stretch at a time: what is held doesn't grow with it
                low = np.min([(h[j : j + 4096, None] * a + b).min(axis=0) for j in range(0, len(h), 4096)], axis=0)
                x = low.reshape(bands, rows)
                keys[i] = np.bitwise_xor.reduce(x * (np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)), axis=1)
            flat_keys = pa.ListArray.from_arrays(np.arange(0, t.num_rows * bands + 1, bands, dtype=np.int32), pa.array(keys.ravel().astype(np.int64)))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), flat_keys], names=["id", "n", "keys"])

    out = sets.mapInArrow(run, f"id {dict(sets.dtypes)['id']}, n int, keys array<long>")
    out = out if of is None else out.join(of.hint("merge"), "id", "left_semi")
    return out.select("id", "n", F.posexplode("keys").alias("band", "key"))


def word_sets(docs: DataFrame, text: str, doc: str) -> DataFrame:
    """(id, n, h) of all documents: sorted hashes of the distinct lower-case words, n of them."""
    words = F.split(F.trim(F.lower(F.coalesce(text, F.lit("")))), r"\s+")
    return docs.select(F.col(doc).alias("id"), F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))).alias("h")).select("id", F.size("h").alias("n"), "h")


def near_duplicates(docs: DataFrame, text: str, doc: str, above: float = 0.8, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """(pairs, membership) of documents whose sets of lower-case words overlap by more than ``above``.

    With ``exact`` no pair is missed. Without, pairs come from the bands of MinHash signatures that two sets share, and no
    list of a word is read: a few are missed (at 0.8 one in 3,000, fewer above), and none is wrong, as similarities are
    exact in either case.

    membership: every document with its class, the smallest id with the same word set (by two hashes of the sorted words).
    pairs: a, b, similarity of linked classes; copies aren't expanded. Prefix filter: with words in order of rarity, a
    pair shares one of each set's first size - ceil(above * size) + 1 words, the sizes differ little, and from the first
    shared word on enough words are left on both sides. Of the smaller set a shorter prefix will do, as the overlap is at
    least 2 * above / (1 + above) of its size. Word sets meet only for what passes, in groups of near copies; they are
    made from the texts anew for each step, and never all of them are shuffled or written."""
    small_batches(docs.sparkSession)
    sets = word_sets(docs, text, doc)  # from here words go by their hashes
    member = sets.select("id", F.xxhash64("h").alias("d1"), F.xxhash64(F.lit(1), "h").alias("d2"))
    classes = member.groupBy("d1", "d2").agg(F.min("id").alias("class_id"))
    membership = member.join(classes.hint("merge"), ["d1", "d2"]).select(F.col("id").alias(doc), "class_id")
    pairs = _sharing_rare_words(sets, above) if exact else _sharing_bands(sets, above, classes.select(F.col("class_id").alias("id")))
    return _similar(written(pairs), docs.select(F.col(doc).alias("id"), F.col(text).alias("text")), above), membership


#: Word sets of near copies that a group of pairs holds of each side at most, and pairs of a group.
HELD, HELD_PAIRS = 512, 1 << 18


def _similar(pairs: DataFrame, docs: DataFrame, above: float) -> DataFrame:
    """Pairs (a, b, similarity) of a saved table of pairs whose word sets, of texts (id, text), are similar enough.

    A word set doesn't go along with each of its pairs. Sets are dealt to parts by the smallest id among them and their
    partners, which near copies have in common, and by salt where that is more than HELD; pairs go to the group of their
    two parts, and a set goes once to each group that has a pair of it."""
    kind = dict(docs.dtypes)["id"]
    ends = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other")))
    leader = written(ends.groupBy("id").agg(F.min("other").alias("other")).select("id", F.least("id", "other").alias("leader")))
    many = leader.groupBy("leader").agg(F.ceil(F.count("*") / HELD).alias("salts"))
    part = leader.join(many.hint("merge"), "leader").select("id", F.xxhash64("leader", F.pmod(F.xxhash64("id"), F.col("salts"))).alias("part"))
    part = written(part)
    groups = max(1, part.count() // HELD, pairs.count() // HELD_PAIRS)
    a, b = (part.select(F.col("id").alias(x), F.col("part").alias(f"p{x}")).hint("merge") for x in "ab")
    group = F.pmod(F.xxhash64(F.least("pa", "pb"), F.greatest("pa", "pb")), F.lit(groups)).alias("g")
    dealt = written(pairs.join(a, "a").join(b, "b").select(group, "a", "b"))
    held = dealt.select(F.col("g").alias("of"), F.explode(F.array("a", "b")).alias("id")).distinct()
    slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS)).cast("int").alias("slot")
    asked = written(part.select(slot).distinct())  # SLOTS at most; most texts without a pair are left out where they are read
    some = docs.withColumn("slot", slot).join(asked.hint("broadcast"), "slot", "left_semi")
    held = held.join(word_sets(some, "text", "id").select("id", "h").hint("merge"), "id").select("of", "id", "h")

    def verify(some: pa.Table, own: pa.Table) -> pa.Table:
        if not some.num_rows:
            return pa.table([pa.array([], some.schema.field(c).type) for c in ("a", "b")] + [pa.array([], pa.float64())], names=["a", "b", "similarity"])
        ids, hs = (pa.concat_arrays(own.column(c).chunks) for c in ("id", "h"))
        cut = hs.offsets.to_numpy().astype(np.int64)
        words, code = np.unique(hs.values.to_numpy(zero_copy_only=False), return_inverse=True)
        at, to = (pc.index_in(some.column(c), value_set=ids).to_numpy().astype(np.int64) for c in ("a", "b"))
        order = np.argsort(at, kind="stable")
        n, both, mine = np.diff(cut), np.zeros(len(at), np.int64), np.zeros(len(words), bool)
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        for i, j in zip(first, np.append(first[1:], len(order)), strict=True):
            own_words = code[cut[at[order[i]]] : cut[at[order[i]] + 1]]
            mine[own_words] = True
            both[order[i:j]] = [np.count_nonzero(mine[code[cut[x] : cut[x + 1]]]) for x in to[order[i:j]].tolist()]
            mine[own_words] = False
        similarity = both / (n[at] + n[to] - both)
        keep = np.flatnonzero(similarity > above)
        return pa.table({"a": some.column("a").take(keep), "b": some.column("b").take(keep), "similarity": similarity[keep]})

    return dealt.groupBy("g").cogroup(held.groupBy("of")).applyInArrow(verify, f"a {kind}, b {kind}, similarity double")


#: Slots that counts of words are kept in, by hash of the word.
SLOTS = 1 << 20
#: Words of prefixes that a group of sets holds, by expectation, and pairs that are looked at together.
GROUP_WORDS, LOOKED_AT = 1 << 21, 1 << 21
#: Buckets of the sketch of a small set, and words to a bucket of a large one.
BUCKETS, BUCKET_WORDS = 128, 4


def _size_classes(above: float) -> np.ndarray:
    """The smallest size of each class: a set's partners that aren't smaller than it are in its class or the next."""
    edges = [0, 1]
    while edges[-1] < 1 << 31:
        edges.append(max(math.floor(edges[-1] / max(above, 1e-6)) + 1, math.ceil(edges[-1] * 1.1)))
    return np.array(edges)


def _prefix(n: np.ndarray, above: float) -> np.ndarray:
    return n - np.ceil(n * above - 1e-9).astype(np.int64) + 1


def _counts(sets: DataFrame, above: float, edges: np.ndarray) -> np.ndarray:
    """Counts of words by slot, and behind them the words in prefixes of sets of each class of sizes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS + len(edges), np.int64)
        for t in batches:
            hs = t.column(0)
            total[:SLOTS] += np.bincount(hs.flatten().to_numpy(zero_copy_only=False) % SLOTS, minlength=SLOTS)
            n = np.diff(hs.offsets.to_numpy())
            np.add.at(total, SLOTS + np.searchsorted(edges, n, "right") - 1, _prefix(n, above))
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(total[slots])], names=["slot", "c"])

    slots = sets.select("h").mapInArrow(count, "slot int, c long").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()
    counts = np.zeros(SLOTS + len(edges), np.int64)
    counts[slots["slot"].to_numpy()] = slots["c"].to_numpy()
    return counts


def _buckets(n: np.ndarray) -> np.ndarray:
    """Buckets of the sketch of a set of n words, a power of two."""
    return np.maximum(BUCKETS, 1 << np.ceil(np.log2(np.maximum(n, 1) / BUCKET_WORDS)).clip(0).astype(np.int64))


class _Sketches:
    """Counts of words by hash, modulo 16. Two sets differ by as many words at least as these counts do in sum; of two
    sketches the larger one is folded to the size of the other."""

    def __init__(self, n: np.ndarray, packed: np.ndarray):
        counts = np.empty(2 * len(packed), np.int8)
        counts[::2], counts[1::2] = packed >> 4, packed & 15
        self.n, self.m, self.at, self.by_size = n, _buckets(n), np.zeros((2, len(n)), np.int64), {}
        starts = np.cumsum(self.m) - self.m
        for m in np.unique(self.m).tolist():
            own, folded = np.flatnonzero(self.m == m), np.flatnonzero(self.m == 2 * m)
            self.at[0, own], self.at[1, folded] = np.arange(len(own)), len(own) + np.arange(len(folded))
            rows = lambda x, k: counts[starts[x[0]] : starts[x[-1]] + k].reshape(len(x), k) if len(x) else np.zeros((0, k), np.int8)  # noqa: E731  n ascends
            twice = rows(folded, 2 * m)
            self.by_size[m] = np.concatenate([rows(own, m), (twice[:, :m] + twice[:, m:]) & 15])

    def near(self, a: np.ndarray, b: np.ndarray, above: float) -> np.ndarray:
        """Whether sets of places a and b, that aren't smaller, may overlap by more than ``above``."""
        out = self.m[b] > 2 * self.m[a]  # too far to compare
        most = (1 - above) / (1 + above) * (self.n[a] + self.n[b]) + 1e-9
        for m, rows in self.by_size.items():
            pairs = np.flatnonzero((self.m[a] == m) & ~out)
            for i in range(0, len(pairs), step := max(1, (LOOKED_AT << 2) // m)):
                k = pairs[i : i + step]
                apart = np.abs(rows[self.at[0, a[k]]] - rows[self.at[(self.m[b[k]] > m).astype(np.int64), b[k]]])
                out[k] = np.minimum(apart, 16 - apart).sum(axis=1, dtype=np.int64) <= most[k]
        return out


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), pa.array(flat))


def _sharing_rare_words(sets: DataFrame, above: float) -> DataFrame:
    """Pairs (a, b) of classes that pass the prefix filter and whose sketches are near enough. Words are in order of the
    count of their slot, then of their hash: any fixed order gives all pairs, and this one has rare words first. Only counts
    by slot are gathered, SLOTS at most; a word that is alone in its slot is in no other set.

    Sets meet by classes of sizes, each with the next larger ones, and there in groups of words by hash, as many as the
    words ask for. A set goes to a group in one row, with its words of the prefix that fall there, their places, and a
    sketch. Equal sets meet in all their groups, where the smallest id stays."""
    edges = _size_classes(above)
    counts = _counts(sets, above, edges)
    by_class = counts[SLOTS:]
    groups = np.maximum(1, -(-(by_class + np.append(by_class[1:], 0)) // GROUP_WORDS))
    first_group = np.cumsum(groups) - groups
    known = sets.sparkSession.sparkContext.broadcast(counts[:SLOTS])
    kind = dict(sets.dtypes)["id"]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            hs = t.column(2)
            cut, flat = hs.offsets.to_numpy().astype(np.int64), hs.flatten().to_numpy(zero_copy_only=False)
            cut = cut - cut[0]
            n = np.diff(cut)
            row = np.repeat(np.arange(len(n)), n)
            count = known.value[flat % SLOTS]
            order = np.lexsort((flat, count, row))
            place = np.arange(len(flat)) - np.repeat(cut[:-1], n) + 1
            head = np.flatnonzero((place <= _prefix(n, above)[row]) & (count[order] > 1))
            m = _buckets(n)
            starts = np.cumsum(m) - m
            buckets = (np.bincount(starts[row] + ((flat >> 20) & (m[row] - 1)), minlength=int(m.sum())) & 15).astype(np.uint8)
            packed = (buckets[::2] << 4 | buckets[1::2]).tobytes()
            sketch = [packed[i // 2 : (i + k) // 2] for i, k in zip(starts.tolist(), m.tolist(), strict=True)]
            digest = [hashlib.blake2b(flat[i:j].tobytes(), digest_size=16).digest() for i, j in itertools.pairwise(cut.tolist())]
            own = np.searchsorted(edges, n, "right") - 1
            for c in (own, own - 1):  # with sets of its class, and as a larger one with those of the class below
                of, word, at = row[head], flat[order[head]], place[head]
                g = first_group[c[of]] + ((word >> 32) & 0x7FFFFFFF) % groups[c[of]]
                order_g = np.lexsort((at, g, of))
                of, g, word, at = of[order_g], g[order_g], word[order_g], at[order_g]
                edge = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(g, prepend=-1) != 0))
                sizes, some = np.diff(np.append(edge, len(of))), of[edge]
                columns = [pa.array(g[edge].astype(np.int32)), t.column(0).take(pa.array(some)), pa.array(n[some].astype(np.int32)), *(pa.array([x[i] for i in some.tolist()], pa.binary()) for x in (digest, sketch))]
                yield pa.RecordBatch.from_arrays([*columns, _lists(word.astype(np.int32), sizes), _lists(at.astype(np.int32), sizes)], names=["g", "id", "n", "digest", "sketch", "ws", "rs"])

    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = int(np.searchsorted(first_group, key[0].as_py(), "right")) - 1
        t = pa.Table.from_batches(list(batches)).select(["id", "n", "digest", "sketch", "ws", "rs"])
        t = t.take(pc.sort_indices(t.select(["digest", "id"]), [("digest", "ascending"), ("id", "ascending")]))
        digest = np.frombuffer(b"".join(t.column("digest").to_pylist()), "V16")
        t = t.take(pa.array(np.flatnonzero(np.append(True, digest[1:] != digest[:-1]))))  # the smallest id of equal sets
        t = t.take(pc.sort_indices(t.column("n"))).combine_chunks()
        ids, n = pa.concat_arrays(t.column("id").chunks), t.column("n").to_numpy().astype(np.int64)
        sketches = _Sketches(n, np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8))
        of = np.repeat(np.arange(len(n)), pc.list_value_length(t.column("ws")).to_numpy())
        word, place = (pc.list_flatten(t.column(x)).to_numpy().astype(np.int64) for x in ("ws", "rs"))
        order = np.lexsort((of, word))
        of, word, place = of[order], word[order], place[order]
        # of a list, in order of size, the sets behind a set that aren't too large for it
        lists = np.cumsum(np.diff(word, prepend=word[:1]) != 0) << 32
        largest = np.minimum(np.floor(n[of] / max(above, 1e-6) + 1e-9), (1 << 32) - 1).astype(np.int64)
        many = np.searchsorted(lists + n[of], lists + largest, "right") - np.arange(len(of)) - 1
        smaller = n[of] - np.ceil(n[of] * (2 * above / (1 + above)) - 1e-9) + 1  # the smaller set's prefix
        mine = np.flatnonzero((many > 0) & (place <= smaller) & (n[of] < edges[c + 1]))
        mine = mine[np.argsort(of[mine], kind="stable")]  # a set's pairs are looked at together
        many = many[mine]
        block = (np.cumsum(many) - many) // LOOKED_AT
        for i, j in itertools.pairwise(np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(mine)).tolist()):
            for low in range(0, int(many[i:j].max()), LOOKED_AT):
                k = np.clip(many[i:j] - low, 0, LOOKED_AT)
                x = np.repeat(mine[i:j], k)
                y = x + 1 + low + np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k)
                s, l = of[x], of[y]
                left = np.minimum(n[s] - place[x], n[l] - place[y]) + 1
                # at a later shared word less is left, but then the first one passes in its own list
                ok = (left >= above / (1 + above) * (n[s] + n[l]) - 1e-9) & (s != l)
                pair = np.unique(s[ok] * len(n) + l[ok])
                s, l = pair // len(n), pair % len(n)
                near = sketches.near(s, l, above)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(z[near])) for z in (s, l)], names=["a", "b"])

    out = sets.mapInArrow(prefixes, f"g int, id {kind}, n int, digest binary, sketch binary, ws array<int>, rs array<int>")
    out = out.groupBy("g").applyInArrow(meet, f"a {kind}, b {kind}")
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sharing_bands(sets: DataFrame, above: float, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes with a band in common and sizes that may fit."""
    keys = written(band_keys(sets, of=classes))
    a, b = ([F.col("id").alias(x), F.col("n").alias(f"n{x}"), "band", "key"] for x in "ab")
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= above * F.greatest("na", "nb"))
    return keys.select(*a).join(keys.select(*b).hint("merge"), ["band", "key"]).where(fits).select("a", "b").distinct()


def near_classes(docs: DataFrame, text: str, doc: str, above: float = 0.8, exact: bool = True) -> DataFrame:
    """A row for each document: its class and the number of other classes that it is linked with."""
    pairs, membership = near_duplicates(docs, text, doc, above, exact)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return membership.join(ends.hint("merge"), "class_id", "left").na.fill(0, ["links"]).select(doc, "class_id", "links")
