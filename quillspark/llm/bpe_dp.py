"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a pre-token exactly one token can end its encoding. An Aho-Corasick automaton over the vocabulary
(the suffix links of all tokens) lists the tokens that end at each position, longest first; the one whose pair with
the last token of the prefix before it is compatible, that is, merges never cross their border, is stored. The
back-pointers then give the ids. Work is linear in the text but for the few candidates at each position.

Two tokens are compatible when no merge rule joins what stood at their border at any time: the right edge of the
first and the left edge of the second are taken apart, latest merge first, and each pair that stood there together
is looked up.

Encodings of kinds of pre-tokens of ``LONGEST`` characters at most are kept in a worker's cache, emptied at ``CACHE``
entries; longer ones are encoded where they stand. Texts are cut at special
strings, which get their own ids. Texts with code points of unsure class are cut by the tokenizer library's
pre-tokenizer; their pre-tokens are encoded the same way.

Defined results: null and empty texts have no ids; rows are kept as they are; extra columns stay, and those named as a
result are replaced; an empty table gives an empty table; very long texts are encoded whole; unknown ids cannot be decoded and raise KeyError.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillspark.llm.pretokens import hashes, pieces, specials, split
from quillspark.llm.textops import chunks, map_texts, per_segment

CACHE, LONGEST, PAIRS, LONG = 1 << 18, 64, 1 << 17, 1 << 30


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class PrefixEncoder:
    """Tables of a byte-level BPE vocabulary and the search over prefixes."""

    def __init__(self, path: str) -> None:
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.chars = byte_chars()
        self.table = {b: c for b, c in enumerate(self.chars)}
        value = {c: b for b, c in enumerate(self.chars)}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.joins: dict[tuple[int, int], int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            i, j, k = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.joins.setdefault((i, j), r)
            if k not in self.parts:
                self.parts[k], self.rank[k] = (i, j), r
        self.special = dict(specials(path))
        by_id = {i: bytes(value[c] for c in t) for t, i in self.vocab.items() if t not in self.special}
        self.bytes_of: dict[int, bytes] = by_id | {i: t.encode() for t, i in self.special.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.vocab.items():
            if t not in self.special and (len(t) == 1 or (i in self.parts and self.own(i))):
                self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}

    def own(self, token: int) -> bool:
        """A token's text encodes to the token: its two halves meet only in the merge that makes it."""
        a, b = self.parts[token]
        return self.crossing(a, b) == self.rank[token]

    def crossing(self, a: int, b: int) -> int:
        """Rank of the first merge across the border of tokens a and b; LONG if there is none.

        At any time the border has one token on either side; undoing the later of the two merges goes back in
        time. A merge of the pair happens if its rank comes before that which uses up either; of equal ranks the
        left place goes first.
        """
        joins, rank, parts = self.joins, self.rank, self.parts
        until_a = until_b = LONG
        first = LONG
        while True:
            r = joins.get((a, b), LONG)
            if r < until_a and r <= until_b and r < LONG:
                first = r
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return first
            if ra > rb:
                until_a, a = ra, parts[a][1]
            else:
                until_b, b = rb, parts[b][0]

    def encode(self, pretoken: str) -> list[int]:
        """Ids of one pre-token."""
        word = pretoken.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table)
        if (i := self.vocab.get(word)) is not None and (len(word) == 1 or (i in self.parts and self.own(i))):
            return [i]
        last: list[int] = [-1] * (len(word) + 1)
        back = [0] * (len(word) + 1)
        fits = self.fits
        for end, (t, n) in self.automaton.iter(word):
            end += 1
            if last[end] < 0:
                if n == end:
                    last[end], back[end] = t, 0
                elif (p := last[end - n]) >= 0:
                    ok = fits.get(p << 20 | t)
                    if ok is None:
                        if len(fits) > PAIRS:
                            fits.clear()
                        ok = fits[p << 20 | t] = self.crossing(p, t) == LONG
                    if ok:
                        last[end], back[end] = t, end - n
        ids, end = [], len(word)
        while end:
            ids.append(last[end])
            end = back[end]
        return ids[::-1]

    def decode(self, ids: Iterable[int]) -> bytes:
        """Bytes of ids, special tokens kept."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(2)
def encoder(path: str) -> PrefixEncoder:
    """One set of tables for each worker process."""
    return PrefixEncoder(path)


@lru_cache(2)
def _kept(path: str) -> dict[int, tuple[str, bytes, int]]:
    """Encodings of kinds of pre-tokens, by hash; a worker's tasks share them."""
    return {}


def _encode_batches(path: str) -> Callable[[list[bytes]], Iterable[tuple[str, bytes, int]]]:
    """For each text: its ids as text, the bytes decoded from them, their number."""
    enc, cache = encoder(path), _kept(path)
    marks = list(enc.special)

    def entry(ids: list[int]) -> tuple[str, bytes, int]:
        return ",".join(map(str, ids)), enc.decode(ids), len(ids)

    of_mark = {m: entry([i]) for m, i in enc.special.items()}

    @lru_cache(1)
    def library():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path).pre_tokenizer

    def run(texts: list[bytes]) -> Iterable[tuple[str, bytes, int]]:
        parts, first, n_marks = pieces(texts, marks)
        cp, s, e, at, hard = split(parts)
        h = hashes(cp, s, e)
        kinds, where, back = np.unique(h, return_index=True, return_inverse=True)
        kinds = kinds.tolist()
        if len(cache) + len(kinds) > CACHE:
            cache.clear()
        found = []
        for x, w in zip(kinds, where.tolist(), strict=True):
            if (got := cache.get(x)) is None:
                got = entry(enc.encode(cp[s[w] : e[w]].tobytes().decode("utf-32-le", "surrogatepass")))
                if e[w] - s[w] <= LONGEST:
                    cache[x] = got
            found.append(got)
        shown, plain = [x[0] for x in found], [x[1] for x in found]
        counts = per_segment(np.array([x[2] for x in found], np.int64)[back] if found else np.zeros(0, np.int64), at).tolist()
        back, at = back.tolist(), at.tolist()
        for k, t in enumerate(texts):
            if first[k + 1] == first[k] + 1 and not hard[p := first[k]]:
                mine = back[at[p] : at[p + 1]]
                yield ",".join(map(shown.__getitem__, mine)), b"".join(map(plain.__getitem__, mine)), counts[p]
                continue
            out: list[tuple[str, bytes, int]] = []
            seen = 0
            for p in range(first[k], first[k + 1]):
                if p > first[k]:
                    seen += len(parts[p - 1])
                    m = _mark_at(t, seen, marks)
                    out.append(of_mark[m])
                    seen += len(m)
                if hard[p]:
                    out += [entry(enc.encode(parts[p][a:b])) for _, (a, b) in library().pre_tokenize_str(parts[p])]
                else:
                    out += map(found.__getitem__, back[at[p] : at[p + 1]])
            yield ",".join(x[0] for x in out), b"".join(x[1] for x in out), sum(x[2] for x in out)

    return run


def _mark_at(text: bytes, place: int, marks: list[str]) -> str:
    t = text.decode("utf-8", "replace")
    return next(m for m in sorted(marks, key=len, reverse=True) if t.startswith(m, place))


def encode_texts(docs: DataFrame, path: str, text_col: str = "text", ids: bool = True, digests: bool = True) -> DataFrame:
    """All columns of ``docs`` with token_ids array<int>, n_tokens and, for checks, hex digests of the comma-joined
    ids and of the text decoded from them. ``ids`` and ``digests`` choose which of these are wanted."""
    fields = [T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("token_ids", T.ArrayType(T.IntegerType()))] * ids
    fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] * digests

    def make() -> Callable:
        encode = _encode_batches(path)

        def run(texts: list[bytes]) -> list:
            cols: list[list] = [[] for _ in fields]
            for i, j in chunks(texts):
                for joined, plain, n in encode(texts[i:j]):
                    row: list = [n]
                    if ids:
                        row.append(np.array(joined.split(","), np.int32) if joined else np.zeros(0, np.int32))
                    if digests:
                        decoded = plain.decode("utf-8", "replace")
                        row += [hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            if ids:
                cols[1] = pa.array(cols[1], pa.list_(pa.int32()))
            return cols

        return run

    return map_texts(docs, text_col, make, fields)


def decode_ids(df: DataFrame, path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """All columns of ``df`` with the text of each id list; null gives empty, as an encoded null text does."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def decoded(col):
        enc = encoder(path)
        return col.map(lambda ids: "" if ids is None else enc.decode(map(int, ids)).decode("utf-8", "replace"))

    return df.withColumn(out_col, decoded(F.col(f"`{ids_col}`")))
