"""Pre-tokens of a byte-level BPE tokenizer, found for many texts at once with array operations.

The split is that of public byte-level tokenizers: contractions, an optional space before a run of letters, digits
or other signs, and white space whose last blank goes to the next run. Texts with special strings are cut there
first. Code points beyond those whose class is sure are left to the library (``needs_library``).
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np

from quillspark.llm.textops import span_hash

LETTER, DIGIT, OTHER, SPACE = 1, 2, 3, 0
#: Below this code point assigned characters have had the same class in all Unicode versions for years.
SURE = 0x2E80


@lru_cache(1)
def classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each code point below SURE, and whether it is assigned."""
    kind, sure = np.full(SURE + 1, OTHER, np.uint8), np.zeros(SURE + 1, bool)
    white = {9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F}
    for c in range(SURE):
        cat = unicodedata.category(chr(c))
        sure[c] = cat != "Cn"
        kind[c] = SPACE if c in white else LETTER if cat[0] == "L" else DIGIT if cat[0] == "N" else OTHER
    return kind, sure


@lru_cache(4)
def specials(path: str) -> tuple[tuple[str, int], ...]:
    """Added tokens of a tokenizer file: text and id."""
    with open(path, encoding="utf-8") as f:
        return tuple((t["content"], t["id"]) for t in json.load(f).get("added_tokens", []))


def split(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, start and end of each pre-token, each text's first pre-token (and a last bound), and
    whether a text needs the library."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    offs = np.concatenate([[0], np.cumsum(lens)])
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cp)
    kind_of, sure_of = classes()
    short = np.minimum(cp, SURE)
    kind = kind_of[short]
    unsure = ~sure_of[short]
    hard = np.concatenate([[0], np.cumsum(unsure)])
    hard = hard[offs[1:]] > hard[offs[:-1]]
    if not n:
        z = np.zeros(0, np.int64)
        return cp, z, z, np.zeros(len(texts) + 1, np.int64), hard
    begins = np.zeros(n + 1, bool)  # of texts; n ends the last
    begins[offs] = True
    run = begins[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    blank = np.zeros(n, bool)  # the character before, in the same text, is a plain space
    blank[1:] = (cp[:-1] == 32) & ~begins[1:n]
    ws = kind == SPACE
    start = run & (ws | ~blank)
    follows = np.zeros(n, bool)  # the last white space before something else in the same text
    follows[:-1] = ws[:-1] & ~ws[1:] & ~begins[1:n]
    start |= follows
    q = np.flatnonzero((cp == 39) & run & ~blank)
    q = q[q + 1 < n]
    q = q[(kind[q + 1] == LETTER) & ~begins[q + 1]]
    if len(q):
        a = cp[q + 1]
        b = np.where((q + 2 < n) & ~begins[np.minimum(q + 2, n)], cp[np.minimum(q + 2, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for some, size in ((q[one], 1), (q[two], 2)):
            start[some + 1] = False
            after = some + 1 + size
            start[after[after < n]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    return cp, starts, ends, np.searchsorted(starts, offs), hard


def hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(cp, starts, ends)


def pieces(texts: list[bytes], marks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts cut at special strings, each text's first piece (and a last bound), and the number of marks in each text.

    Of overlapping marks the leftmost counts, then the longest, as a scan from the left finds them.
    """
    found = [t.decode("utf-8", "replace") for t in texts]
    if not any(m in t for m in marks for t in found):
        return found, np.arange(len(texts) + 1), np.zeros(len(texts), np.int64)
    import re

    scan = re.compile("|".join(re.escape(m) for m in sorted(marks, key=len, reverse=True)))
    cut = [scan.split(t) for t in found]
    sizes = np.array([len(c) for c in cut], np.int64)
    return [p for c in cut for p in c], np.concatenate([[0], np.cumsum(sizes)]), sizes - 1
