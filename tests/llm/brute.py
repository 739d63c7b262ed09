"""Plain re-statements of the operators' contracts, one document or pair at a time."""

from __future__ import annotations

import hashlib
import re

import numpy as np

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")


def low(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def chat(rows):
    """rows: (conv, turn, role, text) -> conv -> (n_turns, digest, loss chars, loss digest)."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)), len(loss), sha(loss))
    return out


def nearest(ids, vectors, k=20, every=20):
    x = np.array(vectors, float)
    ids = np.array(ids)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def windows(text, n=13):
    w = ALNUM.findall(low(text))
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n, 0) + 1)} if w else set()


def contamination(doc, items, n=13):
    """items: id -> text; gives n_words, n_hit, ids, contaminated."""
    w = ALNUM.findall(low(doc))
    hit, found = set(), set()
    for name, text in items.items() if isinstance(items, dict) else items:
        for p in windows(text, n):
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    found.add(str(name))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def shingles(text, k):
    w = PLAIN.findall(low(text))
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k, 0) + 1)} if w else set()


def groups(docs, k, num, den):
    """docs: (id, text) -> id -> (set size, smallest id reachable)."""
    sets = [(i, shingles(t, k)) for i, t in docs]
    root = {i: i for i, _ in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    holders = {}
    for p, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(p)
    near = {(p, q) for h in holders.values() for p in h for q in h if p < q}
    for p, q in near:
        (a, x), (b, y) = sets[p], sets[q]
        both = len(x & y)
        if den * both >= num * (len(x) + len(y) - both):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(s), find(i)) for i, s in sets}


def phrases(text, table):
    w = ALNUM.findall(low(text))
    at = [(i, label) for p, label in table.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    places = sorted(i for i, _ in at)
    return len(w), len(at), places[0] if at else None, places[-1] if at else None, ",".join(sorted({x for _, x in at}))
