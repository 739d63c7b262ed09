"""License scans: an exact containment join of text blocks with license templates.

A template is a license notice. A block is a line of a text, a paragraph (lines with words, without one between them
that has none), or a window of as many words as a template has, and a quarter more at the usual threshold, at any place
of the whole text: notices are mostly wrapped, in comments too. Both are sets of words. A block matches a template when
it holds at least ``threshold`` of the template's distinct words. Template words are put in order of their frequency
over the whole corpus, rare ones first. A match then needs

* prefix: a word among the first size - need + 1 of the template's order, where need = ceil(threshold * size);
* length: at least ``need`` words in the block;
* position: from the first shared prefix word on, enough words of the template's order to reach ``need``;

and what passes is checked by exact intersection. In windows, a running count of distinct template words takes the place
of the last two. Of windows that match one after the other the best counts; a window counts beside lines it meets, and
a paragraph beside lines and windows in it, only if it holds more of the template than each of them. Texts are read once for the word counts and once for the join;
templates and the counts of their words are broadcast, bounded by ``MAX_TEMPLATE_WORDS``.

Beside this, the places of fixed phrases (words consecutive) are counted; they alone make the base labels.

Defined results: a null or empty text has no words, labels or places and score 0; repeated rows are kept; other
columns are ignored, the id column stays; an empty table gives an empty table; templates without words match nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.textops import ALNUM, LOWER, chunks, map_texts, span_hash, texts_of, words

#: Fixed phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short notices in wide use, by label.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "apache": "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by": "this work is licensed under a creative commons attribution 4.0 international license",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2.0",
}
THRESHOLD, MAX_TEMPLATE_WORDS = 0.8, 1 << 16


def word_list(text: str) -> list[bytes]:
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(LOWER[np.frombuffer(text.encode(), np.uint8)]))


def hash_words(ws: list[bytes]) -> np.ndarray:
    if not ws:
        return np.zeros(0, np.uint64)
    data, s, e, _ = words(ws, ALNUM)
    return span_hash(data, s, e)


def word_counts(docs: DataFrame, text_col: str, wanted: list[bytes]) -> dict[int, int]:
    """Occurrences in the whole corpus of each wanted word, by hash; counted in each task, summed by Spark."""
    keys = np.unique(hash_words(wanted))

    def count(batches):
        n = np.zeros(len(keys), np.int64)
        for b in batches:
            texts = texts_of(b.column(0))
            for i, j in chunks(texts):
                data, s, e, _ = words(texts[i:j], ALNUM)
                h = span_hash(data, s, e)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                n += np.bincount(at[keys[at] == h], minlength=len(keys))
        yield pa.RecordBatch.from_pandas(pd.DataFrame({"h": keys.view(np.int64), "n": n}), preserve_index=False)

    rows = docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).collect()
    return {r["h"] & (1 << 64) - 1: r["n"] for r in rows}


def windows(h: np.ndarray, cand: np.ndarray, first: np.ndarray, order: np.ndarray, need: int, span: int) -> list[tuple[int, int, int, int]]:
    """The windows of ``span`` words, within one text, with at least ``need`` distinct words of ``order``: start, end,
    overlap and first such word; of an unbroken run of windows the first of the best. ``cand`` has the places of all
    rare words: windows without one of this template's are not looked at."""
    c = cand[np.isin(h[cand], order[: len(order) - need + 1])]
    if not len(c):
        return []
    step = np.zeros(len(h) + 1, np.int32)
    np.add.at(step, np.maximum(c - span + 1, 0), 1)
    np.add.at(step, np.minimum(c + span, len(h)), -1)
    w, known = np.flatnonzero(np.cumsum(step[:-1])), np.sort(order)
    at = np.minimum(np.searchsorted(known, h[w]), len(known) - 1)
    hit = known[at] == h[w]
    w, at = w[hit], at[hit]
    # a word counts in the windows that begin after its last place before, at most span - 1 words back
    by_word = np.argsort(at, kind="stable")
    same = at[by_word[1:]] == at[by_word[:-1]]
    before = np.full(len(w), -1)
    before[by_word[1:][same]] = w[by_word[:-1][same]]
    begin = np.maximum(np.maximum(before, w - span) + 1, first[np.searchsorted(first, w, side="right") - 1])
    points, which = np.unique(np.concatenate([begin, w + 1]), return_inverse=True)
    count = np.cumsum(np.bincount(which[: len(w)], minlength=len(points)) - np.bincount(which[len(w) :], minlength=len(points)))
    good = np.flatnonzero(count >= max(need, 1))
    text = np.searchsorted(first, points[good], side="right")
    out = []
    for run in np.split(good, np.flatnonzero((np.diff(good) > 1) | (np.diff(text) > 0)) + 1):
        if len(run):
            best = run[np.argmax(count[run])]
            a = int(points[best])
            end = int(first[np.searchsorted(first, a, side="right")])
            out.append((a, min(a + span, end), int(count[best]), int(w[np.searchsorted(w, a)])))
    return out


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels array, matches array<struct<label, block, overlap,
    size>> (block: number from 0 of the line, or of the line in which the window's first template word or the paragraph
    stands), labels array and score, the best containment of any template (1 where
    a phrase stands)."""
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    sets = {k: sorted(set(word_list(t))) for k, t in templates.items()}
    sets = {k: v for k, v in sets.items() if v}
    if sum(map(len, sets.values())) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates hold over {MAX_TEMPLATE_WORDS} words; scan them in parts")
    counts = word_counts(docs, text_col, [w for v in sets.values() for w in v]) if sets else {}
    plans = []
    for label, ws in sets.items():
        h = hash_words(ws)
        order = h[np.lexsort((h, np.array([counts.get(int(x), 0) for x in h])))]
        plans.append((label, order, math.ceil(threshold * len(order) - 1e-9)))
    spans = {label: math.ceil(len(word_list(templates[label])) / max(threshold, 0.1) - 1e-9) for label in sets}
    spoken = [(b" ".join(word_list(p)), len(word_list(p)), label) for p, label in phrases.items()]

    def make() -> Callable:
        rare = np.unique(np.concatenate([o[: len(o) - need + 1] for _, o, need in plans])) if plans else np.zeros(0, np.uint64)
        least = min((need for _, _, need in plans), default=0)

        def contained(block: np.ndarray) -> list[tuple[str, int]]:
            """Label and overlap of each template that a block's words match."""
            out = []
            for label, order, need in plans:
                head = len(order) - need + 1
                if len(block) < need:  # length
                    continue
                lead = np.flatnonzero(np.isin(order[:head], block))
                if not len(lead) or len(order) - lead[0] < need:  # prefix, position
                    continue
                if (got := len(lead) + int(np.isin(order[head:], block).sum())) >= need:
                    out.append((label, got))
            return out

        def chunk(texts: list[bytes], out: list[list]) -> None:
            data, s, e, first = words(texts, ALNUM)
            h = span_hash(data, s, e)
            # phrases: on the words alone, one space apart, texts apart by a NUL
            edge = np.zeros(len(texts), np.int64)
            np.cumsum([len(t) + 1 for t in texts[:-1]], out=edge[1:])
            flat = np.where(ALNUM[data], data, 32).astype(np.uint8)
            keep = np.ones(len(flat), bool)
            keep[1:] = (flat[1:] != 32) | (flat[:-1] != 32)
            last = np.append(edge[1:], len(flat)) - 1
            flat[last], keep[last] = 0, True
            raw = flat[keep].tobytes()
            starts = (np.cumsum(keep) - 1)[s]  # place in raw of each word's first byte
            base: dict[int, list[tuple[int, str]]] = {}
            for core, n, label in spoken:
                x = raw.find(core)
                while x >= 0:
                    w = int(np.searchsorted(starts, x))
                    if w < len(starts) and starts[w] == x and w + n <= len(starts) and raw[x + len(core)] in (32, 0):
                        base.setdefault(int(np.searchsorted(first, w, side="right")) - 1, []).append((w, label))
                    x = raw.find(core, x + 1)
            # blocks: lines with a rare template word and enough words
            hits: dict[int, list[dict]] = {}
            if len(h) and len(rare):
                at = np.minimum(np.searchsorted(rare, h), len(rare) - 1)
                cand = np.flatnonzero(rare[at] == h)
                if len(cand):
                    ends_line = data == 10
                    ends_line[last] = True
                    lines = np.flatnonzero(ends_line)
                    line_of = np.searchsorted(lines, s)
                    found: list[tuple[str, int, int, int, int]] = []  # label, words from, to, overlap, word of the block's line
                    for line in np.unique(line_of[cand]).tolist():
                        a, b = np.searchsorted(line_of, [line, line + 1])
                        if b - a < least:
                            continue
                        found += [(label, a, b, got, a) for label, got in contained(np.unique(h[a:b]))]
                    for label, order, need in plans:
                        for a, b, got, word in windows(h, cand, first, order, need, spans[label]):
                            if got > max((x[3] for x in found if x[0] == label and x[1] < b and a < x[2]), default=0):
                                found.append((label, a, b, got, word))
                    apart = np.zeros(len(h), np.int64)
                    apart[1:] = np.diff(line_of) > 1
                    apart[first[first < len(h)]] = 1
                    para_of = np.cumsum(apart)
                    for para in np.unique(para_of[cand]).tolist():
                        a, b = np.searchsorted(para_of, [para, para + 1]).tolist()
                        if b - a < least or line_of[a] == line_of[b - 1]:
                            continue
                        for label, got in contained(np.unique(h[a:b])):
                            if got > max((x[3] for x in found if x[0] == label and x[1] < b and a < x[2]), default=0):
                                found.append((label, a, b, got, a))
                    sizes = {label: len(order) for label, order, _ in plans}
                    for label, _, _, got, word in found:
                        k = int(np.searchsorted(first, word, side="right")) - 1
                        number = int(line_of[word]) - int(np.searchsorted(lines, edge[k]))
                        hits.setdefault(k, []).append({"label": label, "block": number, "overlap": got, "size": sizes[label]})
            for k in range(len(texts)):
                at_k, m = base.get(k, []), hits.get(k, [])
                places = sorted(w - int(first[k]) for w, _ in at_k)
                labels = sorted({x for _, x in at_k})
                score = 1.0 if places else max((x["overlap"] / x["size"] for x in m), default=0.0)
                for c, v in zip(out, [int(first[k + 1] - first[k]), len(places), places[0] if places else None, places[-1] if places else None, labels, m, sorted({*labels, *(x["label"] for x in m)}), score], strict=True):
                    c.append(v)

        def run(texts: list[bytes]) -> list:
            out: list[list] = [[] for _ in fields]
            for i, j in chunks(texts):
                chunk(texts[i:j], out)
            return out

        return run

    strings = T.ArrayType(T.StringType())
    match = T.StructType([T.StructField("label", T.StringType()), T.StructField("block", T.LongType()), T.StructField("overlap", T.LongType()), T.StructField("size", T.LongType())])
    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", strings),
        T.StructField("matches", T.ArrayType(match)),
        T.StructField("labels", strings),
        T.StructField("score", T.DoubleType()),
    ]
    return map_texts(docs, text_col, make, fields, keep=[id_col])
