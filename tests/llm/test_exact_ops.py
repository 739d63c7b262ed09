"""Operators with exact results, held against brute force and the tokenizer library on the small tables and on
hand-made rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import ann_hilbert, bpe_dp, chat_format, components, decontaminate, license_scan, ngram_join, registered, token_count


def docs_of(spark, texts, **more):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, component_id int")


def odd_texts(n=300, seed=3):
    r = random.Random(seed)
    al = " \n\t'abcdstmlrev.,!09<|>éßЖ中 ​🙂½\r\\[/]"
    fixed = [None, "", " ", "'s", "don't  we'll 's ''s 've", "a<|endoftext|>b<|endoftext|>", "  x", "x  ", "\n\n x\t", "word " * 5000, "x" * 20000, "\0 a\0b", "MIT License, GNU General Public License CC-BY cc by"]
    return fixed + ["".join(r.choice(al) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_tokens_and_bpe(spark, sf_dir):
    path = registered.tokenizer_path()
    lib = token_count.load(path)
    texts = odd_texts() + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    ids = [e.ids for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    df = docs_of(spark, texts)
    got = {r.doc_id: r for r in token_count.count_tokens(df, path, size=50).collect()}
    enc = {r.doc_id: r for r in bpe_dp.decode_ids(bpe_dp.encode_texts(df, path), path).collect()}
    for i, (t, want) in enumerate(zip(texts, ids, strict=True)):
        t = t or ""
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (len(want), len(t.encode()), len(want) > 1024), repr(t)
        assert list(enc[i].token_ids) == want and enc[i].n_tokens == len(want), repr(t)
        assert enc[i].decoded == lib.decode(want, skip_special_tokens=False) == t
        assert enc[i].ids_sha256 == brute.sha(",".join(map(str, want))) and enc[i].decoded_sha256 == brute.sha(t)
    assert got[0].n_words == "x"  # columns stay
    assert token_count.count_tokens(df.limit(0), path).count() == 0 == bpe_dp.encode_texts(df.limit(0), path).count()


def test_decontaminate(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["é", "z9"]
    items = {i: " ".join(r.choice(words) for _ in range(r.choice([1, 3, 12, 13, 14, 40]))) for i in range(60)} | {60: "", 61: None, 62: " ,. ", 10**6: "Z9-é"}
    texts = odd_texts(50)
    for _ in range(150):
        w = [r.choice(words) for _ in range(r.randint(0, 200))]
        if r.random() < 0.7:
            a = (items[r.randint(0, 59)]).split()
            w[5:5] = [x.upper() for x in a] if r.random() < 0.3 else a
        texts.append(r.choice([" ", ", ", "\n"]).join(w))
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {x.doc_id: x for x in decontaminate.decontaminate(docs_of(spark, texts), bench).collect()}
    for i, t in enumerate(texts):
        want = brute.contamination(t, items)
        assert (got[i].n_words, got[i].n_hit, list(got[i].item_ids), got[i].contaminated) == want, repr(t)[:200]
        assert sum(b - a for a, b in got[i].hit_spans) == want[1]
    none = decontaminate.decontaminate(docs_of(spark, texts), bench.limit(0)).where("contaminated OR n_hit > 0").count()
    assert none == 0 and decontaminate.decontaminate(docs_of(spark, texts).limit(0), bench).count() == 0


@pytest.mark.parametrize("size", [40, 300])
def test_decontaminate_in_parts(spark, size):
    r = random.Random(7)
    words = [f"w{i}" for i in range(12)]
    items = [(i % 20, " ".join(r.choice(words) for _ in range(r.choice([1, 2, 5, 13, 20])))) for i in range(30)]  # repeated ids and windows
    items += [(3, "w1 w2"), (4, "w1 w2"), (3, "w1 w2"), (None, "w5 w5 w5"), (5, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(80)] + [None, "w1 W2 " * 3000]
    docs = docs_of(spark, texts).withColumn("hit_spans", F.lit("x"))
    docs = docs.unionByName(docs.limit(3))
    want = {i: brute.contamination(t, [("" if k is None else k, t) for k, t in items]) for i, t in enumerate(texts)}
    got = decontaminate.decontaminate(docs, bench, part_bytes=size).collect()
    whole = decontaminate.decontaminate(docs, bench).collect()
    assert len(got) == len(whole) == len(texts) + 3
    for x in (*got, *whole):
        assert (x.n_words, x.n_hit, list(x.item_ids), x.contaminated) == want[x.doc_id]
    assert sorted((x.doc_id, repr(x.hit_spans)) for x in got) == sorted((x.doc_id, repr(x.hit_spans)) for x in whole)


def near_texts(seed=1):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    passage = [r.choice(vocab) for _ in range(60)]
    texts = [None, "", "  \n", "one", "ONE", "one two", "One  two", "one two three"]
    for _ in range(40):
        base = [r.choice(vocab) for _ in range(r.randint(5, 120))]
        if r.random() < 0.4:
            base[3:3] = passage
        for _ in range(r.choice([1, 1, 2, 3, 25])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 6])):
                w[r.randrange(len(w))] = r.choice(vocab)
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("k,num,den,common", [(3, 90, 100, 1 << 18), (5, 80, 100, 20), (2, 50, 100, 0)])
def test_ngram_join(spark, monkeypatch, k, num, den, common):
    monkeypatch.setattr(ngram_join, "COMMON", common)
    texts = near_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs_of(spark, texts), k=k, num=num, den=den).collect()}
    assert got == brute.groups(list(enumerate(texts)), k, num, den)


def test_ngram_join_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None), (1, "q r s t u v"), (4, "q r s t u v")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(df).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None), (3, 0, 3), (1, 2, 1), (4, 2, 1)], key=str)
    assert ngram_join.ngram_join(df.limit(0)).count() == 0
    kept = ngram_join.keep_one(df)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 1, 1, 3] and kept.columns == ["doc_id", "text"]


def test_ngram_join_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in registered.op8_ngram_join(spark, sf_dir).collect()}
    assert got == brute.groups([(r.doc_id, r.text) for r in docs.collect()], 3, 90, 100)


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, x) for x in range(101, 140)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(30)] + [(5, 5), (None, 3)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {a: find(a) for a in list(root)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_license_scan(spark):
    notice = license_scan.TEMPLATES["mit"]
    cut = " ".join(notice.split()[:-2])
    texts = odd_texts(60) + ["Apache License apache-license\nGNU GENERAL public license", "xmit license mit licensee", "intro\n" + notice.upper() + "\nend", "a\nb\n" + cut, notice[:60], "gnu general public", "mit", "license"]
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        g = got[i]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, ",".join(g.base_labels)) == brute.phrases(t, license_scan.PHRASES), repr(t)
        assert set(g.base_labels) <= set(g.labels) and 0 <= g.score <= 1
        best = {}
        for number, line in enumerate((t or "").split("\n")):
            for label, template in license_scan.TEMPLATES.items():
                a, b = set(brute.ALNUM.findall(template)), set(brute.ALNUM.findall(brute.low(line)))
                if 10 * len(a & b) >= 8 * len(a):
                    best[label, number] = (len(a & b), len(a))
        assert {(m.label, m.block): (m.overlap, m.size) for m in g.matches} == best
    n = len(texts)
    assert [list(got[i].labels) for i in (n - 6, n - 5)] == [["mit"], ["mit"]]
    assert license_scan.scan_licenses(docs_of(spark, texts).limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "hi \\ <|turn|> [INST]"), (1, 1, "assistant", None), (1, 2, "assistant", "<|end|></s>\\<|\n"), (2, None, None, "x"), (2, None, "a", "y"), (3, 5, "assistant", "é🙂"), (3, 5, "assistant", "é🙂"), (None, 1, "user", "z")]
    rows += [(9, i, "assistant" if i % 2 else "user", f"t{i}<|text|>") for i in range(300)]
    part = F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", F.array(part)).withColumn("formatted", F.lit(1))
    out = chat_format.read_back(chat_format.format_conversations(df)).collect()
    want = brute.chat(rows)
    for r in out:
        text = "".join(f"{t.role}\n{t.text}\n" for t in r.turns)
        loss = "".join(t.under_loss or "" for t in r.turns)
        assert (r.n_turns, brute.sha(text), len(loss), brute.sha(loss)) == want[r.conv_id]
    assert len(out) == len(want)
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_chat_parts(spark):
    df = spark.sql("""SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, array(
        named_struct('type','text','text','see <|image|>','ref',null,'units',null), named_struct('type','image','text',null,'ref','a.png','units',2),
        named_struct('type','audio','text',null,'ref','b.wav','units',null), named_struct('type','other','text',null,'ref','c','units',1), null) AS parts
        UNION ALL SELECT 1L, 1L, 'assistant', null""")
    r = chat_format.format_conversations(df).first()
    assert r.formatted == "<|turn|>user<|text|>see <\\|image|><|image|><|audio|><|document|><|end|>\n<|turn|>assistant<|text|><|end|>\n"
    assert [(a.turn, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "a.png", 512), (0, "audio", "b.wav", 25), (0, "document", "c", 512)]
    assert r.expanded_tokens == 1049 and [s.loss for s in r.spans] == [False, True]


def test_chat_forged_parts(spark):
    """Control strings cut at random over parts read back as the given turns, and none stands in a body."""
    r = random.Random(11)
    pool = [*chat_format.CONTROLS, "\\", "\\\\", "<", "[", "<\\", "a", "é\n", ""]
    turns = []
    for c in range(60):
        for t in range(r.randint(1, 3)):
            text = "".join(r.choice(pool) for _ in range(r.randint(0, 8)))
            cuts = sorted(r.randint(0, len(text)) for _ in range(r.randint(0, 6)))
            parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
            turns.append((c, t, r.choice(["user", "assistant", "<|turn|>x"]), [("text", p, None, None) for p in parts], text))
    df = spark.createDataFrame([x[:4] for x in turns], f"conv_id long, turn long, role string, parts {chat_format.PARTS}")
    got = {x.conv_id: x for x in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    for c in range(60):
        want = [(x[2], x[4]) for x in turns if x[0] == c]
        assert [(t.role, t.text) for t in got[c].turns] == want and got[c].n_turns == len(want)
        assert [t.under_loss for t in got[c].turns] == [x if role == "assistant" else None for role, x in want]
        for s in got[c].formatted.split(chat_format.TURN)[1:]:
            role, body = s.split(chat_format.TEXT)
            assert not any(x in y for x in chat_format.CONTROLS for y in (role, body.removesuffix(chat_format.END + "\n")))


def test_license_wrapped(spark):
    def wrapped(label, lead="", blank=None):
        ws = license_scan.TEMPLATES[label].split()
        lines = [lead + " ".join(ws[i : i + 7]) for i in range(0, len(ws), 7)]
        return "\n".join(lines if blank is None else [*lines[:blank], "", *lines[blank:]])

    labels = sorted(license_scan.TEMPLATES)
    texts = [f"first line\n\nmore {chr(120 + n)}\n{wrapped(label, lead, blank)}\n\nlast" for label in labels for n, (lead, blank) in enumerate([("", None), (" * ", None), ("# ", 1)])]
    far = "\n".join(w + " filler" * 60 for w in license_scan.TEMPLATES["mpl"].split())
    texts += ["\n\n".join(far.split("\n")), far, wrapped("mit") + "\n\n" + "plain words " * 40 + "\n\n" + wrapped("mit")]
    # half of a notice at the end of a text, the other half in the next text
    ws = license_scan.TEMPLATES["bsd"].split()
    texts += [" ".join(ws[:11]), " ".join(ws[11:])]
    got = [r for r in license_scan.scan_licenses(docs_of(spark, texts).coalesce(1)).orderBy("doc_id").collect()]
    for i, label in enumerate(labels):
        for r in got[3 * i : 3 * i + 3]:
            assert label in r.labels and r.score == 1.0
            assert [(m.block, m.overlap == m.size) for m in r.matches if m.label == label] == [(3, True)]
    scattered, paragraph, twice, *halves = got[3 * len(labels) :]
    assert not scattered.labels and list(paragraph.labels) == ["mpl"]
    assert len(twice.matches) == 2 and {m.label for m in twice.matches} == {"mit"}
    assert not any(r.labels for r in halves)


def test_nearest_small(spark):
    inf = float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (40, [0.0, 0.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [-1.0, 0.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann_hilbert.nearest(df, "vec_id", "embedding", "id % 20 = 0", 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 20, 1.0), (0, 3, 2, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 1.0), (20, 3, 2, 0.5)]
    assert ann_hilbert.nearest(df.limit(0), "vec_id", "embedding", "id % 20 = 0", 3).count() == 0


def test_nearest_recall(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect() if r.embedding]
    want = brute.nearest([r[0] for r in rows], [r[1] for r in rows])
    got = {}
    for r in registered.op2_ann_hilbert(spark, sf_dir).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, hs in got.items():
        assert [h[0] for h in sorted(hs)] == list(range(1, len(hs) + 1))
        scores = [h[2] for h in sorted(hs)]
        assert scores == sorted(scores, reverse=True)


def recall_of(spark, rows, ids, is_query):
    """Share of the 20 true neighbours that the operator finds."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, rows, strict=True)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann_hilbert.nearest(df, "vec_id", "embedding", is_query, 20).select("query_id", "vec_id").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    scores = rows @ rows.T
    np.fill_diagonal(scores, -np.inf)
    return np.mean([len(got.get(ids[q], set()) & {ids[x] for x in np.argsort(-scores[q])[:20]}) / 20 for q in range(len(ids)) if ids[q] % 20 == 0])


@pytest.mark.parametrize("kind", ["given", "lengths", "cluster"])
def test_nearest_recall_full_ranges(spark, kind):
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("embedding IS NOT NULL").limit(2400).toPandas()
    r, rows = np.random.default_rng(5), np.stack(t["embedding"].to_numpy()).astype(float)
    if len(rows) < 2100:  # enough for 24 ranges
        rows = np.vstack([rows, r.permuted(rows, axis=1)])[:2400]
    if kind == "lengths":
        rows *= np.exp(r.standard_normal(len(rows)))[:, None]
    if kind == "cluster":  # a third lies so close together that it has one key on most curves
        rows[::3] = rows[0] + 1e-4 * r.standard_normal((len(rows[::3]), rows.shape[1]))
    assert len(rows) // 84 >= ann_hilbert.RANGES
    got = recall_of(spark, rows, list(range(len(rows))), "id % 20 = 0")
    assert got >= 0.9


def test_nearest_beside_hot_key(spark):
    r = np.random.default_rng(2)
    # 900 vectors of one key, 1,488 far off, and 12 around the cluster, whose neighbours are in it
    angle = np.concatenate([1e-6 * r.standard_normal(900), r.uniform(1.8, 4.4, 1488), r.uniform(-0.6, 0.6, 12)])
    rows = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    keys = ann_hilbert.curve_keys(rows, 0)
    assert (keys[:900] == keys[0]).all()
    above = [q for q in range(2388, 2400) if keys[q] > keys[0] and ((keys > keys[0]) & (keys <= keys[q])).sum() < 2400 // ann_hilbert.RANGES]
    assert above
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {x.query_id for x in ann_hilbert.nearest(df, "vec_id", "embedding", "id >= 2388", 20, curves=1).where("vec_id < 900").collect()}
    assert got >= set(above)


def test_tables_of_a_part_are_built_once():
    from quillspark.llm import decontaminate

    class Part:
        value = [("1", b"one two three four five six seven eight nine ten eleven twelve thirteen fourteen")]

    first = decontaminate._tables(Part, 13)
    assert decontaminate._tables(Part, 13) is first and sum(len(t.patterns) for t in first) == 2
