"""The pipeline's stages: what they keep, on the small tables."""

from __future__ import annotations

import brute

import corpus_pipeline
from quillspark.llm import decontaminate, registered, token_count


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    lib = token_count.load(registered.tokenizer_path())
    kept = dict(want)
    for name, stage in corpus_pipeline.STAGES:
        from quillspark.llm.store import written

        out = written(stage(spark, docs, sf_dir))
        rows = out.collect()
        ids = [r.doc_id for r in rows]
        assert len(set(ids)) == len(ids) and set(ids) <= set(kept)
        gone = set(kept) - set(ids)
        if name == "quality":
            assert all(labels[d].quality == 0 for d in gone if d in labels)
        elif name == "ngram_join":
            groups = brute.groups([(d, r.text) for d, r in kept.items()], 5, 80, 100)
            assert set(ids) == {d for d, (_, c) in groups.items() if c == d}
        elif name == "decontaminate":
            assert gone == {d for d, r in kept.items() if brute.contamination(r.text, items)[3]}
        elif name == "bpe_encode":
            assert not gone
            for r in rows:
                assert list(r.token_ids) == lib.encode(want[r.doc_id].text, add_special_tokens=False).ids and r.n_tokens == len(r.token_ids)
        if name != "bpe_encode":
            assert out.columns == docs.columns and all(r == want[r.doc_id] for r in rows)
        kept = {d: kept[d] for d in ids}
        docs = out
    assert sorted(kept) == sorted(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect())


def test_contamination_rule():
    assert decontaminate.WINDOW == 13


def test_odd_rows_in_every_stage(spark, sf_dir, tmp_path):
    import shutil

    for t in ("labels", "benchmark"):
        shutil.copy(f"{sf_dir}/{t}.parquet", tmp_path / f"{t}.parquet")
    some = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30).collect()
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    good = max((r.text for r in some), key=len)
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "mine", 7, None) for r in some]
    rows += [(10**6, None, None, None, None, None, None, None), (None, good, None, "x", 1, "mine", 7, "c"), (10**6 + 1, "", "en", "x", 0, "mine", 7, "c")]
    rows += [(10**6 + 2, good + " and so on", "en", "x", 5, "mine", 7, "c")] * 2 + [(10**6 + 3, item, "en", "x", 5, "mine", 7, "c"), (10**6 + 4, (good + " ") * 60, "en", "x", 5, "mine", 7, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, predicted int, contaminated string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if name == "bpe_encode":
            assert len(got) == len(rows) and {r.n_tokens for r in got if r.doc_id in (10**6, 10**6 + 1)} == {0}
            continue
        assert out.columns == docs.columns
        count = lambda x: sum(tuple(r) == tuple(x) for r in got)
        assert all(count(r) <= rows.count(tuple(r)) for r in got)  # rows come out as they went in
        twice = count((10**6 + 2, good + " and so on", "en", "x", 5, "mine", 7, "c"))
        assert twice in (0, 2)
        if name == "ngram_join":
            assert None in {r.doc_id for r in got} and {10**6, 10**6 + 1} <= {r.doc_id for r in got} and twice == 0
        if name == "decontaminate":
            assert 10**6 + 3 not in {r.doc_id for r in got} and {None, 10**6, 10**6 + 1} <= {r.doc_id for r in got}
