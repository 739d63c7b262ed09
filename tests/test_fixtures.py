"""Literal cases of the operators' rules, which the tables don't hold."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.operators import evaluate as E
from quillspark.operators import extract as X
from quillspark.operators import graph as G
from quillspark.operators import ops as O
from quillspark.operators import prepare as D
from quillspark.operators import queries as Q
from quillspark.operators import search as R
from quillspark.operators import verify as V
from quillspark.sources import corpus as S


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "parts,want", [((0.9, 0.8, 1.0, 0.7), 0.85), ((1.0, 1.0, 1.0, None), 1.0), ((0.0, 0.0, 0.0, 0.0), 0.0)]
)
def test_composite(spark, parts, want):
    df = spark.createDataFrame([parts], "f double, r double, p double, c double")
    assert abs(df.select(E.composite(F.col("f"), F.col("r"), F.col("p"), F.col("c")).alias("x")).first().x - want) < 1e-9


@pytest.mark.parametrize(
    "text,want",
    [("What is the yield strength of F53?", "lookup"), ("Compare F51 vs F53", "comparison"), ("What UNS designations are covered?", "list"), ("List all requirements", "list"), ("Which grades are covered?", "list"), ("What is the hardness for S32205?", "lookup")],
)
def test_intent(spark, text, want):
    assert Q.classify_intent(spark.createDataFrame([(text,)], "t string"), "t").first().intent == want


def test_expansions(spark):
    q = spark.createDataFrame([(1, "F51 yield strength"), (2, "ys and cr of 2205"), (3, "s31803 f51")], "k long, t string")
    got = {r.k: r.expanded for r in Q.expand_grades(q, "k", "t").collect()}
    assert got == {1: "F51 yield strength S31803", 2: "ys and cr of 2205 S32205 yield strength chromium", 3: "s31803 f51"}
    assert one(spark, "Nitrogen content", Q.expand_elements) == "nitrogen N content"
    assert one(spark, "minimum yield", Q.expand_synonyms) == "minimum yield yield strength Ys 0.2% proof offset yield"


@pytest.mark.parametrize("name,want", [("ASTM-A790-A790M-24.pdf", ["A790"]), ("The ASTM A789 spec 2013.pdf", ["A789"]), ("API Spec 5CT guide.pdf", ["5CT"]), ("S32205 sheet", ["S32205"])])
def test_filename_codes(spark, name, want):
    assert one(spark, name, X.filename_codes) == want


@pytest.mark.parametrize("name,want", [("877794297-A312-A312M-25.pdf", "A312"), ("API Spec 5CT Casing 9th Edition", "5CT"), ("API 5CRA", "5CRA"), ("nothing", None)])
def test_spec_code(spark, name, want):
    assert one(spark, name, X.spec_code) == want


@pytest.mark.parametrize("text,want", [("section 5.5 of it", (0.7, 0.3)), ("S32205 per ASTM A790", (0.7, 0.3)), ("S32205 please", (0.6, 0.4)), ("yield please", (0.55, 0.45)), ("hello", (0.3, 0.7))])
def test_weights(spark, text, want):
    r = Q.search_weights(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert (r.w_lexical, r.w_vector) == want


def test_section_refs(spark):
    assert one(spark, "what does 5.5.3 say about clause 3.2 in 2014.1", X.section_refs) == ["3.2", "5.5.3"]
    assert one(spark, "ratio 1.4", X.section_refs) == []


def test_resolve_documents(spark):
    index = spark.createDataFrame([("A790", [1, 2]), ("5CT", [7])], "code string, docs array<long>")
    q = spark.createDataFrame([(1, "S32205 per A790"), (2, "A790 pipe"), (3, "S32205 yield"), (4, "API 5CT casing"), (5, "A106 pipe")], "k long, t string")
    assert {r.k: r.documents for r in X.resolve_documents(q, "t", "k", index).collect()} == {1: [1, 2], 2: [1, 2], 3: None, 4: [7], 5: None}


def test_grounding(spark):
    a = spark.createDataFrame([(1, "none here"), (2, "450 MPa and 25 %"), (3, "450 MPa and 3 %"), (4, "9 ksi")], "answer_id long, text string")
    s = spark.createDataFrame([(1, "x"), (2, "450 psi 25.0 %"), (3, "450 MPa"), (4, "nothing")], "answer_id long, text string")
    assert {r.answer_id: (r.score, r.passed) for r in V.ground_answers(a, s).collect()} == {1: (70, True), 2: (100, True), 3: (50, True), 4: (0, False)}


def test_coverage(spark):
    subs = spark.createDataFrame([(1, i) for i in range(3)], "query_id long, sub_no int")
    hits = spark.createDataFrame([(1, 0)] * 30 + [(1, 1)] * 2, "query_id long, sub_no int")
    got = {r.sub_no: (r.hits, r.missing, r.thin) for r in R.coverage(subs, hits).collect()}
    assert got == {0: (30, False, False), 1: (2, False, True), 2: (0, True, False)}


def test_windows(spark):
    df = spark.createDataFrame([(1, "x" * 3000)], "k long, t string")
    assert [r.start for r in D.window_chunks(df, "t", ["k"], 1500, 200).orderBy("start").collect()] == [0, 1300, 2600]
    with pytest.raises(ValueError):
        D.window_chunks(df, "t", ["k"], 100, 100)


@pytest.mark.parametrize("convention,want", [("floor", 20), ("ceil", 19), ("offset", 20)])
def test_percentiles(spark, convention, want):
    df = spark.range(1, 21).select(F.lit(1).alias("g"), "id")
    assert E.percentile_rank(df, ["g"], "id", 0.95, convention).first().percentile == want


def test_pass_rule(spark):
    a = spark.createDataFrame([(i, "Alpha text [1] A790", False) for i in range(3)], "case_id long, text string, false_refusal boolean")
    c = spark.createDataFrame([(0, ["alpha", "beta"], [], []), (1, ["alpha"], ["TEXT"], []), (2, ["alpha"], [], ["A789"])], "case_id long, expected array<string>, forbidden array<string>, citations array<string>")
    assert {r.case_id: r.passed for r in E.score_patterns(a, c).collect()} == {0: True, 1: False, 2: False}


def test_citations(spark):
    schema = "ref string, document string, page double, char_offset_start int, char_offset_end int, document_url string, content_preview string"
    good = ("[1]", "a.pdf", 3.0, 1, 9, "https://x", "long enough preview")
    rows = [good, ("1", *good[1:]), (*good[:2], 0.0, *good[3:]), (*good[:2], -1.0, *good[3:]), (*good[:3], None, None, *good[5:]), (*good[:3], 9, 1, *good[5:]), ("[1]", " ", *good[2:])]
    got = V.validate_citations(spark.createDataFrame(rows, schema)).collect()
    assert [(r.valid, "no offsets" in r.warnings) for r in got] == [(True, False), (False, False), (False, False), (False, False), (True, True), (False, False), (False, False)]
    c = spark.createDataFrame([("see [1] [2] [2]", ["[1]", "[3]"])], "t string, refs array<string>").select(V.citation_consistency(F.col("t"), F.col("refs")).alias("c")).first().c
    assert (c.missing, c.unused, c.consistent) == (["[2]"], ["[3]"], False)


def test_remap_is_simultaneous(spark):
    a = spark.createDataFrame([(1, "a [1] b [2] c [3] d [4]")], "answer_id long, text string")
    s = spark.createDataFrame([(1, 1, "x", 1), (1, 2, "x", 1), (1, 3, "y", 1)], "answer_id long, no int, document string, page int")
    assert V.remap_citations(a, s).first().text == "a [1] b [1] c [2] d "


def test_units_and_quotes(spark):
    assert one(spark, "65 ksi, 100 °F, 65 ksi [448 MPa]", V.standardize_units) == "65 ksi [448 MPa], 100 °F [38 °C], 65 ksi [448 MPa]"
    df = spark.createDataFrame([("The Yield", "the yield is"), ("abc", "abd"), ("", "x")], "q string, s string")
    assert [r.x for r in df.select(V.quote_match(F.col("q"), F.col("s")).alias("x")).collect()] == [100, 67, 100]


def test_structured(spark):
    text = 'Sure {"answer": "x", "claims": [{"claim": "c", "numerical_values": [{"value": "12 MPa"}]}]} ok'
    df = spark.createDataFrame([(1, text), (2, "one [1]\n\ntwo\n\nthree [2]")], "k long, t string")
    a, b = V.parse_structured(df, "t").orderBy("k").collect()
    assert a.structured and a.answer == "x" and a.claims[0].source_ref == "[?]" and a.claims[0].confidence == "medium" and a.claims[0].numerical_values[0].value == 12.0
    assert not b.structured and [c.source_ref for c in b.claims] == ["[1]", "[2]"]


def test_blocks(spark):
    table = "TABLE 1 Chemical\nS32205 | 1 | 2\n----|---|---"
    pages = spark.createDataFrame([(1, 1, f"1.2 Scope Of Work\n\n{table}\n\nNote 1: Maximum, unless given\n\n- a\n- b\n\nplain text"), (1, 2, "more plain text here")], "doc long, page int, t string")
    blocks = D.classify_blocks(D.paragraphs(pages, "t", ["doc", "page"]), "doc", "page")
    got = [(r.page, r.kind) for r in blocks.orderBy("page", "block_no").collect()]
    assert got == [(1, "heading"), (1, "table"), (1, "footnote"), (1, "list"), (1, "text"), (2, "text")]
    joined = D.attach_footnotes(blocks, "doc", "page").where("kind = 'table'").first()
    assert joined.has_footnotes and joined.block.endswith("Maximum, unless given")
    assert [r.section for r in D.carry_section(blocks, "doc", "page").orderBy("page").collect()] == ["Scope Of Work", "Scope Of Work"]
    assert one(spark, "TABLE 2\nGrade | x\nS32205 | 1\nS32207 | 2", D.table_header) == "TABLE 2\nGrade | x"


def test_long_table_is_split_under_its_header(spark):
    rows = "\n".join(f"S{32000 + i} | {i} | {i + 1}" for i in range(400))
    pages = spark.createDataFrame([(1, 1, f"TABLE 2 Chemical\nGrade | a | b\n{rows}")], "doc long, page int, t string")
    got = D.semantic_chunks(pages, "doc", "page", "t").orderBy("chunk_no").collect()
    assert len(got) > 3 and all(r.kind == "table" and r.confidence == 0.85 and r.content.startswith("TABLE 2 Chemical\nGrade | a | b") for r in got)
    assert all(len(r.content) <= 1500 for r in got)


def test_balance_and_strategy(spark):
    c = spark.createDataFrame([(1, i, 1.0 - i / 10, 1 if i < 4 else 2) for i in range(6)], "query_id long, chunk_id long, combined_score double, document_id long")
    need = spark.createDataFrame([(1, 1), (1, 2)], "query_id long, document_id long")
    assert {r.chunk_id for r in R.balance_documents(c, need, 3).collect()} == {0, 4, 1}
    a = spark.createDataFrame([(1, 0, 50, "a"), (1, 1, 50, "b"), (1, 2, 70, "c"), (2, 0, 60, "a"), (2, 1, 90, "b")], "query_id long, attempt_no int, confidence int, strategy string")
    assert {r.query_id: (r.strategy, r.tried) for r in R.best_strategy(a).collect()} == {1: ("c", 3), 2: ("a", 1)}


def test_graph_and_gate(spark, tmp_path):
    m = spark.createDataFrame([("S1", 1, ["2205"]), ("S2", 2, ["2205", "X"])], "id string, ord int, names array<string>")
    assert {r.key: r.id for r in G.material_lookup(spark.createDataFrame([("2205",), ("s2",), ("no",)], "key string"), m).collect()} == {"2205": "S1", "s2": "S2"}
    f = spark.createDataFrame([("a b.pdf", bytearray(b"%PDF-1.7"), 10, "application/pdf"), ("c.pdf", bytearray(b"GIF"), 10, "application/pdf"), ("", bytearray(b"%PDF-"), 1, "application/pdf")], "name string, content binary, length long, content_type string").withColumn("at", F.timestamp_millis(F.lit(5)))
    assert [(r.reason, r.storage_name) for r in S.ingest_gate(f).collect()] == [(None, "5-a_b.pdf"), ("not a pdf", None), ("no name", None)]
    p = tmp_path / "cases.json"
    p.write_text('{"qa_pairs": [{"id": 1, "question": "q", "expected_values": ["5"], "difficulty": "easy"}]}')
    r = S.read_cases(spark, str(p), "pairs").first()
    assert (r.id, r.query, r.expected, r.difficulty) == ("1", "q", ["5"], "easy")
    facts = S.spec_facts(spark.createDataFrame([("A", '{"g": {"yield": "65", "cr": "21.0-23.0"}}')], "standard string, grades string"))
    assert {(r.property, r.low, r.high) for r in facts.collect()} == {("yield", 65.0, 65.0), ("cr", 21.0, 23.0)}


def test_errors(spark):
    df = spark.createDataFrame([("Rate limit hit",), ("file does not exist",), ("weird",), (None,)], "m string")
    assert [r.x for r in df.select(O.categorize_errors(F.col("m")).alias("x")).collect()] == ["RATE_LIMITED", "NOT_FOUND", "INTERNAL_ERROR", "INTERNAL_ERROR"]


def test_suppress_overlap(spark):
    h = spark.createDataFrame([(1, 1, 1, 1, "a b c d e"), (1, 1, 2, 2, "a b c d e"), (1, 1, 3, 3, "v w x y z"), (1, 2, 4, 4, "a b c d e")], "query_id long, document_id long, chunk_id long, rank int, content string")
    assert sorted(r.chunk_id for r in R.suppress_overlap(h, "content").collect()) == [1, 3, 4]
