"""HTML extraction against articles cut out by hand, its rules one by one, and a plain second pass."""

from __future__ import annotations

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.llm import html_text, registered
from quillspark.llm.html_text import INSIDE, NEVER_MAIN, OUTSIDE, WEAK, Blocks, Rules, cut, judge, main_texts

PROSE = "the cat and the dog of it is in the house with a hat "
LONG, SHORT = (PROSE * 6).strip(), "A short line."


def one(page: str) -> str:
    return main_texts([page], Rules())[0]


def article(page: str) -> str:
    body = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    pieces = re.split(r"</?(?:p|h1)\b[^>]*>", re.sub(r"</?b>|<!--.*?(-->|\Z)", "", body, flags=re.S).replace("<br>", " "))
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in pieces]
    return "\n".join(t for t in texts if t)


def test_query(spark, sf_dir):
    got = {r["page_id"]: r for r in registered.op13_html_text(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        want = article(r["html"])
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want) and got[r["page_id"]]["url"] == r["url"]


def test_blocks_and_references():
    assert one(f"<article><p>{LONG} &amp; &#233;&eacute;&nbsp;x\n\t y<p>Next<br>line<br><br>new<div>a<b>b</b>c</div>tail</article>") == f"{LONG} & éé x y\nNext line\nnew\nabc\ntail"
    assert one(f"<main>{LONG} 1 < 2 <3 <!-- <p>no</p> --><script>var a = '</p><p>';</script> end</main>") == f"{LONG} 1 < 2 <3 end"
    assert one(f"<article><p title='a > b' data-x=\"<p>\">{LONG}</article>") == LONG
    assert one(f"<ARTICLE><P>{LONG}</P></ARTICLE><SCRIPT>x") == LONG
    assert one(f"<article><p>{LONG}<!-- never closed </p><p>x") == LONG
    assert one(f"<article><p>{LONG}</p><p>cut off <a href='x") == f"{LONG}\ncut off"
    assert one("") == one("<!DOCTYPE html><html></html>") == one("<p>   </p>") == ""


@pytest.mark.parametrize(
    "junk",
    [
        f"<nav><p>{LONG}</p></nav>", f"<aside>{LONG}</aside>", f"<footer>{LONG}</footer>", f"<header><h1>{LONG}</h1></header>", f"<form>{LONG}</form>", f"<noscript>{LONG}</noscript>", f"<style>{LONG}</style>",
        f"<div class='ad-slot x'>{LONG}</div>", f"<div id=cookieBanner><p>{LONG}</div>", f"<section class='post-comments'><div><p>{LONG}</p></div></section>", f"<div role=navigation>{LONG}</div>", f"<div hidden>{LONG}</div>",
        f"<div style='display: none'>{LONG}</div>", f"<div aria-hidden=true>{LONG}</div>", f"<ul><li><a href=x>{LONG}</a></li></ul>", f"<div class=comments><article><p>{LONG}</p></article></div>", f"<button>{LONG}</button>", f"<select><option>{LONG}</select>",
    ],
)
def test_never_main(junk):
    assert one(f"<body>{junk}<div class=text><p>{LONG}</p><p>{SHORT}</p></div></body>") == f"{LONG}\n{SHORT}"
    assert one(f"<body><div class=text><h2>Title</h2><p>{LONG}</p></div>{junk}</body>") == f"Title\n{LONG}"
    if "<header>" not in junk:
        assert one(f"<body><article><p>{SHORT}</p>{junk}<p>{LONG}</p></article></body>") == f"{SHORT}\n{LONG}"


def test_hints_that_are_none():
    for name in ("has-sidebar", "no-banner", "download", "headline", "shadow", "address"):
        assert one(f"<div class={name}><p>{LONG}</p></div>") == LONG
    assert one(f"<div class=sidebar><p>{LONG}</p></div>") == LONG  # nothing else is there
    assert one(f"<div class='page banner'><article><p>{LONG}</p></article></div>") == LONG
    assert one(f"<body class=modal><p>{LONG}</p></body>") == LONG


def test_article_keeps_what_has_no_stop_words():
    odd = "zrk%%% qwv### " * 30
    assert one(f"<article><h1>Qx</h1><p>{odd}</p><p>{SHORT}</p></article>") == f"Qx\n{odd.strip()}\n{SHORT}"
    assert one(f"<div><p>{odd}</p></div>") == odd.strip()  # nothing speaks against it
    assert one(f"<nav><p>{LONG}</p></nav><p>{odd}</p><div><p>{LONG}</p></div>") == LONG  # the navigation is as near as the text
    assert one(f"<div>{LONG}</div><article><p>{SHORT}</p></article>") == SHORT


def test_links_do_not_leak():
    assert one(f"<article><p>See <a href=x>this<p>{LONG}</article>") == f"See this\n{LONG}"  # the link ends with its paragraph
    assert one(f"<div><p>{LONG} <a href=x>link</a></p></div>") == f"{LONG} link"


def plain_second_pass(b: Blocks, rules: Rules) -> list[bool]:
    out = []
    words = lambda t: re.findall(r"\w+", t.lower())
    for page in dict.fromkeys(b.page):
        rows = [i for i, p in enumerate(b.page) if p == page]
        marked = any(b.place[i] == INSIDE for i in rows)
        plain = any(b.place[i] == OUTSIDE for i in rows)
        label, speaks, prose = {}, {}, {}
        for i in rows:
            t, inside = b.text[i], b.place[i] == INSIDE
            region = inside if marked else b.place[i] == OUTSIDE or b.place[i] == WEAK and not plain
            w = words(t)
            density = sum(x in rules.stop_words for x in w) / max(len(w), 1) if region else 0
            dense = b.linked[i] / len(t) > (rules.article_links if inside else rules.links)
            if not region or dense or "©" in t and not inside and len(t) < rules.long:
                label[i] = False
            elif not inside and b.linked[i] and (len(t) < rules.short or density < rules.low):
                label[i] = False
            elif len(t) >= rules.short and density >= rules.high and len(t) > rules.long:
                label[i] = True
            else:
                label[i] = None
            prose[i] = inside or len(t) >= rules.short and density >= rules.low
            speaks[i] = label[i] is not None and (region and not dense or not marked)
        good = any(label[i] for i in rows)

        def inherited(i, among):
            before = max((j for j in among if j < i and speaks[j]), default=None)
            after = min((j for j in among if j > i and speaks[j]), default=None)
            near = [(abs(i - j), j) for j in (before, after) if j is not None]
            if not near:
                return None
            if len(near) == 1 or near[0][0] != near[1][0]:
                return bool(label[min(near)[1]])
            return bool(prose[i] or not good or label[before] and label[after])

        for i in rows:
            if label[i] is not None:
                out.append(label[i])
                continue
            after = min((j for j in rows if j > i and speaks[j]), default=None)
            own = inherited(i, [j for j in rows if b.around[j] == b.around[i]])
            page_wide = inherited(i, rows) if good else None
            if b.heading[i] and after is not None and good:
                out.append(bool(label[after]))
            elif own is not None:
                out.append(own)
            else:
                out.append(page_wide if page_wide is not None else bool(prose[i] or not good))
    return out


def test_second_pass_by_brute_force():
    r = random.Random(4)
    pages = []
    for _ in range(400):
        parts = []
        for _ in range(r.randrange(12)):
            text = r.choice([SHORT, LONG, "zrk qwv " * r.choice([2, 12, 60]), f"<a href=x>{SHORT}</a>", PROSE * 2, "© me", f"{LONG} <a>{SHORT}</a>", SHORT + f" <a>{SHORT}</a>"])
            tag = r.choice(["p", "p", "p", "h2", "div", "li", "nav", "div class=ad"])
            parts.append(f"<{tag}>{text}</{tag.split()[0]}>")
        whole = "".join(parts)
        pages.append(r.choice(["{}", "<div>{}</div>", "<article>{}</article>", "<p>" + SHORT + "</p><main>{}</main>", "<div class=ad>{}</div>"]).format(whole))
    b = Blocks()
    for i, p in enumerate(pages):
        cut(p, i, b)
    got, want = judge(b, Rules()).tolist(), plain_second_pass(b, Rules())
    assert got == want and 0 < sum(got) < len(got) and NEVER_MAIN in b.place
    assert main_texts(pages, Rules()) == [main_texts([p], Rules())[0] for p in pages]  # pages don't meet


def test_odd_rows(spark):
    rows = [(1, f"<article>{LONG}</article>", "u"), (1, f"<article>{LONG}</article>", "u"), (None, None, None), (3, "", "x"), (4, "<p>" * 1000 + "x", None), (5, "<article><p>" + PROSE * 50_000 + "</article>", "u")]
    df = spark.createDataFrame(rows, "page_id long, html string, url string").withColumn("n_chars", F.lit("old")).withColumn("place", F.lit(1))
    got = html_text.extract_text(df)
    assert sorted(got.columns) == ["n_chars", "page_id", "place", "text", "url"]
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got.collect()) == [(0, 0), (1, len(LONG)), (1, len(LONG)), (3, 0), (4, 1), (5, len(PROSE) * 50_000 - 1)]
    assert html_text.extract_text(df.where("false")).count() == 0
