"""Main text of pages: structure, repeats, edges."""

import re
import time
from collections import defaultdict
from html import unescape

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import html


def test_articles_of_the_pages(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    source = {row.page_id: row.html for row in pages.collect()}
    found = html.extract(pages).collect()
    assert len(found) == len(source)
    for row in found:
        article = re.search(r"<article>(.*)</article>", source[row.page_id], re.S)[1]
        parts = [" ".join(unescape(re.sub("</?b>", "", part.replace("<br>", " "))).split()) for part in re.split("</?(?:p|h1)>", article)]
        assert row.text == "\n\n".join(part for part in parts if part) and row.n_chars == len(row.text)


@pytest.mark.parametrize(
    "page, expected",
    [
        ("<article><h1>A &amp; B</h1><p>one<b>two</b> three<br>four</article>", ["A & B", "onetwo three four"]),
        ("<nav>menu</nav><header>top</header><article><p>x</p></article><footer>f</footer>", ["x"]),
        ("<article><p>x</p><aside>y</aside><div class='comments'><article class=comment>z</article></div></article>", ["x"]),
        ("<div class='ad'>a<article><p>x</p></article>", ["x"]),
        ("<main><p>x</p></main><form>f<input></form>", ["x"]),
        ("<script>var a='<article>no</article>'</script><article>y<style>p{}</style></article>", ["y"]),
        ("<article>a &lt; b &#233; &nbsp; c &am</article>", ["a < b é c &am"]),
        ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", ["1 2", "3"]),
        ("<article><ul><li>a<li>b</ul><pre> k\n  l </pre>", ["a", "b", "k l"]),
        ("<p>a<!-- no --> b <![CDATA[c < d]]> <p title='a > b'>e", ["a b c < d", "e"]),
        ("<article>1 < 2 <unclosed", ["1 < 2 <unclosed"]),
        ("<article><div role=navigation>m</div><p hidden>h</p><p>x</p><noscript>n</noscript></article>", ["x"]),
        ("", []),
        ("<script>never closed", []),
        ("<div><article>", []),
    ],
)
def test_structure(page, expected):
    zone = html.ARTICLE if any(z == html.ARTICLE for z, _ in html.blocks(page)) else html.OPEN
    assert [text for z, text in html.blocks(page) if z == zone] == expected


def test_broken_pages_end_soon():
    for page in ("<" * 50_000, "<a " * 20_000, "<p a=\"" * 5_000, "<!--" * 10_000, "&" * 100_000, "<div>" * 3_000, "</div>" * 20_000):
        html.blocks(page)


MEGABYTE = 1_000_000
BROKEN = {
    "tag in tag": "<a", "tag in tag with space": "<a ", "tag in tag, one end": "<a<b ", "open quotes": "<p a=\"", "both quotes": "<p a=\"x' b='",
    "data": "<![CDATA[", "data end": "]]><![CDATA[", "comments": "<!--", "declarations": "<!", "questions": "<?x", "less": "<", "ends": "</p", "letters": "<b<c",
    "open elements": "<b>", "open blocks": "<div>", "closed only": "</div>", "open p in b": "<b></p>", "p behind a wall": "<b><p></p>", "rows": "<tr><b>",
    "references": "&", "numbers": "&#", "names": "&amp", "attributes": "<i class=", "attribute names": "<i id id id>", "spaces": "<script </script ",
    "items": "<ul><li><b>", "options": "<option><select>", "raw": "<script>", "raw with slash": "<script/>", "single quotes": "<p a='<p b=\">",
}


@pytest.mark.parametrize("unit", BROKEN.values(), ids=BROKEN.keys())
@pytest.mark.parametrize("head, tail", [("", ""), ("", ">"), ("<p><div>", "\"'>")])
def test_a_broken_megabyte_takes_seconds(unit, head, tail):
    page = head + unit * (MEGABYTE // len(unit)) + tail
    began = time.process_time()
    html.blocks(page)
    assert time.process_time() - began < 6


def test_huge_and_padded_references():
    assert html.blocks("<p>&#" + "0" * 9000 + "65; &#" + "9" * 9000 + "; &#x" + "f" * 9000 + ";&#97;</p>") == [(html.OPEN, "A \ufffd \ufffda")]


_OLD_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*)>",
    re.S,
)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "<p", "</p", "<b ", "a", " ", "\"", "'", "/", "<!--", "-->", "<![CDATA[", "]]>", "<!", "<?", "="]), max_size=25))
def test_tags_are_those_of_a_pattern(parts):
    """A pattern that tries both ways to end a tag finds the same tags, in time that grows faster."""
    page = "".join(parts)
    tags, at, found = html._Tags(page), 0, []
    while (tag := tags.next(at)) is not None:
        found.append(tag[:2])
        at = tag[1]
    assert found == [m.span() for m in _OLD_TAG.finditer(page)]


def test_suffix_classes_equal_those_of_slices():
    dice = np.random.default_rng(0)
    tokens = dice.integers(0, 3, 400).astype(np.uint64)
    order, kind = html.suffix_array(tokens, 6)
    cut = [tuple(tokens[i : i + 6].tolist()) for i in range(len(tokens))]
    seen = {}
    for i, key in enumerate(kind.tolist()):
        assert seen.setdefault(key, cut[i]) == cut[i]
    assert len(seen) == len(set(cut))
    assert [cut[i] for i in order] == sorted(cut)


def words(i, n=30):
    return " ".join(f"w{i}x{j}" for j in range(n))


BOIL = "accept all our terms and conditions before you read on this site"


@pytest.mark.parametrize("tokens", [100, 400_000])
def test_repeats_of_a_host_go_and_unique_runs_stay(spark, tokens):
    rows = []
    for i in range(12):
        page = f"<html><body><div>{BOIL}</div><p>{words(i)}</p><p>{words(i + 100)} {BOIL} {words(i + 200)}</p></body></html>"
        rows.append((i, f"http://h{i % 2}.com/a", page))
    rows += [(20 + i, f"https://H{i}.org:80/", f"<p>{BOIL}</p>") for i in range(5)]
    rows += [(30 + i, "http://c.com/x", f"<p>{words(7)}</p>") for i in range(6)]
    rows += [(50, None, None), (51, "x", ""), (52, "http://z.com", "<p>a &lt; b<td>c<!-- no"), (53, "http://z.com", "<p>short"), (53, "http://z.com", "<p>short")]
    pages = spark.createDataFrame([(*row, "extra", 1) for row in rows], "page_id long, url string, html string, text string, host int")
    found = defaultdict(list)
    for row in _extract(pages, tokens).collect():
        found[row.page_id].append(row.text)
    for i in range(12):
        assert found[i] == [f"{words(i)}\n\n{words(i + 100)} {words(i + 200)}"]
    for i in range(5):
        assert found[20 + i] == [BOIL]  # once per host: no repeat
    for i in range(6):
        assert found[30 + i] == [words(7)]  # copies of one page count once
    assert found[50] == [""] and found[51] == [""] and found[52] == ["a < b c"] and found[53] == ["short"] * 2


@pytest.mark.parametrize("tokens", [20, 400_000])
def test_one_template_around_different_articles_is_a_repeat(spark, tokens):
    def page(article):
        return f"<div>{BOIL}</div><article><p>{article}</p></article><div>{BOIL} again</div>"

    rows = [(i, "http://same.com/a", page(words(i))) for i in range(8)]
    rows += [(20 + i, "http://two.com/a", page(words(i))) for i in range(2)]
    rows += [(30 + i, "http://copies.com/a", page(words(7))) for i in range(6)]
    # Two articles in one template and a page of another stream: three pages hold the stretch.
    rows += [(40 + i, "http://mixed.com/a", page(words(i))) for i in range(2)] + [(42, "http://mixed.com/b", f"<p>{BOIL}</p><p>{words(9)}</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {row.page_id: row for row in _extract(pages, tokens).collect()}
    for i in range(8):
        assert found[i].text == words(i) and found[i].repeated_tokens == 25
    for i, k in [(20, 0), (21, 1), *((30 + i, 7) for i in range(6))]:
        assert found[i].text == f"{BOIL}\n\n{words(k)}\n\n{BOIL} again" and found[i].repeated_tokens == 0
    assert [found[i].text for i in (40, 41, 42)] == [words(0), words(1), words(9)]


def _extract(pages, tokens):
    old = html.repeated_stretches.__defaults__
    html.repeated_stretches.__defaults__ = (*old[:-1], tokens)
    try:
        return html.extract(pages)
    finally:
        html.repeated_stretches.__defaults__ = old


def test_no_pages(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_hosts(spark):
    urls = ["http://A.b.C:80/x", "https://u:p@h.org?q", "ftp://f#x", "nothing", None, ""]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    from pyspark.sql import functions as F

    found = [row.h for row in rows.select("i", html.host_of(F.col("u")).alias("h")).orderBy("i").collect()]
    assert found == ["a.b.c", "h.org", "f", "", "", ""]
