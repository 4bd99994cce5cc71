"""Main text extraction: wrappers, page variants, and a plain parser over whole pages."""

from __future__ import annotations

import os
import random
from html.parser import HTMLParser

import pytest
from conftest import SMOKE_DIR
from pyspark.sql import functions as F

from legation.llm.html_text import align, as_items, fold, host_of, host_wrappers, main_text, matched, parse, read
from legation.llm.queries import QUERIES

needs_tables = pytest.mark.skipif(not os.path.isdir(SMOKE_DIR), reason="driver tables not present")


class Plain(HTMLParser):
    """Blocks of the article by open-tag depth alone, for pages with one article."""

    BLOCKS = {"p", "h1", "h2", "article", "li", "ul", "div"}

    def __init__(self):
        super().__init__()
        self.blocks, self.inside = [""], False

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in self.BLOCKS:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.blocks.append("")
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data

    def text(self):
        return "\n\n".join(b for b in (" ".join(x.split()) for x in self.blocks) if b)


def plain(page):
    parser = Plain()
    parser.feed(page or "")
    parser.close()
    return parser.text()


@needs_tables
def test_query_against_plain_parser(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMOKE_DIR}/pages.parquet").collect()}
    got = QUERIES["op12_main_text"](spark, SMOKE_DIR).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plain(pages[r.page_id].html), len(r.text)) and r.text


def expression(*pages):
    items = None
    for page in pages:
        mine = as_items(parse(page))
        items = mine if items is None else align(items, mine)
    return " ".join(x.expression() for x in items)


def test_wrapper_of_equal_pages_is_fixed():
    assert expression("<p>a</p>", "<p>a</p>") == "<p> text </>"


def test_mismatched_text_becomes_a_slot():
    assert expression("<h1>t</h1><p>a</p>", "<h1>t</h1><p>b</p>") == "<h1> text </> <p> #text </>"


def test_mismatched_tag_becomes_optional():
    assert expression("<h1>t</h1><p>a</p>", "<h1>t</h1><hr><p>a</p>") == "<h1> text </> <hr>  </>? <p> text </>"


def test_equal_neighbours_become_repeated():
    assert expression("<ul><li>a<li>b<li>c</ul>", "<ul><li>d</ul>") == "<ul> <li> #text </>+ </>"


def test_repeated_groups():
    several = "<h2>a</h2><p>b</p><h2>c</h2><p>d</p>"
    assert expression(several) == "( <h2> #text </> <p> #text </> )+"
    assert expression("<h2>x</h2><p>y</p>", several) == "( <h2> #text </> <p> #text </> )+"
    assert expression(several, "<div>z</div><h2>x</h2><p>y</p>").endswith("( <h2> #text </> <p> #text </> )+")


def test_wrapper_accepts_every_page_it_saw():
    """Every text of every page falls into a slot of the wrapper."""
    r = random.Random(3)

    def page():
        parts = [f"<h1>{r.random()}</h1>"]
        for _ in range(r.randint(0, 4)):
            parts.append(r.choice(["<p>{0}</p>", "<h2>{0}</h2><p>{0}</p>", "<ul><li>{0}<li>{0}</ul>", "<div class=x><p>{0}</p></div>"]).format(r.random()))
        return "".join(parts)

    pages = [page() for _ in range(60)]
    items = None
    for p in pages:
        mine = as_items(parse(p))
        items = mine if items is None else align(items, mine)
    for p in pages:
        mine = as_items(parse(p))
        texts = sum(len(y.texts) for _, y in matched(items, mine))
        assert texts == p.count("0.")  # every random number is a text of its own


FRAME = (
    '<html><head><title>T</title><script>if (a<b) x("</p>")</script><style>p{{}}</style></head><body>'
    "<header><p>Site</p></header><nav><ul><li><a href=/>Home</a></ul></nav><div id='cookie-notice'>We use cookies</div>"
    "{0}<aside>Side</aside><form><label>Mail</label><input></form><footer>&copy; foot</footer></body></html>"
)
CASES = {
    "<article><h1>A &amp; B</h1><p>one\n two<p><b>three</b> four<br>five</article>": "A & B\n\none two\n\nthree four five",
    "<article><header><h1>Title</h1><span>by me</span></header><p>x</p><div class='share'>tweet</div></article>": "Title\n\nx",
    "<article><p>x</p><section class='comments'><article><p>first!</p></article></section></article>": "x",
    "<article><p>x</p></article><div id=comments><article class=comment><p>first!</p></article></div>": "x",
    "<article><p>a &lt;b&gt; &#233;&#x2603; &nbsp; c &unknown; &am</p></article>": "a <b> é☃ c &unknown; &am",
    "<article><p>x</p></article><section id=comments><article><p>first!</p></article></section>": "x",
    "<main><div class=ad>buy</div><div class='post-body'><p>x</p><p>y</p></div></main>": "x\n\ny",
    "<div role=main><p>x</p></div>": "x",
    "<main><nav>more</nav><article><p>x</p></article></main>": "x",
    "<article><ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e<tr><td>f</table></article>": "a\n\nb\n\nc\n\nd\n\ne\n\nf",
    "<form><article><p>a form around all</p></article></form>": "a form around all",
    "<article><p>never closed <!-- no > comment --><i>but read": "never closed but read",
    "<article></article>": "",
    "<article><p>x <span class='ad'>buy</span> y <button>go</button></p><noscript>off</noscript></article>": "x y",
    "<article><p>1 < 2 <3</p></article>": "1 < 2 <3",
}


@pytest.mark.parametrize("body", CASES)
def test_cases(body):
    page = FRAME.format(body)
    if "never closed" in body:
        page = page[: page.index("<aside>")]
    assert read(parse(page), [], 0) == CASES[body]


def bare(title, body):
    """A page without article elements or telling names: only its host's other pages show what is its own."""
    return f"<html><body><div><p>The Daily</p></div><table><tr><td><a href=1>Home page</a><td><a href=2>All news</a></table><h1>{title}</h1>{body}<div>All rights reserved</div></body></html>"


def test_hosts_without_article_use_the_wrapper(spark):
    rows = [(i, f"http://Bare.example:80/{i}", bare(f"Title {i}", "".join(f"<p>text {i} {j}</p>" for j in range(i + 1)))) for i in range(4)]
    rows += [(10, "https://other.example/", bare("Lone", "<div id='content'><p>named</p><p>block of this page, long enough to be most of it all</p></div>"))]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i in range(4):
        assert got[i] == "\n\n".join([f"Title {i}", *(f"text {i} {j}" for j in range(i + 1))])
    assert got[10] == "named\n\nblock of this page, long enough to be most of it all"


def test_partitioning_does_not_matter(spark):
    rows = [(i, f"http://h{i % 3}.example/{i}", bare(f"T{i}", f"<p>p{i}</p>" * (i % 4 + 1))) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    one, many = ({r.page_id: r.text for r in main_text(df.repartition(n)).collect()} for n in (1, 23))
    assert one == many and all(one[i].startswith(f"T{i}\n\np{i}") for i in one)


def test_messy_rows(spark):
    long_page = "<article>" + "<p>word word</p>" * 20_000 + "</article>"
    rows = [
        (1, None, "<article>a</article>"), (2, "not a url", None), (None, "http://x.example/", "<article>b</article>"),
        (3, "http://x.example/", ""), (3, "http://x.example/", ""), (4, "http://x.example/", long_page), (5, "", "<<<>>> &"), (6, None, "no tags at all"),
    ]
    schema = "page_id long, url string, html string"
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in main_text(spark.createDataFrame(rows, schema)).collect()), key=str)
    texts = {1: "a", 2: "", None: "b", 3: "", 4: "\n\n".join(["word word"] * 20_000), 5: "<<<>>> &", 6: "no tags at all"}
    assert got == sorted(((i, u, texts[i], len(texts[i])) for i, u, _ in rows), key=str)
    wide = spark.createDataFrame([(*r, "clash", 1) for r in rows], schema + ", text string, __html int")
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in main_text(wide).collect()), key=str) == got
    assert main_text(spark.createDataFrame([], schema)).collect() == []


def test_hosts(spark):
    urls = ["http://A.b/c", "https://u:p@a.b:8080?x", "a.b/c", None, "ftp://a.b", "http:///x"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(host_of(F.col("u")).alias("h"))
    assert [r.h for r in got.collect()] == ["a.b", "a.b", "", "", "a.b", ""]


def test_one_wrapper_per_host(spark):
    rows = [(f"h{i % 5}", f"<p>{i}</p>" * (i % 3 + 1)) for i in range(200)]
    got = host_wrappers(spark.createDataFrame(rows, "host string, html string").repartition(16)).collect()
    assert sorted((r.host, r.pages) for r in got) == [(f"h{k}", 40) for k in range(5)]


def test_fold_leaves_single_items():
    assert [x.sign for x in fold(as_items(parse("<p>a</p><h2>b</h2><p>c</p>")))] == ["p", "h2", "p"]
