"""op10: densities computed again from the tree by recursion, and pages whose text is known."""

from __future__ import annotations

import math
import time
from html.parser import HTMLParser

from tests.llm import fixtures as fx
from weftline.llm import htmltext as ht

PARA = "A long paragraph of real prose that goes on for a good while so that its density is well above that of any menu around it."
PAGE = f"""<!doctype html><html><head><title>The &amp; title</title><style>p {{color: red}}</style></head><body>
<nav><ul><li><a href=/1>Home</a></li><li><a href=/2>Products and more</a></li><li><a href=/3>About us</a></li></ul></nav>
<div id=main><h1>Heading</h1><p>{PARA}</p><p>{PARA} <a href=x>link</a></p><p>{PARA}</p><ul><li><a href=/5>related one</a><li><a href=/6>related two</a></ul></div>
<script>var x = "<p>not text</p>";</script><!-- <p>nor this</p> --><footer><a href=/7>Imprint</a> <a href=/8>Terms</a></footer></body></html>"""


class Tree(HTMLParser):
    """An independent tree of well-formed pages."""

    def __init__(self, html):
        super().__init__()
        self.root = self.at = {"tag": "#root", "kids": [], "text": "", "up": None}
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "kids": [], "text": "", "up": self.at}
        self.at["kids"].append(node)
        if tag not in ht.VOID:
            self.at = node

    def handle_endtag(self, tag):
        self.at = self.at["up"]

    def handle_data(self, data):
        self.at["text"] += data


def plain(html: str) -> tuple[str, float]:
    root = Tree(html).root
    every = []

    def count(n):
        for k in n["kids"]:
            count(k)
        n["C"] = len("".join(n["text"].split())) + sum(k["C"] for k in n["kids"])
        n["T"] = sum(k["T"] + 1 for k in n["kids"])
        n["LC"] = n["C"] if n["tag"] == "a" else sum(k["LC"] for k in n["kids"])
        n["LT"] = n["T"] if n["tag"] == "a" else sum(k["LT"] + (k["tag"] == "a") for k in n["kids"])
        every.append(n)

    count(root)
    body = next((n for n in every if n["tag"] == "body"), root)

    def density(n):
        if not n["C"]:
            return 0.0
        t, lc, lt = max(n["T"], 1), max(n["LC"], 1), max(n["LT"], 1)
        base = math.log(n["C"] / max(n["C"] - n["LC"], 1) * n["LC"] + body["LC"] / max(body["C"], 1) * n["C"] + math.e)
        return max(n["C"] / t * math.log(max(n["C"] / lc * t / lt, 1)) / base, 0.0)

    best, top = None, -1.0

    def walk(n):
        nonlocal best, top
        s = sum(density(k) for k in n["kids"])
        if s > top:
            best, top = n, s
        for k in n["kids"]:
            walk(k)

    walk(body)
    least, n = density(best), best
    while n is not body:
        n = n["up"]
        least = min(least, density(n))
    return best["tag"], least


def test_selection_equals_recursion():
    pages = ["<html><body>" + "".join(f"<div><p>{PARA[: 20 * k]}</p><div><a>{'l' * (7 * i)}</a><b>x</b>{PARA[:i]}</div></div>" for k in range(i)) + "</body></html>" for i in range(1, 9)] + [f"<html><body><p>{PARA}</p></body></html>", "<html><body></body></html>"]
    for html in pages:
        got = ht.extract_one(html)
        tag, threshold = plain(html)
        assert got.tag == tag and abs(got.threshold - threshold) < 1e-9


def test_article_is_taken_and_menus_are_not():
    got = ht.extract_one(PAGE)
    assert got.title == "The & title"
    assert got.text.split("\n") == ["Heading", PARA, PARA + " link", PARA]


def test_misnested_and_odd_pages():
    assert ht.extract_one("<body><p>one<p>two <b>three</p>four</body>").text.split("\n") == ["one", "two three", "four"]
    for html in ("<", "<>", "</div></p>", "<a href='", "<!-- open", "<script>never closed", "text only", "&amp;&#x41;", "<div " * 500, "<div>" * 5000):
        ht.extract_one(html)
    assert ht.extract_one("text only").text == "text only" and ht.extract_one("&amp;&#x41;").text == "&A"


def test_entities_count_as_characters():
    spelled = PAGE.replace("real", "&#114;eal").replace("prose", "pros&#x65;").replace("so that", "so&nbsp;that")
    plain_, coded = ht.extract_one(PAGE), ht.extract_one(spelled)
    assert (plain_.tag, plain_.threshold, plain_.text) == (coded.tag, coded.threshold, coded.text)
    nodes = ht.parse("<body><p>&nbsp;&amp;&lt;b&gt; x</p></body>")
    ht.weigh(nodes)
    assert [n.chars for n in nodes if n.tag == "p"] == [5]


def test_ties_go_to_the_first():
    html = "<body><div id=1><p>same text here</p><p>same text here</p></div><section><p>same text here</p><p>same text here</p></section></body>"
    assert ht.extract_one(html).tag in ("div", "body")
    two = "<body><div><p>same text</p></div><section><p>same text</p></section></body>"
    nodes = ht.parse(two)
    ht.weigh(nodes)
    best, _ = ht.select(nodes)
    assert best == min(i for i, n in enumerate(nodes) if n.sum == max(x.sum for x in nodes[1:]) and i)


def test_malformed_pages_take_linear_time():
    """Twice the page, about twice the time: unclosed quotes, stray ends, ends beyond a scope."""
    for make in (lambda n: "<a '" * n, lambda n: "<a \"x' " * n, lambda n: "<!" * n, lambda n: "<b>" * n + "</i>" * n, lambda n: "<b><div>" + "<i>" * n + "</b>" * n, lambda n: "<li>" + "<i>" * n + "<p>" * n, lambda n: "<x \"<x\" '" * n, lambda n: "<script " * n):
        start = time.perf_counter()
        ht.extract_one(make(60_000))
        assert time.perf_counter() - start < 6, make(2)


def test_unclosed_quotes_and_brackets():
    assert ht.extract_one("<body><a href='x>one</a> <p>two</p></body>").text.split("\n") == ["one", "two"]
    assert ht.extract_one('<body><a title="a > b <c>">one</a></body>').text == "one"
    assert ht.extract_one("<body>1 < 2 <b>three</b></body>").text == "1 < 2 three"


def test_awkward_rows(spark):
    kind = "page_id long, url string, html string, title string, text string, tag int, threshold string, n_chars int"
    row = lambda i, h: (i, "u", h, "t", "x", 1, "y", 2)
    df = spark.createDataFrame([row(1, PAGE), row(1, PAGE), row(2, None), row(3, ""), row(None, "<p>a</p>"), row(4, f"<body><div><p>{PARA * 20_000}</p></div></body>"), (None,) * 8], kind)
    got = ht.extract(df)
    assert got.columns == ["page_id", "title", "text", "tag", "threshold", "n_chars"] and got.count() == 7
    by = {r["page_id"]: r for r in got.where("page_id is not null").collect()}
    assert by[2]["text"] is None and by[2]["n_chars"] is None and by[3]["text"] == "" and by[4]["n_chars"] > 2_000_000 and by[1]["title"] == "The & title"
    assert ht.extract(df.where("page_id = 99")).count() == 0


def test_test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = ht.extract(pages)
    assert got.count() == pages.count() and got.where("n_chars > 0").count() > 0.8 * pages.count()
    assert fx.PROSE not in got.first()["text"]
