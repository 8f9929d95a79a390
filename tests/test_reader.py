"""Cleaning of pages, Markdown, tables of contents and clip records."""

import html as entities
import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from knowspan.functions import reader as R
from knowspan.operators import pages as P


def every(spark, column, texts):
    """The column over all texts at once, in their order."""
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", column.alias("c"))
    return [r.c for r in sorted(made.collect(), key=lambda r: r.i)]


class Seen(HTMLParser):
    """What a parser finds in cleaned HTML; an element that isn't closed, or closed twice, is an error."""

    def __init__(self, text):
        super().__init__(convert_charrefs=True)
        self.tags, self.attributes, self.stack, self.text = [], [], [], ""
        self.feed(text)
        self.close()
        assert not self.stack, (text, self.stack)

    def handle_starttag(self, tag, attrs):
        self.tags.append(tag)
        self.attributes += attrs
        if tag not in R.VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag):
        assert self.stack and self.stack.pop() == tag

    def handle_data(self, data):
        self.text += data


STATED = {
    "<p>a</p><script>alert(1)</script>": "<p>a</p>",
    "<svg><script>alert(1)</script></svg>": "<svg></svg>",
    '<iframe src="x"></iframe><object></object><embed><meta http-equiv="refresh" content="1"><form></form><base href="//evil"><p>ok</p>': "<p>ok</p>",
    '<img src="a.png" oNeRrOr="alert(1)"><div onclick="x()">t</div>': '<img src="a.png"><div>t</div>',
    '<a href="javascript:alert(1)">x</a><a href="JAVASCRIPT:x">y</a><a href="data:text/html,<b>z</b>">w</a>': "<a>x</a><a>y</a><a>w</a>",
    '<a href="jav&#x09;ascript&colon;x">q</a><a href=" &#106;avascript:x">r</a><a href="\x01javascript:x">s</a>': "<a>q</a><a>r</a><a>s</a>",
    '<img src="data:image/png;base64,AA"><img src="data:image/svg+xml,x">': '<img src="data:image/png;base64,AA"><img>',
    '<a href=x title=\'say "hi" <b>\' hidden>l</a>': '<a href="x" title="say &quot;hi&quot; &lt;b&gt;" hidden>l</a>',
    '<a x" onclick=alert(1)>z</a>': "<a x>z</a>",
    "<p>1<p>2<ul><li>a<li>b</ul>": "<p>1</p><p>2<ul><li>a</li><li>b</li></ul></p>",
    "<div><form>a<div>b</form>c</div>d</x>e": "<div>c</div>de",
    "<div><object>x</div>y": "<div></div>y",
    "<form>x<p>y": "",
    "<b><i>x</b>y": "<b><i>x</i></b>y",
    "a < b <c": "a &lt; b &lt;c",
    "<!-- x --><!doctype html><?php x ?>y": "y",
    "<style>p > a{}</style x><b>k": "<style>p > a{}</style><b>k</b>",
    "<style><!--</style><img src=x onerror=y>": '<style>!--</style><img src="x">',
    "": "",
    None: None,
}


def test_stated_pages(spark):
    assert every(spark, R.sanitized("t"), list(STATED)) == list(STATED.values())


def test_hostile_pages(spark):
    """Nothing that runs survives, whatever pieces meet, and cleaning once more changes nothing that a parser sees."""
    bits = ["<script>", "</script>", "<script", "<style>", "</style/x>", "<!--", "-->", "<", ">", "\"", "'", "=", "/", " ", "\n", "<a href=", "javascript:x", "java\tscript:x", "&#106;avascript:x", "vbscript:x", "data:text/html,x",
            "<img src=x onerror=alert(1)", " onload='x'", "<svg><animate attributeName=href values=", "<form>", "</form>", "<object>", "</object>", "<p>", "</p>", "<b>", "</b>", "<iframe srcdoc=", "<meta http-equiv=refresh>",
            "<noscript>", "<title>", "</title>", "<math>", "<textarea>", "text", "é", "<ul><li>", "</ul>", "<br/>", "<x:y z>", "<base href=//e>", "<link rel=stylesheet>", "]]>", "<![CDATA["]
    made = random.Random(5)
    texts = ["".join(made.choice(bits) for _ in range(made.randint(1, 30))) for _ in range(3000)]
    clean = every(spark, R.sanitized("t"), texts)
    for text, out in zip(texts, clean, strict=True):
        seen = Seen(re.sub(r"<(/?)(title|textarea|noscript)>", r"<\1x-raw>", out))  # inside these a parser reads no tags
        assert not set(seen.tags) & {*R.DROPPED, *R.DROPPED_ALONE}, (text, out)
        for name, value in seen.attributes:
            assert not name.startswith("on") and name not in R.NEVER, (text, out)
            if name in R.ADDRESSES and value:
                assert not re.search(r"(?:^|;)(?:javascript|vbscript|data):", re.sub(r"[\x00-\x20]", "", entities.unescape(value)).lower()), (text, out)
        assert not re.search(r"<(?![a-z/])", out), (text, out)
    assert every(spark, R.sanitized("t"), clean) == clean


def test_long_page_and_many_tags(spark):
    page = "<div>" * 2000 + "<p>x<p>y" * 3000 + "<a " * 3000
    (out,) = every(spark, R.sanitized("t"), [page])
    assert Seen(out).tags.count("p") == 6000 and out.endswith("</div>" * 2000)


def test_real_pages(spark):
    made = P.cleaned(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").withColumn("toc", F.lit(1)))
    assert made.columns == ["page_id", "url", "html", "clean", "toc"]
    for r in made.collect():
        seen = Seen(r.clean)
        assert "script" not in seen.tags and len(r.toc) == seen.tags.count("h1")


def test_contents(spark):
    (made,) = every(spark, R.anchored("t"), ['x<h1 class="c" id="q">A &amp; B&#33;</h1><h2> </h2><h3>c<b>d</b></h3><h4>no</h4>'])
    assert made.html == 'x<h1 class="c" id="rh-0">A &amp; B&#33;</h1><h2> </h2><h3 id="rh-2">c<b>d</b></h3><h4>no</h4>'
    assert [tuple(t) for t in made.toc] == [(1, "A & B!", "rh-0"), (3, "cd", "rh-2")]
    assert [len(t.text) for t in every(spark, R.anchored("t"), ["<h2>" + "é" * 200 + "</h2>"])[0].toc] == [80]
    assert every(spark, R.anchored("t"), [None, ""]) == [None, ("", [])]


MARKDOWN = {
    "# t\n\ntext **bold** *em* ~~s~~ `a*b*`": "<h1>t</h1>\n<p>text <strong>bold</strong> <em>em</em> <s>s</s> <code>a*b*</code></p>",
    "<script>alert(1)</script>": "<p>&lt;script&gt;alert(1)&lt;/script&gt;</p>",
    "[l](http://x.y/z?a=1&b=2) ![p](./i.png)": '<p><a href="http://x.y/z?a=1&amp;b=2">l</a> <img src="./i.png" alt="p"></p>',
    "see https://x.y/z.": '<p>see <a href="https://x.y/z">https://x.y/z</a>.</p>',
    "- a\n- b": "<ul>\n<li>a</li>\n<li>b</li>\n</ul>",
    "1. a\n2. b": "<ol>\n<li>a</li>\n<li>b</li>\n</ol>",
    "> q\n> r": "<blockquote><p>q\nr</p></blockquote>",
    "a\n\n---\n\nb": "<p>a</p>\n<hr>\n<p>b</p>",
    "| a | b |\n|---|---|\n| 1 | 2 |": "<table>\n<thead><tr><th>a</th><th>b</th></tr></thead>\n<tbody><tr><td>1</td><td>2</td></tr></tbody>\n</table>",
    "```py\nx = 1 < 2\n```": "<pre><code>x = 1 &lt; 2\n</code></pre>",
    "a `b": "<p>a `b</p>",
    "": "",
    None: None,
}


def test_markdown(spark):
    assert every(spark, R.rendered("t"), list(MARKDOWN)) == list(MARKDOWN.values())


def test_whole_reader(spark):
    page = R.reader("t", F.lit(".md"), F.lit("a<b"), F.lit("/asset/7?rel="))
    (made,) = every(spark, page, ["# t\n\n![pic](./img/a.png) ![图](assets/%E4%B8%AD%E6%96%87/i%200.png) ![w](https://x/y.png)\n\n<script>x</script>\n\n## 小节"])
    assert "<script" not in made.html and '<base target="_blank">' in made.html and "<title>a&lt;b</title>" in made.html
    assert 'src="/asset/7?rel=img%2Fa.png" loading="lazy"' in made.html and 'src="https://x/y.png"' in made.html
    assert 'src="/asset/7?rel=assets%2F%E4%B8%AD%E6%96%87%2Fi%200.png"' in made.html
    assert [tuple(t) for t in made.toc] == [(1, "t", "rh-0"), (2, "小节", "rh-1")]


def test_clips(spark):
    at = F.lit("2024-01-31 00:00:00")
    asked = spark.createDataFrame([(1, "https://A.com/x#top"), (2, "https://a.com/x"), (3, "ftp://a.com"), (4, None), (5, "http://b.com/"), (6, "http://b.com"), (7, "http://b.com/X")], "id bigint, url string")
    records, refused = P.clip(spark.createDataFrame([], P.CLIP), asked, at)
    assert sorted(r.id for r in records.collect()) == [1, 5, 7]
    assert sorted((r.id, r.why, r.of) for r in refused.collect()) == [(2, "exists", 1), (3, "invalid", None), (4, "invalid", None), (6, "exists", 5)]
    results = spark.createDataFrame([(1, None, None, "timeout"), (5, "B", "/b", None), (5, None, None, "late"), (99, "n", "/n", None)], "id bigint, title string, file string, error string")
    records = P.settle(records, results, at)
    assert sorted((r.id, r.status, r.title, r.error, r.attempts) for r in records.collect()) == [(1, "failed", None, "timeout", 1), (5, "done", "B", None, 1), (7, "pending", None, None, 0)]
    orders = spark.createDataFrame([(1, "retry"), (5, "retry"), (7, "delete"), (7, "reclip"), (99, "delete")], "id bigint, what string")
    records = P.change(records, orders, at)
    assert sorted((r.id, r.status, r.error) for r in records.collect()) == [(1, "pending", None), (5, "done", None)]
    again = P.change(records, spark.createDataFrame([(5, "reclip")], "id bigint, what string"), at)
    assert [(r.id, r.status, r.title) for r in again.where("id = 5").collect()] == [(5, "pending", "B")]


@pytest.mark.parametrize("url, key", [("HTTP://Ab.c/D", "http://ab.c/D"), (" https://a.b/#x ", "https://a.b"), ("https://a.b?q", "https://a.b?q"), ("mailto:x", None), ("", None)])
def test_addresses(spark, url, key):
    assert every(spark, P.address(F.col("t")), [url]) == [key]
