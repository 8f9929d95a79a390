r"""Pages for a reader, in column functions: cleaning HTML, Markdown to HTML, headings with anchors and their table, addresses of assets.

Cleaning never hands on a piece of its input as markup. Tokens are found the way browsers find them, and each tag is written anew from
its name and the attributes that may stay, with ``<``, ``>`` and ``"`` escaped in every value; a ``<`` that opens no tag becomes text.

Every function takes null to null and an empty text to an empty one. Work is linear in the text, but for the corrections of wrong
nesting (few in a page), whose list is copied as it grows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that go with all they hold, those that go alone, and the schemes of addresses that run code.
DROPPED = ["script", "iframe", "frameset", "object", "form", "noembed", "noframes", "xmp", "applet"]
DROPPED_ALONE = ["frame", "embed", "link", "base", "plaintext"]
UNSAFE = r"(?:^|;)(?:javascript:|vbscript:|data:(?!image/(?:png|gif|jpe?g|webp|avif|bmp)[;,]))"
#: Attributes that hold an address, or set one by animation; attributes that hold markup or send data.
ADDRESSES = ["href", "src", "xlink:href", "action", "poster", "srcset", "data", "cite", "background", "from", "to", "by", "values"]
NEVER = ["srcdoc", "formaction", "ping"]
#: Elements without content; elements that the next of their name closes.
VOID = ["area", "br", "col", "hr", "img", "input", "meta", "param", "source", "track", "wbr"]
FOLLOWED = ["p", "li", "td", "th", "tr", "dt", "dd", "option"]
#: Named characters that are read in headings and in schemes.
NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "colon": ":", "Tab": "\t", "NewLine": "\n", "copy": "©", "middot": "·", "mdash": "—", "ndash": "–", "hellip": "…"}

_ATTRIBUTES = r"""(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+"""
_TOKEN = (
    r"(?is)<!--.*?(?:-->|\z)"
    rf"|<(script|style|iframe|noembed|noframes|xmp)(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1(?=[\s/>])[^>]*>|\z)"
    rf"|</?[a-z][^\s/>]*+{_ATTRIBUTES}>|<[!?/][^>]*+>|[^<]++|<"
)
_ATTRIBUTE = r"""([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+))?"""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _escaped(text: Column, signs: str = '<>"') -> Column:
    for sign, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(entity)) if sign in signs else text
    return text


def decoded(text: Column) -> Column:
    """Text with its character references read: all numbers, the names of ``NAMED`` and ``&amp;``, that one last."""

    def piece(p: Column) -> Column:
        code = F.coalesce(
            F.conv(F.nullif(F.regexp_extract(p, r"^&#[xX]0*([0-9a-fA-F]{1,6})(?![0-9a-fA-F])", 1), F.lit("")), 16, 10),
            F.nullif(F.regexp_extract(p, r"^&#0*([0-9]{1,7})(?![0-9])", 1), F.lit("")),
        ).cast("bigint")
        sign = F.when((code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("�")
        return F.when(code.isNotNull(), F.concat(sign, F.regexp_replace(p, r"^&#[xX]?[0-9a-fA-F]+;?", ""))).otherwise(p)

    def decimals(p: Column) -> Column:  # a decimal reference ends before letters that hexadecimal ones would take
        return F.regexp_replace(p, r"^(&#[0-9]+)(?=[a-fA-F])", "$1;")

    def whole(t: Column) -> Column:
        read = F.array_join(F.transform(F.split(t, r"(?=&#(?:[0-9]|[xX][0-9a-fA-F]))"), lambda p: let(decimals(p), piece)), "")
        for name, sign in NAMED.items():
            read = F.replace(read, F.lit(f"&{name};"), F.lit(sign))
        return F.when(F.contains(t, F.lit("&")), F.replace(read, F.lit("&amp;"), F.lit("&"))).otherwise(t)

    return let(text, whole)


def unsafe(address: Column) -> Column:
    """Whether an address, its references read and blanks and control signs left out, has a scheme that runs code."""
    return F.lower(F.regexp_replace(decoded(address), r"[\x00-\x20\x7f]", "")).rlike(UNSAFE)


def _component(text: Column) -> Column:
    """The text as a component of an address, encoded once even where it is encoded already."""
    out = F.url_encode(F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text))
    for code, sign in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def _tag(token: Column, name: Column, assets: Column | None) -> Column:
    """An opening tag written anew."""

    def attribute(given: Column) -> Column:
        key = F.lower(F.regexp_extract(given, _ATTRIBUTE, 1))
        raw = F.regexp_extract(given, _ATTRIBUTE, 2)
        return let(F.struct(key.alias("k"), F.regexp_replace(raw, r"""(?s)^(["'])(.*)\1$""", "$2").alias("v"), F.contains(given, F.lit("=")).alias("has")), written)

    def written(a: Column) -> Column:
        value = a["v"]
        if assets is not None:
            local = (name == "img") & (a["k"] == "src") & (F.trim(value) != "") & ~F.trim(value).rlike(r"(?i)^(?:https?:|data:|//|/api/)")
            path = _component(F.regexp_replace(decoded(F.trim(value)), r"^\.?/", ""))
            value = F.when(local, F.concat(assets, path, F.lit('" loading="lazy'))).otherwise(_escaped(value))
        else:
            value = _escaped(value)
        stays = a["k"].rlike(r"^(?!on)[a-z_][a-z0-9_:.-]*$") & ~a["k"].isin(NEVER) & ~F.when(a["k"].isin(ADDRESSES), unsafe(a["v"])).otherwise(False)
        return F.when(~stays, "").when(a["has"], F.concat(F.lit(" "), a["k"], F.lit('="'), value, F.lit('"'))).otherwise(F.concat(F.lit(" "), a["k"]))

    body = F.regexp_replace(token, r"(?s)^<[^\s/>]+|>$", "")
    return F.concat(F.lit("<"), name, F.array_join(F.transform(F.regexp_extract_all(body, F.lit(_ATTRIBUTE), 0), attribute), ""), F.lit(">"))


def _token(token: Column, assets: Column | None) -> Column:
    """(kind, name, out) of a token: text, open, close, drop (what begins to go with all it holds), or nothing more than out."""
    name = F.lower(F.regexp_extract(token, r"^</?([A-Za-z][^\s/>]*)", 1))

    def parts(n: Column) -> Column:
        plain = n.rlike(r"^[a-z][a-z0-9:-]*$") & ~n.isin(DROPPED_ALONE)
        close = token.startswith("</")
        redirect = (n == "meta") & token.rlike(r"(?i)[\s/\"']http-equiv\s*=")
        style = F.concat(F.lit("<style>"), F.replace(F.regexp_extract(token, rf"(?is)^<style{_ATTRIBUTES}>(.*?)(?:</style[^>]*>)?\z", 1), F.lit("<"), F.lit("")), F.lit("</style>"))
        raw = n.isin("script", "iframe", "noembed", "noframes", "xmp")
        kind = F.when(n == "", F.lit("text")).when(~plain | raw | redirect | (n == "style") | n.isin(VOID), F.lit("whole")).when(close, F.lit("close")).when(n.isin(DROPPED), F.lit("drop")).otherwise(F.lit("open"))
        out = (
            F.when(n == "", F.when(token.startswith("<!") | token.startswith("<?") | token.startswith("</"), "").otherwise(_escaped(token, "<")))
            .when(~plain | raw | redirect, "")
            .when(n == "style", F.when(close, "").otherwise(style))
            .when(close, F.when(n.isin(VOID), "").otherwise(F.concat(F.lit("</"), n, F.lit(">"))))
            .when(token == F.concat(F.lit("<"), n, F.lit(">")), token)
            .otherwise(_tag(token, n, assets))
        )
        return F.struct(kind.alias("kind"), n.alias("name"), out.alias("out"))

    text = F.struct(F.lit("text").alias("kind"), F.lit("").alias("name"), token.alias("out"))
    return F.when(~token.startswith("<"), text).otherwise(let(name, parts))


_STATE = "struct<stack:array<string>,edits:array<struct<start:int,stop:int,out:string>>,depth:int,since:int>"


def _edit(start: Column, stop: Column, out: Column) -> Column:
    return F.array(F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), out.alias("out")))


def _closers(names: Column) -> Column:
    return F.array_join(F.transform(names, lambda n: F.concat(F.lit("</"), n, F.lit(">"))), "")


def _step(s: Column, x: Column) -> Column:
    """The state after a tag: open elements, the innermost first; corrections so far; where a dropped element began, if one is open."""
    dropping = s["depth"] >= 0
    follows = (x["kind"] == "open") & x["name"].isin(FOLLOWED) & (F.get(s["stack"], F.lit(0)) == x["name"])
    push = F.concat(F.array(x["name"]), s["stack"])
    starts = ~dropping & (x["kind"] == "drop")

    def closed(at: Column) -> Column:
        left = F.slice(s["stack"], at + 1, F.size(s["stack"]))
        ends = dropping & (F.size(left) <= s["depth"])
        # an outer element that closes takes the dropped one with it and is itself still to be closed
        shown = F.slice(s["stack"], F.size(s["stack"]) - s["depth"] + 1, F.greatest(at - (F.size(s["stack"]) - s["depth"]), F.lit(0)))
        edits = (
            F.when(ends, F.concat(s["edits"], _edit(s["since"], x["i"], _closers(shown))))
            .when(dropping | (at == 1), s["edits"])
            .otherwise(F.concat(s["edits"], _edit(x["i"], x["i"], _closers(F.slice(s["stack"], 1, at)))))
        )
        return F.struct(left.alias("stack"), edits.alias("edits"), F.when(ends, -1).otherwise(s["depth"]).alias("depth"), s["since"].alias("since")).cast(_STATE)

    stray = F.struct(s["stack"].alias("stack"), F.when(dropping, s["edits"]).otherwise(F.concat(s["edits"], _edit(x["i"], x["i"], F.lit("")))).alias("edits"), s["depth"].alias("depth"), s["since"].alias("since")).cast(_STATE)
    opened = F.struct(
        F.when(follows, s["stack"]).otherwise(push).alias("stack"),
        F.when(follows & ~dropping, F.concat(s["edits"], _edit(x["i"], x["i"] - 1, _closers(F.array(x["name"]))))).otherwise(s["edits"]).alias("edits"),
        F.when(starts, F.size(s["stack"])).otherwise(s["depth"]).alias("depth"),
        F.when(starts, x["i"]).otherwise(s["since"]).alias("since"),
    ).cast(_STATE)
    return F.when(x["kind"] != "close", opened).otherwise(let(F.array_position(s["stack"], x["name"]).cast("int"), lambda at: F.when(at == 0, stray).otherwise(closed(at))))


def _assembled(tokens: Column, state: Column) -> Column:
    def whole(v: Column) -> Column:
        outs, n = v["outs"], F.size(v["outs"])
        open_now = F.when(v["s"]["depth"] >= 0, F.slice(v["s"]["stack"], F.size(v["s"]["stack"]) - v["s"]["depth"] + 1, F.greatest(v["s"]["depth"], F.lit(0)))).otherwise(v["s"]["stack"])
        last = F.when(v["s"]["depth"] >= 0, _edit(v["s"]["since"], n - 1, F.lit(""))).otherwise(F.array().cast("array<struct<start:int,stop:int,out:string>>"))
        end = _edit(n, n, _closers(open_now))
        return let(F.struct(F.concat(v["s"]["edits"], last, end).alias("e"), outs.alias("outs")), lambda w: F.array_join(F.transform(w["e"], lambda e, k: stretch(w, e, k)), ""))

    def stretch(w: Column, e: Column, k: Column) -> Column:
        before = F.when(k == 0, F.lit(-1)).otherwise(F.get(w["e"], k - 1)["stop"])
        return F.concat(F.array_join(F.slice(w["outs"], before + 2, F.greatest(e["start"] - before - 1, F.lit(0))), ""), e["out"])

    return let(F.struct(F.transform(tokens, lambda t: t["out"]).alias("outs"), state.alias("s")), whole)


def sanitized(html: Column | str, assets: Column | None = None) -> Column:
    """HTML without code: no scripts, frames, objects, forms, links to style sheets or bases, redirections, handlers, addresses that run
    code, comments or declarations; styles stay (without ``<``). What is left is nested properly and every element is closed.

    ``assets`` is an address that relative images are appended to, encoded once; they are then loaded when they are seen."""
    html = F.col(html) if isinstance(html, str) else html
    head = F.regexp_extract(html, r"(?s)^.*>", 0)  # behind the last > is only text

    def nested(tokens: Column) -> Column:
        tags = F.filter(F.transform(tokens, lambda t, i: F.struct(i.alias("i"), t["kind"].alias("kind"), t["name"].alias("name"))), lambda t: ~t["kind"].isin("text", "whole"))
        zero = F.struct(F.array().alias("stack"), F.array().alias("edits"), F.lit(-1).alias("depth"), F.lit(-1).alias("since")).cast(_STATE)
        return _assembled(tokens, F.aggregate(tags, zero, _step))

    def all_tokens(h: Column) -> Column:
        rest = F.array(F.struct(F.lit("text").alias("kind"), F.lit("").alias("name"), _escaped(F.substr(html, F.length(h) + 1), "<").alias("out")))
        return F.concat(F.transform(F.regexp_extract_all(h, F.lit(_TOKEN), 0), lambda t: _token(t, assets)), rest)

    return F.when(html.isNotNull(), let(let(head, all_tokens), nested))


def text_of(html: Column) -> Column:
    """The text of cleaned HTML: without tags and styles, its references read."""
    return decoded(F.regexp_replace(F.regexp_replace(html, r"(?s)<style>.*?</style>", ""), r"<[^>]*>", ""))


def anchored(html: Column | str) -> Column:
    """(html, toc) of cleaned HTML: h1 to h3 that have a text get the id ``rh-<number among all of them>``, and a row (level, text, id)
    each, the text cut after 80 characters."""
    html = F.col(html) if isinstance(html, str) else html

    def head(p: Column, i: Column) -> Column:
        inner = F.regexp_extract(p, r"(?s)^<h([1-3])[^>]*>(.*?)</h\1>", 2)
        text = F.substring(F.regexp_replace(text_of(inner), r"(?U)^\s+|\s+$", ""), 1, 80)
        return F.struct(p.alias("p"), F.substring(p, 3, 1).cast("int").alias("level"), text.alias("text"), F.concat(F.lit("rh-"), i).alias("id"))

    def marked(h: Column) -> Column:
        tag = F.regexp_extract(h["p"], r"^<h[1-3][^>]*>", 0)
        new = F.concat(F.substr(tag, F.lit(1), F.lit(3)), F.regexp_replace(F.regexp_extract(tag, r"^<h[1-3]([^>]*)>", 1), r' id(?:="[^"]*")?(?= |$)', ""), F.lit(' id="'), h["id"], F.lit('">'))
        return F.when(h["text"] == "", h["p"]).otherwise(F.concat(new, F.substr(h["p"], F.length(tag) + 1)))

    def both(v: Column) -> Column:
        toc = F.transform(F.filter(v["heads"], lambda h: h["text"] != ""), lambda h: F.struct(h["level"].alias("level"), h["text"].alias("text"), h["id"].alias("id")))
        return F.struct(F.concat(v["first"], F.array_join(F.transform(v["heads"], marked), "")).alias("html"), toc.alias("toc"))

    def heads(parts: Column) -> Column:
        return F.struct(F.substr(parts[0], F.lit(2)).alias("first"), F.transform(F.slice(parts, 2, F.size(parts)), head).alias("heads"))

    return let(html, lambda h: F.when(h.isNotNull(), let(let(F.split(F.concat(F.lit(" "), h), r"(?=<h[1-3][ >])"), heads), both)))


def _inline(text: Column) -> Column:
    """Escaped text with its marks as elements; what stands between single backticks is code and stays as it is."""

    def marks(p: Column) -> Column:
        for pattern, out in (
            (r"!\[([^\]\n]*)\]\(([^\s()]+)\)", '<img src="$2" alt="$1">'), (r"(?<!!)\[([^\]\n]+)\]\(([^\s()]+)\)", '<a href="$2">$1</a>'),
            (r"(?<![\"=\w/>])(https?://[^\s<>\"]*[^\s<>\".,;:!?)])", '<a href="$1">$1</a>'),
            (r"\*\*(?=\S)([^*\n]+?)(?<=\S)\*\*", "<strong>$1</strong>"), (r"(?<![*\w])\*(?=[^\s*])([^*\n]+?)(?<=\S)\*(?!\*)", "<em>$1</em>"), (r"~~(?=\S)([^~\n]+?)(?<=\S)~~", "<s>$1</s>"),
        ):
            p = F.regexp_replace(p, pattern, out)
        return p

    def odd(parts: Column) -> Column:
        alone = (F.size(parts) % 2 == 0)
        return F.array_join(F.transform(parts, lambda p, i: F.when(alone & (i == F.size(parts) - 1), F.concat(F.lit("`"), marks(p))).when(i % 2 == 1, F.concat(F.lit("<code>"), p, F.lit("</code>"))).otherwise(marks(p))), "")

    return let(F.split(text, "`"), odd)


def _block(block: Column) -> Column:
    """The HTML of a block: heading, rule, list, quotation, table or paragraph."""
    lines = F.split(block, "\n")
    wrap = lambda c, tag: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))
    items = lambda mark: F.array_join(F.transform(F.split(F.regexp_replace(block, rf"^\s*{mark}\s+", ""), rf"\n\s*{mark}\s+"), lambda t: wrap(_inline(t), "li")), "\n")
    level = F.length(F.regexp_extract(block, r"^(#{1,6})\s", 1)).cast("string")
    cells = lambda line, tag: wrap(F.array_join(F.transform(F.split(F.regexp_replace(line, r"^\s*\|?|\|?\s*$", ""), r"\|"), lambda c: wrap(_inline(F.trim(c)), tag)), ""), "tr")
    rows = F.array_join(F.transform(F.slice(lines, 3, F.size(lines)), lambda line: cells(line, "td")), "\n")
    table = F.concat(F.lit("<table>\n"), wrap(cells(lines[0], "th"), "thead"), F.lit("\n"), wrap(rows, "tbody"), F.lit("\n</table>"))
    return (
        F.when(level != "0", F.concat(F.lit("<h"), level, F.lit(">"), _inline(F.regexp_replace(block, r"^#+\s+|\s+#*\s*$", "")), F.lit("</h"), level, F.lit(">")))
        .when(block.rlike(r"^\s*(?:(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,})$"), F.lit("<hr>"))
        .when(block.rlike(r"^\s*[-*+]\s+\S"), F.concat(F.lit("<ul>\n"), items(r"[-*+]"), F.lit("\n</ul>")))
        .when(block.rlike(r"^\s*\d{1,9}[.)]\s+\S"), F.concat(F.lit("<ol>\n"), items(r"\d{1,9}[.)]"), F.lit("\n</ol>")))
        .when(block.rlike(r"^\s*&gt;"), wrap(wrap(_inline(F.regexp_replace(block, r"(?m)^\s*&gt; ?", "")), "p"), "blockquote"))
        .when(block.rlike(r"^[^\n]*\|[^\n]*\n\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*(?:\n|$)"), table)
        .otherwise(wrap(_inline(block), "p"))
    )


def rendered(markdown: Column | str) -> Column:
    """HTML of Markdown, one block a line: headings, paragraphs, flat lists, quotations, rules, tables, fenced code, emphasis, code, links
    and images. HTML in it is text. Lists within lists are flattened; blocks within quotations are one paragraph."""
    markdown = F.col(markdown) if isinstance(markdown, str) else markdown
    text = _escaped(F.replace(F.regexp_replace(markdown, r"\r\n?", "\n"), F.lit("&"), F.lit("&amp;")))

    def stretch(p: Column, i: Column) -> Column:
        spaced = F.regexp_replace(p, r"(?m)^(#{1,6}\s.*|\s*(?:(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,}))$", "\n$1\n")
        blocks = F.filter(F.split(spaced, r"\n[ \t]*(?:\n[ \t]*)+"), lambda b: F.trim(F.replace(b, F.lit("\n"), F.lit(" "))) != "")
        prose = F.array_join(F.transform(blocks, lambda b: let(F.regexp_replace(b, r"^\n+|\s+$", ""), _block)), "\n")
        code = F.concat(F.lit("<pre><code>"), F.regexp_replace(p, r"^[^\n]*\n?", ""), F.lit("</code></pre>"))
        return F.when(i % 2 == 1, code).otherwise(prose)

    fenced = F.transform(F.split(text, r"(?m)^ {0,3}```(?:[ \t]*$\n?)?"), stretch)
    return F.when(markdown.isNotNull(), F.array_join(F.filter(fenced, lambda p: p != ""), "\n"))


def reader(text: Column | str, ext: Column, title: Column, assets: Column) -> Column:
    """(html, toc): the whole page a reader shows, of Markdown (``.md``) or HTML, cleaned either way."""
    text = F.col(text) if isinstance(text, str) else text
    made = anchored(sanitized(F.when(F.lower(ext) == ".md", rendered(text)).otherwise(text), assets))
    shell = lambda a: F.concat(F.lit('<!doctype html>\n<html>\n<head>\n<meta charset="utf-8">\n<base target="_blank">\n<title>'), _escaped(F.coalesce(title, F.lit(""))), F.lit("</title>\n</head>\n<body>"), a["html"], F.lit("</body>\n</html>"))
    return F.when(text.isNotNull(), let(made, lambda a: F.struct(shell(a).alias("html"), a["toc"].alias("toc"))))
