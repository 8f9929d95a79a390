"""Text kernels that expressions don't express: HTML, front matter, chunks, tolerant JSON, compression.

Each is a small function of one text, applied in Arrow batches by ``column`` or ``rows``.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Elements whose content isn't text of the page.
_DROP = {"script", "style", "nav", "footer", "aside", "noscript", "iframe", "form", "button", "svg"}
_VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr"}
_BLOCK = {"p", "div", "section", "article", "main", "header", "table", "tr", "ul", "ol", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "li", "body", "figure"}


#: Bytes of an Arrow batch: a Python worker holds a few of them, whatever the texts' lengths.
BATCH_BYTES = 8 << 20


def bounded_batches() -> None:
    conf, name = SparkSession.active().conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    held = conf.get(name, None)
    if held is None or not held.isdigit() or int(held) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))


def column(function: Callable, kind: str) -> Callable[..., Column]:
    """A Column function from a function of one or more values, by Arrow batches of bounded bytes; a first value of null gives null."""
    made = []

    def over(*values: pd.Series) -> pd.Series:
        return pd.Series([None if row[0] is None else function(*row) for row in zip(*values)], dtype=object)

    def over_struct(*values: pd.Series) -> pd.DataFrame:
        found = [{} if row[0] is None else function(*row) for row in zip(*values)]
        return pd.DataFrame(found, columns=[f.partition(":")[0] for f in kind[7:-1].split(",")], dtype=object)

    def call(*columns: Column | str) -> Column:
        bounded_batches()
        if not made:  # a session has to exist to read the type
            made.append(F.pandas_udf(_one(over_struct if kind.startswith("struct") else over, len(columns)), kind))
        return made[0](*columns)

    return call


def _one(function: Callable, n: int) -> Callable:
    """With a fixed number of arguments, which Spark counts."""
    return {1: lambda a: function(a), 2: lambda a, b: function(a, b), 3: lambda a, b, c: function(a, b, c)}[n]


def normal_key(text: str) -> str:
    """NFKC, lower case, no white space."""
    return "".join(unicodedata.normalize("NFKC", text).lower().split())


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """(keys, rest) of a text that begins with a block between lines of three dashes; values are plain scalars."""
    if not text.startswith("---\n"):
        return {}, text
    head, mark, rest = text[4:].partition("\n---\n")
    if not mark:
        return {}, text
    keys = {}
    for line in head.split("\n"):
        name, colon, value = line.partition(":")
        if colon and re.fullmatch(r"[\w-]+", name.strip()):
            keys[name.strip()] = value.strip().strip("\"'")
    return keys, rest


class _Page(HTMLParser):
    """Title, first heading, metas, canonical link and the Markdown of the main container."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.h1, self.meta, self.canonical = "", "", {}, None
        self.stack: list[str] = []
        self.out: dict[str, list[str]] = {"article": [], "main": [], "body": []}
        self.found: set[str] = set()
        self.lists: list[list] = []
        self.links: list[str | None] = []
        self.images = 0

    def _inside(self) -> bool:
        return not _DROP & set(self.stack) and "head" not in self.stack

    def _put(self, text: str) -> None:
        if self._inside():
            for name in self.out:
                if name == "body" or name in self.stack:
                    self.out[name].append(text)

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag == "meta":
            self.meta[given.get("property") or given.get("name") or ""] = given.get("content") or ""
        elif tag == "link" and given.get("rel") == "canonical":
            self.canonical = given.get("href")
        if tag in self.out:
            self.found.add(tag)
        if tag not in _VOID:
            self.stack.append(tag)
        if tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self._put("\n")
        elif tag == "li" and self.lists:
            self.lists[-1][1] += 1
            self._put("\n" + "  " * (len(self.lists) - 1) + ("- " if self.lists[-1][0] == "ul" else f"{self.lists[-1][1]}. "))
        elif re.fullmatch("h[1-6]", tag):
            self._put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("b", "strong"):
            self._put("**")
        elif tag in ("i", "em"):
            self._put("*")
        elif tag == "code" and "pre" not in self.stack:
            self._put("`")
        elif tag == "pre":
            self._put("\n\n```\n")
        elif tag == "blockquote":
            self._put("\n\n> ")
        elif tag == "br":
            self._put("\n")
        elif tag == "img":
            self.images += 1
            if self.images <= 30:
                self._put(f"![{given.get('alt') or ''}]({given.get('src') or ''})")
        elif tag == "a":
            self.links.append(given.get("href"))
            self._put("[")
        elif tag in ("td", "th"):
            self._put(" | ")
        elif tag in _BLOCK:
            self._put("\n\n")

    def handle_endtag(self, tag):
        if tag in ("b", "strong"):
            self._put("**")
        elif tag in ("i", "em"):
            self._put("*")
        elif tag == "code" and "pre" not in self.stack:
            self._put("`")
        elif tag == "pre":
            self._put("\n```\n\n")
        elif tag == "a" and self.links:
            self._put(f"]({self.links.pop() or ''})")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self._put("\n")
        elif tag in _BLOCK - {"li"}:
            self._put("\n\n")
        if tag in self.stack:
            while self.stack and self.stack.pop() != tag:
                pass

    def handle_data(self, data):
        if "title" in self.stack and "svg" not in self.stack:
            self.title += data
        elif "h1" in self.stack and not self.h1.endswith("\0"):
            self.h1 += data
        if self._inside() and "title" not in self.stack:
            self._put(data if "pre" in self.stack else re.sub(r"\s+", " ", data))


def _page(html: str) -> _Page:
    page = _Page()
    page.feed(html)
    page.close()
    return page


def html_markdown(html: str) -> str:
    """Markdown of the article, else main, else body, without navigation, scripts and forms."""
    page = _page(html)
    name = next((n for n in ("article", "main") if n in page.found), "body")
    text = re.sub(r"[ \t]+\n", "\n", "".join(page.out[name]))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def html_meta(html: str, most: int = 50_000) -> tuple[str, str, str | None, str | None, str]:
    """(title, h1, date, canonical link, text) of a page."""
    page = _page(html)
    date = next((page.meta[k] for k in ("article:published_time", "date", "pubdate") if page.meta.get(k)), None)
    text = re.sub(r"\s+", " ", re.sub(r"[*`#>\[\]]|\([^)]*\)", " ", html_markdown(html))).strip()
    return page.title.strip(), page.h1.strip(), date, page.canonical, text[:most]


def chunks(text: str) -> list[tuple[int, str, str]]:
    """(number, path of headings, content) of the parts of a Markdown text between its headings; none inside fences."""
    found, path, held, fenced = [], [], [], False

    def close():
        content = "\n".join(held).strip()
        if content:
            found.append((len(found), " > ".join(f"{'#' * n} {t}" for n, t in path), content))
        held.clear()

    for line in re.split(r"\r?\n", text):
        if re.match(r"\s*(```|~~~)", line):
            fenced = not fenced
        heading = None if fenced else re.match(r"(#{1,6})\s+(.*)", line)
        if heading:
            close()
            level = len(heading[1])
            path = [p for p in path if p[0] < level]
            path.append((level, heading[2].strip()))
        else:
            held.append(line)
    close()
    return found


def rule_score(kind: str, size: int, text: str) -> tuple[int, int, int, int, int, float]:
    """Type, size, headings, tables and code, each a few points, and their sum out of 14 as a score out of 10."""
    lines, html = text.split("\n"), kind == ".html"
    seen = [int(x) for x in re.findall(r"(?i)<h([1-6])(?=[\s>])", text)] if html else [len(m[1]) for m in (re.match(r"(#{1,6})\s", line) for line in lines) if m]
    headings = 0 if not seen else 1 if len(set(seen)) < 2 or len(seen) < 3 else 3 if len(seen) >= 6 else 2
    if html:
        found = re.findall(r"(?is)<table[\s>].*?</table>", text)
        tables, rows = len(found), sum(len(re.findall(r"(?i)<tr[\s>]", t)) for t in found)
    else:
        marks = [k for k, line in enumerate(lines) if "|" in line and "-" in line and re.fullmatch(r"[\s|:-]+", line)]
        tables, rows = len(marks), 0
        for k in marks:
            for line in lines[k + 1 :]:
                if "|" not in line:
                    break
                rows += 1
    table = 0 if not tables else 3 if rows >= 20 else 2 if tables >= 2 or rows >= 5 else 1
    if html:
        code = sum(1 for block in re.findall(r"(?is)<pre[\s>].*?</pre>", text) for line in block[block.index(">") + 1 : -6].split("\n") if line.strip())
    else:
        code, inside = 0, False
        for line in lines:
            if re.match(r"\s*```", line):
                inside = not inside
            elif inside and line.strip():
                code += 1
    full = sum(1 for line in lines if line.strip())
    band = 0
    if code and full >= 5:
        share = code / full
        band = 1 if share <= 0.1 else 2 if share <= 0.3 or share > 0.8 and not headings else 3
    points = (2 if html else 1, 3 if size > 51_200 else 2 if size > 10_240 else 1 if size > 2_048 else 0, headings, table, band)
    return (*points, int(sum(points) / 14 * 100 + 0.5) / 10)


def compress(text: str, most: int = 12_288, section: int = 450, head: float = 0.65, window: int = 300) -> str:
    """Shorten a text for a model: headings stay, each section keeps its head and tail; without headings, windows over the whole."""
    if len(text) <= most:
        return text
    keys, rest = front_matter(text)
    lead = text[: len(text) - len(rest)][:1000]
    parts = re.split(r"(?m)^(?=#{1,6}\s)", rest)
    if len(parts) > 1:
        short = []
        for part in parts:
            first, _, body = part.partition("\n") if part.startswith("#") else ("", "", part)
            cut = int(section * head)
            short.append(first + "\n" + (body if len(body) <= section else body[:cut] + "\n…\n" + body[cut - section :]))
        rest = "\n".join(short)
    else:
        n = max(2, most // window)
        step = (len(rest) - window) / (n - 1)
        rest = "\n…\n".join(rest[int(round(k * step)) : int(round(k * step)) + window] for k in range(n))
    return (lead + rest)[:most]


def tolerant_json(text: str) -> dict | None:
    """The first object in a text, with its tail repaired if it is cut off; null if nothing can be read."""
    at = text.find("{")
    if at < 0:
        return None
    try:
        return json.JSONDecoder().raw_decode(text[at:])[0]
    except ValueError:
        pass
    quoted, open_, escape = False, [], False
    for c in text[at:]:
        if escape:
            escape = False
        elif quoted:
            escape, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]" and open_:
            open_.pop()
    tail = ('"' if quoted else "") + "".join(reversed(open_))
    body = text[at:]
    for trial in (body + tail, re.sub(r",\s*$", "", body) + tail, re.sub(r',?\s*"[^"]*"?\s*:?\s*$', "", body) + "".join(reversed(open_))):
        try:
            found = json.loads(trial)
            return found if isinstance(found, dict) else None
        except ValueError:
            continue
    fields = dict(re.findall(r'"(\w+)"\s*:\s*"((?:[^"\\]|\\.)*)"', body))
    return fields or None


def clean_title(text: str, most: int = 160) -> str:
    """One line of at most ``most`` characters; of JSON, its title, name or summary, or the first string in it."""
    if text[:1] in "{[":
        try:
            found = _readable(json.loads(text))
        except ValueError:
            found = None
        text = found or text
    line = " ".join(text.split())
    return line[:most] + "…" if len(line) > most + (line[most:] == "…") else line


def _readable(value, depth: int = 0) -> str | None:
    if depth > 1 or value is None:
        return None
    if isinstance(value, str):
        return value if value.strip() else None
    if isinstance(value, dict):
        named = [value.get(k) for k in ("title", "name", "summary")]
        return next((v for v in named if isinstance(v, str) and v.strip()), None) or next(filter(None, (_readable(v, depth + 1) for v in value.values())), None)
    return next(filter(None, (_readable(v, depth + 1) for v in value)), None) if isinstance(value, list) else None


key_column = column(normal_key, "string")
markdown_column = column(html_markdown, "string")
title_column = column(clean_title, "string")
compress_column = column(compress, "string")
chunk_column = column(lambda t: [{"chunk": n, "path": p, "content": c} for n, p, c in chunks(t)], "array<struct<chunk:int,path:string,content:string>>")
meta_column = column(lambda t: dict(zip(("title", "h1", "date", "canonical", "text"), html_meta(t))), "struct<title:string,h1:string,date:string,canonical:string,text:string>")
json_column = column(lambda t: {k: v if isinstance(v, str) else json.dumps(v) for k, v in (tolerant_json(t) or {}).items()}, "map<string,string>")


score_column = column(lambda k, n, t: dict(zip(("type", "size", "headings", "tables", "code", "score"), rule_score(k, n, t or ""))), "struct<type:int,size:int,headings:int,tables:int,code:int,score:double>")
