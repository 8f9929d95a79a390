"""Column builders for entries: aliases, metadata of Markdown entries, key points, image references, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the clean-up of inline text turns entities into, in order.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#0?39;", "'"), ("&nbsp;", " ")]
#: Suffixes of images that may be attached, how many, and the longest alias and summary.
IMAGE_SUFFIXES = ["jpg", "jpeg", "png", "gif", "webp", "bmp"]
MOST_IMAGES = 3
LONGEST = 200
#: Patterns that tell kinds of models, and errors after which another node may be asked.
EMBEDDING_MODEL = r"(?i)embed|bge|nomic|gte|minilm"
VISION_MODEL = r"(?i)ocr|vision|image|(^|[-_.])vl($|[-_.\d])"
FAILOVER_ERROR = (
    r"(?i)429|rate.?limit|tpm|rpm|5\d\d|timeout|timed?\s?out|fetch failed|network|econn|socket|abort|empty_llm_response"
)
_HEADING = r"(?m)^#{1,6}\s+(.+?)\s*$"


def inline(text: Column) -> Column:
    """One line of plain text: no tags, entities or emphasis, at most 200 characters."""
    out = F.regexp_replace(text, "<[^>]+>", " ")
    for entity, plain in ENTITIES:
        out = F.regexp_replace(out, entity, plain)
    out = F.regexp_replace(F.regexp_replace(out, "[*_`]", ""), r"\s+", " ")
    return F.substring(F.trim(out), 1, LONGEST)


def first_tag(html: Column, name: str) -> Column:
    """The inside of the first element of this name; null without one."""
    pattern = rf"(?is)<{name}[^>]*>(.*?)</{name}>"
    return F.when(html.rlike(pattern), F.regexp_extract(html, pattern, 1))


def alias(suffix: Column, text: Column, fallback: Column) -> Column:
    """The name a document gives itself: its first heading after the front matter, or its title or h1 in HTML."""
    body = F.regexp_replace(text, r"^---[\s\S]*?\n---[^\n]*\n", "")
    heading = F.when(body.rlike(_HEADING), F.regexp_replace(F.regexp_extract(body, _HEADING, 1), r"\s*#+\s*$", ""))
    named = F.when(suffix == ".md", heading).otherwise(F.coalesce(first_tag(text, "title"), first_tag(text, "h1")))
    return F.coalesce(F.nullif(inline(named), F.lit("")), fallback)


def key_points(markdown: Column) -> Column:
    """The lines under the heading of key points, without their bullets or numbers; empty without that heading."""
    section = F.split(markdown, r"(?m)^##\s+关键要点\s*$", 2)
    inside = F.get(F.split(F.coalesce(F.get(section, F.lit(1)), F.lit("")), r"(?m)^##\s+", 2), F.lit(0))
    bare = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"^\d+[.、)]\s*", ""), r"^[-*]\s*", "")
    return F.filter(F.transform(F.split(inside, "\n"), bare), lambda x: x != "")


def resolved(path: Column) -> Column:
    """An absolute path without ``.`` and ``..`` segments."""
    step = lambda held, s: F.when(s == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.array_append(held, s))
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def local_images(text: Column, folder: Column, roots: list[str], most: int = MOST_IMAGES) -> Column:
    """Paths of the images of the same machine that a document shows, at most ``most``, only under the roots."""
    pattern = r"""(?i)<img[^>]*\ssrc=["']([^"']+)["']|!\[[^\]]*\]\(([^)\s]+)"""
    part = lambda x: F.trim(F.concat(F.regexp_extract(x, pattern, 1), F.regexp_extract(x, pattern, 2)))
    raw = F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), part), lambda x: (x != "") & ~x.rlike("(?i)^(https?:|data:|//)"))
    plain = lambda x: F.coalesce(F.try_url_decode(F.replace(F.substring_index(x, "#", 1), F.lit("+"), F.lit("%2B"))), x)
    place = lambda x: F.when(F.startswith(x, F.lit("/")), x).otherwise(F.concat(folder, F.lit("/"), x))
    paths = F.transform(raw, lambda x: resolved(place(plain(x))))
    under = lambda p: F.exists(F.array(*(F.lit(r.rstrip("/")) for r in roots)), lambda r: F.startswith(p, F.concat(r, F.lit("/"))))
    image = lambda p: F.lower(F.substring_index(p, ".", -1)).isin(IMAGE_SUFFIXES)
    return F.slice(F.filter(paths, lambda p: under(p) & image(p)), 1, most)


def image_dropped(url: Column, alt: Column, width: Column, height: Column, words: list[str], least: float = 40, ratio: float = 4) -> Column:
    """Whether an image is decoration: by words of its address or text, or by a stated size. Without a sign it stays."""
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(F.lower(url), F.lit(word.lower())) | F.contains(F.lower(F.coalesce(alt, F.lit(""))), F.lit(word.lower()))
    small = F.coalesce(width < least, F.lit(False)) | F.coalesce(height < least, F.lit(False))
    return hit | small | F.coalesce(F.try_divide(width, height) > ratio, F.lit(False))


def quality_score(answer: Column) -> Column:
    """The score of a judged answer, from the object inside it, between 0 and 10 with one decimal; null without one."""
    inside = F.nullif(F.regexp_extract(answer, r"\{[\s\S]*\}", 0), F.lit(""))
    found = F.coalesce(F.get_json_object(inside, "$.quality_score"), F.get_json_object(inside, "$.score"))
    score = found.try_cast("double")
    finite = score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    return F.when(finite, F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(10.0)), 1))


def reason(domain: Column, suffix: Column, size: Column, score: Column) -> Column:
    """Why an entry is shown: its domain, kind, size and score."""
    kilobytes = F.concat(F.greatest(F.lit(1), F.floor(size / 1024 + 0.5)).cast("string"), F.lit("KB"))
    judged = F.when(score != 0, F.concat(F.lit("AI 评分 "), F.format_string("%.1f", score)))
    kind = F.nullif(F.regexp_replace(suffix, r"^([^.]*)\.", "$1"), F.lit(""))
    return F.concat_ws(" · ", F.coalesce(F.nullif(domain, F.lit("")), F.lit("未分类")), kind, F.when(size > 0, kilobytes), judged)


def model_type(name: Column) -> Column:
    return F.when(name.rlike(EMBEDDING_MODEL), "embedding").otherwise("chat")


def sees(name: Column) -> Column:
    return name.rlike(VISION_MODEL)


def failover(message: Column) -> Column:
    return message.rlike(FAILOVER_ERROR)


#: The labels of an entry's metadata, and of the line that says when it was last changed.
SOURCE_LABEL, CONFIDENCE_LABEL, TAGS_LABEL, UPDATED_LABEL = "来源", "置信度", "标签", "最后更新"


def entry_fields(text: Column) -> Column:
    """title, source, confidence, tags, updated and summary of an entry in Markdown.

    The summary is what stands before the second heading once the title, labels, rules, tables and quotes are gone: its prose, or, where it
    has none, its list without the marks; at most 200 characters and an ellipsis."""
    lines = F.regexp_replace(F.coalesce(text, F.lit("")), "\r", "")
    found = lambda pattern: F.trim(F.regexp_extract(lines, pattern, 1))
    value = lambda label: found(rf"(?m)^[ *]*{label}[ *]*:[ *]*([^:\n]*)")
    updated = UPDATED_LABEL + "[：:]"
    aside = rf"(?m)^(?:# .*|\s*\*\*[^\n]*|\s*[|>][^\n]*|---+|\s*{updated}[^\n]*)$"
    parts = F.transform(F.split(F.regexp_replace(lines, aside, ""), r"(?m)^#{2,6} .*$"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    body = F.coalesce(F.get(F.filter(parts, lambda x: x != ""), F.lit(0)), F.lit(""))
    prose = F.regexp_replace(F.regexp_replace(body, r"(?m)^\s*(?:[-*]|\d+\.)\s.*$", ""), r"^\s+|\s+$", "")
    listed = F.regexp_replace(F.regexp_replace(body, r"(?m)^\s*[-*]\s+", ""), r"\*\*", "")
    one = F.regexp_replace(F.when(prose != "", prose).otherwise(listed), "\n", " ")
    return F.struct(
        found(r"(?m)^# +(.*)$").alias("title"),
        value(SOURCE_LABEL).alias("source"),
        value(CONFIDENCE_LABEL).alias("confidence"),
        F.regexp_extract_all(value(TAGS_LABEL), F.lit(r"#([^\s`#]+)"), F.lit(1)).alias("tags"),
        F.regexp_extract(lines, rf"(?m)^\s*{updated}\s*([0-9-]+)", 1).alias("updated"),
        F.concat(F.substring(one, 1, LONGEST), F.when(F.length(one) > LONGEST, "…").otherwise("")).alias("summary"),
    )
