"""Column builders for text, paths, dates and scores. All stay in the JVM.

White space is Unicode's (``(?U)\\s``); lengths and cuts count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = r"(?s)```.*?```"
FRONT_MATTER = r"(?s)^---\n.*?\n---\n"
#: Phrases that carry secrets.
SECRET_PATTERNS = [
    r"(?i)\b(?:sk|api_key|apikey|token|secret|password|pwd|passwd)\b\s*[:=]\s*[^\s\"',;\])]+",
    r"(?i)https?://[^@\n]+@[^\s]+",
    r"(?i)Bearer\s+[^\s\"',;]+",
    r"(?i)\b(?:access_key|accessKey|client_secret|clientSecret)\b\s*[:=]\s*[^\s\"',;]+",
]
SECRET_HINT = r"(?i)sk|api_key|apikey|token|secret|password|pwd|passwd|Bearer|client_?secret|access_?key"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def without_fences(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), FENCE, "")


def effective_chars(text: Column | str) -> Column:
    """Code points left without fenced blocks, front matter, heading lines, Markdown symbols and white space."""
    t = F.regexp_replace(without_fences(text), FRONT_MATTER, "")
    t = F.regexp_replace(t, r"(?m)^#+\s+.+$", "")
    return F.length(F.regexp_replace(F.regexp_replace(t, r"[#*_`~>\-|]", ""), r"(?U)\s+", ""))


def line_count(text: Column | str) -> Column:
    return F.regexp_count(_col(text), F.lit("\n")) + 1


def code_ratio(text: Column | str) -> Column:
    """The share of lines that go with the fenced blocks."""
    lines = line_count(text)
    return (lines - line_count(without_fences(text))) / lines


def collapse(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(text), r"(?U)\s+", " "))


def cut(text: Column, most: int, tail: str = "…") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(tail))).otherwise(text)


def clean_summary(text: Column | str, most: int = 80) -> Column:
    return cut(collapse(text), most)


def redact(text: Column | str, mark: str = "[REDACTED]") -> Column:
    out = _col(text)
    for pattern in SECRET_PATTERNS:
        out = F.regexp_replace(out, pattern, mark.replace("$", r"\$"))
    return out


def looks_secret(text: Column | str) -> Column:
    return _col(text).rlike(SECRET_HINT)


def query_terms(query: Column | str) -> Column:
    """Pairs of neighbouring CJK characters (one alone stays) and words of three or more characters, lower-cased."""
    q = _col(query)
    runs = F.regexp_extract_all(q, F.lit("[一-鿿]+"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substr(r, i, F.lit(2))))))
    words = F.transform(F.regexp_extract_all(q, F.lit("[A-Za-z][A-Za-z0-9_-]{2,}"), F.lit(0)), lambda w: F.lower(w))
    return F.concat(pairs, words)


def overlap_ratio(terms: Column | str, text: Column | str) -> Column:
    """The share of terms that the text contains; null without terms."""
    terms, low = _col(terms), F.lower(_col(text))
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.contains(low, t))) / F.size(terms))


def tokens_by_script(text: Column | str) -> Column:
    """One token for each CJK character, one for each four of the others."""
    cjk = F.regexp_count(_col(text), F.lit("[一-鿿]"))
    return cjk + F.ceil((F.length(_col(text)) - cjk) / 4)


def tokens_by_length(text: Column | str) -> Column:
    return F.ceil(F.length(_col(text)) / 2.2)


def snippet(text: Column | str, needle: Column | str, before: int = 40, most: int = 120) -> Column:
    at = F.instr(F.lower(_col(text)), F.lower(_col(needle)))
    return F.when(at > 0, F.substr(_col(text), F.greatest(at - before, F.lit(1)), F.lit(most))).otherwise(F.substring(_col(text), 1, most))


def parse_time(text: Column | str) -> Column:
    """Two written forms, both UTC; null for anything else."""
    forms = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX"]
    return F.coalesce(*(F.try_to_timestamp(_col(text), F.lit(f)) for f in forms))


def query_of(args: Column | str) -> Column:
    """The query in JSON arguments; also where they are cut off in the middle."""
    a = _col(args)
    whole = F.trim(F.get_json_object(a, "$.query"))
    torn = F.regexp_extract(a, r'"query"\s*:\s*"([^"]{1,200})', 1)
    return F.coalesce(F.when(whole != "", whole), F.when(torn != "", torn))


def like_escape(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"([\\%_])", r"\\$1")


def iso_week(day: Column | str) -> Column:
    d = _col(day)
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def epoch_day(day: Column | str) -> Column:
    return F.datediff(_col(day), F.lit("1970-01-01").cast("date"))


def base_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r".(\.[^.]*)$", 1))


def first_segment(path: Column | str) -> Column:
    return F.split_part(F.ltrim(_col(path), F.lit("/")), F.lit("/"), F.lit(1))


def slug(text: Column | str, most: int = 60) -> Column:
    t = F.regexp_replace(F.lower(_col(text)), "[^a-z0-9一-鿿]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(t, "^-+|-+$", ""), 1, most), "-+$", "")


def under(path: Column, root: Column) -> Column:
    """``path`` is ``root`` or lies under it."""
    r = F.rtrim(root, F.lit("/"))
    return (path == r) | path.startswith(F.concat(r, F.lit("/")))


def whitelisted(path: Column | str, entries: list[str]) -> Column:
    """Equal to, under, or above an entry."""
    p, hit = F.rtrim(_col(path), F.lit("/")), F.lit(False)
    for entry in (e.strip().rstrip("/") for e in entries):
        if entry:
            hit = hit | under(p, F.lit(entry)) | F.lit(entry).startswith(F.concat(p, F.lit("/")))
    return hit


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(_col(a).cast("array<double>"), _col(b).cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 for vectors of other lengths, empty or zero ones."""
    sound = (F.size(_col(a)) == F.size(_col(b))) & (F.size(_col(a)) > 0) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(sound, dot(a, b) / (norm(a) * norm(b))).otherwise(0.0)


def rrf(rank: Column | str, k: int = 60) -> Column:
    return 1.0 / (_col(rank) + k)


def prior(quality: Column | str, rule: Column | str) -> Column:
    """Up to 1: three parts quality, one part rule score, both of 10."""
    return (F.coalesce(_col(quality), F.lit(0)) * 3 + F.coalesce(_col(rule), F.lit(0))) / 40


def call_status(error: Column | str) -> Column:
    """success, timeout, rate_limited or failed by the words of an error."""
    e = _col(error)
    return F.when(e.isNull(), "success").when(e.rlike("(?i)timeout|timed out|abort"), "timeout").when(e.rlike("(?i)429|rate.?limit|too many"), "rate_limited").otherwise("failed")
