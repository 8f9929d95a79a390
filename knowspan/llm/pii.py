"""Format-preserving Feistel pseudonyms for personal data (operator 6), DataFrame functions only.

Numbers and dates that pass their validation (card numbers by Luhn, IBANs by the remainder of 97,
IPv4 octets, North American phone numbers, SSN ranges, calendar dates), the local parts of e-mail
addresses and the values of secrets are replaced by a keyed permutation of the values of the same
format. The permutation is a Feistel network over numeral strings of a radix, halves added modulo
the radix, with SHA-256 of the key, the kind, the round and the other half; where a format has fewer
values than numeral strings, it walks on until it meets a valid one. So pseudonyms are of the same
format and valid in it, equal values get equal pseudonyms in every document, and different values
different ones. Punctuation, spacing and the case of letters stay.

Numbers that stand next to each other (a card and its expiry date or security code) make one run of
words; every sequence of words in it is tried from the left, the usual length of its kind first, and
what is no card or IBAN goes back.

Nulls: a null text stays null, with no matches. Texts are read whole. Rows are independent, so nulls
elsewhere, repeated rows and empty tables need no rule. Extra columns pass through; those named pii_kinds or n_pii are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knowspan.llm._scratch import documents, others

#: The key of the registered query alone. It is public: whoever has the key can undo the pseudonyms.
DRILL_KEY = "knowspan"
ROUNDS = 10
#: Numeral strings are permuted in pieces of so many places, halves of which fit a bigint.
PLACES = 20
#: Long values are filled in slices of so many characters.
SLICE = 512
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[._%+-]*+[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+",
    "secret": r"(?<![A-Za-z0-9])(?:(?i:password|passwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_/+-]{8,}|AKIA[0-9A-Z]{16})(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "date": r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-])",
    "ssn": r"(?<![\d-])(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])",
    "phone": r"(?<![\w+(-])(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}(?![\d-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
}
_PLAIN = "|".join(p for kind, p in PATTERNS.items() if kind not in ("iban", "card"))
#: A word of digits that no letter or open hyphen follows, and further ones up to where a match of another kind begins. Possessive, so that long rows of numbers need no stack.
_DIGITS = r"\d++(?![A-Za-z_]|-(?!\d++(?![A-Za-z_])))"
_MORE = rf"(?:[ -](?!{_PLAIN}){_DIGITS})*+"
_RUNS = [
    rf"(?<![A-Za-z0-9])[A-Z]{{2}}\d{{2}}(?: ?(?!{_PLAIN})[A-Z0-9]{{4}}){{2,7}}(?: ?(?!{_PLAIN})[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]){_MORE}",
    rf"(?<![\w.-])(?=\d(?:[ -]?\d){{12}}){_DIGITS}{_MORE}",
]
ANY = "|".join([_PLAIN, *_RUNS])
#: What every match holds; texts without it aren't searched.
HINT = r"[0-9@=:]|AKIA"
#: The registered lengths of IBANs; of several valid readings they come first.
LENGTHS = {
    x[:2]: int(x[2:])
    for x in """AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20
LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20""".split()
}
_FIRST, _DAYS, _HALVES = "1700-01-01", 146_097, (383, 382)  # 400 years


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, not at each mention in a lambda."""
    return F.get(F.transform(F.array(value), use), 0)


def _number(text: Column, radix: int) -> Column:
    return F.coalesce(F.conv(text, radix, 10).cast("bigint"), F.lit(0).cast("bigint"))


def _mask(key: str, tweak: Column, turn: Column, half: Column) -> Column:
    """60 keyed bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, turn.cast("string"), half.cast("string")), 256), 1, 15), 16, 10).cast("bigint")


def _rounds(a: Column, b: Column, even: Column, odd: Column, key: str, tweak: Column) -> Column:
    """(a, b) after all rounds; a and b are below ``even`` and ``odd``."""
    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))

    def step(s: Column, turn: Column) -> Column:
        return F.struct(s["b"].alias("a"), F.pmod(s["a"] + F.pmod(_mask(key, tweak, turn, s["b"]), F.when(turn % 2 == 0, even).otherwise(odd)), F.when(turn % 2 == 0, even).otherwise(odd)).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def feistel(text: Column, radix: int, key: str, tweak: Column) -> Column:
    """A permutation of the numeral strings of one length, in pieces of ``PLACES``."""

    def piece(text: Column, i: Column) -> Column:
        own = F.substr(text, i * PLACES + 1, F.lit(PLACES))
        left = F.floor(F.length(own) / 2).cast("int")
        right = F.length(own) - left
        size = lambda n: F.pow(F.lit(float(radix)), n).cast("bigint")
        state = _rounds(_number(F.substr(own, F.lit(1), left), radix), _number(F.substr(own, left + 1, right), radix), size(left), size(right), key, F.concat(tweak, F.lit("|"), F.length(own).cast("string"), F.lit("|"), i.cast("string")))
        pad = lambda v, n: F.lower(F.lpad(F.conv(v.cast("string"), 10, radix), n, "0"))
        whole = F.transform(F.array(state), lambda s: F.concat(F.when(left > 0, pad(s["a"], left)).otherwise(""), pad(s["b"], right)))
        return F.get(whole, F.lit(0))

    def whole(text: Column) -> Column:
        count = F.floor((F.length(text) - 1) / PLACES).cast("int")
        return F.when(F.length(text) == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(0))), lambda i: piece(text, i)), ""))

    return _once(text, whole)


def walk(value: Column, step: Callable[[Column], Column], valid: Callable[[Column], Column], most: int = 64) -> Column:
    """The first valid value after ``value`` on its cycle."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), step(value), lambda v, _: F.when(valid(v), v).otherwise(step(v)))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum, the last digit counted once."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def mod97(text: Column) -> Column:
    """The remainder of 97, letters read as 10 to 35."""

    def step(r: Column, i: Column) -> Column:
        c = F.substr(text, i, F.lit(1))
        return F.when(c.rlike("[A-Z]"), r * 100 + F.ascii(c) - 55).otherwise(r * 10 + c.cast("int")) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), step)


def refill(match: Column, body: Column, kind: str) -> Column:
    """``match`` with its characters of ``kind`` (a class) replaced by those of ``body`` in turn, in their case; in slices, as the work of one grows with the square of its length."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def fill(match: Column, body: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            c = F.substr(match, i, F.lit(1))
            new = F.substr(body, s["k"], F.lit(1))
            put = F.when(c.rlike("[A-Z]"), F.upper(new)).otherwise(new)
            own = c.rlike(kind)
            return F.struct(F.concat(s["out"], F.when(own, put).otherwise(c)).alias("out"), (s["k"] + F.when(own, 1).otherwise(0)).alias("k"))

        return F.when(match == "", "").otherwise(F.aggregate(F.sequence(F.lit(1), F.length(match)), start, step, lambda s: s["out"]))

    def piece(match: Column, body: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substr(match, F.lit(1), i * SLICE), f"(?!{kind}).", ""))
        return _once(F.substr(match, i * SLICE + 1, F.lit(SLICE)), lambda m: _once(F.substr(body, before + 1, F.lit(SLICE)), lambda b: fill(m, b)))

    slices = lambda m, b: F.transform(F.sequence(F.lit(0), F.floor(F.length(m) / SLICE).cast("int")), lambda i: piece(m, b, i))
    return _once(match, lambda m: _once(body, lambda b: F.array_join(slices(m, b), "")))


def _full(m: Column, kind: str) -> Column:
    return m.rlike(f"^(?:{PATTERNS[kind]})$")


def number_kind(m: Column) -> Column:
    """iban, card or null."""
    code = F.regexp_replace(m, "[ -]", "")
    iban = mod97(F.concat(F.substr(code, F.lit(5), F.lit(40)), F.substr(code, F.lit(1), F.lit(4))))
    return F.when(_full(m, "iban"), F.when(iban == 1, "iban")).when(_full(m, "card") & (_once(code, luhn_sum) % 10 == 0), "card")


def kind_of(m: Column) -> Column:
    """The kind of a match; null if it isn't valid."""
    return (
        F.when(_full(m, "email"), "email")
        .when(_full(m, "secret"), "secret")
        .when(_full(m, "ip"), "ip")
        .when(_full(m, "date"), F.when(_day(m).between(0, _DAYS - 1), "date"))
        .when(_full(m, "ssn"), "ssn")
        .when(_full(m, "phone"), "phone")
        .otherwise(number_kind(m))
    )


def _format(m: Column) -> Column:
    """Which strings a date is among. With slashes there are three sets that have no string in common: those that
    are dates either way, read as day and month, and those that are dates one way only."""
    low = lambda at: F.substr(m, F.lit(at), F.lit(2)) <= "12"
    slashes = F.when(low(1) & low(4), "either").when(low(4), "dd/MM/yyyy").otherwise("MM/dd/yyyy")
    return F.when(m.contains("-"), "yyyy-MM-dd").when(m.contains("."), "dd.MM.yyyy").otherwise(slashes)


def _day(m: Column) -> Column:
    """Days since ``_FIRST``; null if the date isn't in the calendar."""
    formats = ["yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "MM/dd/yyyy"]
    return F.datediff(F.coalesce(*(F.try_to_timestamp(m, F.lit(f)) for f in formats)).cast("date"), F.to_date(F.lit(_FIRST)))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of a match; the match itself if it isn't valid."""
    digits = F.regexp_replace(m, r"\D", "")

    def numerals(part: Column, kind: str) -> Column:
        body = feistel(F.lower(F.regexp_replace(part, "[^A-Za-z0-9]", "")), 36, key, F.lit(kind))
        return refill(part, F.when(part.rlike("[a-z]"), body).otherwise(F.upper(body)), "[A-Za-z0-9]")

    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    name = F.when(m.startswith("AKIA"), "AKIA").otherwise(F.regexp_extract(m, r"^\w+(?:-key)?\s*[=:]\s*[\"']?", 0))
    value = F.substr(m, F.length(name) + 1, F.length(m))

    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("bigint"))
    half = F.lit(65_536)
    pair = F.array(_rounds(F.get(octets, 0) * 256 + F.get(octets, 1), F.get(octets, 2) * 256 + F.get(octets, 3), half, half, key, F.lit("ip")))
    ip = F.get(F.transform(pair, lambda s: F.concat_ws(".", *(F.floor(x).cast("string") for x in (s["a"] / 256, s["a"] % 256, s["b"] / 256, s["b"] % 256)))), 0)

    own = _format(m)

    def day_step(d: Column) -> Column:
        one = F.array(_rounds(F.floor(d / _HALVES[1]), F.pmod(d, F.lit(_HALVES[1])), F.lit(_HALVES[0]), F.lit(_HALVES[1]), key, F.concat(F.lit("date"), F.regexp_extract(own, "either|/.*", 0))))
        return F.get(F.transform(one, lambda s: (s["a"] * _HALVES[1] + s["b"]).cast("bigint")), 0)

    def in_set(d: Column) -> Column:
        early = F.dayofmonth(F.date_add(F.to_date(F.lit(_FIRST)), d.cast("int"))) <= 12
        return (d < _DAYS) & F.when(own == "either", early).when(own.contains("/"), ~early).otherwise(True)

    day = walk(_day(m).cast("bigint"), day_step, in_set)
    dates = F.get(F.transform(F.array(day), lambda d: F.date_add(F.to_date(F.lit(_FIRST)), d.cast("int"))), 0)
    date = F.get(F.transform(F.array(dates), lambda d: F.when(own == "yyyy-MM-dd", F.date_format(d, "yyyy-MM-dd")).when(own == "dd.MM.yyyy", F.date_format(d, "dd.MM.yyyy")).when(own == "MM/dd/yyyy", F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "dd/MM/yyyy"))), 0)

    ten = F.substr(digits, F.length(digits) - 9, F.lit(10))
    phone = walk(ten, lambda d: feistel(d, 10, key, F.lit("phone")), lambda d: d.rlike(r"^[2-9]\d\d[2-9]"))
    lead = F.substr(digits, F.lit(1), F.length(digits) - 10)
    ssn = walk(digits, lambda d: feistel(d, 10, key, F.lit("ssn")), lambda d: d.rlike(r"^(?!000|666|9)\d{3}(?!00)\d\d(?!0000)"))

    payload = feistel(F.substr(digits, F.lit(1), F.length(digits) - 1), 10, key, F.lit("card"))
    card = F.get(F.transform(F.array(payload), lambda p: F.concat(p, F.pmod(-luhn_sum(F.concat(p, F.lit("0"))), F.lit(10)).cast("string"))), 0)

    country, bban = F.substr(m, F.lit(1), F.lit(2)), F.substr(F.regexp_replace(m, " ", ""), F.lit(5), F.lit(40))
    tweak, alphabet, places = F.concat(F.lit("iban"), country), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdefghijklmnop"
    figures = feistel(F.regexp_replace(bban, "[A-Z]", ""), 10, key, tweak)
    letters = F.translate(feistel(F.translate(F.regexp_replace(bban, r"\d", ""), alphabet, places), 26, key, tweak), places, alphabet)
    check = lambda b: F.lpad((98 - _once(F.concat(b, country, F.lit("00")), mod97)).cast("string"), 2, "0")
    iban = _once(refill(refill(bban, figures, r"\d"), letters, "[A-Z]"), lambda b: F.concat(country, check(b), refill(F.substr(m, F.lit(5), F.length(m)), b, "[A-Z0-9]")))

    by_kind = lambda kind: (
        F.when(kind == "email", F.concat(numerals(local, "email"), F.lit("@"), domain))
        .when(kind == "secret", F.concat(name, numerals(value, "secret")))
        .when(kind == "ip", ip)
        .when(kind == "date", date)
        .when(kind == "ssn", refill(m, ssn, r"\d"))
        .when(kind == "phone", refill(m, F.concat(lead, phone), r"\d"))
        .when(kind == "iban", iban)
        .when(kind == "card", refill(m, card, r"\d"))
        .otherwise(m)
    )
    return F.get(F.transform(F.array(kind_of(m)), by_kind), 0)


def parts(m: Column) -> Column:
    """A match as parts (text, kind); only those with a kind are valid, and all texts make up the match."""
    words = F.regexp_extract_all(m, F.lit("[A-Za-z0-9]+[ -]?"), F.lit(0))
    between = lambda w, a, z: F.array_join(F.slice(w, a, z - a + 1), "")
    empty = "array<struct<rank:int,size:int,first:int,last:int,kind:string>>"

    def best(w: Column, x: Column) -> Column:
        """The preferred valid reading that begins with word ``x``, in an array; none where there is none."""

        def reading(y: Column) -> Column:
            def judged(t: Column) -> Column:
                kind, size = number_kind(t), F.length(F.regexp_replace(t, "[ -]", ""))
                usual = F.when(t.rlike("^[A-Z]"), F.coalesce(F.element_at(F.create_map(*(F.lit(v) for pair in LENGTHS.items() for v in pair)), F.substr(t, F.lit(1), F.lit(2))), F.lit(0))).when(t.rlike("^3[47]"), 15).otherwise(16)
                return F.struct(F.when(size == usual, 0).otherwise(1).alias("rank"), (-size).alias("size"), x.cast("int").alias("first"), y.cast("int").alias("last"), kind.alias("kind"))

            return _once(F.regexp_replace(between(w, x, y), "[ -]$", ""), judged)

        valid = F.filter(F.transform(F.sequence(x, F.least(F.size(w), x + 18)), reading), lambda r: r["kind"].isin("iban", "card"))
        return F.slice(F.array_sort(valid), 1, 1).cast(empty)

    def found(w: Column) -> Column:
        start = F.struct(F.array().cast(empty).alias("hits"), F.lit(1).alias("next"))

        def step(s: Column, x: Column) -> Column:
            new = _once(best(w, x), lambda b: F.struct(F.concat(s["hits"], b).alias("hits"), (F.coalesce(F.get(b, 0)["last"], x) + 1).alias("next")))
            return F.when(x < s["next"], s).otherwise(new)

        return F.aggregate(F.sequence(F.lit(1), F.size(w)), start, step, lambda s: s["hits"])

    def cut(w: Column, hits: Column) -> Column:
        part = lambda text, kind: F.struct(text.alias("text"), kind.cast("string").alias("kind"))

        def around(h: Column, i: Column) -> Column:
            begin = F.when(i > 0, F.get(hits, i - 1)["last"]).otherwise(0) + 1
            own = between(w, h["first"], h["last"])
            return F.array(part(between(w, begin, h["first"] - 1), F.lit(None)), part(F.regexp_replace(own, "[ -]$", ""), h["kind"]), part(F.regexp_extract(own, "[ -]?$", 0), F.lit(None)))

        rest = between(w, F.coalesce(F.get(hits, F.size(hits) - 1)["last"], F.lit(0)) + 1, F.size(w))
        return F.concat(F.flatten(F.transform(hits, around)), F.array(part(rest, F.lit(None))))

    run = _once(words, lambda w: _once(found(w), lambda h: cut(w, h)))
    several = m.rlike("^[A-Z0-9]++(?:[ -][A-Z0-9]++)++$") & ~m.rlike(f"^(?:{_PLAIN})$")
    return F.when(several, run).otherwise(F.array(F.struct(m.alias("text"), kind_of(m).alias("kind"))))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """The columns of ``docs`` with text rewritten, and pii_kinds (of each valid match in order) and n_pii.

    ``key`` is a secret of the caller: the same key gives the same pseudonyms, and without it they can't be undone."""
    if not key:
        raise ValueError("a key is needed")
    names = others(docs, ["pii_kinds", "n_pii"])
    text = F.col("text").cast("string")
    seen = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), text.alias("_text"))
    seen = seen.withColumn("_match", F.when(F.col("_text").rlike(HINT), F.regexp_extract_all("_text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    seen = seen.withColumn("_parts", F.transform("_match", parts))
    kinds = F.filter(F.transform(F.flatten("_parts"), lambda p: p["kind"]), lambda k: k.isNotNull())
    put = lambda p: F.when(p["kind"].isNotNull(), pseudonym(p["text"], key)).otherwise(p["text"])
    seen = seen.withColumn("_new", F.transform("_parts", lambda ps: F.array_join(F.transform(ps, put), ""))).withColumn("pii_kinds", F.coalesce(kinds, F.array().cast("array<string>")))
    pieces = F.split("_text", ANY, -1)
    filled = F.array_join(F.flatten(F.zip_with(pieces, "_new", lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    done = seen.withColumn("_done", F.when(F.size("_match") > 0, filled).otherwise(F.col("_text")))
    return done.select(*(F.col("_done").alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in names), "pii_kinds", F.size("pii_kinds").alias("n_pii"))


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), DRILL_KEY)


QUERIES = {"op6_pii_pseudonyms": op6_pii_pseudonyms}
SQL: dict[str, str] = {}  # a keyed network over strings isn't SQL that DuckDB runs; tests hold it against Python's
