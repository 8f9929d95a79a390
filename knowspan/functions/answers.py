"""JSON in the answers of language models, read in columns: strict, located, repaired, and checked field by field.

Values are variants, so a field's own type can be asked. An object that names a key twice can't be read. Cuts count code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Enumerations, defaults and bounds of the stored fields.
IMPORTANCE = ("critical", "useful", "noise")
ACTIONS = ("ignore", "keep", "act_now", "schedule")
QUIZ_TYPES = ("choice", "judge", "short")
MOST_TAGS, HOOK_TEXT, HOOK_VERDICT, MOST_QUESTIONS, PORTRAIT = 4, 30, 20, 8, 4000
PROFICIENCY = ("expert", "proficient", "learning")
STATUSES = ("active", "user_added", "vetoed")
EVIDENCE = r"^[a-z_]+:[0-9]+$"
RELATION = "相关"
FENCE = r"(?s)^```(?:json)?\s*(.*?)\s*```$"
STRING_FIELD = r'(?s)"%s"\s*:\s*"((?:[^"\\]|\\.)*)"'
CUT_ENVELOPE = r'(?s)^\{\s*"answer"\s*:\s*"(.*)$'
ENVELOPE_END = r'\s*"?\s*\}[\s,]*$'

_BLANK = r"[\s\p{Z}\x{FEFF}]"
CLAIM = "struct<claim:string,status:string,evidence:array<string>,confidence:double>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_BLANK}+|{_BLANK}+$", "")


def filled(text: Column) -> Column:
    """Whether a text is there and not blank."""
    return F.coalesce(F.length(trimmed(text)) > 0, F.lit(False))


def strict(text: Column) -> Column:
    """The variant of a text that is one JSON value and nothing else, else null.

    The parser stops after the first value. So the text is read as an array's only and as its first element of two:
    whatever closes the array from inside gives both the same length."""

    def read(tail: str) -> Column:
        return F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(tail))), "$", "array<variant>")

    return let(read("]"), lambda one: F.when((F.size(one) == 1) & (F.size(read(",0]")) == 2), F.get(one, F.lit(0))))


def kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN or VOID."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def part(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def string(value: Column, path: str = "$") -> Column:
    """The field if it is a string, else null."""
    return F.when(kind(part(value, path)) == "STRING", F.try_variant_get(value, path, "string"))


def shown(value: Column, path: str) -> Column:
    """Any field as trimmed text; empty if it isn't there, or is false or 0."""
    given = F.try_variant_get(value, path, "string")
    none = given.isNull() | ((kind(part(value, path)) != "STRING") & given.isin("false", "0"))
    return F.when(none, "").otherwise(trimmed(given))


def items(value: Column, path: str) -> Column:
    """The elements of a field that is an array, else null."""
    return F.try_variant_get(value, path, "array<variant>")


def number(value: Column, path: str) -> Column:
    """A field that is a number or states one; null counts as 0, one that isn't there is null."""
    return F.when(kind(part(value, path)) == "VOID", 0.0).otherwise(F.try_variant_get(value, path, "double"))


def strings(value: Column, path: str) -> Column:
    """The strings of an array that aren't blank; empty if there is no array."""
    found = F.transform(items(value, path), lambda x: string(x))
    return F.coalesce(F.filter(found, filled), F.array().cast("array<string>"))


def unfenced(text: Column) -> Column:
    """A text without the code fence around the whole of it."""
    return let(trimmed(text), lambda t: F.coalesce(F.nullif(F.regexp_extract(t, FENCE, 1), F.lit("")), t))


def bare_quotes(text: Column) -> Column:
    """The text with quotes escaped that stand within a string: those that neither comma, colon, closing bracket nor the end follow.

    A fold over quotes, escapes and the runs between them keeps whether a string is open and which quotes are bare."""
    tokens = F.regexp_extract_all(text, F.lit(r"(?s)\\.?|\"|[^\"\\]+"), F.lit(0))

    def repair(pieces: Column) -> Column:
        def ends(i: Column) -> Column:
            after = F.get(pieces, i + 1)
            rest = F.ltrim(F.regexp_replace(after, r"^\s+", ""))
            last = after.isNull() | ((rest == "") & F.get(pieces, i + 2).isNull())
            return last | rest.rlike(r"^[,}\]:]")

        def step(state: Column, i: Column) -> Column:
            quote = F.get(pieces, i) == "\""
            inside, bare = state["inside"], state["bare"]
            shut = inside & quote & ends(i)
            return F.struct(
                F.when(quote, ~shut).otherwise(inside).alias("inside"),
                F.when(inside & quote & ~shut, F.concat(bare, F.array(i))).otherwise(bare).alias("bare"),
            )

        start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<int>").alias("bare"))
        places = F.when(F.size(pieces) > 0, F.sequence(F.lit(0), F.size(pieces) - 1)).otherwise(F.array().cast("array<int>"))
        bare = F.aggregate(places, start, step, lambda s: s["bare"])
        return let(bare, lambda b: F.array_join(F.transform(pieces, lambda t, i: F.when(F.array_contains(b, i), F.lit('\\"')).otherwise(t)), ""))

    return let(tokens, repair)


def located(text: Column) -> Column:
    """The JSON value of an answer: the whole of it without fences, what begins at its first bracket, or either with bare quotes escaped.

    A tail that is cut off isn't made up: such an answer is null."""

    def read(t: Column) -> Column:
        return F.coalesce(strict(t), strict(F.nullif(F.regexp_extract(t, r"(?s)[{\[].*", 0), F.lit(""))))

    return let(trimmed(F.regexp_replace(text, "```json|```", "")), lambda t: F.coalesce(read(t), read(bare_quotes(t))))


def entry(text: Column) -> Column:
    """The fields of a distilled entry: title, summary, points, entities, relations, domain, tags, importance, hook.

    What stands between the first and the last brace is read; else what follows the first brace, closed as a string and an
    object; else its title, summary and domain, if one of the first two is whole. Without any of it all fields are empty.
    Values outside an enumeration become ``useful`` and ``keep``; tags end after 4; the hook's texts are cut."""
    empty = F.lit("{}")

    def scanned(tail: Column) -> Column:
        def field(name: str) -> Column:
            # a field that comes several times has its last value
            found = F.regexp_extract_all(tail, F.lit(STRING_FIELD % name), F.lit(1))
            return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))

        fields = F.struct(*(field(n).alias(n) for n in ("title", "summary", "domain")))
        return let(fields, lambda f: F.when((f["title"] != "") | (f["summary"] != ""), F.try_parse_json(F.to_json(f))))

    closed = strict(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))
    tail = F.nullif(F.regexp_extract(text, r"(?s)\{.*", 0), F.lit(""))
    value = F.coalesce(closed, strict(F.concat(tail, F.lit('"}'))), scanned(tail), F.try_parse_json(empty))

    def read(v: Column) -> Column:
        entities = F.filter(items(v, "$.entities"), lambda e: string(e, "$.n").isNotNull())
        relations = F.filter(items(v, "$.relations"), lambda r: string(r, "$.a").isNotNull() & string(r, "$.b").isNotNull())
        stated = string(v, "$.hook.action")
        hook = F.struct(
            F.substring(shown(v, "$.hook.text"), 1, HOOK_TEXT).alias("text"),
            F.substring(shown(v, "$.hook.verdict"), 1, HOOK_VERDICT).alias("verdict"),
            F.when(stated.isin(*ACTIONS), stated).otherwise("keep").alias("action"),
        )
        weight = string(v, "$.importance")
        return F.struct(
            shown(v, "$.title").alias("title"),
            shown(v, "$.summary").alias("summary"),
            strings(v, "$.points").alias("points"),
            F.coalesce(
                F.transform(entities, lambda e: F.struct(string(e, "$.n").alias("n"), F.coalesce(string(e, "$.t"), F.lit("")).alias("t"))),
                F.array().cast("array<struct<n:string,t:string>>"),
            ).alias("entities"),
            F.coalesce(
                F.transform(
                    relations,
                    lambda r: F.struct(
                        string(r, "$.a").alias("a"),
                        F.coalesce(string(r, "$.v"), F.lit(RELATION)).alias("v"),
                        string(r, "$.b").alias("b"),
                        string(r, "$.note").alias("note"),
                    ),
                ),
                F.array().cast("array<struct<a:string,v:string,b:string,note:string>>"),
            ).alias("relations"),
            F.coalesce(trimmed(string(v, "$.domain")), F.lit("")).alias("domain"),
            F.slice(F.transform(strings(v, "$.tags"), trimmed), 1, MOST_TAGS).alias("tags"),
            F.when(weight.isin(*IMPORTANCE), weight).otherwise("useful").alias("importance"),
            F.when(kind(part(v, "$.hook")).isin("OBJECT", "ARRAY"), hook).alias("hook"),
        )

    return let(value, read)


def answer(text: Column) -> Column:
    """The answer out of its envelope: the field ``answer``, what a cut envelope holds, or the text itself.

    An object without that field gives its first string by name of the field, as variants keep fields by name."""

    def read(body: Column) -> Column:
        def of(v: Column) -> Column:
            fields = F.try_variant_get(v, "$", "map<string,variant>")
            texts = F.filter(F.transform(F.array_sort(F.map_keys(fields)), lambda k: string(F.element_at(fields, k))), filled)
            return F.coalesce(F.when(filled(string(v, "$.answer")), string(v, "$.answer")), F.get(texts, F.lit(0)))

        rest = F.when(body.rlike(CUT_ENVELOPE), F.regexp_replace(F.regexp_extract(body, CUT_ENVELOPE, 1), ENVELOPE_END, ""))
        return F.coalesce(let(strict(body), of), rest, trimmed(text))

    return let(unfenced(text), read)


def quiz(text: Column) -> Column:
    """The questions of a quiz that are whole, at most 8; null if none is.

    A question has a text, an answer and a known type; a choice has at least two options."""

    def question(q: Column) -> Column:
        choice = string(q, "$.type") == "choice"
        options = strings(q, "$.options")
        whole = filled(string(q, "$.question")) & filled(string(q, "$.answer")) & string(q, "$.type").isin(*QUIZ_TYPES) & (~choice | (F.size(options) >= 2))
        sources = F.filter(F.transform(items(q, "$.sources"), lambda x: number(x, "$")), lambda n: n > 0)
        fields = F.struct(
            string(q, "$.type").alias("type"),
            trimmed(string(q, "$.question")).alias("question"),
            F.when(choice, options).alias("options"),
            trimmed(string(q, "$.answer")).alias("answer"),
            F.coalesce(string(q, "$.explanation"), F.lit("")).alias("explanation"),
            F.coalesce(F.transform(sources, lambda n: n.cast("bigint")), F.array().cast("array<bigint>")).alias("sources"),
        )
        return F.when(whole, fields)

    found = F.filter(F.transform(items(strict(unfenced(text)), "$.questions"), question), lambda q: q.isNotNull())
    return let(found, lambda f: F.when(F.size(f) > 0, F.slice(f, 1, MOST_QUESTIONS)))


def _claim(raw: Column, evidence: Column, status: Column) -> Column:
    """A claim, or null if a part of it isn't valid."""
    sure = number(raw, "$.confidence")
    fine = filled(string(raw, "$.claim")) & evidence.isNotNull() & status.isNotNull() & sure.between(0, 1)
    fields = F.struct(string(raw, "$.claim").alias("claim"), status.alias("status"), evidence.alias("evidence"), sure.alias("confidence"))
    return F.when(fine, fields.cast(CLAIM))


def _all(values: Column) -> Column:
    """An array without nulls in it, else null."""
    return F.when(F.forall(values, lambda x: x.isNotNull()), values)


def profile(content: Column) -> Column:
    """role_pattern, portrait and claims of a stored profile; null if any part of it isn't valid, so nothing is half read."""

    def claim(raw: Column) -> Column:
        pointers = _all(F.transform(items(raw, "$.evidence"), lambda e: F.when(string(e).rlike(EVIDENCE), string(e))))
        status = string(raw, "$.status")
        return _claim(raw, pointers, F.when(status.isin(*STATUSES), status))

    def read(v: Column) -> Column:
        claims = _all(F.transform(items(v, "$.claims"), claim))
        fields = F.struct(
            string(v, "$.role_pattern").alias("role_pattern"),
            F.nullif(string(v, "$.portrait"), F.lit("")).alias("portrait"),
            claims.alias("claims"),
        )
        return let(fields, lambda f: F.when((string(v, "$.schema_version") == "1") & f["role_pattern"].isNotNull() & f["claims"].isNotNull(), f))

    return let(strict(content), read)


def fresh_profile(text: Column, evidence: Column) -> Column:
    """role_pattern, portrait, claims and domains (domain, claims) of a model's profile; ``evidence`` maps its references to pointers.

    An unknown reference, an empty claim or a confidence outside 0 to 1 rejects the whole. A stated proficiency becomes
    the domain's first claim, with the evidence of the next."""

    def claim(raw: Column) -> Column:
        pointers = _all(F.transform(items(raw, "$.evidence_refs"), lambda e: F.try_element_at(evidence, F.try_variant_get(e, "$", "string"))))
        done = _claim(raw, F.when(F.size(pointers) > 0, pointers), F.lit("active"))
        return F.when(done.isNotNull(), F.struct(trimmed(done["claim"]).alias("claim"), *(done[n].alias(n) for n in ("status", "evidence", "confidence"))).cast(CLAIM))

    def domain(raw: Column) -> Column:
        level = string(raw, "$.proficiency")
        stated = part(raw, "$.proficiency").isNotNull()
        claims = _all(F.transform(items(raw, "$.claims"), claim))

        def led(c: Column) -> Column:
            first = F.get(c, F.lit(0))
            head = F.struct(
                F.concat(F.lit("proficiency: "), level).alias("claim"),
                F.lit("active").alias("status"),
                F.coalesce(first["evidence"], F.array().cast("array<string>")).alias("evidence"),
                F.coalesce(F.nullif(first["confidence"], F.lit(0.0)), F.lit(0.5)).alias("confidence"),
            ).cast(CLAIM)
            return F.when(stated, F.concat(F.array(head), c)).otherwise(c)

        fine = string(raw, "$.domain").isNotNull() & claims.isNotNull() & (~stated | F.coalesce(level.isin(*PROFICIENCY), F.lit(False)))
        return F.when(fine, F.struct(string(raw, "$.domain").alias("domain"), let(claims, led).alias("claims")))

    def read(v: Column) -> Column:
        none = F.array().cast(f"array<struct<domain:string,claims:array<{CLAIM}>>>")
        domains = F.when(part(v, "$.domains").isNull(), none).otherwise(_all(F.transform(items(v, "$.domains"), domain)))
        portrait = F.nullif(trimmed(string(v, "$.portrait")), F.lit(""))
        fields = F.struct(
            string(v, "$.role_pattern").alias("role_pattern"),
            F.substring(portrait, 1, PORTRAIT).alias("portrait"),
            _all(F.transform(items(v, "$.claims"), claim)).alias("claims"),
            domains.alias("domains"),
        )
        return let(fields, lambda f: F.when(f["role_pattern"].isNotNull() & f["claims"].isNotNull() & f["domains"].isNotNull(), f))

    return let(strict(unfenced(text)), read)
