"""Scalar text functions: every one maps Columns to a Column and stays in the JVM."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions import fixed_values as V

PREFIX_BLOCK = 256


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    A plain projection alias may be inlined into a lambda and run per element;
    a lambda variable never is.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def valid_json(text: Column) -> Column:
    """True when a text is exactly one JSON value.

    The JSON functions stop at the end of the first value; wrapping the text in an array and
    in an object leaves no room for anything after it.
    """
    in_array = F.concat(F.lit("["), text, F.lit("]"))
    in_object = F.concat(F.lit('{"a":'), text, F.lit("}"))
    whole = F.try_parse_json(in_array).isNotNull() & F.try_parse_json(in_object).isNotNull()
    return F.coalesce(whole & (F.json_array_length(in_array) == 1), F.lit(False))


def empty_array(ddl: str) -> Column:
    return F.from_json(F.lit("[]"), f"array<{ddl}>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)


def prefix_sums(steps: Column) -> Column:
    """Inclusive running sums of an array of numbers, in O(n * sqrt-ish) by blocks."""

    def build(s: Column) -> Column:
        last = F.size(s) - 1
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor(last / PREFIX_BLOCK).cast("int")),
            lambda b: _total(F.slice(s, F.lit(1), b * PREFIX_BLOCK)),
        )
        return F.when(F.size(s) == 0, empty_array("bigint")).otherwise(
            let(
                blocks,
                lambda before: F.transform(
                    s,
                    lambda _, i: F.get(before, F.floor(i / PREFIX_BLOCK).cast("int"))
                    + _total(F.slice(s, i - i % PREFIX_BLOCK + 1, i % PREFIX_BLOCK + 1)),
                ),
            )
        )

    return let(steps, build)


def place_matches(found: Column, gaps: Column) -> Column:
    """array<struct<raw, start>> from the matches of a text and the pieces between them."""
    steps = F.transform(
        found,
        lambda _, i: (F.length(F.get(gaps, i)) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0)).cast("long"),
    )
    return let(
        prefix_sums(steps),
        lambda starts: F.transform(found, lambda raw, i: F.struct(raw.alias("raw"), F.get(starts, i).alias("start"))),
    )


def match_spans(text: Column, pattern: str) -> Column:
    """All matches of a literal pattern as array<struct<raw, start>> with 0-based starts."""
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.split(text, pattern, -1).alias("gaps"),
    )
    spans = let(parts, lambda p: F.when(F.size(p["found"]) > 0, place_matches(p["found"], p["gaps"])))
    return F.coalesce(spans, empty_array("struct<raw:string,start:bigint>"))


def last_at_or_below(sorted_values: Column, x: Column) -> Column:
    """0-based index of the last element <= x, by binary search."""
    start = F.struct(F.lit(0).alias("lo"), (F.size(sorted_values) - 1).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("int")
        fits = F.get(sorted_values, mid) <= x
        return F.struct(
            F.when(fits, mid).otherwise(acc["lo"]).alias("lo"),
            F.when(fits, acc["hi"]).otherwise(F.greatest(mid - 1, F.lit(0))).alias("hi"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, halve)["lo"]


def segment_starts(text: Column, separators: str) -> Column:
    """Exclusive running lengths of the pieces between single-character separators."""
    return let(
        F.split(text, separators, -1),
        lambda parts: let(
            prefix_sums(F.transform(parts, lambda p: F.length(p).cast("long"))),
            lambda ends: F.transform(parts, lambda p, i: F.get(ends, i) - F.length(p)),
        ),
    )


def contains_any(text: Column, anchors: list[str]) -> Column:
    """True when one of the literal texts occurs; an ``i:`` prefix ignores case."""
    found = F.lit(False)
    for anchor in anchors:
        plain = F.contains(F.lower(text), F.lit(anchor[2:])) if anchor.startswith("i:") else F.contains(text, F.lit(anchor))
        found = found | plain
    return found


def replace_all(text: Column, rules: list[tuple]) -> Column:
    """Replacements in order. A rule with anchors runs its pattern only where one of them occurs; with
    conditions, too, the anchors are searched only where all of those hold."""

    def step(current: Column, rule: tuple) -> Column:
        pattern, replacement, *rest = rule
        anchors, conditions = (*rest, [], [])[:2]
        if not anchors:
            return F.regexp_replace(current, pattern, replacement)
        wanted = lambda t: functools.reduce(lambda left, right: left & right, [*conditions, contains_any(t, anchors)])
        return let(current, lambda t: F.when(wanted(t), F.regexp_replace(t, pattern, replacement)).otherwise(t))

    for rule in rules:
        text = step(text, rule)
    return text


def blank_matches(text: Column, pattern: str, keep: str = r"[^\n]", fill: str = "") -> Column:
    """Remove every match of a pattern but keep its line breaks (``fill`` replaces each other character)."""

    def build(parts: Column) -> Column:
        blanks = F.transform(parts["found"], lambda m: F.regexp_replace(m, keep, fill))
        return F.array_join(
            F.zip_with(parts["gaps"], blanks, lambda g, b: F.concat(g, F.coalesce(b, F.lit("")))), ""
        )

    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.split(text, pattern, -1).alias("gaps"),
    )
    return let(parts, build)


# --- identity of a match ---------------------------------------------------------


def unify_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def auth_id(raw: Column) -> Column:
    """Collision-resistant identity: SHA-256 of the match with line endings unified."""
    return F.sha2(unify_newlines(raw), 256)


def fingerprint(raw: Column) -> Column:
    """Display form of a match; at least eight characters stay hidden behind a public prefix."""

    def build(s: Column) -> Column:
        public = F.regexp_extract(F.left(s, F.lit(12)), r"(?s)^.+[_-]", 0)
        head = F.when(
            (F.length(s) > 14) & (public != "") & (F.length(s) - F.length(public) >= 8), public
        ).otherwise(F.left(s, F.lit(6)))
        tail = F.when(F.length(s) > 14, F.right(s, F.lit(4))).otherwise("")
        return F.concat(head, F.lit("…"), tail, F.lit(" ("), F.length(s).cast("string"), F.lit(" chars)"))

    return let(unify_newlines(raw), build)


def line_col(text: Column, offset: Column) -> Column:
    """struct<line, col>, both 1-based, of a 0-based character offset."""

    def build(head: Column) -> Column:
        newlines = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
        return F.struct(
            (newlines + 1).cast("int").alias("line"),
            (F.length(F.substring_index(head, "\n", -1)) + 1).cast("int").alias("col"),
        )

    return let(F.left(text, F.least(offset, F.length(text)).cast("int")), build)


# --- time ------------------------------------------------------------------------


def iso_week_id(ts: Column) -> Column:
    return F.concat(
        F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0")
    )


def utc_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def traffic_day(stamp: Column) -> Column:
    """The day part of a traffic timestamp string; NULL when it has another shape."""
    day = F.left(stamp, F.lit(10))
    return F.when(day.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), day)


# --- small parsers of one string ---------------------------------------------------


def churn_lines(shortstat: Column) -> Column:
    def number(word: str) -> Column:
        return F.coalesce(F.regexp_extract(shortstat, r"([0-9]+) " + word, 1).try_cast("long"), F.lit(0).cast("long"))

    return F.coalesce(number("insertion") + number("deletion"), F.lit(0).cast("long"))


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a over code points as eight hex digits."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    mixed = F.aggregate(
        codes,
        F.lit(2166136261).cast("long"),
        lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")),
    )
    return F.lower(F.lpad(F.hex(mixed), 8, "0"))


def repo_from_remote(url: Column) -> Column:
    """``owner/name`` of a git remote in scp or URL form, else an empty string."""
    trimmed = F.regexp_replace(F.trim(url), r"(?i)\.git$", "")
    scp = F.regexp_extract(trimmed, r"^[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+:(.+)$", 1)
    with_scheme = F.regexp_extract(trimmed, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(/[^?#]*)", 1)
    path = F.when(scp != "", scp).when(trimmed.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), with_scheme).otherwise(trimmed)
    return let(
        F.filter(F.split(path, "/"), lambda p: p != ""),
        lambda parts: F.when(
            F.size(parts) >= 2, F.array_join(F.slice(parts, F.size(parts) - 1, F.lit(2)), "/")
        ).otherwise(""),
    )


def tsv_field(value: Column) -> Column:
    """Escape control characters so a value can never forge a row or a column."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    text = F.replace(F.replace(F.replace(text, F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    control = [*range(0, 9), 11, 12, *range(14, 32), 127]
    escaped = text
    for code in control:
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(f"\\x{code:02x}"))
    return F.when(text.rlike(r"[\x00-\x1F\x7F]"), escaped).otherwise(text)


def table_name(raw: Column) -> Column:
    """``schema.table`` with the default schema public; quoted parts keep their case."""
    ident = r'((?:"[^"]+"|[A-Za-z0-9_]+))'
    two = r"^" + ident + r"\s*\.\s*" + ident + r"$"
    trimmed = F.trim(raw)

    def part(text: Column) -> Column:
        return F.when(
            text.rlike(r'^".*"$'), F.replace(text.substr(F.lit(2), F.length(text) - 2), F.lit('""'), F.lit('"'))
        ).otherwise(F.lower(F.replace(text, F.lit('"'), F.lit(""))))

    one = r"^" + ident + r"$"
    return (
        F.when(
            trimmed.rlike(two),
            F.concat(part(F.regexp_extract(trimmed, two, 1)), F.lit("."), part(F.regexp_extract(trimmed, two, 2))),
        )
        .when(trimmed.rlike(one), F.concat(F.lit("public."), part(F.regexp_extract(trimmed, one, 1))))
    )


def receipt_fields(body: Column) -> Column:
    """The fields of a run receipt: phase, at, verdict, exit code, bypassed."""

    def line(name: str) -> Column:
        return F.nullif(F.regexp_extract(body, rf"(?m)^- {name}: (\S+)", 1), F.lit(""))

    return F.struct(
        line("phase").alias("phase"),
        line("at").alias("at"),
        line("verdict").alias("verdict"),
        line("exitCode").try_cast("int").alias("exit_code"),
        (F.coalesce(line("bypassed"), F.lit("")) == "true").alias("bypassed"),
    )


# --- source lines ---------------------------------------------------------------


def line_count(text: Column) -> Column:
    """Physical lines; a trailing newline does not add one."""
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (newlines + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("int")


def size_tier(lines: Column) -> Column:
    return (
        F.when(lines > V.SIZE_FLAG, "flag").when(lines > V.SIZE_WARN, "warn").when(lines > V.SIZE_NOTICE, "notice")
    )


def looks_generated(text: Column) -> Column:
    return F.exists(F.split(text, "\n", -1), lambda line: F.length(line) > V.GENERATED_LINE_CHARS)


# A block comment opens only on a line that starts with it and does not close there.
_OPEN_BLOCK = r"(?m)(?:^|\G)[ \t\r\f]*/\*(?![^\n]*\*/)[\s\S]*?(?:\*/|\z)"


def normalized_lines(text: Column) -> Column:
    """Comparable lines as array<struct<norm, line>>: trimmed, spaces collapsed;
    comments, imports, punctuation and lines under four characters dropped."""
    code = F.when(F.contains(text, F.lit("/*")), blank_matches(text, _OPEN_BLOCK)).otherwise(text)
    space = "[" + V.SPACE + "]+"
    tidy = F.transform(
        F.split(code, "\n", -1),
        lambda raw, i: F.struct(
            F.trim(F.regexp_replace(raw, space, " ")).alias("norm"), (i + 1).cast("int").alias("line")
        ),
    )

    def keep(entry: Column) -> Column:
        norm = entry["norm"]
        comment = (
            F.startswith(norm, F.lit("//"))
            | F.startswith(norm, F.lit("#"))
            | F.startswith(norm, F.lit("*"))
            | F.startswith(norm, F.lit("/*"))
        )
        return ~comment & (F.length(norm) >= 4) & ~norm.rlike(V.PUNCTUATION_LINE) & ~norm.rlike(V.BOILERPLATE_LINE)

    return F.filter(tidy, keep)


def collapse_score(lines: Column, churn: Column, blocks: Column) -> Column:
    weight = (lines / 100) * (1 + F.sqrt(churn.cast("double"))) * (1 + 2 * blocks)
    return F.floor(weight * 10 + 0.5) / 10


def move_case(lines: Column, churn: Column, blocks: Column) -> Column:
    """Which advice fits a file: the key of its sentence in ``MOVE_TEXT``."""
    big, hot, dup = lines > V.SIZE_NOTICE, churn >= V.HOT_CHURN, blocks > 0
    return (
        F.when(big & hot & dup, "big_hot_dup").when(big & hot, "big_hot").when(big & dup, "big_dup").when(dup, "dup").when(big, "big").otherwise("churn")
    )


def move_for(lines: Column, churn: Column, blocks: Column) -> Column:
    case = move_case(lines, churn, blocks)
    return F.coalesce(*[F.when(case == key, text) for key, text in V.MOVE_TEXT.items()])


# --- credential-shaped names --------------------------------------------------------


def credential_key(name: Column) -> Column:
    """True when an environment name looks like a credential; tool names never do."""
    return (
        F.when(F.coalesce(name, F.lit("")) == "", False)
        .when(name.rlike(V.TOOL_NAME) | name.rlike(V.TOOL_NAME_PREFIX) | name.isin(V.TOOL_NAME_EXACT), False)
        .when(name.rlike(V.NPM_INFO_PREFIX), False)
        .when(name.rlike(V.NPM_CONFIG_PREFIX), name.rlike(V.NPM_CONFIG_SECRET))
        .when(name.isin(V.CREDENTIAL_NAMES), True)
        .when(name.rlike(V.ACTIONS_RUNTIME) | name.rlike(V.ACTIONS_SECRET), True)
        .when(name.rlike(V.GITHUB_PREFIX), name.rlike(V.GITHUB_SECRET))
        .when(name.rlike(V.NPM_SECRET) | name.rlike(V.DATABASE_SECRET), True)
        .otherwise(name.rlike(V.CREDENTIAL_TAIL))
    )


def scrub_map(values: Column, keep: list[str] | None = None) -> Column:
    """Drop credential-shaped keys and NULL values from a map, except the names to keep."""
    kept = keep or []
    return F.map_filter(values, lambda k, v: v.isNotNull() & (k.isin(kept) | ~credential_key(k)))
