"""Detection of secrets, personal data and denied terms in columns of text.

One row stays one row: hits are an array column built by literal patterns, so
a scan is a narrow projection that never shuffles. ``detect`` explodes it.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import fixed_values as V
from wardline.functions.text import auth_id, col, empty_array, fingerprint, last_at_or_below, let, match_spans, place_matches, segment_starts, valid_json

HIT = (
    "struct<kind:string,pattern_id:string,label:string,view:string,raw:string,"
    "index:bigint,length:int,original_index:bigint,original_length:bigint>"
)


# --- validators: what a pattern alone cannot decide ------------------------------------


def _jwt_header_ok(raw: Column) -> Column:
    head = F.translate(F.substring_index(raw, ".", 1), "-_", "+/")
    head = F.left(head, (F.length(head) - F.when(F.length(head) % 4 == 1, 1).otherwise(0)).cast("int"))
    padded = F.rpad(head, F.ceil(F.length(head) / 4).cast("int") * 4, F.lit("="))
    header = F.make_valid_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))
    keys = F.json_object_keys(header)
    named = F.array_contains(keys, "alg") | F.array_contains(keys, "typ")
    return F.coalesce(named & valid_json(header), F.lit(False))


def _db_url_ok(pattern: str, raw: Column) -> Column:
    password = F.regexp_extract(raw, pattern, 1)
    host = F.lower(F.regexp_replace(F.regexp_extract(raw, pattern, 2), r":[0-9]+$", ""))
    ok = ~host.isin(V.LOCAL_HOSTS)
    for placeholder in V.PLACEHOLDER_PASSWORDS:
        ok = ok & ~password.rlike(placeholder)
    return ok


def iban_valid(raw: Column) -> Column:
    """ISO 7064 mod 97 over the rearranged characters."""
    moved = F.concat(raw.substr(F.lit(5), F.length(raw)), F.left(raw, F.lit(4)))
    rest = F.aggregate(
        F.filter(F.split(moved, ""), lambda c: c != ""),
        F.lit(0).cast("int"),
        lambda acc, c: F.when(c.between("A", "Z"), (acc * 100 + F.ascii(c) - 55) % 97)
        .otherwise((acc * 10 + F.ascii(c) - 48) % 97)
        .cast("int"),
    )
    return (rest == 1) & F.length(raw).between(15, 34)


def _valid(pattern_id: Column, raw: Column) -> Column:
    """What a pattern alone cannot decide, for the detectors that need it."""
    pattern = {d[0]: d[3] for d in V.SECRET_DETECTORS}
    token = F.regexp_extract(raw, pattern["bearer"], 1)
    return (
        F.when(pattern_id == "anthropic", raw.rlike("[0-9]"))
        .when(pattern_id == "openai", raw.rlike("[0-9]") & ~F.startswith(raw, F.lit("sk-ant-")))
        .when(pattern_id == "jwt", _jwt_header_ok(raw))
        .when(pattern_id == "db-url-password", _db_url_ok(pattern["db-url-password"], raw))
        .when(pattern_id == "bearer", token.rlike("[a-z]") & token.rlike("[A-Z]") & token.rlike("[0-9]"))
        .when(pattern_id == "iban", iban_valid(raw))
        .otherwise(True)
    )


# --- many detectors over one text -------------------------------------------------------


def scan(text: Column, detectors: list[tuple], skip: Column | None = None, skipped: tuple[str, ...] = ()) -> Column:
    """Every valid match as array<struct<pattern_id, label, raw, start>>, in detector order.

    Each pattern is a literal of its own and runs only where one of its anchors or its
    hint occurs; placing and validating the matches is written once for all of them.
    """

    def candidate(detector: tuple) -> Column:
        pattern_id, label, anchors, pattern = detector[:4]
        wanted = _any_anchor(text, anchors)
        if len(detector) > 4:
            wanted = wanted & text.rlike(detector[4])
        if skip is not None and pattern_id in skipped:
            wanted = wanted & ~skip
        return F.when(
            wanted,
            F.struct(
                F.lit(pattern_id).alias("pattern_id"),
                F.lit(label).alias("label"),
                F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
                F.split(text, pattern, -1).alias("gaps"),
            ),
        )

    matched = F.filter(F.array(*[candidate(d) for d in detectors]), lambda d: F.size(d["found"]) > 0)
    spans = F.flatten(
        F.transform(
            matched,
            lambda d: F.transform(
                place_matches(d["found"], d["gaps"]),
                lambda s: F.struct(
                    d["pattern_id"].alias("pattern_id"), d["label"].alias("label"), s["raw"].alias("raw"), s["start"].alias("start")
                ),
            ),
        )
    )
    return F.filter(spans, lambda s: _valid(s["pattern_id"], s["raw"]))


def _any_anchor(text: Column, anchors: list[str]) -> Column:
    found = F.lit(not anchors)
    for anchor in anchors:
        found = found | F.contains(text, F.lit(anchor))
    return found


# --- evasion views ----------------------------------------------------------------------

_NEWLINES = r"[\r\n]"
_FORMATS = "[" + V.FORMAT_CHARACTERS + "]"
_BOTH = "[\r\n" + V.FORMAT_CHARACTERS + "]"


def fold_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\n"), F.lit("")), F.lit("\r"), F.lit(""))


def fold_unicode(text: Column) -> Column:
    """Drop format characters and map lookalike letters to ASCII; pure ASCII text passes untouched."""
    folded = F.translate(text, "".join(V.LOOKALIKES) + V.FORMAT_CHARACTERS, "".join(V.LOOKALIKES.values()))
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(folded)


def base64_blobs(text: Column) -> Column:
    """Every decodable blob as array<struct<raw, start, decoded>>; each byte is read as one character, so binary data is searched, too."""
    decoded = F.transform(
        match_spans(text, V.BASE64_BLOB),
        lambda s: F.struct(
            s["raw"].alias("raw"),
            s["start"].alias("start"),
            F.try_to_binary(s["raw"], F.lit("base64")).alias("bytes"),
        ),
    )
    accepted = F.filter(decoded, lambda b: F.octet_length(b["bytes"]) >= 1)
    blobs = F.transform(
        accepted,
        lambda b: F.struct(
            b["raw"].alias("raw"), b["start"].alias("start"), F.decode(b["bytes"], "ISO-8859-1").alias("decoded")
        ),
    )
    return F.when(text.rlike("(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{26}"), blobs).otherwise(
        empty_array("struct<raw:string,start:bigint,decoded:string>")
    )


_VIEW = "struct<view:string,text:string,span_start:bigint,span_length:bigint>"


def _view(name: str, text: Column, start: Column | None = None, length: Column | None = None) -> Column:
    return F.struct(
        F.lit(name).alias("view"),
        text.alias("text"),
        (F.lit(None) if start is None else start).cast("bigint").alias("span_start"),
        (F.lit(None) if length is None else length).cast("bigint").alias("span_length"),
    )


def text_views(text: Column, evasions: bool) -> Column:
    """The texts to scan: the raw one and, for a gate, each view that differs from it."""
    anchors = [a for _, _, group, _ in V.SECRET_DETECTORS for a in group]
    raw = F.array(_view("raw", text))
    if not evasions:
        return F.when(_any_anchor(text, anchors), raw)

    def folded(parts: Column) -> Column:
        uni, both = parts["unicode"], parts["both"]

        def plain(line: Column) -> Column:
            return F.filter(
                F.array(
                    _view("raw", text),
                    _view("newline-fold", F.when(line != text, line)),
                    _view("unicode", F.when(uni != text, uni)),
                    _view("unicode-fold", F.when((uni != text) & (both != uni), both)),
                ),
                lambda v: v["text"].isNotNull(),
            )

        # Folding only removes or maps characters, so a text whose fully folded form has
        # no anchor cannot match in any of the first four views.
        return F.when(_any_anchor(both, anchors), let(fold_newlines(text), plain)).otherwise(empty_array(_VIEW))

    unicode_text = fold_unicode(text)
    plain = let(
        unicode_text, lambda uni: let(F.struct(uni.alias("unicode"), fold_newlines(uni).alias("both")), folded)
    )
    blobs = F.transform(base64_blobs(text), lambda b: _view("base64", b["decoded"], b["start"], F.length(b["raw"])))
    return F.concat(plain, blobs)


def secret_hits(text: Column | str, evasions: bool = False) -> Column:
    """Every secret match of a text in each view, as array<HIT>."""
    text = col(text)

    def scan_view(view: Column) -> Column:
        folded = view["view"].isin("newline-fold", "unicode-fold") if evasions else None
        found = scan(view["text"], V.SECRET_DETECTORS, folded, tuple(V.PEM_DETECTORS))
        return let(found, lambda spans: F.when(F.size(spans) > 0, placed(view, spans)))

    def placed(view: Column, spans: Column) -> Column:
        if not evasions:
            return F.transform(spans, lambda s: _hit("secret", view["view"], s, s["start"], F.length(s["raw"])))
        breaks = (
            F.when(view["view"] == "newline-fold", segment_starts(text, _NEWLINES))
            .when(view["view"] == "unicode", segment_starts(text, _FORMATS))
            .when(view["view"] == "unicode-fold", segment_starts(text, _BOTH))
        )

        def located(starts: Column) -> Column:
            def one(s: Column) -> Column:
                last = s["start"] + F.length(s["raw"]) - 1
                origin = s["start"] + last_at_or_below(starts, s["start"])
                end = last + last_at_or_below(starts, last) + 1
                start = F.coalesce(view["span_start"], F.when(starts.isNotNull(), origin), s["start"])
                length = F.coalesce(view["span_length"], F.when(starts.isNotNull(), end - origin), F.length(s["raw"]))
                return _hit("secret", view["view"], s, start, length)

            return F.transform(spans, one)

        return let(breaks, located)

    hits = F.flatten(F.filter(F.transform(text_views(text, evasions), scan_view), lambda h: h.isNotNull()))
    return F.coalesce(hits, empty_array(HIT))


def _hit(kind: str, view: Column, span: Column, start: Column, length: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        span["pattern_id"].alias("pattern_id"),
        span["label"].alias("label"),
        view.alias("view"),
        span["raw"].alias("raw"),
        span["start"].cast("bigint").alias("index"),
        F.length(span["raw"]).cast("int").alias("length"),
        start.cast("bigint").alias("original_index"),
        length.cast("bigint").alias("original_length"),
    )


_PII_HINTS = {
    "phone": "[0-9]{3}[-." + V.SPACE + "][0-9]{4}",
    "iban": "[A-Z]{2}[0-9]{2}[A-Z0-9]{10}",
    "us-ssn": "[0-9]-[0-9]{2}-[0-9]",
}


def _raw_hits(kind: str, text: Column, detectors: list[tuple]) -> Column:
    hits = F.transform(scan(text, detectors), lambda s: _hit(kind, F.lit("raw"), s, s["start"], F.length(s["raw"])))
    return F.coalesce(hits, empty_array(HIT))


def pii_hits(text: Column | str) -> Column:
    """Email, US phone, IBAN and US SSN matches, as array<HIT>."""
    return _raw_hits("pii", col(text), [(*d, _PII_HINTS[d[0]]) if d[0] in _PII_HINTS else d for d in V.PII_DETECTORS])


def denylist_hits(text: Column | str, terms: list[str]) -> Column:
    """Non-overlapping literal occurrences of each term of two characters or more, as array<HIT>."""
    wanted = [t for t in dict.fromkeys(terms) if len(t) >= 2]
    if not wanted:
        return empty_array(HIT)
    quoted = [("denylist", "Denylist term", [t], "\\Q" + t.replace("\\E", "\\E\\\\E\\Q") + "\\E") for t in wanted]
    return _raw_hits("denylist", col(text), quoted)


def detect(
    df: DataFrame, text: str, keys: list[str], secrets: bool = True, pii: bool = False,
    denylist: list[str] | None = None, evasions: bool = False,
) -> DataFrame:
    """One row per match: the keys, the hit, its fingerprint and its identity. ``raw`` is still present."""
    parts = []
    if secrets:
        parts.append(secret_hits(text, evasions))
    if pii:
        parts.append(pii_hits(text))
    if denylist:
        parts.append(denylist_hits(text, denylist))
    hits = F.concat(*parts) if len(parts) > 1 else parts[0]
    return (
        df.select(*keys, F.posexplode(hits).alias("hit_order", "hit"))
        .select(*keys, "hit_order", "hit.*")
        .withColumn("fp", fingerprint(F.col("raw")))
        .withColumn("auth_id", auth_id(F.col("raw")))
    )


def match_denylist(df: DataFrame, text: str, keys: list[str], terms: list[str]) -> DataFrame:
    """Occurrences per row and term, without positions."""
    counted = F.array(
        *[
            F.struct(
                F.lit(t).alias("term"),
                (
                    (F.length(F.col(text)) - F.length(F.replace(F.col(text), F.lit(t), F.lit("")))) / F.lit(len(t))
                ).cast("int").alias("occurrences"),
            )
            for t in dict.fromkeys(terms)
            if len(t) >= 2
        ]
    )
    return df.select(*keys, F.inline(counted)).where("occurrences > 0")
