"""Hard identifiers: patterns with checksum or context tests, all in one pass over each text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import intervals
from inkveil.functions import values as V
from inkveil.functions.checks import eleven_test, luhn, mod_97
from inkveil.functions.text import Blocks, context_after, context_before, digits_only, first_in, first_of_repeated, let, match_many, with_blocks

#: Emission order of the types; the patterns of a type follow one another.
ORDER = ("bsn", "iban", "telefoon", "email", "postcode", "kenteken", "url", "kvk", "btw", "geboortedatum", "creditcard")
CONFIDENCE = {"bsn": 0.98, "iban": 0.97, "telefoon": 0.95, "email": 0.97, "postcode": 0.90, "kenteken": 0.93, "url": 0.95, "kvk": 0.90, "btw": 0.95, "geboortedatum": 0.95, "creditcard": 0.95}
KVK_FAR_CONFIDENCE = 0.85
_HIT = "array<struct<text:string,start_char:int,end_char:int,confidence:double>>"


def _first_character(pattern: str) -> str:
    """A look-ahead for the first character of a pattern that begins with a word edge: cheaper than the edge, so it stands before it."""
    for start, ahead in ((r"\b0", "(?=0)"), (r"\b[A-Z]", "(?=[A-Z])"), (r"\b\d", r"(?=\d)"), (r"\bNL", "(?=[Nn])"), (r"(?<!\w)\+", r"(?=\+)")):
        if pattern.startswith(start):
            return ahead
    return ""


def _bare_url(s: Column) -> Column:
    bare = F.rtrim(s["text"], F.lit(V.URL_TAIL))
    return F.struct(bare.alias("text"), s["start_char"].alias("start_char"), (s["start_char"] + F.length(bare)).alias("end_char"))


def _near_anchor(text: Blocks, anchors: Column, pattern: str, near: int, reach: int, confidence: float) -> Column:
    """For each anchor the first match in the slice of near + reach characters after it, if it starts within `near`."""

    def first(a: Column) -> Column:
        value, offset = first_in(context_after(text, a["end_char"], near + reach), pattern)
        begin = a["end_char"] + offset
        return F.when((value != "") & (offset <= near), F.struct(value.alias("text"), begin.alias("start_char"), (begin + F.length(value)).alias("end_char"), F.lit(confidence).alias("confidence")))

    return F.filter(F.transform(anchors, first), lambda s: s.isNotNull())


def _kvk(text: Blocks, anchors: Column, numbers: Column) -> Column:
    """Numbers close behind an anchor, then others that are cells of a table after one."""

    def in_table(n: Column, a: Column) -> Column:
        gap = n["start_char"] - a["end_char"]
        between = text.slice(a["end_char"], F.greatest(F.least(gap, F.lit(V.KVK_FAR)), F.lit(0)))
        return gap.between(0, V.KVK_FAR) & between.rlike("[A-Za-z]{2,}") & ~between.rlike(r"(?U)\.\s+[A-Z]")

    def passes(close: Column) -> Column:
        starts, ends = F.transform(numbers, lambda n: n["start_char"]), F.transform(numbers, lambda n: n["start_char"] - V.KVK_FAR)
        # How many anchors end before a number and before its reach: those between are the only ones that can have it.
        ended = F.transform(anchors, lambda a, i: F.struct(a["end_char"].alias("start_char"), (i + 1).alias("end_char")))
        met = F.transform(close, lambda c: F.struct(c["start_char"].alias("start_char"), c["start_char"].alias("end_char")))
        places = F.arrays_zip(
            numbers.alias("n"), intervals.reaches(met, starts, inclusive=True).alias("met"),
            intervals.reaches(ended, starts, inclusive=True).alias("upto"), intervals.reaches(ended, ends).alias("gone"))

        def far(p: Column) -> Column:
            gone = F.greatest(p["gone"], F.lit(0))
            own = F.slice(anchors, gone + 1, F.greatest(p["upto"] - gone, F.lit(0)))
            return (p["met"] != p["n"]["start_char"]) & F.exists(own, lambda a: in_table(p["n"], a))

        rows = F.transform(F.filter(places, far), lambda p: F.struct(p["n"]["text"], p["n"]["start_char"], p["n"]["end_char"], F.lit(KVK_FAR_CONFIDENCE)))
        return F.concat(close.cast(_HIT), rows.cast(_HIT))

    return let(_near_anchor(text, anchors, f"(?U){V.KVK_NUMBER}", V.KVK_NEAR, 8, CONFIDENCE["kvk"]), passes)


def birth_date(text: Column) -> Column:
    """The date in d-m-Y, d/m/Y or 'd month Y', or null where there is no such day."""
    months = F.create_map(*[F.lit(x) for pair in V.MONTHS.items() for x in pair])
    parts = F.split(F.trim(text), r"(?U)[-/]|\s+")
    part = lambda i: F.try_element_at(parts, F.lit(i))
    month = F.coalesce(part(2).try_cast("int"), months[F.lower(part(2))])
    return F.try_make_date(part(3).try_cast("int"), month, part(1).try_cast("int")) if hasattr(F, "try_make_date") else F.try_to_date(F.concat_ws("-", part(3), month.cast("string"), part(1)), "y-M-d")


def _births(text: Blocks, anchors: Column, as_of: Column) -> Column:
    names = "|".join(sorted(V.MONTHS, key=len, reverse=True))
    pattern = rf"(?iU)\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{4}}|\d{{1,2}}\s+(?:{names})\s+\d{{4}}"
    hits = _near_anchor(text, anchors, pattern, V.BIRTH_NEAR, 20, CONFIDENCE["geboortedatum"])
    day = lambda s: birth_date(s["text"])
    return F.filter(hits, lambda s: F.coalesce((day(s) <= as_of) & (F.year(as_of) - F.year(day(s)) <= 120), F.lit(False)))


def _searches(text: Column) -> dict[str, tuple[tuple[str, ...], str, Column | None, Callable[[Column], Column] | None]]:
    """For each type its patterns, their flags, a cheap test that texts with matches pass, and the test of a match."""
    digit = text.rlike(r"\d{2}")
    dutch, ten_digits = digit & F.upper(text).contains("NL"), lambda t: F.length(digits_only(t)) >= 10
    return {
        "bsn": ((V.BSN,), "U", digit, eleven_test),
        "iban": ((V.IBAN,), "iU", dutch, mod_97),
        "telefoon": (V.PHONES, "U", digit, ten_digits),
        "email": ((V.EMAIL,), "U", text.contains("@"), None),
        "postcode": ((V.POSTCODE,), "U", digit, None),
        "kenteken": (V.PLATES, "U", text.rlike(r"\d-[A-Z]|[A-Z]-\d|\d-\d"), None),
        "url": ((V.URL,), "U", text.contains("://"), None),
        "kvk": ((f"(?i){V.KVK_ANCHOR}", V.KVK_NUMBER), "U", text.rlike(f"(?iU){V.KVK_ANCHOR}"), None),
        "btw": ((V.VAT,), "iU", dutch, lambda t: eleven_test(F.substring(digits_only(t), 1, 9))),
        "geboortedatum": ((V.BIRTH_ANCHOR,), "iU", None, None),
        "creditcard": ((V.CARD,), "U", text.rlike(r"\d{4}[-\s]?\d{4}"), luhn),
    }


def _hits(text: Column, as_of: Column, types: tuple[str, ...]) -> Column:
    """All hits in order of emission, with type, ground and ord. Patterns are searched side by side, then each type judges its own."""
    searches, patterns, first = _searches(text), [], {}
    for kind in types:
        first[kind] = len(patterns)
        for p in searches[kind][0]:
            test = searches[kind][2]
            if kind == "telefoon":
                test = test & text.contains("+31" if "+31" in p or r"\+31" in p else "0")
            patterns.append((f"(?{searches[kind][1]}){_first_character(p)}{p}", test))

    def rows(found: Column, kind: str, blocks: Blocks | None) -> Column:
        own = [F.get(found, F.lit(first[kind] + k)) for k in range(len(searches[kind][0]))]
        keep, confidence = searches[kind][3], lambda s: F.lit(CONFIDENCE[kind])
        if kind == "kvk":
            own, confidence = [let(own[0], lambda anchors: _kvk(blocks, anchors, own[1]))], lambda s: s["confidence"]
        elif kind == "geboortedatum":
            own = [_births(blocks, own[0], as_of)]
        elif kind == "url":
            own = [F.filter(F.transform(own[0], _bare_url), lambda s: F.length(s["text"]) > 0)]
        ground, order = V.GROUND_BSN if kind == "bsn" else V.GROUND, ORDER.index(kind) * 100_000_000

        def row(s: Column, k: Column, i: Column) -> Column:
            return F.struct(F.lit(kind).alias("entity_type"), s["text"].alias("text"), s["start_char"].alias("start_char"), s["end_char"].alias("end_char"), confidence(s).alias("confidence"), F.lit(ground).alias("woo_article"), (F.lit(order).cast("long") + k * 1_000_000 + i).alias("ord"))

        kept = lambda spans: F.filter(spans, lambda s: keep(s["text"])) if keep else spans
        return F.flatten(F.transform(F.array(*own), lambda spans, k: F.transform(kept(spans), lambda s, i: row(s, k, i))))

    every = lambda blocks: let(match_many(text, patterns), lambda found: F.flatten(F.array(*[rows(found, kind, blocks) for kind in types])))
    return with_blocks(text, every) if {"kvk", "geboortedatum"} & set(types) else every(None)


def hits(text: Column, as_of: str | None = None, types: tuple[str, ...] = ORDER) -> Column:
    """The rows of `detect` of a text, as an array of structs in its row."""
    return first_of_repeated(_hits(text, F.lit(as_of).cast("date") if as_of else F.current_date(), types))


def detect(docs: DataFrame, types: tuple[str, ...] = ORDER, as_of: str | None = None, text_col: str = "text", before: int = 0) -> DataFrame:
    """One row per hard identifier: doc_id, entity_type, tier, text, start_char, end_char, confidence, woo_article, source, ord.

    Offsets are code points, the end exclusive. Hits of equal lower-cased text and offsets are emitted once, the first
    by `ord`; overlapping spans of other offsets stay. as_of (a date) stands for today in tests of birth dates. before: also a column
    of that name with so many characters before the hit, for decisions that look there. Nothing leaves the row of a document.
    """
    text = F.col(text_col)
    found = hits(text, as_of, types)
    if before:
        plain = found
        found = with_blocks(text, lambda own: F.transform(plain, lambda h: h.withField("before", context_before(own, h["start_char"], before))))
    rows = docs.select("doc_id", F.inline(found))
    return rows.select("doc_id", "entity_type", F.lit("1").alias("tier"), "text", "start_char", "end_char", "confidence", "woo_article", F.lit("regex").alias("source"), "ord", *["before"] * bool(before))
