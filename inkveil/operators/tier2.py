"""Contextual identifiers: names, addresses, reference numbers and dates, found and merged within each text's row.

Everything works on arrays of spans in the row of a text, so there is no shuffle; merges are sweeps over sorted spans, and contexts
come from blocks of the text, so that work grows with a text's hits and not with their square. Column functions take the text and give
arrays; `detect` turns the final array into rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import intervals
from inkveil.functions import values as V
from inkveil.functions.text import Blocks, context_after, context_before, first_of_repeated, let, match_spans, normalise_token, particle_pattern, with_blocks
from inkveil.operators import tier1
from inkveil.operators.groups import grown

HIT = "array<struct<entity_type:string,text:string,start_char:int,end_char:int,confidence:double,source:string>>"
_LINE_GAP = r"[^\S\n]+"
_CAPITAL_WORD = rf"[{V.CAPITAL}][{V.INNER}\-]*"
STREET = rf"(?U)\b(?:{particle_pattern(V.DUTCH_PARTICLES, _LINE_GAP)})?(?:{_CAPITAL_WORD}{_LINE_GAP}){{0,3}}{_CAPITAL_WORD}(?:{'|'.join(V.STREET_ENDINGS)}){_LINE_GAP}\d{{1,4}}(?:[a-zA-Z]{{1,3}}|-\d{{1,3}})?\b"
_SURNAME = rf"[{V.CAPITAL}][{V.INNER}]{{2,}}(?:-[{V.CAPITAL}][{V.INNER}]+)?"
INITIALS = rf"(?U)(?<![\w.])(?:[A-Z]\.\s*){{1,4}}(?:{particle_pattern(V.DUTCH_PARTICLES + V.OTHER_PARTICLES)})?{_SURNAME}\b"
_LABELS = "|".join(label.replace(" ", r"\s+") for label in sorted(V.REFERENCE_LABELS, key=len, reverse=True))
REFERENCE = rf"(?iU)\b({_LABELS})\s*[:\-]?\s*({V.REFERENCE_VALUE})"
TITLE = rf"(?iU)(?<![\w'])(?:{'|'.join(V.TITLES_OF_ADDRESS)})(?=\s)"
_PARTICLE_WORDS = "|".join(p.replace(" ", r"\s+") for p in sorted(V.DUTCH_PARTICLES + V.OTHER_PARTICLES, key=lambda p: (-len(p.split()), p)))
_CAP_TOKEN = r"\p{Lu}[\w'\-]+"
_AFTER_TITLE = rf"(?U)^(?:\s+(?:(?i:{_PARTICLE_WORDS})|(?:[A-Z]\.)+|{_CAP_TOKEN})[,.;:!?)\]}}]*(?=\s|$))+"
#: Distance within which a postcode confirms a street.
NEAR_POSTCODE, TITLE_REACH, CONTEXT = 80, 80, 30


def hit(kind: str, text: Column, start: Column, confidence: Column, source: str) -> Column:
    return F.struct(F.lit(kind).alias("entity_type"), text.alias("text"), start.cast("int").alias("start_char"), (start + F.length(text)).cast("int").alias("end_char"), confidence.cast("double").alias("confidence"), F.lit(source).alias("source"))


def plausible_person(text: Column) -> Column:
    """Cheap test that a span can be a person's name."""
    tokens = F.split(F.trim(text), r"(?U)\s+")
    low = F.transform(tokens, lambda t: F.lower(t))
    first, last = F.element_at(low, 1), F.element_at(tokens, -1)
    later = F.exists(F.slice(tokens, 2, F.size(tokens)), lambda t: t.rlike(r"^\p{Lu}"))
    words = F.array(*[F.lit(w) for w in V.ORGANISATION_WORDS])
    return (
        F.length(F.trim(text)).between(2, 50) & text.rlike(r"\p{Lu}") & (~first.isin(*V.NOT_A_NAME) | later) & ~F.arrays_overlap(low, words)
        & ~F.trim(text).rlike(r"(?U)(?<=[a-z])\.\s+[a-z]") & ~((F.size(tokens) >= 2) & last.rlike(r"^\p{L}$"))
    )


def plausible_home(span: Column, text: Column | Blocks, start: Column) -> Column:
    """False where an address is an institution's: by its words or by the label before it."""
    tokens = F.transform(F.split(F.trim(span), r"(?U)\s+"), lambda t: F.lower(F.regexp_replace(t, r"^[.,;:()]+|[.,;:()]+$", "")))
    words = F.array(*[F.lit(w) for w in V.ORGANISATION_WORDS + V.PUBLIC_BUILDINGS])
    label = rf"(?iU)(?:{'|'.join(V.ADDRESS_LABELS)})\s*[:\-]?\s*$"
    return F.trim(span).contains(" ") & ~F.arrays_overlap(tokens, words) & ~context_before(text, start, CONTEXT).rlike(label)


def event_date(span: Column, text: Column | Blocks, start: Column, as_of: Column) -> Column:
    """True where a date is that of a recent year or of an administrative act, thus not a birth date."""
    year = F.regexp_extract(span, r"\b(?:19|20)\d{2}\b", 0).try_cast("int")
    return F.coalesce(year >= F.year(as_of) - 2, F.lit(False)) | context_before(text, start, CONTEXT).rlike(f"(?iU){V.EVENT_BEFORE}")


def score_name(text: Column, first_names: Sequence[str], surnames: Sequence[str]) -> Column:
    """struct(first, last, plausible): leading particles are skipped, the next token (or a part of it at hyphens) is looked up as first
    name; the rightmost other token that is no particle, else any inner one, as surname."""
    singles = sorted({w for p in V.DUTCH_PARTICLES + V.OTHER_PARTICLES for w in p.split()})
    particle = lambda t: t.isin(*singles)
    listed = lambda names: (lambda t: t.isin(*names)) if names else (lambda t: F.lit(False))

    def scored(body: Column) -> Column:
        first = F.coalesce(F.exists(F.split(F.try_element_at(body, F.lit(1)), "-"), listed(list(first_names))), F.lit(False))

        def both(first: Column) -> Column:
            rest = F.filter(F.when(first, F.slice(body, 2, F.size(body))).otherwise(body), lambda t: ~particle(t))
            last = F.exists(rest, listed(list(surnames)))
            return F.struct(first.alias("first"), last.alias("last"), (first | last).alias("plausible"))

        return let(first, both)

    def without_lead(tokens: Column) -> Column:
        lead = F.coalesce(F.array_position(F.transform(tokens, lambda t: ~particle(t)), True), F.lit(0))
        return let(lead, lambda at: F.when(at > 0, F.slice(tokens, F.greatest(at, F.lit(1)).cast("int"), F.size(tokens))).otherwise(F.array().cast("array<string>")))

    tokens = F.filter(F.transform(F.split(F.trim(text), r"(?U)\s+"), normalise_token), lambda t: t != "")
    return let(let(tokens, without_lead), scored)


def streets(text: Column) -> Column:
    def scored(spans: Column) -> Column:
        codes = match_spans(text, f"(?U){V.POSTCODE}", text.rlike(r"\d{4}"))
        row = lambda s, near: hit("adres", s["text"], s["start_char"], F.when(near, 0.92).otherwise(0.85), "regex")
        return F.zip_with(spans, let(codes, lambda own: intervals.near(spans, own, NEAR_POSTCODE)), row)

    spans = match_spans(text, STREET, text.rlike(rf"(?:{'|'.join(V.STREET_ENDINGS)})\s+\d"))
    return with_blocks(text, lambda own: F.filter(let(spans, scored), lambda h: plausible_home(h["text"], own, h["start_char"])))


def house_numbers(text: Column) -> Column:
    whole = F.transform(match_spans(text, f"(?iU){V.HOUSE_NUMBER}"), lambda s: hit("adres", s["text"], s["start_char"], F.lit(0.85), "regex"))

    def inner(s: Column) -> Column:
        number = F.regexp_extract(s["text"], f"(?iU){V.RESIDENT_NUMBER}", 0)
        return hit("adres", number, s["end_char"] - F.length(number), F.lit(0.80), "regex")

    return F.concat(whole, F.transform(match_spans(text, f"(?iU){V.RESIDENT}"), inner))


def initials_names(text: Column) -> Column:
    found = match_spans(text, INITIALS, text.rlike(r"[A-Z]\."))
    spans = with_blocks(text, lambda own: F.filter(found, lambda s: ~context_after(own, s["end_char"], 2).rlike(r"^\.\p{L}")))
    kept = F.filter(spans, lambda s: ~F.upper(F.regexp_replace(F.regexp_extract(s["text"], r"(?U)^(?:[A-Z]\.\s*){1,4}", 0), r"(?U)[\s.]", "")).isin(*V.NOT_SURNAMES))
    return F.filter(F.transform(kept, lambda s: hit("persoon", F.trim(s["text"]), s["start_char"], F.lit(0.85), "initials_rule")), lambda h: plausible_person(h["text"]))


def references(text: Column) -> Column:
    sure = F.create_map(*[F.lit(x) for pair in V.REFERENCE_LABELS.items() for x in pair])

    def value(s: Column) -> Column:
        number = F.regexp_extract(s["text"], REFERENCE, 2)
        label = F.regexp_replace(F.lower(F.regexp_extract(s["text"], REFERENCE, 1)), r"(?U)\s+", " ")
        return hit("referentie", number, s["end_char"] - F.length(number), sure[label], "regex")

    return F.filter(F.transform(match_spans(text, REFERENCE), value), lambda h: h["text"].rlike(r"\d"))


def titled_names(text: Column) -> Column:
    """Names after a form of address: particles, initials and capitalised tokens as far as they go."""

    def name(a: Column, own: Blocks) -> Column:
        run = F.regexp_extract(context_after(own, a["end_char"], TITLE_REACH), _AFTER_TITLE, 0)
        bare = F.ltrim(F.regexp_replace(run, r"(?U)^\s+", ""))
        bare = F.when(bare.rlike(r"(?U)(?:^|\s)(?:[A-Z]\.)+$"), bare).otherwise(F.regexp_replace(bare, r"[,.;:!?)\]}]+$", ""))
        return hit("persoon", bare, a["end_char"] + F.length(F.regexp_extract(run, r"(?U)^\s+", 0)), F.lit(0.75), "title_rule")

    singles = sorted({w for p in V.DUTCH_PARTICLES + V.OTHER_PARTICLES for w in p.split()})
    capital = lambda t: t.rlike(rf"(?U)^{_CAP_TOKEN}") & ~F.lower(t).isin(*singles)
    hits = with_blocks(text, lambda own: F.transform(match_spans(text, TITLE), lambda a: name(a, own)))
    return intervals.not_within_longer(F.filter(hits, lambda h: F.exists(F.split(h["text"], r"(?U)\s+"), capital) & plausible_person(h["text"])))


def listed_names(text: Column, first_names: Sequence[str], surnames: Sequence[str]) -> Column:
    """Candidates: runs of capitalised tokens (particles between them) with a listed first name or surname."""
    run = rf"(?U)\b{_CAPITAL_WORD}(?:[^\S\n]+(?:{particle_pattern(V.DUTCH_PARTICLES, _LINE_GAP)})?{_CAPITAL_WORD}){{0,4}}"
    spans = F.filter(match_spans(text, run, text.rlike(r"\p{Lu}")), lambda s: plausible_person(s["text"]))

    def candidate(s: Column) -> Column:
        def row(score: Column) -> Column:
            confidence = F.least(F.lit(0.95), F.round(F.lit(0.80) + F.when(score["first"], 0.10).otherwise(0.0) + F.when(score["last"], 0.05).otherwise(0.0), 2))
            return F.when(score["plausible"], hit("persoon", s["text"], s["start_char"], confidence, "ner"))

        return let(score_name(s["text"], first_names, surnames), row)

    return F.filter(F.transform(spans, candidate), lambda h: h.isNotNull())


_MONTHS = "|".join(sorted(V.MONTHS, key=len, reverse=True))
DATE = rf"(?iU)\b(?:\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{4}}|\d{{1,2}}\s+(?:{_MONTHS})\s+\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}})\b"
_KEYWORDS = "|".join(w.capitalize() for w in sorted(V.ORGANISATION_WORDS, key=lambda w: (-len(w), w)))
ORGANISATION = rf"(?U)\b(?:{_KEYWORDS})(?:{_LINE_GAP}(?:{particle_pattern(V.DUTCH_PARTICLES, _LINE_GAP)})?{_CAPITAL_WORD}){{1,4}}"


def dates(text: Column, as_of: Column) -> Column:
    """Dates that may be birth dates: not of recent years, not after an administrative word."""
    hits = F.transform(match_spans(text, DATE, text.rlike(r"\d{4}")), lambda s: hit("datum", s["text"], s["start_char"], F.lit(0.60), "ner"))
    return with_blocks(text, lambda own: F.filter(hits, lambda h: ~event_date(h["text"], own, h["start_char"], as_of)))


def organisations(text: Column) -> Column:
    """A capitalised organisation word and the capitalised words after it."""
    return F.transform(match_spans(text, ORGANISATION), lambda s: hit("organisatie", s["text"], s["start_char"], F.lit(0.50), "ner"))


def trimmed(span: Column) -> Column:
    """A hit without punctuation and spaces at its ends, its offsets moved along."""
    lead = F.length(F.regexp_extract(span["text"], r"(?U)^[\s\p{P}]+", 0))
    bare = F.regexp_replace(span["text"], r"(?U)^[\s\p{P}]+|[\s\p{P}]+$", "")
    return F.struct(span["entity_type"].alias("entity_type"), bare.alias("text"), (span["start_char"] + lead).cast("int").alias("start_char"), (span["start_char"] + lead + F.length(bare)).cast("int").alias("end_char"), span["confidence"].alias("confidence"), span["source"].alias("source"))


def without_titles(text: Column, titles: Sequence[str]) -> Column:
    """A person's span without function titles: those at its end go, from one at the third word or later all goes, then one before the name."""
    any_title = "|".join(t.replace(" ", r"\s+") for t in sorted(titles, key=len, reverse=True))
    if not any_title:
        return text
    end = F.regexp_replace(text, rf"(?iU)(?:[\s,]+(?:{any_title})[.,;:()]*)+$", "")
    inner = F.regexp_replace(text, rf"(?iU)^(\S+\s+\S+(?:\s+\S+)*?)\s+(?:{any_title})\b.*$", "$1")
    return F.regexp_replace(F.when(end != text, end).otherwise(inner), rf"(?iU)^(?:{any_title})\s+(?=\S)", "")


def merge_apart(base: Column, hits: Column, kind: str) -> Column:
    """Append the hits, which are of one type and in the order of their starts, that overlap no span of that type, accepted hits included."""
    same = lambda spans: F.filter(spans, lambda a: a["entity_type"] == kind)
    return let(base, lambda own: F.concat(own, let(let(hits, lambda new: intervals.clear_of(new, same(own))), intervals.apart)))


def replace_contained(base: Column, hits: Column) -> Column:
    """Drop the base's addresses that lie within a hit, then append all hits."""

    def both(own: Column, new: Column) -> Column:
        reach = intervals.reaches(new, F.transform(own, lambda a: a["start_char"]), inclusive=True)
        kept = F.filter(F.zip_with(own, reach, lambda a, r: F.when((a["entity_type"] != "adres") | (r < a["end_char"]), a)), lambda a: a.isNotNull())
        return F.concat(kept, new)

    return let(base, lambda own: let(hits, lambda new: both(own, new)))


def first_of_equals(spans: Column) -> Column:
    """The first of spans of equal lower-cased text and offsets, in their order."""
    ranked = first_of_repeated(F.transform(spans, lambda s, i: s.withField("ord", i)))
    return F.transform(F.array_sort(F.transform(ranked, lambda s: F.struct(s["ord"].alias("ord"), s.alias("s")))), lambda x: x["s"].dropFields("ord")).cast(HIT)


RULES = {"street": streets, "house_number": house_numbers, "initials": initials_names, "reference": references, "title": titled_names, "organisation": organisations}


def rule_rows(docs: DataFrame, rule: str, context: bool = False) -> DataFrame:
    """The rows of one rule alone; context: with the text around each that later decisions look at, so that they need not join texts."""
    hits = RULES[rule](F.col("text")).cast(HIT)
    if context:
        found = hits
        hits = with_blocks(F.col("text"), lambda own: F.transform(found, lambda h: h.withField("before", context_before(own, h["start_char"], V.WINDOW_LIST)).withField("after", context_after(own, h["end_char"], V.WINDOW_TITLE))))
    return docs.select("doc_id", F.inline(hits))


def by_tag(candidates: DataFrame) -> DataFrame:
    """Candidates (tag, ...) of an outside recogniser with their entity_type; tags without a type and types that tier 1 finds itself go."""
    kind = F.create_map(*[F.lit(x) for pair in V.TAGS.items() for x in pair])[F.lower("tag")]
    return candidates.withColumn("entity_type", kind).filter(F.col("entity_type").isin(*V.TIER2_TYPES))


def trim_persons(spans: Column, titles: Sequence[str]) -> Column:
    """Persons of an array of hits without function titles, those that are nothing else dropped, and their offsets moved along."""

    def bare(h: Column) -> Column:
        def moved(name: Column) -> Column:
            at = h["start_char"] + F.greatest(F.call_function("locate", name, h["text"]) - 1, F.lit(0))
            return F.struct(h["entity_type"].alias("entity_type"), name.alias("text"), at.cast("int").alias("start_char"), (at + F.length(name)).cast("int").alias("end_char"), h["confidence"].alias("confidence"), h["source"].alias("source"))

        return F.when(h["entity_type"] == "persoon", let(F.trim(without_titles(h["text"], titles)), moved)).otherwise(h)

    return F.filter(F.transform(spans, bare), lambda h: h["text"] != "") if titles else spans


def _staged(docs: DataFrame, first_names: Sequence[str], surnames: Sequence[str], as_of: str | None, titles: Sequence[str], *keep: str) -> DataFrame:
    """doc_id, text, what is to be kept, and spans: the merged hits of all rules."""
    text, day = F.col("text"), F.lit(as_of).cast("date") if as_of else F.current_date()
    candidates = F.concat(trim_persons(listed_names(text, first_names, surnames).cast(HIT), titles).cast(HIT), dates(text, day).cast(HIT), organisations(text).cast(HIT))
    # One column a step: each is analysed by itself, which deeply nested lambdas would make slow.
    staged, spans = docs.select("doc_id", "text", *keep, F.filter(F.transform(candidates, trimmed), lambda s: s["text"] != "").alias("spans")), F.col("spans")
    addresses, persons = partial(merge_apart, kind="adres"), partial(merge_apart, kind="persoon")
    for step, rule in ((addresses, streets), (replace_contained, house_numbers), (persons, initials_names), (F.concat, references), (persons, titled_names)):
        staged = staged.withColumn("new", rule(text).cast(HIT)).withColumn("spans", step(spans, F.col("new")))
    return staged.withColumn("spans", first_of_equals(spans)).drop("new")


def _ground(kind: Column) -> Column:
    return F.when(kind == "organisatie", "").otherwise(V.GROUND)


def detect(docs: DataFrame, first_names: Sequence[str] = (), surnames: Sequence[str] = (), as_of: str | None = None, titles: Sequence[str] = ()) -> DataFrame:
    """One row per contextual span: doc_id, entity_type, tier, text, start_char, end_char, confidence, woo_article, source, ord.

    Candidates (listed names without function titles, dates, organisations) come first, then streets, house numbers, initials, references and titled names are merged in.
    """
    # Of a plain column Spark infers that it is not empty, and works the whole array out again for each such test.
    numbered = F.transform("spans", lambda s, i: s.withField("ord", i.cast("long")))
    rows = _staged(docs, first_names, surnames, as_of, titles).select("doc_id", F.inline(numbered))
    return rows.select("doc_id", "entity_type", F.lit("2").alias("tier"), "text", "start_char", "end_char", "confidence", _ground(F.col("entity_type")).alias("woo_article"), "source", "ord")


def detect_both(docs: DataFrame, first_names: Sequence[str] = (), surnames: Sequence[str] = (), as_of: str | None = None, titles: Sequence[str] = (), context: bool = False) -> DataFrame:
    """Both tiers of each text in its row, as detect_all puts them together, without a join: each tier is found once, nothing is shuffled.

    context: also the text before and after each hit that decisions look at."""
    held = docs.select("doc_id", "text", tier1.hits(F.col("text"), as_of).alias("hard"))
    staged = _staged(held, first_names, surnames, as_of, titles, "hard")
    place, low = (lambda s: F.concat_ws(":", s["start_char"], s["end_char"])), (lambda s: F.lower(s["text"]))
    flags = [intervals.known(F.transform("spans", of), F.transform("hard", of)).alias(name) for name, of in (("same", place), ("again", low))]
    staged = staged.select("doc_id", "text", "hard", F.arrays_zip("spans", *flags).alias("soft"))
    kind = "array<struct<entity_type:string,tier:string,text:string,start_char:int,end_char:int,confidence:double,woo_article:string,source:string,ord:long>>"

    def row(s: Column, tier: str, confidence: Column, ground: Column, source: Column, order: Column) -> Column:
        return F.struct(s["entity_type"], F.lit(tier), s["text"], s["start_char"], s["end_char"], confidence, ground, source, order.cast("long"))

    raised = lambda x: F.when(x["again"], F.least(F.lit(1.0), F.round(x["spans"]["confidence"] + 0.10, 2))).otherwise(x["spans"]["confidence"])
    hard = F.transform("hard", lambda h: row(h, "1", h["confidence"], h["woo_article"], F.lit("regex"), h["ord"])).cast(kind)
    soft = F.transform(F.filter(F.transform("soft", lambda x, i: x.withField("ord", i)), lambda x: ~x["same"]), lambda x: row(x["spans"], "2", raised(x), _ground(x["spans"]["entity_type"]), x["spans"]["source"], x["ord"])).cast(kind)
    if not context:
        return staged.select("doc_id", F.inline(F.concat(hard, soft)))
    around = lambda own, h: h.withField("before", context_before(own, h["start_char"], V.WINDOW_LIST)).withField("after", context_after(own, h["end_char"], V.WINDOW_TITLE))
    both = staged.withColumn("both", F.concat(hard, soft))
    return both.select("doc_id", F.inline(with_blocks(F.col("text"), lambda own: F.transform("both", lambda h: around(own, h)))))


def detect_all(tier1: DataFrame, tier2: DataFrame) -> DataFrame:
    """Tier 1 and what tier 2 adds: its rows with exactly the offsets of a tier-1 row go, and those whose lower-cased text tier 1 also
    found in the document gain 0.10, up to 1."""
    kept = tier2.join(grown(tier1.select("doc_id", "start_char", "end_char").distinct()), ["doc_id", "start_char", "end_char"], "left_anti")
    known = tier1.select("doc_id", F.lower("text").alias("low"), F.lit(True).alias("known")).distinct()
    raised = kept.withColumn("low", F.lower("text")).join(grown(known), ["doc_id", "low"], "left")
    raised = raised.withColumn("confidence", F.when(F.col("known"), F.least(F.lit(1.0), F.round(F.col("confidence") + 0.10, 2))).otherwise(F.col("confidence")))
    return tier1.unionByName(raised.select(*tier1.columns))
