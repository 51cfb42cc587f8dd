"""Decisions: every span meets the evidence about it (lists, titles, structure) and takes the first branch that fits.

All joins are equi-joins on the document (with a residual interval test) or on normalised values. They sort both sides, since Spark's
estimate of rows made from texts is far too small; only lists of titles and of municipalities' aliases are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkveil.functions import values as V
from inkveil.functions.text import context_after, context_before, digits_only, let, normalise_name, phrase
from inkveil.operators import structure, tier2
from inkveil.operators.containment import with_first_around
from inkveil.operators.groups import grown, written


def contact_key(kind: Column, text: Column) -> Column:
    """How a value is compared with public contact data, by its type."""
    return (
        F.when(kind == "postcode", F.upper(F.replace(text, F.lit(" "), F.lit(""))))
        .when(kind == "telefoon", digits_only(text))
        .when(kind == "url", F.rtrim(F.lower(text), F.lit("/")))
        .when(kind == "adres", normalise_name(F.regexp_replace(text, r"[\p{P}]", " ")))
        .otherwise(F.lower(F.trim(text)))
    )


def with_contacts(spans: DataFrame, contacts: DataFrame) -> DataFrame:
    """Adds public_value: whether the span's value is public contact data (kind, value); for urls also whether it starts with one.

    A url is looked up by its prefixes that end before a slash, question mark or number sign, so the prefix test is an equi-join as
    well; a listed address that is continued within a word (site.nl in site.nlx) does not count.
    """
    listed = contacts.select(F.col("kind").alias("entity_type"), contact_key(F.col("kind"), F.col("value")).alias("key")).distinct()
    key = contact_key(F.col("entity_type"), F.col("text"))
    parts = F.split(key, "(?=[/?#])")
    keys = F.when(F.col("entity_type") == "url", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), ""))).otherwise(F.array(key))
    hits = spans.select("doc_id", "entity_type", "start_char", "end_char", F.explode(keys).alias("key")).join(grown(listed), ["entity_type", "key"], "left_semi")
    hits = hits.select("doc_id", "entity_type", "start_char", "end_char").distinct().withColumn("public_value", F.lit(True))
    return spans.join(grown(hits), ["doc_id", "entity_type", "start_char", "end_char"], "left").withColumn("public_value", F.coalesce("public_value", F.lit(False)))


def with_context(spans: DataFrame, docs: DataFrame | None, **widths: int) -> DataFrame:
    """spans with columns before and after of at least these widths: as detection emitted them, else cut from the texts of docs."""
    missing = [c for c in widths if c not in spans.columns]
    if not missing:
        return spans
    text, cut = F.col("full_text"), {"before": (context_before, "start_char"), "after": (context_after, "end_char")}
    joined = spans.join(grown(docs.select("doc_id", F.col("text").alias("full_text"))), "doc_id")
    return joined.withColumns({c: cut[c][0](text, F.col(cut[c][1]), widths[c]) for c in missing}).drop("full_text")


def with_post_box(spans: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Adds post_box: whether a postcode follows 'Postbus N'. Spans that carry the text before them need no docs."""
    near = with_context(spans, docs, before=30)
    return near.withColumn("post_box", (F.col("entity_type") == "postcode") & F.right("before", F.lit(30)).rlike(V.POST_BOX)).drop("before")


def tier1_status(spans: DataFrame, docs: DataFrame | None, contacts: DataFrame) -> DataFrame:
    """Adds review_status, and for public values source and an empty ground."""
    known = with_post_box(with_contacts(spans, contacts), docs)
    public = F.col("public_value") | F.col("post_box")
    status = F.when(public, "rejected").when(F.col("entity_type") == "kvk", "pending").otherwise("auto_accepted")
    return known.withColumn("review_status", status).withColumn("woo_article", F.when(~public, F.col("woo_article"))).withColumn("source", F.when(public, "whitelist_gemeente").otherwise(F.col("source"))).drop("public_value", "post_box")


def reference_matches(persons: DataFrame, names: DataFrame) -> DataFrame:
    """The persons whose normalised name is on the document's reference list (doc_id, name)."""
    listed = names.select("doc_id", normalise_name(F.col("name")).alias("norm")).distinct()
    return persons.withColumn("norm", normalise_name(F.col("text"))).join(grown(listed), ["doc_id", "norm"], "left_semi").drop("norm")


def surname_of(text: Column) -> Column:
    """A span's name without parts in brackets, forms of address and initials, folded and in lower case."""
    tokens = F.split(F.trim(F.regexp_replace(text, r"\([^)]*\)", " ")), r"(?U)\s+")
    kept = F.filter(tokens, lambda t: ~F.lower(F.rtrim(t, F.lit("."))).isin(*V.HONORIFICS, "familie") & ~t.rlike(r"^(?:[A-Z]\.)+$") & ~t.rlike(r"^\p{L}$"))
    return phrase(F.array_join(kept, " "))


def municipality_aliases(municipalities: DataFrame) -> DataFrame:
    """gm_code, alias from (gm_code, name, short): the name, it with 'gemeente' before it or without, and the short form, alone if it has
    five characters or more."""
    short = F.trim(F.regexp_replace("short", r"\s*\([^)]*\)", ""))
    other = F.when(F.lower("name").startswith("gemeente "), F.substring("name", 10, 1000)).otherwise(F.concat(F.lit("Gemeente "), "name"))
    forms = F.array(F.col("name"), other, F.concat(F.lit("Gemeente "), short), F.when(F.length(short) >= 5, short))
    return municipalities.select("gm_code", F.explode(forms).alias("alias")).select("gm_code", phrase(F.col("alias")).alias("alias")).filter("alias <> ''").distinct()


def active_municipalities(docs: DataFrame, aliases: DataFrame) -> DataFrame:
    """doc_id, gm_code: the municipalities that a text names by one of their aliases, at word edges.

    Runs of as many words as aliases have (their lengths are a handful) meet the aliases by an equi-join.
    """
    listed = aliases.select("gm_code", "alias").distinct()
    lengths = sorted(r[0] for r in listed.select(F.size(F.split("alias", " "))).distinct().collect())
    words = F.split(phrase(F.col("text")), " ")

    def runs(own: Column, n: int) -> Column:
        return F.when(F.size(own) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(own) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(own, i, n), " "))).otherwise(F.array().cast("array<string>"))

    grams = let(words, lambda own: F.array_distinct(F.concat(*[runs(own, n) for n in lengths]) if lengths else F.array().cast("array<string>")))
    return docs.select("doc_id", F.explode(grams).alias("alias")).join(F.broadcast(listed), "alias").select("doc_id", "gm_code").distinct()


def official_matches(persons: DataFrame, docs: DataFrame, officials: DataFrame) -> DataFrame:
    """Persons whose surname ends with an official's of an active municipality, initials permitting; the first (gm_code, surname) wins.

    A common surname needs visible initials that agree with the official's as far as both go; for others, initials that both
    have must begin alike. docs: (doc_id, gm_code, text) with the municipalities a document names. Suffixes of the span's surname
    make the join an equi-join.
    """
    near, runs = with_context(persons, docs, before=30), lambda c: F.regexp_extract_all(c, F.lit(r"(?:[A-Z]\.){1,4}"), F.lit(0))
    seen = F.lower(F.replace(F.coalesce(F.try_element_at(runs(F.right("before", F.lit(30))), F.lit(-1)), F.try_element_at(runs(F.col("text")), F.lit(-1)), F.lit("")), F.lit("."), F.lit("")))
    own = near.join(grown(docs.select("doc_id", "gm_code")), "doc_id").select("doc_id", "start_char", "end_char", "text", "gm_code", seen.alias("seen"), surname_of(F.col("text")).alias("whole"))
    tokens = F.split("whole", " ")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda i: F.array_join(F.slice(tokens, i, F.size(tokens)), " "))
    own = own.withColumn("surname", F.explode(suffixes)).filter("surname <> ''")
    listed = officials.select("gm_code", phrase(F.col("surname")).alias("surname"), F.lower("initials").alias("initials"))
    both = F.least(F.length("seen"), F.length("initials"))
    agree = F.when(F.col("whole").isin(*V.COMMON_SURNAMES), (both > 0) & (F.left("seen", both) == F.left("initials", both))).otherwise((both == 0) | (F.left("seen", F.lit(1)) == F.left("initials", F.lit(1))))
    fits = own.join(grown(listed), ["gm_code", "surname"]).filter(agree)
    best = F.min(F.struct("gm_code", "surname", "initials")).alias("o")
    return fits.groupBy("doc_id", "start_char", "end_char", "text").agg(best).select("doc_id", "start_char", "end_char", "text", "o.gm_code", "o.surname")


def _tokens_between(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda t: t != ""))


def title_matches(persons: DataFrame, docs: DataFrame, titles: DataFrame) -> DataFrame:
    """The nearest function title of each person: doc_id, start_char, end_char, text, list_name, title, position, tokens.

    Titles within 40 characters before or after the span with at most two tokens between; before it also titles up to 240 characters
    away where only a list of names lies between. Before beats after, public beats civil servant, then fewer tokens, then list order.
    titles: (list_name, title, ord), the lists of function titles; they are broadcast, as the persons with their contexts must never be.
    """
    # A title can only be in a window that holds it, so the window's words pick the titles by an equi-join on the first word.
    near = with_context(persons, docs, before=V.WINDOW_LIST, after=V.WINDOW_TITLE).select(
        "doc_id", "start_char", "end_char", "text", F.right("before", F.lit(V.WINDOW_LIST)).alias("list_before"), F.right("before", F.lit(V.WINDOW_TITLE)).alias("before"), F.left("after", F.lit(V.WINDOW_TITLE)).alias("after"))
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "list_before", "after")), F.lit(r"(?U)\w+"), F.lit(0)))
    listed = titles.withColumn("word", F.regexp_extract(F.lower("title"), r"(?U)\w+", 0))
    pairs = near.withColumn("word", F.explode(words)).join(F.broadcast(listed), "word")
    pattern = F.concat(F.lit(r"(?iU)\b"), F.array_join(F.split(F.col("title"), r"\s+"), r"\s+"), F.lit(r"\b"))
    pieces = lambda c: F.call_function("split", F.col(c), pattern, F.lit(-1))
    pairs = pairs.select("*", pieces("before").alias("pb"), pieces("list_before").alias("pl"), pieces("after").alias("pa"))
    narrow = F.when((F.size("pb") > 1) & (_tokens_between(F.element_at("pb", -1)) <= V.MOST_TOKENS_BETWEEN), F.struct(F.lit("before").alias("position"), _tokens_between(F.element_at("pb", -1)).alias("tokens")))
    # Collapsed white space matches alike, and leaves the pattern nothing to try in many ways.
    inside = F.regexp_replace(F.ltrim(F.element_at("pl", -1), F.lit(": ")), r"(?U)\s+", " ")
    listing = F.when((F.size("pl") > 1) & narrow.isNull() & (inside != "") & inside.rlike(V.LIST_INSIDE), F.struct(F.lit("before").alias("position"), _tokens_between(inside).alias("tokens")))
    behind = F.when((F.size("pa") > 1) & (_tokens_between(F.element_at("pa", 1)) <= V.MOST_TOKENS_BETWEEN), F.struct(F.lit("after").alias("position"), _tokens_between(F.element_at("pa", 1)).alias("tokens")))
    found = pairs.select("doc_id", "start_char", "end_char", "text", "list_name", "title", "ord", F.explode(F.filter(F.array(narrow, listing, behind), lambda s: s.isNotNull())).alias("m"))
    order = W.partitionBy("doc_id", "start_char", "end_char").orderBy((F.col("m.position") == "before").desc(), (F.col("list_name") == "publiek").desc(), F.col("m.tokens"), F.col("ord"))
    return found.withColumn("rank", F.row_number().over(order)).filter("rank = 1").select("doc_id", "start_char", "end_char", "text", "list_name", "title", "m.position", "m.tokens")


def leading_titles(persons: DataFrame, titles: DataFrame) -> DataFrame:
    """Persons whose span begins with a function title and goes on after it, as title_matches gives them; public titles first, then list order."""
    listed = titles.withColumn("word", F.regexp_extract(F.lower("title"), r"(?U)\w+", 0))
    own = persons.select("doc_id", "start_char", "end_char", "text", F.regexp_extract(F.lower("text"), r"(?U)^\s*(\w+)", 1).alias("word")).join(F.broadcast(listed), "word")
    pattern = F.concat(F.lit(r"(?iU)^\s*"), F.array_join(F.split(F.col("title"), r"\s+"), r"\s+"), F.lit(r"\b"))
    rest = F.regexp_replace(F.col("text"), pattern, F.lit(""))
    best = F.min_by(F.struct("list_name", "title"), F.struct((F.col("list_name") != "publiek").alias("late"), "ord")).alias("t")
    found = own.filter((rest != F.col("text")) & (F.trim(rest) != "")).groupBy("doc_id", "start_char", "end_char", "text").agg(best)
    return found.select("doc_id", "start_char", "end_char", "text", "t.list_name", "t.title", F.lit("before").alias("position"), F.lit(0).alias("tokens"))


def title_evidence(persons: DataFrame, docs: DataFrame, titles: DataFrame) -> DataFrame:
    """The nearest title of each person, and where there is none, the one that the span itself begins with."""
    near = title_matches(persons, docs, titles)
    return near.unionByName(leading_titles(persons, titles).join(grown(near), ["doc_id", "start_char", "end_char"], "left_anti"))


def enclosing(spans: DataFrame, structures: DataFrame) -> DataFrame:
    """Each span with the kind of the structure around it: the first by start, salutations last."""
    salutation = F.col("kind") == "salutation"
    swept = with_first_around(spans.select("doc_id", "start_char", "end_char").distinct(), structures, {"early": ~salutation, "late": salutation})
    return swept.select("doc_id", "start_char", "end_char", F.coalesce("early", "late").alias("kind")).filter("kind is not null")


def classify_persons(persons: DataFrame, docs: DataFrame, names: DataFrame, officials: DataFrame, titles: DataFrame, structures: DataFrame) -> DataFrame:
    """Persons with review_status, subject_role, confidence, source and ground by the first of: reference list, official, public title,
    header or signature, salutation, civil servant's title, none.

    Each kind of evidence looks at the persons, so they are written once; finding them costs far more than reading them again."""
    at, persons = ["doc_id", "start_char", "end_char"], written(persons, "persons")
    flags = (
        persons.join(grown(reference_matches(persons, names).select(*at).distinct().withColumn("listed", F.lit(True))), at, "left")
        .join(grown(official_matches(persons, docs, officials).select(*at).distinct().withColumn("official", F.lit(True))), at, "left")
        .join(grown(title_evidence(persons, docs, titles).select(*at, "list_name").distinct()), at, "left")
        .join(grown(enclosing(persons, structures)), at, "left")
    )
    case = (
        F.when(F.col("listed"), F.lit("reference"))
        .when(F.col("official"), F.lit("official"))
        .when(F.col("list_name") == "publiek", F.lit("public_title"))
        .when(F.col("kind").isin("email_header", "signature_block"), F.lit("structure"))
        .when(F.col("kind") == "salutation", F.lit("salutation"))
        .when(F.col("list_name") == "ambtenaar", F.lit("servant"))
        .otherwise(F.lit("none"))
    )
    rows = {  # branch: status, role, what the confidence gains (None: it becomes .95), source, whether a ground is left
        "reference": ("rejected", "publiek_functionaris", None, "reference_list", False),
        "official": ("rejected", "publiek_functionaris", 0.05, "whitelist_gemeente", False),
        "public_title": ("rejected", "publiek_functionaris", 0.05, "rule", False),
        "structure": ("auto_accepted", None, 0.15, "structure", True),
        "salutation": ("pending", "burger", 0.10, "structure", True),
        "servant": ("pending", "ambtenaar", 0.0, "rule", True),
        "none": ("pending", None, 0.0, "ner", True),
    }

    def pick(i: int) -> Column:
        out = F.lit(None)
        for name, row in rows.items():
            out = F.when(F.col("branch") == name, F.lit(row[i])).otherwise(out)
        return out

    gain = pick(2).cast("double")
    confidence = F.when(gain.isNull(), 0.95).when(gain == 0, F.col("confidence")).otherwise(F.round(F.least(F.col("confidence") + gain, F.lit(0.95)), 2))
    out = flags.withColumn("branch", case)
    return out.select(*at, "text", "branch", pick(0).alias("review_status"), pick(1).cast("string").alias("subject_role"), confidence.alias("confidence"), pick(3).alias("source"), F.when(pick(4).cast("boolean"), F.lit(V.GROUND)).alias("woo_article"))


def other_status(spans: DataFrame, docs: DataFrame, contacts: DataFrame) -> DataFrame:
    """Contextual spans that are no persons: public values are rejected, the rest waits for review with the default ground."""
    known = with_post_box(with_contacts(spans.filter("entity_type <> 'persoon'"), contacts), docs)
    public = F.col("public_value") | F.col("post_box")
    return known.withColumn("review_status", F.when(public, "rejected").otherwise("pending")).withColumn("woo_article", F.when(~public, F.coalesce(F.expr("nullif(woo_article, '')"), F.lit(V.GROUND)))).drop("public_value", "post_box")


def route(spans: DataFrame, docs: DataFrame, contacts: DataFrame, names: DataFrame, officials: DataFrame, titles: DataFrame, structures: DataFrame) -> DataFrame:
    """All detections of both tiers with their decision, each by the rule of its tier and type. The spans are written once for all rules."""
    spans = written(spans, "spans")
    out = ["doc_id", "entity_type", "tier", "text", "start_char", "end_char", "confidence", "woo_article", "source", "review_status"]
    hard = tier1_status(spans.filter("tier = '1'"), docs, contacts).select(*out)
    other = other_status(spans.filter("tier = '2'"), docs, contacts).select(*out)
    persons = classify_persons(spans.filter("tier = '2' and entity_type = 'persoon'"), docs, names, officials, titles, structures)
    people = persons.select("doc_id", F.lit("persoon").alias("entity_type"), F.lit("2").alias("tier"), *out[3:])
    return hard.unionByName(other).unionByName(people)


def decide(
    docs: DataFrame, contacts: DataFrame, names: DataFrame, officials: DataFrame, titles: DataFrame, aliases: DataFrame,
    first_names: Sequence[str] = (), surnames: Sequence[str] = (), as_of: str | None = None, title_words: Sequence[str] = (),
) -> DataFrame:
    """From documents (doc_id, text) to the decisions on all their detections, as route gives them.

    Both tiers are found in one pass over the texts, with the context that decisions look at; the municipalities whose officials count are those that a text
    names by an alias (gm_code, alias); structures come from a pass over the lines.
    """
    spans = tier2.detect_both(docs, first_names, surnames, as_of, title_words, context=True)
    return route(spans, active_municipalities(docs, aliases), contacts, names, officials, titles, structure.detect(docs))
