"""Summaries, logs and redacted texts of detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkveil.functions import intervals
from inkveil.functions import values as V
from inkveil.functions.text import cut_blocks, let

REPORTABLE = ("accepted", "auto_accepted")
LABELS = {
    "persoon": "Persoon", "bsn": "BSN", "telefoon": "Telefoonnummer", "email": "E-mailadres", "adres": "Adres", "iban": "IBAN", "postcode": "Postcode", "kenteken": "Kenteken", "kvk": "KvK-nummer",
    "btw": "Btw-nummer", "geboortedatum": "Geboortedatum", "creditcard": "Creditcard", "url": "URL", "datum": "Datum", "organisatie": "Organisatie", "referentie": "Referentie",
}


def label(kind: Column) -> Column:
    """A type's label, else the type itself."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[kind], kind)


def level(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "high").when(confidence >= 0.6, "medium").otherwise("low")


def counts(detections: DataFrame) -> DataFrame:
    """dimension, value, n by tier, status, type and in total, in one pass of grouping sets."""
    sets = detections.select("tier", "review_status", "entity_type").groupingSets([["tier"], ["review_status"], ["entity_type"], []], "tier", "review_status", "entity_type").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    name = F.when(F.col("g") == 3, "tier").when(F.col("g") == 5, "status").when(F.col("g") == 6, "type").otherwise("total")
    return sets.select(name.alias("dimension"), F.coalesce("tier", "review_status", "entity_type", F.lit("all")).alias("value"), "n")


def breakdown(detections: DataFrame) -> DataFrame:
    """One row: reviewable, rejected, pending, deferred, reviewed, high-confidence pending."""
    n = lambda c, a: F.count_if(F.expr(c)).alias(a)
    return detections.agg(n("review_status in ('accepted', 'auto_accepted', 'edited')", "reviewable"), n("review_status = 'rejected'", "rejected"), n("review_status = 'pending'", "pending"), n("review_status = 'deferred'", "deferred"), n("review_status not in ('pending', 'deferred')", "reviewed"), n("review_status = 'pending' and tier = '2' and confidence >= 0.85", "high_pending"))


def summary(detections: DataFrame) -> DataFrame:
    """dimension, value, n over reportable rows: by ground (rows without one not), by tier (all three, zeros too), by source and by label."""
    by = {
        "ground": F.expr("nullif(woo_article, '')"), "tier": F.col("tier"), "label": label(F.col("entity_type")),
        "source": F.when(F.col("source").isin("manual", "search_redact"), "handmatig").otherwise("auto"),
    }
    keys = F.array(*[F.struct(F.lit(d).alias("d"), v.alias("v")) for d, v in by.items()])
    rows = detections.filter(F.col("review_status").isin(*REPORTABLE)).select(F.inline(keys)).filter("v is not null")
    zeros = detections.sparkSession.createDataFrame([("tier", t, 0) for t in "123"], "d string, v string, n long")
    found = rows.groupBy("d", "v").agg(F.count("*").alias("n")).unionByName(zeros)
    return found.groupBy(F.col("d").alias("dimension"), F.col("v").alias("value")).agg(F.sum("n").alias("n"))


def grounds(detections: DataFrame) -> DataFrame:
    """doc_id, grounds: the sorted distinct grounds of reportable rows, joined; null if none."""
    shown = F.when(F.col("review_status").isin(*REPORTABLE), F.col("woo_article"))
    return detections.groupBy("doc_id").agg(F.nullif(F.array_join(F.array_sort(F.collect_set(shown)), ", "), F.lit("")).alias("grounds"))


def filtered(detections: DataFrame, tier: str | None = None, status: str | None = None, kind: str | None = None, source: str | None = None, ground: str | None = None, page: int | None = None) -> DataFrame:
    """The log's filter: the conditions that are given, together; a null source counts as regex; a page (counted from 1) is that of any box."""
    out = detections if page is None else detections.filter(F.exists("boxes", lambda b: b["page"] == page - 1))
    for column, value in (("tier", tier), ("review_status", status), ("entity_type", kind), ("woo_article", ground)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    return out if source is None else out.filter(F.coalesce("source", F.lit("regex")) == source)


def numbered(detections: DataFrame) -> DataFrame:
    """Rows with nr, their place within their document: by start, end and type."""
    return detections.withColumn("nr", F.row_number().over(W.partitionBy("doc_id").orderBy("start_char", "end_char", "entity_type")).cast("long"))


def _quoted(value: Column) -> Column:
    return F.when(value.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def csv_lines(detections: DataFrame) -> DataFrame:
    """doc_id, nr, line: the redaction log of reportable rows, quoted where needed."""
    rows = numbered(detections.filter(F.col("review_status").isin(*REPORTABLE)))
    hand = F.when(F.col("source").isin("manual", "search_redact"), "handmatig").otherwise("auto")
    cells = [F.col("nr").cast("string"), label(F.col("entity_type")), F.coalesce("woo_article", F.lit("")), F.col("tier"), hand, F.col("text")]
    return rows.select("doc_id", "nr", F.concat_ws(",", *map(_quoted, cells)).alias("line"))


def json_documents(detections: DataFrame) -> DataFrame:
    """doc_id, json: counts by tier and status, and the rows of a document."""
    row = F.struct("start_char", "end_char", "entity_type", "tier", "review_status")
    held = detections.groupBy("doc_id").agg(F.count("*").alias("total"), F.array_sort(F.collect_list(row)).alias("detections"))

    def by(field: str) -> Column:
        values = F.array_sort(F.array_distinct(F.transform("detections", lambda d: d[field])))
        return F.map_from_entries(F.transform(values, lambda v: F.struct(v, F.size(F.filter("detections", lambda d: d[field] == v))))).alias(f"by_{field.split('_')[-1]}")

    return held.select("doc_id", F.to_json(F.struct("total", by("tier"), by("review_status"), "detections")).alias("json"))


def xml_text(value: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        value = F.replace(value, F.lit(raw), F.lit(safe))
    return value


def xml_documents(docs: DataFrame) -> DataFrame:
    """doc_id, xml: publication elements of (doc_id, title, creator); the keyword is the title's first word of four letters or more."""
    keyword = F.try_element_at(F.filter(F.split("title", r"\s+"), lambda w: F.length(w) >= 4), F.lit(1))
    tag = lambda name, v: F.concat(F.lit(f"<{name}>"), xml_text(v), F.lit(f"</{name}>"))
    return docs.select("doc_id", F.concat(F.lit("<document>"), tag("title", F.col("title")), tag("creator", F.col("creator")), F.coalesce(tag("keyword", keyword), F.lit("")), F.lit("</document>")).alias("xml"))


def redact(docs: DataFrame, detections: DataFrame, block: str = "█") -> DataFrame:
    """doc_id, text, n: texts whose reportable ranges are block characters; n is the number of distinct ranges.

    Overlapping ranges are joined first. Each block of a text is put together from the parts of ranges within it, so a range far
    behind costs no more than one in front.
    """
    ranges = detections.filter(F.col("review_status").isin(*REPORTABLE)).groupBy("doc_id").agg(F.collect_set(F.struct(F.col("start_char").cast("int").alias("start_char"), F.col("end_char").cast("int").alias("end_char"))).alias("ranges"))
    held = docs.select("doc_id", "text").join(ranges, "doc_id", "left").withColumn("ranges", F.coalesce("ranges", F.array().cast("array<struct<start_char:int,end_char:int>>")))
    done = F.when(F.size("ranges") == 0, F.col("text")).otherwise(painted(F.col("text"), intervals.joined(F.col("ranges")), block))
    return held.select("doc_id", done.alias("text"), F.size("ranges").cast("long").alias("n"))


def painted(text: Column, ranges: Column, block: str) -> Column:
    """The text with its sorted, disjoint ranges as block characters."""
    width = 2048
    first = lambda r: F.greatest(r["start_char"], F.lit(0))

    def pieces(r: Column) -> Column:
        """A range cut at the borders of blocks: the block's number, and begin and end within it."""
        numbers = F.sequence((first(r) / width).cast("int"), ((r["end_char"] - 1) / width).cast("int"))
        return F.transform(numbers, lambda k: F.struct(k.alias("k"), F.greatest(first(r) - k * width, F.lit(0)).alias("a"), F.least(r["end_char"] - k * width, F.lit(width)).alias("b")))

    def of_block(here: Column, k: Column, own: Column, upto: Column) -> Column:
        """One block: what stands before each piece, block characters for it, and the rest."""
        before = F.when(k == 0, F.lit(0)).otherwise(F.get(upto, k - 1))

        def put(mine: Column) -> Column:
            gap = lambda p, i: F.when(i == 0, F.lit(0)).otherwise(F.get(mine, i - 1)["b"])
            parts = F.transform(mine, lambda p, i: F.concat(here.substr(gap(p, i) + 1, p["a"] - gap(p, i)), F.repeat(F.lit(block), p["b"] - p["a"])))
            return F.concat(F.array_join(parts, ""), here.substr(F.coalesce(F.try_element_at(mine, F.lit(-1))["b"], F.lit(0)) + 1, F.lit(width)))

        return let(F.slice(own, before + 1, F.get(upto, k) - before), put)

    def whole(own: Column, length: Column) -> Column:
        counts = F.transform(own, lambda p, i: F.struct(p["k"].alias("start_char"), (i + 1).alias("end_char")))
        numbers = F.sequence(F.lit(0), (F.greatest(length - 1, F.lit(0)) / width).cast("int"))
        upto = F.transform(intervals.reaches(counts, numbers, inclusive=True), lambda n: F.greatest(n, F.lit(0)))
        return let(upto, lambda u: F.array_join(F.transform(cut_blocks(text, width, width), lambda here, k: of_block(here, k, own, u)), ""))

    def within(length: Column) -> Column:
        inside = F.filter(F.transform(ranges, lambda r: r.withField("end_char", F.least(r["end_char"], length))), lambda r: r["end_char"] > first(r))
        return let(F.flatten(F.transform(inside, pieces)), lambda own: whole(own, length))

    return let(F.length(text), within)


def buckets(values: DataFrame, column: str, edges: tuple[int, ...] = (0, 10, 50, 100)) -> DataFrame:
    """bucket, n: how many values lie at or above each edge and below the next."""
    name = F.lit(f"<{edges[0]}")
    for e in edges:
        name = F.when(F.col(column) >= e, f">={e}").otherwise(name)
    return values.groupBy(name.alias("bucket")).agg(F.count("*").alias("n"))


def missing_fields(records: DataFrame, required: tuple[str, ...], key: str = "doc_id") -> DataFrame:
    """key, missing: the names of required fields that are null or blank, in their order, joined; null if none."""
    names = F.filter(F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in required]), lambda n: n.isNotNull())
    return records.select(key, F.nullif(F.array_join(names, ", "), F.lit("")).alias("missing"))


def export_name(name: Column) -> Column:
    """A file name for a redacted copy: without folders and unusual characters, of at most 100 characters, with a prefix."""
    base = F.regexp_replace(F.element_at(F.split(name, r"[/\\]"), -1), r"[^A-Za-z0-9._-]+", "_")
    return F.concat(F.lit("gelakt_"), F.when(base == "", "document").otherwise(F.left(base, F.lit(100))))


def per_period(events: DataFrame) -> DataFrame:
    """year, month, status, n with subtotals (null: all), by rollup. events: (ts, status)."""
    return events.select(F.year("ts").alias("year"), F.month("ts").alias("month"), "status").rollup("year", "month", "status").agg(F.count("*").alias("n"))


def _by_code(column: Column, values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[column]


def ground_name(code: Column) -> Column:
    return _by_code(code, {c: g[0] for c, g in V.GROUNDS.items()})


def ground_kind(code: Column) -> Column:
    """absolute, relative, special or residual; null for an unknown code."""
    return _by_code(code, {c: g[1] for c, g in V.GROUNDS.items()})


def ground_label(code: Column) -> Column:
    """'Art. code — name', for an unknown code 'Art. code'."""
    return F.concat(F.lit("Art. "), code, F.coalesce(F.concat(F.lit(" — "), ground_name(code)), F.lit("")))


def motivation(code: Column, missing: str) -> Column:
    """The ground as a sentence of the log; `missing` where there is none (null or empty)."""
    return F.when(F.coalesce(code, F.lit("")) == "", missing).otherwise(ground_label(code))


def redaction_label(code: Column) -> Column:
    """What a reader of a redacted file is told: codes written 5.1.2.e count as 5.1.2e; a general sentence for others."""
    key = F.regexp_replace(F.lower(F.replace(code, F.lit(" "), F.lit(""))), r"\.(?=[a-z]$)", "")
    name = _by_code(key, V.SHORT_GROUNDS)
    return F.coalesce(F.concat(F.lit("Gelakt — Artikel "), code, F.lit(" — "), name), F.lit("Gelakt op grond van de Wet open overheid"))


def ground_choices(detections: DataFrame) -> DataFrame:
    """det_id, tier, code, name, kind, place: the grounds that each detection's tier offers, in the order of their codes."""
    rows = [(g[2], c, g[0], g[1]) for c, g in V.GROUNDS.items()]
    listed = detections.sparkSession.createDataFrame(rows, "tier string, code string, name string, kind string")
    placed = listed.withColumn("place", F.row_number().over(W.partitionBy("tier").orderBy("code")).cast("long"))
    return detections.select("det_id", "tier").join(F.broadcast(placed), "tier").select("det_id", "tier", "code", "name", "kind", "place")  # twelve rows


def by_hand(source: Column) -> Column:
    return F.coalesce(source.isin("manual", "search_redact"), F.lit(False))


def first_page(boxes: Column) -> Column:
    return F.get(boxes, F.lit(0))["page"]


#: What the log can be sorted by: for each key the columns, first to last.
def _sort_columns(key: str) -> list[Column]:
    page = F.coalesce(first_page(F.col("boxes")), F.lit(-1))
    keys = {
        "index": [page, F.col("tier"), F.col("det_id")],
        "page": [page],
        "entity_type": [label(F.col("entity_type"))],
        "tier": [F.col("tier")],
        "woo_article": [F.coalesce("woo_article", F.lit(""))],
        "review_status": [F.col("review_status")],
        "source": [F.coalesce("source", F.lit(""))],
        "reviewed_at": [F.coalesce(F.col("reviewed_at").cast("timestamp"), F.to_timestamp(F.lit("1970-01-01")))],
    }
    return keys[key]


SORT_KEYS = ("index", "page", "entity_type", "tier", "woo_article", "review_status", "source", "reviewed_at")


def log_order(detections: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """Rows with place (from 1) within their document's log, sorted by one of SORT_KEYS; rows that tie stand in the order of det_id."""
    order = [c.desc() if descending else c.asc() for c in _sort_columns(key)]
    return detections.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy(*order, "det_id")).cast("long"))


def reading_place(detections: DataFrame) -> DataFrame:
    """Rows with nr, their place in a document's report: page (those without a box last), height, id."""
    first = F.get("boxes", F.lit(0))
    order = W.partitionBy("doc_id").orderBy(first["page"].asc_nulls_last(), F.coalesce(first["y0"], F.lit(0.0)), "det_id")
    return detections.withColumn("nr", F.row_number().over(order).cast("long"))


def report_rows(detections: DataFrame) -> DataFrame:
    """doc_id, nr, page (from 1, 0 without a box), label, tier, ground, source, source_label, motivation of reportable rows."""
    rows = reading_place(detections.filter(F.col("review_status").isin(*REPORTABLE)))
    source = F.when(F.coalesce("source", F.lit("")) == "", "—").otherwise(F.coalesce(_by_code(F.col("source"), V.SOURCE_LABELS), F.col("source")))
    return rows.select("doc_id", "nr", (F.coalesce(first_page(F.col("boxes")), F.lit(-1)) + 1).alias("page"), label(F.col("entity_type")).alias("label"), "tier", F.col("woo_article").alias("ground"), F.when(by_hand(F.col("source")), "handmatig").otherwise("auto").alias("source"), source.alias("source_label"), motivation(F.col("woo_article"), "Geen Woo-grond gekoppeld — handmatig vastgesteld").alias("motivation"))


CSV_COLUMNS = ("#", "pagina", "type", "trap", "woo_artikel", "grond", "status", "bron", "beoordeeld_op", "bbox_count", "motivatie")


def csv_log(detections: DataFrame) -> DataFrame:
    """doc_id, nr, line: the redaction log with its eleven columns (CSV_COLUMNS) in the order of det_id, quoted where needed; nr 0 is the head."""
    shown = detections.filter(F.col("review_status").isin(*REPORTABLE))
    rows = shown.withColumn("nr", F.row_number().over(W.partitionBy("doc_id").orderBy("det_id")).cast("long"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    cells = [text(F.col("nr")), text(first_page(F.col("boxes"))), label(F.col("entity_type")), F.col("tier"), text(F.col("woo_article")), text(ground_name(F.col("woo_article"))), F.col("review_status"), text(F.col("source")), text(F.col("reviewed_at")), text(F.size("boxes")), motivation(F.col("woo_article"), "Geen Woo-artikel gekoppeld")]
    head = shown.select("doc_id").distinct().select("doc_id", F.lit(0).cast("long").alias("nr"), F.lit(",".join(CSV_COLUMNS)).alias("line"))
    return rows.select("doc_id", "nr", F.concat_ws(",", *map(_quoted, cells)).alias("line")).unionByName(head)


def redaction_boxes(detections: DataFrame) -> DataFrame:
    """doc_id, det_id, page, x0, y0, x1, y1, woo_article: one row for each box of reportable rows; no ground is an empty one."""
    shown = detections.filter(F.col("review_status").isin(*REPORTABLE)).select("doc_id", "det_id", F.coalesce("woo_article", F.lit("")).alias("woo_article"), F.inline("boxes"))
    return shown.select("doc_id", "det_id", "page", "x0", "y0", "x1", "y1", "woo_article")


def responses(detections: DataFrame) -> DataFrame:
    """Rows as a client gets them: id (a hash of document, type and place, so that a second run gives the same; of rows without a place, which
    reviewers made, of their det_id), audit fields null."""
    place = F.col("start_char").cast("string"), F.col("end_char").cast("string")
    made = F.concat_ws("|", F.lit("det"), F.col("det_id").cast("string")) if "det_id" in detections.columns else F.lit("")
    unplaced = F.when(F.col("start_char").isNull() | F.col("end_char").isNull(), made)
    key = F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "entity_type", *place, unplaced), 256)
    empty = [F.lit(None).cast("string").alias(c) for c in ("reviewer_id", "reviewed_at", "propagated_from", "split_from")]
    return detections.select(key.alias("id"), "doc_id", "entity_type", "tier", "confidence", "woo_article", "review_status", "source", "start_char", "end_char", *empty)


def stripped(detections: DataFrame) -> DataFrame:
    """Rows as they are kept: without the text itself and the level derived from confidence."""
    return detections.drop("entity_text", "text", "confidence_level")


def progress(detections: DataFrame) -> DataFrame:
    """tier, reviewed, total, pending, high_pending, not_rejected, accepted."""
    n = lambda c, a: F.count_if(F.expr(c)).alias(a)
    return detections.groupBy("tier").agg(n("review_status not in ('pending', 'deferred')", "reviewed"), F.count("*").alias("total"), n("review_status = 'pending'", "pending"), n("review_status = 'pending' and confidence >= 0.85", "high_pending"), n("review_status <> 'rejected'", "not_rejected"), n("review_status = 'accepted'", "accepted"))


def log_statistics(detections: DataFrame) -> DataFrame:
    """dimension, value, n of a filtered log: by status, tier, ground (null ones not) and hand or auto."""
    hand = F.when(by_hand(F.col("source")), "manual").otherwise("auto")
    pairs = [("status", F.col("review_status")), ("tier", F.col("tier")), ("ground", F.col("woo_article")), ("source", hand)]
    rows = detections.select(F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("value")) for d, v in pairs])))
    return rows.filter("value is not null").groupBy("dimension", "value").agg(F.count("*").alias("n"))


def page_progress(pages: DataFrame, detections: DataFrame) -> DataFrame:
    """doc_id, progress: 'complete/total pages' of (doc_id, page, status), with the open detections if there are any."""
    done = pages.groupBy("doc_id").agg(F.count_if(F.col("status") == "complete").alias("done"), F.count("*").alias("total"))
    open_ = detections.groupBy("doc_id").agg(F.count_if(F.col("review_status") == "pending").alias("open"))
    base = F.format_string("%d/%d pagina's beoordeeld", "done", "total")
    return done.join(open_, "doc_id", "left").select("doc_id", F.when(F.col("open") > 0, F.concat(base, F.format_string(" · %d detecties openstaand", "open"))).otherwise(base).alias("progress"))


def page_label(boxes: Column) -> Column:
    """The lowest page (from 1) that a box is on, or a dash."""
    return F.coalesce((F.array_min(F.transform(boxes, lambda b: b["page"])) + 1).cast("string"), F.lit("—"))


def term_hits(terms: DataFrame, detections: DataFrame) -> DataFrame:
    """term, n: detections from the term list whose reasoning quotes the term. The quoted text is cut out, so the join is an equi-join."""
    quoted = detections.filter("source = 'custom_wordlist'").select(F.explode(F.array_distinct(F.regexp_extract_all("reasoning", F.lit("'([^']*)'"), F.lit(1)))).alias("term"))
    return terms.select("term").distinct().join(quoted.groupBy("term").agg(F.count("*").alias("n")), "term", "left").select("term", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def annotations(detections: DataFrame) -> DataFrame:
    """det_id, nr, article, label, analysis: the lines '[article] label: analysis' of a reasoning; other lines are left out."""
    lines = detections.select("det_id", F.posexplode(F.split("reasoning", "\n")).alias("nr", "line")).filter("startswith(line, '[')")
    part = lambda k: F.regexp_extract("line", r"\[([^\]]+)\]\s*(.*?):\s*(.*)", k)
    return lines.filter(part(1) != "").select("det_id", F.col("nr").cast("long").alias("nr"), part(1).alias("article"), part(2).alias("label"), part(3).alias("analysis"))


def highlighted(context: Column, match: Column) -> Column:
    """struct(before, match, after): the first place of a match in its context, in any case; all is before if there is none."""
    at = F.call_function("locate", F.lower(match), F.lower(context))
    found = F.struct(F.left(context, at - 1).alias("before"), context.substr(at, F.length(match)).alias("match"), context.substr(at + F.length(match), F.length(context)).alias("after"))
    return F.when(at > 0, found).otherwise(F.struct(context.alias("before"), F.lit("").alias("match"), F.lit("").alias("after")))


def cleaned(value: Column, most: int) -> Column:
    """Trimmed and cut to `most` characters; blanks become null."""
    return F.left(F.nullif(F.trim(value), F.lit("")), F.lit(most))


def report_name(name: Column, day: Column, with_log: bool) -> Column:
    stem = F.regexp_replace(F.regexp_replace(name, r"(?i)\.pdf$", ""), r"[\\/]", "_")
    return F.concat(F.lit("onderbouwing_"), stem, F.lit("_"), day.cast("string"), F.lit(".zip" if with_log else ".pdf"))


def bundle_name(name: Column, day: Column) -> Column:
    return F.concat(F.regexp_replace(F.coalesce(name, F.lit("document.pdf")), r"(?i)\.pdf$", ""), F.lit("_diwoo_"), day.cast("string"), F.lit(".zip"))


def fingerprint(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value.cast("binary"), 256))


def same_documents(docs: DataFrame) -> DataFrame:
    """doc_id, first_id, copies: documents with equal texts, told by a 256-bit hash; rows of one text alone are left out."""
    hashed = docs.select("doc_id", F.sha2("text", 256).alias("h"))
    groups = hashed.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1")
    return hashed.join(groups, "h").select("doc_id", "first_id", "copies")


_REDACTION = "array<struct<page:int,x0:double,y0:double,x1:double,y1:double,woo_article:string>>"


def parsed_redactions(requests: DataFrame, most: int = 10_000) -> DataFrame:
    """doc_id, n, reason of JSON arrays of boxes (doc_id, redactions): null where fine, else 'not an array', 'too many' or 'bad box'."""
    held = requests.withColumn("r", F.from_json("redactions", _REDACTION))
    bad = F.exists("r", lambda b: b.isNull() | b["page"].isNull() | (b["page"] < 0) | b["x0"].isNull() | b["y0"].isNull() | b["x1"].isNull() | b["y1"].isNull())
    return held.select("doc_id", F.size("r").alias("n"), F.when(F.col("r").isNull() | ~F.col("redactions").rlike(r"^\s*\["), "not an array").when(F.size("r") > most, "too many").when(bad, "bad box").alias("reason"))


def publication_json(records: DataFrame, schema: str = "", origin: str = "export") -> DataFrame:
    """doc_id, json: the publication and its document. records: doc_id, uuid, document_uuid, title, identifier, creator, responsible,
    publisher categories (array), created, changed, exported, format, filename, size, description; empty optional fields are left out.
    """
    mark = F.array(F.struct(F.col("identifier").alias("kenmerk"), F.lit(origin).alias("bron")))
    responsible, description = F.coalesce("responsible", "creator"), F.nullif(F.col("description"), F.lit(""))
    shared = lambda: [F.col("title").alias("officieleTitel"), F.col("exported").alias("registratiedatum"), F.col("changed").alias("laatstGewijzigdDatum"), F.lit("concept").alias("publicatiestatus"), mark.alias("kenmerken"), description.alias("omschrijving")]
    publication = F.struct(F.col("uuid"), *shared(), F.lit("").alias("urlPublicatieIntern"), F.lit("").alias("urlPublicatieExtern"), F.col("categories").alias("diWooInformatieCategorieen"), F.col("creator").alias("opsteller"), responsible.alias("verantwoordelijke"), responsible.alias("publisher"))
    document = F.struct(F.col("document_uuid").alias("uuid"), F.col("uuid").alias("publicatie"), *shared(), F.col("created").alias("creatiedatum"), F.lit(True).alias("uploadVoltooid"), F.col("format").alias("bestandsformaat"), F.col("filename").alias("bestandsnaam"), F.col("size").alias("bestandsomvang"))
    return records.select("doc_id", F.to_json(F.struct(F.nullif(F.lit(schema), F.lit("")).alias("$schema"), publication.alias("publicatie"), document.alias("document"))).alias("json"))


def bundle_readme(records: DataFrame) -> DataFrame:
    """doc_id, readme: what a bundle of (doc_id, title, filename, n) holds."""
    text = F.format_string("%s\n\nBestand: %s\nGelakte passages: %d\n\n- redacted.pdf: gelakt document\n- metadata.xml, metadata.json: publicatiegegevens\n- redaction-log.csv: lijst van gelakte passages\n", "title", "filename", "n")
    return records.select("doc_id", text.alias("readme"))
