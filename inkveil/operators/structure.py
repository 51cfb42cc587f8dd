"""Parts of letters and mails: header blocks, signature blocks, salutations; and properties of whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkveil.functions import values as V
from inkveil.functions.text import Blocks, context_before, let, match_many, running_totals, with_blocks

_SPAN = "array<struct<start_char:int,end_char:int,evidence:string>>"
_CLOSING = rf"(?iU)^\s*(?:{'|'.join(V.CLOSINGS)})"


def lines_of(text: Column) -> Column:
    """Lines (blank ones too) with their offsets, the line end left out."""

    def placed(lines: Column) -> Column:
        ends = running_totals(F.transform(lines, lambda x: F.length(x) + 1))
        return F.transform(F.arrays_zip(lines.alias("line"), ends.alias("end")), lambda x, i: F.struct(i.alias("i"), x["line"].alias("line"), (x["end"] - 1 - F.length(x["line"])).alias("start_char"), (x["end"] - 1).alias("end_char")))

    return let(F.split(text, "\n", -1), placed)


def line_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.inline(lines_of(F.col("text"))))


def _salutation(line: Column) -> Column:
    """The first pattern's match, trimmed, or an empty text."""
    out = F.lit("")
    for p in reversed(V.SALUTATIONS):
        out = F.when(line.rlike(p), F.trim(F.regexp_extract(line, p, 0))).otherwise(out)
    return out


def salutations(lines: Column) -> Column:
    met = F.filter(lines, lambda x: _salutation(x["line"]) != "")
    return F.transform(met, lambda x: F.struct(x["start_char"].alias("start_char"), x["end_char"].alias("end_char"), _salutation(x["line"]).alias("evidence")))


def header_blocks(lines: Column) -> Column:
    """From a header word on, further header-like lines up to 15 in all; the scan goes on after the block."""
    none = F.lit(None).cast("int")
    state = F.struct(F.array().cast(_SPAN).alias("done"), none.alias("start_char"), none.alias("end_char"), F.lit("").alias("evidence"), F.lit(0).alias("n"))

    def closed(acc: Column) -> Column:
        own = F.struct(acc["start_char"].alias("start_char"), acc["end_char"].alias("end_char"), acc["evidence"].alias("evidence"))
        return F.when(acc["n"] > 0, F.array_append(acc["done"], own)).otherwise(acc["done"])

    def step(acc: Column, x: Column) -> Column:
        trigger = x["line"].rlike(V.HEADER_START)
        goes_on = (acc["n"] > 0) & (acc["n"] < V.MOST_HEADER_LINES) & (trigger | x["line"].rlike(V.HEADER_LINE))
        longer = F.struct(acc["done"].alias("done"), acc["start_char"].alias("start_char"), x["end_char"].alias("end_char"), acc["evidence"].alias("evidence"), (acc["n"] + 1).alias("n"))
        fresh = F.struct(closed(acc).alias("done"), x["start_char"].alias("start_char"), x["end_char"].alias("end_char"), F.trim(F.regexp_extract(x["line"], V.HEADER_START, 0)).alias("evidence"), F.lit(1).alias("n"))
        shut = F.struct(closed(acc).alias("done"), none.alias("start_char"), none.alias("end_char"), F.lit("").alias("evidence"), F.lit(0).alias("n"))
        return F.when(goes_on, longer).when(trigger, fresh).otherwise(shut)

    return F.aggregate(lines, state, step, closed)


def signature_blocks(lines: Column) -> Column:
    """From a closing phrase on up to six lines that are not blank; two blank lines, a salutation or a disclaimer's address end it."""

    def block(x: Column, lines: Column) -> Column:
        state = F.struct(x["end_char"].alias("end_char"), F.lit(0).alias("taken"), F.lit(0).alias("blank"), F.lit(True).alias("open"))

        def step(acc: Column, y: Column) -> Column:
            blank = F.trim(F.regexp_replace(y["line"], r"(?U)\s", "")) == ""
            stop = F.when(blank, acc["blank"] >= 1).otherwise((_salutation(y["line"]) != "") | y["line"].rlike(V.DISCLAIMER) | (acc["taken"] >= V.MOST_SIGNATURE_LINES))
            go = acc["open"] & ~stop
            return F.struct(F.when(go & ~blank, y["end_char"]).otherwise(acc["end_char"]).alias("end_char"), F.when(go & ~blank, acc["taken"] + 1).otherwise(acc["taken"]).alias("taken"), F.when(blank, acc["blank"] + 1).otherwise(F.lit(0)).alias("blank"), go.alias("open"))

        end = F.aggregate(F.slice(lines, x["i"] + 2, 2 * V.MOST_SIGNATURE_LINES + 2), state, step, lambda acc: acc["end_char"])
        return F.struct(x["start_char"].alias("start_char"), end.alias("end_char"), F.trim(F.regexp_extract(x["line"], _CLOSING, 0)).alias("evidence"))

    return let(lines, lambda all_lines: F.transform(F.filter(all_lines, lambda x: x["line"].rlike(_CLOSING)), lambda x: block(x, all_lines)))


KINDS = (("email_header", header_blocks, 0.95), ("signature_block", signature_blocks, 0.90), ("salutation", salutations, 0.85))


def detect(docs: DataFrame, kinds: tuple[str, ...] = ("email_header", "signature_block", "salutation")) -> DataFrame:
    """doc_id, kind, start_char, end_char, confidence, evidence; no shuffle."""
    held = docs.select("doc_id", lines_of(F.col("text")).alias("lines"))
    parts = []
    for kind, found, confidence in KINDS:
        if kind in kinds:
            parts.append(held.select("doc_id", F.lit(kind).alias("kind"), F.inline(found(F.col("lines")).cast(_SPAN))).withColumn("confidence", F.lit(confidence)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("doc_id", "kind", "start_char", "end_char", "confidence", "evidence")


def ordered(structures: DataFrame) -> DataFrame:
    """Structures with place (from 1) in their document: by start, end and kind."""
    return structures.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy("start_char", "end_char", "kind")).cast("long"))


def environmental(docs: DataFrame) -> DataFrame:
    """doc_id, environmental: whether a word of environmental information stands in the text."""
    return docs.select("doc_id", F.col("text").rlike(rf"(?iU)\b(?:{'|'.join(V.ENVIRONMENT)})\b").alias("environmental"))


def assemble(pages: DataFrame, gap: str = "\n\n") -> DataFrame:
    """doc_id, text, n_pages from (doc_id, page, text): pages in order, joined by a blank line."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), gap).alias("text"), F.count("*").alias("n_pages"))


_DATES = (rf"(?iU)\b\d{{1,2}}\s+(?:{'|'.join(V.MONTH_NAMES)})\s+\d{{4}}\b", r"(?U)\b\d{1,2}[-/]\d{1,2}[-/]\d{4}\b", r"(?U)\b\d{4}-\d{1,2}-\d{1,2}\b")


def document_dates(pages: DataFrame, as_of: str | None = None) -> DataFrame:
    """doc_id, document_date: that of the first page that has one. pages: (doc_id, page, text).

    Dates are 'd month Y' with the month's whole name, d-m-Y or d/m/Y, and Y-m-d, with or without leading zeros, of a year from 1901 to the one after as_of's
    (today's), but no birth dates. On a page the latest date with a label such as 'datum' or 'verzonden' in the 30 characters before it counts, else the latest one.
    """
    text, last = F.col("text"), F.year(F.lit(as_of).cast("date") if as_of else F.current_date()) + 1
    months = F.array(*[F.lit(m) for m in V.MONTH_NAMES])

    def day(written: Column) -> Column:
        """The day of a date in one of the forms, or null where there is none such."""

        def made(parts: Column) -> Column:
            number = lambda k: F.get(parts, F.lit(k)).try_cast("int")
            month = F.coalesce(number(1), F.array_position(months, F.lower(F.get(parts, F.lit(1)))).cast("int"))
            first = F.length(F.get(parts, F.lit(0))) == 4
            return F.to_date(F.try_to_timestamp(F.concat_ws("-", F.when(first, number(0)).otherwise(number(2)), month, F.when(first, number(2)).otherwise(number(0))), F.lit("y-M-d")))

        return let(F.split(written, r"(?U)[-/]|\s+"), made)

    def dated(s: Column, own: Blocks) -> Column:
        before = context_before(own, s["start_char"], 30)

        def judged(found: Column) -> Column:
            fits = F.coalesce(F.year(found).between(1901, F.least(last, F.lit(2099))), F.lit(False)) & ~before.rlike(V.BIRTH_BEFORE)
            return F.when(fits, F.struct(before.rlike(V.DATE_BEFORE).alias("labelled"), found.alias("day")))

        return let(day(s["text"]), judged)

    spans = F.flatten(match_many(text, [(p, text.rlike(r"\d{4}")) for p in _DATES]))
    found = F.array_max(with_blocks(text, lambda own: F.transform(spans, lambda s: dated(s, own))))["day"]
    return pages.select("doc_id", "page", found.alias("date")).groupBy("doc_id").agg(F.min_by("date", F.when(F.col("date").isNotNull(), F.col("page"))).alias("document_date"))
