"""From texts to places on pages and back: boxes of occurrences, texts in boxes, search with boxes.

Items are positioned texts (doc_id, page, ord, text, x0, y0, x1, y1). Characters of an item share its width by their glyphs' widths, so
a cumulated sum of widths leads from a character to x and back. A page with its items in order is one row; documents are never one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkveil.functions import intervals
from inkveil.functions import values as V
from inkveil.functions.text import context_after, context_before, let, normalise_term, running_totals, with_blocks
from inkveil.operators.custom import literal_spans
from inkveil.operators.groups import grown
from inkveil.operators.locate import area

BOX = "struct<page:int,x0:double,y0:double,x1:double,y1:double>"
#: Tolerances in points: items of one line in a merge, in a search hit, in a text; slack of x; an item counts as inside; items touch.
SAME_LINE, SEARCH_LINE, TEXT_LINE, SLACK, INSIDE, TOUCHING = 3.0, 2.0, 2.0, 2.0, 1.5, 1.5
#: Height of the bands by which boxes and items of a page meet.
BAND = 40.0
_BORDER = r"[\p{L}\p{N}]"


def glyph_widths(text: Column) -> Column:
    """The width of each character, in thousandths of the type size."""
    table = F.array(*[F.lit(w) for w in V.GLYPH_WIDTHS])
    return let(table, lambda known: F.transform(F.split(text, ""), lambda c: F.coalesce(F.when(F.ascii(c) >= 32, F.get(known, F.ascii(c) - 32)), F.lit(V.GLYPH_WIDTH))))


def _total(widths: Column) -> Column:
    return F.aggregate(widths, F.lit(0), lambda acc, w: acc + w)


def box_of(item: Column, page: Column, begin: Column, length: Column) -> Column:
    """The box of `length` characters of an item from `begin` on; the item's own box for all of it."""

    def cut(widths: Column) -> Column:
        whole, before, own = F.greatest(_total(widths), F.lit(1)), _total(F.slice(widths, 1, begin)), _total(F.slice(widths, begin + 1, length))
        full, wide = (begin == 0) & (length >= F.size(widths)), item["x1"] - item["x0"]
        x0 = F.when(full, item["x0"]).otherwise(item["x0"] + wide * before / whole)
        x1 = F.when(full, item["x1"]).otherwise(item["x0"] + wide * (before + own) / whole)
        return F.struct(page.alias("page"), x0.alias("x0"), item["y0"].alias("y0"), x1.alias("x1"), item["y1"].alias("y1")).cast(BOX)

    return let(glyph_widths(item["text"]), cut)


def text_between(item: Column, left: Column, right: Column) -> Column:
    """The part of an item's text between two x: characters whose middle lies there; all of it where the item lies between them."""
    wide = item["x1"] - item["x0"]

    def cut(ends: Column) -> Column:
        scale = wide / F.element_at(ends, -1)
        middles = F.transform(ends, lambda end, i: (F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1)) + end) / 2.0 * scale)
        first = F.size(F.filter(middles, lambda m: m < F.greatest(item["x0"], left) - item["x0"]))
        after = F.size(F.filter(middles, lambda m: m <= F.least(item["x1"], right) - item["x0"]))
        return F.trim(item["text"].substr(first + 1, F.greatest(after - first, F.lit(0))))

    inside = (item["x0"] >= left - INSIDE) & (item["x1"] <= right + INSIDE)
    apart = F.least(item["x1"], right) <= F.greatest(item["x0"], left)
    return F.when((wide <= 0) | (item["text"] == "") | inside, item["text"]).when(apart, F.lit("")).otherwise(let(running_totals(glyph_widths(item["text"])), cut))


def page_rows(items: DataFrame) -> DataFrame:
    """doc_id, page, items: the items of each page that are not blank, in order."""
    item = F.struct("ord", "text", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    return items.filter("trim(text) <> ''").groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(item)).alias("items"))


def _whole(needle: Column) -> Column:
    return F.concat(F.lit(rf"(?<!{_BORDER})\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(rf"\E(?!{_BORDER})"))


def _holds(text: Column, needle: Column) -> Column:
    return text.contains(needle) & F.rlike(text, _whole(needle))


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def _walked(items: Column, at: Column, needle: Column) -> Column:
    """The box of the run of items from place `at` on that spells the needle, or null.

    Items of the line are appended one by one until they hold the needle with spaces between them or without, or are equal to it but for
    white space. The walk gives up at another line, and once the items are four characters longer than the needle.
    """
    target, first = _bare(needle), F.get(items, at)
    most = F.greatest(F.lit(60), F.length(target) * 2 + 8)
    numbers = ("x0", "y0", "x1", "y1")

    def state(spaced: Column, glued: Column, bare: Column, box: dict[str, Column], done: Column) -> Column:
        return F.struct(spaced.alias("spaced"), glued.alias("glued"), bare.alias("bare"), *[box[c].alias(c) for c in numbers], done.alias("done"))

    def step(acc: Column, item: Column) -> Column:
        low = F.lower(item["text"])
        box = {c: (F.least if c.endswith("0") else F.greatest)(acc[c], item[c]) for c in numbers}

        def judged(now: Column) -> Column:
            met = _holds(now["spaced"], needle) | _holds(now["glued"], needle) | (now["bare"] == target)
            return now.withField("done", F.when(met, 1).when(F.length(now["bare"]) > F.length(target) + 4, -1).otherwise(0))

        longer = state(F.concat(acc["spaced"], F.lit(" "), low), F.concat(acc["glued"], low), F.concat(acc["bare"], _bare(low)), box, F.lit(0))
        return F.when(acc["done"] != 0, acc).when(F.abs(item["y0"] - first["y0"]) > SAME_LINE, acc.withField("done", F.lit(-1))).otherwise(let(longer, judged))

    start = F.lower(first["text"])
    begun = state(start, start, _bare(start), {c: first[c] for c in numbers}, F.lit(0))
    end = F.aggregate(F.slice(items, at + 2, most), begun, step)
    return let(end, lambda e: F.when(e["done"] == 1, F.struct(*[e[c].alias(c) for c in numbers])))


def needle_boxes(items: DataFrame, needles: DataFrame) -> DataFrame:
    """doc_id, needle, page, at, single, box: all places of needles (doc_id, needle; lower case, trimmed) on their documents' pages.

    A place is an item that holds the whole needle at word edges (its box cut to the needle by glyph widths), or a run of items of one line that
    begins with its first word or as it does. An item meets a needle by an equi-join: on the first run of letters and digits of the needle's first
    word, or on the whole item being a beginning of the needle.
    """
    pages = page_rows(items)
    own = needles.select("doc_id", "needle").filter("needle <> ''").distinct()
    word = F.split("needle", " ", 2)[0]
    starts = F.transform(F.sequence(F.lit(1), F.length("needle")), lambda n: F.concat(F.lit("="), F.left("needle", n)))
    run = F.regexp_extract(word, rf"{_BORDER}+", 0)
    keyed = own.withColumn("key", F.explode(F.concat(starts, F.when(run != "", F.array(F.concat(F.lit("~"), run))).otherwise(F.array().cast("array<string>")))))
    runs = F.transform(F.array_distinct(F.regexp_extract_all(F.lower("item.text"), F.lit(rf"{_BORDER}+"), F.lit(0))), lambda w: F.concat(F.lit("~"), w))
    anchors = pages.select("doc_id", "page", F.posexplode("items").alias("at", "item"))
    anchors = anchors.select("doc_id", "page", "at", F.explode(F.concat(runs, F.array(F.concat(F.lit("="), F.lower("item.text"))))).alias("key"))
    met = anchors.join(grown(keyed), ["doc_id", "key"]).select("doc_id", "page", "at", "needle").distinct()
    rows = met.join(grown(pages), ["doc_id", "page"]).withColumn("low", F.lower(F.get("items", F.col("at"))["text"]))
    needle, low = F.col("needle"), F.col("low")
    offset = F.when(_holds(low, needle), F.length(F.element_at(F.call_function("split", low, _whole(needle), F.lit(2)), 1)))
    anchored = _holds(low, F.split(needle, " ", 2)[0]) | needle.startswith(low)
    rows = rows.withColumn("offset", offset).withColumn("run", F.when(F.col("offset").isNull() & anchored, _walked(F.col("items"), F.col("at"), needle)))
    page = F.col("page").cast("int")
    merged = F.when(F.col("run").isNotNull(), F.struct(page.alias("page"), *[F.col(f"run.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")]).cast(BOX))
    single = F.when(F.col("offset").isNotNull(), box_of(F.get("items", F.col("at")), page, F.col("offset"), F.length(needle)))
    return rows.select("doc_id", "needle", "page", "at", F.col("offset").isNotNull().alias("single"), F.coalesce(single, merged).alias("box")).filter("box is not null")


def boxes_of_occurrences(detections: DataFrame, items: DataFrame) -> DataFrame:
    """detections (doc_id, text, nth: which of its text's occurrences in the document it is) with box: the nth place of the text on the pages.

    Where there are not so many, the first place on the first page that has one, places within one item first; null where there is none.
    """
    needle = F.lower(F.trim("text"))
    found = needle_boxes(items, detections.select("doc_id", needle.alias("needle")))
    by_place, whole_first = W.partitionBy("doc_id", "needle").orderBy("page", "at"), W.partitionBy("doc_id", "needle").orderBy("page", F.desc("single"), "at")
    ranked = found.select("doc_id", "needle", "box", (F.row_number().over(by_place) - 1).alias("nth"), F.row_number().over(whole_first).alias("first"))
    own = detections.withColumn("needle", needle)
    exact = own.join(grown(ranked.select("doc_id", "needle", "nth", F.col("box").alias("_exact"))), ["doc_id", "needle", "nth"], "left")
    both = exact.join(grown(ranked.filter("first = 1").select("doc_id", "needle", F.col("box").alias("_first"))), ["doc_id", "needle"], "left")
    return both.select(*detections.columns, F.coalesce("_exact", "_first").alias("box"))


def _bands(low: Column, high: Column) -> Column:
    return F.sequence(F.floor(low / BAND).cast("long"), F.greatest(F.floor(low / BAND), F.floor(high / BAND)).cast("long"))


def texts_of_boxes(boxes: DataFrame, items: DataFrame) -> DataFrame:
    """det_id, text of detections by their boxes (det_id, doc_id, place, page, x0, y0, x1, y1; place: the box's number): the items whose middle height
    lies in a box, each cut to the box, in reading order; items that touch are joined without a space. Boxes of equal text count once;
    detections without text are left out. Boxes and items meet by document, page and band of height."""
    own = boxes.withColumn("band", F.explode(_bands(F.col("y0"), F.col("y1"))))
    middle = (F.col("y0") + F.col("y1")) / 2
    placed = items.select("doc_id", "page", F.floor(middle / BAND).alias("band"), F.struct("text", "x0", "y0", "x1", "y1").alias("item"), middle.alias("middle"))
    met = own.join(grown(placed), ["doc_id", "page", "band"]).filter(f"middle between y0 and y1 and item.x0 < x1 + {SLACK} and item.x1 > x0 - {SLACK}")
    item = F.col("item")
    cut = met.withColumn("part", text_between(item, F.col("x0"), F.col("x1"))).filter("part <> ''")
    parts = F.collect_list(F.struct(F.col("item.y0").alias("y0"), F.col("item.x0").alias("x0"), F.col("item.x1").alias("x1"), "part"))
    lined = cut.groupBy("det_id", "place").agg(F.array_sort(parts).alias("parts")).select("det_id", "place", _joined(F.col("parts")).alias("text")).filter("text <> ''")
    key = F.regexp_replace(F.lower("text"), "[.,;:]+$", "")
    fresh = lined.groupBy("det_id", key.alias("key")).agg(F.min(F.struct("place", "text")).alias("t"))
    return fresh.groupBy("det_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["text"]), " ").alias("text"))


def _joined(parts: Column) -> Column:
    """The text of parts sorted by height: lines are found first, then each line is read from left to right."""

    def read(own: Column) -> Column:
        tops = intervals.scan(own, F.lit(-1e300), lambda top, p: F.when(p["y0"] - top > TEXT_LINE, p["y0"]).otherwise(top))
        ordered = F.array_sort(F.zip_with(own, tops, lambda p, top: F.struct(top.alias("top"), p["x0"].alias("x0"), p["y0"].alias("y0"), p["x1"].alias("x1"), p["part"].alias("part"))))

        def glued(row: Column) -> Column:
            before = lambda i: F.get(row, i - 1)
            touches = lambda p, i: (F.abs(p["y0"] - before(i)["y0"]) < TEXT_LINE) & (p["x0"] - before(i)["x1"] < TOUCHING)
            return F.array_join(F.transform(row, lambda p, i: F.concat(F.when(i == 0, "").when(touches(p, i), "").otherwise(" "), p["part"])), "")

        return let(ordered, glued)

    return F.trim(F.regexp_replace(let(parts, read), r"(?U)\s+", " "))


def entity_texts(boxes: DataFrame, items: DataFrame, types: DataFrame) -> DataFrame:
    """det_id, text as texts_of_boxes gives it; urls (by det_id, entity_type, or by how they begin) without punctuation at their end."""
    joined = texts_of_boxes(boxes, items).join(types.select("det_id", "entity_type"), "det_id", "left")
    url = F.coalesce(F.col("entity_type") == "url", F.lit(False)) | F.col("text").rlike("(?i)^https?://")
    return joined.select("det_id", F.when(url, F.regexp_replace("text", r"[.,;:!?)\]}>]+$", "")).otherwise(F.col("text")).alias("text")).filter("text <> ''")


def line_boxes(items: Column, page: Column) -> Column:
    """Boxes of items, those of one line (tops and bottoms less than SEARCH_LINE apart from the box so far) as one."""

    def step(acc: Column, b: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        same = F.coalesce((F.abs(last["y0"] - b["y0"]) < SEARCH_LINE) & (F.abs(last["y1"] - b["y1"]) < SEARCH_LINE), F.lit(False))
        wider = F.struct(last["page"].alias("page"), F.least(last["x0"], b["x0"]).alias("x0"), F.least(last["y0"], b["y0"]).alias("y0"), F.greatest(last["x1"], b["x1"]).alias("x1"), F.greatest(last["y1"], b["y1"]).alias("y1"))
        return F.when(same, F.array_append(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), wider)).otherwise(F.array_append(acc, b))

    boxes = F.transform(items, lambda s: F.struct(s["y0"].alias("k0"), s["x0"].alias("k1"), F.struct(page.cast("int").alias("page"), s["x0"].alias("x0"), s["y0"].alias("y0"), s["x1"].alias("x1"), s["y1"].alias("y1")).cast(BOX).alias("b")))
    return F.aggregate(F.transform(F.array_sort(boxes), lambda x: x["b"]), F.array().cast(f"array<{BOX}>"), step)


def shared_area(hit: Column, boxes: Column) -> Column:
    """The area of a box that the boxes cover together: slabs between the boxes' sides, in each the joined heights."""
    clipped = F.transform(boxes, lambda b: F.struct(F.greatest(b["x0"], hit["x0"]).alias("x0"), F.greatest(b["y0"], hit["y0"]).alias("y0"), F.least(b["x1"], hit["x1"]).alias("x1"), F.least(b["y1"], hit["y1"]).alias("y1")))

    def height(own: Column, left: Column, right: Column) -> Column:
        across = F.array_sort(F.transform(F.filter(own, lambda b: (b["x0"] <= left) & (b["x1"] >= right)), lambda b: F.struct(b["y0"].alias("a"), b["y1"].alias("b"))))
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1e300).alias("reach"))
        grown = lambda acc, y: F.struct((acc["sum"] + F.greatest(y["b"] - F.greatest(y["a"], acc["reach"]), F.lit(0.0))).alias("sum"), F.greatest(acc["reach"], y["b"]).alias("reach"))
        return F.aggregate(across, start, grown, lambda acc: acc["sum"])

    def slabs(own: Column) -> Column:
        sides = F.array_sort(F.array_distinct(F.concat(F.transform(own, lambda b: b["x0"]), F.transform(own, lambda b: b["x1"]))))
        part = lambda xs, i: F.when(i > 0, (F.get(xs, i) - F.get(xs, i - 1)) * height(own, F.get(xs, i - 1), F.get(xs, i))).otherwise(0.0)
        return let(sides, lambda xs: F.aggregate(F.transform(xs, lambda _, i: part(xs, i)), F.lit(0.0), lambda acc, x: acc + x))

    return let(F.filter(clipped, lambda b: (b["x1"] > b["x0"]) & (b["y1"] > b["y0"])), slabs)


def search(items: DataFrame, needle: str, redacted: DataFrame, context: int = 24, share: float = 0.5) -> DataFrame:
    """doc_id, page, start_char, end_char, text, snippet, boxes, covered, covered_share: hits of a needle of two characters or more on pages.

    A page's text are its items with a space between them; hits do not overlap, in any case of letters. boxes: one for each line. covered: whether one
    of the redacted boxes (doc_id, page, x0, y0, x1, y1) takes at least `share` of one of the hit's boxes; covered_share: how much of the hit's
    area all of them take together. Hits and items meet by a sweep over a page's offsets, boxes by document, page and band of height.
    """
    term = normalise_term(F.lit(needle))
    pages = page_rows(items).withColumn("text", F.array_join(F.transform("items", lambda i: i["text"]), " "))
    spans = _page_hits(F.col("items"), F.col("text"), F.col("page"), term, context)
    found = pages.filter((F.length(term) >= 2) & F.lower("text").contains(term)).select("doc_id", "page", F.inline(spans)).filter("size(boxes) > 0")
    lines = found.select("doc_id", "page", "start_char", F.posexplode("boxes").alias("line", "hit")).withColumn("band", F.explode(_bands(F.col("hit.y0"), F.col("hit.y1"))))
    other = redacted.select("doc_id", "page", F.struct(*[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]).alias("b"))
    met = lines.join(grown(other.withColumn("band", F.explode(_bands(F.col("b.y0"), F.col("b.y1"))))), ["doc_id", "page", "band"]).filter("b.x0 < hit.x1 and b.x1 > hit.x0 and b.y0 < hit.y1 and b.y1 > hit.y0")
    by_line = met.groupBy("doc_id", "page", "start_char", "line", "hit").agg(F.collect_set("b").alias("over"))
    common = lambda b: (F.least(F.col("hit.x1"), b["x1"]) - F.greatest(F.col("hit.x0"), b["x0"])) * (F.least(F.col("hit.y1"), b["y1"]) - F.greatest(F.col("hit.y0"), b["y0"]))
    marked = by_line.select("doc_id", "page", "start_char", F.exists("over", lambda b: common(b) >= share * F.greatest(area(F.col("hit")), F.lit(1e-6))).alias("covered"), shared_area(F.col("hit"), F.col("over")).alias("taken"))
    known = marked.groupBy("doc_id", "page", "start_char").agg(F.bool_or("covered").alias("covered"), F.sum("taken").alias("taken"))
    whole = F.aggregate("boxes", F.lit(0.0), lambda acc, b: acc + area(b))
    out = found.join(grown(known), ["doc_id", "page", "start_char"], "left")
    return out.select("doc_id", "page", "start_char", "end_char", "text", "snippet", "boxes", F.coalesce("covered", F.lit(False)).alias("covered"), F.when(whole > 0, F.coalesce("taken", F.lit(0.0)) / whole).otherwise(0.0).alias("covered_share"))


def _page_hits(items: Column, text: Column, page: Column, term: Column, context: int) -> Column:
    """The hits of a page with their snippets and line boxes; each finds its items by how many end before it and begin before its end."""

    def placed(ends: Column, hits: Column) -> Column:
        point = lambda p, i: F.struct(p.alias("start_char"), (i + 1).alias("end_char"))
        over = F.transform(ends, lambda e, i: point(e - 1, i))
        begun = F.transform(ends, lambda e, i: point(e - 1 - F.length(F.get(items, i)["text"]), i))
        ended, started = intervals.reaches(over, F.transform(hits, lambda h: h["start_char"]), inclusive=True), intervals.reaches(begun, F.transform(hits, lambda h: h["end_char"]))
        return F.zip_with(hits, F.zip_with(ended, started, lambda a, b: F.struct(F.greatest(a, F.lit(0)).alias("a"), F.greatest(b, F.lit(0)).alias("b"))), lambda h, r: F.struct(h.alias("h"), F.slice(items, r["a"] + 1, F.greatest(r["b"] - r["a"], F.lit(0))).alias("own")))

    def shown(blocks: Column, length: Column) -> Callable[[Column], Column]:
        def row(x: Column) -> Column:
            h = x["h"]
            around = F.concat(context_before(blocks, h["start_char"], context), h["text"], context_after(blocks, h["end_char"], context))
            snippet = F.concat(F.when(h["start_char"] > context, "…").otherwise(""), F.regexp_replace(around, r"(?U)\s+", " "), F.when(h["end_char"] + context < length, "…").otherwise(""))
            return F.struct(h["start_char"].alias("start_char"), h["end_char"].alias("end_char"), h["text"].alias("text"), snippet.alias("snippet"), line_boxes(x["own"], page).alias("boxes"))

        return row

    ends = running_totals(F.transform(items, lambda i: F.length(i["text"]) + 1))
    hits = let(ends, lambda e: let(literal_spans(text, term), lambda h: placed(e, h)))
    return with_blocks(text, lambda blocks: let(F.length(text), lambda length: F.transform(hits, shown(blocks, length))))


def grown_to_word(box: Column, word: Column) -> Column:
    """A box that also holds a word's box."""
    return F.struct(box["page"].alias("page"), F.least(box["x0"], word["x0"]).alias("x0"), F.least(box["y0"], word["y0"]).alias("y0"), F.greatest(box["x1"], word["x1"]).alias("x1"), F.greatest(box["y1"], word["y1"]).alias("y1"))


def shrunk_by_word(box: Column, word: Column, least: float = 2.0) -> Column:
    """A box that ends where a word in its right half begins, or begins where one in its left half ends; at least `least` points wide."""
    right = (word["x0"] + word["x1"]) / 2 >= (box["x0"] + box["x1"]) / 2
    x0 = F.when(right, box["x0"]).otherwise(F.least(box["x1"] - least, word["x1"]))
    x1 = F.when(right, F.greatest(box["x0"] + least, word["x0"])).otherwise(box["x1"])
    return F.struct(box["page"].alias("page"), x0.alias("x0"), box["y0"].alias("y0"), x1.alias("x1"), box["y1"].alias("y1"))


def split_boxes(boxes: Column, nth: Column, x: Column, least: float = 2.0) -> Column:
    """Two lists: the boxes up to the nth (from 0) that is cut at x, and those from it on; null if there is no such box."""
    target = F.get(boxes, nth)
    at = F.least(F.greatest(x, target["x0"] + least), target["x1"] - least)
    lists = F.struct(F.array_append(F.slice(boxes, 1, nth), target.withField("x1", at)).alias("a"), F.array_prepend(F.slice(boxes, nth + 2, F.size(boxes)), target.withField("x0", at)).alias("b"))
    return F.when(target.isNotNull(), lists)
