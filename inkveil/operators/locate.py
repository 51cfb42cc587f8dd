"""Places on pages: joining text items, boxes of spans, texts of boxes, and box geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkveil.operators.groups import grown

#: Items touch if they are on one line within LINE points and at most GAP points apart.
LINE, GAP = 2.0, 1.5


def join_items(items: DataFrame) -> DataFrame:
    """doc_id, page, text from positioned items (doc_id, page, ord, text, x0, y0, x1, y1): a space between items that do not touch.

    The neighbour comes from lag() within the page; pages, not documents, are the unit of the window.
    """
    order = W.partitionBy("doc_id", "page").orderBy("ord")
    kept = items.filter("trim(text) <> ''")
    touching = (F.abs(F.col("y0") - F.lag("y0").over(order)) < LINE) & (F.col("x0") - F.lag("x1").over(order)).between(-GAP, GAP)
    glued = kept.withColumn("part", F.concat(F.when(F.coalesce(touching, F.lit(False)), "").otherwise(" "), F.col("text")))
    parts = F.array_sort(F.collect_list(F.struct("ord", "part")))
    return glued.groupBy("doc_id", "page").agg(F.ltrim(F.array_join(F.transform(parts, lambda p: p["part"]), "")).alias("text"))


def item_offsets(items: DataFrame) -> DataFrame:
    """Items with start_char and end_char in their page's text (items joined by one space)."""
    order = W.partitionBy("doc_id", "page").orderBy("ord")
    start = F.coalesce(F.sum(F.length("text") + 1).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return items.filter("trim(text) <> ''").withColumn("start_char", start.cast("int")).withColumn("end_char", (start + F.length("text")).cast("int"))


def boxes_of_spans(spans: DataFrame, items: DataFrame) -> DataFrame:
    """Each span (doc_id, page, start_char, end_char) with the boxes of its items, cut to the share of the item's characters, merged by line."""
    at = item_offsets(items).select("doc_id", "page", F.col("start_char").alias("i_start"), F.col("end_char").alias("i_end"), "x0", "y0", "x1", "y1")
    met = spans.join(at, ["doc_id", "page"]).filter("i_start < end_char and start_char < i_end")
    width = (F.col("x1") - F.col("x0")) / (F.col("i_end") - F.col("i_start"))
    left = F.col("x0") + F.greatest(F.col("start_char") - F.col("i_start"), F.lit(0)) * width
    right = F.col("x1") - F.greatest(F.col("i_end") - F.col("end_char"), F.lit(0)) * width
    lines = met.groupBy("doc_id", "page", "start_char", "end_char", "y0").agg(F.min(left).alias("x0"), F.max(right).alias("x1"), F.max("y1").alias("y1"))
    box = F.struct("page", "x0", "y0", "x1", "y1")
    return lines.groupBy("doc_id", "page", "start_char", "end_char").agg(F.array_sort(F.collect_list(box)).alias("boxes"))


def text_of_boxes(boxes: DataFrame, items: DataFrame) -> DataFrame:
    """box_id, text: the items whose middle height lies in the box and whose width meets it, in reading order."""
    i = items.select("doc_id", "page", F.col("text"), F.col("x0").alias("ix0"), F.col("y0").alias("iy0"), F.col("x1").alias("ix1"), F.col("y1").alias("iy1"))
    met = boxes.join(i, ["doc_id", "page"]).filter(f"(iy0 + iy1) / 2 between y0 and y1 and ix0 < x1 + {LINE} and ix1 > x0 - {LINE}")
    parts = F.array_sort(F.collect_list(F.struct("iy0", "ix0", "text")))
    return met.groupBy("box_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def area(box: Column) -> Column:
    return F.greatest(box["x1"] - box["x0"], F.lit(0.0)) * F.greatest(box["y1"] - box["y0"], F.lit(0.0))


def covered(hit: Column, boxes: Column, share: float = 0.5) -> Column:
    """Whether one of the boxes covers at least a share of the hit's area."""

    def common(b: Column) -> Column:
        return F.greatest(F.least(hit["x1"], b["x1"]) - F.greatest(hit["x0"], b["x0"]), F.lit(0.0)) * F.greatest(F.least(hit["y1"], b["y1"]) - F.greatest(hit["y0"], b["y0"]), F.lit(0.0))

    return F.exists(boxes, lambda b: (b["page"] == hit["page"]) & (common(b) >= share * area(hit)))


def split_box(box: Column, x: Column) -> Column:
    """The two parts of a box left and right of x; a part is at least 2 points wide."""
    at = F.least(F.greatest(x, box["x0"] + 2.0), box["x1"] - 2.0)
    part = lambda a, b: F.struct(box["page"].alias("page"), a.alias("x0"), box["y0"].alias("y0"), b.alias("x1"), box["y1"].alias("y1"))
    return F.array(part(box["x0"], at), part(at, box["x1"]))


def merge_line_boxes(boxes: DataFrame) -> DataFrame:
    """group_id, page, x0, y0, x1, y1: boxes whose tops lie within 2 points of the box above become one (islands by lag)."""
    order = W.partitionBy("group_id", "page").orderBy("y0", "x0")
    fresh = F.coalesce((F.col("y0") - F.lag("y0").over(order) > LINE).cast("int"), F.lit(1))
    island = boxes.withColumn("fresh", fresh).withColumn("line", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy("group_id", "page", "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).drop("line")


def _whole(needle: Column) -> Column:
    """A pattern for a needle (any case) that no letter or digit touches."""
    return F.concat(F.lit(r"(?iU)(?<![\p{L}\p{N}])\Q"), needle, F.lit(r"\E(?![\p{L}\p{N}])"))


def occurrences(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans (doc_id, text, start_char, end_char) with nth (from 0), which of its text's whole occurrences in the document each is, and n_all,
    how many there are. Null offsets count as the first."""
    joined = spans.join(grown(docs.select("doc_id", F.col("text").alias("full_text"))), "doc_id")
    count = lambda t: F.size(F.call_function("split", t, _whole(F.col("text")), F.lit(-1))) - 1
    # What follows the span's beginning decides nothing about earlier ones, but an occurrence must not be cut: one character more stands for the edge.
    before = F.concat(F.left("full_text", F.coalesce("start_char", F.lit(0))), F.lit(" "))
    return joined.withColumn("nth", count(before)).withColumn("n_all", count(F.col("full_text"))).drop("full_text")


def nth_occurrence(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, needle, nth, start_char, end_char of the nth (from 0) whole occurrence of a needle, or of the first where there are not so many; not
    found: no row. wanted: (doc_id, needle, nth)."""
    joined = wanted.join(grown(docs.select("doc_id", "text")), "doc_id").withColumn("parts", F.call_function("split", F.col("text"), _whole(F.col("needle")), F.lit(-1))).filter("size(parts) > 1")
    n = F.when(F.col("nth") < F.size("parts") - 1, F.col("nth")).otherwise(F.lit(0))
    gaps = F.aggregate(F.slice("parts", 1, n + 1), F.lit(0), lambda acc, p: acc + F.length(p))
    start = gaps + n * F.length("needle")
    return joined.select("doc_id", "needle", "nth", start.cast("int").alias("start_char"), (start + F.length("needle")).cast("int").alias("end_char"))


def _box(page: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(page.alias("page"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def moved(box: Column, dx: float, dy: float) -> Column:
    """A box nudged by (dx, dy)."""
    return _box(box["page"], box["x0"] + dx, box["y0"] + dy, box["x1"] + dx, box["y1"] + dy)


def resized(box: Column, handle: str, x: Column, y: Column, least: float = 2.0) -> Column:
    """A box whose handle (of n, s, w, e) was dragged to (x, y); it stays at least `least` points wide and high."""
    x0 = F.least(x, box["x1"] - least) if "w" in handle else box["x0"]
    x1 = F.greatest(x, box["x0"] + least) if "e" in handle else box["x1"]
    y0 = F.least(y, box["y1"] - least) if "n" in handle else box["y0"]
    y1 = F.greatest(y, box["y0"] + least) if "s" in handle else box["y1"]
    return _box(box["page"], x0, y0, x1, y1)
