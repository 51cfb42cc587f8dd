"""Changes of detections by reviewers: edits, sweeps, splitting and merging, and states from an event log with undo."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkveil.functions.text import normalise_name
from inkveil.operators.containment import with_inside, with_narrowest_around


def apply_edits(detections: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (det_id, review_status, woo_article and, if there, boxes and at), null where a field stays, on detections.

    The first new boxes keep the old ones as original_boxes; new boxes without a status make the row 'edited'; at becomes reviewed_at
    of rows whose status or boxes changed.
    """
    fields = [c for c in ("review_status", "woo_article", "boxes", "at") if c in edits.columns]
    joined = detections.join(edits.select("det_id", *[F.col(c).alias(f"new_{c}") for c in fields]), "det_id", "left")
    out = joined.withColumn("woo_article", F.coalesce("new_woo_article", "woo_article"))
    status = F.coalesce("new_review_status", "review_status")
    if "boxes" in fields:
        status = F.coalesce("new_review_status", F.when(F.col("new_boxes").isNotNull(), "edited"), "review_status")
        kept = F.col("original_boxes") if "original_boxes" in detections.columns else F.lit(None)
        out = out.withColumn("original_boxes", F.coalesce(kept, F.when(F.col("new_boxes").isNotNull(), F.col("boxes")))).withColumn("boxes", F.coalesce("new_boxes", "boxes"))
    if "at" in fields:
        touched = F.col("new_review_status").isNotNull() | (F.col("new_boxes").isNotNull() if "boxes" in fields else F.lit(False))
        out = out.withColumn("reviewed_at", F.coalesce(F.when(touched, F.col("new_at")), F.col("reviewed_at")))
    return out.withColumn("review_status", status).drop(*[f"new_{c}" for c in fields])


def adjust_boundary(detections: DataFrame, changes: DataFrame) -> DataFrame:
    """New boxes (det_id, boxes) of detections: they become 'edited' and keep their first boxes as original_boxes."""
    return apply_edits(detections, changes.select("det_id", "boxes", F.lit(None).cast("string").alias("review_status"), F.lit(None).cast("string").alias("woo_article")))


def manual_rows(wanted: DataFrame, source: str = "manual") -> DataFrame:
    """Rows that a reviewer makes, from (det_id, doc_id, entity_type, tier, woo_article, text, boxes): accepted, of full confidence, without offsets."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return wanted.select("det_id", "doc_id", "entity_type", "tier", "text", "woo_article", "boxes", F.lit(1.0).alias("confidence"), F.lit("accepted").alias("review_status"), F.lit(source).alias("source"), none("int", "start_char"), none("int", "end_char"))


def commit_search(hits: DataFrame, entity_type: str, tier: str, ground: str) -> DataFrame:
    """One row for each search hit (doc_id, page, text, start_char, boxes) that is to be redacted; ids tell document, page and place."""
    det_id = F.concat_ws("-", F.lit("search"), F.col("doc_id").cast("string"), F.col("page").cast("string"), F.col("start_char").cast("string"))
    return manual_rows(hits.select(det_id.alias("det_id"), "doc_id", F.lit(entity_type).alias("entity_type"), F.lit(tier).alias("tier"), F.lit(ground).alias("woo_article"), "text", "boxes"), "search_redact")


def accept_pending(detections: DataFrame) -> DataFrame:
    """Pending rows of tier 1, and those of tier 2 of a confidence of at least 0.85, become accepted."""
    sure = (F.col("tier") == "1") | ((F.col("tier") == "2") & (F.col("confidence") >= 0.85))
    return detections.withColumn("review_status", F.when((F.col("review_status") == "pending") & sure, "accepted").otherwise(F.col("review_status")))


def bulk(detections: DataFrame, chosen: DataFrame, status: str | None = None, ground: str | None = None, delete: bool = False) -> DataFrame:
    """The log's action on chosen rows (det_id): a status, a ground, or removal, which spares what the analysis made."""
    if delete:
        return remove(detections, chosen)
    value = lambda v: F.lit(v).cast("string")
    return apply_edits(detections, chosen.select("det_id").distinct().select("det_id", value(status).alias("review_status"), value(ground).alias("woo_article")))


def touched_pages(pages: DataFrame, detections: DataFrame) -> DataFrame:
    """doc_id, page, status: unreviewed pages (doc_id, page, status) with a reviewed detection are in progress; complete and flagged ones stay."""
    reviewed = detections.filter("review_status in ('accepted', 'rejected', 'edited', 'deferred')").select("doc_id", F.explode(F.transform("boxes", lambda b: b["page"])).alias("page")).distinct().withColumn("met", F.lit(True))
    joined = pages.join(reviewed, ["doc_id", "page"], "left")
    status = F.coalesce("status", F.lit("unreviewed"))
    return joined.select("doc_id", "page", F.when(F.col("met") & (status == "unreviewed"), "in_progress").otherwise(status).alias("status"))


def edited_list(listed: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """doc_id, name of a reviewer's list after additions (trimmed, blanks dropped) and removals; a name in other letters or spacing is the same name."""
    norm = lambda df: df.select("doc_id", F.trim("name").alias("name")).filter("name <> ''").withColumn("norm", normalise_name(F.col("name")))
    both = norm(listed).withColumn("late", F.lit(0)).unionByName(norm(added).withColumn("late", F.lit(1)))
    first = both.groupBy("doc_id", "norm").agg(F.min_by("name", F.struct("late", "name")).alias("name"))
    return first.join(norm(removed).select("doc_id", "norm").distinct(), ["doc_id", "norm"], "left_anti").select("doc_id", "name")


def redo_next(events: DataFrame, steps: int) -> DataFrame:
    """The log with the earliest `steps` undone events of each detection live again, as far as no event came after they were undone:
    a new event ends what can be redone."""
    last_live = F.max(F.when(~F.col("undone"), F.col("seq"))).over(W.partitionBy("det_id"))
    open_ = F.col("undone") & (F.col("seq") > F.coalesce(last_live, F.lit(-1)))
    order = W.partitionBy("det_id", "open").orderBy("seq")
    return events.withColumn("open", open_).withColumn("nth", F.row_number().over(order)).withColumn("undone", F.col("undone") & ~(F.col("open") & (F.col("nth") <= steps))).drop("open", "nth")


def remove(detections: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the given rows (det_id); only what reviewers made can go."""
    gone = detections.filter("source in ('manual', 'search_redact')").join(ids.select("det_id").distinct(), "det_id", "left_semi").select("det_id")
    return detections.join(gone, "det_id", "left_anti")


def sweep_block(detections: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pending detections inside a block (doc_id, start_char, end_char) become accepted."""
    swept = F.when(F.col("swept") & (F.col("review_status") == "pending"), "accepted").otherwise(F.col("review_status"))
    return with_inside(detections, blocks, "swept").withColumn("review_status", swept).drop("swept")


def sweep_name(detections: DataFrame, chosen: DataFrame) -> DataFrame:
    """Pending detections with type and normalised text of a chosen one (doc_id, entity_type, text) of their document become accepted."""
    c = chosen.select("doc_id", "entity_type", normalise_name(F.col("text")).alias("norm")).distinct().withColumn("swept", F.lit(True))
    joined = detections.withColumn("norm", normalise_name(F.col("text"))).join(c, ["doc_id", "entity_type", "norm"], "left")
    return joined.withColumn("review_status", F.when(F.col("swept") & (F.col("review_status") == "pending"), "accepted").otherwise(F.col("review_status"))).drop("swept", "norm")


def same_name_counts(detections: DataFrame) -> DataFrame:
    """Persons with how many rows of their document have their normalised name; counted by pre-aggregation, then joined."""
    persons = detections.filter("entity_type = 'persoon'").withColumn("norm", normalise_name(F.col("text")))
    counts = persons.groupBy("doc_id", "norm").agg(F.count("*").alias("same_name"))
    return persons.join(counts, ["doc_id", "norm"])


def split(detections: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows with a cut (det_id, at) become two manual ones that meet there; others stay."""
    joined = detections.join(cuts.select("det_id", "at"), "det_id", "left")
    two = joined.filter("at > start_char and at < end_char")
    both = two.select("*", F.explode(F.expr("array(struct(start_char as s, at as e, 'a' as side), struct(at as s, end_char as e, 'b' as side))")).alias("p"))
    fresh = both.withColumn("text", F.expr("substring(text, p.s - start_char + 1, p.e - p.s)")).withColumn("split_from", F.col("det_id")).withColumn("det_id", F.concat("det_id", "p.side")).withColumn("start_char", F.col("p.s")).withColumn("end_char", F.col("p.e")).withColumn("source", F.lit("manual")).drop("p", "at")
    rest = joined.filter("not coalesce(at > start_char and at < end_char, false)").drop("at").withColumn("split_from", F.lit(None).cast("string"))
    return rest.unionByName(fresh)


def merge(detections: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per group (merge_id, det_id, click) of at least two rows of one document: the first clicked row's fields, all texts."""
    joined = groups.join(detections, "det_id")
    rows = F.array_sort(F.collect_list(F.struct("click", "det_id", "text")))
    first = F.min_by(F.struct("entity_type", "woo_article"), "click")
    out = joined.groupBy("merge_id").agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.transform(rows, lambda r: r["det_id"]).alias("merged_from"), F.array_join(F.transform(rows, lambda r: r["text"]), " ").alias("text"), first.alias("f"))
    return out.filter("docs = 1 and n > 1").select("merge_id", "doc_id", "text", "merged_from", "f.entity_type", "f.woo_article")


def states(events: DataFrame) -> DataFrame:
    """det_id, status, n_events: the state after all events (seq, det_id, status, undone) but the undone ones."""
    live = F.when(~F.col("undone"), F.col("seq"))
    return events.groupBy("det_id").agg(F.coalesce(F.max_by("status", live), F.lit("pending")).alias("status"), F.count("*").alias("n_events"))


def undo_last(events: DataFrame, steps: int) -> DataFrame:
    """The log with the last `steps` live events of each detection undone."""
    order = W.partitionBy("det_id", "undone").orderBy(F.desc("seq"))
    return events.withColumn("back", F.row_number().over(order)).withColumn("undone", F.col("undone") | (F.col("back") <= steps)).drop("back")


def page_states(pages: DataFrame, reviews: DataFrame) -> DataFrame:
    """status, n: pages without a review count as unreviewed."""
    joined = pages.join(reviews.select("doc_id", "page", "status"), ["doc_id", "page"], "left")
    return joined.groupBy(F.coalesce("status", F.lit("unreviewed")).alias("status")).agg(F.count("*").alias("n"))


def neighbours(detections: DataFrame) -> DataFrame:
    """Rows with the det_id before and after them in their document's reading order (start, end, id)."""
    order = W.partitionBy("doc_id").orderBy("start_char", "end_char", "det_id")
    return detections.withColumn("before", F.lag("det_id").over(order)).withColumn("after", F.lead("det_id").over(order))


def recent(uses: DataFrame, most: int = 5) -> DataFrame:
    """user_id, value, place: each user's last used values (user_id, value, seq), the latest first, at most `most` (the feature itself)."""
    last = uses.groupBy("user_id", "value").agg(F.max("seq").alias("seq"))
    ranked = last.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("seq"))).cast("long"))
    return ranked.filter(F.col("place") <= most).select("user_id", "value", "place")


def block_groups(detections: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, kind, start_char, end_char) with how many detections lie in them and how many of those wait; empty ones are dropped.

    A detection belongs to the narrowest block around it.
    """
    narrow = with_narrowest_around(detections.select("doc_id", "start_char", "end_char", "review_status"), blocks).filter("around is not null")
    groups = narrow.groupBy("doc_id", F.col("around.kind").alias("kind"), F.col("around.start_char").alias("start_char"), F.col("around.end_char").alias("end_char"))
    return groups.agg(F.count("*").alias("n"), F.count_if(F.col("review_status") == "pending").alias("pending"))


def sweepable(groups: DataFrame) -> DataFrame:
    """Groups that a sweep would change: those with a row that waits."""
    return groups.filter("pending > 0")


def weighed(items: DataFrame) -> DataFrame:
    """det_id, complete: whether all required items (det_id, required, checked) of a checklist are checked."""
    return items.groupBy("det_id").agg(F.bool_and(~F.col("required") | F.col("checked")).alias("complete"))
