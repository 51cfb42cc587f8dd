"""Decisions over dossiers: what a reviewer decides about a name in one document holds for the dossier's other documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkveil.functions.text import normalise_name
from inkveil.operators.groups import connected, grown, written

DECIDED = ("accepted", "rejected")


def _written(df: DataFrame, name: str) -> DataFrame:
    """df as a table, as it is read several times and costs more to make; columns that hold nothing but untyped nulls are made again on reading."""
    void = [c for c, kind in df.dtypes if kind == "void"]
    return written(df.drop(*void), name).withColumns({c: F.lit(None) for c in void}).select(*df.columns)


def propagate(detections: DataFrame, dossiers: DataFrame) -> DataFrame:
    """detections (det_id, doc_id, entity_type, text, review_status, woo_article, reviewed_at, scope) with the decisions of their dossiers applied,
    and propagated_from (the det_id whose decision a row took, else null).

    Rows of one type and normalised text are one group over all documents that dossiers (dossier_id, doc_id) connect, directly or over further documents with
    the same text; a document in no dossier stands alone. The group's decision is the latest accepted or rejected row whose scope is not
    'document', of equal times the one with the larger det_id. It goes to the group's rows that wait (pending or deferred); a row's own decision,
    and any in its document about the same text of scope 'document', comes before it. Nulls: a null scope is 'all', rows without a text or time of review
    decide nothing for others.
    """
    own = _written(detections.withColumn("_norm", normalise_name(F.col("text"))).withColumn("_key", F.struct("entity_type", "_norm")), "detections")
    placed = own.filter("_norm <> ''").select("doc_id", "_key").distinct()
    links = placed.join(grown(dossiers.select("doc_id", "dossier_id").distinct()), "doc_id").select(F.struct("_key", "doc_id").alias("node"), F.struct("_key", "dossier_id").alias("link"))
    groups = connected(links, lone=False).select("node._key", "node.doc_id", F.col("label").alias("_group"))
    grouped = _written(own.join(grown(groups), ["_key", "doc_id"], "left").withColumn("_group", F.coalesce("_group", F.struct("_key", "doc_id"))), "grouped")
    local = F.coalesce(F.col("scope") == "document", F.lit(False))
    decides = F.col("review_status").isin(*DECIDED) & F.col("reviewed_at").isNotNull() & (F.col("_norm") != "")
    decision = F.struct("reviewed_at", "det_id", "review_status", "woo_article")
    latest = grouped.filter(decides & ~local).groupBy("_group").agg(F.max(decision).alias("_latest"))
    shadows = grouped.filter(decides & local).groupBy("doc_id", "_key").agg(F.max(decision).alias("_local"))
    both = grouped.join(grown(latest), "_group", "left").join(grown(shadows), ["doc_id", "_key"], "left")
    given = F.when(F.col("review_status").isin("pending", "deferred") & (F.col("_norm") != ""), F.coalesce("_local", "_latest"))
    out = both.withColumn("_given", given)
    return out.select(
        *[c for c in detections.columns if c not in ("review_status", "woo_article")],
        F.coalesce("_given.review_status", "review_status").alias("review_status"),
        F.when(F.col("_given").isNotNull(), F.coalesce("_given.woo_article", "woo_article")).otherwise(F.col("woo_article")).alias("woo_article"),
        F.col("_given.det_id").alias("propagated_from"),
    )


def decision_panel(propagated: DataFrame) -> DataFrame:
    """propagated_from, review_status, n, docs: how often each decision was taken over, and in how many documents."""
    taken = propagated.filter("propagated_from is not null")
    return taken.groupBy("propagated_from", "review_status").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


def page_copies(pages: DataFrame) -> DataFrame:
    """doc_id, page, hash, first_doc, first_page, copies: pages whose text is equal but for case and white space, each with the first of its copies."""
    norm = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"(?U)\s+", " "))
    hashed = pages.select("doc_id", "page", F.when(norm != "", F.sha2(norm, 256)).alias("hash"))
    groups = hashed.filter("hash is not null").groupBy("hash").agg(F.min(F.struct("doc_id", "page")).alias("first"), F.count("*").alias("copies"))
    return hashed.join(groups, "hash", "left").select("doc_id", "page", "hash", F.coalesce("first.doc_id", "doc_id").alias("first_doc"), F.coalesce("first.page", "page").alias("first_page"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies"))


def five_year_rule(docs: DataFrame, as_of: str) -> DataFrame:
    """docs with over_five_years: whether the document's date lies more than five years before as_of (null without a date)."""
    return docs.withColumn("over_five_years", F.col("document_date") < F.add_months(F.lit(as_of).cast("date"), -60))


def inventory(detections: DataFrame) -> DataFrame:
    """doc_id, place, woo_article, entity_type, n, pages: what is redacted in each document by ground and type; pages from 1, sorted."""
    shown = detections.filter(F.col("review_status").isin("accepted", "auto_accepted"))
    rows = shown.select("doc_id", F.coalesce("woo_article", F.lit("")).alias("woo_article"), "entity_type", "det_id", F.explode_outer("boxes").alias("b"))
    out = rows.groupBy("doc_id", "woo_article", "entity_type").agg(F.count_distinct("det_id").alias("n"), F.array_sort(F.collect_set(F.col("b.page") + 1)).alias("pages"))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("woo_article", "entity_type")).cast("long")
    return out.withColumn("place", place)
