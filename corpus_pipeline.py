"""Cleaning and packing of a corpus: four stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm import ngram_join, packing, quality, toxicity
from inkveil.llm.common import materialise
from inkveil.llm.queries import table, vocabulary


#: Rows that go as near duplicates are broadcast to the scan of the texts up to this number (16 MB of ids), more are joined by a shuffle.
MOST_BROADCAST = 2_000_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality classifier does not reject, with all their columns.

    Null and empty texts are judged as texts without words; texts of any length are judged whole; repeated rows and rows of one id are judged each by
    its text, so equal texts share their fate; an empty table gives an empty one; other columns, whatever their names, are passed on as they are.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the toxicity classifier does not reject, with all their columns.

    Null and empty texts have no evidence against them and stay; otherwise as keep_quality.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: the first by (id, hash of the text, place of the row), null ids last.

    Rows are told apart by their place in a written copy, so equal or null ids with different texts are different documents. Rows without words (null
    and empty texts) are near no other; of those with equal ids and texts one stays. Texts of any length are compared whole; an empty table gives an
    empty one; other columns, whatever their names, are passed on as they are. Texts are not shuffled: the places of rows that go are joined to them.
    """
    place_of_row = "row"
    while place_of_row in docs.columns:
        place_of_row += "_"
    rows = materialise(docs.withColumn(place_of_row, F.monotonically_increasing_id()), "rows")
    texts = rows.select(F.col(place_of_row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = materialise(ngram_join.near_duplicates(texts.select(F.col("row").alias("doc_id"), "text")), "near").withColumnRenamed("doc_id", "row")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "row")
    placed = materialise(texts.select("row", place.alias("place")).join(found, "row"), "placed")
    shown = placed.filter("n_shingles > 0").groupBy("component_id").agg(F.min("place").alias("first")).select("first.row")
    bare = placed.filter("n_shingles = 0").groupBy("place.unknown", "place.id", "place.h").agg(F.min("place.row").alias("row")).select("row")
    gone = materialise(placed.select("row").join(shown.unionByName(bare), "row", "left_anti").withColumnRenamed("row", place_of_row), "gone")
    few = gone.count() <= MOST_BROADCAST
    return rows.join(F.broadcast(gone) if few else gone, place_of_row, "left_anti").drop(place_of_row)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of what is left.

    Null and empty texts are their end id alone; texts of any length are cut at windows; repeated rows and null ids are packed each; an empty table has
    no pieces; other columns are not looked at.
    """
    return packing.piece_digests(packing.pack(docs, vocabulary("byte_bpe_50k.json")))


STAGES = [("quality", keep_quality), ("toxicity", keep_civil), ("near duplicates", keep_distinct), ("packing", pack)]

#: Trained classifiers and a tokenizer are not SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
