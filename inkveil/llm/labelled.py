"""What classifiers here share: bounded samples of labelled rows, scoring of all documents, and filtering by score."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import crc_bucket, sliced, text_rows

#: From which score on a document is predicted to have label 1.
THRESHOLD = 0.3


def label_rows(labels: DataFrame, label_col: str, folds: int | None = None, held_out_fold: int = 0) -> DataFrame:
    """(doc_id, label 0/1), one row an id, without null ids or labels and, if folds are given, without the held-out fold."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    if folds:
        rows = rows.filter(crc_bucket(F.col("doc_id"), folds) != held_out_fold)
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def sample_ids(rows: DataFrame, most: int, *conditions: str) -> DataFrame:
    """At most `most` labelled rows (for each condition), those whose hashed ids are smallest: bounded, so it may be broadcast."""
    parts = [rows.filter(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c in conditions or ("true",)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, text, label) of a bounded sample; the documents are filtered in their scan."""
    return text_rows(docs).join(F.broadcast(sample), "doc_id")


def held_out(folds: int, fold: int) -> Column:
    return F.coalesce(crc_bucket(F.col("doc_id"), folds) == fold, F.lit(False)).alias("held_out")


def score_documents(docs: DataFrame, score: Callable[[list[str]], np.ndarray], folds: int, fold: int, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in sliced(batch, "text"):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(score(rows.column("text").to_pylist()), pa.float64())], ["doc_id", "score"])

    scored = text_rows(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(folds, fold), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def filter_documents(docs: DataFrame, score: Callable[[list[str]], np.ndarray], keep: Callable[[np.ndarray], np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose score `keep` accepts; null texts are scored as empty ones.

    Columns are only known by their place meanwhile, so their names can hold dots and back-ticks.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = f"c{docs.columns.index(text_col)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in sliced(batch, text):
                kept = keep(score([t or "" for t in rows.column(text).to_pylist()]))
                yield rows.filter(pa.array(kept, pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
