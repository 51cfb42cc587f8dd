"""Analysing anew what a change of a list can touch: an index from evidence keys to documents, kept as a table beside the detections.

A document's decisions only depend on a list through the keys under which its spans look things up: values of contacts, names of reference lists, suffixes of
surnames. The index holds those keys; the keys of changed list entries find the documents by an equi-join, and only they are decided again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.text import normalise_name, phrase
from inkveil.operators.classify import contact_key, surname_of


def _beginnings(tokens: Column, gap: str, from_end: bool = False) -> Column:
    slice_ = (lambda i: F.slice(tokens, i, F.size(tokens))) if from_end else (lambda i: F.slice(tokens, 1, i))
    return F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda i: F.array_join(slice_(i), gap))


def evidence_index(spans: DataFrame) -> DataFrame:
    """list, key, doc_id: under which keys the spans of a document (doc_id, entity_type, tier, text) look into each list."""
    key = contact_key(F.col("entity_type"), F.col("text"))
    values = F.when(F.col("entity_type") == "url", _beginnings(F.split(key, "(?=[/?#])"), "")).otherwise(F.array(key))
    contacts = spans.filter("entity_type <> 'persoon'").select(F.concat(F.lit("contact:"), "entity_type").alias("list"), F.explode(values).alias("key"), "doc_id")
    persons = spans.filter("entity_type = 'persoon'")
    names = persons.select(F.lit("reference").alias("list"), normalise_name(F.col("text")).alias("key"), "doc_id")
    surnames = persons.select(F.lit("official").alias("list"), F.explode(_beginnings(F.split(surname_of(F.col("text")), " "), " ", True)).alias("key"), "doc_id")
    return contacts.unionByName(names).unionByName(surnames).filter("key <> ''").distinct()


def changed_contacts(before: DataFrame, after: DataFrame) -> DataFrame:
    """list, key of contacts (kind, value) that only one of two tables has."""
    keyed = lambda c: c.select(F.concat(F.lit("contact:"), "kind").alias("list"), contact_key(F.col("kind"), F.col("value")).alias("key")).distinct()
    return _either(keyed(before), keyed(after))


def changed_names(before: DataFrame, after: DataFrame) -> DataFrame:
    """list, key, doc_id of reference names (doc_id, name) that only one of two tables has: they concern their own document alone."""
    keyed = lambda c: c.select(F.lit("reference").alias("list"), normalise_name(F.col("name")).alias("key"), "doc_id").distinct()
    return _either(keyed(before), keyed(after))


def changed_officials(before: DataFrame, after: DataFrame) -> DataFrame:
    """list, key of officials (gm_code, surname, initials) that only one of two tables has."""
    keyed = lambda c: c.select(F.col("gm_code").cast("string").alias("gm"), phrase(F.col("surname")).alias("key"), F.lower("initials").alias("initials")).distinct()
    return _either(keyed(before), keyed(after)).select(F.lit("official").alias("list"), "key").distinct()


def _either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def touched(index: DataFrame, changes: DataFrame) -> DataFrame:
    """doc_id of the documents with a changed key; changes that name a document touch no other."""
    on = [c for c in ("list", "key", "doc_id") if c in changes.columns]
    return index.join(changes.select(*on).distinct(), on, "left_semi").select("doc_id").distinct()


def refreshed(decisions: DataFrame, spans: DataFrame, docs: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Decisions with those of the touched documents (doc_id) made anew from their spans; all others stay as they stand."""
    again = decide(spans.join(docs, "doc_id", "left_semi"))
    return decisions.join(docs, "doc_id", "left_anti").unionByName(again)
