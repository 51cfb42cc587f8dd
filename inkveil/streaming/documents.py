"""Documents as they arrive: detection row by row on a stream, whole decisions by micro-batch, and counts in windows of time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkveil.operators import tier1
from inkveil.operators.classify import contact_key


def detect_stream(docs: DataFrame, as_of: str | None = None) -> DataFrame:
    """Tier-1 rows of a stream of (doc_id, text): nothing but expressions on each row, so it runs under readStream unchanged."""
    return tier1.detect(docs, as_of=as_of)


def decide_by_batch(docs: DataFrame, decide: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run a batch plan on each micro-batch of whole documents; a batch's folder is overwritten if the batch is run again."""

    def write(batch: DataFrame, number: int) -> None:
        decide(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(detections: DataFrame, time_col: str = "ts", width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """begin, entity_type, n in tumbling windows; rows later than the watermark are dropped."""
    return detections.withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("w"), "entity_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), "entity_type", "n")


def once(rows: DataFrame, keys: list[str], time_col: str = "ts", late: str = "30 minutes") -> DataFrame:
    """Rows without repeated deliveries (equal keys). On a stream a delivery is known as long as the watermark has not passed it, so state does not
    grow with the stream; the watermark also holds for what follows."""
    if rows.isStreaming:
        return rows.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)
    return rows.dropDuplicates(keys)


def with_public_values(spans: DataFrame, contacts: DataFrame) -> DataFrame:
    """Adds public_value: whether the span's value is public contact data (kind, value), by a join of the stream with the table as it is at
    each micro-batch. Whole values are compared; prefixes of urls are a matter of whole decisions."""
    listed = contacts.select(F.col("kind").alias("entity_type"), contact_key(F.col("kind"), F.col("value")).alias("key")).distinct().withColumn("listed", F.lit(True))
    keyed = spans.withColumn("key", contact_key(F.col("entity_type"), F.col("text")))
    return keyed.join(listed, ["entity_type", "key"], "left").withColumn("public_value", F.coalesce("listed", F.lit(False))).drop("key", "listed")


def sessions(rows: DataFrame, key: str, gap: str = "30 minutes", time_col: str = "ts", late: str | None = "30 minutes") -> DataFrame:
    """key, begin, end, n, public: rows (with public_value) of one key that follow each other within a gap, as sessions.

    On a stream a session is given out once the watermark has passed its end; later rows are dropped. late None: the rows have a watermark.
    """
    timed = rows.withWatermark(time_col, late) if rows.isStreaming and late else rows
    found = timed.groupBy(F.session_window(time_col, gap).alias("w"), key).agg(F.count("*").alias("n"), F.count_if("public_value").alias("public"))
    return found.select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n", "public")


def delivery_sessions(docs: DataFrame, contacts: DataFrame, key: str = "sender", gap: str = "30 minutes", late: str = "30 minutes", as_of: str | None = None) -> DataFrame:
    """Hard identifiers by session of a sender, from deliveries (doc_id, sender, ts, text) that may come late, out of order and more than once.

    Repeated deliveries are dropped, identifiers found row by row, met with public contact data, and counted by session: one query, batch or stream.
    """
    fresh = once(docs, ["doc_id"], "ts", late)
    hits = tier1.detect(fresh.withColumn("doc_id", F.struct("doc_id", key, "ts")), as_of=as_of)
    rows = hits.select("doc_id.doc_id", f"doc_id.{key}", "doc_id.ts", "entity_type", "text")
    return sessions(with_public_values(rows, contacts), key, gap, "ts", None)
