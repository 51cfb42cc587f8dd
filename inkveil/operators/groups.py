"""Connected groups: members of the same sets, over any number of sets, by rounds of least labels."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the folder that driver and executors share, so a round's lineage ends there and outlives lost executors."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    path = f"{top}/inkveil-core/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def grown(df: DataFrame) -> DataFrame:
    """df as a side of a join that sorts both sides. Spark reckons the size of rows made from texts by the files that the texts' keys come from, so a
    side that it thinks small enough for a broadcast can be many times what the driver holds."""
    return df.hint("merge")


def connected(members: DataFrame, most_rounds: int | None = None, lone: bool = True) -> DataFrame:
    """node, label from (node, link): the least node that a node reaches over common links.

    Links of a single member join nothing, so they are left out first; nodes that have no others are their own labels (lone False: they are left out as well).
    The rest is numbered, nodes in their order, so that rounds only move pairs of numbers. Each round gives a link the least label of its members and a
    node the least label of its links, then follows labels to their own labels, so chains shorten by more than half a round. Rounds only pre-aggregate
    and join by equal keys, so a link of many members costs its rows, not their pairs.
    Nodes that are null, or have only null links, are left out. most_rounds is for tests.
    """
    rows = written(members.filter("node is not null and link is not null").distinct(), "members")
    links = written(rows.groupBy("link").agg(F.count("*").alias("m")).filter("m > 1").select("link", F.monotonically_increasing_id().alias("l")), "links")
    shared = written(rows.join(grown(links), "link").select("node", "l"), "shared")
    nodes = written(shared.select("node").distinct().orderBy("node").select("node", F.monotonically_increasing_id().alias("n")), "nodes")
    edges = written(shared.join(grown(nodes), "node").select("n", "l"), "edges")
    labels, before, rounds = nodes.select("n", F.col("n").alias("label")), None, 0
    while most_rounds is None or rounds < most_rounds:
        by_link = edges.join(grown(labels), "n").groupBy("l").agg(F.min("label").alias("label"))
        least = edges.join(grown(by_link), "l").groupBy("n").agg(F.min("label").alias("label"))
        jumped = least.join(grown(labels.select(F.col("n").alias("label"), F.col("label").alias("further"))), "label", "left")
        labels = written(jumped.select("n", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        now = labels.agg(F.sum(F.xxhash64("n", "label").cast("decimal(38,0)"))).first()[0]
        rounds += 1
        if now == before:
            break
        before = now
    least = nodes.select(F.col("n").alias("label"), F.col("node").alias("least"))
    out = labels.join(grown(nodes), "n").join(grown(least), "label").select("node", F.col("least").alias("label"))
    if not lone:
        return out
    alone = rows.select("node").distinct().join(grown(nodes.select("node")), "node", "left_anti")
    return out.unionByName(alone.select("node", F.col("node").alias("label")))
