"""Which intervals of a document lie around its spans: sweeps over the sorted events of a document, no pairs of span and interval.

Spans and outer intervals of all documents become one table of events, dealt out by document and sorted; what is known of the intervals so far is
carried along, so each event is looked at once. A document's events go through one task as a stream: memory holds no document, only the
running value (for the narrowest interval: the intervals that can still be an answer).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _events(spans: DataFrame, outer: DataFrame, columns: list[Column]) -> DataFrame:
    """Spans with their columns, and the outer intervals as rows of _outer (start_char, end_char and more) alone."""
    own = spans.withColumn("_turn", F.lit(1))
    around = outer.select("doc_id", F.col("start_char").cast("int").alias("start_char"), F.col("end_char").cast("int").alias("end_char"), F.struct(*columns).alias("_outer"), F.lit(0).alias("_turn"))
    return own.unionByName(around, allowMissingColumns=True)


def with_inside(spans: DataFrame, outer: DataFrame, name: str = "inside") -> DataFrame:
    """spans with a flag: whether one of the outer intervals (doc_id, start_char, end_char) holds the whole span.

    In the order of starts (intervals first) the greatest end so far tells it. Spans without offsets lie in nothing.
    """
    order = W.partitionBy("doc_id").orderBy(F.asc_nulls_first("start_char"), "_turn").rowsBetween(W.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("_turn") == 0, F.col("end_char"))).over(order)
    swept = _events(spans, outer, ["start_char"]).withColumn(name, F.coalesce(reach >= F.col("end_char"), F.lit(False)) & F.col("start_char").isNotNull())
    return swept.filter("_turn = 1").drop("_turn", "_outer")


def with_first_around(spans: DataFrame, outer: DataFrame, classes: dict[str, Column]) -> DataFrame:
    """spans with one column for each class of outer intervals (a test on them): the kind of the first interval by (start, end, kind)
    that holds the span, or null.

    In the order of falling ends (intervals first) the least interval so far is the first that ends late enough; if it begins after the span, all do.
    """
    order = W.partitionBy("doc_id").orderBy(F.desc_nulls_last("end_char"), "_turn").rowsBetween(W.unboundedPreceding, 0)
    key = F.struct("start_char", "end_char", "kind")
    out = _events(spans, outer, [*[F.when(test, key).alias(name) for name, test in classes.items()]])
    for name in classes:
        out = out.withColumn(f"_{name}", F.min(F.col(f"_outer.{name}")).over(order))
    fits = lambda name: F.when(F.col(f"_{name}.start_char") <= F.col("start_char"), F.col(f"_{name}.kind")).alias(name)
    return out.filter("_turn = 1").select(*spans.columns, *[fits(name) for name in classes])


class _Frontier:
    """The intervals begun so far that can be the narrowest around a later span: by rising end, each wider than the one before."""

    def __init__(self) -> None:
        self.ends, self.keys = [], []

    def add(self, start: int, end: int, kind: str) -> None:
        key, at = (end - start, start, end, kind), bisect_left(self.ends, end)
        if at < len(self.ends) and self.keys[at] <= key:
            return  # one that ends no earlier is no wider
        stop = at + (at < len(self.ends) and self.ends[at] == end)
        while at and self.keys[at - 1] > key:
            at -= 1
        self.ends[at:stop], self.keys[at:stop] = [end], [key]

    def around(self, end: int) -> tuple[int, int, int, str] | None:
        at = bisect_left(self.ends, end)
        return self.keys[at] if at < len(self.ends) else None


def with_narrowest_around(spans: DataFrame, outer: DataFrame) -> DataFrame:
    """spans with around (kind, start_char, end_char): the narrowest outer interval that holds the span, of equal ones the first; else null.

    In the order of starts (intervals first) a frontier keeps the intervals that may still be an answer; where they are nested it is a stack.
    """
    columns = spans.columns
    kind = "struct<kind:string,start_char:int,end_char:int>"
    events = _events(spans, outer, ["kind"]).filter("_turn = 1 or (start_char is not null and end_char is not null)")
    dealt = events.repartition("doc_id").sortWithinPartitions("doc_id", F.asc_nulls_first("start_char"), "_turn")
    types = {f.name: f.dataType for f in events.schema.fields}

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, frontier = object(), _Frontier()
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "_turn", "start_char", "end_char", "_outer")), strict=True)
            keep, found = [], []
            for i, (doc_id, turn, start, end, own) in enumerate(rows):
                if doc_id != document:
                    document, frontier = doc_id, _Frontier()
                if not turn:
                    frontier.add(start, end, own["kind"])
                    continue
                met = frontier.around(end) if start is not None and end is not None else None
                keep.append(i)
                found.append(met and {"kind": met[3], "start_char": met[1], "end_char": met[2]})
            own = batch.select(columns).take(pa.array(keep, pa.int64()))
            around = pa.array(found, pa.struct([("kind", pa.string()), ("start_char", pa.int32()), ("end_char", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*own.columns, around], [*columns, "around"])

    schema = ", ".join(f"`{c}` {types[c].simpleString()}" for c in columns)
    return dealt.mapInArrow(sweep, f"{schema}, around {kind}")
