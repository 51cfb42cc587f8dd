"""Small helpers that the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes, and rows at most, that a task turns into output at once.
SLICE_BYTES, SLICE_ROWS = 4 << 20, 50_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one under the warehouse where it is unset (tests)."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"


def materialise(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet into the shared folder and read it again.

    This cuts the lineage at a point that survives lost executors, and keeps work that two later
    branches need from being done twice.
    """
    path = f"{shared_folder(df.sparkSession)}/inkveil/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """While it holds, what is executed hands batches of at most `most` rows to Python: for rows of known, large size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id long, text string): the only columns the operators read, so extra ones can have any name."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def sliced(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that `column` has about `most` bytes, and SLICE_ROWS rows at most, in each part; a longer value stands alone."""
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    begin = total = 0
    for i, size in enumerate(sizes):
        size = size or 0
        if i > begin and (total + size > most or i - begin == SLICE_ROWS):
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield batch.slice(begin)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text", most: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow with batches cut by `sliced`; fn turns a slice into rows of `schema`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, column, most):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def bytes_array(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def crc_bucket(column: Column, n: int) -> Column:
    """crc32(id as text) mod n."""
    return F.crc32(column.cast("string").cast("binary")) % n
