"""Packing of tokenised documents into fixed windows: concatenate and cut.

Pass 1 encodes each document once, keeps its ids together with its place within its partition, and adds up
token totals of partitions. A prefix sum over those totals (one number a partition) gives each partition its global
offset. Pass 2 cuts every document at the multiples of the window length; where a window's border falls inside a
document, the document has a piece on either side. No row is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import bytes_array, map_slices, materialise, sliced, text_rows
from inkveil.llm.tokenizing import from_json

WINDOW = 1024


def tokenise_in_place(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Pass 1: doc_id, ids (binary: unsigned 16- or 32-bit), width, n_tokens, part, begin (tokens before it in its partition)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, begin = from_json(tokenizer_path), TaskContext.get().partitionId(), 0
        kind, end = ("<u4", "<u2")[not tokenizer.wide and end_id < 1 << 16], np.array([end_id])
        for batch in batches:
            for rows in sliced(batch, "text"):
                ids = [np.concatenate([tokenizer.ids(t), end]).astype(kind) for t in rows.column("text").to_pylist()]
                n = np.array([len(x) for x in ids], np.int64)
                begins = begin + np.concatenate([[0], np.cumsum(n)[:-1]])
                begin += int(n.sum())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), bytes_array([x.tobytes() for x in ids]), pa.array(np.full(len(n), int(kind[-1]), np.int32)), pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(begins)], ["doc_id", "ids", "width", "n_tokens", "part", "begin"])

    return text_rows(docs).mapInArrow(encode, "doc_id long, ids binary, width int, n_tokens long, part int, begin long")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary, little-endian unsigned 32-bit).

    Every document's ids are followed by end_id; a piece is the part of a document within one sequence of `window`
    ids; only the last sequence can need padding. Null and empty texts have the one id end_id. Repeated rows are
    packed once each; null doc_ids stay; extra columns are ignored; an empty table gives no pieces.
    Sent to the driver: one total for each partition.
    """
    encoded = materialise(tokenise_in_place(docs, tokenizer_path, end_id), "packing")
    totals = sorted((r.part, r.n) for r in encoded.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base = dict(zip([p for p, _ in totals], np.cumsum([0] + [n for _, n in totals]).tolist(), strict=False))

    def cut(rows: pa.RecordBatch) -> pa.RecordBatch:
        n, width = rows.column("n_tokens").to_numpy(), rows.column("width").to_numpy()
        first = rows.column("begin").to_numpy() + np.array([base[p] for p in rows.column("part").to_pylist()], np.int64)
        pieces = (first + n - 1) // window - first // window + 1
        row = np.repeat(np.arange(len(n)), pieces)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        sequence = first[row] // window + nth
        begin = np.maximum(sequence * window, first[row])
        end = np.minimum((sequence + 1) * window, first[row] + n[row])
        start, length = begin - first[row], end - begin
        ids, out, last, whole = rows.column("ids"), [], -1, b""
        for r, s, m in zip(row.tolist(), start.tolist(), length.tolist(), strict=True):
            if r != last:
                last, whole = r, np.frombuffer(ids[r].as_buffer(), f"<u{width[r]}").astype("<u4").tobytes()
            out.append(whole[4 * s : 4 * (s + m)])
        return pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array(n[row]), pa.array(sequence), pa.array(begin % window), bytes_array(out)], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return map_slices(encoded, cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary", column="ids")


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
