"""Token ids in compressed shard files: one wavelet matrix a shard.

A file holds the ids of consecutive documents (ascending doc_id) as bit planes, highest bit first; in each plane
the ids stand in the order that stable partitioning by the planes above gives. With counts of ones before each block of
512 bits, the planes answer access(i) and rank(id, i) in one step a plane, and select(id, k) from the lowest plane up with one search
of the counts a plane, and give all ids back
without any other copy. Planes are compressed one by one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import bytes_array, materialise, sliced, text_rows
from inkveil.llm.tokenizing import from_json

MAGIC, BLOCK = b"WVM1", 512
_HEAD = struct.Struct("<4sBBQQ")
#: A shard file is closed after the document with which it has so many ids.
SHARD_TOKENS = 2_000_000


class WaveletMatrix:
    def __init__(self, n: int, bits: int, planes: list[np.ndarray], zeros: list[int], ones_before: list[np.ndarray] | None = None):
        self.n, self.bits, self.planes, self.zeros = n, bits, planes, zeros
        self.ones_before = ones_before or [self._directory(p) for p in planes]

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        step = BLOCK // 8
        padded = np.zeros(-(-len(plane) // step) * step, np.uint8)
        padded[: len(plane)] = np.bitwise_count(plane)
        return np.concatenate([[0], np.cumsum(padded.reshape(-1, step).sum(1, dtype=np.int64))])

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        ids = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for level in range(bits - 1, -1, -1):
            one = (ids & ids.dtype.type(1 << level)) != 0
            low = ids[~one]
            planes.append(np.packbits(one, bitorder="little"))
            zeros.append(len(low))
            ids = np.concatenate([low, ids[one]])
        return cls(len(ids), bits, planes, zeros)

    def ids(self) -> np.ndarray:
        """All ids in order."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for level in range(self.bits):
            plane, zeros = self.planes[self.bits - 1 - level], self.zeros[self.bits - 1 - level]
            one = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            above = np.empty(self.n, kind)
            above[~one] = ids[:zeros]
            above[one] = ids[zeros:] | kind(1 << level)
            ids = above
        return ids

    def _ones(self, plane: int, i: int) -> int:
        """Ones in the first i bits of a plane."""
        block, rest = divmod(i, BLOCK)
        part = self.planes[plane][block * (BLOCK // 8) : (i + 7) // 8].copy()
        if rest % 8:
            part[-1] &= (1 << rest % 8) - 1
        return int(self.ones_before[plane][block]) + int(np.bitwise_count(part).sum())

    def _select(self, plane: int, k: int, bit: int) -> int:
        """Place of a plane's bit number k (from 0) of this value: its block by the counts before blocks, then within the block."""
        before = self.ones_before[plane]
        low, high = 0, len(before) - 1  # the last block with at most k such bits before it
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if (before[mid] if bit else mid * BLOCK - before[mid]) <= k else (low, mid)
        rest = k - int(before[low] if bit else low * BLOCK - before[low])
        part = self.planes[plane][low * (BLOCK // 8) : (low + 1) * (BLOCK // 8)]
        return low * BLOCK + int(np.flatnonzero(np.unpackbits(part, bitorder="little") == bit)[rest])

    def access(self, i: int) -> int:
        value = 0
        for plane in range(self.bits):
            ones = self._ones(plane, i)
            bit = self._ones(plane, i + 1) - ones
            i = self.zeros[plane] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _narrow(self, token: int, i: int) -> tuple[int, int]:
        """Begin of the token's run after all planes, and its place for the first i ids."""
        begin = 0
        for plane in range(self.bits):
            a, b = self._ones(plane, begin), self._ones(plane, i)
            if token >> (self.bits - 1 - plane) & 1:
                begin, i = self.zeros[plane] + a, self.zeros[plane] + b
            else:
                begin, i = begin - a, i - b
        return begin, i

    def rank(self, token: int, i: int) -> int:
        """How often the token is among the first i ids."""
        if token < 0 or token >> self.bits:
            return 0
        begin, end = self._narrow(token, i)
        return end - begin

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the token's occurrence number k (from 0), or -1."""
        if k < 0 or k >= self.count(token):
            return -1
        at = self._narrow(token, 0)[0] + k  # its place after all planes; from the lowest plane up, where it stood before
        for plane in range(self.bits - 1, -1, -1):
            if token >> (self.bits - 1 - plane) & 1:
                at = self._select(plane, at - self.zeros[plane], 1)
            else:
                at = self._select(plane, at, 0)
        return at


def to_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    matrix, pack = WaveletMatrix.build(ids), zstandard.ZstdCompressor(level=1).compress
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [known.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), lengths.astype("<i8").tobytes()]
    for plane, ones in zip(matrix.planes, matrix.ones_before, strict=True):
        parts += [plane.tobytes(), ones.astype("<i8").tobytes()]
    packed = [pack(p) for p in parts]
    sizes = struct.pack(f"<{len(packed)}Q", *map(len, packed)) + struct.pack(f"<{matrix.bits}Q", *matrix.zeros)
    return _HEAD.pack(MAGIC, matrix.bits, len(packed), matrix.n, len(doc_ids)) + sizes + b"".join(packed)


def from_file(file: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, their lengths in ids, and the matrix."""
    magic, bits, n_parts, n, _ = _HEAD.unpack_from(file)
    if magic != MAGIC:
        raise ValueError("not a shard file")
    sizes = struct.unpack_from(f"<{n_parts}Q", file, _HEAD.size)
    zeros = struct.unpack_from(f"<{bits}Q", file, _HEAD.size + 8 * n_parts)
    at, unpack, parts = _HEAD.size + 8 * (n_parts + bits), zstandard.ZstdDecompressor().decompress, []
    for size in sizes:
        parts.append(unpack(file[at : at + size]))
        at += size
    known, ids = np.frombuffer(parts[0], np.uint8), np.frombuffer(parts[1], "<i8").tolist()
    planes = [np.frombuffer(p, np.uint8) for p in parts[3::2]]
    matrix = WaveletMatrix(n, bits, planes, list(zeros), [np.frombuffer(p, "<i8") for p in parts[4::2]])
    return [d if k else None for d, k in zip(ids, known, strict=True)], np.frombuffer(parts[2], "<i8"), matrix


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode all documents, each followed by end_id, and write shard files in ascending doc_id order.

    Returns the written table: part, nth (together the files' order), n_docs, n_tokens, file (binary). One range
    shuffle by doc_id and a hash of the text carries the texts, so rows of one id can be many; they stand in the order of that hash, null ids first. Null and empty texts
    have the one id end_id; extra columns are ignored; an empty table gives no file.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, nth = from_json(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.uint16 if not tokenizer.wide and end_id < 1 << 16 else np.uint32)
        doc_ids, ids, total = [], [], 0

        def close() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in ids], np.int64)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([total], pa.int64()), bytes_array([to_file(doc_ids, lengths, np.concatenate(ids))])], ["part", "nth", "n_docs", "n_tokens", "file"])

        for batch in batches:
            for rows in sliced(batch, "text"):
                for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                    doc_ids.append(doc_id)
                    ids.append(np.concatenate([tokenizer.ids(text).astype(end.dtype), end]))
                    total += len(ids[-1])
                    if total >= shard_tokens:
                        yield close()
                        doc_ids, ids, total, nth = [], [], 0, nth + 1
        if ids:
            yield close()

    # The hash lets ranges end within the rows of one id, or of none.
    ordered = text_rows(docs).withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    return materialise(ordered.mapInArrow(build, "part int, nth int, n_docs long, n_tokens long, file binary"), "shards", "none")


def read_shards(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Sent to the driver: one total for each file.
    """
    totals = sorted((r.part, r.nth, r.n_tokens) for r in files.select("part", "nth", "n_tokens").collect())
    base = dict(zip([t[:2] for t in totals], np.cumsum([0] + [t[2] for t in totals]).tolist(), strict=False))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, nth, file = (batch.column(c)[row].as_py() for c in ("part", "nth", "file"))
                doc_ids, lengths, matrix = from_file(file)
                starts, raw = np.cumsum(lengths) - lengths, memoryview(matrix.ids().astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * s : 4 * (s + m)]) for s, m in zip(starts.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts + base[part, nth]), pa.array(lengths), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("part", "nth", "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def count_token(files: DataFrame, token: int) -> DataFrame:
    """part, nth, occurrences of one id, by rank on each file."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [from_file(f)[2].count(token) for f in batch.column("file").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("nth"), pa.array(n, pa.int64())], ["part", "nth", "n"])

    return files.select("part", "nth", "file").mapInArrow(count, "part int, nth int, n long")


def corpus_positions(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    return read_shards(write_shards(docs, tokenizer_path, end_id)).select(F.col("doc_id"), "start", "n_tokens", "ids_crc32")
