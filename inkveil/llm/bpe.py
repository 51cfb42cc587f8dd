"""Byte-level BPE encoding and decoding as a tree reduction over a monoid.

A text is cut into halves again and again down to leaves; two encoded neighbours are joined by
re-encoding a window around their border. The window grows until it ends on both sides at a place
where tokens outside cannot change:

* between two pieces of the splitting pattern, at a border that any context leaves in place
  (after a letter run, after a digit run, or before white space that follows something else), or
* within one long piece, where the token outside and the first token of the window are a *stable pair*:
  encoding their joined bytes gives the two again. A token sequence is the encoding of its bytes exactly if
  all its neighbours are stable pairs, so nothing further out can change.

Decoding concatenates bytes up the same tree.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import bytes_array, map_slices, text_rows
from inkveil.llm.tokenizing import PATTERN, from_ranks

LEAF = 2048
_BORDER = regex.compile(r"\p{L}(?=\P{L})|\p{N}(?=\P{N})|\S(?=\s)")


class TreeCodec:
    """Encoder and decoder for one rank file. `leaf`: characters (encoding) or ids (decoding) of a leaf."""

    def __init__(self, path: str, pattern: str = PATTERN, leaf: int = LEAF):
        self.bpe, self.pattern, self.leaf = from_ranks(path, pattern), regex.compile(pattern), leaf
        self.bytes_of = {i: token for token, i in self.bpe._mergeable_ranks.items()}

    def plain(self, text: str) -> np.ndarray:
        return self.bpe.encode_to_numpy(text, disallowed_special=()) if text else np.empty(0, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> np.ndarray:
        if hi - lo <= self.leaf:
            return self.plain(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def join(self, text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of text[lo:hi] from those of its halves."""
        begin, end = self._before(text, lo, mid), self._after(text, mid, hi)
        if begin == mid:
            return np.concatenate([left, right])
        if end - begin > self.leaf and all(self.pattern.fullmatch(text, a, b) for a, b in ((begin, end), (begin, mid), (mid, end))):
            a, b = (len(left) if begin == lo else len(self.encode(text[begin:mid]))), (len(right) if end == hi else len(self.encode(text[mid:end])))
            window = self._within_piece(left[len(left) - a :], right[:b])
        else:
            a, b, window = len(self.plain(text[begin:mid])), len(self.plain(text[mid:end])), self.plain(text[begin:end])
        return np.concatenate([left[: len(left) - a], window, right[b:]])

    def _before(self, text: str, lo: int, mid: int) -> int:
        """The last fixed border in (lo, mid], else lo."""
        if _BORDER.match(text, mid - 1, mid + 1):
            return mid
        width = 32
        while True:
            start, last = max(lo, mid - width), None
            for last in _BORDER.finditer(text, start, mid):
                pass
            if last or start == lo:
                return last.end() if last else lo
            width *= 4

    def _after(self, text: str, mid: int, hi: int) -> int:
        found = _BORDER.search(text, mid, hi)
        return found.end() if found else hi

    def _stable(self, a: int, b: int) -> bool:
        return self.bpe._encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def _within_piece(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        width = 1
        while True:
            a, b = left[-width:].tolist(), right[:width].tolist()
            window = self.bpe._encode_single_piece(b"".join(map(self.bytes_of.__getitem__, a + b)))
            outer_a, outer_b = left[: len(left) - len(a)], right[len(b) :]
            if (not len(outer_a) or self._stable(int(outer_a[-1]), window[0])) and (not len(outer_b) or self._stable(window[-1], int(outer_b[0]))):
                return np.concatenate([outer_a, np.array(window, np.uint32), outer_b])
            width *= 2

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(maxsize=4)
def codec(path: str, pattern: str = PATTERN, leaf: int = LEAF) -> TreeCodec:
    return TreeCodec(path, pattern, leaf)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str = PATTERN, leaf: int = LEAF) -> DataFrame:
    """One row per row of docs: doc_id, ids (binary: little-endian unsigned 32-bit), n_tokens.

    Null and empty texts give empty ids and 0; repeated rows give repeated rows; a null doc_id stays null;
    an empty table gives an empty one; columns besides doc_id and text are ignored. Narrow: no shuffle.
    """

    def encode(rows: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(ranks_path, pattern, leaf)
        ids = [own.encode(t) for t in rows.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), bytes_array([x.astype("<u4").tobytes() for x in ids]), pa.array([len(x) for x in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])

    return map_slices(text_rows(docs), encode, "doc_id long, ids binary, n_tokens long")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str = PATTERN, leaf: int = LEAF) -> DataFrame:
    """The rows of `encode_documents` with decoded (binary); null ids decode to no bytes."""

    def decode(rows: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(ranks_path, pattern, leaf)
        decoded = [own.decode(np.frombuffer(x or b"", "<u4")) for x in rows.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([*rows.columns, bytes_array(decoded)], ["doc_id", "ids", "n_tokens", "decoded"])

    return map_slices(encoded.select("doc_id", "ids", "n_tokens"), decode, "doc_id long, ids binary, n_tokens long, decoded binary", column="ids")


def round_trip_digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    both = decode_documents(encode_documents(docs, ranks_path), ranks_path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
