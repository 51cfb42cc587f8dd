"""Words of a column of texts, found on the bytes of its Arrow buffer: no text becomes a Python string."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Each byte with A-Z in lower case.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Bytes of words of letters and digits: all but 00-2F, 3A-60 and 7B-7F once A-Z are in lower case.
ALNUM = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: A word of more bytes is hashed by itself.
LONG_WORD = 256

_U = np.uint64
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
_ODD = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without nulls, and the n + 1 places where its texts begin and end."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_edges(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word begins and ends, and (n + 1 numbers) the first word of each text; a word ends with its text."""
    inside = in_word[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts], after[cuts - 1] = False, False
    start, stop = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, stop, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes of all of them at a time; equal bytes have equal hashes in every process."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    length = stop - start
    out = mix(length.astype(_U) * _ODD)
    live, at = np.flatnonzero((length > 0) & (length <= LONG_WORD)), 0
    while len(live):
        left = length[live] - at
        out[live] = mix(out[live] * _ODD ^ (eights[start[live] + at] & _MASK[np.minimum(left, 8)]))
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : stop[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """For each place the hash of the `size` words from there on; the last size - 1 places have none."""
    many = max(0, len(words) - size + 1)
    out = np.full(many, size, _U)
    for k in range(size):
        out = mix(out * _ODD ^ words[k : k + many])
    return out


def gathered(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """The byte ranges as a string column; they have to hold whole characters."""
    length = stop - start
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    taken = data[np.repeat(start - (ends - length), length) + np.arange(total)]
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(length), pa.py_buffer(offsets), pa.py_buffer(taken)).cast(pa.string())


def joined_words(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words in one line with one space after each, and where each ends there."""
    ends = np.cumsum(stop - start + 1) - 1
    line = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
    held, inside = np.zeros(len(data) + 1, np.int8), np.ones(len(line), bool)
    held[start] += 1
    held[stop] -= 1
    inside[ends] = False
    line[inside] = data[np.cumsum(held[:-1], dtype=np.int8).view(bool)]
    return line, ends
