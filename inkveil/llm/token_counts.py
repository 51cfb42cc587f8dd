"""Exact token counts of every prefix of a text, by dynamic programming.

Within one piece of the splitting pattern, the encoding of a prefix is the encoding of a shorter prefix
plus one token; it is the longest vocabulary entry ending there that forms a stable pair with the
last token of the shorter prefix. So one pass gives the count of every prefix. Counts of whole pieces add up.
Places where a cut changes the split itself (runs of white space before a word, cut contractions, cut
special strings) are corrected, so that each stored count equals what encoding that prefix would give.

A position within a character has the count of the last whole character. The stored form keeps the steps between the
counts of successive prefixes as signed bytes, with a whole 32-bit count at every 512th prefix (a text with a larger step keeps
32-bit counts only). It answers `count_at`, `longest_prefix` and budget questions alone, without the text or the tokenizer.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from inkveil.llm.common import bytes_array, map_slices, text_rows
from inkveil.llm.tokenizing import PATTERN, from_json

#: Bytes that a worker's memory of pieces and their tables may take, and its entries of token pairs, before it starts anew;
#: longer pieces (in characters) are not remembered.
MEMORY, MOST_PAIRS, LONG_PIECE = 160 << 20, 800_000, 1024
#: Distance of whole counts in the stored form.
STEP = 512
_SPACES, _MAYBE_SPACES = regex.compile(r"\s{2,}(?=\S)"), re.compile(r"\s\s")
_CONTRACTIONS = ("'re", "'ve", "'ll")


class PrefixCounter:
    """Counts for a plain byte-level BPE whose merges stand in the order of their ids; any other vocabulary raises ValueError,
    since the longest-token rule holds only there."""

    def __init__(self, path: str, pattern: str = PATTERN):
        tokenizer = from_json(path)
        if tokenizer.encoding is None:
            raise ValueError(f"{path} is not a byte-level BPE in merge order")
        self.bpe, self.ranks = tokenizer.encoding, tokenizer.encoding._mergeable_ranks
        self.pattern, self.longest = regex.compile(pattern), max(map(len, self.ranks))
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.special = regex.compile("|".join(map(regex.escape, tokenizer.special))) if tokenizer.special else None
        self.pieces: dict[str, bytes] = {}
        self.held = 0  # bytes, about
        self.tables: dict[bytes, bytes] = {}  # one copy of each table: pieces are many, tables few
        self.pairs: dict[int, bool] = {}

    def _stable(self, pair: int) -> bool:
        a, b = pair >> 32, pair & 0xFFFFFFFF
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        known = self.pairs[pair] = self.bpe._encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def _dp(self, piece: bytes) -> list[int]:
        """Counts of the prefixes of 1, 2, ... bytes. Only one token ends each prefix's encoding, so the order of trying is free: short ones are likelier."""
        ranks, pairs, longest = self.ranks, self.pairs, self.longest
        last, counts = [-1], [0]
        for i in range(1, len(piece) + 1):
            for j in range(i - 1, max(-1, i - 1 - longest), -1):
                token = ranks.get(piece[j:i])
                if token is not None:
                    if j:
                        key = last[j] << 32 | token
                        known = pairs.get(key)
                        if not (self._stable(key) if known is None else known):
                            continue
                    last.append(token)
                    counts.append(counts[j] + 1)
                    break
        return counts[1:]

    def piece(self, text: str) -> bytes:
        """Prefix counts of a piece as little-endian signed 32-bit numbers."""
        raw = text.encode()
        counts = self._dp(raw)
        if len(raw) > len(text):  # within a character, the count before it holds
            held = 0
            for i in range(len(raw)):
                if i + 1 < len(raw) and raw[i + 1] & 0xC0 == 0x80:
                    counts[i] = held
                held = counts[i]
        if text in _CONTRACTIONS:  # cut short, the apostrophe stands alone
            counts[1] = 2
        table = np.array(counts, "<i4").tobytes()
        return self.tables.setdefault(table, table) if len(text) <= LONG_PIECE else table

    def ordinary(self, text: str) -> np.ndarray:
        """Prefix counts of a text without special strings."""
        pieces, known = self.pattern.findall(text), self.pieces
        try:
            parts = list(map(known.__getitem__, pieces))
        except KeyError:
            if self.held >= MEMORY:
                known.clear()
                self.tables.clear()
                self.held = 0
            fresh = {p: self.piece(p) for p in dict.fromkeys(pieces) if p not in known}
            parts = [known.get(p) or fresh[p] for p in pieces]
            for p, table in fresh.items():
                if len(p) <= LONG_PIECE:
                    known[p] = table
                    self.held += 200 + len(p) + len(table)
        counts = np.frombuffer(b"".join(parts), "<i4").copy()
        if len(parts) > 1:
            lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
            ends = np.cumsum(lengths) - 1
            before = np.concatenate([[0], np.cumsum(counts[ends])[:-1]])
            counts += np.repeat(before, lengths).astype("<i4")
            self._fix_spaces(text, counts)
        return counts

    def _fix_spaces(self, text: str, counts: np.ndarray) -> None:
        """A prefix that ends with a run of white space has the run as one piece; in the whole text the run's last character goes to what follows."""
        found = list(_SPACES.finditer(text)) if _MAYBE_SPACES.search(text) else []
        at = 0 if text.isascii() else None
        for m in found:
            start, end = (m.start(), m.end()) if at == 0 else (len(text[: m.start()].encode()), len(text[: m.end()].encode()))
            base = int(counts[start - 1]) if start else 0
            run = np.frombuffer(self.piece(m.group()), "<i4")
            width = len(m.group()[-1].encode())
            counts[end - 1] = base + run[-1]
            counts[end - width : end - 1] = counts[end - width - 1]

    def counts(self, text: str) -> np.ndarray:
        """Token counts of the prefixes of 0, 1, 2, ... bytes of the text."""
        out, total, at = [np.zeros(1, "<i4")], 0, 0
        for m in self.special.finditer(text) if self.special else ():
            counts = self.ordinary(text[at : m.end()])  # the special string as far as it is not complete
            out.append(counts + total)
            whole = self.ordinary(text[at : m.start()])
            total += (int(whole[-1]) if len(whole) else 0) + 1
            out[-1][-1] = total
            at = m.end()
        rest = self.ordinary(text[at:]) if at < len(text) else np.empty(0, "<i4")
        return np.concatenate([*out, rest + np.int32(total)])


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def pack_counts(counts: np.ndarray) -> bytes:
    """The stored form of the counts of the prefixes of 0, 1, 2, ... bytes."""
    steps = np.diff(counts)
    if len(steps) and max(steps.max(), -steps.min()) > 127:
        return b"w" + counts.astype("<i4").tobytes()
    return b"s" + counts[::STEP].astype("<i4").tobytes() + steps.astype(np.int8).tobytes()


def unpack_counts(stored: bytes) -> np.ndarray:
    """All counts from the stored form."""
    if stored[:1] == b"w":
        return np.frombuffer(stored, "<i4", offset=1)
    steps = np.frombuffer(stored, np.int8, offset=1 + 4 * _blocks(stored))
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int32)])


def _blocks(stored: bytes) -> int:
    """Whole counts in the form with steps: n prefixes have ceil(n / STEP) of them and n - 1 steps."""
    return -(-len(stored) // (STEP + 4))


def prefix_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, and prefixes (binary, the stored form above).

    Null and empty texts: 0 bytes, 0 tokens, the one count 0. Repeated rows and null ids stay; extra columns are
    ignored; an empty table gives no rows.
    """

    def count(rows: pa.RecordBatch) -> pa.RecordBatch:
        own = counter(tokenizer_path)
        tables = [own.counts(t) for t in rows.column("text").to_pylist()]
        columns = [rows.column("doc_id"), pa.array([len(t) - 1 for t in tables], pa.int64()), pa.array([int(t[-1]) for t in tables], pa.int64()), bytes_array(list(map(pack_counts, tables)))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "prefixes"])

    return map_slices(text_rows(docs), count, "doc_id long, n_bytes long, n_tokens long, prefixes binary")


def count_at(prefixes: bytes, n_bytes: int) -> int:
    """Tokens of the first n_bytes bytes (of all, if there are fewer)."""
    if prefixes[:1] == b"w":
        table = np.frombuffer(prefixes, "<i4", offset=1)
        return int(table[min(n_bytes, len(table) - 1)])
    blocks = _blocks(prefixes)
    steps = np.frombuffer(prefixes, np.int8, offset=1 + 4 * blocks)
    at = min(n_bytes, len(steps))
    block = at // STEP
    return int(np.frombuffer(prefixes, "<i4", blocks, 1)[block]) + int(steps[block * STEP : at].sum(dtype=np.int64))


def longest_prefix(prefixes: bytes, budget: int) -> int:
    """Bytes of the longest prefix that has at most `budget` tokens (a prefix can have more tokens than a longer one)."""
    return int(np.flatnonzero(unpack_counts(prefixes) <= budget)[-1])


def within_budget(stored: DataFrame, budget: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_bytes, fit_tokens, read from stored prefixes alone: whether a text has more than
    `budget` tokens, and the bytes and tokens of its longest prefix within them."""

    def answer(rows: pa.RecordBatch) -> pa.RecordBatch:
        raw, sizes = rows.column("prefixes").to_pylist(), rows.column("n_bytes").to_pylist()
        total = [count_at(p, n) for p, n in zip(raw, sizes, strict=True)]
        fit = [n if t <= budget else longest_prefix(p, budget) for p, n, t in zip(raw, sizes, total, strict=True)]
        columns = [rows.column("doc_id"), rows.column("n_bytes"), pa.array(total, pa.int64()), pa.array([t > budget for t in total], pa.bool_()), pa.array(fit, pa.int64()), pa.array([count_at(p, n) for p, n in zip(raw, fit, strict=True)], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_bytes", "fit_tokens"])

    return map_slices(stored.select("doc_id", "n_bytes", "prefixes"), answer, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_bytes long, fit_tokens long", column="prefixes")
