"""Importance resampling towards a target distribution, on hashed word features.

The features of a text are its runs of up to `longest` words; a feature's bucket is its crc32 modulo BUCKETS. Texts are never turned
into Python strings: each byte of the Arrow buffer is classified by a lookup table, words begin and end where the class
differs, and the CRC's automaton is advanced over all words at once, one byte of each at a time. Counts of buckets over the raw and the target
texts give each bucket's gain; a text's weight is the sum of its gains, and adding Gumbel noise to it draws without replacement.

Ranks come from a sort by ranges: one number for each partition reaches the driver, whatever the number of documents.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import map_slices, materialise, sliced
from inkveil.llm.words import ALNUM, LOWER, text_buffer, word_edges

BUCKETS, LONGEST, LEAST_WORDS, SHARE, SEED = 10_000, 1, 20, 10, 2024
#: A word of more bytes goes through zlib instead of the common steps.
LONG_WORD = 64


def _crc_table() -> np.ndarray:
    """What each byte does to a CRC-32 register (polynomial EDB88320, bits from the lowest)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


_TABLE = _crc_table()


def _step(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return _TABLE[(state ^ byte) & 255] ^ state >> np.uint32(8)


def advance(state: np.ndarray, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes from start to stop of each; all words take a step together while they have bytes left."""
    length = stop - start
    state = state.copy()
    order = np.argsort(-np.minimum(length, LONG_WORD + 1), kind="stable")
    ranked = length[order]
    first, live = int((ranked > LONG_WORD).sum()), start[order]
    now = state[order]
    for k in range(int(ranked[first]) if first < len(ranked) else 0):
        some = slice(first, first + int(np.searchsorted(-ranked[first:], -k, side="left")))
        now[some] = _step(now[some], data[live[some] + k])
    for i in range(first):
        at = order[i]
        now[i] = zlib.crc32(data[start[at] : stop[at]], int(now[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    state[order] = now
    return state


def features(texts: pa.Array, longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of runs: (text, bucket) of each feature, and the number of words of each text."""
    raw, offsets = text_buffer(texts)
    data = LOWER[raw]
    start, stop, first = word_edges(data, offsets, ALNUM)
    words, owner = np.diff(first), np.repeat(np.arange(len(first) - 1), np.diff(first))
    state, at = np.full(len(start), 0xFFFFFFFF, np.uint32), np.arange(len(start))
    for size in range(1, longest + 1):
        if size > 1:  # the runs that go on within their text take a space and the next word
            goes_on = at + size - 1 < first[owner[at] + 1]
            state, at = _step(state[goes_on], 32), at[goes_on]
        state = advance(state, data, start[at + size - 1], stop[at + size - 1])
        yield owner[at], ((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(BUCKETS)).astype(np.int64), words


def bucket_counts(rows: DataFrame, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall into each bucket. Tasks add up their own; BUCKETS numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in sliced(batch, "text"):
                for _, bucket, _ in features(part.column("text"), longest):
                    held += np.bincount(bucket, minlength=BUCKETS)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["bucket", "n"])

    found = rows.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over its share in the raw texts."""
    s, t = float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + BUCKETS) / ((x + 1.0) * (t + BUCKETS)))) for x, y in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(rows: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features and weight (sum of the features' gains) of each row."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        n = part.num_rows
        n_features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for owner, bucket, words in features(part.column("text"), longest):
            n_features += np.bincount(owner, minlength=n)
            total = np.concatenate([[0], np.cumsum(gain[bucket])])
            at = np.searchsorted(owner, np.arange(n + 1))
            weight += total[at[1:]] - total[at[:-1]]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words), pa.array(n_features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return map_slices(rows, run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the hash of the seed and the id (null: no digits)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, eligible: str, order: list[Column], share: int) -> DataFrame:
    """scored (a written table) with `rank`: 1, 2, 3... for the first floor(share * N / 100) of the N eligible rows, null for the others.

    Rows are dealt to sorted ranges, equal ones too (by their place in the table), and numbered within them; totals of ranges, one number
    each, give the offsets.
    """
    placed = scored.withColumn("row", F.monotonically_increasing_id())
    keys = [F.expr(eligible).desc(), *order, F.asc("row")]
    n_parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()  # the partition's number, and the row's number in 33 bits
    dealt = materialise(placed.repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys).withColumn("at", at).drop("row"), "ranges")
    totals = sorted(tuple(r) for r in dealt.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*"), F.count_if(F.expr(eligible))).collect())
    drawn = share * sum(n for _, _, n in totals) // 100
    before = np.cumsum([0, *(n for _, n, _ in totals)]).tolist()
    base = dealt.sparkSession.createDataFrame([(p, b) for (p, _, _), b in zip(totals, before, strict=False)], "part long, base long")
    place = F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    rank = F.when(F.expr(eligible) & (place <= drawn), place)
    return dealt.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(base), "part").withColumn("rank", rank).drop("part", "at", "base")


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, least_words: int = LEAST_WORDS, share: int = SHARE, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, n_features, weight, score, rank (null where not drawn), all long.

    Drawn are the floor(share * N / 100) best scores of the N documents of at least `least_words` words, ties to the smaller
    doc_id, then to fewer features; a null doc_id comes last. Null and empty texts have no features and weigh 0; repeated rows are scored and drawn each; extra
    columns are ignored; without target texts all gains come from the raw ones; an empty table gives an empty one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    gain = gains(bucket_counts(rows, longest), bucket_counts(target.select(text), longest))
    scored = materialise(weighed(rows, gain, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights")
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    return ranked(scored, f"n_words >= {least_words}", order, share).select("doc_id", "n_features", "weight", "score", "rank")
