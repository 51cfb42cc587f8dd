"""Collocations: phrases that occur much more often than their parts would together, mined level by level (Apriori).

Pass k over the texts counts the phrases of k words. From level 2 on a task emits a phrase only if the two phrases of k - 1 words
that overlap in it are frequent, which a bitmap of hashes of the frequent ones tells; the bitmap is what is broadcast. It has at
most MAX_BITS bits whatever the corpus, since a phrase that it lets through by chance is counted exactly all the same and falls below
the least count. Tasks count the phrases of a slice before they leave Python, Spark adds them up before and after the shuffle.
The tables of the levels hold the frequent phrases with their exact counts; cuts are scored by joins of these tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.common import materialise, sliced
from inkveil.llm.words import LOWER, gathered, joined_words, run_hashes, text_buffer, word_edges, word_hashes

MOST_WORDS, LEAST_COUNT, TOP, ABSORBED = 5, 100, 2000, 100
#: Bits of the bitmap for each frequent phrase, and at most (16 MB).
BITS_EACH, MAX_BITS = 32, 1 << 27
#: Text bytes whose phrases are counted together in a task.
SLICE = 3 << 20
#: Parts of a language whose best phrases are found apart.
SALTS = 64
_CUT = np.array([b in b".,;:!?" or 0x0A <= b <= 0x0D for b in range(256)])
_WORD = ~_CUT & np.array([b not in (0x20, 0x09) for b in range(256)])
_ROWS = "lang string, phrase string, n long"


def _language_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _hashes(words: pa.Array) -> np.ndarray:
    data, offsets = text_buffer(words)
    return word_hashes(data, offsets[:-1], offsets[1:])


class Bitmap:
    """Which hashes of phrases may be frequent."""

    def __init__(self, bits: int):
        self.mask = np.uint64(bits - 1)
        self.held = np.zeros(bits // 64, np.uint64)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the 64-bit word, and the bit within it."""
        low = hashes & self.mask
        return (low >> np.uint64(6)).astype(np.int64), low & np.uint64(63)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        at, bit = self.places(hashes)
        return (self.held[at] >> bit & np.uint64(1)).astype(bool)


class Slice:
    """The words of some texts: a number for each distinct word, hashes, and the piece of text that each stands in."""

    def __init__(self, rows: pa.RecordBatch):
        raw, offsets = text_buffer(rows.column("text"))
        data = LOWER[raw]
        start, stop, first = word_edges(data, offsets, _WORD)
        cuts = np.cumsum(_CUT[data])[start] if len(start) else start
        begins = np.diff(cuts, prepend=-1) != 0
        begins[first[:-1][first[:-1] < len(start)]] = True
        self.piece = np.cumsum(begins, dtype=np.int32)
        self.line, self.end = joined_words(data, start, stop)
        self.begin = self.end - (stop - start)
        langs = rows.column("lang").dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        self.lang = np.repeat(langs.indices.to_numpy(), np.diff(first))
        self.word, self.hash, self.distinct = np.empty(0, np.int32), np.empty(0, np.uint64), 0
        if len(start):
            known = gathered(self.line, self.begin, self.end).dictionary_encode()
            self.word, self.distinct = known.indices.to_numpy(), len(known.dictionary)
            self.hash = _hashes(known.dictionary)[self.word] ^ np.array([_language_hash(x) for x in self.langs], np.uint64)[self.lang]

    def counted(self, size: int, frequent: Bitmap | None) -> pa.RecordBatch:
        """The phrases of `size` words that may be frequent, with their counts in the slice; at size 1 also, as the empty phrase, all words."""
        if size == 1:
            code = self.lang.astype(np.int64) * self.distinct + self.word
            n = np.bincount(code)
            some = np.flatnonzero(n)
            at = np.zeros(len(n), np.int64)
            at[code] = np.arange(len(code))
            at, n = at[some], n[some]
            total = np.bincount(self.lang, minlength=len(self.langs))
            return self._rows(at, 1, n, [(lang, int(t)) for lang, t in zip(self.langs, total, strict=True) if t])
        within = self.piece[: -size + 1] == self.piece[size - 1 :]
        may = frequent.may_hold(run_hashes(self.hash, size - 1))
        at = np.flatnonzero(within & may[:-1] & may[1:])
        _, one, group, n = np.unique(run_hashes(self.hash, size)[at], return_index=True, return_inverse=True, return_counts=True)
        same = self.lang[at] == self.lang[at[one]][group]
        for k in range(size):
            same &= self.word[at + k] == self.word[at[one] + k][group]
        if not same.all():  # two phrases of one hash: tell them apart by their words
            rows = np.stack([self.lang[at], *(self.word[at + k] for k in range(size))], 1)
            _, one, n = np.unique(rows, axis=0, return_index=True, return_counts=True)
        return self._rows(at[one], size, n, [])

    def _rows(self, at: np.ndarray, size: int, n: np.ndarray, totals: list[tuple[str, int]]) -> pa.RecordBatch:
        langs = pa.DictionaryArray.from_arrays(pa.array(self.lang[at], pa.int32()), pa.array(self.langs, pa.string())).cast(pa.string())
        phrases = gathered(self.line, self.begin[at], self.end[at + size - 1])
        more = [pa.array([x for x, _ in totals], pa.string()), pa.array([""] * len(totals), pa.string()), pa.array([t for _, t in totals], pa.int64())]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip((langs, phrases, pa.array(n, pa.int64())), more, strict=True)], ["lang", "phrase", "n"])


def _bitmap(level: DataFrame, size: int) -> Bitmap:
    """The bitmap of the phrases of a level; its 64-bit words (at most MAX_BITS / 64) reach the driver already joined."""
    out = Bitmap(min(MAX_BITS, 1 << max(10, (BITS_EACH * level.count()).bit_length())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            raw, offsets = text_buffer(rows.column("phrase"))
            start, stop, _ = word_edges(raw, offsets, _WORD)
            langs = rows.column("lang").dictionary_encode()
            lang = np.array([_language_hash(x) for x in langs.dictionary.to_pylist()], np.uint64)[langs.indices.to_numpy()]
            words = word_hashes(raw, start, stop) ^ np.repeat(lang, size)
            at, bit = out.places(run_hashes(words, size)[::size])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array((np.uint64(1) << bit).view(np.int64))], ["at", "bits"])

    held = level.select("lang", "phrase").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out.held[held.column("at").to_numpy()] = held.column("bits").to_numpy().view(np.uint64)
    return out


def _level(rows: DataFrame, size: int, frequent: Bitmap | None, least: int) -> DataFrame:
    """lang, phrase, n: the frequent phrases of `size` words; at size 1 also, as the empty phrase, the number of all words."""
    sent = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text", SLICE):
                words = Slice(part)
                if len(words.word) >= size:
                    yield words.counted(size, sent.value)

    counts = rows.mapInArrow(run, _ROWS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return materialise(counts.filter((F.col("n") >= least) | (F.col("phrase") == "")), f"phrases{size}")


def frequent_phrases(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST_COUNT, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n, size) of all phrases of up to `most_words` words that occur `least` times or more, and (lang, n) of all words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(text.alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    words = _level(rows, 1, None, least)
    totals = words.filter("phrase = ''").select("lang", "n")
    levels = [words.filter(f"phrase <> '' and n >= {least}")]
    while len(levels) < most_words and not levels[-1].isEmpty():
        size = len(levels)
        levels.append(_level(rows, size + 1, _bitmap(levels[-1], size), least))
    out = levels[0].withColumn("size", F.lit(1))
    for size, level in enumerate(levels[1:], 2):
        out = out.unionByName(level.withColumn("size", F.lit(size)))
    return out, totals


def scored(phrases: DataFrame, totals: DataFrame, absorbed: int = ABSORBED) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the candidates (two words and more) that no longer candidate absorbs, each by its worst cut.

    The cut after k words scores floor(1000 * a * n / (l * r)), in exact decimals; the least score counts, of equal ones the
    smallest k. A candidate goes if a longer one around it has at least absorbed percent of its count. A longer one that does contains one
    of one word more that does as well (it is at least as frequent), so only those are looked at.
    """
    cuts = phrases.filter("size >= 2").select("lang", "phrase", F.col("n").alias("a"), F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    part = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    score = F.expr("(cast(a as decimal(20,0)) * 1000 * cast(n as decimal(20,0))) div (cast(l as decimal(20,0)) * cast(r as decimal(20,0)))")
    worst = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a", "n")).alias("w")).select("lang", "phrase", "w.a", "w.l", "w.r", "w.n", "w.score")
    longer = phrases.filter("size >= 3").select("lang", "n", F.explode(F.expr("array(substring_index(phrase, ' ', size - 1), substring(phrase, length(substring_index(phrase, ' ', 1)) + 2))")).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("n").alias("around"))
    return worst.join(longer, ["lang", "phrase"], "left").filter(f"around is null or 100 * around < {absorbed} * a").drop("around")


def collocations(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST_COUNT, top: int = TOP, absorbed: int = ABSORBED) -> DataFrame:
    """The first `top` phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    Texts are cut at . , ; : ! ? and line ends (0A to 0D) into pieces, these at spaces and tabs into words, A-Z in lower case. Ranked by score and a,
    both descending, then by the phrase's bytes. A null language is `und`; null and empty texts have no words; repeated rows count each; other
    columns are ignored; without a frequent phrase a language has no rows, an empty table gives none. least is 1 or more.
    """
    phrases, totals = frequent_phrases(docs, most_words, least)
    found = scored(phrases, totals, absorbed)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language may hold most phrases: first the best of each of its parts, then the best of those.
    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
