"""Terms that a reviewer gives: matching, merging with what is there, and searching whole documents."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.text import SPAN, Blocks, let, normalise_term, running_totals, with_blocks
from inkveil.operators.groups import grown


def literal_spans(text: Column, term: Column) -> Column:
    """Non-overlapping places of a term (any case) in a text, by cutting the lower-cased text at the term."""
    low = F.lower(text)

    def placed(gaps: Column) -> Column:
        ends = running_totals(F.transform(F.slice(gaps, 1, F.size(gaps) - 1), lambda g: F.length(g) + F.length(term)))  # no place follows the last gap
        span = lambda end, own: F.struct(own.slice(end - F.length(term), F.length(term)).alias("text"), (end - F.length(term)).alias("start_char"), end.alias("end_char"))
        return with_blocks(text, lambda own: F.transform(ends, lambda end: span(end, own)))

    gaps = F.call_function("split", low, F.concat(F.lit(r"\Q"), term, F.lit(r"\E")), F.lit(-1))
    return F.when(low.contains(term), let(gaps, placed)).otherwise(F.array().cast(SPAN))


def term_matches(docs: DataFrame, terms: DataFrame, ground: str = "5.1.2e") -> DataFrame:
    """doc_id, ord, term, woo_article, text, start_char, end_char of each document's own terms (doc_id, ord, term and, if given,
    match_mode and woo_article). Modes other than 'exact' are skipped; a term without a ground has the default one."""
    own = terms if "match_mode" not in terms.columns else terms.filter("coalesce(match_mode, 'exact') = 'exact'")
    article = F.coalesce(F.col("woo_article"), F.lit(ground)) if "woo_article" in terms.columns else F.lit(ground)
    own = own.select("doc_id", "ord", normalise_term(F.col("term")).alias("term"), article.alias("woo_article")).filter("term <> ''")
    return docs.join(grown(own), "doc_id").select("doc_id", "ord", "term", "woo_article", F.inline(literal_spans(F.col("text"), F.col("term"))))


class _Taken:
    """Which of a document's rows each match takes over: the first in the rows' order that it overlaps, else a new row.

    Offsets become whole numbers of which an interval holds those strictly inside it (2 a + 1 to 2 e - 1), so that empty rows count as well.
    The given rows are painted onto the elementary stretches between their borders, each stretch with the first row over it; new rows never
    overlap each other and are kept sorted.
    """

    def __init__(self, starts: list[int | None], ends: list[int | None]):
        self.n, self.fresh = len(starts), []
        ranges = [_inside(s, e) for s, e in zip(starts, ends, strict=True)]
        self.borders = sorted({x for r in ranges if r for x in (r[0], r[1] + 1)})
        self.owner = np.full(len(self.borders), len(starts), np.int64)
        free = list(range(len(self.borders) + 1))  # the next stretch that is not painted

        def next_free(i: int) -> int:
            while free[i] != i:
                free[i] = i = free[free[i]]
            return i

        for row, r in enumerate(ranges):
            if r:
                i, stop = next_free(bisect_left(self.borders, r[0])), bisect_left(self.borders, r[1] + 1)
                while i < stop:
                    self.owner[i], free[i] = row, i + 1
                    i = next_free(i)

    def place(self, start: int, end: int) -> int:
        low, high = _inside(start, end)
        first, after = max(bisect_right(self.borders, low) - 1, 0), bisect_right(self.borders, high)
        row = int(self.owner[first:after].min(initial=self.n))
        if row < self.n:
            return row
        begin = bisect_left(self.fresh, (low, -1, -1))
        begin -= begin > 0 and self.fresh[begin - 1][1] >= low
        met = [number for _, _, number in self.fresh[begin : bisect_right(self.fresh, (high + 1, -1, -1))]]
        if met:
            return min(met)
        number = self.n + len(self.fresh)
        insort(self.fresh, (low, high, number))
        return number


def _inside(start: int | None, end: int | None) -> tuple[int, int] | None:
    if start is None or end is None or end < start:
        return None
    return (2 * start + 1, 2 * end - 1) if end > start else (2 * start, 2 * start)


def merge_terms(detections: DataFrame, matches: DataFrame) -> DataFrame:
    """Each match in order takes over the first detection that it overlaps (earlier matches included), else it is a new detection.

    Detections stand in their own order (pos, or by offset where there is no such column). The last term's ground wins. The merge
    depends on the order, so it is done within the row of a document; its work grows like n log n with the rows and matches. Returns
    doc_id, pos, text, start_char, end_char, review_status, source, confidence, woo_article.
    """
    fields = ("start_char", "end_char", "text", "review_status", "source", "confidence", "woo_article")
    place = F.col("pos") if "pos" in detections.columns else F.struct("start_char", "end_char")
    listed = F.array_sort(F.collect_list(F.struct(place.alias("pos"), F.struct(*fields).alias("d"))))
    base = detections.groupBy("doc_id").agg(F.transform(listed, lambda x: x["d"]).alias("base"))
    hits = matches.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "start_char", "end_char", "text", "woo_article"))).alias("hits"))
    both = base.join(grown(hits), "doc_id", "full").select("doc_id", "base", "hits")
    kind = detections.schema["doc_id"].dataType.simpleString()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {name: [] for name in ("doc_id", "pos", *fields)}
            for doc_id, rows, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "base", "hits")), strict=True):
                rows = list(rows or [])
                taken = _Taken([r["start_char"] for r in rows], [r["end_char"] for r in rows])
                for h in found or []:
                    at = taken.place(h["start_char"], h["end_char"])
                    if at == len(rows):
                        rows.append({"start_char": h["start_char"], "end_char": h["end_char"], "text": h["text"], "confidence": 0.99})
                    rows[at] |= {"review_status": "accepted", "source": "custom_wordlist", "woo_article": h["woo_article"]}
                out["doc_id"] += [doc_id] * len(rows)
                out["pos"] += range(len(rows))
                for name in fields:
                    out[name] += [r[name] for r in rows]
            types = {"pos": pa.int32(), "start_char": pa.int32(), "end_char": pa.int32(), "confidence": pa.float64(), "doc_id": batch.schema.field("doc_id").type}
            yield pa.RecordBatch.from_arrays([pa.array(v, types.get(name, pa.string())) for name, v in out.items()], list(out))

    return both.mapInArrow(merged, f"doc_id {kind}, pos int, start_char int, end_char int, text string, review_status string, source string, confidence double, woo_article string").select("doc_id", "pos", *fields)


def search(pages: DataFrame, needle: str, context: int = 24) -> DataFrame:
    """doc_id, page, text, start_char, end_char, snippet of a needle of two characters or more, in any case and without overlaps."""
    term, text = normalise_term(F.lit(needle)), F.col("text")

    def shown(own: Blocks, length: Column) -> Column:
        def row(s: Column) -> Column:
            begin = F.greatest(s["start_char"] - context, F.lit(0))
            around = F.concat(F.when(begin > 0, "…").otherwise(""), own.slice(begin, s["end_char"] - begin + context), F.when(length > s["end_char"] + context, "…").otherwise(""))
            return s.withField("snippet", F.trim(F.regexp_replace(around, r"(?U)\s+", " ")))

        return F.transform(literal_spans(text, term), row)

    return pages.filter(F.length(term) >= 2).select("doc_id", "page", F.inline(with_blocks(text, lambda own: let(F.length(text), lambda n: shown(own, n)))))
