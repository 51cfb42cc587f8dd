"""Spans of pattern matches with code-point offsets, and text normalisation, as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MARK = "\uFDD0"
SPAN = "array<struct<text:string,start_char:int,end_char:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, also where body uses it within other lambdas (those compute what they name anew each time)."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Running totals are added up in blocks of so many numbers, so that work grows in proportion to an array's length.
_BLOCK = 64


def running_totals(numbers: Column) -> Column:
    """For each number of an array the sum of those up to it."""

    def from_base(block: Column, base: Column) -> Column:
        sums = F.aggregate(block, F.array(base), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
        return F.slice(sums, 2, F.size(block))

    def placed(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, n: acc + n))
        bases = F.aggregate(totals, F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
        return let(bases, lambda own: F.flatten(F.transform(blocks, lambda b, i: from_base(b, F.get(own, i)))))

    def cut(own: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(own), F.lit(1)), F.lit(_BLOCK))
        return let(F.transform(firsts, lambda i: F.slice(own, i, _BLOCK)), placed)

    return let(numbers, cut)


def match_many(text: Column, patterns: Sequence[tuple[str, Column | None]]) -> Column:
    """For each (Java pattern, cheap test that a text with matches passes, or None) the array of all its matches (never empty ones)
    as (text, start_char, end_char).

    One pass a pattern puts a mark before and after each match (a code point that Unicode keeps free; should a text hold it, it
    is matched as a space and given back as it is); cut at the marks, matches and what stands between them alternate, and
    running totals of their lengths give the places.
    """
    clean = F.when(text.contains(_MARK), F.translate(text, _MARK, " ")).otherwise(text)
    own = lambda s: F.struct(text.substr(s["start_char"] + 1, s["end_char"] - s["start_char"]).alias("text"), s["start_char"].alias("start_char"), s["end_char"].alias("end_char"))
    marked = F.array(*[F.when(text.rlike(p) if test is None else test, F.regexp_replace(clean, F.lit(p), F.lit(f"{_MARK}$0{_MARK}"))) for p, test in patterns])
    found = F.transform(marked, lambda m: place_matches(F.split(m, _MARK, -1)))
    return F.when(text.contains(_MARK), F.transform(found, lambda spans: F.transform(spans, own))).otherwise(found)


def match_spans(text: Column, pattern: str, only_if: Column | None = None) -> Column:
    """The matches of one pattern."""
    return F.get(match_many(text, [(pattern, only_if)]), F.lit(0))


def place_matches(parts: Column) -> Column:
    """Spans from an array of texts of which every second one is a match."""

    def placed(own: Column) -> Column:
        matches = F.filter(own, lambda p, i: i % 2 == 1)
        gaps = F.filter(own, lambda p, i: (i % 2 == 0) & (i + 1 < F.size(own)))
        ends = running_totals(F.zip_with(gaps, matches, lambda g, m: F.length(g) + F.length(m)))
        return F.zip_with(matches, ends, lambda m, end: F.struct(m.alias("text"), (end - F.length(m)).alias("start_char"), end.alias("end_char")))

    return let(parts, lambda own: F.when(F.size(own) > 1, placed(own)).otherwise(F.array().cast(SPAN)))


def find_spans(docs: DataFrame, pattern: str, text_col: str = "text", keys: tuple[str, ...] = ("doc_id",), only_if: Column | None = None) -> DataFrame:
    """One row per match: keys, text, start_char, end_char. No shuffle."""
    return docs.select(*keys, F.inline(match_spans(F.col(text_col), pattern, only_if)))


def first_in(window: Column, pattern: str) -> tuple[Column, Column]:
    """(text, offset) of the first match in a short slice; the text is empty if there is none."""
    return F.regexp_extract(window, pattern, 0), F.length(F.element_at(F.split(window, pattern, 2), 1))


#: Slices of up to so many characters are cut from overlapping blocks of a text, so that one far behind costs no more than one in front.
_REACH = 2048


class Blocks:
    """A text cut into overlapping blocks: block i holds the characters from i * _REACH on, twice _REACH of them."""

    def __init__(self, column: Column):
        self.column = column

    def slice(self, start: Column, n: Column) -> Column:
        """n (at most _REACH) characters from start on."""
        return F.coalesce(F.get(self.column, (start / _REACH).cast("int")), F.lit("")).substr((start % _REACH).cast("int") + 1, n.cast("int"))


def cut_blocks(text: Column, width: int, size: int) -> Column:
    """The text from each multiple of `width` on, `size` characters of it (or what is left).

    A character's place is found by a walk from the beginning, so the text is first cut coarsely and the coarse parts finely.
    """
    wide = 64 * width
    last = lambda n, w: (F.greatest(n - 1, F.lit(0)) / w).cast("int")

    def fine(part: Column, j: Column, length: Column) -> Column:
        own = F.least(length - j * wide, F.lit(wide))
        return F.transform(F.sequence(F.lit(0), last(own, width)), lambda i: part.substr(i * width + 1, F.lit(size)))

    def coarse(length: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), last(length, wide)), lambda j: text.substr(j * wide + 1, F.lit(wide + size - width)))
        return F.flatten(F.transform(parts, lambda part, j: fine(part, j, length)))

    return let(F.coalesce(F.length(text), F.lit(0)), coarse)


def with_blocks(text: Column, body: Callable[[Blocks], Column]) -> Column:
    """body with the text's blocks, which are cut once."""
    return let(cut_blocks(text, _REACH, 2 * _REACH), lambda own: body(Blocks(own)))


def context_before(text: Column | Blocks, start: Column, width: int) -> Column:
    begin = F.greatest(start - width, F.lit(0))
    return text.slice(begin, start - begin) if isinstance(text, Blocks) else text.substr(begin + 1, start - begin)


def context_after(text: Column | Blocks, end: Column, width: int) -> Column:
    return text.slice(end, F.lit(width)) if isinstance(text, Blocks) else text.substr(end + 1, F.lit(width))


def _folding() -> tuple[str, str]:
    """Letters whose canonical decomposition is one base letter with marks, and those base letters."""
    pairs = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _folding()


def fold(text: Column) -> Column:
    """Without diacritics (letters that have no decomposition stay, as do combining marks' absence)."""
    return F.regexp_replace(F.translate(text, _FROM, _TO), r"\p{M}+", "")


def normalise_name(name: Column) -> Column:
    """Folded, white space collapsed, trimmed, lower case; particles stay."""
    return F.lower(F.trim(F.regexp_replace(fold(name), r"(?U)\s+", " ")))


def phrase(text: Column) -> Column:
    """Folded, lower case, punctuation as spaces, spaces collapsed."""
    return F.lower(F.trim(F.regexp_replace(fold(text), r"(?U)[^\w]+", " ")))


def normalise_token(token: Column) -> Column:
    """Folded, without punctuation at the ends, lower case."""
    return F.lower(F.regexp_replace(fold(token), r"(?U)^[^\w]+|[^\w]+$", ""))


def normalise_term(term: Column) -> Column:
    """Lower case with collapsed white space; diacritics stay."""
    return F.lower(F.trim(F.regexp_replace(term, r"(?U)\s+", " ")))


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def first_of_repeated(spans: Column) -> Column:
    """Of an array of spans (with ord) those that are first by ord among spans of equal lower-cased text and offsets, whatever their
    type. Sorted, equals stand side by side, so nothing leaves the row."""
    key = lambda s: F.struct(s["start_char"].alias("a"), s["end_char"].alias("b"), F.lower(s["text"]).alias("low"))
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(key(s).alias("k"), s["ord"].alias("ord"), s.alias("s"))))
    fresh = lambda own: F.filter(own, lambda x, i: (i == 0) | (x["k"] != F.get(own, i - 1)["k"]))
    return F.transform(let(keyed, fresh), lambda x: x["s"])


def particle_pattern(particles: tuple[str, ...], gap: str = r"\s+") -> str:
    """A pattern for one particle sequence with the gap after it; first letters in either case, longer sequences first."""
    word = lambda w: f"[{w[0].upper()}{w[0]}]{w[1:]}" if w[0].isalpha() else w
    listed = sorted(particles, key=lambda p: (-len(p.split()), p))
    return "(?:" + "|".join(gap.join(map(word, p.split())) + gap for p in listed) + ")"
