"""Sets of intervals in the row of a text: ordered sweeps over arrays of spans instead of comparing all with all.

Spans are structs with start_char and end_char (exclusive). Each function sorts what it compares once and goes over it once, so its work
grows like n log n with the spans of a text, whatever their overlaps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions.text import let

#: Below all offsets.
NOWHERE = -(2**31) + 1
#: States are gathered in blocks of so many, so that no long array is copied at each step.
_BLOCK = 64


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The states after each item of an array, the first from `start`: step(state, item)."""

    def through(block: Column, state: Column) -> Column:
        states = F.aggregate(block, F.array(state), lambda out, x: F.array_append(out, step(F.element_at(out, -1), x)))
        return F.slice(states, 2, F.size(block))

    def gathered(blocks: Column) -> Column:
        out = F.aggregate(blocks, F.array(F.array(start)), lambda done, b: F.array_append(done, through(b, F.element_at(F.element_at(done, -1), -1))))
        return F.flatten(F.slice(out, 2, F.size(blocks)))

    def cut(own: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(own), F.lit(1)), F.lit(_BLOCK))
        return let(F.transform(firsts, lambda i: F.slice(own, i, _BLOCK)), gathered)

    return let(items, cut)


def numbered(items: Column) -> Column:
    """Each item as struct(i, item)."""
    return F.transform(items, lambda x, i: F.struct(i.alias("i"), x.alias("item")))


def reaches(spans: Column, places: Column, inclusive: bool = False) -> Column:
    """For each of the places the greatest end of the spans that start before it (inclusive: or at it), NOWHERE if none does.

    One sweep: starts and places are sorted together, the greatest end so far is carried along, and the answers go back into the order of the places.
    """
    starts = F.transform(spans, lambda s: F.struct(s["start_char"].cast("int").alias("at"), F.lit(0 if inclusive else 1).alias("turn"), s["end_char"].cast("int").alias("reach"), F.lit(-1).alias("i")))
    asked = F.transform(places, lambda p, i: F.struct(p.cast("int").alias("at"), F.lit(1 if inclusive else 0).alias("turn"), F.lit(NOWHERE).alias("reach"), i.cast("int").alias("i")))

    def swept(events: Column) -> Column:
        ends = scan(F.transform(events, lambda e: e["reach"]), F.lit(NOWHERE), lambda most, reach: F.greatest(most, reach))
        answers = F.filter(F.zip_with(events, ends, lambda e, reach: F.struct(e["i"].alias("i"), reach.alias("reach"))), lambda a: a["i"] >= 0)
        return F.transform(F.array_sort(answers), lambda a: a["reach"])

    return let(F.array_sort(F.concat(starts, asked)), swept)


def _chosen(items: Column, test: Column, keep: Callable[[Column, Column], Column]) -> Column:
    """The items for which keep(item, test's value at its place) holds."""
    pairs = F.zip_with(items, test, lambda x, t: F.struct(x.alias("item"), t.alias("test")))
    return F.transform(F.filter(pairs, lambda p: keep(p["item"], p["test"])), lambda p: p["item"])


def clear_of(hits: Column, base: Column) -> Column:
    """The hits that overlap no span of the base."""
    return _chosen(hits, reaches(base, F.transform(hits, lambda h: h["end_char"])), lambda h, reach: reach <= h["start_char"])


def apart(hits: Column) -> Column:
    """Of hits in the order of their starts those that overlap none taken before them, the first being taken."""

    def taken(ends: Column) -> Column:
        before = F.transform(ends, lambda e, i: F.when(i == 0, F.lit(NOWHERE)).otherwise(F.get(ends, i - 1)))
        return _chosen(hits, F.zip_with(ends, before, lambda e, b: e > b), lambda h, fresh: fresh)

    step = lambda end, h: F.when(h["start_char"] >= end, h["end_char"].cast("int")).otherwise(end)
    return let(scan(hits, F.lit(NOWHERE), step), taken)


def not_inside(spans: Column, outer: Column) -> Column:
    """The spans that lie in none of the outer ones."""
    return _chosen(spans, reaches(outer, F.transform(spans, lambda s: s["start_char"]), inclusive=True), lambda s, reach: reach < s["end_char"])


def not_within_longer(spans: Column) -> Column:
    """The spans that lie in no longer one of the same array; equal ones all stay."""

    def kept(own: Column) -> Column:
        starts = F.transform(own, lambda s: s["start_char"])
        earlier, not_later = reaches(own, starts), reaches(own, starts, inclusive=True)
        both = F.zip_with(earlier, not_later, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return _chosen(own, both, lambda s, r: (r["a"] < s["end_char"]) & (r["b"] <= s["end_char"]))

    return let(spans, kept)


def near(spans: Column, others: Column, most: int) -> Column:
    """For each span whether another begins at most so far behind its end, or ends at most so far before its start."""
    point = lambda p: F.struct(p.alias("start_char"), p.alias("end_char"))
    back = reaches(F.transform(others, lambda o: point(o["end_char"])), F.transform(spans, lambda s: s["start_char"]), inclusive=True)
    ahead = reaches(F.transform(others, lambda o: point(-o["start_char"])), F.transform(spans, lambda s: -s["end_char"]), inclusive=True)
    gaps = F.zip_with(back, ahead, lambda b, a: F.struct(b.alias("b"), a.alias("a")))
    return F.zip_with(spans, gaps, lambda s, g: (g["b"] >= s["start_char"] - most) | (g["a"] >= -s["end_char"] - most))


def joined(spans: Column) -> Column:
    """The spans as sorted intervals (start_char, end_char) that neither overlap nor touch."""
    kind = "array<struct<start_char:int,end_char:int>>"

    def islands(own: Column) -> Column:
        ends = scan(F.transform(own, lambda s: s["end_char"]), F.lit(NOWHERE), lambda most, end: F.greatest(most, end))

        def cut(reach: Column) -> Column:
            firsts = F.filter(F.transform(own, lambda s, i: F.when((i == 0) | (s["start_char"] > F.get(reach, i - 1)), i)), lambda i: i.isNotNull())
            last = lambda own_firsts, k: F.coalesce(F.get(own_firsts, k + 1), F.size(own)) - 1
            return let(firsts, lambda f: F.transform(f, lambda i, k: F.struct(F.get(own, i)["start_char"].alias("start_char"), F.get(reach, last(f, k)).alias("end_char"))))

        return let(ends, cut)

    plain = F.transform(spans, lambda s: F.struct(s["start_char"].cast("int").alias("start_char"), s["end_char"].cast("int").alias("end_char")))
    return F.when(F.size(spans) > 0, let(F.array_sort(F.filter(plain, lambda s: s["end_char"] > s["start_char"])), islands)).otherwise(F.array()).cast(kind)


def known(keys: Column, others: Column) -> Column:
    """For each of an array of texts whether the other array holds it: both are sorted together, and the last of the others is carried along."""
    events = F.concat(F.transform(others, lambda k: F.struct(k.alias("key"), F.lit(0).alias("turn"), F.lit(-1).alias("i"))), F.transform(keys, lambda k, i: F.struct(k.alias("key"), F.lit(1).alias("turn"), i.cast("int").alias("i"))))

    def swept(own: Column) -> Column:
        last = scan(own, F.lit(None).cast("string"), lambda key, e: F.when(e["turn"] == 0, e["key"]).otherwise(key))
        answers = F.filter(F.zip_with(own, last, lambda e, key: F.struct(e["i"].alias("i"), e["key"].eqNullSafe(key).alias("met"))), lambda a: a["i"] >= 0)
        return F.transform(F.array_sort(answers), lambda a: a["met"])

    return let(F.array_sort(events), swept)
