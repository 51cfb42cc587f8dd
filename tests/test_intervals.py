"""Sweeps over spans against comparing all with all, and the time that they take with many hits in one text."""

import random
import time

import pytest
from pyspark.sql import functions as F

from inkveil.functions import intervals
from inkveil.functions.text import cut_blocks
from inkveil.operators import custom, reports, tier1, tier2

SPANS = "array<struct<start_char:int,end_char:int>>"


@pytest.fixture(scope="module")
def arrays(spark):
    rnd = random.Random(4)

    def spans(n, wide):
        return [(a, a + rnd.randint(1, wide)) for a in (rnd.randint(0, 60) for _ in range(n))]

    rows = [(k, spans(rnd.choice([0, 1, 5, 40, 150]), 20), sorted(spans(rnd.choice([0, 1, 5, 40]), 9))) for k in range(60)]
    return rows, spark.createDataFrame(rows, f"k long, a {SPANS}, b {SPANS}")


def checked(arrays, column, want):
    rows, df = arrays
    got = {r.k: r.x for r in df.select("k", column.alias("x")).collect()}
    plain = lambda x: [tuple(y) if hasattr(y, "_fields") else y for y in x]
    assert all(plain(got[k]) == want(a, b) for k, a, b in rows)


def clash(x, y):
    return x[0] < y[1] and y[0] < x[1]


def greedy(hits):
    taken = []
    for h in hits:
        if not any(clash(h, t) for t in taken):
            taken.append(h)
    return taken


def union(spans):
    inside = sorted({p for s in spans for p in range(*s)})
    edges = [(p, p - 1 not in inside, p + 1 not in inside) for p in inside]
    return list(zip([p for p, first, _ in edges if first], [p + 1 for p, _, last in edges if last], strict=True))


def test_sweeps(arrays):
    a, b = F.col("a"), F.col("b")
    nowhere = intervals.NOWHERE
    checked(arrays, intervals.reaches(a, F.transform(b, lambda s: s["start_char"])), lambda a, b: [max([e for s, e in a if s < p], default=nowhere) for p, _ in b])
    checked(arrays, intervals.reaches(a, F.transform(b, lambda s: s["end_char"]), inclusive=True), lambda a, b: [max([e for s, e in a if s <= p], default=nowhere) for _, p in b])
    checked(arrays, intervals.clear_of(b, a), lambda a, b: [h for h in b if not any(clash(h, s) for s in a)])
    checked(arrays, intervals.apart(b), lambda a, b: greedy(b))
    checked(arrays, intervals.not_inside(a, b), lambda a, b: [s for s in a if not any(h[0] <= s[0] and s[1] <= h[1] for h in b)])
    checked(arrays, intervals.not_within_longer(a), lambda a, b: [s for s in a if not any(o[0] <= s[0] and s[1] <= o[1] and o != s for o in a)])
    checked(arrays, intervals.near(a, b, 3), lambda a, b: [any(0 <= o[0] - s[1] <= 3 or 0 <= s[0] - o[1] <= 3 for o in b) for s in a])
    checked(arrays, intervals.joined(a), lambda a, b: union(a))


def test_blocks_of_long_texts(spark):
    texts = ["", "é", "ab" * 5, "x😀" * 700, "y" * 64 * 7, "z" * (64 * 7 + 1)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string").select("k", cut_blocks(F.col("text"), 7, 10).alias("b")).collect()
    assert all(r.b == [(texts[r.k] or "")[i : i + 10] for i in range(0, max(1, len(texts[r.k] or "")), 7)] for r in rows)


def test_painted_ranges(spark):
    rnd = random.Random(9)
    cases = []
    for k in range(40):
        text = "".join(rnd.choice("aé😀\n") for _ in range(rnd.choice([0, 1, 2047, 2048, 2049, 5000])))
        spans = [(s, s + rnd.choice([1, 3, 2048, 5000])) for s in (rnd.randint(0, 5000) for _ in range(rnd.choice([0, 1, 30])))]
        cases.append((k, text, spans))
    docs = spark.createDataFrame([(k, t) for k, t, _ in cases], "doc_id long, text string")
    found = spark.createDataFrame([(k, s, e, "accepted") for k, _, spans in cases for s, e in spans] + [(0, None, None, "accepted"), (1, 0, 9, "pending")], "doc_id long, start_char int, end_char int, review_status string")
    got = {r.doc_id: r.text for r in reports.redact(docs, found).collect()}
    assert all(got[k] == "".join("█" if any(s <= i < e for s, e in spans) else c for i, c in enumerate(t)) for k, t, spans in cases)


def fold(base, hits):
    """The merge of terms by comparing each match with all rows."""
    rows = [list(r) for r in base]
    for s, e, ground in hits:
        at = next((i for i, r in enumerate(rows) if r[0] is not None and r[0] < e and s < r[1]), None)
        if at is None:
            rows.append([s, e, None])
            at = len(rows) - 1
        rows[at][2] = ground
    return rows


def test_terms_take_over_the_first_row_that_they_overlap():
    rnd = random.Random(11)
    for _ in range(300):
        base = [(s, s + rnd.randint(0, 12), None) for s in (rnd.randint(0, 60) for _ in range(rnd.choice([0, 1, 20])))] + [(None, None, None)] * rnd.randint(0, 2)
        hits = [(s, s + rnd.randint(1, 9), k) for k, s in enumerate(rnd.randint(0, 80) for _ in range(25))]
        rnd.shuffle(base)
        taken, rows = custom._Taken([b[0] for b in base], [b[1] for b in base]), [list(b) for b in base]
        for s, e, ground in hits:
            at = taken.place(s, e)
            rows += [[s, e, None]] * (at == len(rows))
            rows[at] = [*rows[at][:2], ground]
        assert rows == fold(base, hits)


def detected(spark, n):
    text = "".join(f"Jan Jansen A. Smit dhr. Bakker, Kerkstraat {i % 99} 1234 AB huisnummer {i % 50}\n" for i in range(n // 5))
    return tier2.detect(spark.createDataFrame([(0, text)], "doc_id long, text string"), ("jan",), ("jansen",), "2024-01-01", ("wethouder",))


def ruled(rule, line, per):
    return lambda spark, n: tier2.rule_rows(spark.createDataFrame([(0, line * (n // per))], "doc_id long, text string"), rule)


def companies(spark, n):
    return tier1.detect(spark.createDataFrame([(0, "KvK-nummer regel 12345678 en 87654321\n" * (n // 2))], "doc_id long, text string"), ("kvk",))


def redacted(spark, n):
    docs = spark.createDataFrame([(0, "abcdefgh" * n)], "doc_id long, text string")
    found = spark.range(n).selectExpr("0L as doc_id", "cast(id * 8 as int) as start_char", "cast(id * 8 + 4 + id % 9 as int) as end_char", "'accepted' as review_status")
    return reports.redact(docs, found)


def merged(spark, n):
    docs = spark.createDataFrame([(0, "aap noot mies " * (n // 2))], "doc_id long, text string")
    terms = spark.createDataFrame([(0, 0, "noot"), (0, 1, "mies")], "doc_id long, ord int, term string")
    base = spark.range(n // 2).selectExpr("0L as doc_id", "cast(id * 14 as int) as start_char", "cast(id * 14 + 6 as int) as end_char", "'x' as text", "'pending' as review_status", "'ner' as source", "0.8D as confidence", "'g' as woo_article")
    return custom.merge_terms(base, custom.term_matches(docs, terms))


CASES = {
    "detect": detected, "streets": ruled("street", "Kerkstraat 12 1234 AB\n", 1), "initials": ruled("initials", "A. Smit en ", 1), "titles": ruled("title", "dhr. De Vries en ", 1),
    "kvk": companies, "redact": redacted, "terms": merged,
}


@pytest.mark.parametrize("name", CASES)
def test_time_grows_with_the_hits(spark, name):
    """Four times the hits take at most seven times as long (a square would take sixteen), with what a plan of its own costs left out."""

    def seconds(n):
        began = time.time()
        CASES[name](spark, n).write.format("noop").mode("overwrite").save()
        return time.time() - began

    seconds(4000)
    fixed, small, large = seconds(5), seconds(4000), seconds(16000)
    assert large - fixed < 7 * max(small - fixed, 0.35), (fixed, small, large)
