"""Intervals around spans against comparing all with all, and a document with many of both."""

import random
import time

import pytest
from pyspark.sql import functions as F

from inkveil.operators import classify, containment, review


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(8)
    spans, outer = [], []
    for doc in range(30):
        place = lambda wide: (lambda a: (a, a + rnd.randint(1, wide)))(rnd.randint(0, 50))
        spans += [(doc, *place(6), k) for k in range(rnd.choice([0, 1, 30]))]
        outer += [(doc, *place(30), rnd.choice(["email_header", "salutation", "signature_block"])) for _ in range(rnd.choice([0, 1, 4, 25]))]
    spans += [(0, None, None, 98), (77, 1, 2, 99), *spans[:3]]
    outer += outer[:3]
    return spans, outer, spark.createDataFrame(spans, "doc_id long, start_char int, end_char int, n int"), spark.createDataFrame(outer, "doc_id long, start_char int, end_char int, kind string")


def around(outer, doc, start, end):
    return [o for o in outer if start is not None and o[0] == doc and o[1] <= start and end <= o[2]]


def test_spans_in_intervals(tables):
    spans, outer, s, o = tables
    got = sorted(map(tuple, containment.with_inside(s, o).collect()), key=str)
    assert got == sorted([(*x, bool(around(outer, *x[:3]))) for x in spans], key=str)


def test_first_interval_around(tables):
    spans, outer, s, o = tables
    got = sorted(map(tuple, classify.enclosing(s, o).collect()), key=str)
    want = set()
    for doc, start, end, _ in spans:
        if met := around(outer, doc, start, end):
            want.add((doc, start, end, min(met, key=lambda x: (x[3] == "salutation", *x[1:]))[3]))
    assert got == sorted(want, key=str)


def test_narrowest_interval_around(tables):
    spans, outer, s, o = tables
    got = sorted(((r.doc_id, r.start_char, r.end_char, r.n, r.around and tuple(r.around)) for r in containment.with_narrowest_around(s, o).collect()), key=str)
    narrowest = lambda met: (lambda x: (x[3], x[1], x[2]))(min(met, key=lambda x: (x[2] - x[1], *x[1:]))) if met else None
    assert got == sorted([(*x, narrowest(around(outer, *x[:3]))) for x in spans], key=str)


def test_of_empty_tables(tables):
    spans, _, s, o = tables
    assert containment.with_narrowest_around(s.limit(0), o).count() == containment.with_inside(s.limit(0), o).count() == 0
    assert containment.with_inside(s, o.limit(0)).filter("inside").count() == 0 and containment.with_narrowest_around(s, o.limit(0)).count() == len(spans)


@pytest.mark.parametrize("blocks", ["cast(id * 40 as int) as start_char, cast(id * 40 + 200000 as int) as end_char", "cast(id as int) as start_char, cast(200000 - id as int) as end_char"])
def test_a_document_of_many_spans_and_blocks(spark, blocks):
    """20,000 spans in 5,000 blocks, each of which holds thousands: about 60 million pairs, which are never made."""
    spans = spark.range(20_000).selectExpr("0L as doc_id", "cast(id * 10 as int) as start_char", "cast(id * 10 + 5 as int) as end_char", "'pending' as review_status")
    outer = spark.range(5_000).selectExpr("0L as doc_id", "'email_header' as kind", blocks.split(", ")[0], blocks.split(", ")[1])
    review.block_groups(spans.limit(10), outer).count()
    began = time.time()
    assert review.sweep_block(spans, outer).filter("review_status = 'accepted'").count() > 15_000
    assert review.block_groups(spans, outer).agg(F.sum("n")).first()[0] > 15_000
    assert classify.enclosing(spans, outer).count() > 15_000
    assert time.time() - began < 20
