"""Places on pages: merge walk, glyph widths, texts in boxes, search with boxes and coverage."""

import random

import pytest
from pyspark.sql import functions as F

from inkveil.functions import values as V
from inkveil.operators import places

ITEMS = "doc_id long, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double"
_BOXED = "doc_id long, page int, x0 double, y0 double, x1 double, y1 double"


def words(line, y, x=10.0, per=6.0):
    out = []
    for w in line.split(" "):
        out.append((w, x, y, x + per * len(w), y + 10))
        x += per * (len(w) + 1)
    return out


def glyphs(line, y):
    return [(c, 10.0 + 6 * i, y, 16.0 + 6 * i, y + 10) for i, c in enumerate(line) if c != " "]


def table(spark, *pages):
    """pages: (doc_id, page, [items])."""
    return spark.createDataFrame([(d, p, i, *item) for d, p, own in pages for i, item in enumerate(own)], ITEMS)


def found(spark, items, *needles):
    d = spark.createDataFrame([(0, n, k) for n, k in needles], "doc_id long, text string, nth int")
    return {(r.text, r.nth): r.box and (r.box.page, r.box.x0, r.box.y0, r.box.x1, r.box.y1) for r in places.boxes_of_occurrences(d, items).collect()}


def test_needles_over_one_two_and_five_items(spark):
    items = table(spark, (0, 0, [*words("Aan mevrouw Jan de Vries van Aken toe", 20.0), *words("Vriesland en Jan", 40.0), *words("de Vries, Jan", 60.0)]), (0, 1, [("Zie Jan de Vries hier", 10.0, 20.0, 110.0, 30.0)]))
    boxes = found(spark, items, ("Vries", 0), ("Jan de", 0), ("jan de vries van aken", 0), ("Vries", 1), ("Jan", 2), ("de Vries", 5), ("niemand", 0), ("Jan de Vries", 1))
    assert boxes["Vries", 0] == (0, 124.0, 20.0, 154.0, 30.0) and boxes["Vries", 1][2] == 60.0  # not the one of Vriesland
    assert boxes["Jan de", 0] == (0, 82.0, 20.0, 118.0, 30.0)
    assert boxes["jan de vries van aken", 0] == (0, 82.0, 20.0, 208.0, 30.0)
    assert boxes["Jan", 2][2] == 60.0 and boxes["niemand", 0] is None
    assert boxes["de Vries", 5] == (0, 106.0, 20.0, 154.0, 30.0)  # not so many: the first
    assert boxes["Jan de Vries", 1][0] == 1  # the second occurrence lies within one item of the next page


def test_items_of_single_characters(spark):
    items = table(spark, (0, 0, glyphs("NL83INGB0004752861 en Jan de Vries", 20.0)))
    boxes = found(spark, items, ("NL83INGB0004752861", 0), ("Jan de Vries", 0), ("de Vries", 0))
    assert boxes["NL83INGB0004752861", 0] == (0, 10.0, 20.0, 118.0, 30.0)
    assert boxes["Jan de Vries", 0] == (0, 142.0, 20.0, 214.0, 30.0)


def test_a_run_never_leaves_its_line_and_gives_up_when_too_long(spark):
    items = table(spark, (0, 0, [*words("Jan", 20.0), *words("Bos", 40.0), *words("Jan oververlengde Bos", 60.0), *words("Jan Bos", 80.0)]))
    assert found(spark, items, ("Jan Bos", 0), ("Jan Bos", 1)) == {("Jan Bos", 0): (0, 10.0, 80.0, 52.0, 90.0), ("Jan Bos", 1): (0, 10.0, 80.0, 52.0, 90.0)}


def test_boxes_are_cut_by_glyph_widths(spark):
    text, begin, length = "mevrouw De Vries il", 8, 8
    wide = [V.GLYPH_WIDTHS[ord(c) - 32] for c in text]
    box = found(spark, table(spark, (0, 0, [(text, 100.0, 20.0, 300.0, 30.0)])), ("De Vries", 0))["De Vries", 0]
    assert box[1] == pytest.approx(100 + 200 * sum(wide[:begin]) / sum(wide)) and box[3] == pytest.approx(100 + 200 * sum(wide[: begin + length]) / sum(wide))
    assert found(spark, table(spark, (0, 0, [("é😀 Bos", 0.0, 0.0, 10.0, 9.0)])), ("é😀 bos", 0))["é😀 bos", 0] == (0, 0.0, 0.0, 10.0, 9.0)


def test_box_to_text_and_back(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(120):
        line = " ".join("".join(rnd.choice("abcimwWVl.é1") for _ in range(rnd.randint(2, 9))) for _ in range(5))
        rows.append((k, line, rnd.randint(0, 4)))
    items = spark.createDataFrame([(k, 0, 0, line, 50.0, 20.0, 450.0, 30.0) for k, line, _ in rows], ITEMS)
    needle = F.split("text", " ")
    found_ = spark.createDataFrame(rows, "doc_id long, text string, nth int").select("doc_id", F.get(needle, F.col("nth")).alias("text"), F.lit(0).alias("nth"))
    boxes = places.boxes_of_occurrences(found_, items).filter("box is not null").select(F.col("doc_id").alias("det_id"), "doc_id", F.lit(0).alias("place"), "box.*", "text")
    back = boxes.drop("text").transform(lambda b: places.texts_of_boxes(b, items)).join(boxes.select("det_id", F.col("text").alias("want")), "det_id").collect()
    assert len(back) > 80 and all(r.text == r.want for r in back)


def test_texts_of_boxes(spark):
    items = table(spark, (0, 0, [*words("Postbus 12 Leiden", 20.0), *words("Telefoon: 06", 31.0), *glyphs("Willem", 60.0)]), (0, 1, [*words("leiden,", 20.0)]))
    boxes = [(1, 0, 0, 0, 0.0, 19.0, 200.0, 30.0), (2, 0, 0, 0, 10.0, 55.0, 46.0, 72.0), (3, 0, 0, 0, 76.0, 20.0, 112.0, 30.0), (3, 0, 1, 1, 0.0, 20.0, 60.0, 30.0), (4, 0, 0, 0, 300.0, 20.0, 310.0, 30.0), (5, 0, 0, 0, 0.0, 10.0, 300.0, 50.0)]
    df = spark.createDataFrame(boxes, "det_id int, doc_id long, place int, page int, x0 double, y0 double, x1 double, y1 double")
    got = {r.det_id: r.text for r in places.texts_of_boxes(df, items).collect()}
    assert got == {1: "Postbus 12 Leiden", 2: "Willem", 3: "Leiden", 5: "Postbus 12 Leiden Telefoon: 06"}


def test_urls_lose_punctuation(spark):
    items = table(spark, (0, 0, [("https://x.nl).", 0.0, 0.0, 90.0, 10.0)]))
    box = spark.createDataFrame([(1, 0, 0, 0, 0.0, 0.0, 90.0, 10.0)], "det_id int, doc_id long, place int, page int, x0 double, y0 double, x1 double, y1 double")
    assert places.entity_texts(box, items, spark.createDataFrame([(1, "adres")], "det_id int, entity_type string")).first().text == "https://x.nl"


def test_search_with_boxes_and_coverage(spark):
    items = table(spark, (0, 0, [*words("een Jan", 20.0), *words("de Vries en Jan de Vries", 40.0), *words("x" * 60 + " jan de vriesland", 60.0)[:-1], ("de vri es", 500.0, 60.0, 550.0, 70.0)]), (1, 0, words("niets", 20.0)))
    over = spark.createDataFrame([(0, 0, 30.0, 18.0, 60.0, 32.0), (0, 0, 82.0, 40.0, 110.0, 44.0), (0, 0, 100.0, 40.0, 170.0, 44.0)], _BOXED)
    rows = places.search(items, " Jan  de VRIES ", over).orderBy("start_char").collect()
    assert [(r.text, [tuple(b) for b in r.boxes], r.covered) for r in rows] == [
        ("Jan de Vries", [(0, 34.0, 20.0, 52.0, 30.0), (0, 10.0, 40.0, 58.0, 50.0)], True),
        ("Jan de Vries", [(0, 82.0, 40.0, 154.0, 50.0)], False),
    ]
    assert rows[0].covered_share == pytest.approx(180 / (180 + 480)) and rows[1].covered_share == pytest.approx(72 * 4 / 720)
    assert rows[0].snippet == "een Jan de Vries en Jan de Vries " + "x" * 7 + "…" and rows[1].snippet.startswith("een Jan de Vries en Jan")
    assert places.search(items, "j", over).count() == 0 == places.search(items.limit(0), "jan", over).count()


def test_area_that_boxes_share(spark):
    rnd = random.Random(6)
    for _ in range(12):
        boxes = [(float(a), float(b), float(a + rnd.randint(0, 9)), float(b + rnd.randint(0, 9))) for a, b in ((rnd.randint(0, 12), rnd.randint(0, 12)) for _ in range(rnd.randint(0, 7)))]
        cells = sum(any(x0 <= x and x + 1 <= x1 and y0 <= y and y + 1 <= y1 for x0, y0, x1, y1 in boxes) for x in range(3, 11) for y in range(2, 9))
        df = spark.createDataFrame([(boxes,)], "b array<struct<x0:double,y0:double,x1:double,y1:double>>")
        hit = F.struct(F.lit(3.0).alias("x0"), F.lit(2.0).alias("y0"), F.lit(11.0).alias("x1"), F.lit(9.0).alias("y1"))
        assert df.select(places.shared_area(hit, F.col("b")).alias("a")).first().a == cells


def test_boxes_and_words(spark):
    box = lambda x0, y0, x1, y1: F.struct(F.lit(0).alias("page"), F.lit(x0).alias("x0"), F.lit(y0).alias("y0"), F.lit(x1).alias("x1"), F.lit(y1).alias("y1"))
    own = box(10.0, 10.0, 50.0, 20.0)
    row = spark.range(1).select(
        places.grown_to_word(own, box(45.0, 9.0, 70.0, 19.0)).alias("g"), places.shrunk_by_word(own, box(40.0, 10.0, 50.0, 20.0)).alias("r"), places.shrunk_by_word(own, box(5.0, 10.0, 20.0, 20.0)).alias("l"),
        places.shrunk_by_word(own, box(0.0, 0.0, 59.0, 20.0)).alias("w"), places.split_boxes(F.array(own, own, own), F.lit(1), F.lit(0.0)).alias("s"), places.split_boxes(F.array(own), F.lit(3), F.lit(0.0)).alias("n"),
    ).first()
    assert tuple(row.g) == (0, 10.0, 9.0, 70.0, 20.0) and row.r.x1 == 40.0 and row.l.x0 == 20.0 and row.w.x0 == 48.0 and row.n is None
    assert [b.x1 for b in row.s.a] == [50.0, 12.0] and [b.x0 for b in row.s.b] == [12.0, 10.0]
