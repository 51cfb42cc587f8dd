"""Contextual rules, structure, decisions, terms, places, review and reports on small rows."""

import time

import pytest
from pyspark.sql import functions as F

from inkveil.operators import classify, custom, locate, reports, review, structure, tier1, tier2
from inkveil.sources import readers


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def texts(df):
    return sorted(r.text for r in df.collect())


def test_streets(spark):
    d = docs(spark, "Hij woont aan de Lange Kerkstraat 12b te 1234 AB", "Bezoekadres: Kerkstraat 1", "de Straat 5 en lindelaan 3")
    rows = tier2.rule_rows(d, "street").collect()
    assert [(r.text, r.confidence) for r in rows] == [("aan de Lange Kerkstraat 12b", 0.92)]


def test_house_numbers(spark):
    assert texts(tier2.rule_rows(docs(spark, "huisnummer 12a; bewoners van nummer 3; nummer 9"), "house_number")) == ["huisnummer 12a", "nummer 3"]


def test_initials(spark):
    assert texts(tier2.rule_rows(docs(spark, "A.B. van der Berg en B.V. Holland, Xa.B. Smit"), "initials")) == ["A.B. van der Berg"]


def test_references(spark):
    rows = tier2.rule_rows(docs(spark, "Klantnummer: 12 34-56, uw  kenmerk AB/12-x, zaaknummer onbekend"), "reference").collect()
    assert sorted((r.text, r.confidence) for r in rows) == [("12 34-56", 0.85), ("AB/12-x", 0.70)]


def test_titled_names(spark):
    assert texts(tier2.rule_rows(docs(spark, "dhr. A. van den Khatib, die sprak; mevrouw zei niets; de heer De Vries."), "title")) == ["A. van den Khatib", "De Vries"]


def test_detect_merges_rules(spark):
    rows = tier2.detect(docs(spark, "Met dhr. J. Smit en Jan Jansen, Kerkstraat 12."), ("jan",), ("jansen",)).collect()
    found = {(r.entity_type, r.text) for r in rows}
    assert ("persoon", "Jan Jansen") in found and ("adres", "Kerkstraat 12") in found and ("persoon", "J. Smit") in found


def test_structure(spark):
    d = docs(spark, "Van: A\nAan: B\nBetreft: C\n\nGeachte heer X,\nbla\nMet vriendelijke groet,\nJan\n\n06\n\n\nniet")
    rows = {r.kind: (r.start_char, r.end_char) for r in structure.detect(d).collect()}
    text = d.first().text
    assert text[slice(*rows["email_header"])] == "Van: A\nAan: B\nBetreft: C"
    assert text[slice(*rows["salutation"])] == "Geachte heer X,"
    assert text[slice(*rows["signature_block"])] == "Met vriendelijke groet,\nJan\n\n06"


def test_header_restarts_after_fifteen_lines(spark):
    rows = structure.detect(docs(spark, "\n".join(["Van: a"] * 17)), ("email_header",)).collect()
    assert len(rows) == 2 and rows[0].end_char == 15 * 7 - 1


def test_document_date_is_the_latest_of_the_first_dated_page(spark):
    pages = spark.createDataFrame([(1, 0, "geen 31-02-2020"), (1, 1, "1-2-2020 en 3 mei 2021"), (1, 2, "2022-01-01")], "doc_id long, page int, text string")
    assert str(structure.document_dates(pages).first().document_date) == "2021-05-03"


@pytest.mark.parametrize("text,day", [("Datum: 01/02/2023", "2023-02-01"), ("Datum: 2024-3-5", "2024-03-05"), ("op 3 mrt 2021", None), ("op 3 Maart 2021", "2021-03-03"), ("op 3-12/1999", "1999-12-03"), ("op 31/2/2020 en 1-1-1900", None), ("geb. 1/1/2001 en nog veel meer woorden dan dertig; verzonden 2/2/2002 en een lange tussenzin later 3/3/2003", "2002-02-02")])
def test_forms_of_dates(spark, text, day):
    pages = spark.createDataFrame([(1, 0, text)], "doc_id long, page int, text string")
    found = structure.document_dates(pages, "2025-01-01").first().document_date
    assert (found and str(found)) == day


def test_both_tiers_in_one_row(spark):
    texts_ = ["Mail jan@x.nl en jan@x.nl. Dhr. J. Smit, Kerkstraat 12, 1234 AB. Geboren op 01-02-1980, datum 3-4-1990; klantnummer 123456782, BSN 123456782.", "", "Jan Jansen sprak met A. Bos", None, "Klantnummer: 06-12345678, bel 06-12345678"]
    d = docs(spark, *texts_)
    shape = lambda df: sorted(map(str, df.select("doc_id", "entity_type", "tier", "text", "start_char", "end_char", F.round("confidence", 2), "woo_article", "source").collect()))
    names = (("jan",), ("jansen",), "2025-01-01", ("wethouder",))
    apart = tier2.detect_all(tier1.detect(d, as_of="2025-01-01"), tier2.detect(d, *names))
    assert shape(tier2.detect_both(d, *names)) == shape(apart) and apart.count() > 8


def test_brackets_are_no_part_of_a_surname(spark):
    assert spark.range(1).select(classify.surname_of(F.lit("mevr. A. Jansen (VVD) van Dam"))).first()[0] == "jansen van dam"


def test_rows_without_a_place_have_ids_of_their_own(spark):
    rows = spark.createDataFrame([(k, 1, "area", "2", 1.0, None, "accepted", "manual", None, None) for k in (1, 2)], "det_id long, doc_id long, entity_type string, tier string, confidence double, woo_article string, review_status string, source string, start_char int, end_char int")
    assert reports.responses(rows).select("id").distinct().count() == 2


def test_titles_and_lists(spark):
    d = docs(spark, "De wethouder J. Smit sprak. De raadsleden A. Bos, B. Vos en C. Mos stemden. Later belde D. Das.")
    titles = spark.createDataFrame([("publiek", "wethouder", 0), ("publiek", "raadsleden", 1)], "list_name string, title string, ord int")
    rows = {r.text: r.title for r in classify.title_matches(tier2.rule_rows(d, "initials"), d, titles).collect()}
    assert rows == {"J. Smit": "wethouder", "A. Bos": "raadsleden", "B. Vos": "raadsleden", "C. Mos": "raadsleden"}


def test_names_in_lists_may_begin_like_forms_of_address(spark):
    d = docs(spark, "De raadsleden A. Drost, B. Drenth, C. Mrksa en P. Profijt stemden. J. van 't Veer ook.")
    titles = spark.createDataFrame([("publiek", "raadsleden", 0)], "list_name string, title string, ord int")
    persons = tier2.rule_rows(d, "initials", context=True)
    assert texts(persons) == ["A. Drost", "B. Drenth", "C. Mrksa", "J. van 't Veer", "P. Profijt"]
    found = texts(classify.title_matches(persons, d, titles))
    assert found == texts(classify.title_matches(persons.drop("before", "after"), d, titles)) == ["A. Drost", "B. Drenth", "C. Mrksa", "P. Profijt"]


def test_spaces_in_a_list_take_no_time(spark):
    d = docs(spark, "De raadsleden A. Bos," + " " * 180 + "zei B. Vos")
    titles = spark.createDataFrame([("publiek", "raadsleden", 0)], "list_name string, title string, ord int")
    assert texts(classify.title_matches(tier2.rule_rows(d, "initials"), d, titles)) == ["A. Bos"]


def officials_found(spark, text, surname, initials):
    d = docs(spark, text).withColumn("gm_code", F.lit(1))
    listed = spark.createDataFrame([(1, surname, initials)], "gm_code int, surname string, initials string")
    persons = d.select("doc_id", F.inline(tier2.titled_names(F.col("text")).cast(tier2.HIT))).unionByName(tier2.rule_rows(d, "initials"))
    return texts(classify.official_matches(persons, d, listed).select("text").distinct())


@pytest.mark.parametrize(
    "text,surname,initials,found",
    [
        ("de heer Jansen sprak", "Jansen", "A.B.".replace(".", ""), []),  # a common surname needs initials
        ("A. Jansen sprak", "jansen", "ab", ["A. Jansen"]),
        ("A.C. Jansen sprak", "jansen", "ab", []),  # they must agree as far as both go
        ("A.B.C. Jansen sprak", "jansen", "ab", ["A.B.C. Jansen"]),
        ("A. Jansen sprak", "jansen", "", []),
        ("de heer Erdogan sprak", "erdogan", "hh", ["Erdogan"]),
        ("M. Erdogan sprak", "erdogan", "hh", []),
        ("H.K. Erdogan sprak", "erdogan", "hh", ["H.K. Erdogan"]),  # others only need to begin alike
        ("mevrouw Van den Oever sprak", "oever", "", ["Van den Oever"]),
        ("mevrouw Oever sprak", "van den oever", "", []),
    ],
)
def test_officials(spark, text, surname, initials, found):
    assert officials_found(spark, text, surname, initials) == found


def test_person_rows(spark):
    names = ["Dhr. H.H. (Arjan) van den Oever", "Mw. mr. E. Ünal-Bos", "Juridische zaken", "Jan Jansen", "K.J. Vos", "mevrouw", ""]
    rows = spark.createDataFrame([(n,) for n in names], "name string").select(readers.parsed_person(F.col("name")).alias("p")).collect()
    assert [tuple(r.p) if r.p else None for r in rows] == [("van den oever", "hh"), ("unal bos", "e"), None, None, ("vos", "kj"), None, None]


def test_urls_of_listed_sites(spark):
    spans = spark.createDataFrame([(1, "url", f"https://site.nl{t}", i, i + 1) for i, t in enumerate(["", "/", "/a/b", "?x", "#a", "x", ".be"])], "doc_id long, entity_type string, text string, start_char int, end_char int")
    listed = spark.createDataFrame([("url", "https://site.nl/")], "kind string, value string")
    found = {r.text[15:]: r.public_value for r in classify.with_contacts(spans, listed).collect()}
    assert found == {"": True, "/": True, "/a/b": True, "?x": True, "#a": True, "x": False, ".be": False}


def test_document_dates_with_labels(spark):
    rows = [(1, 0, "Datum: 3 mei 2021, in antwoord op uw brief van 1-2-2023"), (2, 0, "geboren 1-1-2020, 2-2-2010, verzonden: 1-1-2009 en verzonden: 2009-05-01"), (3, 0, "1-1-2049"), (4, 0, "geb. 1-1-1990")]
    pages = spark.createDataFrame(rows, "doc_id long, page int, text string")
    got = {r.doc_id: str(r.document_date) for r in structure.document_dates(pages, "2025-01-01").collect()}
    assert got == {1: "2021-05-03", 2: "2009-05-01", 3: "None", 4: "None"}


@pytest.mark.parametrize("build,hits", [("tier1", lambda d: tier1.detect(d, ("postcode",))), ("lines", structure.line_rows), ("terms", lambda d: custom.search(d.withColumn("page", F.lit(0)), "ab"))])
def test_time_grows_with_the_hits_in_a_text(spark, build, hits):
    took = []
    for n in (4_000, 4_000, 32_000):
        d = docs(spark, "1234 AB x\n" * n)
        plan, began = hits(d), time.time()
        assert plan.count() >= n
        took.append(time.time() - began)
    assert took[2] < 8 * took[1] + 6


def test_offsets_of_many_matches(spark):
    text = "".join(f"é😀{i} {1000 + i} AB\n" for i in range(1000))
    rows = tier1.detect(docs(spark, text, "geen", "\ufdd0 1234 AB"), ("postcode",)).collect()
    assert len(rows) == 1001 and all(text[r.start_char : r.end_char] == r.text for r in rows if r.doc_id == 0)


def test_reviewers_terms_keep_their_ground_and_the_order_of_detections(spark):
    d = docs(spark, "aap NOOT aap")
    terms = spark.createDataFrame([(0, 0, "aap", None, "5.2"), (0, 1, "noot", "prefix", None)], "doc_id long, ord int, term string, match_mode string, woo_article string")
    base = spark.createDataFrame([(0, 1, 0, 3, "aap", "pending", "ner", 0.8, "x"), (0, 0, 0, 12, "alles", "pending", "ner", 0.7, "y")], "doc_id long, pos int, start_char int, end_char int, text string, review_status string, source string, confidence double, woo_article string")
    rows = custom.merge_terms(base, custom.term_matches(d, terms)).orderBy("pos").collect()
    assert [(r.text, r.woo_article, r.review_status) for r in rows] == [("alles", "5.2", "accepted"), ("aap", "x", "pending")]


def test_redo_ends_with_a_new_event(spark):
    log = spark.createDataFrame([(1, 7, "accepted", False), (2, 7, "rejected", True), (3, 7, "deferred", True), (1, 8, "accepted", True), (2, 8, "rejected", False)], "seq long, det_id long, status string, undone boolean")
    got = {r.det_id: r.status for r in review.states(review.redo_next(log, 1)).collect()}
    assert got == {7: "rejected", 8: "rejected"}


def test_first_new_boxes_keep_the_old_ones(spark):
    box = "array<struct<page:int,x0:double,y0:double,x1:double,y1:double>>"
    own = spark.createDataFrame([(1, "pending", "5.2", [(0, 1.0, 1.0, 2.0, 2.0)])], f"det_id long, review_status string, woo_article string, boxes {box}")
    change = lambda x: spark.createDataFrame([(1, [(0, x, 1.0, 2.0, 2.0)])], f"det_id long, boxes {box}")
    row = review.adjust_boundary(review.adjust_boundary(own, change(0.5)), change(0.7)).first()
    assert (row.review_status, row.original_boxes[0].x0, row.boxes[0].x0) == ("edited", 1.0, 0.7)


def test_page_and_request_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"doc_id": "a", "pages": [{"page_number": 0, "full_text": "x y", "text_items": [{"text": "x", "x0": 1.0}, {"text": " "}]}]}')
    got = readers.requests(spark, str(tmp_path / "r.json"))
    assert [(r.doc_id, r.page, r.text) for r in readers.pages(got).collect()] == [("a", 0, "x y")] and [r.text for r in readers.items(got).collect()] == ["x"]
    for name, content in (("a.pdf", b"%PDF-1"), ("c.pdf", b"PK")):
        (tmp_path / "files").mkdir(exist_ok=True)
        (tmp_path / "files" / name).write_bytes(content)
    assert {r.path[-5:]: r.reason for r in readers.pdf_files(spark, str(tmp_path / "files")).collect()} == {"a.pdf": None, "c.pdf": "no PDF"}
    (tmp_path / "v.json").write_text('[{"uri": "u1", "label": "b"}, {"uri": "u1", "label": "a"}]')
    assert [tuple(r) for r in readers.value_list(spark, str(tmp_path / "v.json")).collect()] == [("u1", "a")]


def test_custom_merge(spark):
    d = docs(spark, "aap NOOT aap")
    terms = spark.createDataFrame([(0, 0, "aap"), (0, 1, "noot  AAP")], "doc_id long, ord int, term string")
    base = spark.createDataFrame([(0, 0, 3, "aap", "pending", "ner", 0.8, "x")], "doc_id long, start_char int, end_char int, text string, review_status string, source string, confidence double, woo_article string")
    rows = custom.merge_terms(base, custom.term_matches(d, terms)).orderBy("start_char").collect()
    assert [(r.text, r.confidence, r.review_status) for r in rows] == [("aap", 0.8, "accepted"), ("aap", 0.99, "accepted")]


def test_search_needs_two_characters(spark):
    pages = spark.createDataFrame([(1, 0, "Aap noot aap")], "doc_id long, page int, text string")
    assert custom.search(pages, "AAP").count() == 2 and custom.search(pages, "a").count() == 0


def test_boxes(spark):
    items = spark.createDataFrame([(1, 0, 0, "ab", 0.0, 0.0, 20.0, 10.0), (1, 0, 1, "cd", 30.0, 0.0, 50.0, 10.0)], "doc_id long, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double")
    spans = spark.createDataFrame([(1, 0, 1, 4)], "doc_id long, page int, start_char int, end_char int")
    box = locate.boxes_of_spans(spans, items).first().boxes[0]
    assert (box.x0, box.x1) == (10.0, 40.0)


def test_redaction_joins_overlaps(spark):
    d = docs(spark, "abcdefgh", "rest")
    det = spark.createDataFrame([(0, 1, 4, "accepted"), (0, 2, 6, "auto_accepted"), (0, 7, 8, "pending")], "doc_id long, start_char int, end_char int, review_status string")
    assert [r.text for r in reports.redact(d, det).orderBy("doc_id").collect()] == ["a█████gh", "rest"]


def test_undo(spark):
    log = spark.createDataFrame([(1, 7, "accepted", False), (2, 7, "rejected", False), (3, 7, "deferred", True)], "seq long, det_id long, status string, undone boolean")
    assert review.states(log).first().status == "rejected"
    assert review.states(review.undo_last(log, 1)).first().status == "accepted"
    assert review.states(review.undo_last(log, 9)).first().status == "pending"


def test_csv_quotes(spark):
    det = spark.createDataFrame([(0, "bsn", 'a "b", c', 0, 3, "accepted", "1", "regex", None)], "doc_id long, entity_type string, text string, start_char int, end_char int, review_status string, tier string, source string, woo_article string")
    assert reports.csv_lines(det).first().line == '1,BSN,,1,auto,"a ""b"", c"'


@pytest.mark.parametrize("name", ["title_list", "name_list"])
def test_list_files(spark, tmp_path, name):
    from inkveil.sources import readers

    (tmp_path / "x.txt").write_text("# c\nWethouder;1\n\nwethouder;2\nÉlan;3\n")
    rows = readers.name_list(spark, str(tmp_path)).collect() if name == "name_list" else readers.title_list(spark, str(tmp_path), "l").collect()
    assert len(rows) == (2 if name == "name_list" else 3)


def test_stream(spark, tmp_path):
    from inkveil.streaming.documents import decide_by_batch, detect_stream

    docs(spark, "mail a@b.nl", "niets").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    decide_by_batch(detect_stream(stream), lambda b: b.filter(F.col("tier") == "1"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a@b.nl"]


def test_dates_of_acts_are_no_birth_dates(spark):
    d = docs(spark, "vastgesteld op 1-2-1990, geboren 3 mei 1980 en 2024-05-01")
    rows = d.select(F.inline(tier2.dates(F.col("text"), F.lit("2025-01-01").cast("date"))))
    assert texts(rows) == ["3 mei 1980"]


def test_organisations(spark):
    assert texts(tier2.rule_rows(docs(spark, "De Stichting van het Open Huis en de gemeente; Gemeente Ede."), "organisation")) == ["Gemeente Ede", "Stichting van het Open Huis"]


def test_trims(spark):
    d = docs(spark, "wethouder Jan de Vries, burgemeester", "Jan de Vries raadslid van Ede", "Jan de Vries")
    rows = d.select(tier2.without_titles(F.col("text"), ("wethouder", "burgemeester", "raadslid")).alias("text"))
    assert texts(rows) == ["Jan de Vries", "Jan de Vries", "Jan de Vries"]
    one = d.limit(1).select(tier2.trimmed(tier2.hit("persoon", F.lit(" (Jan) "), F.lit(4), F.lit(0.8), "ner")).alias("h")).first().h
    assert (one.text, one.start_char, one.end_char) == ("Jan", 6, 9)
