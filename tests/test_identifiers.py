"""Tier-1 extractors on our own strings: positive, negative, offsets."""

import pytest

from inkveil.operators import tier1


def hits(spark, text, *kinds):
    rows = tier1.detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), kinds or tier1.ORDER, as_of="2025-01-01").collect()
    for r in rows:
        assert text[r.start_char : r.end_char] == r.text
    return sorted((r.entity_type, r.text, r.start_char) for r in rows)


CASES = [
    ("bsn", "😀 nr 111222333, niet 111222334 of 011222333", ["111222333"]),
    ("iban", "op NL91ABNA0417164300 en nl20 INGB\n0001 2345 67, niet NL92ABNA0417164300 of DE89370400440532013000", ["NL91ABNA0417164300", "nl20 INGB\n0001 2345 67"]),
    ("telefoon", "bel 06-12345678, +31 6 12345678, 020-1234567, (+31(0)6 12 34 56 78) niet 0612345", ["+31 6 12345678", "+31(0)6 12 34 56 78", "020-1234567", "06-12345678"]),
    ("email", "mail a.b+c@post.voorbeeld.nl; niet a@b", ["a.b+c@post.voorbeeld.nl"]),
    ("postcode", "in 1234 AB en 1234AB, niet 1234 ab of 12345 AB", ["1234 AB", "1234AB"]),
    ("kenteken", "auto's AB-12-CD en 1-ABC-23, niet ab-12-cd", ["1-ABC-23", "AB-12-CD"]),
    ("url", "zie (https://a.nl/b?c=1). En xhttp://b.nl", ["https://a.nl/b?c=1"]),
    ("kvk", "KvK: 12345678. Maar factuur 87654321", ["12345678"]),
    ("btw", "NL111222333B01 en NL111222334B01", ["NL111222333B01"]),
    ("geboortedatum", "geboren op 3 mei 1980, geb. 31-02-1980, DOB 01/02/2030, geb: 1-2-1999", ["1-2-1999", "3 mei 1980"]),
    ("creditcard", "kaart 4111 1111 1111 1111, niet 4111 1111 1111 1112", ["4111 1111 1111 1111"]),
]


@pytest.mark.parametrize("kind,text,expected", CASES, ids=[c[0] for c in CASES])
def test_type(spark, kind, text, expected):
    assert sorted(t for _, t, _ in hits(spark, text, kind)) == expected


def test_kvk_table_pass_needs_words_between(spark):
    assert [t for _, t, _ in hits(spark, "Kamer van Koophandel 11111111 vestiging 22222222", "kvk")] == ["11111111", "22222222"]
    assert [t for _, t, _ in hits(spark, "KvK 11111111. Daarna kwam 22222222", "kvk")] == ["11111111"]


def test_equal_span_is_told_once(spark):
    assert hits(spark, "06 12345678", "telefoon") == [("telefoon", "06 12345678", 0)]


def test_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a@b.nl")], "doc_id long, text string")
    assert [(r.doc_id, r.text) for r in tier1.detect(docs).collect()] == [(None, "a@b.nl")]
    assert tier1.detect(docs.limit(0)).count() == 0
