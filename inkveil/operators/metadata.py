"""Publication metadata as XML: one document's record as an indented envelope with all required collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.operators.reports import xml_text

#: Namespaces and names of the format (fixed values).
NS_DIWOO, NS_TERMS = "https://standaarden.overheid.nl/diwoo/metadata/", "http://purl.org/dc/terms/"
KIND, NO_THEME, NO_KEYWORD = "besluit", "overig", "document"
RECORD = """doc_id long, uuid string, title string, identifier string, categories array<struct<uri:string,label:string>>, author string, responsible string,
created string, language string, actions array<struct<type:string,at:string>>, format string, description string"""


def keyword(title: Column) -> Column:
    """The first word of four characters or more of a title without its file ending, in lower case; else its first word."""
    plain = F.trim(F.lower(F.regexp_replace(F.regexp_replace(title, r"(?i)\.[a-z0-9]{1,5}$", ""), "[_-]+", " ")))
    words = F.filter(F.split(plain, r"\s+"), lambda w: w != "")
    return F.coalesce(F.try_element_at(F.filter(words, lambda w: F.length(w) >= 4), F.lit(1)), F.try_element_at(words, F.lit(1)), F.lit(NO_KEYWORD))


def _line(depth: int, *parts: Column | str) -> Column:
    return F.concat(F.lit("\t" * depth), *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _leaf(depth: int, tag: str, value: Column) -> Column:
    return F.array(_line(depth, f"<diwoo:{tag}>", xml_text(value), f"</diwoo:{tag}>"))


def _block(depth: int, tag: str, *inner: Column) -> Column:
    return F.concat(F.array(_line(depth, f"<diwoo:{tag}>")), *inner, F.array(_line(depth, f"</diwoo:{tag}>")))


def _if(test: Column, lines: Column) -> Column:
    return F.when(test, lines).otherwise(F.array().cast("array<string>"))


def publication_xml(records: DataFrame) -> DataFrame:
    """doc_id, xml of records (RECORD). Texts are escaped; actions and description are left out where there are none; the responsible body is the author
    where none is given; the theme is the first category's label. Null required values are empty elements."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    none = F.array().cast("array<struct<uri:string,label:string>>")
    categories = F.transform(F.coalesce("categories", none), lambda c: _line(4, '<diwoo:informatiecategorie resource="', xml_text(F.coalesce(c["uri"], F.lit(""))), '">', xml_text(F.coalesce(c["label"], F.lit(""))), "</diwoo:informatiecategorie>"))
    action = lambda a: _block(3, "documenthandeling", _leaf(4, "soortHandeling", F.coalesce(a["type"], F.lit(""))), _leaf(4, "atTime", F.coalesce(a["at"], F.lit(""))))
    responsible = F.coalesce("responsible", text("author"))
    theme = F.coalesce(F.try_element_at(F.col("categories"), F.lit(1))["label"], F.lit(NO_THEME))
    collection = _block(
        2, "classificatiecollectie",
        _block(3, "documentsoorten", _leaf(4, "documentsoort", F.lit(KIND))), _block(3, "informatiecategorieen", categories),
        _block(3, "themas", _leaf(4, "thema", theme)), _block(3, "trefwoorden", _leaf(4, "trefwoord", keyword(text("title")))),
    )
    body = _block(
        1, "DiWoo", collection, _leaf(2, "creatiedatum", text("created")),
        _if(F.coalesce(F.size("actions") > 0, F.lit(False)), _block(2, "documenthandelingen", F.flatten(F.transform("actions", action)))),
        _leaf(2, "format", text("format")), _block(2, "geldigheid", _leaf(3, "begindatum", text("created"))),
        _block(2, "identifiers", _leaf(3, "identifier", text("identifier")), _leaf(3, "identifier", F.concat(F.lit("urn:uuid:"), text("uuid")))), _leaf(2, "language", text("language")),
        _if(text("description") != "", _block(2, "omschrijvingen", _leaf(3, "omschrijving", text("description")))),
        _leaf(2, "opsteller", text("author")), _leaf(2, "publisher", responsible), _leaf(2, "verantwoordelijke", responsible), _block(2, "titelcollectie", _leaf(3, "officieleTitel", text("title"))),
    )
    head = F.array(F.lit('<?xml version="1.0" encoding="UTF-8"?>'), F.lit(f'<diwoo:Document xmlns:diwoo="{NS_DIWOO}" xmlns:dcterms="{NS_TERMS}">'))
    return records.select("doc_id", F.array_join(F.concat(head, body, F.array(F.lit("</diwoo:Document>"), F.lit(""))), "\n").alias("xml"))
