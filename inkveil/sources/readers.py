"""Readers and writers: page and item files, dimension files, review tables, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions import values as V
from inkveil.functions.text import normalise_token, phrase

PAGES = "doc_id string, pages array<struct<page_number:int,full_text:string,text_items:array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>>>, reference_names array<string>, custom_terms array<struct<term:string,match_mode:string,woo_article:string>>"
DETECTION = "doc_id string, entity_type string, tier string, confidence double, woo_article string, review_status string, source string, start_char int, end_char int, text string"


def requests(spark: SparkSession, path: str) -> DataFrame:
    """Analyze requests as JSON lines, with a fixed schema."""
    return spark.read.schema(PAGES).json(path)


def pages(requests_: DataFrame) -> DataFrame:
    """doc_id, page, text."""
    return requests_.select("doc_id", F.inline("pages")).select("doc_id", F.col("page_number").alias("page"), F.col("full_text").alias("text"))


def items(requests_: DataFrame) -> DataFrame:
    """doc_id, page, ord, text and box of every item that is not blank."""
    rows = requests_.select("doc_id", F.inline("pages")).select("doc_id", F.col("page_number").alias("page"), F.posexplode("text_items").alias("ord", "item"))
    return rows.select("doc_id", "page", "ord", "item.*").filter("trim(text) <> ''")


def pdf_files(spark: SparkSession, path: str, most_bytes: int = 50 << 20) -> DataFrame:
    """path, length, valid, reason of PDF files: by size, emptiness and magic bytes. Only checks; no parser is bundled.
    Spark's reader may leave out files without any byte."""
    files = spark.read.format("binaryFile").load(path)
    reason = F.when(F.col("length") == 0, "empty").when(F.col("length") > most_bytes, "too large").when(F.substring("content", 1, 5) != F.to_binary(F.lit("255044462D"), F.lit("hex")), "no PDF")
    return files.select("path", "length", reason.isNull().alias("valid"), reason.alias("reason"))


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """name: first column of a list with ; , or tab between columns, without comments and blanks, normalised and distinct."""
    lines = spark.read.text(path).filter("trim(value) <> '' and not startswith(ltrim(value), '#')")
    return lines.select(normalise_token(F.element_at(F.split("value", "[;,\t]", 2), 1)).alias("name")).filter("name <> ''").distinct()


def title_list(spark: SparkSession, path: str, list_name: str) -> DataFrame:
    """list_name, title, ord: one title a line, lower case, white space collapsed, first occurrence kept. A list is a small file of one split."""
    lines = spark.read.text(path).coalesce(1).withColumn("ord", F.monotonically_increasing_id()).filter("trim(value) <> '' and not startswith(ltrim(value), '#')")
    title = F.lower(F.trim(F.regexp_replace("value", r"\s+", " ")))
    return lines.groupBy(title.alias("title")).agg(F.min("ord").cast("int").alias("ord")).select(F.lit(list_name).alias("list_name"), "title", "ord")


def municipalities(spark: SparkSession, path: str) -> DataFrame:
    """kind, value of public contact data from a ;-separated file with columns adres, telefoon, email, website ('k: v' parts, first value before a comma)."""
    rows = spark.read.option("sep", ";").option("header", True).csv(path)
    first = lambda c: F.trim(F.element_at(F.split(F.col(c), ","), 1))
    code = F.regexp_extract("adres", r"\b\d{4}\s?[A-Z]{2}\b", 0)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("telefoon", first("telefoon")), ("email", first("email")), ("url", first("website")), ("postcode", code))])
    return rows.select(F.inline(kinds)).filter("value is not null and value <> ''").distinct()


def concepts(page_rows: DataFrame) -> DataFrame:
    """uri, label of links in (page_id, html), the first of each uri."""
    links = page_rows.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?s)<a\s+href="([^"]+)"[^>]*>([^<]*)</a>'), F.lit(0))).alias("ord", "link"))
    parts = links.select("page_id", "ord", F.regexp_extract("link", r'href="([^"]+)"', 1).alias("uri"), F.regexp_extract("link", r">([^<]*)<", 1).alias("label"))
    return parts.groupBy("uri").agg(F.min_by("label", F.struct("page_id", "ord")).alias("label"))


def changed(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows that only one of two lists has, with change 'added' or 'removed'."""
    return fresh.exceptAll(stored).withColumn("change", F.lit("added")).unionByName(stored.exceptAll(fresh).withColumn("change", F.lit("removed")))


def patched(stored: DataFrame, patches: DataFrame, key: str = "doc_id") -> DataFrame:
    """Stored session rows with the fields of patches (null: field stays); rows only in patches are added."""
    fields = [c for c in stored.columns if c != key]
    p = patches.select(key, *[F.col(c).alias(f"new_{c}") for c in fields])
    return stored.join(p, key, "full").select(key, *[F.coalesce(f"new_{c}", c).alias(c) for c in fields])


def write_log(lines: DataFrame, path: str) -> None:
    """The redaction log's lines (doc_id, nr, line) as Parquet, sorted within files, so that the rows of a document stand together."""
    lines.repartitionByRange("doc_id", "nr").sortWithinPartitions("doc_id", "nr").select("doc_id", "nr", "line").write.parquet(path)


def addresses(rows: DataFrame, column: str = "adressen") -> DataFrame:
    """gm_code, nth, record (map) of packed addresses: records between semicolons, 'key: value' parts between commas; other parts are left out."""
    records = F.filter(F.transform(F.split(column, ";"), lambda r: F.trim(r)), lambda r: r != "")

    def record(text: Column) -> Column:
        pairs = F.filter(F.split(text, ","), lambda p: p.contains(":"))
        entries = F.transform(pairs, lambda p: F.struct(F.trim(F.split(p, ":", 2)[0]).alias("k"), F.trim(F.split(p, ":", 2)[1]).alias("v")))
        last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["k"] == e["k"]))
        return F.map_from_entries(last)

    return rows.select("gm_code", F.posexplode(F.transform(records, record)).alias("nth", "record")).filter(F.size("record") > 0)


def public_values(rows: DataFrame) -> DataFrame:
    """kind, value of municipalities' contact data from (gm_code, adressen, telefoon, email, website); first value before a comma."""
    first = lambda c: F.trim(F.split(F.col(c), ",", 2)[0])
    simple = rows.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), first(c).alias("value")) for k, c in (("telefoon", "telefoon"), ("email", "email"), ("url", "website"))])))
    of = addresses(rows).select("record")
    street = F.concat_ws(" ", F.col("record")["openbareRuimte"], F.col("record")["huisnummer"])
    packed = of.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("postcode", F.col("record")["postcode"]), ("adres", street), ("adres", F.col("record")["woonplaats"]))])))
    return simple.unionByName(packed).filter("value is not null and value <> ''").distinct()


def parsed_person(name: Column) -> Column:
    """struct(surname, initials) of a listed name, or null where it is no person's (neither a form of address nor initials)."""
    tokens = F.filter(F.split(F.trim(F.regexp_replace(name, r"\([^)]*\)", " ")), r"\s+"), lambda t: t != "")
    honorific = lambda t: F.lower(F.btrim(t, F.lit("."))).isin(*V.HONORIFICS)
    initials = lambda t: t.rlike(r"^[A-Z](?:\.[A-Z])*\.$")
    own = F.split(F.trim(name), r"\s+")
    person = F.exists(own, lambda t: honorific(t) | initials(t))
    letters = F.lower(F.regexp_replace(F.array_join(F.filter(tokens, initials), ""), r"[^A-Z]", ""))
    surname = phrase(F.array_join(F.filter(tokens, lambda t: ~initials(t) & ~honorific(t)), " "))
    return F.when(person & (surname != ""), F.struct(surname.alias("surname"), letters.alias("initials")))


def officials(rows: DataFrame, municipalities: DataFrame) -> DataFrame:
    """gm_code, surname, initials, role, name of persons from (organisation, name, role, uri).

    A row belongs to the municipality (gm_code, name) whose code ends its uri, else to the one with its organisation's name; rows of
    neither, and names that are no person's, are left out.
    """
    codes = municipalities.select("gm_code").distinct().withColumn("by_code", F.col("gm_code"))
    names = municipalities.groupBy(phrase(F.col("name")).alias("norm")).agg(F.min("gm_code").alias("by_name"))
    keyed = rows.withColumn("tail", F.element_at(F.split(F.coalesce("uri", F.lit("")), "/"), -1)).withColumn("norm", phrase(F.col("organisation")))
    placed = keyed.join(codes.withColumnRenamed("gm_code", "tail"), "tail", "left").join(names, "norm", "left").withColumn("gm_code", F.coalesce("by_code", "by_name"))
    return placed.withColumn("p", parsed_person(F.col("name"))).filter("gm_code is not null and p is not null").select("gm_code", "p.surname", "p.initials", "role", "name")


def officials_of(listed: DataFrame) -> DataFrame:
    """gm_code, officials, n: those of a municipality as one sorted array."""
    rows = F.array_sort(F.collect_list(F.struct("surname", "initials", "role")))
    return listed.groupBy("gm_code").agg(rows.alias("officials"), F.count("*").alias("n"))


def split_contacts(rows: DataFrame) -> DataFrame:
    """municipality, name, role, uri, kind (named or inbox) of contact persons: a name is a person's by its form, initials or particles, else if it
    tells no function and all its words are capitalised."""
    bare = lambda c: F.btrim(F.trim(F.col(c)), F.lit('"'))
    own = rows.select(bare("organisation").alias("municipality"), bare("name").alias("name"), bare("role").alias("role"), bare("uri").alias("uri")).filter(F.col("role") == V.CONTACT_ROLE)
    name, words = F.col("name"), F.split(F.trim("name"), r"\s+")
    capital = F.forall(words, lambda w: F.upper(F.left(w, F.lit(1))) == F.left(w, F.lit(1))) & F.forall(words, lambda w: ~F.left(w, F.lit(1)).rlike(r"[^\p{L}]"))
    plain = (F.size(words) >= 2) & capital & ~F.exists(words, lambda w: F.lower(w).isin("en", "of"))
    person = (name != "") & (name.rlike(V.CONTACT_HONORIFIC) | (name.rlike(V.CONTACT_INITIAL) & name.rlike("[A-Z][a-z]{2,}")) | name.rlike(V.CONTACT_PARTICLE) | (~name.rlike(V.CONTACT_FUNCTION) & plain))
    return own.withColumn("kind", F.when(person, "named").otherwise("inbox"))


def value_list(spark: SparkSession, path: str) -> DataFrame:
    """uri, label of a JSON list of values, the first of each uri."""
    rows = spark.read.option("multiLine", True).schema("uri string, label string").json(path)
    return rows.filter("uri is not null").groupBy("uri").agg(F.min("label").alias("label"))
