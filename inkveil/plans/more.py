"""Further queries on detections that are derived from the given tables, each with DuckDB's answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions import values as V
from inkveil.functions.text import phrase
from inkveil.operators import classify, custom, locate, reports, review, structure, tier2
from inkveil.plans import queries as base
from inkveil.plans import sql
from inkveil.sources import corpus, readers

#: Detections with all fields that logs and reviews look at, one for each line item.
DETECTIONS = """select l_orderkey * 10 + l_linenumber as det_id, l_orderkey as doc_id,
    case l_linenumber % 5 when 0 then 'persoon' when 1 then 'adres' when 2 then 'bsn' when 3 then 'email' else 'area' end as entity_type,
    case when l_linenumber % 5 in (2, 3) then '1' else '2' end as tier,
    case l_suppkey % 6 when 0 then 'pending' when 1 then 'accepted' when 2 then 'rejected' when 3 then 'auto_accepted' when 4 then 'edited' else 'deferred' end as review_status,
    case l_suppkey % 4 when 0 then 'manual' when 1 then 'regex' when 2 then 'search_redact' end as source,
    case l_partkey % 5 when 0 then '5.1.2e' when 1 then '5.1.1.e' when 2 then '5.2' when 3 then 'x.9' end as woo_article,
    cast(50 + l_partkey % 50 as double) / 100 as confidence, case when l_partkey % 7 > 0 then cast(l_linenumber % 4 as int) end as page, cast(l_partkey % 700 as double) as y0,
    case when l_suppkey % 5 > 0 then cast(1000000000 + l_partkey as bigint) end as seen from (select l_orderkey, l_linenumber, max(l_partkey) as l_partkey, max(l_suppkey) as l_suppkey from lineitem group by 1, 2)"""
D = f"({DETECTIONS})"
SHOWN = "review_status in ('accepted', 'auto_accepted')"
LABEL = base._LABEL
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def query(name: str, answer: str) -> Callable[[Callable[[SparkSession, str], DataFrame]], None]:
    def add(plan: Callable[[SparkSession, str], DataFrame]) -> None:
        QUERIES[name] = (plan, answer)

    return add


def detections(s: SparkSession, d: str) -> DataFrame:
    rows = corpus.derived(s, d, DETECTIONS, "lineitem")
    box = F.struct("page", F.lit(1.0).alias("x0"), "y0", F.lit(9.0).alias("x1"), (F.col("y0") + 8).alias("y1"))
    return rows.select("*", F.when(F.col("page").isNotNull(), F.array(box)).otherwise(F.array().cast("array<struct<page:int,x0:double,y0:double,x1:double,y1:double>>")).alias("boxes"), F.timestamp_seconds("seen").alias("reviewed_at"))


def case_of(column: str, values: dict[str, str], other: str = "null") -> str:
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    return f"case {column} " + " ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in values.items()) + f" else {other} end"


NAME = case_of("woo_article", {c: g[0] for c, g in V.GROUNDS.items()})
MOTIVE = f"'Art. ' || woo_article || coalesce(' — ' || {NAME}, '')"
HAND = "coalesce(source in ('manual', 'search_redact'), false)"

# --- logs and reports --------------------------------------------------------------------------------------------------------
query("log_filter_page", f"select det_id from {D} where woo_article = '5.2' and tier = '2' and page = 2")(lambda s, d: reports.filtered(detections(s, d), tier="2", ground="5.2", page=3).select("det_id"))
_KEYS = {
    "index": "coalesce(page, -1) {0}, tier {0}, det_id {0}",
    "page": "coalesce(page, -1) {0}",
    "entity_type": f"{LABEL} {{0}}",
    "tier": "tier {0}",
    "woo_article": "coalesce(woo_article, '') {0}",
    "review_status": "review_status {0}",
    "source": "coalesce(source, '') {0}",
    "reviewed_at": "coalesce(seen, 0) {0}",
}
for _key, _order in _KEYS.items():
    for _way in ("asc", "desc"):
        query(f"log_sort_{_key}_{_way}", f"select doc_id, det_id, row_number() over (partition by doc_id order by {_order.format(_way)}, det_id) as place from {D}")(lambda s, d, key=_key, way=_way: reports.log_order(detections(s, d), key, way == "desc").select("doc_id", "det_id", "place"))
_PLACE = "row_number() over (partition by doc_id order by page asc nulls last, case when page is null then 0.0 else y0 end, det_id)"
query("report_rows", f"""select doc_id, {_PLACE} as nr, coalesce(page, -1) + 1 as page, {LABEL} as label, tier, woo_article as ground, case when {HAND} then 'handmatig' else 'auto' end as source,
    case when source is null then '—' else {case_of('source', V.SOURCE_LABELS, 'source')} end as source_label, case when woo_article is null then 'Geen Woo-grond gekoppeld — handmatig vastgesteld' else {MOTIVE} end as motivation from {D} where {SHOWN}""")(lambda s, d: reports.report_rows(detections(s, d)))  # fmt: skip
query("reading_order", f"select doc_id, det_id, {_PLACE} as nr from {D}")(lambda s, d: reports.reading_place(detections(s, d)).select("doc_id", "det_id", "nr"))
_CELL = lambda c: f"case when contains({c}, ',') then '\"' || {c} || '\"' else {c} end"
query("csv_log", f"""select doc_id, nr, nr || ',' || coalesce(cast(page as varchar), '') || ',' || {LABEL} || ',' || tier || ',' || coalesce(woo_article, '') || ',' || coalesce({_CELL(NAME)}, '') || ',' || review_status || ',' || coalesce(source, '') || ',' || coalesce(strftime(to_timestamp(seen) at time zone 'UTC', '%Y-%m-%d %H:%M:%S'), '') || ',' || case when page is null then '0' else '1' end || ',' || case when woo_article is null then 'Geen Woo-artikel gekoppeld' else {_CELL('(' + MOTIVE + ')')} end as line
    from (select *, row_number() over (partition by doc_id order by det_id) as nr from {D} where {SHOWN}) union all select distinct doc_id, 0, '{",".join(reports.CSV_COLUMNS)}' from {D} where {SHOWN}""")(lambda s, d: reports.csv_log(detections(s, d)))  # fmt: skip
query("redaction_boxes", f"select doc_id, det_id, page, cast(1 as double) as x0, y0, cast(9 as double) as x1, y0 + 8 as y1, coalesce(woo_article, '') as woo_article from {D} where {SHOWN} and page is not null")(lambda s, d: reports.redaction_boxes(detections(s, d)))
_SHORT = V.SHORT_GROUNDS
query("redaction_labels", f"select det_id, coalesce('Gelakt — Artikel ' || woo_article || ' — ' || {case_of('replace(woo_article, chr(46) || chr(101), chr(101))', _SHORT)}, 'Gelakt op grond van de Wet open overheid') as label from {D}")(lambda s, d: detections(s, d).select("det_id", reports.redaction_label(F.col("woo_article")).alias("label")))
query("ground_helpers", f"select det_id, 'Art. ' || woo_article || coalesce(' — ' || {NAME}, '') as label, {case_of('woo_article', {c: g[1] for c, g in V.GROUNDS.items()})} as kind from {D}")(lambda s, d: detections(s, d).select("det_id", reports.ground_label(F.col("woo_article")).alias("label"), reports.ground_kind(F.col("woo_article")).alias("kind")))
_LISTED = ", ".join("('" + "', '".join((g[2], c, g[0], g[1])) + "')" for c, g in V.GROUNDS.items())
query("ground_choices", f"select det_id, d.tier, code, name, kind, place from {D} d join (select *, row_number() over (partition by tier order by code) as place from (values {_LISTED}) t(tier, code, name, kind)) g on g.tier = d.tier")(
    lambda s, d: reports.ground_choices(detections(s, d))
)
query("tier_progress", f"select tier, count(*) filter (where review_status not in ('pending', 'deferred')) as reviewed, count(*) as total, count(*) filter (where review_status = 'pending') as pending, count(*) filter (where review_status = 'pending' and confidence >= 0.85) as high_pending, count(*) filter (where review_status <> 'rejected') as not_rejected, count(*) filter (where review_status = 'accepted') as accepted from {D} group by 1")(lambda s, d: reports.progress(detections(s, d)))
query("log_statistics", f"with d as (select * from {D} where entity_type = 'persoon') select 'status' as dimension, review_status as value, count(*) as n from d group by 2 union all select 'tier', tier, count(*) from d group by 2 union all select 'ground', woo_article, count(*) from d where woo_article is not null group by 2 union all select 'source', case when {HAND} then 'manual' else 'auto' end, count(*) from d group by 2")(lambda s, d: reports.log_statistics(reports.filtered(detections(s, d), kind="persoon")))
_REVIEWS = "select o_orderkey as doc_id, cast(o_custkey % 3 as int) as page, case o_custkey % 4 when 0 then 'complete' when 1 then 'flagged' when 2 then 'unreviewed' end as status from orders"
query("page_progress", f"select r.doc_id, done || '/' || total || ' pagina''s beoordeeld' || case when coalesce(open, 0) > 0 then ' · ' || open || ' detecties openstaand' else '' end as progress from (select doc_id, count(*) filter (where status = 'complete') as done, count(*) as total from ({_REVIEWS}) group by 1) r left join (select doc_id, count(*) filter (where review_status = 'pending') as open from {D} group by 1) o on o.doc_id = r.doc_id")(lambda s, d: reports.page_progress(corpus.derived(s, d, _REVIEWS, "orders"), detections(s, d)))
query("page_labels", f"select det_id, coalesce(cast(page + 1 as varchar), '—') as label from {D}")(lambda s, d: detections(s, d).select("det_id", reports.page_label(F.col("boxes")).alias("label")))
query("response_rows", f"select sha256(doc_id || '|' || entity_type || '|' || (det_id % 10) || '|' || (det_id % 10 + 5)) as id, det_id from {D}")(lambda s, d: reports.responses(detections(s, d).withColumn("start_char", F.col("det_id") % 10).withColumn("end_char", F.col("det_id") % 10 + 5)).join(detections(s, d).select("det_id", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "entity_type", (F.col("det_id") % 10).cast("string"), (F.col("det_id") % 10 + 5).cast("string")), 256).alias("id")), "id").select("id", "det_id"))
query("stripped_rows", f"select doc_id, tier, count(*) as n from {D} group by 1, 2")(lambda s, d: reports.stripped(detections(s, d).withColumn("entity_text", F.lit("x")).withColumn("confidence_level", F.lit("high"))).groupBy("doc_id", "tier").agg(F.count("*").alias("n")))
_REASONS = "select c_custkey as det_id, 'custom_wordlist' as source, 'Zoekterm ''' || c_mktsegment || ''' uit lijst' as reasoning from customer"
query("term_hits", f"select t.term, count(r.det_id) as n from (select distinct c_mktsegment as term from customer union all select 'NOWHERE') t left join ({_REASONS}) r on contains(r.reasoning, '''' || t.term || '''') group by 1")(lambda s, d: reports.term_hits(corpus.table(s, d, "customer").select(F.col("c_mktsegment").alias("term")).distinct().unionByName(s.sql("select 'NOWHERE' as term")), corpus.derived(s, d, _REASONS, "customer")))
_NOTES = "select o_orderkey as det_id, 'vooraf' || chr(10) || '[5.2] ' || o_orderpriority || ': ' || o_orderstatus || chr(10) || '[zonder einde' || chr(10) || '[5.1.2i] a: b' as reasoning from orders"
query("annotations", "select o_orderkey as det_id, cast(1 as bigint) as nr, '5.2' as article, o_orderpriority as label, o_orderstatus as analysis from orders union all select o_orderkey, 3, '5.1.2i', 'a', 'b' from orders")(lambda s, d: reports.annotations(corpus.derived(s, d, _NOTES, "orders")))
query("highlights", "select c_custkey, case when p > 0 then substr(c_name, 1, p - 1) else c_name end as before, case when p > 0 then substr(c_name, p, 4) else '' end as match, case when p > 0 then substr(c_name, p + 4) else '' end as after from (select *, strpos(lower(c_name), '0001') as p from customer)")(lambda s, d: corpus.table(s, d, "customer").select("c_custkey", reports.highlighted(F.col("c_name"), F.lit("0001")).alias("h")).select("c_custkey", "h.*"))
query("cleaned_values", "select p_partkey, left(nullif(trim(case when p_partkey % 3 = 0 then '   ' else '  ' || p_name || ' ' end), ''), 12) as value from part")(lambda s, d: corpus.table(s, d, "part").select("p_partkey", reports.cleaned(F.when(F.col("p_partkey") % 3 == 0, "   ").otherwise(F.concat(F.lit("  "), "p_name", F.lit(" "))), 12).alias("value")))
query("file_names", "select p_partkey, 'onderbouwing_' || replace(p_name, '/', '_') || '_2025-01-02.zip' as report, p_name || '_diwoo_2025-01-02.zip' as bundle from part")(lambda s, d: corpus.table(s, d, "part").select("p_partkey", reports.report_name(F.concat("p_name", F.lit(".PDF")), F.lit("2025-01-02"), True).alias("report"), reports.bundle_name(F.concat("p_name", F.lit(".pdf")), F.lit("2025-01-02")).alias("bundle")))
query("fingerprints", "select page_id, 'sha256:' || sha256(url) as hash from pages")(lambda s, d: corpus.table(s, d, "pages").select("page_id", reports.fingerprint(F.col("url")).alias("hash")))
query("same_documents", "select d.doc_id, g.first_id, g.copies from documents d join (select text, min(doc_id) as first_id, count(*) as copies from documents group by 1 having count(*) > 1) g on g.text = d.text")(lambda s, d: reports.same_documents(corpus.table(s, d, "documents")))
_SENT = "select o_orderkey as doc_id, case o_orderkey % 4 when 0 then '[{\"page\":' || o_orderkey % 5 || ',\"x0\":1,\"y0\":2,\"x1\":3,\"y1\":4}]' when 1 then '[{\"page\":1,\"x0\":1},{\"page\":-1}]' when 2 then 'nichts' else '[{\"page\":1,\"x0\":1,\"y0\":2,\"x1\":3,\"y1\":4},{\"page\":2,\"x0\":1,\"y0\":2,\"x1\":3,\"y1\":4},{\"page\":3,\"x0\":1,\"y0\":2,\"x1\":3,\"y1\":4}]' end as redactions from orders"
query("parsed_redactions", "select o_orderkey as doc_id, case o_orderkey % 4 when 1 then 'bad box' when 2 then 'not an array' when 3 then 'too many' end as reason from orders")(lambda s, d: reports.parsed_redactions(corpus.derived(s, d, _SENT, "orders"), 2).select("doc_id", "reason"))
_RECORDS = "select p_partkey as doc_id, 'u' || p_partkey as uuid, 'd' || p_partkey as document_uuid, p_name as title, p_brand as identifier, p_type as creator, case when p_partkey % 2 = 0 then p_brand end as responsible, '2024-01-01' as created, '2024-02-02' as changed, '2024-03-03' as exported, 'pdf' as format, 'a.pdf' as filename, case when p_partkey % 3 = 0 then p_size end as size, case when p_partkey % 5 = 0 then '' else p_name end as description from part"
_SHARED = """'"officieleTitel":"' || title || '","registratiedatum":"2024-03-03","laatstGewijzigdDatum":"2024-02-02","publicatiestatus":"concept","kenmerken":[{"kenmerk":"' || identifier || '","bron":"export"}]' || coalesce(',"omschrijving":"' || nullif(description, '') || '"', '')"""
query("publication_json", f"""select doc_id, '{{"publicatie":{{"uuid":"' || uuid || '",' || {_SHARED} || ',"urlPublicatieIntern":"","urlPublicatieExtern":"","diWooInformatieCategorieen":["c1"],"opsteller":"' || creator || '","verantwoordelijke":"' || coalesce(responsible, creator) || '","publisher":"' || coalesce(responsible, creator) || '"}},"document":{{"uuid":"' || document_uuid || '","publicatie":"' || uuid || '",' || {_SHARED} || ',"creatiedatum":"2024-01-01","uploadVoltooid":true,"bestandsformaat":"pdf","bestandsnaam":"a.pdf"' || coalesce(',"bestandsomvang":' || size, '') || '}}}}' as json from ({_RECORDS})""")(lambda s, d: reports.publication_json(corpus.derived(s, d, _RECORDS, "part").withColumn("categories", F.array(F.lit("c1")))))
query("bundle_readme", "select p_partkey as doc_id, p_name || chr(10) || chr(10) || 'Bestand: a.pdf' || chr(10) || 'Gelakte passages: ' || p_size || chr(10) || chr(10) || '- redacted.pdf: gelakt document' || chr(10) || '- metadata.xml, metadata.json: publicatiegegevens' || chr(10) || '- redaction-log.csv: lijst van gelakte passages' || chr(10) as readme from part")(lambda s, d: reports.bundle_readme(corpus.table(s, d, "part").selectExpr("p_partkey as doc_id", "p_name as title", "'a.pdf' as filename", "p_size as n")))

# --- review ------------------------------------------------------------------------------------------------------------------
query("review_edits", f"select det_id, case when det_id % 4 = 0 then 'rejected' when det_id % 4 = 2 then 'edited' else review_status end as review_status, case when det_id % 4 = 0 then '5.1.5' else woo_article end as woo_article, det_id % 4 = 2 and page is not null as kept_boxes, case when det_id % 2 = 0 then 1700000000 else coalesce(seen, 0) end as seen from {D}")(lambda s, d: _edited(s, d))


def _edited(s: SparkSession, d: str) -> DataFrame:
    own = detections(s, d)
    fresh = F.transform("boxes", lambda b: locate.moved(b, 1.0, 1.0))
    edits = own.filter("det_id % 2 = 0").select("det_id", F.when(F.col("det_id") % 4 == 0, "rejected").alias("review_status"), F.when(F.col("det_id") % 4 == 0, "5.1.5").alias("woo_article"), F.when(F.col("det_id") % 4 == 2, fresh).alias("boxes"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("at"))
    out = review.apply_edits(own, edits)
    return out.select("det_id", "review_status", "woo_article", F.coalesce(F.get("original_boxes", F.lit(0))["y0"] + 1 == F.get("boxes", F.lit(0))["y0"], F.lit(False)).alias("kept_boxes"), F.coalesce(F.unix_timestamp("reviewed_at"), F.lit(0).cast("long")).alias("seen"))


query("adjusted_boxes", f"select det_id, case when det_id % 3 = 0 then 'edited' else review_status end as review_status from {D}")(lambda s, d: review.adjust_boundary(detections(s, d), detections(s, d).filter("det_id % 3 = 0").select("det_id", F.transform("boxes", lambda b: locate.resized(b, "se", F.lit(0.0), F.lit(900.0))).alias("boxes"))).select("det_id", "review_status"))
query("resized_boxes", f"select det_id, 3.0::double as x1, greatest(700.0, y0 + 2) as y1, least(5.0, 7.0)::double as x0 from {D} where page is not null")(lambda s, d: detections(s, d).filter("page is not null").select("det_id", locate.resized(F.col("boxes")[0], "se", F.lit(0.0), F.lit(700.0)).alias("a"), locate.resized(F.col("boxes")[0], "nw", F.lit(5.0), F.lit(0.0)).alias("b")).select("det_id", "a.x1", "a.y1", "b.x0"))
query("bulk_accept", f"select det_id, case when review_status = 'pending' and (tier = '1' or confidence >= 0.85) then 'accepted' else review_status end as review_status from {D}")(lambda s, d: review.accept_pending(detections(s, d)).select("det_id", "review_status"))
query("bulk_status", f"select det_id, case when doc_id % 5 = 0 then 'deferred' else review_status end as review_status, case when doc_id % 5 = 0 then '5.2' else woo_article end as woo_article from {D}")(lambda s, d: review.bulk(detections(s, d), detections(s, d).filter("doc_id % 5 = 0"), "deferred", "5.2").select("det_id", "review_status", "woo_article"))
query("bulk_delete", f"select det_id from {D} where not (doc_id % 5 = 0 and {HAND})")(lambda s, d: review.bulk(detections(s, d), detections(s, d).filter("doc_id % 5 = 0"), delete=True).select("det_id"))
query("manual_rows", f"select det_id, 'accepted' as review_status, 'manual' as source, cast(1 as double) as confidence from {D} where doc_id % 5 = 0")(lambda s, d: review.manual_rows(detections(s, d).filter("doc_id % 5 = 0").withColumn("text", F.lit("x"))).select("det_id", "review_status", "source", "confidence"))
query("search_commit", f"select 'search-' || doc_id || '-' || page || '-' || start_char as det_id, text, 'search_redact' as source from ({sql.search('the')})")(lambda s, d: review.commit_search(custom.search(corpus.table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text"), "the").withColumn("boxes", F.array()), "persoon", "2", "5.1.2e").select("det_id", "text", "source"))
query("touched_pages", f"select r.doc_id, r.page, case when coalesce(r.status, 'unreviewed') = 'unreviewed' and exists (select 1 from {D} d where d.doc_id = r.doc_id and d.page = r.page and d.review_status in ('accepted', 'rejected', 'edited', 'deferred')) then 'in_progress' else coalesce(r.status, 'unreviewed') end as status from ({_REVIEWS}) r")(lambda s, d: review.touched_pages(corpus.derived(s, d, _REVIEWS, "orders"), detections(s, d)))
query("edited_lists", "select k as doc_id, n as name from (select c_custkey % 20 as k, c_mktsegment as n, min(c_custkey) from customer group by 1, 2) where not (k % 2 = 0 and n = 'BUILDING')")(lambda s, d: _lists(s, d))


def _lists(s: SparkSession, d: str) -> DataFrame:
    own = corpus.table(s, d, "customer").select((F.col("c_custkey") % 20).alias("doc_id"), F.col("c_mktsegment").alias("name"))
    return review.edited_list(own, own.select("doc_id", F.concat(F.lit("  "), F.lower("name"), F.lit(" ")).alias("name")), own.filter("doc_id % 2 = 0 and name = 'BUILDING'"))


_LIVE = f"(select *, max(case when not undone then seq end) over (partition by det_id) as last_live from {sql.EVENTS})"
query("redo_state", f"""with o as (select *, undone and seq > coalesce(last_live, -1) as open from {_LIVE}), r as (select *, row_number() over (partition by det_id, open order by seq) as nth from o)
    select det_id, coalesce(arg_max(status, seq) filter (where not (undone and not (open and nth <= 1))), 'pending') as status from r group by 1""")(lambda s, d: review.states(review.redo_next(base.events(s, d), 1)).select("det_id", "status"))  # fmt: skip

# --- municipalities, officials, lists ----------------------------------------------------------------------------------------
_MUNI = "select cast(n_nationkey as string) as gm_code, n_name as name, case when n_nationkey % 2 = 0 then substr(n_name, 1, 4) || ' (x)' else n_name end as short from nation"
_ALIASES = "(select gm_code, lower(a) as alias from (select gm_code, unnest([name, 'gemeente ' || name, 'gemeente ' || trim(regexp_replace(short, '\\s*\\([^)]*\\)', '', 'g')), case when length(trim(regexp_replace(short, '\\s*\\([^)]*\\)', '', 'g'))) >= 5 then trim(regexp_replace(short, '\\s*\\([^)]*\\)', '', 'g')) end]) as a from (" + _MUNI + ")) where a is not null)"
query("municipality_aliases", f"select distinct gm_code, alias from {_ALIASES}")(lambda s, d: classify.municipality_aliases(corpus.derived(s, d, _MUNI, "nation")))
_TALK = "select s_suppkey as doc_id, 'Brief aan gemeente ' || n_name || '/(' || s_name || '), over de ' || lower(n_name) || 'se zaak' as text from supplier join nation on s_nationkey = n_nationkey"
query("active_municipalities", f"select distinct doc_id, gm_code from (select doc_id, ' ' || lower(trim(regexp_replace(text, '\\W+', ' ', 'g'))) || ' ' as t from ({_TALK})) join {_ALIASES} on contains(t, ' ' || alias || ' ')")(lambda s, d: classify.active_municipalities(corpus.derived(s, d, _TALK, "supplier", "nation"), classify.municipality_aliases(corpus.derived(s, d, _MUNI, "nation"))))
_STAFF = "select n_name as organisation, case s_suppkey % 5 when 0 then 'Dhr. A.B. (Jan) van den ' || 'Berg' || s_suppkey when 1 then 'Mw. mr. C. Smit' when 2 then 'Klant ' || s_suppkey when 3 then 'ing. D.E.F. Étoile-Bos' else 'Juridische zaken' end as name, case when s_suppkey % 2 = 0 then 'Woo-contactpersoon' else 'raadslid' end as role, case when s_suppkey % 3 = 0 then 'x/' || n_nationkey else 'x/none' end as uri, cast(n_nationkey as string) as code, s_suppkey as k from supplier join nation on s_nationkey = n_nationkey"
_PARSED = f"(select *, case k % 5 when 0 then 'van den berg' || k when 1 then 'smit' when 3 then 'etoile bos' end as surname, case k % 5 when 0 then 'ab' when 1 then 'c' when 3 then 'def' end as initials from ({_STAFF}))"
query("officials_list", f"select code as gm_code, surname, initials, role, name from {_PARSED} where surname is not null")(lambda s, d: readers.officials(corpus.derived(s, d, _STAFF, "supplier", "nation"), corpus.derived(s, d, _MUNI, "nation")))
query("officials_per_municipality", f"select code as gm_code, count(*) as n from {_PARSED} where surname is not null group by 1")(lambda s, d: readers.officials_of(readers.officials(corpus.derived(s, d, _STAFF, "supplier", "nation"), corpus.derived(s, d, _MUNI, "nation"))).select("gm_code", "n"))
query("split_contacts", f"select organisation as municipality, name, role, uri, case when k % 5 in (0, 1, 3) then 'named' else 'inbox' end as kind from ({_STAFF}) where role = 'Woo-contactpersoon'")(lambda s, d: readers.split_contacts(corpus.derived(s, d, _STAFF, "supplier", "nation")))
_PACKED = "select cast(n_nationkey as string) as gm_code, 'adresType: Bezoekadres, openbareRuimte: ' || n_name || 'straat, huisnummer: ' || n_nationkey || ', woonplaats: ' || n_name || '; adresType: Postadres, postbus: 93, t.a.v. balie, postcode: ' || (1000 + n_nationkey) || ' AB;' as adressen, '0' || (201234567 + n_nationkey) || ', label: algemeen' as telefoon, lower(n_name) || '@x.nl' as email, case when n_nationkey % 2 = 0 then 'https://x' || n_nationkey || '.nl, label: a' end as website from nation"
query("public_values", "select 'telefoon' as kind, '0' || (201234567 + n_nationkey) as value from nation union select 'email', lower(n_name) || '@x.nl' from nation union select 'url', 'https://x' || n_nationkey || '.nl' from nation where n_nationkey % 2 = 0 union select 'postcode', (1000 + n_nationkey) || ' AB' from nation union select 'adres', n_name || 'straat ' || n_nationkey from nation union select 'adres', n_name from nation")(lambda s, d: readers.public_values(corpus.derived(s, d, _PACKED, "nation")))
_TAGGED = "select p_partkey as id, case p_partkey % 6 when 0 then 'NAAM' when 1 then 'woonplaats' when 2 then 'bsn' when 3 then 'leeftijd' when 4 then 'ziekenhuis' else 'datum' end as tag from part"
query("tag_map", "select p_partkey as id, case p_partkey % 6 when 0 then 'persoon' when 1 then 'adres' when 4 then 'organisatie' else 'datum' end as entity_type from part where p_partkey % 6 in (0, 1, 4, 5)")(lambda s, d: tier2.by_tag(corpus.derived(s, d, _TAGGED, "part")).select("id", "entity_type"))

# --- places and decisions ----------------------------------------------------------------------------------------------------
_WORDS = "select c_custkey as doc_id, 'jan Jan janssen, JAN; anjan jan' as text, cast(c_custkey % 6 as int) as nth from customer"
_LED = "select c_custkey as doc_id, 0 as start_char, 30 as end_char, case c_custkey % 4 when 0 then 'Wethouder Jan Smit' when 1 then 'wethouder' when 2 then 'Projectleider A. Bos' else 'Jan de wethouder' end as text from customer"
query("leading_titles", "select c_custkey as doc_id, case c_custkey % 4 when 0 then 'publiek' else 'ambtenaar' end as list_name, case c_custkey % 4 when 0 then 'wethouder' else 'projectleider' end as title from customer where c_custkey % 4 in (0, 2)")(lambda s, d: classify.leading_titles(corpus.derived(s, d, _LED, "customer"), base.titles(s)).select("doc_id", "list_name", "title"))
query("structure_order", f"select doc_id, kind, start_char, row_number() over (partition by doc_id order by start_char, end_char, kind) as place from ({sql.structures()})")(lambda s, d: structure.ordered(structure.detect(base.letters(s, d))).select("doc_id", "kind", "start_char", "place"))
_ROUTED = f"select doc_id, entity_type, '1' as tier, start_char, end_char, review_status from ({sql.status()}) union all select doc_id, 'persoon', '2', start_char, end_char, review_status from ({sql.classify()}) union all select doc_id, entity_type, '2', start_char, end_char, 'pending' from ({sql.reference()})"
query("routed", _ROUTED)(lambda s, d: _routed(s, d))


def _routed(s: SparkSession, d: str) -> DataFrame:
    own = ["doc_id", "entity_type", "text", "start_char", "end_char", "confidence", "source"]
    soft = tier2.rule_rows(base.letters(s, d), "initials", context=True).select(*own, "before", "after").unionByName(tier2.rule_rows(base.letters(s, d), "reference", context=True).select(*own, "before", "after"))
    hard = base.found(s, d).select(*own, "before", "tier", "woo_article").withColumn("after", F.lit(""))
    spans = hard.unionByName(soft.withColumn("tier", F.lit("2")).withColumn("woo_article", F.lit("5.1.2e")))
    letters = base.letters(s, d)
    out = classify.route(spans, letters, base.contacts(s, d), base.reference_names(s, d), base.officials(s, d), base.titles(s), structure.detect(letters))
    return out.select("doc_id", "entity_type", "tier", "start_char", "end_char", "review_status")


_TOWNS = ", ".join(f"({k}, '{t}')" for k, t in enumerate(corpus._TOWNS.split(",")))


def decided_documents(s: SparkSession, d: str) -> DataFrame:
    """From the letters to decisions; their municipality is the one that the text names."""
    letters = base.letters(s, d).select("doc_id", "text")
    towns = s.sql(f"select gm_code, name, name as short from values {_TOWNS} as t(gm_code, name)")
    out = classify.decide(letters, base.contacts(s, d), base.reference_names(s, d), base.officials(s, d), base.titles(s), classify.municipality_aliases(towns), as_of=sql.AS_OF)
    return out.select("doc_id", "entity_type", "tier", "start_char", "end_char", "review_status")


_OVER = "exists (select 1 from {0} x where x.doc_id = p.doc_id and x.start_char < p.end_char and p.start_char < x.end_char)"
_T2 = f"""with l as ({sql.listed(base.FIRST, base.LAST)}), i as (select * from ({sql.initials()}) p where not {_OVER.format('l')}), t as (select * from ({sql.titles()}) p where not {_OVER.format('l')} and not {_OVER.format('i')}),
    every as (select * from l union all select * from ({sql.organisations()}) union all select * from ({sql.street()}) union all select * from ({sql.house_number()}) union all select * from i union all select * from ({sql.reference()}) union all select * from t)
    select doc_id, entity_type, '2' as tier, text, start_char, end_char, confidence, case when entity_type = 'organisatie' then '' else '5.1.2e' end as woo_article, source from every"""
query("t2_all", _T2)(lambda s, d: base._QUERIES["t2_all"](s, d))
query("detect_all", f"""with t1 as ({sql.tier1()}), t2 as ({_T2}) select * from t1 union all
    select doc_id, entity_type, tier, text, start_char, end_char, case when exists (select 1 from t1 where t1.doc_id = t2.doc_id and lower(t1.text) = lower(t2.text)) then least(1.0, round(confidence + 0.10, 2)) else confidence end, woo_article, source
    from t2 where not exists (select 1 from t1 where t1.doc_id = t2.doc_id and t1.start_char = t2.start_char and t1.end_char = t2.end_char)""")(lambda s, d: base._QUERIES["detect_all"](s, d))  # fmt: skip
#: Persons by initials, and by forms of address where no such person is; then the other rules, without what tier 1 found at the same place.
#: The letters' one date stands behind "Geboortedatum:", which counts as a date of an act for tier 2, so it has none.
_COLUMNS = "doc_id, entity_type, text, start_char, end_char, confidence, source"
_PERSONS = f"with i as (select {_COLUMNS} from ({sql.initials()})), t as (select {_COLUMNS} from ({sql.titles()}) p where not {_OVER.format('i')}) select * from i union all select * from t"
_OTHERS = " union all ".join(f"select doc_id, entity_type, start_char, end_char from ({x})" for x in (sql.organisations(), sql.street(), sql.house_number(), sql.reference()))
query("decided_documents", f"""select doc_id, entity_type, '1' as tier, start_char, end_char, review_status from ({sql.status()}) union all select doc_id, 'persoon', '2', start_char, end_char, review_status from ({sql.classify().replace(sql.initials(), _PERSONS)})
    union all select doc_id, entity_type, '2', start_char, end_char, 'pending' from ({_OTHERS}) o where not exists (select 1 from ({sql.tier1()}) t where t.doc_id = o.doc_id and t.start_char = o.start_char and t.end_char = o.end_char)""")(decided_documents)  # fmt: skip

