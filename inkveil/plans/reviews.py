"""Queries on reviews over time and over dossiers: undo by batches, sessions, refreshed decisions, copies, propagated decisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.operators import classify, copies, dossiers, incremental, metadata, undo
from inkveil.operators.groups import grown, written
from inkveil.plans import queries as base
from inkveil.plans import sql
from inkveil.sources import corpus
from inkveil.streaming import documents

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, answer: str | None) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    def add(plan: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = (plan, answer)
        return plan

    return add


# --- undo by batches: each user's events are commands on that user's detections --------------------------------------------------
COMMANDS = """select user_id as session, event_id as seq,
    case when event_type in ('click', 'signup', 'error') then 'push' when event_type = 'view' then 'undo' when event_id % 50 = 0 then 'clear' else 'redo' end as action, event_id % 4 as n from events"""
DEPTH = 4


def commands(s: SparkSession, d: str) -> DataFrame:
    """A batch of up to three changes for each new command; two of its changes can be of one detection."""
    rows = corpus.derived(s, d, COMMANDS, "events")
    change = lambda k: F.struct(
        ((F.col("seq") + k * 7) % 5).alias("det_id"), F.when((F.col("seq") + k) % 3 > 0, F.lit("pending")).otherwise(F.lit("deferred")).alias("status_before"),
        F.when((F.col("seq") + k) % 2 == 0, F.lit("accepted")).otherwise(F.lit("rejected")).alias("status"),
        F.when(F.col("seq") % 5 > 0, F.lit("5.2")).alias("ground_before"), F.concat(F.lit("5.1."), k.cast("string")).alias("ground"),
    )
    changes = F.when((F.col("action") == "push") & (F.col("n") > 0), F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), change))
    return rows.select("session", "seq", "action", changes.cast(undo.CHANGES).alias("changes"))


@query(
    "undo_batches",
    f"""with recursive c as (select *, row_number() over (partition by session order by seq) as k from ({COMMANDS})),
run as (
    select distinct session, 0::bigint as k, []::bigint[] as done, []::bigint[] as undone, null::bigint as batch, false as back from c
    union all
    select c.session, c.k,
        case action when 'push' then list_append(done, seq)[-{DEPTH} :] when 'undo' then done[: len(done) - 1] when 'redo' then case when len(undone) > 0 then list_append(done, undone[-1]) else done end else [] end,
        case action when 'push' then [] when 'undo' then case when len(done) > 0 then list_append(undone, done[-1]) else undone end when 'redo' then undone[: len(undone) - 1] else [] end,
        case action when 'push' then seq when 'undo' then done[-1] when 'redo' then undone[-1] end, action = 'undo'
    from run join c on c.session = run.session and c.k = run.k + 1),
made as (
    select run.session, run.k, case when back then -j else j end as place, (batch + j * 7) % 5 as det_id,
        case when back then case when (batch + j) % 3 > 0 then 'pending' else 'deferred' end when (batch + j) % 2 = 0 then 'accepted' else 'rejected' end as status,
        case when back then case when batch % 5 > 0 then '5.2' end else '5.1.' || j end as ground
    from run join c on c.session = run.session and c.seq = run.batch, unnest(range(1, c.n + 1)) as u(j))
select session, det_id, arg_max(status, k * 100 + place) as status, arg_max(ground, k * 100 + place) filter (ground is not null) as ground, count(*) as n from made group by all""",
)
def undo_batches(s: SparkSession, d: str) -> DataFrame:
    return undo.states(undo.changes_of(commands(s, d), DEPTH))


# --- sessions of deliveries: each event delivers the letter of its user's customer ------------------------------------------------
@query(
    "delivery_sessions",
    f"""with docs as (select distinct on (event_id) event_id, user_id as sender, ts, text from events join ({corpus.CORPUS_SQL}) l on l.doc_id = user_id where event_type <> 'error'),
mails as (
    select doc_id, count(*) as n, count(*) filter (where c.value is not null) as public from ({sql.tier1(('email', 'url'))}) t
    left join (select distinct kind, lower(value) as value from ({corpus.CONTACTS_SQL})) c on c.kind = t.entity_type and c.value = lower(t.text) group by 1),
hits as (select sender, ts, n, public from docs join mails on mails.doc_id = sender),
cut as (select *, case when ts - lag(ts) over w < interval 12 hour then 0 else 1 end as fresh from hits window w as (partition by sender order by ts)),
placed as (select *, sum(fresh) over (partition by sender order by ts rows unbounded preceding) as session from cut)
select sender, min(ts) as begin, max(ts) + interval 12 hour as "end", sum(n)::bigint as n, sum(public)::bigint as public from placed group by sender, session""",
)
def delivery_sessions(s: SparkSession, d: str) -> DataFrame:
    """Mail addresses and urls by session of a sender; every delivery comes twice."""
    events = corpus.table(s, d, "events").filter("event_type <> 'error'").select("event_id", F.col("user_id").alias("sender"), "ts")
    docs = events.join(grown(base.letters(s, d).select(F.col("doc_id").alias("sender"), "text")), "sender").withColumnRenamed("event_id", "doc_id")
    found = documents.once(docs.unionByName(docs), ["doc_id"])
    hits = documents.tier1.detect(found.withColumn("doc_id", F.struct("doc_id", "sender", "ts")), ("email", "url")).select("doc_id.sender", "doc_id.ts", "entity_type", "text")
    return documents.sessions(documents.with_public_values(hits, base.contacts(s, d)), "sender", "12 hours")


# --- refreshed decisions: the contact list loses every fifth entry's value and gains others ---------------------------------------
_AFTER = corpus.CONTACTS_SQL.replace("from supplier where", "from supplier where s_suppkey % 5 > 0 and").replace("as value from supplier union", "as value from supplier where s_suppkey % 5 > 0 union")
_BEFORE = _AFTER.replace("s_suppkey % 5 > 0", "s_suppkey % 7 > 0")


def _edited(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    before, after = corpus.derived(s, d, _BEFORE, "supplier"), corpus.derived(s, d, _AFTER, "supplier")
    spans = written(base.found(s, d), "spans")
    return spans, before, after, incremental.touched(incremental.evidence_index(spans), incremental.changed_contacts(before, after))


@query("refreshed_decisions", sql.status().replace(corpus.CONTACTS_SQL, _AFTER))
def refreshed_decisions(s: SparkSession, d: str) -> DataFrame:
    """Decisions by the list as it was, with those of touched documents made anew."""
    spans, before, after, docs = _edited(s, d)
    decide = lambda contacts: (lambda rows: classify.tier1_status(rows, None, contacts).select(*base._T1, "review_status"))
    return incremental.refreshed(decide(before)(spans), spans, docs, decide(after))


_KEYED = "case kind when 'postcode' then upper(replace(value, ' ', '')) when 'telefoon' then regexp_replace(value, '\\D', '', 'g') else lower(value) end"


@query(
    "touched_documents",
    f"""with changed as (
    (select kind, {_KEYED} as key from ({_BEFORE}) except select kind, {_KEYED} from ({_AFTER})) union (select kind, {_KEYED} from ({_AFTER}) except select kind, {_KEYED} from ({_BEFORE})))
select distinct doc_id from (select *, {sql._KEY} as key from ({sql.tier1()})) t join changed on changed.kind = t.entity_type and changed.key = t.key""",
)
def touched_documents(s: SparkSession, d: str) -> DataFrame:
    return _edited(s, d)[3]


# --- copies ---------------------------------------------------------------------------------------------------------------------
@query(
    "page_copies",
    """with h as (select conv_id as doc_id, turn as page, nullif(trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')), '') as norm from conversations),
g as (select norm, min((doc_id, page)) as f, count(*) as n from h where norm is not null group by 1)
select doc_id, page, sha256(h.norm) as hash, coalesce(f[1], doc_id) as first_doc, coalesce(f[2], page) as first_page, coalesce(n, 1) as copies from h left join g using (norm)""",
)
def page_copies(s: SparkSession, d: str) -> DataFrame:
    return dossiers.page_copies(corpus.table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text"))


@query("near_copies", None)
def near_copies(s: SparkSession, d: str) -> DataFrame:
    """Near copies among all documents; MinHash has no SQL of its own, so the tests hold it against exact pairs."""
    found = copies.near_copies(corpus.spread(corpus.table(s, d, "documents").select(F.col("doc_id").alias("key"), "text")))
    return found.select("key", "n_shingles", "class", F.round("similarity", 6).alias("similarity"))


# --- dossiers: orders are documents, their customer's orders a dossier, and orders of one clerk and day another -------------------
DECIDED = """select l_orderkey * 10 + l_linenumber as det_id, l_orderkey as doc_id, case when l_linenumber % 2 = 0 then 'persoon' else 'adres' end as entity_type,
    case when l_linenumber % 3 = 0 then 'naam ' else 'Naam  ' end || cast(max(l_partkey) % 40 as string) as text,
    case max(l_suppkey) % 5 when 0 then 'accepted' when 1 then 'rejected' when 2 then 'deferred' else 'pending' end as review_status,
    case when max(l_partkey) % 3 = 0 then '5.2' end as woo_article, case when max(l_suppkey) % 5 < 2 then max(l_shipdate) end as reviewed_at,
    case when max(l_partkey) % 11 = 0 then 'document' end as scope from lineitem group by l_orderkey, l_linenumber"""
DOSSIERS = "select 'c' || cast(o_custkey as string) as dossier_id, o_orderkey as doc_id from orders where o_orderkey % 3 > 0 union all select 'd' || cast(o_orderdate as string), o_orderkey from orders where o_orderkey % 4 = 0"


@query(
    "propagated_decisions",
    f"""with recursive det as (select *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as norm from ({DECIDED})),
dossier as ({DOSSIERS}),
node as (select distinct entity_type, norm, doc_id from det),
link as (select distinct entity_type, norm, dossier_id, doc_id from node join dossier using (doc_id)),
edge as (select distinct a.entity_type, a.norm, a.doc_id as u, b.doc_id as v from link a join link b using (entity_type, norm, dossier_id)),
reach(entity_type, norm, u, v) as (select entity_type, norm, doc_id, doc_id from node union select r.entity_type, r.norm, r.u, e.v from reach r join edge e on e.entity_type = r.entity_type and e.norm = r.norm and e.u = r.v),
grp as (select entity_type, norm, u as doc_id, min(v) as g from reach group by all),
placed as (select det.*, g from det join grp using (entity_type, norm, doc_id)),
latest as (select entity_type, norm, g, max((reviewed_at, det_id, review_status, woo_article)) as d from placed where review_status in ('accepted', 'rejected') and reviewed_at is not null and scope is null group by all),
mine as (select entity_type, norm, doc_id, max((reviewed_at, det_id, review_status, woo_article)) as d from placed where review_status in ('accepted', 'rejected') and reviewed_at is not null and scope = 'document' group by all),
given as (
    select p.*, case when review_status in ('pending', 'deferred') then coalesce(m.d, l.d) end as d from placed p
    left join latest l on l.entity_type = p.entity_type and l.norm = p.norm and l.g = p.g left join mine m on m.entity_type = p.entity_type and m.norm = p.norm and m.doc_id = p.doc_id)
select det_id, doc_id, coalesce(d[3], review_status) as review_status, coalesce(d[4], woo_article) as woo_article, cast(d[2] as varchar) as propagated_from from given""",
)
def propagated_decisions(s: SparkSession, d: str) -> DataFrame:
    rows, dossier = corpus.derived(s, d, DECIDED, "lineitem"), corpus.derived(s, d, DOSSIERS, "orders")
    return dossiers.propagate(rows, dossier).select("det_id", "doc_id", "review_status", "woo_article", F.col("propagated_from").cast("string").alias("propagated_from"))


@query("five_year_rule", "select o_orderkey as doc_id, o_orderdate < date '2000-01-01' as over_five_years from orders")
def five_year_rule(s: SparkSession, d: str) -> DataFrame:
    dated = corpus.table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("date").alias("document_date"))
    return dossiers.five_year_rule(dated, "2005-01-01").select("doc_id", "over_five_years")


# --- publication metadata --------------------------------------------------------------------------------------------------------
_RECORDS = """select cast(p_partkey as bigint) as doc_id, 'u-' || cast(p_partkey as string) as uuid, replace(p_name, ' ', '_') || '.pdf' as title, 'P-' || cast(p_partkey as string) as identifier, p_brand as author,
    case when p_partkey % 3 = 0 then 'Gemeente "' || p_brand || '"' end as responsible, '2024-01-0' || cast(1 + p_partkey % 9 as string) as created, p_partkey % 2 as acts, p_partkey % 4 as n,
    case when p_partkey % 5 = 0 then 'Over <' || p_brand || '> & ''anders''' end as description from part"""


def _e(column: str) -> str:
    return f"replace(replace(replace(replace(replace({column}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


_XML = f"""select doc_id, replace(replace('<?xml version="1.0" encoding="UTF-8"?>~<diwoo:Document xmlns:diwoo="https://standaarden.overheid.nl/diwoo/metadata/" xmlns:dcterms="http://purl.org/dc/terms/">~|<diwoo:DiWoo>~||<diwoo:classificatiecollectie>'
    || '~|||<diwoo:documentsoorten>~||||<diwoo:documentsoort>besluit</diwoo:documentsoort>~|||</diwoo:documentsoorten>~|||<diwoo:informatiecategorieen>'
    || array_to_string(list_transform(range(1, n + 1), lambda k: '~||||<diwoo:informatiecategorie resource="https://x/' || k || '">Soort &amp; ' || k || '</diwoo:informatiecategorie>'), '')
    || '~|||</diwoo:informatiecategorieen>~|||<diwoo:themas>~||||<diwoo:thema>' || case when n > 0 then 'Soort &amp; 1' else 'overig' end || '</diwoo:thema>~|||</diwoo:themas>~|||<diwoo:trefwoorden>~||||<diwoo:trefwoord>'
    || coalesce(list_filter(string_split(lower(replace(regexp_replace(title, '\\.pdf$', ''), '_', ' ')), ' '), lambda w: length(w) >= 4)[1], string_split(lower(replace(regexp_replace(title, '\\.pdf$', ''), '_', ' ')), ' ')[1])
    || '</diwoo:trefwoord>~|||</diwoo:trefwoorden>~||</diwoo:classificatiecollectie>~||<diwoo:creatiedatum>' || created || '</diwoo:creatiedatum>'
    || case when acts = 1 then '~||<diwoo:documenthandelingen>~|||<diwoo:documenthandeling>~||||<diwoo:soortHandeling>anonimiseren</diwoo:soortHandeling>~||||<diwoo:atTime>' || created || 'T10:00:00Z</diwoo:atTime>~|||</diwoo:documenthandeling>~||</diwoo:documenthandelingen>' else '' end
    || '~||<diwoo:format>application/pdf</diwoo:format>~||<diwoo:geldigheid>~|||<diwoo:begindatum>' || created || '</diwoo:begindatum>~||</diwoo:geldigheid>~||<diwoo:identifiers>~|||<diwoo:identifier>' || identifier
    || '</diwoo:identifier>~|||<diwoo:identifier>urn:uuid:' || uuid || '</diwoo:identifier>~||</diwoo:identifiers>~||<diwoo:language>nld</diwoo:language>'
    || coalesce('~||<diwoo:omschrijvingen>~|||<diwoo:omschrijving>' || {_e('description')} || '</diwoo:omschrijving>~||</diwoo:omschrijvingen>', '')
    || '~||<diwoo:opsteller>' || author || '</diwoo:opsteller>~||<diwoo:publisher>' || coalesce({_e('responsible')}, author) || '</diwoo:publisher>~||<diwoo:verantwoordelijke>' || coalesce({_e('responsible')}, author)
    || '</diwoo:verantwoordelijke>~||<diwoo:titelcollectie>~|||<diwoo:officieleTitel>' || title || '</diwoo:officieleTitel>~||</diwoo:titelcollectie>~|</diwoo:DiWoo>~</diwoo:Document>~', '~', chr(10)), '|', chr(9)) as xml from ({_RECORDS})"""


@query("publication_xml", _XML)
def publication_xml(s: SparkSession, d: str) -> DataFrame:
    rows = corpus.derived(s, d, _RECORDS, "part")
    category = lambda k: F.struct(F.concat(F.lit("https://x/"), k.cast("string")).alias("uri"), F.concat(F.lit("Soort & "), k.cast("string")).alias("label"))
    categories = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), category))
    actions = F.when(F.col("acts") == 1, F.array(F.struct(F.lit("anonimiseren").alias("type"), F.concat("created", F.lit("T10:00:00Z")).alias("at"))))
    return metadata.publication_xml(rows.withColumns({"categories": categories, "actions": actions, "format": F.lit("application/pdf"), "language": F.lit("nld")}))
