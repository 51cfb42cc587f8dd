"""The registered queries: for each name a Spark plan and, where SQL can say it, DuckDB's answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.operators import classify, custom, locate, reports, review, structure, tier1, tier2
from inkveil.operators.groups import written
from inkveil.plans import sql
from inkveil.sources import corpus, readers

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_T1 = ("doc_id", "entity_type", "tier", "text", "start_char", "end_char", "confidence", "woo_article", "source")
_T2 = ("doc_id", "entity_type", "text", "start_char", "end_char", "confidence", "source")
FIRST, LAST = tuple(corpus._FIRST.lower().split(",")), tuple(corpus._LAST.lower().split(","))


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return add


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.dutch_letters(spark, sf_dir)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.spread(corpus.table(spark, sf_dir, "documents").select("doc_id", "text"))


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.derived(spark, sf_dir, corpus.CONTACTS_SQL, "supplier")


def officials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.derived(spark, sf_dir, corpus.OFFICIALS_SQL, "nation")


def titles(spark: SparkSession) -> DataFrame:
    return spark.sql(corpus.TITLES_SQL)


def reference_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.derived(spark, sf_dir, sql.NAMES_SQL, "customer")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tier1.detect(letters(spark, sf_dir), as_of=sql.AS_OF, before=30)


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier-1 detections of the letters with their review status."""
    return classify.tier1_status(written(found(spark, sf_dir), "spans"), None, contacts(spark, sf_dir)).select(*_T1, "review_status")


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tier2.rule_rows(letters(spark, sf_dir), "initials", context=True)


# --- tier 1 -------------------------------------------------------------------------------------------------------------
for _kind in tier1.ORDER:
    query(f"t1_{_kind}", sql.tier1((_kind,)))(lambda s, d, kind=_kind: tier1.detect(letters(s, d), (kind,), sql.AS_OF).select(*_T1))
query("t1_all_dedup", sql.tier1())(lambda s, d: found(s, d).select(*_T1))
_DOCS = "(select doc_id, text from documents)"
_URLS = "(select page_id as doc_id, url as text from pages)"
query("documents_email", sql.tier1(("email",), _DOCS))(lambda s, d: tier1.detect(texts(s, d), ("email",)).select(*_T1))
query("documents_card", sql.tier1(("creditcard",), _DOCS))(lambda s, d: tier1.detect(texts(s, d), ("creditcard",)).select(*_T1))
query("pages_url", sql.tier1(("url",), _URLS))(lambda s, d: tier1.detect(corpus.table(s, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("text")), ("url",)).select(*_T1))
query("status_tier1", sql.status())(decided)
query("t1_counts", f"select entity_type, count(*) as n from ({sql.tier1()}) group by 1")(lambda s, d: found(s, d).groupBy("entity_type").agg(F.count("*").alias("n")))
query("documents_identifiers", sql.tier1(source=_DOCS))(lambda s, d: tier1.detect(texts(s, d), as_of=sql.AS_OF).select(*_T1))

# --- tier 2 -------------------------------------------------------------------------------------------------------------
for _rule, _name, _sql in (("street", "t2_street", sql.street()), ("house_number", "t2_housenumber", sql.house_number()), ("reference", "t2_reference", sql.reference()), ("initials", "t2_initials", sql.initials()), ("title", "t2_title", sql.titles()), ("organisation", "t2_organisation", sql.organisations())):
    query(_name, _sql)(lambda s, d, rule=_rule: tier2.rule_rows(letters(s, d), rule).select(*_T2))
query("t2_dates", sql.dates())(lambda s, d: letters(s, d).select("doc_id", F.replace("text", F.lit("Geboortedatum: "), F.lit("Geboren op ")).alias("text")).select("doc_id", F.inline(tier2.dates(F.col("text"), F.lit(sql.AS_OF).cast("date")))))
query("t2_all")(lambda s, d: tier2.detect(letters(s, d), FIRST, LAST, sql.AS_OF).select(*_T1))


def _small_tier2(s: SparkSession, d: str) -> DataFrame:
    """References and streets, and postcodes once more as contextual rows, so that the exact-offset and equal-text rules meet."""
    base = tier2.rule_rows(letters(s, d), "reference").unionByName(tier2.rule_rows(letters(s, d), "street"))
    again = tier1.detect(letters(s, d), ("postcode",)).select("doc_id", F.lit("adres").alias("entity_type"), "text", F.when(F.col("start_char") % 2 == 0, F.col("start_char")).otherwise(F.col("start_char") + 1).alias("start_char"), F.when(F.col("start_char") % 2 == 0, F.col("end_char")).otherwise(F.col("end_char") + 1).alias("end_char"), F.lit(0.75).alias("confidence"), F.lit("ner").alias("source"))
    return base.unionByName(again).withColumn("tier", F.lit("2")).withColumn("woo_article", F.lit("5.1.2e"))


_SMALL = f"select * from ({sql.reference()}) union all select * from ({sql.street()}) union all select doc_id, 'adres', text, start_char + start_char % 2, end_char + start_char % 2, cast(0.75 as double), 'ner' from ({sql.tier1(('postcode',))})"
query("detect_all_boost", f"""with t1 as ({sql.tier1()}), t2 as ({_SMALL})
    select * from t1 union all select doc_id, entity_type, '2', text, start_char, end_char, case when exists (select 1 from t1 where t1.doc_id = t2.doc_id and lower(t1.text) = lower(t2.text)) then least(1.0, round(confidence + 0.10, 2)) else confidence end, '5.1.2e', source
    from t2 where not exists (select 1 from t1 where t1.doc_id = t2.doc_id and t1.start_char = t2.start_char and t1.end_char = t2.end_char)""")(lambda s, d: tier2.detect_all(written(found(s, d).select(*_T1), "spans"), _small_tier2(s, d).select(*_T1)))  # fmt: skip
query("detect_all")(lambda s, d: tier2.detect_both(letters(s, d), FIRST, LAST, sql.AS_OF).select(*_T1))

# --- structure and documents -----------------------------------------------------------------------------------------------
query("structure_lines", f"select doc_id, i, line, start_char, end_char from {sql.LINES}")(lambda s, d: structure.line_rows(letters(s, d)))
query("salutations", sql.salutations())(lambda s, d: structure.detect(letters(s, d), ("salutation",)))
query("header_blocks", sql.headers())(lambda s, d: structure.detect(letters(s, d), ("email_header",)))
query("signature_blocks", sql.signatures())(lambda s, d: structure.detect(letters(s, d), ("signature_block",)))
query("structure_counts", f"select kind, count(*) as n from ({sql.structures()}) group by 1")(lambda s, d: structure.detect(letters(s, d)).groupBy("kind").agg(F.count("*").alias("n")))
query("environmental_docs", f"select doc_id, regexp_matches(text, '(?i)\\b(?:{'|'.join(sql.V.ENVIRONMENT)})\\b') as environmental from {sql.LETTERS}")(lambda s, d: structure.environmental(letters(s, d)))
_PAGES = f"(select doc_id, cast(i as integer) as page, p[i + 1] as text from (select doc_id, p, unnest(range(0, len(p))) as i from (select doc_id, string_split(text, chr(10) || chr(10)) as p from {sql.LETTERS})))"


def letter_pages(s: SparkSession, d: str) -> DataFrame:
    return letters(s, d).select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("page", "text"))


def marked_pages(s: SparkSession, d: str) -> DataFrame:
    """Pages whose one date is the document's own (labelled), a plain one, or a birth date, by doc_id; in four forms, without leading zeros."""
    label = F.when(F.col("doc_id") % 3 == 0, "Datum: ").when(F.col("doc_id") % 3 == 1, "Gezien op ").otherwise("Geboren op ")
    born = r"Geboortedatum: 0?(\d+)-0?(\d+)-(\d+)"
    day, month, year = (F.regexp_extract("text", born, k) for k in (1, 2, 3))
    name = F.get(F.array(*[F.lit(m) for m in sql.V.MONTH_NAMES]), month.try_cast("int") - 1)
    form = F.col("doc_id") % 4
    date = F.when(form == 0, F.concat(day, F.lit("-"), month, F.lit("-"), year)).when(form == 1, F.concat(day, F.lit("/"), month, F.lit("/"), year)).when(form == 2, F.concat(year, F.lit("-"), month, F.lit("-"), day)).otherwise(F.concat_ws(" ", day, name, year))
    return letter_pages(s, d).withColumn("text", F.regexp_replace(F.col("text"), F.lit(born), F.concat(label, date)))


_DATED = f"(select doc_id, page, list_max(list_filter(list_transform(regexp_extract_all(text, '\\b\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}\\b'), lambda x: try_cast(split_part(x, '-', 3) || '-' || split_part(x, '-', 2) || '-' || split_part(x, '-', 1) as date)), lambda x: x is not null)) as dt from {_PAGES})"
query("document_date", f"select doc_id, cast(min_by(dt, page) filter (where dt is not null and doc_id % 3 <> 2) as varchar) as document_date from {_DATED} group by doc_id")(lambda s, d: structure.document_dates(marked_pages(s, d), sql.AS_OF).withColumn("document_date", F.col("document_date").cast("string")))
query("assemble_pages", "select conv_id as doc_id, string_agg(text, chr(10) || chr(10) order by turn, text) as text, count(*) as n_pages from conversations group by 1")(lambda s, d: structure.assemble(corpus.table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")))

# --- evidence and decisions ----------------------------------------------------------------------------------------------
query("reference_match", sql.reference_match())(lambda s, d: classify.reference_matches(persons(s, d), reference_names(s, d)).select("doc_id", "start_char", "end_char", "text"))
query("officials_match", sql.officials_match())(lambda s, d: classify.official_matches(persons(s, d), letters(s, d), officials(s, d)))
query("role_match", sql.role_match())(lambda s, d: classify.title_matches(persons(s, d), letters(s, d), titles(s)))
query("classify_persons", sql.classify())(lambda s, d: classify.classify_persons(persons(s, d), letters(s, d), reference_names(s, d), officials(s, d), titles(s), structure.detect(letters(s, d))))
query("other_status", f"select doc_id, entity_type, '2' as tier, text, start_char, end_char, confidence, source, case when pub then 'rejected' else 'pending' end as review_status, case when not pub then '5.1.2e' end as woo_article from (select *, entity_type = 'adres' and lower(text) in (select lower(value) from ({corpus.CONTACTS_SQL}) where kind = 'adres') as pub from ({_SMALL}))")(lambda s, d: classify.other_status(written(_small_tier2(s, d), "spans"), letters(s, d), contacts(s, d)))


# --- reviewers' terms and search --------------------------------------------------------------------------------------------
def terms(s: SparkSession, d: str) -> DataFrame:
    own = letters(s, d).select("doc_id")
    return own.select("doc_id", F.inline(F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(t).alias("term")) for o, t in enumerate(("stikstof", "Uw  Kenmerk", "sprak met"))])))


query("custom_terms", sql.terms())(lambda s, d: custom.term_matches(letters(s, d), terms(s, d)))


def merged_terms(s: SparkSession, d: str) -> DataFrame:
    """The terms, one more that lies within mail addresses and has a ground of its own, and one of a mode that is not supported."""
    rows = [(o, t, None, None) for o, t in enumerate(("stikstof", "Uw  Kenmerk", "sprak met"))] + [(3, "@voorbeeld", "exact", "5.2"), (4, "Mijn", "fuzzy", None)]
    own = F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(t).alias("term"), F.lit(m).cast("string").alias("match_mode"), F.lit(g).cast("string").alias("woo_article")) for o, t, m, g in rows])
    return letters(s, d).select("doc_id", F.inline(own))


_FRESH = f"(select doc_id, text, start_char, end_char, 'accepted' as review_status, 'custom_wordlist' as source, cast(0.99 as double) as confidence, '5.1.2e' as woo_article, 1 as late, ord from ({sql.terms()}))"
_HELD = f"(select doc_id, text, start_char, end_char, case when entity_type = 'email' then 'accepted' else review_status end as review_status, case when entity_type = 'email' then 'custom_wordlist' else source end as source, confidence, case when entity_type = 'email' then '5.2' else woo_article end as woo_article, 0 as late, 0 as ord from ({sql.status()}))"
query("custom_merge", f"select doc_id, cast(row_number() over (partition by doc_id order by late, ord, start_char, end_char) - 1 as integer) as pos, text, start_char, end_char, review_status, source, confidence, woo_article from (select * from {_HELD} union all select * from {_FRESH})")(
    lambda s, d: custom.merge_terms(decided(s, d), custom.term_matches(letters(s, d), merged_terms(s, d)))
)
query("search_hits", sql.search("the"))(lambda s, d: custom.search(corpus.table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text"), "The"))

# --- places -----------------------------------------------------------------------------------------------------------------
_ITEMS = "select l_orderkey as doc_id, cast(0 as int) as page, l_linenumber as ord, 'w' || cast(max(l_partkey) as string) as text, cast(l_linenumber * 10 as double) as x0, cast(case when l_linenumber < 4 then 0 else 12 end as double) as y0, cast(l_linenumber * 10 + 10 - max(l_partkey) % 4 as double) as x1, cast(case when l_linenumber < 4 then 10 else 22 end as double) as y1 from lineitem group by l_orderkey, l_linenumber"


def items(s: SparkSession, d: str) -> DataFrame:
    return corpus.derived(s, d, _ITEMS, "lineitem")


_GLUE = "case when abs(y0 - lag(y0) over w) < 2 and x0 - lag(x1) over w between -1.5 and 1.5 then '' else ' ' end"
query("join_items", f"select doc_id, page, ltrim(string_agg(glue || text, '' order by ord)) as text from (select *, {_GLUE} as glue from ({_ITEMS}) window w as (partition by doc_id, page order by ord)) group by 1, 2")(lambda s, d: locate.join_items(items(s, d)))
query("item_offsets", f"select doc_id, page, ord, text, cast(coalesce(sum(length(text) + 1) over (partition by doc_id, page order by ord rows between unbounded preceding and 1 preceding), 0) as integer) as start_char from ({_ITEMS})")(lambda s, d: locate.item_offsets(items(s, d)).select("doc_id", "page", "ord", "text", "start_char"))
_PLACED = f"(select *, coalesce(sum(length(text) + 1) over (partition by doc_id, page order by ord rows between unbounded preceding and 1 preceding), 0) as s from ({_ITEMS}))"
_CUT = f"(select doc_id, page, y0, y1, x0 + greatest(2 - s, 0) * (x1 - x0) / length(text) as x0, x1 - greatest(s + length(text) - 12, 0) * (x1 - x0) / length(text) as x1 from {_PLACED} where s < 12 and s + length(text) > 2)"
query("boxes_of_spans", f"select doc_id, round(min(x0), 6) as x0, y0, round(max(x1), 6) as x1, max(y1) as y1 from {_CUT} group by doc_id, page, y0")(
    lambda s, d: locate.boxes_of_spans(items(s, d).select("doc_id", "page").distinct().select("doc_id", "page", F.lit(2).alias("start_char"), F.lit(12).alias("end_char")), items(s, d)).select("doc_id", F.inline("boxes")).select("doc_id", F.round("x0", 6).alias("x0"), "y0", F.round("x1", 6).alias("x1"), "y1")
)
query("merge_boxes", f"with f as (select *, case when y0 - lag(y0) over w > 2 or lag(y0) over w is null then 1 else 0 end as fresh from ({_ITEMS}) window w as (partition by doc_id, page order by y0, x0)), l as (select *, sum(fresh) over (partition by doc_id, page order by y0, x0 rows unbounded preceding) as line from f) select doc_id as group_id, page, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from l group by doc_id, page, line")(lambda s, d: locate.merge_line_boxes(items(s, d).withColumnRenamed("doc_id", "group_id")))
query("text_of_boxes", f"select doc_id as box_id, string_agg(text, ' ' order by y0, x0, text) as text from ({_ITEMS}) where (y0 + y1) / 2 between 0 and 10 and x0 < 27 and x1 > 13 group by 1")(lambda s, d: locate.text_of_boxes(items(s, d).select("doc_id", "page").distinct().select("doc_id", "page", F.col("doc_id").alias("box_id"), F.lit(15.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(25.0).alias("x1"), F.lit(10.0).alias("y1")), items(s, d)))
query("split_boxes", f"select doc_id, ord, least(greatest(cast(25 as double), x0 + 2), x1 - 2) as at from ({_ITEMS})")(lambda s, d: items(s, d).select("doc_id", "ord", locate.split_box(F.struct("page", "x0", "y0", "x1", "y1"), F.lit(25.0))[0]["x1"].alias("at")))


# --- review ------------------------------------------------------------------------------------------------------------------
def events(s: SparkSession, d: str) -> DataFrame:
    return corpus.derived(s, d, corpus.EVENTS_SQL, "events")


query("undo_state", f"select det_id, coalesce(arg_max(status, seq) filter (where not undone), 'pending') as status, count(*) as n_events from {sql.EVENTS} group by 1")(lambda s, d: review.states(events(s, d)))
query("undo_last", f"with b as (select *, row_number() over (partition by det_id, undone order by seq desc) as back from {sql.EVENTS}), u as (select det_id, seq, status, undone or back <= 2 as undone from b) select det_id, coalesce(arg_max(status, seq) filter (where not undone), 'pending') as status, count(*) as n_events from u group by 1")(lambda s, d: review.states(review.undo_last(events(s, d), 2)))
_BLOCK = f"(select doc_id, start_char, end_char from ({sql.structures()}) where kind <> 'salutation')"
_PENDING = f"(select * replace ('pending' as review_status) from ({sql.classify()}))"


def pending(s: SparkSession, d: str) -> DataFrame:
    return persons(s, d).withColumn("review_status", F.lit("pending"))


query("sweep_block", f"select p.doc_id, p.start_char, p.end_char, p.text, case when exists (select 1 from {_BLOCK} b where b.doc_id = p.doc_id and b.start_char <= p.start_char and p.end_char <= b.end_char) then 'accepted' else 'pending' end as review_status from ({sql.initials()}) p")(lambda s, d: review.sweep_block(pending(s, d).drop("before", "after"), structure.detect(letters(s, d), ("email_header", "signature_block"))).select("doc_id", "start_char", "end_char", "text", "review_status"))
query("same_name_sweep", f"select p.doc_id, p.start_char, p.end_char, p.text, case when exists (select 1 from ({sql.NAMES_SQL}) n where n.doc_id = p.doc_id and lower(n.name) = lower(regexp_replace(p.text, '\\s+', ' ', 'g'))) then 'accepted' else 'pending' end as review_status from ({sql.initials()}) p")(lambda s, d: review.sweep_name(pending(s, d).drop("before", "after"), reference_names(s, d).select("doc_id", F.lit("persoon").alias("entity_type"), F.col("name").alias("text"))).select("doc_id", "start_char", "end_char", "text", "review_status"))
query("same_name_counts", f"select doc_id, start_char, count(*) over (partition by doc_id, lower(regexp_replace(text, '\\s+', ' ', 'g'))) as same_name from ({sql.initials()})")(lambda s, d: review.same_name_counts(persons(s, d)).select("doc_id", "start_char", "same_name"))
query("split_rows", f"select doc_id, entity_type, substr(text, s - start_char + 1, e - s) as text, cast(s as integer) as start_char, cast(e as integer) as end_char, confidence, 'manual' as source, doc_id || '-' || start_char || side as det_id, doc_id || '-' || start_char as split_from from (select *, start_char as s, start_char + 2 as e, 'a' as side from ({sql.initials()}) union all select *, start_char + 2, end_char, 'b' from ({sql.initials()}))")(lambda s, d: review.split(persons(s, d).drop("before", "after").withColumn("det_id", F.concat_ws("-", "doc_id", "start_char")), persons(s, d).select(F.concat_ws("-", "doc_id", "start_char").alias("det_id"), (F.col("start_char") + 2).alias("at"))))
query("merge_rows", f"with p as (select *, row_number() over (partition by doc_id order by start_char) as click from ({sql.initials()})) select doc_id as merge_id, string_agg(text, ' ' order by click) as text, count(*) as n from p group by 1 having count(*) > 1")(lambda s, d: review.merge(persons(s, d).withColumn("det_id", F.concat_ws("-", "doc_id", "start_char")).withColumn("woo_article", F.lit("5.1.2e")), persons(s, d).select(F.col("doc_id").alias("merge_id"), F.concat_ws("-", "doc_id", "start_char").alias("det_id"), F.col("start_char").alias("click"))).select("merge_id", "text", F.size("merged_from").cast("long").alias("n")))
query("page_states", f"select coalesce(r.status, 'unreviewed') as status, count(*) as n from {_PAGES} p left join (select det_id as doc_id, 0 as page, arg_max(status, seq) as status from {sql.EVENTS} group by 1) r on p.doc_id = r.doc_id and p.page = r.page group by 1")(lambda s, d: review.page_states(letter_pages(s, d), events(s, d).groupBy(F.col("det_id").alias("doc_id")).agg(F.max_by("status", "seq").alias("status")).withColumn("page", F.lit(0))))

# --- reports --------------------------------------------------------------------------------------------------------------------
_D = f"({sql.status()})"
_SHOWN = "review_status in ('accepted', 'auto_accepted')"
_LABEL = "case entity_type " + " ".join(f"when '{k}' then '{v}'" for k, v in reports.LABELS.items()) + " else entity_type end"
query("log_stats_sets", f"with d as (select * from {_D}) select 'tier' as dimension, tier as value, count(*) as n from d group by tier union all select 'status', review_status, count(*) from d group by review_status union all select 'type', entity_type, count(*) from d group by entity_type union all select 'total', 'all', count(*) from d")(lambda s, d: reports.counts(decided(s, d)))
query("status_breakdown", f"select count(*) filter (where review_status in ('accepted', 'auto_accepted', 'edited')) as reviewable, count(*) filter (where review_status = 'rejected') as rejected, count(*) filter (where review_status = 'pending') as pending, count(*) filter (where review_status = 'deferred') as deferred, count(*) filter (where review_status not in ('pending', 'deferred')) as reviewed, count(*) filter (where review_status = 'pending' and tier = '2' and confidence >= 0.85) as high_pending from {_D}")(lambda s, d: reports.breakdown(decided(s, d)))
query("report_summary", f"with d as (select * from {_D} where {_SHOWN}) select 'ground' as dimension, woo_article as value, count(*) as n from d where woo_article <> '' group by 2 union all select 'tier', t.t, count(d.doc_id) from (values ('1'), ('2'), ('3')) t(t) left join d on d.tier = t.t group by 2 union all select 'source', case when source in ('manual', 'search_redact') then 'handmatig' else 'auto' end, count(*) from d group by 2 union all select 'label', {_LABEL}, count(*) from d group by 2")(lambda s, d: reports.summary(decided(s, d)))
query("grounds", f"select doc_id, nullif(coalesce(array_to_string(list_sort(list(distinct woo_article) filter (where {_SHOWN} and woo_article is not null)), ', '), ''), '') as grounds from {_D} group by 1")(lambda s, d: reports.grounds(decided(s, d)))
query("log_filter_sort", f"select doc_id, entity_type, text, start_char, end_char, review_status, row_number() over (partition by doc_id order by start_char, end_char, entity_type) as nr from {_D} where review_status = 'rejected' and coalesce(source, 'regex') = 'whitelist_gemeente'")(lambda s, d: reports.numbered(reports.filtered(decided(s, d), status="rejected", source="whitelist_gemeente")).select("doc_id", "entity_type", "text", "start_char", "end_char", "review_status", "nr"))
query("redaction_log_csv", f"select doc_id, nr, nr || ',' || {_LABEL} || ',' || coalesce(woo_article, '') || ',' || tier || ',auto,' || text as line from (select *, row_number() over (partition by doc_id order by start_char, end_char, entity_type) as nr from {_D} where {_SHOWN})")(lambda s, d: reports.csv_lines(decided(s, d)))
_COUNTED = "'{' || string_agg('\"' || {0} || '\":' || n, ',' order by {0}) || '}' from (select doc_id, {0}, count(*) as n from d group by 1, 2) group by 1"
_JSON_ROWS = """'{"start_char":' || start_char || ',"end_char":' || end_char || ',"entity_type":"' || entity_type || '","tier":"' || tier || '","review_status":"' || review_status || '"}'"""
query("json_documents", f"""with d as (select * from {_D}), t as (select doc_id, {_COUNTED.replace('{0}', 'tier')}), s as (select doc_id, {_COUNTED.replace('{0}', 'review_status')}),
    r as (select doc_id, count(*) as total, string_agg({_JSON_ROWS}, ',' order by start_char, end_char, entity_type, tier, review_status) as rows from d group by 1)
    select r.doc_id, '{{"total":' || total || ',"by_tier":' || t.j || ',"by_status":' || s.j || ',"detections":[' || rows || ']}}' as json from r join t on t.doc_id = r.doc_id join s on s.doc_id = r.doc_id""".replace(" from (select doc_id, tier", " as j from (select doc_id, tier").replace(" from (select doc_id, review_status", " as j from (select doc_id, review_status"))(lambda s, d: reports.json_documents(decided(s, d)))
query("xml_documents", "select cast(p_partkey as bigint) as doc_id, '<document><title>' || p_name || '</title><creator>' || p_brand || '</creator>' || coalesce('<keyword>' || list_filter(string_split_regex(p_name, '\\s+'), lambda w: length(w) >= 4)[1] || '</keyword>', '') || '</document>' as xml from part")(lambda s, d: reports.xml_documents(corpus.table(s, d, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("creator"))))
query("redact_text", f"with r as (select distinct doc_id, start_char, end_char from {_D} where {_SHOWN}), c as (select doc_id, text, unnest(range(1, length(text) + 1)) as p from {sql.LETTERS}) select c.doc_id, string_agg(case when h.p is null then substr(c.text, c.p, 1) else '█' end, '' order by c.p) as text, coalesce(any_value(n.n), 0) as n from c left join (select distinct doc_id, unnest(range(start_char + 1, end_char + 1)) as p from r) h on h.doc_id = c.doc_id and h.p = c.p left join (select doc_id, count(*) as n from r group by 1) n on n.doc_id = c.doc_id group by c.doc_id")(lambda s, d: reports.redact(letters(s, d), decided(s, d)))
query("detection_buckets", f"select case when n >= 100 then '>=100' when n >= 50 then '>=50' when n >= 10 then '>=10' when n >= 0 then '>=0' end as bucket, count(*) as n from (select doc_id, count(*) as n from {_D} group by 1) group by 1")(lambda s, d: reports.buckets(decided(s, d).groupBy("doc_id").agg(F.count("*").alias("k")), "k"))
query("confidence_levels", f"select case when confidence >= 0.85 then 'high' when confidence >= 0.6 then 'medium' else 'low' end as level, count(*) as n from {_D} group by 1")(lambda s, d: decided(s, d).groupBy(reports.level(F.col("confidence")).alias("level")).agg(F.count("*").alias("n")))


# --- further parts ----------------------------------------------------------------------------------------------------------
_LINKS = "(select page_id, i, m[i] as link from (select page_id, m, unnest(range(1, len(m) + 1)) as i from (select page_id, regexp_extract_all(html, '(?s)<a\\s+href=\"[^\"]+\"[^>]*>[^<]*</a>') as m from pages)))"
query("html_concepts", f"select uri, min_by(label, (page_id, i)) as label from (select page_id, i, regexp_extract(link, 'href=\"([^\"]+)\"', 1) as uri, regexp_extract(link, '>([^<]*)<', 1) as label from {_LINKS}) group by 1")(lambda s, d: readers.concepts(corpus.table(s, d, "pages")))
query("list_changes", "select *, 'added' as change from (select c_name, c_acctbal from customer where c_custkey % 3 <> 0 except all select c_name, c_acctbal from customer where c_custkey % 3 <> 1) union all select *, 'removed' from (select c_name, c_acctbal from customer where c_custkey % 3 <> 1 except all select c_name, c_acctbal from customer where c_custkey % 3 <> 0)")(lambda s, d: readers.changed(corpus.table(s, d, "customer").filter("c_custkey % 3 <> 1").select("c_name", "c_acctbal"), corpus.table(s, d, "customer").filter("c_custkey % 3 <> 0").select("c_name", "c_acctbal")))
query("session_patch", "select coalesce(o.c_custkey, n.k) as doc_id, coalesce(n.name, o.c_name) as name, coalesce(n.seg, o.c_mktsegment) as segment from customer o full join (select c_custkey + 5 as k, case when c_custkey % 2 = 0 then c_name end as name, case when c_custkey % 3 = 0 then c_mktsegment end as seg from customer) n on o.c_custkey = n.k")(lambda s, d: readers.patched(corpus.table(s, d, "customer").selectExpr("c_custkey as doc_id", "c_name as name", "c_mktsegment as segment"), corpus.table(s, d, "customer").selectExpr("c_custkey + 5 as doc_id", "case when c_custkey % 2 = 0 then c_name end as name", "case when c_custkey % 3 = 0 then c_mktsegment end as segment")))
query("neighbours", f"select doc_id, start_char, end_char, coalesce(lag(start_char) over w, -1) as before, coalesce(lead(start_char) over w, -1) as after from ({sql.initials()}) window w as (partition by doc_id order by start_char, end_char)")(lambda s, d: review.neighbours(persons(s, d).drop("before", "after").withColumn("det_id", F.col("start_char"))).select("doc_id", "start_char", "end_char", F.coalesce("before", F.lit(-1)).alias("before"), F.coalesce("after", F.lit(-1)).alias("after")))
query("recent_values", "select user_id, event_type as value, place from (select user_id, event_type, row_number() over (partition by user_id order by max(event_id) desc) as place from events group by 1, 2) where place <= 3")(lambda s, d: review.recent(corpus.table(s, d, "events").selectExpr("user_id", "event_type as value", "event_id as seq"), 3))
query("block_groups", f"with i as (select p.doc_id, p.start_char as s, p.end_char as e, b.kind, b.start_char, b.end_char, row_number() over (partition by p.doc_id, p.start_char, p.end_char order by b.end_char - b.start_char, b.start_char, b.end_char, b.kind) as r from ({sql.initials()}) p join ({sql.structures()}) b on b.doc_id = p.doc_id and b.start_char <= p.start_char and p.end_char <= b.end_char) select doc_id, kind, start_char, end_char, count(*) as n, count(*) as pending from i where r = 1 group by 1, 2, 3, 4")(lambda s, d: review.block_groups(pending(s, d), structure.detect(letters(s, d))))
query("weighed", "select user_id as det_id, bool_and(event_type <> 'error' or value > 10) as complete from events group by 1")(lambda s, d: review.weighed(corpus.table(s, d, "events").selectExpr("user_id as det_id", "event_type = 'error' as required", "value > 10 as checked")))
query("missing_fields", "select page_id as doc_id, nullif(concat_ws(', ', case when regexp_extract(html, '<title>([^<]*)', 1) = '' then 'title' end, case when trim(coalesce(url, '')) = '' then 'url' end, case when regexp_extract(url, '#(.+)', 1) = '' then 'anchor' end), '') as missing from pages")(lambda s, d: reports.missing_fields(corpus.table(s, d, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), "url", F.regexp_extract("url", "#(.+)", 1).alias("anchor")), ("title", "url", "anchor")))
query("export_names", "select page_id, 'gelakt_' || case when b = '' then 'document' else left(b, 100) end as name from (select page_id, regexp_replace(string_split_regex(url, '[/\\\\]')[-1], '[^A-Za-z0-9._-]+', '_', 'g') as b from pages)")(lambda s, d: corpus.table(s, d, "pages").select("page_id", reports.export_name(F.col("url")).alias("name")))
query("per_period", "select coalesce(cast(year(ts) as varchar), 'all') as year, coalesce(cast(month(ts) as varchar), 'all') as month, coalesce(event_type, 'all') as status, count(*) as n from events group by rollup (year(ts), month(ts), event_type)")(lambda s, d: reports.per_period(corpus.table(s, d, "events").select("ts", F.col("event_type").alias("status"))).select(*[F.coalesce(F.col(c).cast("string"), F.lit("all")).alias(c) for c in ("year", "month", "status")], "n"))
_TOKENS = "list_filter(list_transform(string_split_regex(trim(text), '\\s+'), lambda t: lower(regexp_replace(t, '^\\W+|\\W+$', '', 'g'))), lambda t: t <> '' and t not in ('van', 'de', 'der', 'den', 'ter', 'ten', 'te'))"
query("name_scores", f"""select doc_id, text, first, last, first or last as plausible from (select doc_id, text, list_contains({list(FIRST)}, t[1]) as first, len(list_filter(case when list_contains({list(FIRST)}, t[1]) then t[2:] else t end, lambda x: x in ({str(list(LAST))[1:-1]}))) > 0 as last
    from (select doc_id, text, {_TOKENS} as t from ({sql.initials()})))""")(lambda s, d: persons(s, d).select("doc_id", "text", tier2.score_name(F.col("text"), FIRST, LAST).alias("score")).select("doc_id", "text", "score.*"))
query("covered_boxes", f"select a.doc_id, a.ord, max(case when least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0 and least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0 and (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) >= 0.5 * (a.x1 - a.x0) * (a.y1 - a.y0) then 1 else 0 end) = 1 as covered from ({_ITEMS}) a join (select doc_id, page, x0 - 4 as x0, x1 - 4 as x1, y0, y1 from ({_ITEMS}) where ord % 2 = 0) b on a.doc_id = b.doc_id and a.page = b.page group by 1, 2")(lambda s, d: _covered(s, d))


def _covered(s: SparkSession, d: str) -> DataFrame:
    box = lambda shift: F.struct("page", (F.col("x0") - shift).alias("x0"), "y0", (F.col("x1") - shift).alias("x1"), "y1")
    boxes = items(s, d).filter("ord % 2 = 0").groupBy("doc_id").agg(F.collect_list(box(4)).alias("boxes"))
    return items(s, d).join(boxes, "doc_id").select("doc_id", "ord", locate.covered(box(0), F.col("boxes")).alias("covered"))


def _others() -> dict[str, tuple[Query, str | None]]:
    from inkveil.plans import more, places, reviews

    return more.QUERIES | places.QUERIES | reviews.QUERIES


def queries() -> dict[str, Query]:
    return _QUERIES | {name: plan for name, (plan, _) in _others().items()}


def oracle_sql() -> dict[str, str]:
    return _ORACLES | {name: answer for name, (_, answer) in _others().items() if answer}
