"""Queries on positioned items: the pages of the derived letters, as words, whole lines or single characters by document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions import values as V
from inkveil.operators import locate, places, tier2
from inkveil.plans import queries as base
from inkveil.plans import sql
from inkveil.sources import corpus

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}
NEEDLE = "Sprak  met"


def query(name: str, answer: str) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    def add(plan: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = (plan, answer)
        return plan

    return add


def width(text: str) -> str:
    """SQL for the sum of the widths of a text's characters."""
    table = ", ".join(map(str, V.GLYPH_WIDTHS))
    return f"case when {text} = '' then 0 else list_sum(list_transform(string_split({text}, ''), lambda c: coalesce([{table}][unicode(c) - 31], {V.GLYPH_WIDTH}))) end"


def letter_items(s: SparkSession, d: str) -> DataFrame:
    """The letters' lines on pages of twelve; characters are 6 points wide and lines 14 points apart."""
    lines = base.letters(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    words = F.split("s", " ")
    before = lambda i: F.aggregate(F.slice(words, 1, i), F.lit(0), lambda n, w: n + F.length(w) + 1)
    piece = lambda off, text: F.struct(off.alias("off"), text.alias("text"))
    by_mode = F.when(F.col("doc_id") % 3 == 0, F.transform(words, lambda w, i: piece(before(i), w))).when(F.col("doc_id") % 3 == 1, F.array(piece(F.lit(0), F.col("s")))).otherwise(F.transform(F.split("s", ""), lambda c, i: piece(i, c)))
    rows = lines.select("doc_id", "line", F.inline(by_mode)).filter("trim(text) <> ''")
    x0, y0 = 10 + 6.0 * F.col("off"), 20 + 14.0 * (F.col("line") % 12)
    return rows.select(
        "doc_id", (F.col("line") / 12).cast("int").alias("page"), (F.col("line") * 1000 + F.col("off")).alias("ord"), "text",
        x0.alias("x0"), y0.alias("y0"), (x0 + 6.0 * F.length("text")).alias("x1"), (y0 + 10).alias("y1"),
    )


def with_(*more: str) -> str:
    """The items in SQL (i: with nr, their number on the page, from 0), and what further tables a query needs."""
    return f"""with recursive lines as (
    select doc_id, unnest(string_split(text, chr(10))) as s, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from ({corpus.CORPUS_SQL})),
words as (select doc_id, line, unnest(string_split(s, ' ')) as text, generate_subscripts(string_split(s, ' '), 1) as k from lines where doc_id % 3 = 0),
pieces as (
    select doc_id, line, text, coalesce(sum(length(text) + 1) over (partition by doc_id, line order by k rows between unbounded preceding and 1 preceding), 0) as off from words
    union all select doc_id, line, s, 0 from lines where doc_id % 3 = 1
    union all select doc_id, line, unnest(string_split(s, '')), generate_subscripts(string_split(s, ''), 1) - 1 from lines where doc_id % 3 = 2),
i as (
    select doc_id, (line // 12)::int as page, (line * 1000 + off)::int as ord, text, (10 + 6 * off)::double as x0, (20 + 14 * (line % 12))::double as y0,
        (10 + 6 * off + 6 * length(text))::double as x1, (30 + 14 * (line % 12))::double as y1,
        row_number() over (partition by doc_id, line // 12 order by line * 1000 + off) - 1 as nr
    from pieces where trim(text) <> ''){''.join(', ' + m for m in more)}
"""


# --- occurrences -------------------------------------------------------------------------------------------------------------
def found(s: SparkSession, d: str) -> DataFrame:
    """Persons by initials, and titled names, with which of their text's occurrences each is."""
    letters = base.letters(s, d)
    persons = base.persons(s, d).select("doc_id", "text", "start_char", "end_char")
    return locate.occurrences(persons, letters).select("doc_id", "text", "start_char", "nth")


def holds(text: str, needle: str = "needle") -> str:
    """Whether a text holds a needle at word edges; the pattern is only built where the needle occurs at all."""
    return rf"case when contains({text}, {needle}) then regexp_matches({text}, '(^|[^\p{{L}}\p{{N}}])' || regexp_escape({needle}) || '($|[^\p{{L}}\p{{N}}])') else false end"


_DETECTED = f"det as (select doc_id, text, start_char, lower(trim(text)) as needle from ({sql.initials()}))"
_NTH = rf"""
texts as (select doc_id, lower(text) as full_text from ({corpus.CORPUS_SQL})),
nths as (
    select distinct det.doc_id, det.text, det.start_char, needle,
        len(list_filter(range(1, start_char + 1), lambda p: substr(full_text, p, length(needle)) = needle
            and not regexp_matches(substr(full_text, p - 1, case when p = 1 then 0 else 1 end), '[\p{{L}}\p{{N}}]')
            and not regexp_matches(substr(full_text, p + length(needle), 1), '[\p{{L}}\p{{N}}]'))) as nth
    from det join texts using (doc_id))"""
_SINGLE = rf"""
n as (select distinct doc_id, needle, split_part(needle, ' ', 1) as word, regexp_replace(needle, '\s', '', 'g') as target from det),
single as (
    select n.doc_id, needle, page, nr, text, x0, y0, x1, y1,
        strpos(lower(text), regexp_extract(lower(text), '(^|[^\p{{L}}\p{{N}}])' || regexp_escape(needle) || '($|[^\p{{L}}\p{{N}}])'))
        + length(regexp_extract(lower(text), '(^|[^\p{{L}}\p{{N}}])' || regexp_escape(needle) || '($|[^\p{{L}}\p{{N}}])', 1)) - 1 as begin
    from n join i using (doc_id) where {holds('lower(text)')}),
w as (
    select n.doc_id, needle, target, page, nr, nr as j, lower(text) as spaced, lower(text) as glued, x0, y0, x1, y1, y0 as top, 0 as done
    from n join i using (doc_id) where ({holds('lower(text)', 'word')} or starts_with(needle, lower(text))) and not {holds('lower(text)')}
    union all
    select w.doc_id, needle, target, w.page, w.nr, i.nr, spaced || ' ' || lower(text), glued || lower(text), least(w.x0, i.x0), least(w.y0, i.y0), greatest(w.x1, i.x1), greatest(w.y1, i.y1), top,
        case when {holds("spaced || ' ' || lower(text)")} or {holds('glued || lower(text)')} or regexp_replace(glued || lower(text), '\s', '', 'g') = target then 1
             when length(regexp_replace(glued || lower(text), '\s', '', 'g')) > length(target) + 4 then -1 else 0 end
    from w join i on i.doc_id = w.doc_id and i.page = w.page and i.nr = w.j + 1
    where done = 0 and abs(i.y0 - top) <= 3 and w.j + 1 - w.nr <= greatest(60, 2 * length(target) + 8)),
hits as (
    select doc_id, needle, page, nr, false as one, x0, y0, x1, y1 from w where done = 1
    union all
    select doc_id, needle, page, nr, true,
        case when begin = 0 and length(needle) = length(text) then x0 else x0 + (x1 - x0) * ({width('substr(text, 1, begin)')}) / ({width('text')}) end, y0,
        case when begin = 0 and length(needle) = length(text) then x1 else x0 + (x1 - x0) * ({width('substr(text, 1, begin)')} + {width('substr(text, begin + 1, length(needle))')}) / ({width('text')}) end, y1
    from single),
ranked as (
    select *, row_number() over (partition by doc_id, needle order by page, nr) - 1 as nth, row_number() over (partition by doc_id, needle order by page, one desc, nr) as first from hits)"""


@query(
    "occurrence_boxes",
    with_(_DETECTED, _NTH, _SINGLE)
    + """select t.doc_id, t.text, t.start_char, t.nth, coalesce(a.page, b.page) as page, round(coalesce(a.x0, b.x0), 6) as x0, coalesce(a.y0, b.y0) as y0, round(coalesce(a.x1, b.x1), 6) as x1, coalesce(a.y1, b.y1) as y1
from nths t left join ranked a on a.doc_id = t.doc_id and a.needle = t.needle and a.nth = t.nth left join ranked b on b.doc_id = t.doc_id and b.needle = t.needle and b.first = 1""",
)
def occurrence_boxes(s: SparkSession, d: str) -> DataFrame:
    placed = places.boxes_of_occurrences(found(s, d), letter_items(s, d))
    return placed.select("doc_id", "text", "start_char", "nth", "box.page", F.round("box.x0", 6).alias("x0"), "box.y0", F.round("box.x1", 6).alias("x1"), "box.y1").distinct()


_COUNTS = _NTH.replace("len(list_filter(range(1, start_char + 1)", "len(list_filter(range(1, length(full_text)::int + 1)").replace("nths as (", "alls as (").replace("texts as (select doc_id, lower(text) as full_text", "whole as (select doc_id, lower(text) as full_text").replace("join texts", "join whole").replace("as nth\n", "as n_all\n")


@query("occurrence_counts", "with " + ", ".join((_DETECTED, _NTH, _COUNTS)) + " select doc_id, text, start_char, nth, n_all from nths join alls using (doc_id, text, start_char)")
def occurrence_counts(s: SparkSession, d: str) -> DataFrame:
    """Which of its text's whole occurrences in the letter each person is, and how many there are."""
    persons = base.persons(s, d).select("doc_id", "text", "start_char", "end_char")
    return locate.occurrences(persons, base.letters(s, d)).select("doc_id", "text", "start_char", "nth", "n_all")


@query("nth_occurrence", "with " + ", ".join((_DETECTED, _NTH)) + " select doc_id, text as needle, nth, start_char, start_char + length(text) as end_char from nths")
def nth_occurrence(s: SparkSession, d: str) -> DataFrame:
    """From a person's text and number back to its place in the letter."""
    return locate.nth_occurrence(base.letters(s, d), found(s, d).select("doc_id", F.col("text").alias("needle"), "nth"))


# --- persons' spans without function titles ----------------------------------------------------------------------------------
_TITLED = f"""select k as doc_id, first || ' ' || last as name, case k % 5 when 0 then first || ' ' || last || ', ' || title when 1 then first || ' ' || last || ' ' || title || ' te Gouda'
    when 2 then upper(title) || ' ' || first || ' ' || last when 3 then first || ' ' || last || ' ' || title || ', ' || title || '.' else first || ' ' || last end as text
from (select c_custkey as k, split_part('{corpus._FIRST}', ',', cast(1 + c_custkey % 7 as int)) as first, split_part('{corpus._LAST}', ',', cast(1 + c_custkey % 11 as int)) as last,
    split_part('{corpus._TITLES}', ',', cast(1 + c_custkey % 5 as int)) as title from customer) a"""


@query("trimmed_titles", f"select doc_id, name as text, cast(case doc_id % 5 when 2 then strpos(text, ' ') else 0 end as integer) as start_char from ({_TITLED})")
def trimmed_titles(s: SparkSession, d: str) -> DataFrame:
    """Titles behind, within and before a name go, and the name's offsets move along."""
    rows = corpus.derived(s, d, _TITLED, "customer")
    hit = tier2.hit("persoon", F.col("text"), F.lit(0), F.lit(0.8), "ner")
    bare = tier2.trim_persons(F.array(hit).cast(tier2.HIT), [t for _, t, _ in corpus.TITLES])
    return rows.select("doc_id", F.inline(bare)).select("doc_id", "text", "start_char")


# --- texts in boxes ----------------------------------------------------------------------------------------------------------
_CHARS = f"""
asked as (select distinct doc_id, page, y0 - 1 as top from i),
met as (select i.*, top from i join asked using (doc_id, page) where (y0 + y1) / 2 between top and top + 12 and x0 < 202 and x1 > 39),
chars as (
    select doc_id, page, nr, top, x0, x1, unnest(string_split(text, '')) as c, generate_subscripts(string_split(text, ''), 1) as k,
        unnest(list_transform(string_split(text, ''), lambda c: coalesce([{', '.join(map(str, V.GLYPH_WIDTHS))}][unicode(c) - 31], {V.GLYPH_WIDTH}))) as wide
    from met where not (x0 >= 39.5 and x1 <= 201.5)),
placed as (
    select *, sum(wide) over (partition by doc_id, page, nr, top order by k) as reach, sum(wide) over (partition by doc_id, page, nr, top) as whole from chars),
cut as (
    select doc_id, page, nr, top, trim(string_agg(c, '' order by k)) as part from placed
    where (reach - wide + reach) / 2.0 * ((x1 - x0) / whole) >= greatest(x0, 41) - x0 and (reach - wide + reach) / 2.0 * ((x1 - x0) / whole) <= least(x1, 200) - x0
        and least(x1, 200) > greatest(x0, 41) group by all),
parts as (
    select doc_id, page, nr, top, x0, x1, case when x0 >= 39.5 and x1 <= 201.5 then text else part end as part from met left join cut using (doc_id, page, nr, top)),
glued as (
    select doc_id, page, top, nr, case when lag(x1) over w is null then '' when x0 - lag(x1) over w < 1.5 then '' else ' ' end || part as part
    from parts where coalesce(part, '') <> '' window w as (partition by doc_id, page, top order by x0)),
lined as (select doc_id, page, top, trim(regexp_replace(string_agg(part, '' order by nr), '\\s+', ' ', 'g')) as text from glued group by all),
fresh as (select doc_id, page, min(top) as top, arg_min(text, top) as text from lined where text <> '' group by doc_id, page, regexp_replace(lower(text), '[.,;:]+$', ''))"""


@query("box_texts", with_(_CHARS) + "select doc_id, page, string_agg(text, ' ' order by top) as text from fresh group by all")
def box_texts(s: SparkSession, d: str) -> DataFrame:
    """The text of a column of each page (41 to 200 points), a box a line."""
    items = letter_items(s, d)
    boxes = items.select("doc_id", "page", (F.col("y0") - 1).alias("y0")).distinct()
    boxes = boxes.select(F.struct("doc_id", "page").alias("det_id"), "doc_id", "page", F.col("y0").alias("place"), F.lit(41.0).alias("x0"), "y0", F.lit(200.0).alias("x1"), (F.col("y0") + 12).alias("y1"))
    return places.texts_of_boxes(boxes, items).select("det_id.doc_id", "det_id.page", "text")


# --- search ------------------------------------------------------------------------------------------------------------------
_HITS = """
p as (select doc_id, page, string_agg(text, ' ' order by nr) as text from i group by all),
o as (select *, coalesce(sum(length(text) + 1) over (partition by doc_id, page order by nr rows between unbounded preceding and 1 preceding), 0) as s from i),
h as (
    select doc_id, page, text as full_text, unnest(list_filter(range(0, length(text)::int), lambda k: substr(lower(text), k + 1, 9) = 'sprak met')) as a from p where contains(lower(text), 'sprak met')),
l as (
    select h.doc_id, h.page, a, y0, min(x0) as x0, max(x1) as x1, max(y1) as y1 from h join o on o.doc_id = h.doc_id and o.page = h.page and s < a + 9 and s + length(o.text) > a group by all),
r as (select doc_id, page, x0 - 4 as x0, y0 + 2 as y0, x0 + 20 as x1, y1 from i where ord % 2 = 0),
c as (
    select l.doc_id, l.page, l.a, l.y0, max(case when (least(l.x1, r.x1) - greatest(l.x0, r.x0)) * (least(l.y1, r.y1) - greatest(l.y0, r.y0)) >= 0.5 * (l.x1 - l.x0) * (l.y1 - l.y0) then 1 else 0 end) = 1 as covered
    from l join r on r.doc_id = l.doc_id and r.page = l.page and r.x0 < l.x1 and r.x1 > l.x0 and r.y0 < l.y1 and r.y1 > l.y0 group by all),
g as (
    select l.doc_id, l.page, l.a, l.y0, count(*) * 2.0 * 8 as taken from l, unnest(range(0, ((l.x1 - l.x0) / 2)::int)) as u(k)
    where exists (select 1 from r where r.doc_id = l.doc_id and r.page = l.page and r.y0 = l.y0 + 2 and r.x0 <= l.x0 + 2 * k and r.x1 >= l.x0 + 2 * k + 2) group by all)"""
_FOUND = """select l.doc_id, l.page, a::int as start_char, substr(max(full_text), a + 1, 9) as text,
    case when a > 24 then '…' else '' end || substr(max(full_text), greatest(a - 24, 0) + 1, a - greatest(a - 24, 0) + 33) || case when a + 33 < max(length(full_text)) then '…' else '' end as snippet,
    count(*) as lines, min(x0) as x0, max(x1) as x1, coalesce(bool_or(covered), false) as covered, round(coalesce(sum(taken), 0) / sum((x1 - x0) * (y1 - l.y0)), 6) as covered_share
from l join h using (doc_id, page, a) left join c using (doc_id, page, a, y0) left join g using (doc_id, page, a, y0) group by l.doc_id, l.page, a"""


@query("search_boxes", with_(_HITS) + _FOUND)
def search_boxes(s: SparkSession, d: str) -> DataFrame:
    """Hits on the pages with their boxes, and how much of them boxes round every second item take."""
    items = letter_items(s, d)
    redacted = items.filter("ord % 2 = 0").select("doc_id", "page", (F.col("x0") - 4).alias("x0"), (F.col("y0") + 2).alias("y0"), (F.col("x0") + 20).alias("x1"), "y1")
    found = places.search(items, NEEDLE, redacted)
    least, most = F.array_min(F.transform("boxes", lambda b: b["x0"])), F.array_max(F.transform("boxes", lambda b: b["x1"]))
    return found.select("doc_id", "page", "start_char", "text", "snippet", F.size("boxes").cast("long").alias("lines"), least.alias("x0"), most.alias("x1"), "covered", F.round("covered_share", 6).alias("covered_share"))


# --- boxes and words ---------------------------------------------------------------------------------------------------------
_NEXT = "nx as (select *, lead(x0) over w as wx0, lead(x1) over w as wx1, lead(y0) over w as wy0, lead(y1) over w as wy1 from i window w as (partition by doc_id, page order by nr))"


@query(
    "word_boxes",
    with_(_NEXT)
    + """select doc_id, page, ord, least(x0, wx0) as gx0, greatest(x1, wx1) as gx1, greatest(y1, wy1) as gy1,
    case when (wx0 + wx1) / 2 >= (x0 + x1) / 2 then x0 else least(x1 - 2, wx1) end as sx0, case when (wx0 + wx1) / 2 >= (x0 + x1) / 2 then greatest(x0 + 2, wx0) else x1 end as sx1
from nx where wx0 is not null""",
)
def word_boxes(s: SparkSession, d: str) -> DataFrame:
    """Each item's box grown to the next item, and shrunk by it."""
    box, order = F.struct("page", "x0", "y0", "x1", "y1"), places.W.partitionBy("doc_id", "page").orderBy("ord")
    pairs = letter_items(s, d).select("doc_id", "page", "ord", box.alias("b"), F.lead(box).over(order).alias("w")).filter("w is not null")
    both = pairs.select("doc_id", "page", "ord", places.grown_to_word(F.col("b"), F.col("w")).alias("g"), places.shrunk_by_word(F.col("b"), F.col("w")).alias("s"))
    return both.select("doc_id", "page", "ord", F.col("g.x0").alias("gx0"), F.col("g.x1").alias("gx1"), F.col("g.y1").alias("gy1"), F.col("s.x0").alias("sx0"), F.col("s.x1").alias("sx1"))
