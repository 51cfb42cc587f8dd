"""DuckDB SQL that computes the same rows as the queries, written from the rules and not from the Spark plans."""

from __future__ import annotations

from inkveil.functions import values as V
from inkveil.operators import tier2
from inkveil.operators.tier1 import CONFIDENCE, KVK_FAR_CONFIDENCE, ORDER
from inkveil.sources.corpus import CONTACTS_SQL, CORPUS_SQL, EVENTS_SQL, OFFICIALS_SQL, TITLES_SQL

AS_OF = "2025-01-01"
LETTERS = f"(select cast(doc_id as bigint) as doc_id, cast(gm_code as integer) as gm_code, text from ({CORPUS_SQL}))"


def q(pattern: str) -> str:
    """A Java pattern for RE2, as an SQL literal: no U flag, look-arounds at word edges become edges."""
    for java, re2 in (("(?iU)", "(?i)"), ("(?U)", ""), (r"(?<!\w)\+", r"\B\+"), (r"(?<!\w)http", r"\bhttp"), (r"(?!\w)", r"\b")):
        pattern = pattern.replace(java, re2)
    return "'" + pattern.replace("'", "''") + "'"


def spans(source: str, pattern: str, column: str = "text", keys: str = "doc_id") -> str:
    """keys, full_text, text, start_char, end_char, i of all matches."""
    p = q(pattern)
    total = lambda a: f"coalesce(list_sum(list_transform({a}, lambda x: length(x))), 0)"
    return f"""(select *, cast(start_char + length(text) as integer) as end_char from (
        select {keys}, full_text, m[i] as text, cast({total("g[1:i]")} + {total("m[1:i-1]")} as integer) as start_char, i from (
        select *, unnest(range(1, len(m) + 1)) as i from (
        select {keys}, {column} as full_text, regexp_extract_all({column}, {p}) as m, string_split_regex({column}, {p}) as g from {source} where regexp_matches({column}, {p})))))"""


def _eleven(d: str) -> str:
    total = " + ".join(f"{w} * cast(substr({d}, {i + 1}, 1) as integer)" for i, w in enumerate((9, 8, 7, 6, 5, 4, 3, 2, -1)))
    return f"(length({d}) = 9 and substr({d}, 1, 1) <> '0' and ({total}) % 11 = 0 and ({total}) <> 0)"


def _luhn(d: str) -> str:
    digit = f"cast(substr({d}, length({d}) - k + 1, 1) as integer)"
    return f"(length({d}) between 13 and 19 and list_sum(list_transform(range(1, length({d}) + 1), lambda k: case when k % 2 = 1 then {digit} when {digit} > 4 then 2 * {digit} - 9 else 2 * {digit} end)) % 10 = 0)"


def _mod97(t: str) -> str:
    c = f"upper(regexp_replace({t}, '\\s', '', 'g'))"
    digits = f"list_transform(string_split(substr({c}, 5) || substr({c}, 1, 4), ''), lambda c: case when c between 'A' and 'Z' then cast(ascii(c) - 55 as varchar) else c end)"
    return f"try_cast(array_to_string({digits}, '') as hugeint) % 97 = 1"


def _rows(kind: str, source: str, where: str = "true", pattern_no: int = 0, confidence: float | None = None, text: str = "text", start: str = "start_char") -> str:
    ground = V.GROUND_BSN if kind == "bsn" else V.GROUND
    order = (ORDER.index(kind) * 100 + pattern_no) * 1_000_000
    return f"select doc_id, '{kind}' as entity_type, '1' as tier, {text} as text, cast({start} as integer) as start_char, cast({start} + length({text}) as integer) as end_char, cast({confidence or CONFIDENCE[kind]} as double) as confidence, '{ground}' as woo_article, 'regex' as source, {order} + i as ord from {source} where {where}"


def _anchored(anchor: str, pattern: str, near: int, reach: int, source: str) -> str:
    window = f"substr(full_text, end_char + 1, {near + reach})"
    return f"(select doc_id, full_text, i, end_char as a_end, regexp_extract({window}, {q(pattern)}) as text, length(string_split_regex({window}, {q(pattern)})[1]) as gap, end_char + gap as start_char from {spans(source, anchor)})"


def tier1_parts(source: str = LETTERS) -> dict[str, str]:
    """By type, the rows before repeated ones are dropped."""
    digits = "regexp_replace(text, '\\D', '', 'g')"
    union = " union all ".join
    anchor, number = f"(?i){V.KVK_ANCHOR}", V.KVK_NUMBER
    close = f"(select * from {_anchored(anchor, number, V.KVK_NEAR, 8, source)} where text <> '' and gap <= {V.KVK_NEAR})"
    between = "substr(n.full_text, a.end_char + 1, n.start_char - a.end_char)"
    far = f"""(select distinct n.doc_id, n.text, n.start_char, n.i from {spans(source, number)} n join {spans(source, anchor)} a on n.doc_id = a.doc_id
        where n.start_char - a.end_char between 0 and {V.KVK_FAR} and regexp_matches({between}, '[A-Za-z]{{2,}}') and not regexp_matches({between}, '\\.\\s+[A-Z]')
        and not exists (select 1 from {close} c where c.doc_id = n.doc_id and c.start_char = n.start_char))"""
    names = "|".join(sorted(V.MONTHS, key=len, reverse=True))
    births = _anchored(f"(?i){V.BIRTH_ANCHOR}", rf"(?i)\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{4}}|\d{{1,2}}\s+(?:{names})\s+\d{{4}}", V.BIRTH_NEAR, 20, source)
    day = "try_cast(split_part(text, '-', 3) || '-' || split_part(text, '-', 2) || '-' || split_part(text, '-', 1) as date)"
    urls = f"(select doc_id, rtrim(text, '{V.URL_TAIL}') as text, start_char, i from {spans(source, V.URL)})"
    return {
        "bsn": _rows("bsn", spans(source, V.BSN), _eleven("text")),
        "iban": _rows("iban", spans(source, f"(?i){V.IBAN}"), _mod97("text")),
        "telefoon": union(_rows("telefoon", spans(source, p), f"length({digits}) >= 10", k) for k, p in enumerate(V.PHONES)),
        "email": _rows("email", spans(source, V.EMAIL)),
        "postcode": _rows("postcode", spans(source, V.POSTCODE)),
        "kenteken": union(_rows("kenteken", spans(source, p), "true", k) for k, p in enumerate(V.PLATES)),
        "url": _rows("url", urls, "text <> ''"),
        "kvk": _rows("kvk", close) + " union all " + _rows("kvk", far, "true", 1, KVK_FAR_CONFIDENCE),
        "btw": _rows("btw", spans(source, f"(?i){V.VAT}"), _eleven(f"substr({digits}, 1, 9)")),
        "geboortedatum": _rows("geboortedatum", births, f"text <> '' and gap <= {V.BIRTH_NEAR} and {day} <= date '{AS_OF}' and year(date '{AS_OF}') - year({day}) <= 120"),
        "creditcard": _rows("creditcard", spans(source, V.CARD), _luhn("regexp_replace(text, '[\\s\\-]', '', 'g')")),
    }


def first_only(rows: str) -> str:
    return f"select doc_id, entity_type, tier, text, start_char, end_char, confidence, woo_article, source from ({rows}) qualify row_number() over (partition by doc_id, lower(text), start_char, end_char order by ord) = 1"


def tier1(kinds: tuple[str, ...] = ORDER, source: str = LETTERS) -> str:
    parts = tier1_parts(source)
    return first_only(" union all ".join(f"({parts[k]})" for k in kinds))


_KEY = "case entity_type when 'postcode' then upper(replace(text, ' ', '')) when 'telefoon' then regexp_replace(text, '\\D', '', 'g') when 'url' then rtrim(lower(text), '/') else lower(trim(text)) end"


def status() -> str:
    """Tier-1 rows with their review status."""
    keyed = f"(select s.*, c.text as full_text from (select *, {_KEY} as key from ({tier1()})) s join {LETTERS} c using (doc_id))"
    listed = f"(select distinct kind, case kind when 'postcode' then upper(replace(value, ' ', '')) when 'telefoon' then regexp_replace(value, '\\D', '', 'g') else lower(value) end as value from ({CONTACTS_SQL}))"
    post_box = "entity_type = 'postcode' and regexp_matches(substr(full_text, greatest(start_char - 30, 0) + 1, start_char - greatest(start_char - 30, 0)), '(?i)\\bpostbus\\s+\\d{1,6}[\\s,.;:\\-]*$')"
    flagged = f"(select k.*, l.value is not null or ({post_box}) as public from {keyed} k left join {listed} l on l.kind = k.entity_type and l.value = k.key)"
    return f"""select doc_id, entity_type, tier, text, start_char, end_char, confidence, case when not public then woo_article end as woo_article, case when public then 'whitelist_gemeente' else source end as source,
        case when public then 'rejected' when entity_type = 'kvk' then 'pending' else 'auto_accepted' end as review_status from {flagged}"""


def _before(width: int) -> str:
    return f"substr(full_text, greatest(start_char - {width}, 0) + 1, start_char - greatest(start_char - {width}, 0))"


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def home(text: str = "text") -> str:
    tokens = f"list_transform(string_split_regex(trim({text}), '\\s+'), lambda t: lower(trim(t, '.,;:()')))"
    return f"(contains(trim({text}), ' ') and not list_has_any({tokens}, {_list(V.ORGANISATION_WORDS + V.PUBLIC_BUILDINGS)}) and not regexp_matches({_before(30)}, '(?i)(?:{'|'.join(V.ADDRESS_LABELS)})\\s*[:\\-]?\\s*$'))"


def plausible(text: str = "text") -> str:
    tokens = f"string_split_regex(trim({text}), '\\s+')"
    return f"""(length(trim({text})) between 2 and 50 and regexp_matches({text}, '\\p{{Lu}}') and (lower({tokens}[1]) not in ({_list(V.NOT_A_NAME)[1:-1]}) or len(list_filter({tokens}[2:], lambda t: regexp_matches(t, '^\\p{{Lu}}'))) > 0)
        and not list_has_any(list_transform({tokens}, lambda t: lower(t)), {_list(V.ORGANISATION_WORDS)}) and not regexp_matches(trim({text}), '[a-z]\\.\\s+[a-z]') and not (len({tokens}) >= 2 and regexp_matches({tokens}[-1], '^\\p{{L}}$')))"""


def street() -> str:
    near = f"exists (select 1 from {spans(LETTERS, V.POSTCODE)} p where p.doc_id = s.doc_id and (p.start_char - s.end_char between 0 and 80 or s.start_char - p.end_char between 0 and 80))"
    return f"select doc_id, 'adres' as entity_type, text, start_char, end_char, cast(case when {near} then 0.92 else 0.85 end as double) as confidence, 'regex' as source from {spans(LETTERS, tier2.STREET)} s where {home()}"


def house_number() -> str:
    inner = f"regexp_extract(text, {q('(?i)' + V.RESIDENT_NUMBER)})"
    return f"""select doc_id, 'adres' as entity_type, text, start_char, end_char, cast(0.85 as double) as confidence, 'regex' as source from {spans(LETTERS, '(?i)' + V.HOUSE_NUMBER)}
        union all select doc_id, 'adres', {inner}, cast(end_char - length({inner}) as integer), end_char, cast(0.80 as double), 'regex' from {spans(LETTERS, '(?i)' + V.RESIDENT)}"""


def reference() -> str:
    value = f"regexp_extract(text, {q(tier2.REFERENCE)}, 2)"
    label = f"regexp_replace(lower(regexp_extract(text, {q(tier2.REFERENCE)}, 1)), '\\s+', ' ', 'g')"
    sure = "case " + label + " " + " ".join(f"when '{k}' then {v}" for k, v in V.REFERENCE_LABELS.items()) + " end"
    return f"select doc_id, 'referentie' as entity_type, {value} as text, cast(end_char - length({value}) as integer) as start_char, end_char, cast({sure} as double) as confidence, 'regex' as source from {spans(LETTERS, tier2.REFERENCE)} where regexp_matches({value}, '\\d')"


def initials() -> str:
    core = tier2.INITIALS.replace(r"(?<![\w.])", "")
    found = f"(select doc_id, full_text, regexp_replace(text, '^[^A-Z]', '') as text, cast(end_char - length(regexp_replace(text, '^[^A-Z]', '')) as integer) as start_char, end_char from {spans(LETTERS, '(?:^|[^' + chr(92) + 'w.])' + core.replace('(?U)', ''))})"
    norm = "upper(regexp_replace(regexp_extract(text, '^(?:[A-Z]\\.\\s*){1,4}'), '[\\s.]', '', 'g'))"
    return f"select doc_id, 'persoon' as entity_type, text, start_char, end_char, cast(0.85 as double) as confidence, 'initials_rule' as source from {found} where not regexp_matches(substr(full_text, end_char + 1, 2), '^\\.\\p{{L}}') and {norm} not in ({_list(V.NOT_SURNAMES)[1:-1]}) and {plausible()}"


def titles() -> str:
    """Names after 'dhr.': particles and one capitalised word (other forms of address in the letters are followed by no name)."""
    name = "regexp_extract(text, 'dhr\\.\\s+((?:(?:van|de|der)\\s+)*[A-Z][a-z]+)', 1)"
    start = "strpos(text, 'dhr. ') + 4"
    return f"select doc_id, 'persoon' as entity_type, {name} as text, cast({start} as integer) as start_char, cast({start} + length({name}) as integer) as end_char, cast(0.75 as double) as confidence, 'title_rule' as source from {LETTERS} where {name} <> ''"


BORN = f"(select doc_id, replace(text, 'Geboortedatum: ', 'Geboren op ') as text from {LETTERS})"


def dates() -> str:
    year = "try_cast(regexp_extract(text, '\\b(?:19|20)\\d{2}\\b') as integer)"
    return f"select doc_id, 'datum' as entity_type, text, start_char, end_char, cast(0.60 as double) as confidence, 'ner' as source from {spans(BORN, tier2.DATE)} where not (coalesce({year} >= year(date '{AS_OF}') - 2, false) or regexp_matches({_before(30)}, {q('(?i)' + V.EVENT_BEFORE)}))"


def listed(first: tuple[str, ...], last: tuple[str, ...]) -> str:
    """Runs of capitalised words that hold a listed first name (at their begin) or surname."""
    word = f"[{V.CAPITAL}][{V.INNER}\\-]*"
    particles = "(?:(?:van der|van den|van de|van het|van|de|der|den|ter|ten|te|op de|op den|op)[^\\S\\n]+)?"
    run = f"\\b{word}(?:[^\\S\\n]+{particles}{word}){{0,4}}"
    tokens = "list_filter(list_transform(string_split_regex(trim(text), '\\s+'), lambda t: lower(regexp_replace(t, '^\\W+|\\W+$', '', 'g'))), lambda t: t <> '' and t not in ('van', 'de', 'der', 'den'))"
    scored = f"(select *, list_contains({list(first)}, t[1]) as f, len(list_filter(case when list_contains({list(first)}, t[1]) then t[2:] else t end, lambda x: x in ({str(list(last))[1:-1]}))) > 0 as l from (select *, {tokens} as t from {spans(LETTERS, run)} where {plausible()}))"
    return f"select doc_id, 'persoon' as entity_type, text, start_char, end_char, cast(least(0.95, round(0.80 + case when f then 0.10 else 0.0 end + case when l then 0.05 else 0.0 end, 2)) as double) as confidence, 'ner' as source from {scored} where f or l"


def organisations() -> str:
    return f"select doc_id, 'organisatie' as entity_type, text, start_char, end_char, cast(0.50 as double) as confidence, 'ner' as source from {spans(LETTERS, tier2.ORGANISATION)}"


LINES = f"(select doc_id, cast(i - 1 as integer) as i, l[i] as line, cast(coalesce(list_sum(list_transform(l[1:i-1], lambda x: length(x) + 1)), 0) as integer) as start_char, cast(coalesce(list_sum(list_transform(l[1:i-1], lambda x: length(x) + 1)), 0) + length(l[i]) as integer) as end_char from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(text, chr(10)) as l from {LETTERS})))"
_GREETING = "case " + " ".join(f"when regexp_matches(line, {q(p.replace('(?=' + chr(92) + 's|[,;:!?]|$)', '(?:' + chr(92) + 's|[,;:!?]|$)'))}) then trim(regexp_extract(line, {q(p.replace('(?=' + chr(92) + 's|[,;:!?]|$)', ''))}))" for p in V.SALUTATIONS) + " else '' end"


def salutations() -> str:
    return f"select doc_id, 'salutation' as kind, start_char, end_char, cast(0.85 as double) as confidence, {_GREETING} as evidence from {LINES} where {_GREETING} <> ''"


def headers() -> str:
    """Blocks as islands of header-like lines from their first header word on (no island of the letters has over 15 lines)."""
    trigger, shaped = f"regexp_matches(line, {q(V.HEADER_START)})", f"regexp_matches(line, {q(V.HEADER_LINE)})"
    islands = f"(select *, i - row_number() over (partition by doc_id order by i) as island from (select *, {trigger} as t from {LINES}) where t or {shaped})"
    opened = f"(select *, min(case when t then i end) over (partition by doc_id, island) as first from {islands})"
    return f"select doc_id, 'email_header' as kind, min(start_char) as start_char, max(end_char) as end_char, cast(0.95 as double) as confidence, trim(regexp_extract(min_by(line, i), {q(V.HEADER_START)})) as evidence from {opened} where i >= first group by doc_id, island"


def signatures() -> str:
    closing = f"'(?i)^\\s*(?:{'|'.join(V.CLOSINGS)})'"
    flagged = f"(select *, trim(line) = '' as blank, coalesce(lag(trim(line) = '') over (partition by doc_id order by i), false) as blank_before, ({_GREETING}) <> '' or regexp_matches(line, {q(V.DISCLAIMER)}) as hard from {LINES})"
    return f"""with f as (select * from {flagged}),
        pairs as (select t.doc_id, t.i as t, t.start_char as t_start, t.end_char as t_end, trim(regexp_extract(t.line, {closing})) as evidence, y.* exclude (doc_id) from f t left join f y on y.doc_id = t.doc_id and y.i > t.i where regexp_matches(t.line, {closing})),
        stops as (select *, min(case when (not blank and hard) or (blank and blank_before and i > t + 1) then i end) over (partition by doc_id, t) as stop from pairs),
        taken as (select *, count(case when not blank then 1 end) over (partition by doc_id, t order by i) as n from stops)
        select doc_id, 'signature_block' as kind, t_start as start_char, cast(coalesce(max(case when not blank and n <= {V.MOST_SIGNATURE_LINES} and (stop is null or i < stop) then end_char end), t_end) as integer) as end_char, cast(0.90 as double) as confidence, evidence from taken group by doc_id, t, t_start, t_end, evidence"""


def structures() -> str:
    return f"select * from ({headers()}) union all select * from ({signatures()}) union all select * from ({salutations()})"


NAMES_SQL = "select k as doc_id, name from (select cast(c_custkey as bigint) as k, substr('ABCDEFGH', cast(1 + c_custkey % 8 as int), 1) || '. ' || split_part('Jansen,Bakker,Visser,Smit,Meijer,Mulder,Bos,Dekker,Peters,Hendriks,Dijkman', ',', cast(1 + c_custkey % 11 as int)) as name from customer) n where k % 3 = 0"


def reference_match() -> str:
    norm = lambda x: f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"
    return f"select p.doc_id, p.start_char, p.end_char, p.text from ({initials()}) p where exists (select 1 from ({NAMES_SQL}) n where n.doc_id = p.doc_id and {norm('n.name')} = {norm('p.text')})"


#: Of the rule's common surnames those that the letters hold.
COMMON = ("jansen", "bakker", "visser", "smit", "meijer", "mulder", "bos", "dekker", "peters", "hendriks", "dijkman", "de bakker", "de dekker", "de bos", "de vos")


def officials_match() -> str:
    seen = lambda x: f"list_extract(regexp_extract_all({x}, '(?:[A-Z]\\.){{1,4}}'), -1)"
    own = f"""(select p.doc_id, p.start_char, p.end_char, p.text, c.gm_code, c.text as full_text, list_filter(string_split_regex(trim(p.text), '\\s+'), lambda t: not list_contains(['heer', 'dhr', 'mevr', 'mw', 'mr', 'drs', 'prof', 'dr', 'mevrouw', 'meneer', 'familie'], lower(rtrim(t, '.'))) and not regexp_matches(t, '^(?:[A-Z]\\.)+$') and not regexp_matches(t, '^\\p{{L}}$')) as tokens
        from ({initials()}) p join {LETTERS} c using (doc_id))"""
    shown = f"(select *, lower(array_to_string(tokens, ' ')) as name, lower(replace(coalesce({seen(_before(30))}, {seen('text')}, ''), '.', '')) as seen from {own})"
    fits = f"""(select s.*, o.gm_code as o_gm, lower(o.surname) as surname from {shown} s join ({OFFICIALS_SQL}) o on o.gm_code = s.gm_code and (s.name = lower(o.surname) or ends_with(s.name, ' ' || lower(o.surname)))
        where case when s.name in ({', '.join(repr(n) for n in COMMON)}) then s.seen <> '' and o.initials <> '' and (starts_with(lower(o.initials), s.seen) or starts_with(s.seen, lower(o.initials))) else s.seen = '' or o.initials = '' or left(s.seen, 1) = lower(left(o.initials, 1)) end)"""
    return f"select doc_id, start_char, end_char, text, min_by(o_gm, (o_gm, surname)) as gm_code, min_by(surname, (o_gm, surname)) as surname from {fits} group by doc_id, start_char, end_char, text"


def role_match() -> str:
    """Titles within 40 characters and two tokens (the letters have no lists of names after a title)."""
    n_tokens = lambda x: f"len(list_filter(string_split_regex({x}, '\\s+'), lambda t: t <> ''))"
    p = f"(select p.*, c.text as full_text from ({initials()}) p join {LETTERS} c using (doc_id))"
    parts = f"(select p.*, t.*, string_split_regex({_before(40)}, '(?i)\\b' || t.title || '\\b') as pb, string_split_regex(substr(full_text, end_char + 1, 40), '(?i)\\b' || t.title || '\\b') as pa from {p} p cross join ({TITLES_SQL}) t)"
    found = f"select *, 'before' as position, {n_tokens('pb[-1]')} as tokens from {parts} where len(pb) > 1 union all select *, 'after', {n_tokens('pa[1]')} from {parts} where len(pa) > 1"
    return f"select doc_id, start_char, end_char, text, list_name, title, position, cast(tokens as integer) as tokens from ({found}) where tokens <= 2 qualify row_number() over (partition by doc_id, start_char, end_char order by position = 'before' desc, list_name = 'publiek' desc, tokens, ord) = 1"


def classify() -> str:
    inside = f"(select p.doc_id, p.start_char, p.end_char, min_by(s.kind, (s.kind = 'salutation', s.start_char, s.end_char, s.kind)) as kind from ({initials()}) p join ({structures()}) s on s.doc_id = p.doc_id and s.start_char <= p.start_char and p.end_char <= s.end_char group by all)"
    return f"""with p as (select * from ({initials()})), r as (select distinct doc_id, start_char, end_char from ({reference_match()})), o as (select distinct doc_id, start_char, end_char from ({officials_match()})), t as (select * from ({role_match()})), s as (select * from {inside}),
        b as (select p.*, case when r.doc_id is not null then 'reference' when o.doc_id is not null then 'official' when t.list_name = 'publiek' then 'public_title' when s.kind in ('email_header', 'signature_block') then 'structure' when s.kind = 'salutation' then 'salutation' when t.list_name = 'ambtenaar' then 'servant' else 'none' end as branch
            from p left join r using (doc_id, start_char, end_char) left join o using (doc_id, start_char, end_char) left join t using (doc_id, start_char, end_char) left join s using (doc_id, start_char, end_char))
        select doc_id, start_char, end_char, text, branch, case branch when 'reference' then 'rejected' when 'official' then 'rejected' when 'public_title' then 'rejected' when 'structure' then 'auto_accepted' else 'pending' end as review_status,
            case branch when 'reference' then 'publiek_functionaris' when 'official' then 'publiek_functionaris' when 'public_title' then 'publiek_functionaris' when 'salutation' then 'burger' when 'servant' then 'ambtenaar' end as subject_role,
            round(case branch when 'reference' then 0.95 when 'official' then least(confidence + 0.05, 0.95) when 'public_title' then least(confidence + 0.05, 0.95) when 'structure' then least(confidence + 0.15, 0.95) when 'salutation' then least(confidence + 0.10, 0.95) else confidence end, 2) as confidence,
            case branch when 'reference' then 'reference_list' when 'official' then 'whitelist_gemeente' when 'public_title' then 'rule' when 'structure' then 'structure' when 'salutation' then 'structure' when 'servant' then 'rule' else 'ner' end as source,
            case when branch in ('reference', 'official', 'public_title') then null else '{V.GROUND}' end as woo_article from b"""


TERMS_SQL = "select doc_id, 0 as ord, 'stikstof' as term from letters union all select doc_id, 1, 'Uw  Kenmerk' from letters union all select doc_id, 2, 'sprak met' from letters"


def terms() -> str:
    parts = []
    for o, t in ((0, "stikstof"), (1, "uw kenmerk"), (2, "sprak met")):
        parts.append(f"select doc_id, {o} as ord, '{t}' as term, '5.1.2e' as woo_article, substr(full_text, s + 1, {len(t)}) as text, cast(s as integer) as start_char, cast(s + {len(t)} as integer) as end_char from (select *, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)::bigint + (i - 1) * {len(t)} as s from (select *, unnest(range(1, len(g))) as i from (select doc_id, text as full_text, string_split(lower(text), '{t}') as g from {LETTERS})))")
    return " union all ".join(parts)


def search(needle: str) -> str:
    n = len(needle)
    hits = f"(select doc_id, page, full_text, cast(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) as bigint) + (i - 1) * {n} as s from (select *, unnest(range(1, len(g))) as i from (select conv_id as doc_id, turn as page, text as full_text, string_split(lower(text), '{needle}') as g from conversations)))"
    around = f"case when s > 24 then '…' else '' end || substr(full_text, greatest(s - 24, 0) + 1, s - greatest(s - 24, 0)) || substr(full_text, s + 1, {n}) || substr(full_text, s + {n} + 1, 24) || case when length(full_text) > s + {n} + 24 then '…' else '' end"
    return f"select doc_id, page, substr(full_text, s + 1, {n}) as text, cast(s as integer) as start_char, cast(s + {n} as integer) as end_char, trim(regexp_replace({around}, '\\s+', ' ', 'g')) as snippet from {hits}"


EVENTS = f"({EVENTS_SQL})"
