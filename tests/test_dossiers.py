"""Dossiers: propagated decisions, connected groups, copies of pages, and analysing anew after changes of lists."""

import datetime as dt
import random

from pyspark.sql import functions as F

from inkveil.operators import classify, copies, dossiers, groups, incremental, tier1
from inkveil.plans import queries

ROWS = "det_id long, doc_id long, entity_type string, text string, review_status string, woo_article string, reviewed_at timestamp, scope string"


def union_find(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return find


def test_connected_groups(spark):
    rnd = random.Random(1)
    rows = [(rnd.randint(0, 300), f"l{rnd.randint(0, 260)}") for _ in range(420)] + [(k, f"chain{k // 2}") for k in range(1000, 1060)] + [(k + 1, f"chain-{k}") for k in range(1000, 1059, 2)]
    rows += [(1000, "chain-x"), (1001, "chain-x")] + [(k, f"c{k}") for k in range(2000, 2100)] + [(k + 1, f"c{k}") for k in range(2000, 2100)]
    by_link = {}
    for n, link in rows:
        by_link.setdefault(link, n)
    find = union_find([(by_link[link], n) for n, link in rows])
    got = {r.node: r.label for r in groups.connected(spark.createDataFrame(rows, "node long, link string")).collect()}
    assert got == {n: find(n) for n, _ in rows}
    assert groups.connected(spark.createDataFrame([(None, "a"), (5, None)], "node long, link string")).count() == 0


def at(hour):
    return dt.datetime(2024, 1, 1, hour)


def test_decisions_hold_for_the_dossier(spark):
    dossier = spark.createDataFrame([("A", 1), ("A", 2), ("B", 2), ("B", 3), ("C", 9)], "dossier_id string, doc_id long")
    rows = [
        (1, 1, "persoon", "Ünal van Dam", "accepted", "5.1.2e", at(1), None), (2, 2, "persoon", "unal  VAN dam", "pending", None, None, None), (3, 3, "persoon", "Unal van Dam", "deferred", "x", None, None),
        (4, 9, "persoon", "Unal van Dam", "pending", None, None, None), (5, 2, "adres", "Unal van Dam", "pending", None, None, None), (6, 3, "persoon", "Bos", "rejected", None, at(2), "all"),
        (7, 1, "persoon", "Bos", "pending", "5.2", None, None), (8, 2, "persoon", "Dal", "rejected", None, at(5), "document"), (9, 2, "persoon", "DAL", "pending", None, None, None),
        (10, 1, "persoon", "Dal", "accepted", "5.1.2e", at(3), None), (11, 3, "persoon", "dal", "pending", None, None, None), (12, 1, "persoon", " ", "accepted", None, at(9), None),
        (13, 2, "persoon", "", "pending", None, None, None), (14, 1, "persoon", "Unal van Dam", "rejected", None, at(4), None), (15, 2, "persoon", "Unal van Dam", "edited", None, None, None),
    ]
    got = {r.det_id: (r.review_status, r.woo_article, r.propagated_from) for r in dossiers.propagate(spark.createDataFrame(rows, ROWS), dossier).collect()}
    want = {r[0]: (r[4], r[5], None) for r in rows}
    # The later decision of the group wins; Bos reaches document 1 only where document 2 holds the name as well; Dal is decided in document 2 for itself.
    want |= {2: ("rejected", None, 14), 3: ("rejected", "x", 14), 9: ("rejected", None, 8)}
    want[11] = ("accepted", "5.1.2e", 10)
    assert got == want
    panel = {r.propagated_from: (r.n, r.docs) for r in dossiers.decision_panel(dossiers.propagate(spark.createDataFrame(rows, ROWS), dossier)).collect()}
    assert panel == {14: (2, 2), 8: (1, 1), 10: (1, 1)}


def test_page_copies_and_rules(spark):
    pages = spark.createDataFrame([(1, 0, "Een  Tekst"), (2, 3, "een tekst "), (3, 0, "anders"), (4, 0, None), (5, 0, "")], "doc_id long, page int, text string")
    assert sorted((r.doc_id, r.first_doc, r.first_page, r.copies) for r in dossiers.page_copies(pages).collect()) == [(1, 1, 0, 2), (2, 1, 0, 2), (3, 3, 0, 1), (4, 4, 0, 1), (5, 5, 0, 1)]
    dated = spark.createDataFrame([(1, dt.date(2019, 1, 1)), (2, dt.date(2020, 1, 1)), (3, None)], "doc_id long, document_date date")
    assert [r.over_five_years for r in dossiers.five_year_rule(dated, "2025-01-01").orderBy("doc_id").collect()] == [True, False, None]


def exact(text):
    own = (text or "").lower().split()
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def test_near_copies(spark):
    """All pairs of 0.85 or more are in one class, at least 0.95 of those of 0.75, and no class links texts that are not alike."""
    rnd = random.Random(7)
    rows = []
    for k in range(60):
        base = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(30, 120))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(rnd.choice([0, 1, 3])):
            own = list(base)
            for _ in range(rnd.randint(0, 2)):
                own[rnd.randrange(len(own))] = f"x{rnd.randint(0, 99)}"
            rows.append((len(rows), "  ".join(own).upper()))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", "kort", "Kort", rows[0][1]])]
    got = {r.key: r for r in copies.near_copies(spark.createDataFrame(rows, "key long, text string")).collect()}
    sets, pairs = [exact(t) for _, t in rows], []
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]):
                pairs.append((j, i, len(sets[i] & sets[j]) / len(sets[i] | sets[j])))
    together = [got[i]["class"] == got[j]["class"] for i, j, _ in pairs]
    assert all(t for t, (_, _, s) in zip(together, pairs, strict=True) if s >= 0.85) and sum(together) >= 0.95 * len(pairs) > 20
    find = union_find([(i, j) for i, j, _ in pairs])
    assert all(find(r["class"]) == find(k) for k, r in got.items())
    assert [got[k].n_shingles for k in range(len(rows))] == [len(s) for s in sets] and got[len(rows) - 1].similarity == 1.0
    assert copies.near_copies(spark.createDataFrame([], "key long, text string")).count() == 0


def test_recall_on_given_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("key"), "text")
    talks = spark.read.parquet(f"{sf}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "text")
    for table in (docs, talks):
        rows = table.collect()
        sets = [(r.key, {tuple(w) for w in exact(r.text)}) for r in rows]
        got = {r.key: r["class"] for r in copies.near_copies(table).collect()}
        pairs = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and 4 * len(x & y) >= 3 * len(x | y)]
        find = union_find(pairs)
        assert sum(got[a] == got[b] for a, b in pairs) >= 0.95 * len(pairs) and all(find(c) == find(k) for k, c in got.items())


def test_refreshed_decisions_equal_a_full_run(spark, sf):
    """Random edits of the contact list, one after the other: as deciding everything anew, with few documents read."""
    rnd = random.Random(3)
    letters = queries.letters(spark, sf)
    spans = tier1.detect(letters, as_of="2025-01-01", before=30).cache()
    index = incremental.evidence_index(spans).cache()
    listed = [(r.kind, r.value) for r in queries.contacts(spark, sf).collect()]
    table = lambda rows: spark.createDataFrame(rows, "kind string, value string")
    decide = lambda rows: (lambda s: classify.tier1_status(s, None, table(rows)))
    kept = listed[: len(listed) // 2]
    decisions, documents = decide(kept)(spans), letters.count()
    for _ in range(3):
        after = [c for c in kept if rnd.random() > 0.2] + rnd.sample(listed, 2)
        docs = incremental.touched(index, incremental.changed_contacts(table(kept), table(after)))
        assert 0 < docs.count() < documents
        decisions, kept = incremental.refreshed(decisions, spans, docs, decide(after)), after
    plain = lambda df: sorted(map(str, df.select("doc_id", "start_char", "end_char", "entity_type", "review_status", "source", "woo_article").collect()))
    assert plain(decisions) == plain(decide(kept)(spans))


def test_changed_names_touch_their_document(spark):
    spans = spark.createDataFrame([(1, "persoon", "2", "A. van Ünal"), (2, "persoon", "2", "a. van unal"), (3, "url", "1", "https://x.nl/a/b?c")], "doc_id long, entity_type string, tier string, text string")
    index = incremental.evidence_index(spans)
    names = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, name string")
    found = lambda changes: sorted(r.doc_id for r in incremental.touched(index, changes).collect())
    assert found(incremental.changed_names(names((2, "A. van Unal")), names((2, "A. VAN UNAL"), (9, "A. van Unal")))) == []
    assert found(incremental.changed_names(names((2, "x")), names((2, "A. van Unal")))) == [2]
    gm = lambda *rows: spark.createDataFrame(list(rows), "gm_code int, surname string, initials string")
    assert found(incremental.changed_officials(gm((1, "Van Ünal", "a")), gm((1, "Van Unal", "b")))) == [1, 2]
    contact = lambda *rows: spark.createDataFrame(list(rows), "kind string, value string")
    assert found(incremental.changed_contacts(contact(("url", "x")), contact(("url", "https://X.nl/a/")))) == [3]


def test_links_of_one_member_join_nothing(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (2, "c"), (4, "c"), (5, "d")], "node long, link string")
    whole = {r.node: r.label for r in groups.connected(rows).collect()}
    assert whole == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}
    assert {r.node: r.label for r in groups.connected(rows, lone=False).collect()} == {k: whole[k] for k in (1, 2, 4)}
