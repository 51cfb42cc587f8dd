"""Streams: late, repeated and out-of-order rows, restarts from a checkpoint, and the same results as in batch."""

import datetime as dt
import random

import pytest

from inkveil.operators import undo
from inkveil.streaming import documents

DOCS = "doc_id long, sender string, ts timestamp, text string"


def at(minute):
    return dt.datetime(2024, 1, 1, 12, 0) + dt.timedelta(minutes=minute)


def run(stream, out, checkpoint):
    stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


@pytest.fixture
def place(tmp_path):
    return str(tmp_path)


def read(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def put(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_counts_by_window_drop_late_rows(spark, place):
    schema = "ts timestamp, entity_type string"
    for rows in ([(at(1), "bsn"), (at(3), "bsn"), (at(12), "iban")], [(at(100), "bsn")], [(at(2), "bsn"), (at(95), "iban")], [(at(400), "bsn")], [(at(401), "bsn")]):
        put(spark, rows, schema, f"{place}/in")
        run(documents.counts_by_window(read(spark, schema, f"{place}/in")), f"{place}/out", f"{place}/check")
    got = sorted((r.begin, r.entity_type, r.n) for r in spark.read.parquet(f"{place}/out").collect())
    assert got == [(at(0), "bsn", 2), (at(10), "iban", 1), (at(90), "iban", 1), (at(100), "bsn", 1)]


def deliveries():
    text = "Mail klant1@voorbeeld1.nl of anders@x.nl, bel 06-12345678."
    return [
        [(1, "a", at(0), text), (2, "b", at(5), "niets"), (3, "a", at(20), text)],
        [(1, "a", at(0), text), (4, "a", at(10), text)],  # delivered again, and out of order
        [(5, "a", at(90), text), (6, "b", at(91), text)],
        [(7, "a", at(1), text), (5, "a", at(90), text)],  # too late, and delivered again
        [(8, "c", at(600), text)],
        [(9, "c", at(1200), text)],
    ]


def test_sessions_of_late_and_repeated_deliveries(spark, place):
    contacts = spark.createDataFrame([("email", "Klant1@voorbeeld1.nl"), ("email", "KLANT1@voorbeeld1.nl")], "kind string, value string")
    for part in deliveries():
        put(spark, part, DOCS, f"{place}/in")
        # Each part is a run of its own from the checkpoint.
        run(documents.delivery_sessions(read(spark, DOCS, f"{place}/in"), contacts), f"{place}/out", f"{place}/check")
    got = sorted((r.sender, r.begin, r.end, r.n, r.public) for r in spark.read.parquet(f"{place}/out").collect())
    assert got == [("a", at(0), at(50), 9, 3), ("a", at(90), at(120), 3, 1), ("b", at(91), at(121), 3, 1), ("c", at(600), at(630), 3, 1)]
    in_time = [r for part in deliveries() for r in part if r[0] not in (7, 9)]
    batch = documents.delivery_sessions(spark.createDataFrame(in_time, DOCS), contacts)
    assert sorted((r.sender, r.begin, r.end, r.n, r.public) for r in batch.collect()) == got


def test_detection_on_a_stream(spark, place):
    put(spark, [(1, "x 06-12345678"), (2, None)], "doc_id long, text string", f"{place}/in")
    run(documents.detect_stream(read(spark, "doc_id long, text string", f"{place}/in")), f"{place}/out", f"{place}/check")
    assert [r.text for r in spark.read.parquet(f"{place}/out").collect()] == ["06-12345678"]
    documents.decide_by_batch(read(spark, "doc_id long, text string", f"{place}/in"), lambda b: b.groupBy().count(), f"{place}/decided", f"{place}/check2").awaitTermination()
    assert spark.read.parquet(f"{place}/decided").first()["count"] == 2


def commands(seed, n=400):
    rnd, out = random.Random(seed), []
    for seq in range(n):
        action = rnd.choices(["push", "undo", "redo", "clear"], [6, 4, 3, 0.1])[0]
        changes = [(rnd.randint(0, 9), rnd.choice(["pending", "accepted", None]), rnd.choice(["accepted", "rejected"]), rnd.choice(["5.2", None]), rnd.choice(["5.1.2e", None])) for _ in range(rnd.randint(0, 4))]
        out.append((rnd.randint(0, 3), seq, action, changes if action == "push" else None))
    return out


def simulated(rows, depth):
    """The same in the plainest way: whole lists of batches, states changed one by one."""
    state, done, redo, n = {}, {}, {}, {}
    for session, _, action, changes in rows:
        a, b = done.setdefault(session, []), redo.setdefault(session, [])
        made = []
        if action == "push":
            a.append(changes or [])
            del a[:-depth]
            b.clear()
            made = [(c[0], c[2], c[4]) for c in changes or []]
        elif action == "undo" and a:
            b.append(a.pop())
            made = [(c[0], c[1], c[3]) for c in b[-1][::-1]]
        elif action == "redo" and b:
            a.append(b.pop())
            made = [(c[0], c[2], c[4]) for c in a[-1]]
        elif action == "clear":
            a.clear(), b.clear()
        for det, status, ground in made:
            old = state.get((session, det), (None, None))
            state[session, det] = (status or old[0], ground or old[1])
            n[session, det] = n.get((session, det), 0) + 1
    return sorted((*k, *v, n[k]) for k, v in state.items())


def plain(df):
    return sorted((r.session, r.det_id, r.status, r.ground, r.n) for r in df.collect())


@pytest.mark.parametrize("depth", [100, 3])
def test_batches_are_undone_in_opposite_order(spark, depth):
    rows = commands(1)
    assert plain(undo.states(undo.changes_of(spark.createDataFrame(rows, undo.COMMANDS).repartition(5), depth))) == simulated(rows, depth)
    one = [(0, 1, "push", [(7, "pending", "accepted", None, None), (7, "accepted", "rejected", None, None)]), (0, 2, "undo", None)]
    assert plain(undo.states(undo.changes_of(spark.createDataFrame(one, undo.COMMANDS)))) == [(0, 7, "pending", None, 4)]
    assert undo.changes_of(spark.createDataFrame([], undo.COMMANDS)).count() == 0


def test_undo_on_a_stream_that_restarts(spark, place):
    rows = commands(2, 120)
    for k in range(0, 120, 40):
        again = rows[max(0, k - 5) : k]  # repeated deliveries
        put(spark, again + rows[k : k + 40][::-1], undo.COMMANDS, f"{place}/in")
        run(undo.changes_of_stream(read(spark, undo.COMMANDS, f"{place}/in"), 5), f"{place}/out", f"{place}/check")
    assert plain(undo.states(spark.read.parquet(f"{place}/out"))) == simulated(rows, 5)


def test_sweeps_are_one_command(spark):
    rows = spark.createDataFrame([(0, 5, 1, "pending", "x"), (0, 5, 2, "deferred", None)], "session long, seq long, det_id long, review_status string, woo_article string")
    log = undo.sweep_commands(rows, "accepted", "5.1.2e").unionByName(spark.createDataFrame([(0, 6, "undo", None)], undo.COMMANDS))
    assert plain(undo.states(undo.changes_of(log))) == [(0, 1, "pending", "x", 2), (0, 2, "deferred", "5.1.2e", 2)]
