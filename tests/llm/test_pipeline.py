"""The pipeline's stages against a brute-force version of what they have to keep."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline
from inkveil.llm import quality, queries, toxicity
from tests.llm.test_operators import components, shingles


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    top = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
        out.append(docs)
    return out


def test_filters_keep_whole_rows(spark, sf, stages):
    labels = queries.table(spark, sf, "labels")
    for before, after, operator, least in ((stages[0], stages[1], quality, 0.3), (stages[1], stages[2], toxicity, -1)):
        model = operator.fit(before, labels)
        rows = before.collect()
        scores = model.score([r.text or "" for r in rows])
        kept = [r for r, s in zip(rows, scores, strict=True) if (s >= least if operator is quality else s < 0.3)]
        assert sorted(after.collect(), key=str) == sorted(kept, key=str) and after.columns == stages[0].columns


def test_one_of_each_group_stays(stages):
    rows = sorted(stages[2].collect(), key=lambda r: r.doc_id)
    sets = [shingles(r.text) for r in rows]
    links = {i: {j for j in range(len(rows)) if i != j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])} for i in range(len(rows))}
    root = components(links)
    assert sorted(r.doc_id for r in stages[3].collect()) == [r.doc_id for i, r in enumerate(rows) if root[i] == i]


def test_repeated_ids_are_one_document(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    twice = docs.unionByName(docs)
    kept = corpus_pipeline.keep_distinct(spark, twice, sf)
    assert kept.columns == docs.columns and kept.count() == corpus_pipeline.keep_distinct(spark, docs, sf).count()


def test_rows_with_repeated_or_null_ids_are_told_apart(spark, sf):
    a, b, c = ("one two three four five six seven", "red green blue white black grey pink", "north south east west up down left")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, "quite other words than those of the third row"), (None, a), (None, b), (None, "no id at all but words of its own"), (None, "no id at all but words of its own"), (4, ""), (5, None), (4, "")]
    kept = corpus_pipeline.keep_distinct(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, a), (2, b), (3, c), rows[4], rows[7], (4, ""), (5, None)], key=str)


def test_everything_kept_is_packed(spark, sf, stages):
    packed = stages[4].groupBy("doc_id").sum("length").count()
    assert packed == stages[3].count()
    assert corpus_pipeline.run(spark, sf).count() == stages[4].count()


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_odd_tables_in_every_stage(spark, sf, monkeypatch, most):
    """Null, empty and very long texts, repeated rows, null ids, and columns called as stages call theirs, with a dot or a back-tick."""
    monkeypatch.setattr(corpus_pipeline, "MOST_BROADCAST", most)
    columns = "doc_id long, text string, `row` long, `row_` long, `a.b` string, `c``d` string, score double, label int, component_id long"
    long = " ".join(f"word{i % 9973} is here" for i in range(30_000))
    rows = [(1, long), (2, long + " again"), (3, None), (3, None), (4, ""), (None, long), (None, "quite another text of its own and nothing else"), (5, "quite other words"), (5, "quite other words")]
    docs = spark.createDataFrame([(*r, 7, 9, "x", "y", 0.5, 1, 3) for r in rows], columns)
    for name, stage in corpus_pipeline.STAGES[: -1 if most else 0]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns, name
        assert set(map(tuple, kept.collect())) <= set(map(tuple, docs.collect())), name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    distinct = corpus_pipeline.keep_distinct(spark, docs, sf).collect()
    assert sorted(((r.doc_id, (r.text or "")[:5]) for r in distinct), key=str) == sorted([(1, "word0"), (3, ""), (4, ""), (None, "quite"), (5, "quite")], key=str)
    assert all((r.row, r.row_, r["a.b"], r["c`d"]) == (7, 9, "x", "y") for r in distinct)
    pieces = corpus_pipeline.pack(spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == 6 and corpus_pipeline.pack(spark, docs.limit(0), sf).count() == 0
