"""Decontamination, collocations and importance resampling against brute force, with nulls, empty and long texts, ties, repeated
rows, empty tables, and columns that are called as the operators' own."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkveil.llm import collocations, decontaminate, importance, queries, words
from inkveil.llm.common import materialise

_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BITS = ["Alpha", "beta", "Ünder", "x", "世界", "a1", "9", "É", "the", "of"]
GAPS = [" ", "  ", "\n", "-", ", ", "\t", "_", "...", "\x00", "'"]


def words_of(text):
    return _WORD.findall((text or "").translate(_ASCII_LOWER))


def random_text(rnd, n, bits=BITS):
    return "".join(rnd.choice(bits) + rnd.choice(GAPS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Documents and items that share passages, with every odd case."""
    rnd = random.Random(5)
    items = [(k, random_text(rnd, rnd.choice([1, 2, 3, 9, 10, 11, 30, 40]))) for k in range(40)]
    items += [(7, items[3][1]), (100, items[5][1]), (None, random_text(rnd, 12)), (101, None), (102, ""), (103, " .. "), (9, "The of"), (104, "x " * 400)]
    docs = []
    for k in range(150):
        text = random_text(rnd, rnd.choice([0, 1, 5, 19, 20, 40, 200]))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            part = words_of(rnd.choice(items)[1])
            cut = rnd.randint(0, len(part))
            text += " | " + "; ".join(part[cut:] + part[:cut]).upper() + " "
        docs.append((k, text))
    long = " ".join(f"w{i % 977}" for i in range(40_000)) + " " + (items[6][1] or "")
    docs += [(200, long), (201, None), (202, ""), (203, "###"), (5, docs[5][1]), (5, docs[6][1]), (None, docs[8][1]), (None, docs[8][1]), (204, "b" * 5000 + " " + items[0][1]), (205, "x " * 3000)]
    mine = "doc_id long, text string, n_words string, spans int, items int, score double, weight string, rank int, lang string"
    langs = ["en", None, "und", "de"]
    documents = spark.createDataFrame([(i, t, "a", 1, 2, 0.5, "w", 3, langs[k % 4]) for k, (i, t) in enumerate(docs)], mine)
    return docs, items, documents, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int"), langs


def brute_contamination(docs, items, window=10):
    found = []
    wanted = defaultdict(set)
    for item, text in items:
        own = words_of(text)
        size = min(window, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            wanted[tuple(own[k : k + size])].add(item)
    sizes = {len(w) for w in wanted}
    for doc, text in docs:
        own, hit, named = words_of(text), set(), set()
        for size in sizes:
            for k in range(len(own) - size + 1):
                if (w := tuple(own[k : k + size])) in wanted:
                    hit |= set(range(k, k + size))
                    named |= {str(i) for i in wanted[w] if i is not None}
        found.append((doc, len(own), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(found, key=str)


@pytest.mark.parametrize("block", [1 << 24, 3000])
@pytest.mark.parametrize("at_once", [1 << 18, 7])
def test_contamination(odd, monkeypatch, block, at_once):
    docs, items, documents, benchmark, _ = odd
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontaminate, "AT_ONCE", at_once)
    found = decontaminate.contaminated(documents, benchmark)
    rows = decontaminate.contamination_digests(found).collect()
    want = brute_contamination(docs, items)
    assert sorted(map(tuple, rows), key=str) == want and any(r[2] for r in want) and not all(r[5] for r in want)
    texts = defaultdict(list)
    for doc, text in docs:
        texts[doc].append(len(words_of(text)))
    for r in found.collect():
        ends = [0, *(x for s in r.spans for x in s), r.n_words]
        assert ends == sorted(ends) and all(s.begin < s.end for s in r.spans) and all(a.end < b.begin for a, b in zip(r.spans, r.spans[1:], strict=False))
        assert r.n_words in texts[r.doc_id] and r["items"] == sorted(set(r["items"]))


def test_contamination_of_empty_tables(odd):
    docs, _, documents, benchmark, _ = odd
    assert decontaminate.contaminated(documents.limit(0), benchmark).count() == 0
    clean = decontaminate.contamination_digests(decontaminate.contaminated(documents, benchmark.limit(0))).collect()
    assert len(clean) == len(docs) and not any(r.contaminated or r.n_hit or r.n_items for r in clean)


def test_documents_without_any_passage(spark, odd):
    """Not one shingle of an item is anywhere, or is in some slices only."""
    _, _, _, benchmark, _ = odd
    clean = spark.createDataFrame([(k, "nothing of the kind " * 9) for k in range(30)], "doc_id long, text string").repartition(7)
    assert not any(r.contaminated for r in decontaminate.contamination_digests(decontaminate.contaminated(clean, benchmark.filter("item_id = 104"))).collect())
    mixed = clean.unionByName(spark.createDataFrame([(99, "x " * 400)], "doc_id long, text string"))
    assert [r.doc_id for r in decontaminate.contamination_digests(decontaminate.contaminated(mixed, benchmark.filter("item_id = 104"))).filter("contaminated").collect()] == [99]


def test_equal_hashes_are_told_apart_by_bytes(odd, monkeypatch):
    docs, items, documents, benchmark, _ = odd
    real = words.word_hashes
    monkeypatch.setattr(decontaminate, "word_hashes", lambda *a: real(*a) % np.uint64(3))
    windows = decontaminate.item_windows(benchmark).toArrow()
    block = decontaminate.Block(windows)
    tokens = {int(s): decontaminate.Tokens(block.shingle[block.width == s]) for s in np.unique(block.width)}
    prefixes = decontaminate.Prefixes(block, {s: np.ones(len(t.tokens), np.int64) for s, t in tokens.items()}, tokens)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in docs[:60]]), "text": pa.array([t or "" for _, t in docs[:60]])})
    out = decontaminate._found(batch, prefixes)
    n_hit = [sum(s["end"] - s["begin"] for s in spans) for spans in out.column("spans").to_pylist()]
    assert sorted(zip(out.column("doc_id").to_pylist(), n_hit, strict=True)) == sorted((r[0], r[2]) for r in brute_contamination(docs[:60], items))


def brute_collocations(rows, most, least, top, absorbed):
    count, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(_ASCII_LOWER)):
            own = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(own)
            for k in range(1, most + 1):
                count[lang].update(tuple(own[i : i + k]) for i in range(len(own) - k + 1))
    out = []
    for lang, f in count.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        parts = defaultdict(int)
        for p, a in candidates.items():
            for k in range(1, len(p)):
                for i in range(len(p) - k + 1):
                    parts[p[i : i + k]] = max(parts[p[i : i + k]], a)
        ranked = []
        for p, a in candidates.items():
            score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if not (p in parts and 100 * parts[p] >= absorbed * a):
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("most", "least", "top", "absorbed"), [(5, 3, 2000, 100), (3, 2, 5, 50), (4, 1, 40, 100), (1, 2, 9, 100)])
def test_collocations(odd, monkeypatch, most, least, top, absorbed):
    docs, _, documents, _, langs = odd
    want = brute_collocations([(langs[k % 4], t) for k, (_, t) in enumerate(docs)], most, least, top, absorbed)
    for slice_bytes, bits in ((8 << 20, 1 << 27), (500, 1 << 10)):
        monkeypatch.setattr(collocations, "SLICE", slice_bytes)
        monkeypatch.setattr(collocations, "MAX_BITS", bits)
        assert sorted(map(tuple, collocations.collocations(documents, most, least, top, absorbed).collect())) == want
    assert want or most == 1


def test_phrases_of_one_hash_are_counted_apart(monkeypatch):
    monkeypatch.setattr(collocations, "run_hashes", lambda own, size: np.zeros(max(0, len(own) - size + 1), np.uint64))
    every = collocations.Bitmap(1 << 10)
    every.held[:] = ~np.uint64(0)
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a b a b. b a", "b a a"]), "lang": pa.array(["x", "y"])})
    got = collocations.Slice(batch).counted(2, every).to_pylist()
    assert sorted((r["lang"], r["phrase"], r["n"]) for r in got) == [("x", "a b", 2), ("x", "b a", 2), ("y", "a a", 1), ("y", "b a", 1)]


def test_scores_beyond_64_bits(spark):
    phrases = spark.createDataFrame([("en", "a", 10**15, 1), ("en", "b", 3 * 10**15, 1), ("en", "a b", 10**15 - 7, 2)], "lang string, phrase string, n long, size int")
    row = collocations.scored(phrases, spark.createDataFrame([("en", 10**17)], "lang string, n long")).first()
    assert row.score == 1000 * (10**15 - 7) * 10**17 // (10**15 * 3 * 10**15)


def test_collocations_of_empty_tables(odd):
    assert collocations.collocations(odd[2].limit(0)).count() == 0
    assert collocations.collocations(odd[2].filter("doc_id in (201, 202)")).count() == 0


def brute_importance(docs, items, longest, least, share, seed):
    def hashed(text):
        own = words_of(text)
        return [zlib.crc32(" ".join(own[i : i + k]).encode()) % 10_000 for k in range(1, longest + 1) for i in range(len(own) - k + 1)]

    raw, target = Counter(), Counter()
    for _, text in docs:
        raw.update(hashed(text))
    for _, text in items:
        target.update(hashed(text))
    s, t = sum(raw.values()), sum(target.values())
    out = []
    for doc, text in docs:
        own = hashed(text)
        weight = sum(math.floor(1000 * math.log((target[b] + 1) * (s + 10_000) / ((raw[b] + 1) * (t + 10_000)))) for b in own)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text)) >= least])
    drawn = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(drawn[: share * len(drawn) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize(("longest", "least", "share"), [(1, 20, 10), (3, 1, 100), (2, 5, 33), (1, 10**9, 50)])
def test_importance(odd, longest, least, share):
    docs, items, documents, benchmark, _ = odd
    got = importance.resample(documents, benchmark, longest, least, share)
    assert sorted(map(tuple, got.collect()), key=str) == brute_importance(docs, items, longest, least, share, 2024)


def test_importance_of_empty_tables(odd):
    docs, _, documents, benchmark, _ = odd
    assert importance.resample(documents.limit(0), benchmark).count() == 0
    assert sorted(map(tuple, importance.resample(documents, benchmark.limit(0)).collect()), key=str) == brute_importance(docs, [], 1, 20, 10, 2024)


def test_crc_registers_equal_zlib():
    rnd = random.Random(2)
    parts = [bytes(rnd.randrange(256) for _ in range(n)) for n in [0, 1, 2, 3, 63, 64, 65, 66, 300, 7, 7, 0, 1]]
    data, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
    state = importance.advance(np.full(len(parts), 0xFFFFFFFF, np.uint32), data, ends - [len(p) for p in parts], ends)
    assert [(int(x) ^ 0xFFFFFFFF) for x in state] == [zlib.crc32(p) for p in parts]


def test_ranks_of_equal_rows_are_dealt_over_ranges(spark):
    rows = spark.range(0, 4000).selectExpr("cast(null as long) as doc_id", "5L as n_features", "20L as n_words", "7L as score")
    out = importance.ranked(materialise(rows, "equal"), "n_words >= 20", [F.desc("score"), F.asc_nulls_last("doc_id")], 10)
    assert sorted(r.rank for r in out.filter("rank is not null").collect()) == list(range(1, 401)) and out.count() == 4000


def test_words_end_with_their_text():
    column = pa.array(["skip", "ab", "cd e", "", "É世"]).slice(1)
    data, offsets = words.text_buffer(column)
    start, stop, first = words.word_edges(data, offsets, words.ALNUM)
    assert [data[a:b].tobytes().decode() for a, b in zip(start, stop, strict=True)] == ["ab", "cd", "e", "É世"] and first.tolist() == [0, 1, 3, 3, 4]


@pytest.mark.parametrize("name", ["op11_decontamination", "op12_collocations", "op13_importance"])
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf)
    want = con.execute(f"select {', '.join(got.columns)} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
