"""The ten operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows, and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from inkveil.llm import bpe, embeddings, media, ngram_join, packing, quality, queries, token_counts, toxicity, url_filter, wavelet
from inkveil.llm.common import materialise
from inkveil.llm.components import connected_components
from inkveil.llm.tokenizing import from_json

MULTI, JSON = queries.vocabulary("byte_bpe_multi_50k.tiktoken"), queries.vocabulary("byte_bpe_50k.json")
PIECES = ["a", "b", "th", "e ", " ", "  ", "\n", "\t", "'s", "'re", "don't", "1", "23", "é", "世界", "!", "##", "\u00a0", "😀", "xxxxx", "ing", "\u3000", "½", "_", "<|endoftext|>", "<|endof"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def odd(spark):
    """Null id, null and empty texts, a long text, repeated rows, and columns that the operators' own results are called."""
    long = " ".join(f"w{i % 977} naïve" for i in range(30_000))
    rows = [(1, "Hello world, it's me"), (2, None), (3, ""), (4, long), (5, "Hello world, it's me"), (5, "Hello world, it's me"), (None, "no id"), (7, "<|endoftext|> x")]
    columns = "doc_id long, text string, score double, n_tokens string, ids string, component_id int, start int, part int, label int"
    return spark.createDataFrame([(*r, 0.5, "x", "y", 1, 2, 3, 4) for r in rows], columns)


def shapes(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 60))) for _ in range(n)] + ["etaoin" * 60, "世界" * 99, "é" * 120, "a" * 300, " " * 70]


def expected(library, odd, end):
    return [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids + [end]) for r in odd.collect()]


def test_tree_encoding_equals_the_library():
    codec = bpe.TreeCodec(MULTI, leaf=16)
    for text in shapes(800):
        ids = codec.encode(text)
        assert np.array_equal(ids, codec.plain(text)) and codec.decode(ids) == text.encode()


def test_round_trip_of_documents(spark, odd):
    plain = bpe.codec(MULTI).plain
    want = sorted((r.doc_id or 0, hashlib.sha256(plain(r.text or "").astype("<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect())
    assert sorted((r.doc_id or 0, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digests(odd, MULTI).collect()) == want
    assert bpe.round_trip_digests(odd.limit(0), MULTI).count() == 0


def test_fast_tokenizer_equals_the_library(library):
    own = from_json(JSON)
    assert own.encoding is not None
    for text in shapes(400, 2):
        assert own.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_every_prefix_count(library):
    own = token_counts.PrefixCounter(JSON)
    for text in [t[:60] for t in shapes(150, 3)]:
        table = own.counts(text)
        assert len(table) == len(text.encode()) + 1
        for j in range(len(text) + 1):
            assert table[len(text[:j].encode())] == len(library.encode(text[:j], add_special_tokens=False).ids)
        raw = token_counts.pack_counts(table)
        assert token_counts.count_at(raw, 10**9) == table[-1] and table[token_counts.longest_prefix(raw, 3)] <= 3


@pytest.mark.parametrize("step", [1, 200])
def test_stored_prefixes_answer_as_the_counts_do(step):
    rnd = np.random.default_rng(3)
    for n in (0, 1, 511, 512, 513, 1023, 1024, 5000):
        counts = np.concatenate([[0], np.cumsum(rnd.integers(-1, step + 1, n))]).astype(np.int32)
        raw = token_counts.pack_counts(counts)
        assert np.array_equal(token_counts.unpack_counts(raw), counts)
        assert all(token_counts.count_at(raw, i) == counts[i] for i in range(0, n + 1, 97)) and token_counts.count_at(raw, n + 9) == counts[n]
        assert token_counts.longest_prefix(raw, 40) == max(i for i in range(n + 1) if counts[i] <= 40)


def test_forgetting_pieces_changes_nothing(monkeypatch):
    want = [token_counts.PrefixCounter(JSON).counts(t) for t in shapes(20, 5)]
    monkeypatch.setattr(token_counts, "MEMORY", 300)
    monkeypatch.setattr(token_counts, "LONG_PIECE", 3)
    own = token_counts.PrefixCounter(JSON)
    assert all(np.array_equal(own.counts(t), w) for t, w in zip(shapes(20, 5), want, strict=True))


def test_counts_of_documents(spark, odd, library):
    want = sorted((d or 0, len(i) - 1) for d, i in expected(library, odd, 0))
    rows = token_counts.prefix_counts(odd, JSON).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == want
    assert all(len(token_counts.unpack_counts(r.prefixes)) == r.n_bytes + 1 for r in rows)
    assert token_counts.prefix_counts(odd.limit(0), JSON).count() == 0


@pytest.mark.parametrize("budget", [0, 3, 1024])
def test_budget_is_answered_from_stored_prefixes(spark, odd, library, budget):
    n_tokens = lambda text: len(library.encode(text, add_special_tokens=False).ids)
    rows = token_counts.within_budget(materialise(token_counts.prefix_counts(odd, JSON), "prefixes"), budget).collect()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert len(rows) == odd.count()
    for r in rows:
        text = texts[r.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n_tokens(text), n_tokens(text) > budget)
        assert r.fit_tokens <= budget and n_tokens(text.encode()[: r.fit_bytes].decode(errors="ignore")) == r.fit_tokens
        if len(text) < 100:
            assert r.fit_bytes == max(len(text[:k].encode()) for k in range(len(text) + 1) if n_tokens(text[:k]) <= budget)


@pytest.mark.parametrize("window", [8, 1024])
def test_packing(spark, odd, library, window):
    pieces = packing.pack(odd, JSON, window=window).collect()
    stream = {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length
        for k, i in enumerate(ids):
            assert p.offset + k < window and stream.setdefault(p.sequence_id * window + p.offset + k, i) == i
    want = sorted(i for _, ids in expected(library, odd, 0) for i in ids)
    assert sorted(stream) == list(range(len(want))) and sorted(stream.values()) == want
    assert sum(p.length for p in pieces) == len(want)
    assert {(p.doc_id, p.doc_tokens) for p in pieces} == {(d, len(i)) for d, i in expected(library, odd, 0)}
    assert packing.pack(odd.limit(0), JSON).count() == 0


def test_wavelet_matrix():
    ids = np.random.default_rng(1).integers(0, 300, 3000).astype(np.uint32)
    doc_ids, lengths, m = wavelet.from_file(wavelet.to_file([5, None], np.array([1000, 2000]), ids))
    assert doc_ids == [5, None] and lengths.tolist() == [1000, 2000] and np.array_equal(m.ids(), ids)
    for i in range(0, 3000, 97):
        t = int(ids[i])
        assert m.access(i) == t and m.rank(t, i) == (ids[:i] == t).sum() and m.select(t, m.rank(t, i)) == i
    assert m.count(299) == (ids == 299).sum() and m.rank(100_000, 3000) == 0 and m.select(7, 10**6) == -1


def test_select_goes_up_the_planes_once(monkeypatch):
    ids = np.concatenate([np.random.default_rng(2).integers(0, 9, 2000), np.zeros(1500), np.full(1600, 8)]).astype(np.uint32)
    m = wavelet.WaveletMatrix.build(ids)
    descents, narrow = [], wavelet.WaveletMatrix._narrow
    monkeypatch.setattr(wavelet.WaveletMatrix, "_narrow", lambda *a: descents.append(a) or narrow(*a))
    for t in range(9):
        at = np.flatnonzero(ids == t)
        for k in (*range(0, len(at), 89), len(at) - 1):
            descents.clear()
            assert m.select(t, k) == at[k] and len(descents) <= 2
        assert m.select(t, len(at)) == -1


def test_shards(spark, odd, library):
    files = wavelet.write_shards(odd.filter("doc_id is not null"), JSON, shard_tokens=100)
    rows = sorted(wavelet.read_shards(files).collect(), key=lambda r: r.start)
    at = 0
    for r, (d, ids) in zip(rows, sorted(x for x in expected(library, odd, 2) if x[0] is not None), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert sum(r.n for r in wavelet.count_token(files, 2).collect()) == len(rows)
    assert wavelet.corpus_positions(odd, JSON).count() == odd.count()
    assert wavelet.corpus_positions(odd.limit(0), JSON).count() == 0


def test_media(spark, odd):
    by_text = {}
    stored = materialise(media.features(media.store(odd)), "tensors")
    shown = {(r.doc_id, r.media_sha256): r.feature for r in media.digests(stored).collect()}
    for r, source in zip(sorted(stored.collect(), key=lambda r: (r.doc_id or 0)), sorted(odd.collect(), key=lambda r: (r.doc_id or 0)), strict=True):
        raw = (source.text or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        feature = shown[r.doc_id, r.media_sha256]
        assert by_text.setdefault(source.text or "", feature) == feature
        clips = pa.ipc.open_stream(r.tensors).read_all()["mel"].combine_chunks().to_numpy_ndarray()
        assert clips.shape[1:] == (media.CLIP, media.MELS)
    assert media.digests(media.features(media.store(odd.limit(0)))).count() == 0


def test_the_media_query_stores_media_and_tensors(spark, sf, monkeypatch):
    written = {}
    monkeypatch.setattr(queries, "materialise", lambda df, name: written.setdefault(name, materialise(df, name)), raising=False)
    rows = queries.op5_media(spark, sf)
    assert {"media", "tensors"} == set(written) and not {"spans", "tensors"} & set(rows.columns)
    assert all(written[n].count() == written[n].filter(f"length({n}) > 0").count() == rows.count() for n in written)


def slow_features(payload):
    """Plain loops: every sample filtered and every second kept, each frame's transform and bands one by one, segments by walking."""
    x = [(b - 128) / 128 for b in payload]
    taps = [np.sinc((t - 15.5) / 2) / 2 * (0.54 - 0.46 * np.cos(2 * np.pi * t / 31)) for t in range(32)]
    y = [sum(taps[k] / sum(taps) * x[n - k] for k in range(32) if 0 <= n - k < len(x)) for n in range(0, len(x), 2)]
    y += [0.0] * (200 - len(y))
    hertz = lambda m: 700 * (10 ** (m / 2595) - 1)
    top = 2595 * np.log10(1 + 4000 / 700)
    edges = [hertz(top * i / 25) for i in range(26)]
    frames = []
    for begin in range(0, len(y) - 199, 80):
        part = [y[begin + n] * (0.5 - 0.5 * np.cos(2 * np.pi * n / 199)) for n in range(200)]
        power = [abs(sum(v * np.exp(-2j * np.pi * f * n / 256) for n, v in enumerate(part))) ** 2 for f in range(129)]
        bands = []
        for a, b, c in zip(edges, edges[1:], edges[2:], strict=False):
            bands.append(sum(p * max(0, min((f * 8000 / 256 - a) / (b - a), (c - f * 8000 / 256) / (c - b))) for f, p in enumerate(power)))
        frames.append([np.log(v + 1e-6) for v in bands])
    loud = [10 * np.log10(sum(np.exp(v) for v in f)) for f in frames]
    loud, found, begin = [v - max(loud) for v in loud], [], None
    for i, v in enumerate([*loud, -99]):
        if begin is None and v >= -12:
            begin = i
        if begin is not None and v < -12:
            found += [(begin, i)] if max(loud[begin:i]) >= -6 else []
            begin = None
    return np.array(frames), found


@pytest.mark.parametrize("payload", [b"\xff" * 576, bytes(random.Random(2).randbytes(1152)), ("Stil " * 60 + "!!!" * 80).encode().ljust(1152, b"\xff")])
def test_features_equal_plain_loops(payload):
    mel = media.log_mel(media.resample((np.frombuffer(payload, np.uint8) - 128.0) / 128))
    want, spans = slow_features(payload)
    assert np.allclose(mel, want, atol=1e-6) and media.segments(mel) == spans
    assert np.allclose(media.mel_frames(media.tensors(mel)), want, atol=0.02)


def test_resampling_keeps_low_tones_and_drops_high_ones():
    t = np.arange(16_000) / 16_000
    low, high = (media.resample(np.sin(2 * np.pi * f * t))[100:-100].std() for f in (500, 7000))
    assert low > 0.65 and high < 0.02
    tone = np.concatenate([np.zeros(8000), np.sin(2 * np.pi * 500 * t[:8000]), np.zeros(8000)])
    assert len(media.segments(media.log_mel(media.resample(tone)))) == 1


def labelled(spark, n=400):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        body = [rnd.choice(words) for _ in range(60)]
        bad, junk = i % 5 == 0, i % 4 == 0
        if bad:
            for _ in range(4):
                body[rnd.randrange(60)] = rnd.choice(["vile", "nasty", "awful"])
        docs.append((i, " ".join(w + ("###" if junk else "") for w in body)))
        labels.append((i, int(not junk), int(bad)))
    docs += [(1000, None), (1001, ""), (None, "vile nasty"), (1002, "nasty awful vile"), (1002, "nasty awful vile"), (1003, "!!! " * 20_000)]
    labels += [(None, 1, 1), (77_777, 0, 0), (3, None, None), (3, 1, 0)]
    extra = spark.createDataFrame([(d, t, 0.1, "q") for d, t in docs], "doc_id long, text string, score double, label string")
    return extra, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("operator,column", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, operator, column):
    docs, labels = labelled(spark)
    rows = operator.score(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    truth = {r.doc_id: r[column] for r in labels.collect() if r[column] is not None}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 20 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    folds, fold = (4, 2) if operator is toxicity else (5, 0)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == fold) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1000, 1001)}) == 1
    assert operator.score(docs.limit(0), labels.limit(0)).count() == 0
    assert operator.score(docs, labels.limit(0)).count() == docs.count()


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = labelled(spark)
    folded = labels.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - toxic else toxic end as toxic")
    key = lambda r: (r.doc_id or -1, r.score)
    assert sorted(map(key, toxicity.score(docs, labels).collect())) == sorted(map(key, toxicity.score(docs, folded).collect()))


def test_block_max_search_is_exact():
    rnd = np.random.default_rng(5)
    vectors = [{int(t): float(rnd.random()) for t in rnd.choice(50, 8, replace=False)} for _ in range(700)]
    index = toxicity.BlockMaxIndex(vectors, 50, block=16)
    skipped = 0
    for _ in range(60):
        query = {int(t): float(rnd.random()) for t in rnd.choice(50, 3, replace=False)}
        exact = np.array([sum(w * v.get(t, 0) for t, w in query.items()) for v in vectors])
        ids, products, done = index.search(query, 5)
        assert np.allclose(np.sort(exact)[::-1][:5], products) and np.allclose(exact[ids], products)
        skipped += index.n_blocks - done
    assert skipped > 0


def test_blocks_below_the_kth_product_are_not_scored():
    index = toxicity.BlockMaxIndex([{0: 0.5}] * 30 + [{0: 1.0}] * 10, 1, block=1)
    ids, products, done = index.search({0: 1.0}, 5)
    assert ids.tolist() == [30, 31, 32, 33, 34] and products.tolist() == [1.0] * 5 and done == 10


def test_words_of_texts_of_any_characters():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["A".join(every[i : i + 256]) for i in range(0, len(every), 256)] + ["", " ", "Naïve É_1\u00a0x\u0085y\x1cZ", "İ K Σας ſ\u2003“Wörd”"]
    assert [toxicity.words_of(t) for t in texts] == [re.findall(r"\w+", t.lower()) for t in texts]


def test_a_word_of_many_texts_is_looked_up_once(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    texts = [f"w1 w2 w2 W3 unheard {i} “w{i}”" if i % 3 else f"w1 w2 w2 W3 unheard {i} w{i}" for i in range(100)]
    expected, looked = [model.score([t])[0] for t in texts], []

    class Watched(dict):
        def __contains__(self, w):
            looked.append(w)
            return super().__contains__(w)

        def get(self, w, *other):
            looked.append(w)
            return super().get(w, *other)

    model.terms = Watched(model.terms)
    assert np.allclose(model.score(texts), expected, rtol=1e-12, atol=0)
    assert sorted(looked) == sorted({w for t in texts for w in toxicity.words_of(t)})


def test_equal_texts_of_both_labels_keep_both(spark):
    docs = spark.createDataFrame([(1, "same words here"), (2, "same words here"), (3, "same words here"), (4, "other text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert sorted(zip(model.doc_ids, model.labels.tolist(), strict=True)) == [(1, 0.0), (2, 1.0), (4, 0.0)]


def test_evidence(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    row = toxicity.evidence(docs.filter("doc_id = 1002"), model).first()
    assert row.neighbours and all(0 < n.cosine <= 1 + 1e-9 for n in row.neighbours) and row.neighbours[0].label == 1


def test_every_word_of_the_examples_counts(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    examples = {r.doc_id: r.text for r in docs.collect() if r.doc_id in truth}
    assert set(model.terms) == {w for t in examples.values() for w in toxicity.words_of(t)} and (model.weights > 0).all()

    def unit(text):
        counts = {w: toxicity.words_of(text).count(w) for w in toxicity.words_of(text) if w in model.terms}
        weights = {w: (1 + np.log(n)) * model.weights[model.terms[w]] for w, n in counts.items()}
        return {w: x / np.sqrt(sum(y * y for y in weights.values())) for w, x in weights.items()}

    units = {d: unit(t) for d, t in examples.items()}
    for text in (examples[1], "w1 w2 w2 w3", "unheard w7"):  # none holds a word that tells the labels apart
        own = unit(text)
        exact = sorted((sum(x * u.get(w, 0) for w, x in own.items()) for u in units.values()), reverse=True)
        found = model.neighbours(text)
        assert found and np.allclose([c for _, c, _ in found], exact[: len(found)]) and any(label == 0 for *_, label in found)


def test_a_high_share_of_toxic_labels_rejects_nothing_by_itself(spark):
    rnd = random.Random(9)
    docs = [(i, " ".join([rnd.choice([f"w{j}" for j in range(40)]) for _ in range(20)] + ["vile nasty awful"] * (i % 2))) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, toxic int")
    docs += [(300, None), (301, ""), (302, "unheard words"), (303, "w1 w2 w3 w4 w5"), (304, "vile nasty awful")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in toxicity.keep_clean(table, labels).collect()) == [*range(0, 200, 2), 300, 301, 302, 303]


def slow_trees(x, y, trees, depth):
    """Boosting by trying every cut of every feature at every node, and a walk node by node."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS)[1:-1])) for f in range(x.shape[1])]
    base = np.log(y.mean() / (1 - y.mean()))
    raw = np.full(len(y), base)
    leaf = lambda g, h: -quality.RATE * g.sum() / (h.sum() + quality.SHRINK)
    score = lambda g, h: g.sum() ** 2 / (h.sum() + quality.SHRINK)

    def grow(rows, g, h, d):
        best = (1e-6, None, None)
        for f in range(x.shape[1]) if d < depth else ():
            for cut in edges[f]:
                low = rows[x[rows, f] <= cut]
                high = rows[x[rows, f] > cut]
                if h[low].sum() >= quality.LEAST_HESSIAN and h[high].sum() >= quality.LEAST_HESSIAN:
                    gain = score(g[low], h[low]) + score(g[high], h[high]) - score(g[rows], h[rows])
                    if gain > best[0] + 1e-9:
                        best = (gain, f, cut)
        _, f, cut = best
        if f is None:
            return leaf(g[rows], h[rows])
        return f, cut, grow(rows[x[rows, f] <= cut], g, h, d + 1), grow(rows[x[rows, f] > cut], g, h, d + 1)

    def walk(node, row):
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    grown = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grown.append(grow(np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-9), 0))
        raw = raw + np.array([walk(grown[-1], r) for r in x])
    return lambda rows: 1 / (1 + np.exp(-(base + np.array([sum(walk(t, r) for t in grown) for r in rows]))))


def test_trees_equal_a_search_of_every_cut():
    rnd = np.random.default_rng(11)
    x = rnd.random((160, 4))
    y = ((x[:, 0] + 0.3 * rnd.random(160) > 0.6) ^ (x[:, 2] > 0.7)).astype(float)
    own = quality.BoostedTrees.fit(x[:120], y[:120], trees=6, depth=3)
    assert np.allclose(own.predict(x), slow_trees(x[:120], y[:120], 6, 3)(x), atol=1e-9)


def test_repeated_ids_give_one_model(spark):
    docs, labels = labelled(spark, 60)
    more = docs.unionByName(docs.filter("doc_id < 30").selectExpr("doc_id", "concat(text, ' quite other words') as text", "score", "label"))
    scores = lambda d: [r.score for r in quality.score(d, labels).orderBy("doc_id", "score").collect()]
    assert scores(more.repartition(7, "score", "text")) == scores(more.orderBy("text"))


def test_votes_equal_a_naive_cosine(spark):
    docs, labels = labelled(spark, 120)
    model = toxicity.fit(docs, labels)
    rows, truth = docs.collect(), {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None and r.doc_id is not None}
    examples = {}
    for r in sorted((r for r in rows if r.doc_id in truth), key=lambda r: r.doc_id):
        examples.setdefault(tuple(sorted(toxicity.words_of(r.text))), (r.text, truth[r.doc_id]))
    words = [toxicity.words_of(r.text or "") for r in rows]
    share = sum(truth.values()) / len(truth)
    texts, of = zip(*examples.values(), strict=True)
    n1, n0 = sum(of), len(of) - sum(of)

    def weight(w):
        ones, zeros = (sum(w in toxicity.words_of(t) for t, x in zip(texts, of, strict=True) if x == label) for label in (1, 0))
        p = (ones + zeros + 0.5) / (n1 + n0 + 1)
        z = (ones / n1 - zeros / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
        return (np.log((1 + len(rows)) / (1 + sum(w in d for d in words))) + 1e-9) * (1 + z * z)

    weights = {w: weight(w) for w in {w for t in texts for w in toxicity.words_of(t)}}

    def unit(text):
        own = toxicity.words_of(text)
        v = {w: (1 + np.log(own.count(w))) * weights[w] for w in set(own) if w in weights}
        return {w: x / np.sqrt(sum(y * y for y in v.values())) for w, x in v.items()}

    units, rate = [unit(t) for t in texts], {1: share / (n1 / len(of)), 0: (1 - share) / (n0 / len(of))}
    prior = toxicity.PRIOR * np.mean([rate[x] for x in of])
    for text in [r.text for r in rows[:25]] + ["nasty w1 w2", "w9", "none of these"]:
        own = unit(text)
        near = sorted(((sum(x * u.get(w, 0) for w, x in own.items()), x) for u, x in zip(units, of, strict=True)), key=lambda p: -p[0])
        near = [(c, x) for c, x in near if c > 0][: toxicity.NEIGHBOURS]
        votes = [(c**3 * rate[x], x) for c, x in near]
        want = (sum(v for v, x in votes if x) + prior * share) / (sum(v for v, _ in votes) + prior) if votes else share
        assert abs(model.score([text])[0] - want) < 1e-9


def test_flat_trees_fit():
    x = np.random.default_rng(6).random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    p = quality.BoostedTrees.fit(x[:1500], y[:1500]).predict(x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.97


def brute_links(rows, threshold):
    links = {i: set() for i in range(len(rows))}
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows[:i]):
            if a is not None and a == b and v is not None and w is not None and len(v) == len(w) and all(x is not None and np.isfinite(x) for x in v + w) and any(v) and any(w):
                p, q = np.array(v), np.array(w)
                if p @ q / (np.linalg.norm(p) * np.linalg.norm(q)) >= threshold:
                    links[i].add(j), links[j].add(i)
    return links


def components(links):
    root = {i: i for i in links}
    changed = True
    while changed:
        changed = False
        for i, js in links.items():
            low = min([root[i], *(root[j] for j in js)])
            for k in [i, *js]:
                if root[k] != low:
                    root[k], changed = low, True
    return root


def test_embeddings(spark):
    rnd = np.random.default_rng(7)
    centres = rnd.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + 0.12 * rnd.normal(size=12)).tolist(), i % 3 if i % 11 else None) for i in range(250)]
    rows += [(300 + i, rows[5][1], rows[5][2]) for i in range(40)]
    rows += [(400, None, 1), (401, [0.0] * 12, 1), (402, [float("nan")] * 12, 1), (403, [None] * 12, 1), (404, [], 1), (405, [1.0], 1), (406, [2.0], 1), (407, [float("inf")] * 12, 1)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<double>, label int, n_links int")
    links, got = brute_links(rows, 0.98), {r.vec_id: r for r in embeddings.near_links(df, tile=16).collect()}
    root = components(links)
    for i, r in enumerate(rows):
        assert (got[r[0]].n_links, got[r[0]].component_id, got[r[0]].kept) == (len(links[i]), rows[root[i]][0], root[i] == i)
    assert embeddings.near_links(df.limit(0)).count() == 0
    extra = spark.createDataFrame([(None, [1.0], 1)], "vec_id long, embedding array<double>, label int")
    assert embeddings.near_links(extra).first().asDict() == {"vec_id": None, "n_links": 0, "component_id": None, "kept": False}


URLS = ["http://a.example.com/en/x", "https://WWW.Example.COM/en/1?q", "x://example.com/EN/", "http://bad.net/fr/", "http://bad.net/frx", "http://net/es/#", "http://com", "http://com/", "nothing", "", None, "http://notexample.com/en/", "http://h.org/en/?://b", "http://a.com:80/x", "http://u@b.com/en/\nz", "http://example.com/en/", "http://example.com/en/"]


def test_urls(spark):
    pages = spark.createDataFrame([(i if i else None, u, "h", "p") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
        fits = [(len(h + p), h + p, v) for h, p, v in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")

    key = lambda r: (r[0] or 0, *map(str, r[1:]))
    got = sorted((tuple(r) for r in url_filter.judge(pages, queries.RULES).collect()), key=key)
    assert got == sorted(((i if i else None, *judge(u)) for i, u in enumerate(URLS)), key=key)
    assert url_filter.judge(pages, []).filter("verdict <> 'allow' or rule is not null").count() == 0
    assert url_filter.judge(pages.limit(0), queries.RULES).count() == 0


def test_full_bloom_filter_changes_nothing(spark, monkeypatch):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    rules = [*queries.RULES, *[(f"h{i}.org", "/en/", "block") for i in range(200)]]
    want = sorted(map(str, url_filter.judge(pages, rules).collect()))
    monkeypatch.setattr(url_filter, "MOST_BLOCKS", 1)
    monkeypatch.setattr(url_filter, "MOST_BROADCAST", 0)
    assert sorted(map(str, url_filter.judge(pages, rules).collect())) == want


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def near_corpus(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = [rnd.choice(words) for _ in range(60)]
    texts = []
    for _ in range(40):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 5, 6, 9, 20, 80, 300]))]
        if rnd.random() < 0.5:
            base[5:5] = shared
        texts.append(base)
        for _ in range(rnd.choice([0, 1, 3, 8])):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(copy + [rnd.choice(words) for _ in range(rnd.choice([0, 0, 1, 20]))])
    return [" ".join(t).upper() if rnd.random() < 0.2 else "\t ".join(t) for t in texts] + ["", " \n\x0b", None, "één", "ÉÉN", "één"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_duplicates(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "CHUNK", 1 << 10 if seed == 2 else ngram_join.CHUNK)
    monkeypatch.setattr(ngram_join, "AT_ONCE", 50 if seed == 3 else ngram_join.AT_ONCE)
    monkeypatch.setattr(ngram_join, "NAME_SHIFT", 61 if seed == 1 else ngram_join.NAME_SHIFT)  # many sets of one name
    monkeypatch.setattr(ngram_join, "SEEN", 3 if seed == 2 else ngram_join.SEEN)
    monkeypatch.setattr(ngram_join, "PACKED", 700 if seed == 2 else ngram_join.PACKED)
    monkeypatch.setattr(ngram_join, "KEY_BYTES", 2000 if seed == 3 else ngram_join.KEY_BYTES)  # several keys a task
    texts = near_corpus(seed)
    sets = [shingles(t) for t in texts]
    links = {i: set() for i in range(len(texts))}
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                links[i].add(j), links[j].add(i)
    root = components(links)
    df = spark.createDataFrame([(i, t, 9, "x") for i, t in enumerate(texts)], "doc_id long, text string, component_id int, set string")
    got = {r.doc_id: r for r in ngram_join.near_duplicates(df).collect()}
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == [(len(sets[i]), root[i]) for i in range(len(texts))]


@pytest.mark.parametrize("rounds", [1, 8])
def test_similar_sets_share_a_signature(rounds, monkeypatch):
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    rnd, bands = random.Random(8), ngram_join.Bands()
    for _ in range(1500):
        n = rnd.choice([1, 2, 3, 4, 5, 6, 7, 8, 12, 20, 40, 150, 600])
        a = [rnd.getrandbits(64) for _ in range(n)]
        lost = rnd.randint(0, n // 4)
        b = a[lost:]
        while 3 * (len(b) + 1 + lost) <= 4 * (n - lost) + 3 * lost and rnd.random() < 0.9:
            b.append(rnd.getrandbits(64))
        x, y = np.unique(np.array(a, np.uint64)), np.unique(np.array(b, np.uint64))
        common = len(np.intersect1d(x, y))
        if 4 * common >= 3 * (len(x) + len(y) - common):
            assert np.intersect1d(ngram_join.signatures(x, bands), ngram_join.signatures(y, bands)).size
            words = lambda s: np.frombuffer(ngram_join.sketch(s), "<u8")
            assert ngram_join.may_be_similar(words(x), len(x), words(y), len(y))
            rough = lambda s: np.frombuffer(ngram_join.coarse(ngram_join.sketch(s), len(s)), "<u8")
            assert ngram_join.may_be_similar(rough(x), len(x), rough(y), len(y))


def test_chunks_and_long_words_change_no_shingle(monkeypatch):
    rnd = random.Random(12)
    texts = ["".join(rnd.choice(["a", "B", "é", " ", "\n", "\t "]) for _ in range(n)) for n in (0, 1, 5, 300, 4000)] + ["x" * 5000, "y " * 3000, " "]
    whole = ngram_join.shingle_sets(texts)
    monkeypatch.setattr(ngram_join, "CHUNK", 64)
    assert all(np.array_equal(a, b) for a, b in zip(whole, ngram_join.shingle_sets(texts), strict=True))
    assert [len(s) for s in whole] == [len(shingles(t)) for t in texts]


def test_packed_signatures_come_back():
    rnd = np.random.default_rng(5)
    names = np.repeat(rnd.integers(0, 1 << 40, 12).astype(np.uint64), [1, 2, 254, 255, 256, 600, 3, 1, 1, 765, 9, 1])
    signature = rnd.integers(0, 1 << 63, len(names)).astype(np.uint64)
    for n_keys in (1, 2, 7, 4000):
        got = []
        for row in ngram_join._packed(signature, names, n_keys).to_pylist():
            own = ngram_join._from_five(row["signatures"]).tolist()
            sets = np.repeat(ngram_join._from_five(row["sets"]), np.frombuffer(row["counts"], np.uint8)).tolist()
            got += [(row["key"], *pair) for pair in zip(own, sets, strict=True)]
        assert sorted(got) == sorted(zip((signature % np.uint64(n_keys)).tolist(), (signature >> np.uint64(24)).tolist(), names.tolist(), strict=True))


def test_leaders_do_not_depend_on_how_a_bucket_is_cut():
    rnd = np.random.default_rng(1)
    signature, sets = rnd.integers(0, 40, 3000).astype(np.uint64), rnd.integers(0, 200, 3000)
    leaders, pairs = ngram_join._Leaders(), set()
    for begin in range(0, 3000, 170):
        pairs |= set(map(tuple, leaders.meet(signature[begin : begin + 170], sets[begin : begin + 170]).tolist()))
    assert len(leaders.signatures) == 40
    for s, leader in zip(leaders.signatures, leaders.sets, strict=True):
        assert all((leader, x) in pairs for x in set(sets[signature == s].tolist()) - {leader})


def test_a_star_of_thousands_of_different_sets(spark):
    """All texts share most words; each differs from the next ones in a few, and every tenth in many."""
    rnd = random.Random(13)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(2500):
        words = list(base)
        for _ in range(3 if i % 10 else 30):
            words[rnd.randrange(120)] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(words))
    sets = [shingles(t) for t in texts]
    where = {}
    for i, s in enumerate(sets):
        for w in s:
            where.setdefault(w, []).append(i)
    links = {i: set() for i in range(len(texts))}
    for i, s in enumerate(sets):
        common = {}
        for w in s:
            for j in where[w]:
                common[j] = common.get(j, 0) + 1
        links[i] = {j for j, n in common.items() if j != i and 4 * n >= 3 * (len(s) + len(sets[j]) - n)}
    root = components(links)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == root


def test_near_copies_without_ids_meet(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join(words)), (None, " ".join(["other", *words[1:]])), (7, " ".join([*words[:-1], "else"])), (None, "alone")]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.n_shingles, r.component_id or -1) for r in got) == [(1, -1), (56, 7), (56, 7), (56, 7)]


def test_near_duplicates_of_odd_rows(spark, odd):
    rows = ngram_join.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.doc_id in (1, 5)} == {1}
    assert {r.doc_id: r.component_id for r in rows if r.doc_id in (2, 3)} == {2: 2, 3: 3}
    assert ngram_join.near_duplicates(odd.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 101), (None, 4)], "u long, v long")
    assert {r.node: r.component for r in connected_components(edges).collect()} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
