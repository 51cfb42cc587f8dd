"""Passages of benchmark items in documents, by a prefix-filtered join of shingle sets.

A window is a run of `window` words of an item (the whole item if it has fewer); its set are its shingles of SHINGLE words
(of all its words if it has fewer). All shingles of items are ordered by rarity, that is by how often all documents together hold
them. Where a document holds a window it holds the whole set, so the prefix that has to be joined is one token: the window's rarest
shingle. A document's shingles meet these prefix tokens; the token's place in the window says where the window would begin and
end (positional bound), which has to lie within the document (length bound); there the document's words are compared with the
window's, first by their hashes and then byte by byte.

Items are the stated query set. They are broadcast in blocks of at most about BLOCK_BYTES, one after the other, so that neither
the driver nor a task holds more than one block; documents are read twice a block (rarity, join) and never shuffled for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import map_slices, materialise, sliced, text_rows
from inkveil.llm.words import ALNUM, LOWER, gathered, joined_words, run_hashes, text_buffer, word_edges, word_hashes

WINDOW, SHINGLE = 10, 3
#: Bytes of the texts and names of windows that are broadcast together.
BLOCK_BYTES = 16 << 20
#: Candidates that are compared at once in a task.
AT_ONCE = 1 << 18
_FOUND = "doc_id long, n_words long, spans array<struct<begin:int,end:int>>, items array<string>"


def item_windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item string, text string): each window of each item as its words joined by a space. Items without words have none."""

    def run(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        raw, offsets = text_buffer(rows.column("text"))
        data = LOWER[raw]
        start, stop, first = word_edges(data, offsets, ALNUM)
        words = np.diff(first)
        size = np.minimum(words, window)
        many = np.where(words > 0, words - size + 1, 0)
        item = np.repeat(np.arange(len(words)), many)
        at = first[item] + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
        line, ends = joined_words(data, start, stop)
        texts = gathered(line, ends[at] - (stop - start)[at], ends[at + size[item] - 1]) if len(at) else pa.array([], pa.string())
        return pa.RecordBatch.from_arrays([rows.column("item").take(pa.array(item)), texts], ["item", "text"])

    rows = items.select(F.col(id_col).cast("string").alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return map_slices(rows, run, "item string, text string").distinct()


class Block:
    """The windows of one block as arrays: their words' hashes, shingles, names of items."""

    def __init__(self, rows: pa.Table):
        texts = rows.column("text").combine_chunks().dictionary_encode()
        self.texts = [t.encode() for t in texts.dictionary.to_pylist()]
        names = rows.column("item").combine_chunks()
        known = sorted(set(names.to_pylist()) - {None}, key=lambda s: s.encode())
        self.names = known
        index = {name: i for i, name in enumerate(known)}
        pairs = np.array([(w, index.get(n, -1)) for w, n in zip(texts.indices.to_pylist(), names.to_pylist(), strict=True)], np.int64).reshape(-1, 2)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        self.item_of, self.items_at = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.texts) + 1))
        data, offsets = text_buffer(pa.array(self.texts, pa.binary()).cast(pa.string()))
        start, stop, first = word_edges(data, offsets, ALNUM)
        self.size = np.diff(first)
        hashes = word_hashes(data, start, stop)
        self.words = np.zeros((len(self.texts), int(self.size.max(initial=1))), np.uint64)
        for k in range(self.words.shape[1]):
            has = self.size > k
            self.words[has, k] = hashes[first[:-1][has] + k]
        # The shingles of each window, as (window, place, hash); the shingle's size is SHINGLE or the whole of a shorter window.
        every = []
        for size in range(1, SHINGLE + 1):
            own = np.flatnonzero(np.minimum(self.size, SHINGLE) == size)
            many = self.size[own] - size + 1
            of = np.repeat(own, many)
            place = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            runs = run_hashes(hashes, size)
            every.append((of, place, runs[first[of] + place] if len(of) else np.empty(0, np.uint64), np.full(len(of), size)))
        self.of, self.place, self.shingle, self.width = (np.concatenate(x) for x in zip(*every, strict=True))


class Tokens:
    """Sorted tokens of one shingle size, with a bitmap that drops most other shingles at once."""

    def __init__(self, tokens: np.ndarray):
        self.tokens = np.unique(tokens)
        self.bits = max(10, int(16 * len(self.tokens)).bit_length())
        self.may = np.zeros(1 << self.bits, bool)
        self.may[self._low(self.tokens)] = True

    def _low(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def meet(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `hashes` that hold a token, and the token's number."""
        if not len(self.tokens):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        place = np.flatnonzero(self.may[self._low(hashes)])
        at = np.minimum(np.searchsorted(self.tokens, hashes[place]), len(self.tokens) - 1)
        same = self.tokens[at] == hashes[place]
        return place[same], at[same]


def _rarity(docs: DataFrame, tokens: dict[int, Tokens]) -> dict[int, np.ndarray]:
    """How often all documents hold each token, by shingle size. Tasks add up their own; one number a token reaches the driver."""
    sent = docs.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = sent.value
        held = {size: np.zeros(len(t.tokens), np.int64) for size, t in tokens.items()}
        for batch in batches:
            for rows in sliced(batch, "text"):
                raw, offsets = text_buffer(rows.column("text"))
                data = LOWER[raw]
                start, stop, first = word_edges(data, offsets, ALNUM)
                hashes, doc = word_hashes(data, start, stop), np.repeat(np.arange(len(first) - 1), np.diff(first))
                for size, t in tokens.items():
                    place, token = t.meet(run_hashes(hashes, size))
                    within = doc[place] == doc[place + size - 1]
                    held[size] += np.bincount(token[within], minlength=len(t.tokens))
        for size, n in held.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), size, np.int32)), pa.array(some), pa.array(n[some])], ["size", "token", "n"])

    found = docs.mapInArrow(run, "size int, token long, n long").groupBy("size", "token").agg(F.sum("n").alias("n")).toArrow()
    out = {size: np.zeros(len(t.tokens), np.int64) for size, t in tokens.items()}
    for size in out:
        rows = found.filter(pc.equal(found.column("size"), size))
        out[size][rows.column("token").to_numpy()] = rows.column("n").to_numpy()
    return out


class Prefixes:
    """Prefix tokens of a block: for each shingle size the tokens, and the windows that begin so many words before each."""

    def __init__(self, block: Block, rarity: dict[int, np.ndarray], tokens: dict[int, Tokens]):
        count = np.zeros(len(block.of), np.int64)
        for size, t in tokens.items():
            own = block.width == size
            count[own] = rarity[size][np.searchsorted(t.tokens, block.shingle[own])]
        order = np.lexsort((block.place, block.shingle, count, block.of))
        rarest = order[np.flatnonzero(np.diff(block.of[order], prepend=-1))]
        rarest = rarest[count[rarest] > 0]  # a window whose rarest shingle is nowhere is nowhere
        self.block, self.by_size = block, {}
        for size in np.unique(block.width[rarest]).tolist():
            own = rarest[block.width[rarest] == size]
            own = own[np.argsort(block.shingle[own], kind="stable")]
            t = Tokens(block.shingle[own])
            self.by_size[size] = (t, block.of[own], block.place[own], np.searchsorted(block.shingle[own], np.append(t.tokens, t.tokens[-1:]), side="left"))
            self.by_size[size][3][-1] = len(own)

    def occurrences(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first word, window) of all occurrences, in parts of bounded size."""
        hashes, doc = word_hashes(data, start, stop), np.repeat(np.arange(len(first) - 1), np.diff(first))
        for size, (tokens, windows, places, begins) in self.by_size.items():
            place, token = tokens.meet(run_hashes(hashes, size))
            if not len(place):
                continue
            many = begins[token + 1] - begins[token]
            ends = np.cumsum(many)
            edges = np.searchsorted(ends, np.arange(0, int(ends[-1]), AT_ONCE), side="left").tolist()
            for a, b in zip(edges, [*edges[1:], len(place)], strict=True):
                some = many[a:b]
                at = np.repeat(begins[token[a:b]], some) + np.arange(int(some.sum())) - np.repeat(np.cumsum(some) - some, some)
                window, begin = windows[at], np.repeat(place[a:b], some) - places[at]
                own = np.repeat(doc[place[a:b]], some)
                keep = (begin >= first[own]) & (begin + self.block.size[window] <= first[own + 1])
                window, begin = window[keep], begin[keep]
                for k in range(self.block.words.shape[1]):
                    longer = self.block.size[window] > k
                    keep = ~longer
                    keep[longer] = hashes[begin[longer] + k] == self.block.words[window[longer], k]
                    window, begin = window[keep], begin[keep]
                exact = [b" ".join(data[start[i] : stop[i]].tobytes() for i in range(p, p + n)) == self.block.texts[w] for p, n, w in zip(begin.tolist(), self.block.size[window].tolist(), window.tolist(), strict=True)]
                exact = np.array(exact, bool)
                yield begin[exact], window[exact]


def _lists(values: pa.Array, owner: np.ndarray, n: int) -> pa.Array:
    """Lists of the values, which are in the order of their owners (0 to n - 1)."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), values)


def _found(rows: pa.RecordBatch, prefixes: Prefixes) -> pa.RecordBatch:
    raw, offsets = text_buffer(rows.column("text"))
    data, n = LOWER[raw], rows.num_rows
    start, stop, first = word_edges(data, offsets, ALNUM)
    block, doc = prefixes.block, np.repeat(np.arange(n), np.diff(first))
    change, pairs = np.zeros(len(start) + 1, np.int64), [np.empty(0, np.int64)]
    for begin, window in prefixes.occurrences(data, start, stop, first):
        np.add.at(change, begin, 1), np.add.at(change, begin + block.size[window], -1)
        some = block.items_at[window + 1] - block.items_at[window]
        at = np.repeat(block.items_at[window], some) + np.arange(int(some.sum())) - np.repeat(np.cumsum(some) - some, some)
        item = block.item_of[at]
        pairs.append(np.unique((np.repeat(doc[begin], some) * len(block.names) + item)[item >= 0]))
    hit = np.cumsum(change[:-1]) > 0
    before, after = np.append(False, hit[:-1]), np.append(hit[1:], False)
    before[first[:-1][first[:-1] < len(hit)]] = False
    after[first[1:][first[1:] > 0] - 1] = False
    begins, ends = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
    base = first[doc[begins]] if len(begins) else begins
    spans = pa.StructArray.from_arrays([pa.array((begins - base).astype(np.int32)), pa.array((ends - base).astype(np.int32))], ["begin", "end"])
    pairs = np.unique(np.concatenate(pairs))
    owner, item = np.divmod(pairs, max(1, len(block.names)))
    items = pa.array([block.names[i] for i in item.tolist()], pa.string())
    lists = [_lists(spans, doc[begins] if len(begins) else begins, n), _lists(items, owner, n)]
    return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(first)), *lists], ["doc_id", "n_words", "spans", "items"])


def _scan(docs: DataFrame, windows: pa.Table) -> DataFrame:
    """_FOUND for each row of docs (doc_id, text) against the windows of one block."""
    block = Block(windows)
    tokens = {int(size): Tokens(block.shingle[block.width == size]) for size in np.unique(block.width)}
    sent = docs.sparkSession.sparkContext.broadcast(Prefixes(block, _rarity(docs, tokens), tokens))
    return map_slices(docs, lambda rows: _found(rows, sent.value), _FOUND)


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, n_words, spans (runs of words that windows of items cover), items (ids as strings, sorted).

    A-Z are lower-cased; words are runs of letters and digits of ASCII and of all other characters above it. Null and empty texts have
    no words; neither do they hit nor are they hit. Items of fewer than `window` words are one window. Rows of a repeated item id
    are one item; an item without an id covers words but is not named. Repeated documents are looked at once each, null doc_ids stay, extra
    columns are ignored; without items nothing is covered, without documents the result is empty.
    """
    windows = materialise(item_windows(items, window), "windows")
    size = windows.agg(F.coalesce(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0))), F.lit(0))).first()[0]
    blocks = -(-size // BLOCK_BYTES)
    rows = text_rows(docs)
    if blocks <= 1:
        return _scan(rows, windows.toArrow())
    # Several blocks: rows are numbered in a written copy, and what the blocks found is put together by that number.
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    numbered, parts = rows.select(F.col("row").alias("doc_id"), "text"), []
    for k in range(blocks):
        own = windows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).toArrow()
        if own.num_rows:
            part = _scan(numbered, own).filter(F.size("spans") > 0)
            parts.append(materialise(part.select(F.col("doc_id").alias("row"), "spans", "items"), "block"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = found.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    found = found.mapInArrow(lambda batches: map(_joined_spans, batches), "row long, spans array<struct<begin:int,end:int>>, items array<string>")
    counted = map_slices(numbered, _counted, "row long, n_words long")
    none = F.array().cast("array<struct<begin:int,end:int>>"), F.array().cast("array<string>")
    out = rows.select("row", "doc_id").join(counted, "row").join(found, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))


def _counted(rows: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = text_buffer(rows.column("text"))
    return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(word_edges(data, offsets, ALNUM)[2]))], ["row", "n_words"])


def _joined_spans(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Sorted spans with those that overlap or touch as one."""
    spans, n = rows.column("spans"), rows.num_rows
    flat, owner = spans.flatten(), np.repeat(np.arange(n), np.diff(spans.offsets.to_numpy()))
    begin, end = (owner << 32 | flat.field(k).to_numpy().astype(np.int64) for k in (0, 1))
    reach = np.maximum.accumulate(end) if len(end) else end
    first = np.flatnonzero(np.append(True, begin[1:] > reach[:-1])) if len(end) else np.empty(0, np.int64)
    last = np.append(first[1:], len(end))[: len(first)] - 1
    joined = pa.StructArray.from_arrays([pa.array((x & 0xFFFFFFFF).astype(np.int32)) for x in (begin[first], reach[last])], ["begin", "end"])
    return pa.RecordBatch.from_arrays([rows.column("row"), _lists(joined, owner[first], n), rows.column("items")], ["row", "spans", "items"])


def contamination_digests(found: DataFrame) -> DataFrame:
    """n_hit, n_items and the digest of the items of each row of `contaminated`."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
