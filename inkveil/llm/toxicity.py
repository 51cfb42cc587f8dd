"""Toxicity by the nearest labelled examples, exact TF-IDF cosine over block-max inverted indexes.

A bounded, documented sample of labelled documents (`EXAMPLES` of either label) is the set of examples. Every word of
the examples is a term; document frequencies come from all documents. A term's TF-IDF weight is multiplied by 1 + z * z,
z being how many standard errors its shares in the two labels of the examples lie apart: no term is left out, and one that
tells nothing keeps its plain TF-IDF weight. (With plain weights the neighbours of long texts agree in subject, not in label.)
Words that no example holds meet nothing and do not enter a text's length.

A posting list holds a term's weight in each example; examples stand in blocks of 64, and for each term and block the
largest weight is known. Terms of many examples stand in a dense matrix instead, whose products are taken first. For a text, the weights' products with those maxima, added to the dense ones, bound the cosine with any example of a
block: blocks are scored in the order of their bounds until no bound exceeds the k-th best cosine, so the neighbours are exact.

The score is the vote of the neighbours, each with weight cosine cubed and class weights that undo the sampling, drawn
towards the share of label 1 among all labelled rows by `PRIOR` of a vote; so a text near no example has that share.
"""

from __future__ import annotations

import gc
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import map_slices, sliced, text_rows
from inkveil.llm.labelled import THRESHOLD, filter_documents, label_rows, sample_ids, sampled_texts, score_documents

#: At most so many labelled examples of either label.
EXAMPLES = 3000
NEIGHBOURS, BLOCK, PRIOR = 15, 64, 0.4
#: Terms in at least one of so many examples stand in a dense matrix instead of posting lists; queries that meet it at once.
OFTEN, AT_ONCE = 24, 128
#: Bytes of text, and texts, whose words are counted at once.
COUNTED_BYTES, COUNTED_TEXTS = 1 << 20, 4 * AT_ONCE
_WORD = re.compile(r"\w+")
#: Each Latin-1 character in lower case (which is Latin-1 again), or a space if it is of no word.
_LATIN = b"".join((chr(c).lower() if _WORD.match(chr(c)) else " ").encode("latin-1") for c in range(256))


def _spaced(text: str) -> bytes:
    """The words of a text with white space between them, as UTF-8; a text of Latin-1 characters alone takes one step of a table for each."""
    try:
        return text.encode("latin-1").translate(_LATIN).decode("latin-1").encode()
    except UnicodeEncodeError:
        return " ".join(_WORD.findall(text.lower())).encode()


def words_of(text: str) -> list[str]:
    """The runs of letters, digits and underscores, in lower case."""
    return _spaced(text).decode().split()


def _counted(texts: list[str], terms: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) for each of terms in each of texts, in this order: each word of all texts is looked up once."""
    words = pc.ascii_split_whitespace(pa.array([_spaced(t) for t in texts], pa.large_binary()).view(pa.large_string()))
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy())
    coded = words.flatten().dictionary_encode()
    held = coded.dictionary.to_numpy(zero_copy_only=False)
    number = np.fromiter(map(terms.get, held, repeat(-1)), np.int64, len(held))[coded.indices.to_numpy()]
    known = number >= 0
    found, counts = np.unique(row[known] * len(terms) + number[known], return_counts=True)
    return *np.divmod(found, max(1, len(terms))), counts


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [begin, begin + size) in a row."""
    end = np.cumsum(size)
    return np.repeat(begin - end + size, size) + np.arange(end[-1] if len(end) else 0)


class BlockMaxIndex:
    """Exact top-k inner products of sparse query vectors with sparse example vectors; no weight is negative."""

    def __init__(self, vectors: list[dict[int, float]], n_terms: int, block: int = BLOCK):
        rows = np.repeat(np.arange(len(vectors)), [len(v) for v in vectors])
        self._build(rows, np.array([t for v in vectors for t in v], np.int64), np.array([w for v in vectors for w in v.values()], float), len(vectors), n_terms, block)

    @classmethod
    def of(cls, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, n_terms: int, block: int = BLOCK) -> BlockMaxIndex:
        """From one entry for each term of each vector."""
        out = cls.__new__(cls)
        out._build(rows, terms, weights, n, n_terms, block)
        return out

    def _build(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, n_terms: int, block: int) -> None:
        self.n, self.block, self.n_blocks = n, block, max(1, -(-n // block))
        often = np.bincount(terms, minlength=n_terms) * OFTEN >= max(1, n)
        self.column = np.where(often, np.cumsum(often) - 1, -1)
        self.dense, in_dense = np.zeros((int(often.sum()), self.n_blocks * block)), often[terms]
        self.dense[self.column[terms[in_dense]], rows[in_dense]] = weights[in_dense]
        rare = np.flatnonzero(~in_dense)
        rare = rare[np.lexsort((rows[rare], terms[rare]))]
        terms, self.ids, self.weights = terms[rare].astype(np.int64), rows[rare].astype(np.int32), weights[rare]
        # A run is what one term has in one block.
        key = terms * self.n_blocks + self.ids // block
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.run_block, self.starts = (key[first] % self.n_blocks).astype(np.int32), np.append(first, len(key)).astype(np.int32)
        self.maxima = np.maximum.reduceat(self.weights, first) if len(first) else np.empty(0)
        self.runs = np.searchsorted(terms[first], np.arange(n_terms + 1)).astype(np.int32)

    def search(self, query: dict[int, float], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(examples, products, blocks scored): the k best positive products, larger first, then smaller numbers."""
        return self.nearest([(np.array(list(query), np.int64), np.array(list(query.values()), float))], k)[0]

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """As search, for many queries of (terms, weights)."""
        out = []
        for i in range(0, len(queries), AT_ONCE):
            own = queries[i : i + AT_ONCE]
            dense = np.zeros((AT_ONCE, len(self.dense)))  # always of one size, so that equal queries have equal products
            for row, (terms, weights) in enumerate(own):
                column = self.column[terms]
                dense[row, column[column >= 0]] = weights[column >= 0]
            products = dense @ self.dense
            for row, (terms, weights) in enumerate(own):
                rare = self.column[terms] < 0
                out.append(self._nearest(terms[rare], weights[rare], products[row], k))
        return out

    def _nearest(self, terms: np.ndarray, weights: np.ndarray, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """known: the products over the frequent terms."""
        known = known.reshape(self.n_blocks, self.block)
        size = self.runs[terms + 1] - self.runs[terms]
        runs, weights = _ranges(self.runs[terms], size), np.repeat(weights, size)
        blocks = self.run_block.take(runs)
        bounds = known.max(1) + np.bincount(blocks, weights * self.maxima.take(runs), self.n_blocks)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        place = np.full(self.n_blocks, self.n_blocks)
        place[order] = np.arange(len(order))
        at, begin = place.take(blocks), self.starts.take(runs)
        size = self.starts.take(runs + 1) - begin
        ids, products, least, done, step = np.empty(0, np.int64), np.empty(0), 0.0, 0, 8
        while done < len(order) and bounds[order[done]] >= least * (1 - 1e-12):
            now = order[done : done + step]
            now = now[bounds[now] >= least * (1 - 1e-12)]
            chosen = np.flatnonzero((at >= done) & (at < done + len(now)))
            many = size.take(chosen)
            postings = _ranges(begin.take(chosen), many)
            slots = self.ids.take(postings) + np.repeat((at.take(chosen) - done - blocks.take(chosen)) * self.block, many)
            values = known[now].ravel() + np.bincount(slots, np.repeat(weights.take(chosen), many) * self.weights.take(postings), len(now) * self.block)
            # Only what is among the k best of these blocks, equal products included, can be among the k best of all.
            here = np.partition(values, -k)[-k] if len(values) > k else 0.0
            found = np.flatnonzero((values > 0) & (values >= max(least, here)))
            done, step = done + len(now), step * 4
            ids, products = np.concatenate([ids, now[found // self.block] * self.block + found % self.block]), np.concatenate([products, values[found]])
            best = np.lexsort((ids, -products))[:k]
            ids, products = ids[best], products[best]
            least = products[-1] if len(products) == k else 0.0
        return ids, products, done


class ToxicityModel:
    """terms: word -> number; weights: by number; examples: ids, labels, and (example, term, count) for each word of each."""

    def __init__(self, terms: dict[str, int], weights: np.ndarray, doc_ids: list[int], labels: np.ndarray, entries: tuple[np.ndarray, np.ndarray, np.ndarray], share: float, neighbours: int = NEIGHBOURS):
        self.terms, self.weights, self.share, self.k = terms, weights, share, neighbours
        self.doc_ids, self.labels = doc_ids, np.asarray(labels, float)
        ones = float(self.labels.mean()) if len(doc_ids) else 0.0
        self.class_weight = np.where(self.labels == 1, share / ones if ones else 0.0, (1 - share) / (1 - ones) if ones < 1 else 0.0)
        rows, numbers, counts = entries
        own = (1 + np.log(counts)) * weights[numbers]
        norms = np.sqrt(np.bincount(rows, own * own, len(doc_ids)))[rows]
        self.index = BlockMaxIndex.of(rows, numbers, np.divide(own, norms, out=np.zeros(len(own)), where=norms > 0), len(doc_ids), len(terms))

    def _units(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Term numbers and weights of each text."""
        rows, numbers, counts = _counted(texts, self.terms)
        own = (1 + np.log(counts)) * self.weights[numbers]
        norms = np.sqrt(np.bincount(rows, own * own, len(texts)))[rows]
        own = np.divide(own, norms, out=np.zeros(len(own)), where=norms > 0)
        ends = np.searchsorted(rows, np.arange(len(texts) + 1)).tolist()
        return [(numbers[i:j], own[i:j]) for i, j in pairwise(ends)]

    def neighbours(self, text: str) -> list[tuple[int, float, int]]:
        """(doc_id, cosine, label) of the nearest examples: the evidence of a score."""
        ids, cosines, _ = self.index.nearest(self._units([text]), self.k)[0]
        return [(self.doc_ids[i], float(c), int(self.labels[i])) for i, c in zip(ids, cosines, strict=True)]

    def score(self, texts: list[str]) -> np.ndarray:
        return self._judge(texts)[0]

    def proven(self, texts: list[str]) -> np.ndarray:
        """The scores, with 0 for texts whose neighbours alone, without the share of label 1, do not reach THRESHOLD."""
        scores, votes = self._judge(texts)
        return np.where(votes >= THRESHOLD, scores, 0.0)

    def _judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and the neighbours' votes for label 1 as a share of all their votes (0 without any)."""
        out, alone = np.full(len(texts), self.share), np.zeros(len(texts))
        prior = PRIOR * float(self.class_weight.mean()) if len(self.class_weight) else 0.0
        for begin in range(0, len(texts), COUNTED_TEXTS):
            found = self.index.nearest(self._units(texts[begin : begin + COUNTED_TEXTS]), self.k)
            for row, (ids, cosines, _) in enumerate(found, begin):
                if len(ids):
                    votes = cosines**3 * self.class_weight[ids]
                    ones, total = float(votes @ self.labels[ids]), float(votes.sum())
                    out[row] = (ones + prior * self.share) / (total + prior)
                    alone[row] = ones / total if total else 0.0
        return out, alone


def _document_frequencies(docs: DataFrame, terms: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many rows of docs each term stands, by number, and how many rows there are. A partition is summed up before it is sent."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            for part in sliced(batch, "text", COUNTED_BYTES):
                found += np.bincount(_counted(part.column("text").to_pylist(), terms)[1], minlength=len(terms))
                rows += part.num_rows
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(found[some], rows))], ["term", "n"])

    summed = text_rows(docs).mapInArrow(partial, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms) + 1, np.int64)
    out[summed["term"].to_numpy()] = summed["n"].to_numpy()
    return out[:-1], int(out[-1])


def fit(docs: DataFrame, labels: DataFrame, folds: int | None = None, fold: int = 0, examples: int = EXAMPLES) -> ToxicityModel:
    """Learn from rows outside the held-out fold. Frequencies are counted over all of docs; no labels give the score 0.

    Sent to the driver: the words and counts of the examples, and one frequency for each of their words.
    """
    gc.collect()  # models of earlier runs in this session stand in reference cycles
    rows = label_rows(labels, "toxic", folds, fold)
    share = rows.agg(F.avg("label")).first()[0] or 0.0
    texts = sampled_texts(docs, sample_ids(rows, examples, "label = 1", "label = 0"))

    def counted(part: pa.RecordBatch) -> pa.RecordBatch:
        counts = [Counter(words_of(t)) for t in part.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))], ["doc_id", "label", "words", "counts"])

    held = map_slices(texts.select("doc_id", "text", "label"), counted, "doc_id long, label int, words array<string>, counts array<int>")
    # Copies of one label are one example, the one with the smallest id; where equal words have both labels, each label keeps its own.
    held = held.groupBy("label", F.xxhash64("words", "counts").alias("h")).agg(F.min_by(F.struct(*held.columns), "doc_id").alias("e")).select("e.*", "h")
    known = held.toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending"), ("h", "ascending")])
    of_label = known["label"].to_numpy()
    of_row = np.repeat(np.arange(len(known), dtype=np.int32), pc.list_value_length(known["words"]).to_numpy())
    coded = pc.list_flatten(known["words"]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    terms = {w: i for i, w in enumerate(coded.dictionary.take(pa.array(order)).to_pylist())}
    number = np.empty(len(terms), np.int32)
    number[order] = np.arange(len(terms))
    numbers, counts, doc_ids = number[coded.indices.to_numpy()], pc.list_flatten(known["counts"]).to_numpy(), known["doc_id"].to_numpy()
    n_examples = len(known)
    del known, coded  # the words stand in terms from here on

    ones = np.bincount(numbers, of_label[of_row], len(terms))
    zeros = np.bincount(numbers, minlength=len(terms)) - ones
    n1, n0 = float(max(1, of_label.sum())), float(max(1, n_examples - of_label.sum()))
    p = (ones + zeros + 0.5) / (n1 + n0 + 1)
    z = (ones / n1 - zeros / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    df, total = _document_frequencies(docs, terms) if terms else (np.zeros(0), 0)
    weights = (np.log((1 + total) / (1 + df)) + 1e-9) * (1 + z * z)
    # Examples of one label whose heaviest term is the same stand side by side: blocks of like examples have tighter bounds.
    by_weight = np.lexsort(((1 + np.log(counts)) * weights[numbers], of_row))
    last = by_weight[np.flatnonzero(np.diff(of_row[by_weight], append=-1))]
    heaviest = np.full(n_examples, -1)
    heaviest[of_row[last]] = numbers[last]
    order = np.lexsort((heaviest, of_label))
    place = np.empty(n_examples, np.int32)
    place[order] = np.arange(n_examples)
    del by_weight, last
    return ToxicityModel(terms, weights, doc_ids[order].tolist(), of_label[order], (place[of_row], numbers, counts), share)


def score(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null, empty and wordless texts, and those that share no word with an example, score the share of label 1 among the labelled
    training rows; equal texts score alike, repeated rows stay; a null
    doc_id is not held out; labels of missing documents, null labels and extra columns are ignored; empty tables give no rows.
    """
    return score_documents(docs, fit(docs, labels, folds, fold).score, folds, fold)


def evidence(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, neighbours (array of doc_id, cosine, label): what a score rests on."""

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = [[{"doc_id": d, "cosine": c, "label": x} for d, c, x in model.neighbours(t)] for t in rows.column("text").to_pylist()]
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(found, kind)], ["doc_id", "neighbours"])

    return map_slices(text_rows(docs), run, "doc_id long, neighbours array<struct<doc_id:long,cosine:double,label:int>>")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, without those that are predicted toxic and whose neighbours alone say so.

    A high share of label 1 among the labelled rows rejects nothing by itself: texts without any evidence, null and empty ones included, stay.
    """
    return filter_documents(docs, fit(docs, labels).proven, lambda s: s < THRESHOLD)
