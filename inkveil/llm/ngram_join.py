"""Near-duplicate documents by the Jaccard similarity of word shingles, with PartEnum signatures.

Sets of similar size fall in one size band or in two neighbouring ones; each band is an instance of the join with its
own partitioning of the shingle domain. If two sets reach the similarity t, they differ in at most D = (a + b)(1 - t)/(1 + t)
shingles. The domain is cut into partitions of CELLS cells each. Of any D // 2 + 1 partitions, one holds at most one
differing shingle, so the sets agree in all but one of its cells: the subsets of CELLS - 1 cells of each partition are
enumerated, and what a set has in one subset is a signature. (With D = 0 the whole set is its only signature.)

A set gives the subsets that are not empty, up to the partition with which it has D // 2 + 1 full ones (in which no subset is
empty), D being the most that any partner of it can have. Of two similar sets, take the one that ends first: among its full
partitions is one with at most one difference; the subset on which they agree is not empty and both give it. A set that has
too few full partitions gives all subsets that are not empty and takes part in a further round with other hashes as well; two
such sets meet in the first round in which one of them has enough. Only in the last of ROUNDS rounds are empty subsets given, too.
No similar pair is lost.

Candidates are checked exactly. In a bucket of one signature every set is first checked against one, the bucket's leader;
the sets that meet a leader in any bucket are its star. Pairs within a star are only looked at where the star
still holds sets of different components, each pair once a star instead of once a bucket. All pairs are first sieved by
folded parity sketches, those left by whole ones (the sketches of two sets differ in at most as many bits as the sets differ in
shingles), then checked exactly.
Sets are known by 128-bit hashes, so exact copies are one set. A bucket is read as a stream, in memory that does not grow with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import bytes_array, map_slices, materialise, sliced, text_rows
from inkveil.llm.components import connected_components

WORDS, NUMERATOR, DENOMINATOR = 5, 3, 4
_U = np.uint64
_BASE, _SALT, _SALT_2 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Least bits of a parity sketch; a larger set has at least SKETCH_SHARE bits a shingle. Sketches only drop pairs that differ too much.
SKETCH, SKETCH_SHARE = 512, 4
#: Text bytes that are cut into shingles at once (a longer text stands alone), and bytes that are hashed at once within them.
SLICE, CHUNK = 1 << 20, 1 << 18
#: Cells of a partition, of which subsets leave out one, and rounds for sets with too few full partitions.
CELLS, ROUNDS = 3, 8
#: Signatures that a task packs at once, bytes of signatures that share a key, and signatures that are looked at together.
PACKED, KEY_BYTES, AT_ONCE = 1 << 19, 24 << 20, 1 << 19
#: Sets that a task of signatures knows at once, so as not to give those of copies again (about 25 MB).
SEEN = 100_000
#: Low bits of a set's first id that its name leaves out (24 at least: a name has five bytes).
NAME_SHIFT = 24
#: Sets of a star that are compared in one block.
BLOCK = 1024
#: Sets that one group of blocks holds, about.
TASK_ROWS = 20_000
#: Sets that are to be verified are broadcast to the scan up to this number (32 bytes each, 16 MB in all), more are joined by a shuffle.
MOST_BROADCAST = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _BASE)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, n.bit_length())
        inverse = _U(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.concatenate([[_U(1)], np.cumprod(np.full(size - 1, b))]) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its shingles: A-Z lower-cased, words between white space
    (space and the bytes 9 to 13), `words` in a row; a shorter text is one shingle, one without words has none."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer((b"\n".join(raw) + b"\n").translate(_LOWER), np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    # A word's hash is the sum of its bytes' terms times powers of the base, moved to power 0; sums run over chunks, kept at the words' edges.
    power, inverse = _power(CHUNK + 1)
    edges, sums, moved, before, was_space = [], [], [], 0, True
    for begin in range(0, len(data), CHUNK):
        part = data[begin : begin + CHUNK]
        space = _SPACE[part]
        edge = np.flatnonzero(np.diff(np.concatenate([[was_space], space])))
        total = np.concatenate([[_U(0)], np.cumsum(_BYTE[part] * power[: len(part)])])
        shift, back = (pow(int(p[1]), begin, 1 << 64) for p in (power, inverse))
        edges.append(edge + begin), sums.append(total[edge] * _U(shift) + _U(before)), moved.append(inverse[edge] * _U(back))
        before, was_space = (before + shift * int(total[-1])) % (1 << 64), space[-1]
    edge, total = np.concatenate(edges), np.concatenate(sums)
    start, stop = edge[0::2], edge[1::2]
    word = mix((total[1::2] - total[0::2]) * np.concatenate(moved)[0::2] + (stop - start).astype(_U) * _SALT)
    first = np.searchsorted(start, np.concatenate([[0], ends[:-1]]))
    bounds = np.concatenate([first, [len(start)]])
    many = max(0, len(word) - words + 1)
    combined = np.zeros(many, _U)
    for k in range(words):
        combined = combined * _BASE + word[k : k + many]
    combined = mix(combined)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            s = np.sort(combined[a : b - words + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            h = _U(b - a)
            with np.errstate(over="ignore"):
                for w in word[a:b]:
                    h = h * _BASE + w
            out.append(mix(np.array([h ^ _SALT])))
        else:
            out.append(np.empty(0, _U))
    return out


def set_ids(sets: list[np.ndarray], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit ids for equal sets that are not empty. The second one of a set of one or two shingles comes from the words
    themselves, since both hashes of so few could agree by one chance."""
    if not sets:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sizes = np.array([len(s) for s in sets], np.int64)
    every, begin = np.concatenate(sets), np.cumsum(sizes) - sizes
    one, two = (mix(np.add.reduceat(mix(every ^ salt), begin) + sizes.astype(_U) * _BASE).view(np.int64) for salt in (_SALT, _SALT_2))
    for i in np.flatnonzero(sizes <= 2).tolist():
        words = b" ".join(texts[i].encode().translate(_LOWER).split())
        two[i] = int.from_bytes(hashlib.blake2b(words, digest_size=8).digest(), "little", signed=True)
    return one, two


class Bands:
    """Size bands, and what sets of a band can differ in, for a similarity of numerator/denominator."""

    def __init__(self, numerator: int = NUMERATOR, denominator: int = DENOMINATOR):
        self.n, self.d = numerator, denominator
        self.tops = [0, 1]

    def band(self, size: int) -> int:
        while self.tops[-1] < size:
            self.tops.append(max(self.tops[-1] + 1, self.tops[-1] * self.d // self.n))
        return int(np.searchsorted(self.tops, size))

    def most(self, both: int) -> int:
        """The most shingles in which two similar sets with together `both` shingles differ."""
        return both * (self.d - self.n) // (self.d + self.n)

    def instances(self, size: int) -> list[tuple[int, int, int]]:
        """(instance, partitions, D) for the set's own band and for that of larger partners."""
        own, largest = self.band(size), size * self.d // self.n
        self.band(largest + 1)
        self.band(self.tops[own] + 1)

        def parts(band: int) -> int:
            needed = self.most(2 * self.tops[band]) // 2 + 1
            return needed + needed * 3 // 20  # a reserve for those that are not full

        out = [(own, parts(own), self.most(size + min(largest, self.tops[own])))]
        if largest > self.tops[own]:
            out.append((own + 1, parts(own + 1), self.most(size + largest)))
        return out


def signatures(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """Signatures (64-bit) of one set that is not empty."""
    out = []
    for instance, parts, most in bands.instances(len(shingles)):
        if not most:
            out.append(mix(np.add.reduce(mix(shingles), keepdims=True) + np.array([instance], _U) * _SALT))
            continue
        needed = most // 2 + 1
        for turn in range(ROUNDS):
            hashed = mix(shingles ^ _U((instance * ROUNDS + turn) * 0x1F123BB5 + 1))
            cell = (hashed % _U(parts * CELLS)).astype(np.int64)
            sums = np.zeros(parts * CELLS, _U)
            np.add.at(sums, cell, mix(hashed))
            sums = sums.reshape(parts, CELLS)
            held = np.bincount(cell, minlength=parts * CELLS).reshape(parts, CELLS)
            left = held.sum(1, keepdims=True) - held  # by the cell that a subset leaves out
            full = np.flatnonzero((left > 0).all(1))
            enough = len(full) >= needed
            given = left > 0 if enough or turn < ROUNDS - 1 else np.ones_like(left, bool)
            if enough:
                given[full[needed - 1] + 1 :] = False
            part, leaves = np.nonzero(given)
            tag = (part * CELLS + leaves).astype(_U) * _BASE + left[part, leaves].astype(_U) * _SALT + _U(instance * ROUNDS + turn)
            out.append(mix((sums.sum(1, keepdims=True) - sums)[part, leaves] + mix(tag)))
            if enough:
                break
    return np.concatenate(out)


def sketch(shingles: np.ndarray) -> bytes:
    """For each of 2**k hash values whether an odd number of shingles has it; folding the halves gives the sketch for k - 1."""
    bits = max(SKETCH, 1 << (SKETCH_SHARE * len(shingles) - 1).bit_length())
    held = np.bincount((mix(shingles + _BASE) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(held.astype(bool)).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) folded to `size` words."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def may_be_similar(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> bool:
    """False only where sizes or sketches rule the similarity out."""
    size = min(len(a), len(b))
    apart = int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())
    return min(n_a, n_b) * DENOMINATOR >= max(n_a, n_b) * NUMERATOR and apart * (DENOMINATOR + NUMERATOR) <= (n_a + n_b) * (DENOMINATOR - NUMERATOR)


def similar(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> bool:
    """Exact test on sorted distinct hashes."""
    if min(n_a, n_b) * denominator < max(n_a, n_b) * numerator:
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return denominator * common >= numerator * (n_a + n_b - common)


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set, set_2 and sketch (the last three null where a text has no words)."""

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = rows.column("text").to_pylist()
        sets = shingle_sets(texts)
        n = np.array([len(s) for s in sets], np.int64)
        ids = np.zeros((2, len(n)), np.int64)
        ids[:, n > 0] = set_ids([s for s in sets if len(s)], [t for t, k in zip(texts, n, strict=True) if k])
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n), *(pa.array(i, mask=n == 0) for i in ids), bytes_array([sketch(s) if len(s) else None for s in sets])], ["doc_id", "n_shingles", "set", "set_2", "sketch"])

    return map_slices(text_rows(docs), run, "doc_id long, n_shingles long, set long, set_2 long, sketch binary", most=SLICE)


def _five(values: np.ndarray) -> bytes:
    """The low five bytes of each value."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_five(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def set_name(column: str) -> Column:
    """The high bits of a set's first id: what goes with its signatures. Different sets of one name are candidates of their own."""
    return F.shiftrightunsigned(column, NAME_SHIFT)


def _packed(signature: np.ndarray, names: np.ndarray, n_keys: int) -> pa.RecordBatch:
    """For each key one row: 5-byte signatures (a chance hit only makes one more candidate), and, for each run of signatures
    of one set, its name in 5 bytes and the length of the run in one (a longer one is several)."""
    key = (signature % _U(n_keys)).astype(np.int32)
    order = np.argsort(key, kind="stable")
    key, names, short = key[order], names[order], _five(signature[order] >> _U(24))
    rows = np.flatnonzero(np.diff(key, prepend=-1, append=-1))
    first = np.flatnonzero((np.diff(key, prepend=-1) != 0) | np.append(True, names[1:] != names[:-1]))
    length = np.diff(first, append=len(key))
    pieces = -(-length // 255)
    nth, of = _nth(pieces)
    counts = np.minimum(255, length[of] - 255 * nth).astype(np.uint8)
    runs = np.searchsorted(first[of] + 255 * nth, rows).tolist()
    cut = lambda raw, width, at: bytes_array([raw[width * i : width * j] for i, j in zip(at[:-1], at[1:], strict=True)])
    return pa.RecordBatch.from_arrays([pa.array(key[rows[:-1]]), cut(short, 5, rows.tolist()), cut(_five(names[first[of]]), 5, runs), cut(counts.tobytes(), 1, runs)], ["key", "signatures", "sets", "counts"])


def _nth(pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 within each run of pieces, and the run of each."""
    of = np.repeat(np.arange(len(pieces)), pieces)
    return np.arange(len(of)) - (np.cumsum(pieces) - pieces)[of], of


def _signature_rows(docs: DataFrame, n_keys: int) -> DataFrame:
    """Signatures packed before the shuffle. A task sends those of one set once, as long as it knows the set as one of the last SEEN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, parts, held, seen = Bands(), [], 0, set()
        for batch in batches:
            for rows in sliced(batch, "text", SLICE):
                texts = rows.column("text").to_pylist()
                some = [(s, t) for s, t in zip(shingle_sets(texts), texts, strict=True) if len(s)]
                one, two = set_ids([s for s, _ in some], [t for _, t in some])
                for (shingles, _), name, known in zip(some, (one.view(np.uint64) >> _U(NAME_SHIFT)).tolist(), zip(one.tolist(), two.tolist(), strict=True), strict=True):
                    if known in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(known)
                    own = signatures(shingles, bands)
                    parts.append((own, np.full(len(own), name, np.uint64)))
                    held += len(own)
                    if held >= PACKED:
                        yield _packed(*(np.concatenate(p) for p in zip(*parts, strict=True)), n_keys)
                        parts, held = [], 0
        if parts:
            yield _packed(*(np.concatenate(p) for p in zip(*parts, strict=True)), n_keys)

    return text_rows(docs).mapInArrow(run, "key int, signatures binary, sets binary, counts binary")


class _Leaders:
    """The leaders of the buckets of one key: per signature the first set that is met."""

    def __init__(self) -> None:
        self.signatures, self.sets = np.empty(0, np.uint64), np.empty(0, np.int64)

    def meet(self, signatures: np.ndarray, sets: np.ndarray) -> np.ndarray:
        """Pairs (leader, set), each once, for further members of buckets."""
        order = np.lexsort((sets, signatures))
        signatures, sets = signatures[order], sets[order]
        begin = np.flatnonzero(np.diff(signatures, prepend=~signatures[:1]))
        own, leader = signatures[begin], sets[begin].copy()
        at = np.searchsorted(self.signatures, own)
        known = at < len(self.signatures)
        known[known] = self.signatures[at[known]] == own[known]
        leader[known] = self.sets[at[known]]
        head = np.repeat(leader, np.diff(begin, append=len(sets)))
        other = head != sets
        pairs = np.stack([head[other], sets[other]], 1)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        self.signatures, self.sets = np.insert(self.signatures, at[~known], own[~known]), np.insert(self.sets, at[~known], leader[~known])
        return pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)])] if len(pairs) else pairs


def _stars(packed: DataFrame, tasks: int) -> DataFrame:
    """Pairs (a, b) of the names of leaders and of other sets of their buckets; memory is bounded by the signatures of one key.

    Keys are numbers that go round the tasks, so every task gets as many of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leaders, signatures, sets, held = None, _Leaders(), [], [], 0

        def met() -> pa.RecordBatch:
            pairs = leaders.meet(_from_five(b"".join(signatures)), np.concatenate(sets).astype(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            for k, s, i, c in zip(*(batch.column(c) for c in ("key", "signatures", "sets", "counts")), strict=True):
                if key is not None and (k.as_py() != key or held >= AT_ONCE):
                    yield met()
                    signatures, sets, held = [], [], 0
                    if k.as_py() != key:
                        leaders = _Leaders()
                key = k.as_py()
                signatures.append(s.as_py()), sets.append(np.repeat(_from_five(i.as_py()), np.frombuffer(c.as_py(), np.uint8)))
                held += len(sets[-1])
        if signatures:
            yield met()

    # The order is total, so that a task that runs again chooses the same leaders.
    ordered = packed.repartitionById(tasks, F.pmod("key", F.lit(tasks))).sortWithinPartitions("key", "signatures", "sets", "counts")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def _shingles_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls, n, shingles (binary, 8 bytes each) of the sets in `wanted` (cls, set, set_2, and doc_id of a text with it).

    A set's row goes to its text, and the text's own set tells whether it is the one, so no shingles are shuffled for it.
    """

    def run(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        texts = rows.column("text").to_pylist()
        known = list(zip(*(rows.column(c).to_pylist() for c in ("cls", "set", "set_2")), strict=True))
        some = [(s, t, k) for s, t, k in zip(shingle_sets(texts), texts, known, strict=True) if len(s)]
        one, two = set_ids([s for s, _, _ in some], [t for _, t, _ in some])
        own = [(cls, s) for (s, _, (cls, x, y)), a, b in zip(some, one.tolist(), two.tolist(), strict=True) if (a, b) == (x, y)]
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in own], pa.int64()), pa.array([len(s) for _, s in own], pa.int64()), bytes_array([s.astype("<u8").tobytes() for _, s in own])], ["cls", "n", "shingles"])

    wanted = wanted.withColumnRenamed("doc_id", "wanted")
    few = wanted.count() <= MOST_BROADCAST
    chosen = text_rows(docs).join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("wanted")))
    return map_slices(chosen.select("text", "cls", "set", "set_2"), run, "cls long, n long, shingles binary", most=SLICE)


def coarse(bits: bytes, n: int) -> bytes:
    """The sketch of a set of n shingles, folded to about a bit a shingle: a quarter of it, enough to drop most pairs."""
    return folded(np.frombuffer(bits, "<u8"), max(SKETCH, 1 << (n - 1).bit_length()) // 64).tobytes()


def _coarse(sets: DataFrame) -> DataFrame:
    """cls, name, n and the coarse sketch of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = [coarse(s.as_buffer(), n) for s, n in zip(batch.column("sketch"), batch.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("name"), batch.column("n"), bytes_array(small)], ["cls", "name", "n", "sketch"])

    return sets.select("cls", set_name("set").alias("name"), "n", "sketch").mapInArrow(run, "cls long, name long, n long, sketch binary")


def _sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s_a, s_b = batch.column("sketch_a"), batch.column("sketch_b")
        good = [may_be_similar(np.frombuffer(s_a[i].as_buffer(), "<u8"), n_a, np.frombuffer(s_b[i].as_buffer(), "<u8"), n_b) for i, (n_a, n_b) in enumerate(zip(batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist(), strict=True))]
        yield pa.RecordBatch.from_arrays([batch.column("cls_a"), batch.column("cls_b"), pa.array(good, pa.bool_())], ["a", "b", "likely"])


def _sides(pairs: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """Pairs of keys (a, b) with what _sieve reads of both sets."""
    side = lambda x: sets.select(F.col(key).alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("cls", "n", "sketch")])
    return pairs.join(side("b"), "b").drop("b").join(side("a"), "a").drop("a")


def _close(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that whole sketches let through; pairs is a written table. Only sketches of their sets are joined."""
    ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    own = materialise(ends.join(sets.select("cls", "n", "sketch"), "cls"), "sketches")
    return _sides(pairs, own, "cls").mapInArrow(_sieve, "a long, b long, likely boolean").filter("likely").select("a", "b")


def _sieved(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of names as pairs of sets, with likely: whether sizes and coarse sketches do not rule the pair out.

    A member's coarse sketch goes to its leader once a star. Different sets of one name are pairs as well.
    """
    named = sets.select("cls", set_name("set").alias("name"))
    alike = named.groupBy("name").agg(F.min("cls").alias("cls_a"), F.count("*").alias("m")).filter("m > 1").select("name", "cls_a")
    alike = alike.join(named, "name").filter("cls_a <> cls").select(F.col("cls_a").alias("a"), F.col("cls").alias("b"), F.lit(True).alias("likely"))
    return _sides(stars, _coarse(sets), "name").mapInArrow(_sieve, "a long, b long, likely boolean").unionByName(alike)


def _verified(docs: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity, as (u, v): exact, on all shingles."""
    ends = materialise(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct().join(sets.select("cls", "set", "set_2", "least"), "cls"), "ends")
    shingles = materialise(_shingles_of(docs, ends.withColumnRenamed("least", "doc_id")), "shingles", "lz4")
    if shingles.count() > ends.count():  # rows that repeat an id and its text
        shingles = materialise(shingles.groupBy("cls").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")), "shingles", "lz4")
    left = shingles.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    right = shingles.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s_a, s_b = batch.column("s_a"), batch.column("s_b")
            good = [similar(np.frombuffer(s_a[i].as_buffer(), "<u8"), n_a, np.frombuffer(s_b[i].as_buffer(), "<u8"), n_b) for i, (n_a, n_b) in enumerate(zip(batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist(), strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(check, "u long, v long").distinct()


def _rest_of_stars(stars: DataFrame, components: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components within a star that sizes and coarse sketches let through; large stars are cut into blocks."""
    placed = stars.select(F.col("a").alias("star"), F.col("b").alias("set")).distinct().join(components.select(F.col("node").alias("set"), "component"), "set", "left").select("star", "set", F.coalesce("component", "set").alias("component"))
    mixed = placed.groupBy("star").agg(F.count("*").alias("m"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("star", "m", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    mixed = materialise(mixed, "mixed")
    total = mixed.agg(F.coalesce(F.sum(F.col("m") * F.col("blocks")), F.lit(0))).first()[0]
    rows = placed.join(mixed.drop("m"), "star").join(_coarse(sets).select(F.col("cls").alias("set"), "n", "sketch"), "set")
    spread = rows.withColumn("own", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("star", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "set", "component", "n", "sketch")
    tasks = max(8 * int(stars.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK_ROWS)  # blocks are many and mostly small: some share a group
    spread = spread.withColumn("task", F.pmod(F.xxhash64("star", "i", "j"), F.lit(tasks)))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["star", "i", "j", "n"])
        block = group[["star", "i", "j"]].to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]).any(1), [True]]))
        n_all, component_all, id_all, own_all = (group[c].to_numpy() for c in ("n", "component", "set", "own"))
        sketches = [np.frombuffer(s, "<u8") for s in group["sketch"]]
        out = [np.empty((0, 2), np.int64)]
        for first, after in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            n, component, ids, own = n_all[first:after], component_all[first:after], id_all[first:after], own_all[first:after]
            size, across = [len(s) for s in sketches[first:after]], block[first, 1] != block[first, 2]
            bits, begin = np.empty((0, 0), np.uint64), 0
            ends = np.searchsorted(n, n * DENOMINATOR // NUMERATOR, side="right").tolist()  # partners are at most so large
            for k, to in enumerate(ends):
                if to <= k + 1:
                    continue
                if size[k] != bits.shape[1]:  # sketches of this size and, folded, of the next
                    begin, last = k, int(np.searchsorted(size, 2 * size[k], side="right"))
                    bits = np.stack([folded(s, size[k]) for s in sketches[first + k : first + last]])
                fits = component[k + 1 : to] != component[k]
                if across:
                    fits &= own[k + 1 : to] != own[k]
                at = k + 1 + np.flatnonzero(fits)
                apart = np.bitwise_count(bits[k - begin] ^ bits[at - begin]).sum(1, dtype=np.int64)
                hit = at[apart * (DENOMINATOR + NUMERATOR) <= (n[k] + n[at]) * (DENOMINATOR - NUMERATOR)]
                out.append(np.stack([np.full(len(hit), ids[k]), ids[hit]], 1))
        pairs = np.unique(np.sort(np.concatenate(out), 1), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return spread.groupBy("task").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Links as in the module's text, with five words and a similarity of 0.75; nothing is capped or sampled. Null and empty texts and
    those of white space only have no shingles and stand alone; repeated rows are one set, as are texts with equal shingles; a null
    doc_id takes part and is never the smallest unless alone (then null); extra columns are ignored; an empty table gives an empty one.
    """
    own = materialise(document_sets(docs), "sets")
    sets = own.filter("set is not null").groupBy("set", "set_2").agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    sets = materialise(sets.withColumn("cls", F.monotonically_increasing_id()), "classes")
    shingles = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_keys = tasks * max(1, -(-shingles * 10 // (tasks * KEY_BYTES)))
    stars = materialise(_sieved(_stars(_signature_rows(docs, n_keys), tasks), sets), "stars")
    close = materialise(_close(stars.filter("likely").select("a", "b"), sets), "close")
    links = materialise(_verified(docs, close, sets), "links")
    components = materialise(connected_components(links), "components")
    rest = materialise(_rest_of_stars(stars, components, sets), "rest")
    rest = materialise(_close(rest, sets), "close")
    if not rest.isEmpty():
        more = _verified(docs, rest, sets)
        components = materialise(connected_components(links.unionByName(more)), "components")
    placed = sets.join(components.select(F.col("node").alias("cls"), "component"), "cls", "left").select("set", "set_2", "least", F.coalesce("component", "cls").alias("component"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    known = materialise(placed.join(least, "component").select("set", "set_2", "component_id"), "classes")
    return own.drop("sketch").join(known, ["set", "set_2"], "left").select("doc_id", "n_shingles", F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
