"""Near-duplicate embeddings of equal label: PCA-ordered tiled comparison.

Vectors are turned so that leading dimensions carry most of the variance. Vectors of one label are laid on a grid by their
leading two turned coordinates: unit vectors with a cosine of at least t differ by at most sqrt(2 - 2t) in
each, so only neighbouring cells are compared. A cell is cut into tiles of bounded size (in rows and bytes). Pairs of tiles
are enumerated by their numbers alone and dealt out by a hash of the pair, and each fetches its vectors by tile number, so
a crowded cell is the work of many tasks. Two tiles are compared by
accumulating products over leading dimensions; the rest is bounded by the product of the suffix norms, and a pair
stops as soon as its cosine cannot reach t. What is left is checked exactly on the stored vectors.
Tiles return link counts and a spanning forest, so rows grow with vectors, not with pairs. Equal vectors are one class, known
by a 128-bit hash of label and vector: vectors are never the key of a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import arrow_rows, materialise
from inkveil.llm.components import connected_components

#: Vectors of a tile, bytes of a tile, rows of the one tile that are compared with the other at once, and bytes of a batch of pairs.
TILE, TILE_BYTES, ROWS, BATCH_BYTES = 2048, 2 << 20, 256, 32 << 20
#: Leading dimensions are added in steps of so many.
STEP = 8
_SLACK = 1e-9


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(rows, -1)


def _second_moments(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By dimension, the sum of u uT over unit vectors; d x d numbers reach the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == d))
                x = _matrix(rows.column("embedding"), rows.num_rows)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array(s.tolist(), pa.list_(pa.float64()))], ["dim", "i", "sums"])

    entries = vectors.select("dim", "embedding").mapInArrow(partial, "dim int, i int, sums array<double>").select("dim", "i", F.posexplode("sums").alias("j", "s"))
    out: dict[int, np.ndarray] = {}
    for r in entries.groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).collect():
        out.setdefault(r.dim, np.zeros((r.dim, r.dim)))[r.i, r.j] = r.s
    return out


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By dimension, an orthogonal matrix whose columns are the axes in the order of falling variance."""
    return {d: np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy() for d, m in _second_moments(vectors).items()}


def links_of_tiles(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of the pairs with a cosine of at least threshold; i < j where both tiles are one."""
    norm_a, norm_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    x, y = (a / norm_a[:, None]) @ axes, (b / norm_b[:, None]) @ axes
    rest = lambda z: np.pad(np.sqrt(np.maximum(np.cumsum((z**2)[:, ::-1], axis=1)[:, ::-1], 0)), ((0, 0), (0, 1)))
    rest_x, rest_y = rest(x), rest(y)
    d, lead, found = x.shape[1], min(STEP, x.shape[1]), []
    for begin in range(0, len(a), ROWS):
        own = slice(begin, begin + ROWS)
        dots = x[own, :lead] @ y[:, :lead].T
        possible = dots + np.outer(rest_x[own, lead], rest_y[:, lead]) >= threshold - _SLACK
        if same:
            possible &= np.arange(len(b)) > np.arange(begin, begin + len(possible))[:, None]
        i, j = np.nonzero(possible)
        dots, i, at = dots[i, j], i + begin, lead
        while at < d and len(i):
            to = min(d, at + STEP)
            dots = dots + np.einsum("ij,ij->i", x[i, at:to], y[j, at:to])
            open_ = dots + rest_x[i, to] * rest_y[j, to] >= threshold - _SLACK
            i, j, dots, at = i[open_], j[open_], dots[open_], to
        exact = np.einsum("ij,ij->i", a[i], b[j]) / (norm_a[i] * norm_b[j]) >= threshold
        found.append((i[exact], j[exact]))
    i, j = (np.concatenate(f) for f in zip(*found, strict=True))
    return i, j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node number that the pairs reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def near_links(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile: int = TILE) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, they have as many components, and their cosine (double
    precision) is at least threshold; null, empty or zero vectors and those with null or non-finite components link with
    nothing, nor do rows with a null id (component_id null, kept false). n_links counts linked other rows; equal vectors are compared
    once and counted as often as they stand. Rows that share an id count as one node, with the links of all of them. Extra columns are ignored; an empty table gives an empty one.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    sound = F.expr("vec_id is not null and label is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    keyed = rows.filter("sound").select("vec_id", "label", "embedding", F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit("second"), "embedding", "label").alias("h2"))
    classes = keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("cls"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = materialise(classes.select("h1", "h2", "cls", "label", F.size("embedding").alias("dim"), "embedding", "copies"), "classes")
    axes = principal_axes(classes)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros((batch.num_rows, 2), np.int32)
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == d))
                x = _matrix(rows.column("embedding"), rows.num_rows)
                turned = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes[d][:, :2]
                cells[dims == d, : turned.shape[1]] = np.floor(turned / reach)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h1", "h2", "label", "dim")), pa.array(cells[:, 0]), pa.array(cells[:, 1])], ["h1", "h2", "label", "dim", "x", "y"])

    # Vectors are told apart by their class's hash from here on; they are read again when tiles are put together.
    cell = ["label", "dim", "x", "y"]
    kinds = dict(classes.dtypes)
    laid = materialise(classes.select("h1", "h2", "label", "dim", "embedding").mapInArrow(lay, f"h1 long, h2 long, label {kinds['label']}, dim int, x int, y int"), "cells")
    # Cells are numbered; a tile is a cell's number and its own within the cell.
    most = F.greatest(F.lit(1), F.least(F.lit(tile), F.floor(F.lit(TILE_BYTES) / (8 * F.col("dim")))))
    cells = materialise(laid.groupBy(*cell).agg(F.ceil(F.count("*") / most).cast("int").alias("tiles")).withColumn("cell", F.monotonically_increasing_id()), "numbers")
    placed = laid.join(cells, cell).select("h1", "h2", "cell", F.pmod(F.xxhash64("h1", F.lit("tile")), F.col("tiles")).cast("int").alias("sub"))
    found = classes.join(placed, ["h1", "h2"]).select("dim", "cell", "sub", F.struct("cls", "copies", "embedding").alias("row"))
    tiles = found.withColumn("tile", F.xxhash64("cell", "sub")).repartition("tile").groupBy("tile", "cell", "sub").agg(F.first("dim").alias("dim"), F.collect_list("row").alias("rows"))
    tiles = materialise(tiles.drop("tile"), "tiles")
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])).alias("step")
    one = cells.select("label", "dim", "x", "y", F.col("cell").alias("a_cell"), F.col("tiles").alias("a_tiles"), steps).withColumns({"x": F.col("x") + F.col("step.dx"), "y": F.col("y") + F.col("step.dy")})
    near = one.join(cells.withColumnsRenamed({"cell": "b_cell", "tiles": "b_tiles"}), cell)
    pairs = near.select("dim", "a_cell", "b_cell", "b_tiles", F.explode(F.sequence(F.lit(0), F.col("a_tiles") - 1)).alias("a_sub")).repartition(F.xxhash64("a_cell", "a_sub", "b_cell"))
    pairs = pairs.select("dim", "a_cell", "a_sub", "b_cell", F.explode(F.sequence(F.when(F.col("a_cell") == F.col("b_cell"), F.col("a_sub")).otherwise(0), F.col("b_tiles") - 1)).alias("b_sub"))
    side = lambda s: tiles.select(F.col("cell").alias(f"{s}_cell"), F.col("sub").alias(f"{s}_sub"), F.col("rows").alias(f"{s}_rows"))
    pairs = pairs.join(side("a"), ["a_cell", "a_sub"]).join(side("b"), ["b_cell", "b_sub"])
    pairs = pairs.select("dim", F.expr("a_cell = b_cell and a_sub = b_sub").alias("same"), "a_rows", "b_rows")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                a, b = (batch.column(c).slice(r, 1).flatten() for c in ("a_rows", "b_rows"))
                same, turn = batch.column("same")[r].as_py(), axes[batch.column("dim")[r].as_py()]
                i, j = links_of_tiles(_matrix(a.field("embedding"), len(a)), _matrix(b.field("embedding"), len(b)), turn, threshold, same)
                if not len(i):
                    continue
                ids = np.concatenate([x.field("cls").to_numpy() for x in (a, b)])
                copies = np.concatenate([x.field("copies").to_numpy() for x in (a, b)])
                j = j if same else j + len(a)
                n = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
                root = forest(len(ids), i, j)
                least = np.full(len(ids), np.iinfo(np.int64).max)
                np.minimum.at(least, root, ids)
                met = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[met]), pa.array(n[met].astype(np.int64)), pa.array(least[root[met]])], ["cls", "n", "root"])

    with arrow_rows(vectors.sparkSession, max(1, BATCH_BYTES // (2 * TILE_BYTES))):
        found = materialise(pairs.mapInArrow(compare, "cls long, n long, root long"), "links")
    counts = found.groupBy("cls").agg(F.sum("n").alias("others"))
    components = connected_components(found.select(F.col("cls").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("cls"), "component")
    linked = classes.select("h1", "h2", "cls", "copies").join(counts, "cls", "left").join(components, "cls", "left")
    linked = materialise(linked.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component_id")), "classes")
    good = keyed.select("vec_id", "h1", "h2").join(linked, ["h1", "h2"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = rows.filter("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    return good.unionByName(alone)
