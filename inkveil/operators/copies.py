"""Near copies of pages: MinHash signatures and banding as expressions, exact Jaccard after it, no Python.

A text's set are its shingles of five words as 64-bit hashes. For each of BANDS * ROWS hash functions the least value over the set is kept; texts that
agree in all ROWS values of one of the BANDS meet in a bucket. In a bucket each text is compared with the bucket's first one, so a bucket of many copies
costs its rows; the exact similarity of the sets decides. Exact copies are one set before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.text import let
from inkveil.operators.groups import connected, written

WORDS, NUMERATOR, DENOMINATOR = 5, 3, 4
BANDS, ROWS = 16, 3


def shingles(text: Column, words: int = WORDS) -> Column:
    """Distinct hashes of the runs of `words` words (in lower case, split at white space); fewer words are one shingle, none are none."""

    def runs(own: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(own) - (words - 1), F.lit(1)))
        return F.when(F.size(own) > 0, F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(own, i, words), " "))))).otherwise(F.array().cast("array<long>"))

    return let(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: w != ""), runs)


def bands(own: Column) -> Column:
    """One hash for each band of a set's MinHash signature."""
    least = lambda k: F.array_min(F.transform(own, lambda h: F.xxhash64(h, F.lit(k))))
    return F.array(*[F.xxhash64(F.lit(b), *[least(b * ROWS + r) for r in range(ROWS)]) for b in range(BANDS)])


def near_copies(pages: DataFrame) -> DataFrame:
    """key, n_shingles, class, similarity from (key, text): the class is the least key that links of a similarity of 0.75 or more reach, over links
    that MinHash finds; similarity is the exact one to the best bucket's first text (null where there is none, 1 for exact copies).

    Null and empty texts have no shingles and stand alone; repeated keys are looked at by text each.
    """
    held = written(pages.select("key", shingles(F.col("text")).alias("s")).withColumn("n_shingles", F.size("s").cast("long")).withColumn("set", F.when(F.col("n_shingles") > 0, F.xxhash64(F.array_sort("s")))), "shingles")
    sets = written(held.filter("n_shingles > 0").groupBy("set").agg(F.first("s").alias("s"), F.min("key").alias("least"), F.count("*").alias("copies")), "sets")
    banded = sets.select("set", F.posexplode(bands(F.col("s"))).alias("band", "h"))
    first = banded.groupBy("band", "h").agg(F.min("set").alias("first"), F.count("*").alias("m")).filter("m > 1")
    pairs = banded.join(first, ["band", "h"]).filter("set <> first").select("set", "first").distinct()
    sides = pairs.join(sets.select("set", F.col("s").alias("a")), "set").join(sets.select(F.col("set").alias("first"), F.col("s").alias("b")), "first")
    common = F.size(F.array_intersect("a", "b")).cast("long")
    checked = sides.select("set", "first", common.alias("both"), (F.size("a") + F.size("b") - common).alias("any")).filter(f"both * {DENOMINATOR} >= any * {NUMERATOR}")
    links = written(checked.select("set", "first", (F.col("both") / F.col("any")).alias("similarity")), "links")
    edges = links.select(F.struct("set", "first").alias("link"), F.explode(F.array("set", "first")).alias("node"))
    labels = connected(edges)
    classed = sets.join(labels.select(F.col("node").alias("set"), "label"), "set", "left").withColumn("label", F.coalesce("label", "set"))
    least = classed.groupBy("label").agg(F.min("least").alias("class"))
    best = links.groupBy("set").agg(F.max("similarity").alias("similarity"))
    known = classed.join(least, "label").join(best, "set", "left").select("set", "class", F.coalesce("similarity", F.when(F.col("copies") > 1, F.lit(1.0))).alias("similarity"))
    return held.drop("s").join(known, "set", "left").select("key", "n_shingles", F.coalesce("class", "key").alias("class"), "similarity")
