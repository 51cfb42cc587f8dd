"""URL lists by host and path, with DataFrame functions only.

A listed rule is (host, path, verdict); it fits its host and all subdomains where the url's path starts with the
rule's, and the longest fitting rule wins. A url's candidate keys are its host's domain suffixes with as many labels as
hosts in the list have, each with the path prefixes of the lengths that occur in the list. A blocked Bloom filter of the listed keys (each key sets bits within one
512-bit block) drops nearly all keys that are not listed, inside the row; the few that pass go to an exact hash
join with the list, which removes false positives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, PROBES, BITS_A_RULE = 8, 4, 16
#: The filter has at most so many 512-bit blocks (64 KB); longer lists only let more false positives through to the join.
MOST_BLOCKS = 1024
#: A list of at most so many rules (some 100 bytes each) is broadcast to the join, a longer one is shuffled.
MOST_BROADCAST = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end; both empty without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _probe_words(key: Column, n_blocks: int) -> tuple[Column, Column]:
    """The key's block, and its mask within each of the block's words as an array."""
    block = F.pmod(F.xxhash64(key), F.lit(n_blocks))
    bits = [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(WORDS * 64)) for i in range(PROBES)]

    def mask(word: int) -> Column:
        out = F.lit(0).cast("long")
        for bit in bits:
            one = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
            out = out.bitwiseOR(F.when(F.floor(bit / 64) == word, one).otherwise(F.lit(0).cast("long")))
        return out

    return block, F.array(*[mask(w) for w in range(WORDS)])


def bloom_words(rules: DataFrame, n_rules: int) -> tuple[int, list[int]]:
    """(number of blocks, words of all blocks in order) for the column rule; its size is bounded by MOST_BLOCKS."""
    n_blocks = min(MOST_BLOCKS, max(1, -(-n_rules * BITS_A_RULE // (WORDS * 64))))
    block, masks = _probe_words(F.col("rule"), n_blocks)
    ones = rules.select(block.alias("block"), F.posexplode(masks).alias("word", "mask")).groupBy("block", "word").agg(F.bit_or("mask").alias("mask"))
    words = [0] * (n_blocks * WORDS)
    for r in ones.collect():
        words[r.block * WORDS + r.word] = r.mask
    return n_blocks, words


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule (host and path of the winning rule, else null), verdict.

    A null or malformed url has empty host and path and the default verdict; repeated rows are judged alike and stay;
    extra columns are ignored; an empty list gives the default everywhere. Of rules listed twice the verdict that sorts
    last (block) holds. rules: a DataFrame (host, path, verdict) or such tuples.
    """
    spark = pages.sparkSession
    listed = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "host string, path string, verdict string")
    listed = listed.select(F.concat(F.translate("host", _UPPER, _LOWER), F.col("path")).alias("rule"), "verdict", F.length("path").alias("n"), F.size(F.split("host", r"\.")).alias("labels")).filter("rule is not null")
    listed = listed.groupBy("rule").agg(F.max("verdict").alias("rule_verdict"), F.max("n").alias("n"), F.max("labels").alias("labels"))
    facts = listed.agg(F.count("*").alias("n"), F.collect_set("n").alias("lengths"), F.collect_set("labels").alias("labels")).first()
    host, path = host_and_path(F.col(url_col))
    base = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if not facts.n:
        return base.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    n_blocks, words = bloom_words(listed, facts.n)
    bloom = F.array(*[F.lit(w).cast("long") for w in words])

    def passes(key: Column) -> Column:
        block, masks = _probe_words(key, n_blocks)
        word = lambda i: F.element_at(bloom, (block * WORDS + i + 1).cast("int"))
        return F.forall(F.transform(masks, lambda m, i: word(i).bitwiseAND(m) == m), lambda ok: ok)

    labels = F.split(F.col("host"), r"\.")
    suffixes = [F.when(F.size(labels) >= n, F.array_join(F.slice(labels, F.greatest(F.size(labels) - (n - 1), F.lit(1)), F.lit(n)), ".")) for n in sorted(facts.labels)]
    keys = F.array(*[F.when(F.length("path") >= n, F.concat(s, F.left(F.col("path"), F.lit(n)))) for s in suffixes for n in sorted(facts.lengths)])
    keyed = base.withColumn("keys", F.filter(F.filter(keys, lambda k: k.isNotNull()), passes)).withColumn("row", F.monotonically_increasing_id())
    none = keyed.filter(F.size("keys") == 0).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    possible = keyed.filter(F.size("keys") > 0).select("row", "page_id", "host", "path", F.explode("keys").alias("rule"))
    exact = possible.join(F.broadcast(listed) if facts.n <= MOST_BROADCAST else listed, "rule", "left")
    best = F.max(F.when(F.col("rule_verdict").isNotNull(), F.struct(F.length("rule").alias("n"), F.col("rule"), F.col("rule_verdict"))))
    found = exact.groupBy("row", "page_id", "host", "path").agg(best.alias("best"))
    return none.unionByName(found.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")))
