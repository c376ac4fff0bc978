"""Bloom filter, Flajolet-Martin distinct counts, deterministic reservoirs: batch forms, all in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.hashing import text_mod, trailing_zeros

BLOOM_HASHES, BITS_PER_KEY, FM_HASHES = 5, 50, 100


def positions(text: Column, m: int, hashes: int = BLOOM_HASHES) -> Column:
    x = text_mod(text, m)
    return F.array(*(F.pmod(F.lit(i * 7919 + 17) * x + i * 104729 + 31, F.lit(m)).cast("long") for i in range(hashes)))


def bloom_build(train: DataFrame, col: str) -> tuple[DataFrame, int]:
    """The set positions (pos), and the number of bits: 50 for each distinct non-empty key."""
    keys = train.select(F.col(col).alias("k")).where("k <> ''").distinct()
    m = max(1, BITS_PER_KEY * keys.count())
    return keys.select(F.explode(positions(F.col("k"), m)).alias("pos")).distinct(), m


def bloom_probe(probe: DataFrame, col: str, bits: DataFrame, m: int) -> DataFrame:
    """Per distinct key (k, hit): 1 if all positions are set; 0 for empty and null keys."""
    keys = probe.select(F.coalesce(F.col(col), F.lit("")).alias("k")).distinct()
    each = keys.select("k", F.explode_outer(F.array_distinct(positions(F.col("k"), m))).alias("pos"))
    hit = each.join(bits.withColumn("set", F.lit(1)), "pos", "left").groupBy("k").agg(F.min(F.coalesce("set", F.lit(0))).alias("hit"))
    return hit.select("k", F.when(F.col("k") == "", 0).otherwise(F.col("hit")).alias("hit"))


def bloom_probe_rows(probe: DataFrame, order: str, col: str, bits: DataFrame, m: int) -> DataFrame:
    """Per row of probe (order, hit), to be written in the order of that column; each key is tested once."""
    hits = bloom_probe(probe, col, bits, m)
    return probe.select(F.col(order).alias("order"), F.coalesce(F.col(col), F.lit("")).alias("k")).join(hits, "k").select("order", "hit")


def fm_sums(keys: DataFrame, groups: list[str]) -> DataFrame:
    """Distinct keys of each group, (groups, k, n_rows), each standing for n_rows rows -> (groups, s, w, truth, n_rows): the sum of
    a key's characters' codes, and that of the codes times their places. The hashes of a key depend on these two only, so keys of
    equal sums are one row, truth of them; of keys that are not hashed (null, empty) both are null."""
    code = lambda j: F.ascii(F.substr(F.col("k"), j, F.lit(1)))
    places, none, hashed = F.sequence(F.lit(1), F.length("k")), F.lit(0).cast("long"), F.col("k") != ""
    s, w = F.aggregate(places, none, lambda a, j: a + code(j)), F.aggregate(places, none, lambda a, j: a + code(j) * (j - 1))
    sums = keys.select(*groups, F.when(hashed, s).alias("s"), F.when(hashed, w).alias("w"), "n_rows")
    return sums.groupBy(*groups, "s", "w").agg(F.count("*").alias("truth"), F.sum("n_rows").alias("n_rows"))


def fm_of_sums(sums: DataFrame, groups: list[str]) -> DataFrame:
    """The rows of fm_sums() -> (groups, truth, estimate, accuracy)."""
    size = sums.groupBy(*groups).agg(F.coalesce(F.sum("truth"), F.lit(0)).alias("truth"), F.sum("n_rows").alias("n_rows"))
    size = size.dropna(subset=groups) if groups else size
    pairs = sums.where("s IS NOT NULL").select(*groups, "s", "w")
    pairs = pairs.join(size, groups) if groups else pairs.crossJoin(F.broadcast(size))
    m = F.pow(F.lit(2.0), F.floor(F.log2("n_rows"))).cast("long")
    each = pairs.select(*groups, m.alias("m"), F.explode(F.sequence(F.lit(0), F.lit(FM_HASHES - 1))).alias("i"), "s", "w")
    r = trailing_zeros(F.pmod(F.col("s") * F.col("i") + F.col("w"), F.col("m")))
    per = each.groupBy(*groups, "i").agg(F.pow(F.lit(2.0), F.max(r) - F.min(r)).alias("e"))
    trimmed = per.groupBy(*groups).agg(F.ceil((F.sum("e") - F.min("e") - F.max("e")) / (F.count("*") - 2)).alias("estimate"))
    both = size.join(trimmed, groups, "left") if groups else size.crossJoin(trimmed)
    return both.select(*groups, "truth", "estimate", (1 - F.abs(F.col("truth") - F.col("estimate")) / F.col("truth")).alias("accuracy"))


def fm_estimate(rows: DataFrame, groups: list[str], key: str, weight: str | None = None) -> DataFrame:
    """rows of a key, each standing for weight rows (else one) -> (groups, truth, estimate, accuracy): hash i of a key is the sum of its characters' codes times (i + place),
    modulo the power of two at or below the number of rows; 2^(greatest - least trailing zeros) per hash, the
    lowest and highest left out, averaged and rounded up. Only distinct keys are hashed."""
    keys = rows.select(*groups, F.col(key).alias("k"), (F.col(weight) if weight else F.lit(1)).alias("c")).groupBy(*groups, "k").agg(F.sum("c").alias("n_rows"))
    return fm_of_sums(fm_sums(keys, groups), groups)


def reservoir(rows: DataFrame, key: str, capacity: int = 100) -> DataFrame:
    """A uniform sample by the smallest MD5 values of a key: the same rows in every run and layout, one top-k pass."""
    return rows.withColumn("_h", F.md5(F.col(key).cast("string"))).orderBy("_h", key).limit(capacity).drop("_h")


def top_tags(sample: DataFrame, tag: str, ranks: int = 3) -> DataFrame:
    """(tag, n) of the `ranks` greatest distinct counts."""
    counts = sample.groupBy(F.col(tag).alias("tag")).agg(F.count("*").alias("n"))
    best = counts.select("n").distinct().orderBy(F.desc("n")).limit(ranks)  # `ranks` rows at most
    return counts.join(F.broadcast(best), "n").select("tag", "n")
