"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Sources get weighted shares of a word budget, each at most a number of epochs of its own words. Whole
epochs take every document; the rest of a target is filled in the order of exponential keys
-ln(u) / quality, u hashed from the document, up to the exact budget: the document at the border is
cut there.

Running sums inside a source would put a hot source into one task. So keys are bucketed on a log scale
(the log of a key has a density of at most 1/e whatever the weights, so a bucket holds at most
that share of a source per unit), bucket sums are added up per source, and documents are summed inside
their bucket: no task gets more than a bucket's documents or a source's bucket sums.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import JAVA_WORD, store

WEIGHTS, MAX_EPOCHS, SEED = (1, 2, 3), 3, 20240601


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(JAVA_WORD)).cast("long"), F.lit(0).cast("long"))


def letter_share(text: Column) -> Column:
    """The share of letters among a text's characters, at least 0.05: a quality weight."""
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    return F.coalesce(F.greatest(letters / F.nullif(F.length(text), F.lit(0)), F.lit(0.05)), F.lit(0.05))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes (source, size) -> (source, target): weights repeat over the sources by code point, null
    last; targets share all sizes by weight, stop at max_epochs * size, and what is above is shared
    anew. In the order of size / weight the sources that stop come first, so one running sum finds them."""
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sizes.withColumn("w", F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(place, F.lit(len(weights))))).withColumn("cap", F.col("size") * float(max_epochs))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    levelled = ranked.withColumn("level", level).withColumn("free", F.col("cap") / F.col("w") > F.col("level"))
    return levelled.withColumn("level", F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), "level"))).over(every)["level"]).select(
        "source", F.when(F.col("free"), F.col("level") * F.col("w")).otherwise(F.col("cap")).alias("target")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality=letter_share, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, also: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: its id, size, source_size, target, taken (words, repeats counted),
    its source and the columns named in also.

    A null or empty text has size 0 and takes 0; a null source is a source, the last one; rows that
    agree in id and text have equal keys and stand side by side, so any order of them gives the same
    rows; sources without a word have the target 0; an empty table gives no rows; other columns are not read. A long text counts
    whole, and is cut where a budget ends in it. All sources, a row each, are ordered in one task."""
    text = F.col("text")
    u = (F.pmod(F.xxhash64(F.lit(seed), "id", "text"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    narrow = store(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), *(F.col(c).alias(f"also_{c}") for c in also)).select(
            "id", "source", word_count(text).alias("size"), F.xxhash64("text").alias("mark"), (-F.log(u) / quality(text)).alias("key"), *(f"also_{c}" for c in also)
        ),
        "mix",
    )
    per_unit = max(1.0, math.sqrt(narrow.count()) / 4)
    placed = narrow.withColumn("bucket", F.floor(F.log("key") * per_unit))
    buckets = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    per_source = buckets.groupBy("source").agg(F.sum("words").alias("size"))
    shares = targets(per_source, weights, max_epochs).withColumnRenamed("source", "s")
    one = Window.partitionBy("source")
    sums = (
        buckets.withColumn("source_size", F.sum("words").over(one))
        .withColumn("ahead", F.coalesce(F.sum("words").over(one.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(shares, F.col("source").eqNullSafe(F.col("s")))
        .select(F.col("source").alias("s"), F.col("bucket").alias("b"), "source_size", "ahead", "target")
    )
    inside = Window.partitionBy("source", "bucket").orderBy("key", F.col("id").asc_nulls_last(), "mark").rowsBetween(Window.unboundedPreceding, -1)
    run = placed.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0)
    left = F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size")
    taken = F.col("whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("ahead") - F.col("inner")))
    return (
        run.withColumn("whole", whole)
        .withColumn("left", left)
        .select(
            F.col("id").alias(id_col), "size", "source_size", "target", F.least(taken, F.col("size") * max_epochs).cast("long").alias("taken"), F.col("source").alias(source_col), *(F.col(f"also_{c}").alias(c) for c in also)
        )
    )


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    from siltstone.llm.common import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
