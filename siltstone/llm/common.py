"""What the training-data operators share: word patterns, connected components, stored steps."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.storage import drop, new_path, remove, shared_folder, store

__all__ = ["JAVA_WORD", "WORD", "components", "drop", "new_path", "remove", "shared_folder", "store", "table"]

#: A word: a run of characters that are none of space, tab, line feed, vertical tab, form feed, carriage return.
WORD = re.compile(r"[^\x20\x09-\x0d]+")
JAVA_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): one row (node, root) per node that has an
    edge to another node, root the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each a grouped minimum and an
    equi-join, until the edge set is stable. Minima combine before the shuffle and are stored, which
    leaves joins whose skewed side AQE can split, so a hub with a large share of the edges is not gathered anywhere. Loops and
    rows with a null end are ignored; no edges give an empty result."""
    now = store(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("a is not null and b is not null and a <> b")
        .distinct(),
        "edges",
    )
    mark = F.struct(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("v", "u")), F.lit(0)))
    seen = None
    while True:
        state = tuple(now.agg(mark.alias("m")).first()["m"])
        if state == seen or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = store(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = store(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        drop(now, least)
        least = store(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = store(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        drop(large, least)
