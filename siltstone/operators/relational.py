"""Exploration of review-like tables: counts, top lists, averages per category, layouts, filtered pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the class of characters that separate words in top_words(); results depend on it.
SEPARATORS = r"[;,.:?!\s()\[\]]"


def top_users(df: DataFrame, user: str, m: int) -> DataFrame:
    """The m users with most rows, ties by user."""
    return df.groupBy(F.col(user).alias("user")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user").limit(m)


def top_words(df: DataFrame, text: str, stop: list[str], n: int) -> DataFrame:
    """The n most frequent words, case kept; the stop list holds lower-case words; ties by word."""
    words = df.where(F.col(text).isNotNull()).select(F.explode(F.split(text, SEPARATORS)).alias("word"))
    kept = words.where((F.col("word") != "") & ~F.lower("word").isin(*stop))
    return kept.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(n).select("word", "n")


def category_avg(reviews: DataFrame, items: DataFrame, n: int | None = None, sep: str = ", ") -> DataFrame:
    """reviews (item, stars), items (item, categories) -> mean stars per category, best first."""
    each = items.where(F.col("categories").isNotNull()).select("item", F.explode(F.split("categories", sep)).alias("c")).select("item", F.trim("c").alias("category"))
    out = reviews.join(each, "item").groupBy("category").agg(F.avg("stars").alias("stars"))
    return out.orderBy(F.desc("stars"), "category").limit(n) if n else out


def busy_items(df: DataFrame, item: str, more_than: int) -> DataFrame:
    return df.groupBy(F.col(item).alias("item")).agg(F.count("*").alias("n")).where(F.col("n") > more_than)


def partition_layout(df: DataFrame, parts: int, key: str | None = None) -> DataFrame:
    """Rows per partition after dealing df out, by key or in turn."""
    dealt = df.repartition(parts, key) if key else df.repartition(parts)
    return dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n_items"))


def partition_totals(df: DataFrame, parts: int, key: str | None = None) -> DataFrame:
    """One row: the number of partitions that df is dealt to, empty ones included, and its rows."""
    rows = partition_layout(df, parts, key).agg(F.coalesce(F.sum("n_items"), F.lit(0)).alias("n_items"))
    return rows.select(F.lit(parts).alias("n_partitions"), "n_items")


def filtered_pairs(reviews: DataFrame, items: DataFrame, state: str) -> DataFrame:
    """Distinct (user, item) of reviews of the items in a state."""
    return reviews.join(items.where(F.col("state") == state).select("item"), "item").select("user", "item").distinct()


def never_seen(items: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return items.join(seen.select(key), key, "left_anti")
