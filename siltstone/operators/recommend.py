"""Content-based and collaborative-filtering recommendation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.similarity import jaccard, meeting
from siltstone.storage import store

EPS = 1e-9


def term_frequency(docs: DataFrame, stop: list[str], rare: float = 1e-6) -> DataFrame:
    """docs (id, text) -> (id, term, n, tf): A-Z words lower-cased, stop words and words below the share rare of
    a document's words left out, tf = n / the document's greatest n."""
    words = docs.where(F.col("text").isNotNull()).select("id", F.explode(F.split(F.regexp_replace("text", "[^A-Za-z]+", " "), " ")).alias("w"))
    counts = words.where("w <> ''").select("id", F.lower("w").alias("term")).where(~F.col("term").isin(*stop)).groupBy("id", "term").agg(F.count("*").alias("n"))
    size = counts.groupBy("id").agg(F.sum("n").alias("all"))
    kept = store(counts.join(size, "id").where(F.col("n") >= rare * F.col("all")).select("id", "term", "n"), "terms")
    top = kept.groupBy("id").agg(F.max("n").alias("top"))
    return kept.join(top, "id").select("id", "term", "n", (F.col("n") / F.col("top")).alias("tf"))


def inverse_frequency(tf: DataFrame) -> DataFrame:
    """(term, df, idf), idf = log2(documents / df)."""
    n = tf.select("id").distinct().agg(F.count("*").alias("docs"))
    return tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", "df", F.log2(F.col("docs") / F.col("df")).alias("idf"))


def profiles(tf: DataFrame, k: int = 200) -> DataFrame:
    """The k terms of greatest tf * idf per document: (id, term, score, rank); ties by term."""
    scored = tf.join(inverse_frequency(tf), "term").select("id", "term", F.round(F.col("tf") * F.col("idf"), 9).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "term"))).where(F.col("rank") <= k)


def user_profiles(reviews: DataFrame, items: DataFrame, k: int = 400) -> DataFrame:
    """reviews (user, id), items = profiles() -> the k terms that most of a user's reviewed items hold."""
    counts = reviews.select("user", "id").join(items.select("id", "term"), "id").groupBy("user", "term").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("n"), "term"))).where(F.col("rank") <= k)


def content_predict(users: DataFrame, items: DataFrame, pairs: DataFrame | None = None, least: float = 0.01) -> DataFrame:
    """Set cosine of the profiles of users and items, where it reaches least: of all that share a term, or of given (user, id) pairs."""
    nu, ni = users.groupBy("user").agg(F.count("*").alias("nu")), items.groupBy("id").agg(F.count("*").alias("ni"))
    met = users.select("user", "term")
    if pairs is None:
        met = met.join(items.select("id", "term"), "term")
    else:
        met = met.join(pairs.select("user", "id").distinct(), "user").join(items.select("id", "term"), ["id", "term"])
    both = met.groupBy("user", "id").agg(F.count("*").alias("c"))
    return both.join(nu, "user").join(ni, "id").select("user", "id", (F.col("c") / F.sqrt(F.col("nu") * F.col("ni"))).alias("sim")).where(F.col("sim") >= least)


def pearson(ratings: DataFrame, pairs: DataFrame | None = None, least: int = 3) -> DataFrame:
    """ratings (k, other, stars) -> (a, b, sim), a < b: Pearson over what both have rated, at least `least`,
    means over that only; positive similarities. Without pairs, all that are co-rated are formed, where they are also summed up, so
    that no row per pair is shuffled; with pairs (a, b), those meet the ratings of both. Centred sums come from one grouped aggregate."""
    kind = ratings.schema["k"].dataType.simpleString()
    if pairs is None:
        both = meeting(ratings.select(F.col("k").alias("id"), F.col("other").alias("x"), "stars"), "stars")
    else:
        x = ratings.select(F.col("k").alias("a"), "other", F.col("stars").alias("sa"))
        y = ratings.select(F.col("k").alias("b"), "other", F.col("stars").alias("sb"))
        both = pairs.select("a", "b").distinct().join(x, "a").join(y, ["b", "other"])
    sums = both.groupBy("a", "b").agg(F.count("*").alias("n"), *(F.sum(F.expr(e)).alias(n) for e, n in (("sa", "x"), ("sb", "y"), ("sa*sb", "xy"), ("sa*sa", "xx"), ("sb*sb", "yy"))))
    top, vx, vy = F.expr("xy - x * y / n"), F.expr("xx - x * x / n"), F.expr("yy - y * y / n")
    good = sums.where((F.col("n") >= least) & (top > EPS) & (vx > EPS) & (vy > EPS))
    return good.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), (top / F.sqrt(vx * vy)).alias("sim"))


def symmetric(model: DataFrame) -> DataFrame:
    """Every pair from both ends: (k, neighbour, sim)."""
    return model.select(F.col("a").alias("k"), F.col("b").alias("neighbour"), "sim").unionByName(model.select(F.col("b").alias("k"), F.col("a").alias("neighbour"), "sim"))


def symmetric_full_outer(model: DataFrame) -> DataFrame:
    """The same by a full outer join of both directions, as lists: (k, neighbours, sorted by sim, then id)."""
    side = lambda k, o, n: model.groupBy(F.col(k).alias("k")).agg(F.collect_list(F.struct((-F.col("sim")).alias("s"), F.col(o).alias("o"))).alias(n))
    none = F.array().cast("array<struct<s:double,o:bigint>>")
    both = side("a", "b", "l").join(side("b", "a", "r"), "k", "full")
    return both.select("k", F.array_sort(F.concat(F.coalesce("l", none), F.coalesce("r", none))).alias("neighbours"))


def _nearest(pairs, model, known, on, k=3):
    """Of each asked pair, the first k neighbours that have a rating; single matches and single-neighbour
    models give nothing."""
    near = symmetric(model)
    many = near.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k")
    near = near.join(many, "k", "left_semi")
    hit = pairs.join(near, pairs[on] == near["k"]).join(known, ["neighbour", "other"])
    first = hit.withColumn("r", F.row_number().over(Window.partitionBy("user", "item").orderBy(F.desc("sim"), "neighbour"))).where(F.col("r") <= k)
    return first


def jaccard_gate(pairs: DataFrame, ratings: DataFrame, least: float = 0.01) -> DataFrame:
    """Of pairs (a, b), those whose rated sets, ratings (k, other), reach a Jaccard similarity of least."""
    return jaccard(pairs, ratings.select(F.col("k").alias("id"), F.col("other").alias("x")), least).select("a", "b")


def predict_items(pairs: DataFrame, model: DataFrame, ratings: DataFrame) -> DataFrame:
    """pairs (user, item), ratings (user, item, stars) -> (user, item, stars): mean of the user's ratings of the three
    most similar items, weighted by similarity."""
    asked = pairs.select("user", "item", F.col("user").alias("other"))
    known = ratings.select(F.col("item").alias("neighbour"), F.col("user").alias("other"), F.col("stars").alias("s"))
    sums = _nearest(asked, model, known, "item").groupBy("user", "item").agg(F.count("*").alias("c"), F.sum(F.col("s") * F.col("sim")).alias("t"), F.sum(F.abs("sim")).alias("w"))
    return sums.where("c > 1 and w > 0").select("user", "item", (F.col("t") / F.col("w")).alias("stars"))


def predict_users(pairs: DataFrame, model: DataFrame, ratings: DataFrame) -> DataFrame:
    """The user's mean plus the weighted deviations of the three most similar users from their means of other items; deviations
    that sum up to 0 give nothing."""
    asked = pairs.select("user", "item", F.col("item").alias("other"))
    means = ratings.groupBy("user").agg(F.sum("stars").alias("t"), F.count("*").alias("c"))
    known = ratings.join(means, "user").where("c > 1").select(F.col("user").alias("neighbour"), F.col("item").alias("other"), (F.col("stars") - (F.col("t") - F.col("stars")) / (F.col("c") - 1)).alias("s"))
    sums = _nearest(asked, model, known, "user").groupBy("user", "item").agg(F.count("*").alias("n"), F.sum(F.col("s") * F.col("sim")).alias("d"), F.sum(F.abs("sim")).alias("w"))
    own = means.select("user", (F.col("t") / F.col("c")).alias("mean"))
    return sums.where((F.col("n") > 1) & (F.col("w") > 0) & (F.abs("d") > EPS)).join(own, "user").select("user", "item", (F.col("mean") + F.col("d") / F.col("w")).alias("stars"))
