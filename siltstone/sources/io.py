"""Sources and sinks: explicit schemas, no inference; small results only go through the driver."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEW = "user_id string, business_id string, stars double, date string, text string"
BUSINESS = "business_id string, categories string, state string, city string"
TAGGED = "text string, lang string, coordinates struct<coordinates: array<double>>, entities struct<hashtags: array<struct<text: string>>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def csv_pairs(spark: SparkSession, path: str, schema: str = "user_id string, business_id string") -> DataFrame:
    """CSV with a header line."""
    return spark.read.schema(schema).option("header", True).csv(path)


def vector_chunks(spark: SparkSession, path: str, level: int = 1) -> DataFrame:
    """Headerless lines id,f1,...,fd of a file or folder -> (id, v, chunk), chunk being the file's name, or with level 2 its folder's."""
    parts = F.split("value", ",")
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.select(parts[0].cast("long").alias("id"), F.transform(F.slice(parts, 2, F.size(parts)), lambda x: x.cast("double")).alias("v"), F.element_at(F.split(F.input_file_name(), "/"), -level).alias("chunk"))


def parts(spark: SparkSession, folder: str) -> list[str]:
    """The folders of a partitioned folder, in the order of their names; no file is read."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().toString() for x in system.listStatus(hadoop) if x.isDirectory() and not x.getPath().getName().startswith(("_", ".")))


def stop_words(spark: SparkSession, path: str) -> list[str]:
    """One word a line; a list for people, so it is small by nature."""
    return [r["value"].strip() for r in spark.read.text(path).where("trim(value) <> ''").collect()]


def model_by_type(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The records of one kind of a tagged model (type, name, profile)."""
    return json_lines(spark, path, "type string, name string, profile array<string>").where(F.col("type") == kind)


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def tagged_stream(spark: SparkSession, folder: str, track: str | None = None, box: tuple[float, float, float, float] | None = None, languages: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Messages as JSON files -> (tags array), and with order that number of each message. What a live feed would filter are ordinary predicates: a term of the text or
    tags, a box (west, south, east, north) of coordinates, either of which suffices, and languages. Credentials of a live feed
    belong to the caller's source."""
    tags = F.coalesce(F.transform("entities.hashtags", lambda x: x["text"]), F.array().cast("array<string>"))
    stream = spark.readStream.schema(f"{TAGGED}, {order} long" if order else TAGGED).json(folder).withColumn("tags", tags)
    wanted = []
    if track:
        wanted.append(F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit(track.lower())) | F.array_contains(F.transform("tags", F.lower), track.lower()))
    if box:
        x, y = F.get(F.col("coordinates.coordinates"), F.lit(0)), F.get(F.col("coordinates.coordinates"), F.lit(1))
        wanted.append(F.coalesce(x.between(box[0], box[2]) & y.between(box[1], box[3]), F.lit(False)))
    if wanted:
        stream = stream.where(reduce(Column.__or__, wanted))
    return (stream.where(F.col("lang").isin(languages)) if languages else stream).select("tags", *[order] * bool(order))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def write_answers(spark: SparkSession, answers: dict, path: str) -> None:
    """One JSON object of small answers, to any file system that Spark reaches."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        out.write(bytearray(json.dumps(answers).encode()))
    finally:
        out.close()


def read_answers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """A report, (value), as text."""
    df.select("value").write.mode("append" if append else "overwrite").text(path)


def csv_sink(path: str):
    """For foreachBatch or write_estimates(): appends each batch as CSV with a header. A batch that is run again overwrites
    its own folder, so none is there twice."""
    return lambda df, batch: df.write.mode("overwrite").option("header", True).csv(f"{path}/batch={batch}")


def log_sink(path: str):
    """The same for a log of the top tags, (n, tag, count): a block of lines per n."""

    def add(df: DataFrame, batch: int) -> None:
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "tag"))), lambda x: F.concat(x["tag"], F.lit(" : "), (-x["c"]).cast("string"))), "\n")
        blocks = df.groupBy("n").agg(lines.alias("tags")).orderBy("n")
        blocks.select(F.format_string("The number of tweets with tags from the beginning: %d\n%s\n", "n", "tags").alias("value")).write.mode("overwrite").text(f"{path}/batch={batch}")

    return add


def community_lines(communities: DataFrame) -> DataFrame:
    """(size, members) -> lines 'a', 'b' ordered by size and first member."""
    quoted = F.concat_ws(", ", F.transform("members", lambda m: F.concat(F.lit("'"), m.cast("string"), F.lit("'"))))
    return communities.orderBy("size", F.element_at("members", 1)).select(quoted.alias("value"))


def itemset_lines(found: DataFrame) -> DataFrame:
    """(itemset array, size) -> (size, value): per size one line of ('a', 'b') groups in lexicographic order."""
    return found.groupBy("size").agg(F.array_sort(F.collect_list("itemset")).alias("sets")).select(
        "size", F.concat_ws(",", F.transform("sets", lambda s: F.concat(F.lit("('"), F.array_join(s, "', '"), F.lit("')")))).alias("value")
    )


def itemset_report(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """Both blocks of a mining report, (part, block, size, value): candidates first, then the frequent itemsets, a line for each size."""
    one = lambda df, part, name: itemset_lines(df).select(F.lit(part).alias("part"), F.lit(name).alias("block"), "size", "value")
    return one(candidates, 1, "Candidates:").unionByName(one(frequent, 2, "Frequent Itemsets:")).orderBy("part", "size")


def betweenness_lines(edges: DataFrame) -> DataFrame:
    return edges.orderBy(F.desc("betweenness"), "a", "b").select(F.format_string("('%s', '%s'), %s", F.col("a").cast("string"), F.col("b").cast("string"), F.col("betweenness").cast("string")).alias("value"))


def bit_vector_line(hits: DataFrame, order: str, hit: str) -> DataFrame:
    """The hits in the order of a column, in one line."""
    return hits.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, hit))), lambda x: x[hit].cast("string")), " ").alias("value"))
