"""Streaming forms: distinct counts over sliding windows, and a reservoir with its most frequent tags."""

from __future__ import annotations

import random
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.operators.sketch import fm_of_sums, fm_sums
from siltstone.storage import drop, remove, store

TOP = "n long, tag string, count long"
HELD = "n long, held array<array<string>>"
TO_SORT = 500_000


def parse_json(lines: DataFrame, field: str) -> DataFrame:
    """(value) -> (ts, key): a field of JSON lines, '' where it is absent; arrival time."""
    return lines.select(F.current_timestamp().alias("ts"), F.coalesce(F.get_json_object("value", f"$.{field}"), F.lit("")).alias("key"))


def windowed_keys(stream: DataFrame, length: str = "30 seconds", slide: str = "10 seconds", late: str = "10 seconds") -> DataFrame:
    """(ts, key) -> counts per window and distinct key: the state is bounded by a watermark and holds no rows."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", length, slide).alias("w"), "key").agg(F.count("*").alias("c"))


def write_estimates(stream: DataFrame, sink, length: str = "30 seconds", slide: str = "10 seconds", late: str = "10 seconds", **options) -> StreamingQuery:
    """Starts a query that hands sink a DataFrame (start, truth, estimate, accuracy) for each closed batch of windows. The sums of
    the keys are stored first: whatever reads df runs the batch with its state again, and an estimate reads its keys more than once."""

    def each(df: DataFrame, batch: int) -> None:
        sums = store(fm_sums(df.select(F.col("w.start").alias("start"), F.col("key").alias("k"), F.col("c").alias("n_rows")), ["start"]), "sums")
        sink(fm_of_sums(sums, ["start"]), batch)
        drop(sums)

    writer = windowed_keys(stream, length, slide, late).writeStream.outputMode("append").foreachBatch(each)
    return writer.trigger(**(options.pop("trigger", None) or {"processingTime": "5 seconds"})).options(**options).start()


def place(n: int, capacity: int, seed: int) -> int | None:
    """Where record n, counted from 1, goes in a reservoir; None if it is left out. It depends on nothing else, so any task can tell."""
    if n <= capacity:
        return n - 1
    rng = random.Random(seed * 1_000_003 + n)
    return rng.randrange(capacity) if rng.random() < capacity / n else None


class Reservoir:
    """The tags of the sampled records, and the counts of these."""

    def __init__(self, held: list[list[str]]):
        self.held = [list(x) for x in held]
        self.counts = Counter(t for x in self.held for t in x)

    def put(self, at: int, tags: list[str]) -> None:
        if at == len(self.held):
            self.held.append([])
        self.counts.subtract(self.held[at])
        self.held[at] = list(tags)
        self.counts.update(tags)

    def top(self, ranks: int) -> list[tuple[str, int]]:
        """The tags of the `ranks` greatest distinct counts, and these."""
        best = sorted({c for c in self.counts.values() if c}, reverse=True)[:ranks]
        return sorted(((t, c) for t, c in self.counts.items() if c in best), key=lambda x: (-x[1], x[0]))


def reservoir_tags(stream: DataFrame, capacity: int = 100, ranks: int = 3, seed: int = 1, each: bool = False) -> DataFrame:
    """(tag array per record) -> (n, tag, count): a reservoir over records with tags, seeded, and the tags of the `ranks`
    greatest distinct counts in it, after each batch, or with each after each record. One sample is one state, so it has
    one key, and all records of a batch come to one task: for feeds of small batches. write_top_tags() has no such task."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, held = (state.get if state.exists else (0, []))
        sample = Reservoir(held)
        for pdf in batches:
            rows = []
            for tags in pdf["tags"]:
                n += 1
                at = place(n, capacity, seed)
                if at is not None:
                    sample.put(at, tags)
                if each:
                    rows += [(n, *x) for x in sample.top(ranks)]
            if each:
                yield frame(rows)  # one for a batch of records: to make one takes far longer than to count
        state.update((n, sample.held))
        if not each:
            yield frame([(n, *x) for x in sample.top(ranks)])

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"n": [r[0] for r in rows], "tag": [r[1] for r in rows], "count": [r[2] for r in rows]})

    tagged = stream.where(F.size("tags") > 0).select("tags", F.lit(0).alias("one"))
    return tagged.groupBy("one").applyInPandasWithState(update, TOP, HELD, "update", GroupStateTimeout.NoTimeout)


def write_top_tags(stream: DataFrame, sink, folder: str, order: str | None = None, capacity: int = 100, ranks: int = 3, seed: int = 1, each: bool = False, **options) -> StreamingQuery:
    """Starts a query that hands sink the rows of reservoir_tags() for each batch, by the same sample. The records of a batch
    are numbered where they lie, by the column order of the stream, or else as they are read, and every task tells which of its
    own the sample takes. Only these, about capacity * (1 + ln(n / capacity)) of n, come to the driver. folder keeps the sample
    after the last two batches, so a batch that is run again begins with the same one."""

    @F.pandas_udf("long")
    def placed(n: pd.Series) -> pd.Series:
        return pd.Series([place(x, capacity, seed) for x in n.tolist()], dtype="Int64")

    def batch_of(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        n, held = tuple(spark.read.schema(HELD).parquet(f"{folder}/batch={batch - 1}").first()) if batch else (0, [])
        rows, read = df.where(F.size("tags") > 0), []
        if order:
            read.append(store(rows, "read"))  # the sort takes two passes, and a task sorts about TO_SORT records
            rows = read[0].repartitionByRange(read[0].count() // TO_SORT + 1, order).sortWithinPartitions(order)
        lying = store(rows.select(F.monotonically_increasing_id().alias("at"), "tags"), "tagged")
        drop(*read)
        part = F.shiftright("at", 33)
        starts, end = [], n
        for r in sorted(lying.groupBy(part.alias("part")).count().collect()):
            starts.append((r[0], end + 1))
            end += r[1]
        first = spark.createDataFrame(starts, "part long, first long")
        numbered = lying.withColumn("part", part).join(F.broadcast(first), "part").select((F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("n"), "tags")
        sample = Reservoir(held)
        since, tops = [n], [sample.top(ranks)]  # the top tags from each record on at which they change
        for r in sorted(numbered.withColumn("place", placed("n")).where("place IS NOT NULL").collect()):
            sample.put(r["place"], r["tags"])
            if each and sample.top(ranks) != tops[-1]:
                since.append(r["n"])
                tops.append(sample.top(ranks))
        if each:
            version = F.pandas_udf(lambda n: n.map(lambda x: bisect_right(since, x) - 1), "long")
            known = spark.createDataFrame([(i, *x) for i, top in enumerate(tops) for x in top], "version long, tag string, count long")
            found = numbered.select("n", version("n").alias("version")).join(F.broadcast(known), "version").select("n", "tag", "count")
        else:
            found = spark.createDataFrame([(end, *x) for x in sample.top(ranks)] if end > n else [], TOP)
        sink(found, batch)
        spark.createDataFrame([(end, sample.held)], HELD).coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch={batch}")
        drop(lying)
        remove(spark, f"{folder}/batch={batch - 2}")

    return stream.writeStream.foreachBatch(batch_of).trigger(**(options.pop("trigger", None) or {"processingTime": "5 seconds"})).options(**options).start()


def console(stream: DataFrame, rows: int = 1, **options) -> StreamingQuery:
    """Starts a query that prints the first rows of each batch."""
    return stream.writeStream.format("console").option("numRows", rows).options(**options).start()


def watch(query: StreamingQuery, timeout: float | None = None, stop_on: Callable[[str], bool] = lambda error: False) -> bool:
    """Waits for a query, for timeout seconds at most, and stops it then. An error for which stop_on is true (a feed that
    refuses more requests, say) ends it quietly, any other is raised. True if it ended by itself without one."""
    try:
        ended = query.awaitTermination(timeout) if timeout is not None else query.awaitTermination() is None
    except StreamingQueryException as e:
        if not stop_on(str(e)):
            raise
        return False
    if not ended:
        query.stop()
    return bool(ended)
