"""Clustering of vectors: distances, seeds, k-means, sufficient statistics and multi-round BFR."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.storage import drop, store

FLOOR = 1e-10
#: Centres go to every task, so there may be no more.
MOST_CENTRES = 10_000


def distance(v, w):
    return F.sqrt(F.aggregate(F.zip_with(v, w, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _in_one_row(clusters: DataFrame) -> DataFrame:
    """All rows as one array, (every), which is broadcast: at most MOST_CENTRES, counted first."""
    if (n := clusters.count()) > MOST_CENTRES:
        raise ValueError(f"{n} centres; at most {MOST_CENTRES} can be sent to every task")
    return F.broadcast(clusters.agg(F.array_sort(F.collect_list(F.struct(*clusters.columns))).alias("every")))


def nearest(points: DataFrame, centres: DataFrame) -> DataFrame:
    """points (id, v), centres (c, w) -> (id, c, dist), ties to the smallest c. No shuffle: each point is compared with an array of the centres."""
    best = F.array_min(F.transform("every", lambda e: F.struct(distance(F.col("v"), e["w"]).alias("dist"), e["c"].alias("c"))))
    return points.crossJoin(_in_one_row(centres.select("c", "w"))).select("id", best.alias("m")).select("id", "m.c", "m.dist")


def statistics(assigned: DataFrame) -> DataFrame:
    """(c, v) -> (c, j, n, s, ss): per cluster and dimension, count, sum and sum of squares."""
    return assigned.select("c", F.posexplode("v").alias("j", "x")).groupBy("c", "j").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))


def vectors(stats: DataFrame) -> DataFrame:
    """statistics() -> (c, n, centre, sd), arrays over the dimensions; sd has a floor."""
    sd = F.sqrt(F.greatest(F.lit(FLOOR), F.col("ss") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)))
    rows = stats.groupBy("c").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("j", (F.col("s") / F.col("n")).alias("m"), sd.alias("sd")))).alias("a"))
    return rows.select("c", "n", F.transform("a", lambda x: x["m"]).alias("centre"), F.transform("a", lambda x: x["sd"]).alias("sd"))


def mahalanobis(points: DataFrame, clusters: DataFrame, threshold: float) -> DataFrame:
    """(id, c): the nearest cluster of vectors() by scaled distance below threshold, clusters of one point skipped;
    -1 where there is none. No shuffle."""
    scaled = lambda v, m, sd: F.sqrt(F.aggregate(F.zip_with(F.zip_with(v, m, lambda x, y: x - y), sd, lambda x, y: (x / y) * (x / y)), F.lit(0.0), lambda s, x: s + x))
    each = F.transform("every", lambda e: F.struct(scaled(F.col("v"), e["centre"], e["sd"]).alias("dist"), e["c"].alias("c")))
    best = F.array_min(F.filter(each, lambda x: x["dist"] < threshold))
    return points.crossJoin(_in_one_row(clusters.where("n > 1").select("c", "centre", "sd"))).select("id", F.coalesce(best["c"], F.lit(-1)).cast("long").alias("c"))


def maximin(points: DataFrame, k: int) -> list[list[float]]:
    """k seeds: the point of the smallest id, then always the point farthest from those chosen (ties: smallest id). A pass
    takes a row from every task, its farthest point."""
    first = points.orderBy("id").select("v").first()
    seeds = [list(first["v"])] if first else []
    kind = points.schema["id"].dataType.simpleString()
    while first and len(seeds) < k:
        chosen = np.array(seeds)

        def run(batches, chosen=chosen):
            best = None
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    part = b.slice(at, 1024)
                    x = np.ascontiguousarray(_vectors(part.column(1), chosen.shape[1]).T)
                    d = np.zeros((len(chosen), part.num_rows))
                    for j, own in enumerate(x):  # in the order of the dimensions, as distance() adds
                        d += (own - chosen[:, j : j + 1]) ** 2
                    d, ids = np.sqrt(d.min(axis=0)), part.column(0).to_numpy()
                    far = np.flatnonzero(d == d.max())
                    i = int(far[ids[far].argmin()])
                    if best is None or (d[i], -ids[i]) > (best[0], -best[1]):
                        best = d[i], ids[i], part.slice(i, 1)
            if best:
                yield pa.RecordBatch.from_arrays([best[2].column(0), best[2].column(1), pa.array([best[0]])], names=["id", "v", "d"])

        found = points.select("id", "v").where("v is not null").mapInArrow(run, f"id {kind}, v array<double>, d double")
        seeds.append(list(found.select(F.max_by("v", F.struct("d", -F.col("id")))).first()[0]))
    return seeds


def _vectors(column: pa.ListArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _assign(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """points (id, v, c) -> (id, v, c, moved): the nearest centre, and whether it is another than c."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x = _vectors(part.column(1), centres.shape[1])
                now = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1).astype(np.int64)
                moved = now != part.column(2).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(now), pa.array(moved)], names=["id", "v", "c", "moved"])

    return points.select("id", "v", "c").mapInArrow(run, "id long, v array<double>, c long, moved boolean")


def kmeans(points: DataFrame, k: int, rounds: int = 10) -> DataFrame:
    """(id, v, c): Lloyd steps from maximin seeds, until a fiftieth of the points or 100, the larger, at most change,
    or rounds are over; the last assignment is to the last centres. Only k centres go through the driver; every round's
    assignment is stored."""
    now = store(points.select("id", "v", F.lit(-1).cast("long").alias("c")), "points")
    n = now.count()
    if not n:
        return now
    centres = np.array(maximin(now, k))
    for _ in range(rounds):
        step = store(_assign(now, centres), "assigned")
        drop(now)
        now = step
        changed = now.where("moved").count()
        for r in vectors(statistics(now)).collect():
            centres[r["c"]] = r["centre"]
        if changed <= max(n / 50, 100):
            break
    return _assign(now, centres).select("id", "v", "c")


class Bfr:
    """Discard (DS), compression (CS) and retained (RS) sets over rounds of points.

    The statistics of the clusters, a few numbers each, are on the driver; who belongs where is a stored table for each
    round. With sequential, as the method is defined, statistics move after every point in the order of ids, so one task
    reads a round after the other batch; else a round's points are assigned against the statistics at its start, in
    parallel, which are then merged."""

    def __init__(self, k: int, sequential: bool = False):
        self.k, self.sequential, self.seen = k, sequential, 0
        self.ds, self.cs, self.report, self.placed, self.rs = [], [], [], [], None

    @staticmethod
    def _stats(assigned: DataFrame) -> dict[int, dict]:
        """(c, v) -> per c its n, s and ss."""
        rows = statistics(assigned).groupBy("c").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("j", "s", "ss"))).alias("a"))
        return {r["c"]: {"n": r["n"], "s": np.array([x["s"] for x in r["a"]]), "ss": np.array([x["ss"] for x in r["a"]])} for r in rows.collect()}

    @staticmethod
    def _add(to: dict, more: dict) -> None:
        to["n"], to["s"], to["ss"] = to["n"] + more["n"], to["s"] + more["s"], to["ss"] + more["ss"]

    @staticmethod
    def _nearest(x: np.ndarray, clusters: list[dict]) -> np.ndarray:
        """Of each row of x the nearest cluster within the threshold, -1 if there is none."""
        best, where = np.full(len(x), 2 * np.sqrt(x.shape[1])), np.full(len(x), -1)
        for i, c in enumerate(clusters):
            if c["n"] > 1:
                m = c["s"] / c["n"]
                d = np.sqrt(((x - m) ** 2 / np.maximum(FLOOR, c["ss"] / c["n"] - m * m)).sum(axis=1))
                where[d < best], best = i, np.minimum(d, best)
        return where

    def _keep(self, kind: str, found: DataFrame) -> None:
        self.placed.append(store(found.select("id", F.lit(kind).alias("kind"), F.col("c").cast("long").alias("c")), "placed"))

    def _groups(self, points: DataFrame, k: int) -> tuple[DataFrame, dict[int, dict]]:
        """The k-means clusters of points, stored, and their statistics."""
        found = store(kmeans(points, k), "clusters")
        return found, self._stats(found)

    def _renamed(self, found: DataFrame, to: dict[int, int]) -> DataFrame:
        """(id, c) of the clusters that to names, under their new numbers: at most five times k."""
        names = found.sparkSession.createDataFrame(list(to.items()), "c long, t long")
        return found.join(F.broadcast(names), "c").select("id", F.col("t").alias("c"))

    def _alone(self, found: DataFrame, stats: dict[int, dict]) -> DataFrame:
        """(id, v) of the clusters of one point: at most five times k."""
        return found.where(F.col("c").isin([c for c, x in stats.items() if x["n"] == 1])).select("id", "v")

    def _retain(self, rs: DataFrame) -> None:
        old, self.rs = self.rs, store(rs, "retained")
        if old is not None:
            drop(old)

    def _first(self, points: DataFrame) -> None:
        sample = points.where(F.pmod(F.xxhash64("id"), F.lit(10)) == 0)
        rest = points.where(F.pmod(F.xxhash64("id"), F.lit(10)) != 0)
        found, stats = self._groups(sample, self.k)
        order = sorted(stats)
        self.ds = [stats[c] for c in order]
        self._keep("ds", self._renamed(found, {c: i for i, c in enumerate(order)}))
        found, stats = self._groups(rest, 5 * self.k)
        order = [c for c in sorted(stats) if stats[c]["n"] > 1]
        self.cs = [stats[c] for c in order]
        self._keep("cs", self._renamed(found, {c: i for i, c in enumerate(order)}))
        self._retain(self._alone(found, stats))

    def _later(self, points: DataFrame) -> None:
        ds, cs, sequential = self.ds, self.cs, self.sequential
        nearest_of = self._nearest

        def run(batches):
            own = [[{k: (x.copy() if k != "n" else x) for k, x in c.items()} for c in group] for group in (ds, cs)]
            d = len((ds or cs)[0]["s"])
            for b in batches:
                x = _vectors(b.column(1), d)
                kind, at = np.full(len(x), 2), np.full(len(x), -1)
                if sequential:
                    for i in range(len(x)):
                        for g, group in enumerate(own):
                            p = int(nearest_of(x[i : i + 1], group)[0])
                            if p >= 0:
                                kind[i], at[i] = g, p
                                c = group[p]
                                c["n"], c["s"], c["ss"] = c["n"] + 1, c["s"] + x[i], c["ss"] + x[i] * x[i]
                                break
                else:
                    for g, group in reversed(list(enumerate(own))):
                        p = nearest_of(x, group)
                        kind[p >= 0], at = g, np.where(p >= 0, p, at)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(["ds", "cs", "rs"])[kind]), pa.array(at)], names=["id", "v", "kind", "c"])

        dealt = points.coalesce(1).sortWithinPartitions("id") if sequential else points
        found = store(dealt.mapInArrow(run, "id long, v array<double>, kind string, c long"), "round")
        for kind, group in (("ds", self.ds), ("cs", self.cs)):
            for c, more in self._stats(found.where(F.col("kind") == kind)).items():
                self._add(group[c], more)
            self._keep(kind, found.where(F.col("kind") == kind))
        self._retain(self.rs.unionByName(found.where("kind = 'rs'").select("id", "v")))
        retained = self.rs.count()
        if retained > 50 * self.k and retained > self.seen / 100:
            self._compact()

    def _compact(self) -> None:
        found, stats = self._groups(self.rs, 5 * self.k)
        to = {}
        for c in (c for c in sorted(stats) if stats[c]["n"] > 1):
            at = int(self._nearest((stats[c]["s"] / stats[c]["n"])[None], self.cs)[0])
            if at < 0:
                at = len(self.cs)
                self.cs.append(stats[c])
            else:
                self._add(self.cs[at], stats[c])
            to[c] = at
        self._keep("cs", self._renamed(found, to))
        self._retain(self._alone(found, stats))

    def round(self, points: DataFrame) -> None:
        """Takes the points (id, v) of one round; the report gets a row of its counters."""
        points = store(points.select("id", "v"), "points")
        self.seen += points.count()
        self._later(points) if self.report else self._first(points)
        drop(points)
        sums = (len(self.ds), sum(c["n"] for c in self.ds), len(self.cs), sum(c["n"] for c in self.cs), self.rs.count())
        self.report.append((len(self.report) + 1, *map(int, sums)))

    def result(self) -> DataFrame:
        """(id, c): compression sets near a cluster join it, others are clusters of their own, retained points -1."""
        to, extra = {}, len(self.ds)
        for i, c in enumerate(self.cs):
            at = int(self._nearest((c["s"] / c["n"])[None], self.ds)[0]) if len(self.report) > 1 else -1  # one round sets no threshold
            to[i] = at if at >= 0 else extra
            extra += at < 0
        names = self.rs.sparkSession.createDataFrame([("ds", i, i) for i in range(len(self.ds))] + [("cs", i, t) for i, t in to.items()], "kind string, c long, t long")
        every = reduce(DataFrame.unionByName, self.placed).join(F.broadcast(names), ["kind", "c"]).select("id", F.col("t").alias("c"))
        return every.unionByName(self.rs.select("id", F.lit(-1).cast("long").alias("c")))
