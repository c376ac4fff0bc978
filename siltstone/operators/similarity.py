"""MinHash signatures, bands, candidate pairs and exact Jaccard similarity."""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.storage import store

BROADCAST = 1_000_000
#: Ids of an element that are sent as one list, and pairs that a task forms, about.
TAIL, PAIRS = 1000, 1_000_000
#: Elements that are hashed at once; values of one hash that a task holds; sets whose pairs one task tells apart.
SLICE, KEYS, SETS = 128, 16_000_000, 20_000
#: Rows that pairs by common elements form at most for one value of a set's hashes, that they come first in similar_pairs().
CHEAP = 10


def numbered(df: DataFrame, col: str) -> DataFrame:
    """(col, x): distinct values numbered from 0 in order. Ranges of values are numbered apart, after what the
    ranges before them hold, so no task gets all values; a range's count is one row."""
    dealt = df.select(col).distinct().repartitionByRange(col).withColumn("_p", F.spark_partition_id())
    dealt = store(dealt, "numbered")
    counts = sorted((r["_p"], r["n"]) for r in dealt.groupBy("_p").agg(F.count("*").alias("n")).collect())  # a row per partition
    before = accumulate((n for _, n in counts), initial=0)
    starts = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=False)], "_p int, _s long")
    place = F.row_number().over(Window.partitionBy("_p").orderBy(col)).cast("long") - 1
    return dealt.withColumn("x", place).join(F.broadcast(starts), "_p").select(col, (F.col("x") + F.col("_s")).alias("x"))


def coefficients(n_hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of each hash, 1 <= a, 0 <= b: closed forms, so that runs agree."""
    i = np.arange(n_hashes, dtype=np.int64)
    return 1 + (i * 7919 + 17) % 10007, (i * 104729 + 31) % 10009


def _least(batches, n_hashes: int, modulus: int):
    """Batches (id, x) sorted by id -> (ids, the least values of their hashes, a column per id). A set that runs on into the
    next slice takes its least values along."""
    a, b = (c[:, None] for c in coefficients(n_hashes))
    values, parts = np.empty((2, n_hashes, SLICE), np.int64)
    held, least = None, None  # the last set so far, which may run on
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            codes = part.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            v, q = values[:, : len(codes)], parts[:, : len(codes)]
            np.add(np.multiply(a, part.column(1).to_numpy(), out=v), b, out=v)
            np.multiply(np.floor_divide(v, modulus, out=q), modulus, out=q)  # faster than a remainder
            found = np.minimum.reduceat(np.subtract(v, q, out=v), starts, axis=1)
            ids = part.column(0).take(pa.array(starts))
            if held is not None and ids[0] == held[0]:
                found[:, 0] = np.minimum(found[:, 0], least)
            elif held is not None:
                yield held, least[:, None]
            if len(ids) > 1:
                yield ids[:-1], found[:, :-1]
            held, least = ids[-1:], found[:, -1]
    if held is not None:
        yield held, least[:, None]


def _sorted_sets(sets: DataFrame) -> DataFrame:
    """sets (id, x) dealt and sorted by id; elements that are null are left out."""
    return sets.select("id", F.col("x").cast("long").alias("x")).where("x is not null").repartition("id").sortWithinPartitions("id")


def hashes(sets: DataFrame, n_hashes: int, modulus: int) -> DataFrame:
    """sets (id, x long) -> (id, hs): the least of (a x + b) mod modulus for each hash. Elements come sorted by id
    and are hashed in slices, so a set of any size takes little memory; rows that occur twice change nothing."""

    def run(batches):
        for ids, found in _least(batches, n_hashes, modulus):
            ends = np.arange(0, n_hashes * len(ids) + 1, n_hashes, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(found.T.ravel()))], names=["id", "hs"])

    return _sorted_sets(sets).mapInArrow(run, f"id {sets.schema['id'].dataType.simpleString()}, hs array<bigint>")


def signatures(sets: DataFrame, n_hashes: int, modulus: int) -> DataFrame:
    """(id, i, h): a row per hash."""
    return hashes(sets, n_hashes, modulus).select("id", F.posexplode("hs").alias("i", "h")).select("id", F.col("i").cast("long").alias("i"), "h")


def bands(sets: DataFrame, n_hashes: int, modulus: int, rows: int = 2) -> DataFrame:
    """(id, band, key): runs of rows hash values, in order. Keys are written where the values are found, a column at a time."""

    def run(batches):
        for ids, found in _least(batches, n_hashes, modulus):
            for at in range(0, len(ids), 64):
                some = found[:, at : at + 64].T  # a row per id
                n, every = len(some), range(0, n_hashes, rows)
                last = [pa.array(np.ascontiguousarray(some[:, r::rows]).ravel()).cast(pa.string()) for r in range(rows)] if n_hashes % rows == 0 else None
                keys = pc.binary_join_element_wise(*last, "-") if last else pa.array(["-".join(map(str, h[i : i + rows])) for h in some.tolist() for i in every])
                where = ids.slice(at, 64).take(pa.array(np.repeat(np.arange(n), len(every))))
                yield pa.RecordBatch.from_arrays([where, pa.array(np.tile(np.arange(len(every)), n)), keys], names=["id", "band", "key"])

    return _sorted_sets(sets).mapInArrow(run, f"id {sets.schema['id'].dataType.simpleString()}, band bigint, key string")


def candidates(b: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, that share a band."""
    left, right = b.select("band", "key", F.col("id").alias("a")), b.select("band", "key", F.col("id").alias("b"))
    return left.join(right, ["band", "key"]).where("a < b").select("a", "b").distinct()


def _pairs_of_runs(order: np.ndarray, starts: np.ndarray, most: int):
    """(left, right): all pairs of members of each run, about most at a time; a run is order[starts[i]:starts[i + 1]]."""
    if not len(order):
        return
    ends = np.append(starts[1:], len(order))
    more = np.repeat(ends, ends - starts) - 1 - np.arange(len(order))  # later members of each one's run
    at, total = 0, np.cumsum(more)
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        m = more[at:to]
        if n := int(m.sum()):
            first = np.repeat(np.arange(at, to), m)
            yield order[first], order[first + 1 + np.arange(n) - np.repeat(np.cumsum(m) - m, m)]
        at = to


def band_pairs(sets: DataFrame, n_hashes: int, modulus: int, rows: int = 2) -> DataFrame:
    """candidates(bands(sets)) without a row per band: sets' values go, packed by some thousand sets, to a task for each few bands,
    which sorts every band by its values and pairs what is equal. With more sets than KEYS, counted first, a band is dealt over
    tasks by its values, so a task holds about KEYS values of a band; each pair of a run is formed, also of very frequent values."""
    spark, kind = sets.sparkSession, sets.schema["id"].dataType.simpleString()
    sets = store(sets.select("id", F.col("x").cast("long").alias("x")).where("id is not null and x is not null"), "sets")
    n, most = sets.agg(F.approx_count_distinct("id", 0.02), *([F.max(F.abs("id"))] if kind == "bigint" else [F.lit(None)])).first()
    n_bands, spread = math.ceil(n_hashes / rows), max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    parts = max(1, math.ceil(n / KEYS))
    groups = min(n_bands, max(spread, math.ceil(n_bands * n / KEYS)))
    edges = np.linspace(0, n_bands, groups + 1).astype(int)
    word = np.uint32 if modulus < 2**32 else np.uint64
    short = "int" if fits_int(most) else kind

    def pack(batches):
        held, count = [], 0
        for ids, found in _least(batches, n_hashes, modulus):
            held.append((ids, found.astype(word)))
            count += len(ids)
            if count >= 2048:
                yield from packed(held)
                held, count = [], 0
        if held:
            yield from packed(held)

    def packed(held):
        ids, found, zstd = pa.concat_arrays([i for i, _ in held]), np.concatenate([f for _, f in held], axis=1), pa.Codec("zstd")
        for g in range(groups):
            some = found[edges[g] * rows : edges[g + 1] * rows]
            deal = (np.uint64(0x9E3779B97F4A7C15) * (some.astype(np.uint64) * np.arange(1, len(some) + 1, dtype=np.uint64)[:, None]).sum(axis=0) >> np.uint64(32)) % np.uint64(parts) if parts > 1 else np.zeros(len(ids), int)
            for p in range(parts):
                chosen = np.flatnonzero(deal == p)
                if len(chosen):
                    part = np.ascontiguousarray(some[:, chosen])
                    planes = zstd.compress(part.view(np.uint8).reshape(-1, part.itemsize).T.tobytes(), asbytes=True)  # bytes of one place together
                    yield pa.RecordBatch.from_arrays([pa.array([g * parts + p], pa.int32()), pa.array([ids.take(pa.array(chosen)).to_pylist()], pa.list_(ids.type)), pa.array([planes], pa.binary())], names=["at", "ids", "hs"])

    def meet(batches):
        ids, blocks = defaultdict(list), defaultdict(list)
        zstd, size = pa.Codec("zstd"), np.dtype(word).itemsize
        for batch in batches:
            for g, own, planes in zip(batch["at"].to_pylist(), range(batch.num_rows), batch["hs"].to_pylist(), strict=True):
                mine = batch["ids"][own].values
                high = (edges[g // parts + 1] * rows if edges[g // parts + 1] * rows < n_hashes else n_hashes) - edges[g // parts] * rows
                raw = np.frombuffer(zstd.decompress(planes, int(high) * len(mine) * size, asbytes=True), np.uint8)
                blocks[g].append(np.ascontiguousarray(raw.reshape(size, -1).T).view(word).reshape(int(high), len(mine)))
                ids[g].append(mine)
        def flush(every, found):
            """A row per a, with its distinct b in a list."""
            pairs, n = np.unique(np.concatenate(found)), len(every)
            starts = np.flatnonzero(np.append(True, pairs[1:] // n != pairs[:-1] // n))
            a, b = (every.take(pa.array(x)).cast(pa.int32() if short == "int" else every.type) for x in (pairs[starts] // n, pairs % n))
            return pa.RecordBatch.from_arrays([a, pa.ListArray.from_arrays(pa.array(np.append(starts, len(pairs)).astype(np.int32)), b)], names=["a", "bs"])

        for g in sorted(ids):
            found, count = [], 0
            every, own = pa.concat_arrays(ids.pop(g)), blocks.pop(g)
            rank = np.empty(len(every), np.int64)
            rank[pc.sort_indices(every).to_numpy()] = np.arange(len(every))
            every = every.take(pc.sort_indices(every))
            for band in range(0, len(own[0]), rows):
                key = np.concatenate([x[band] for x in own]).astype(np.int64)
                for r in range(band + 1, min(band + rows, len(own[0]))):
                    key = (np.unique(key, return_inverse=True)[1] if r > band + 1 or modulus >= 2**31 else key) * modulus + np.concatenate([x[r] for x in own]).astype(np.int64)
                order = np.argsort(key)
                key = key[order]
                same = np.append(False, key[1:] == key[:-1])
                member = same | np.append(same[1:], False)
                starts = np.flatnonzero(~same[member])
                for left, right in _pairs_of_runs(rank[order[member]], starts, PAIRS):
                    found.append(np.minimum(left, right) * len(every) + np.maximum(left, right))
                    count += len(left)
                    if count > 8 * PAIRS:
                        yield flush(every, found)
                        found, count = [], 0
            if found:
                yield flush(every, found)

    dealt = _sorted_sets(sets).mapInArrow(pack, f"at int, ids array<{kind}>, hs binary").repartitionById(groups * parts, F.col("at"))
    met = dealt.mapInArrow(meet, f"a {short}, bs array<{short}>").repartition(max(spread, math.ceil(n / SETS)), "a").select("a", F.explode("bs").alias("b")).distinct()
    return met.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"))


def meeting(sets: DataFrame, value: str | None = None) -> DataFrame:
    """sets (id, x), perhaps with a number value -> (a, b), or (a, b, sa, sb), a < b: a row for every common x of every pair, all
    rows of one a in one task. What is shuffled is each id with lists of the later ids of its elements (and their values), not a
    row per pair; tasks grow in number with the pairs, not in size."""
    spark, kind = sets.sparkSession, sets.schema["id"].dataType.simpleString()
    each = sets.where("id is not null and x is not null")
    entry = F.struct(F.col("id"), *([F.col(value).alias("s")] if value else []))
    lists = store(each.groupBy("x").agg(F.sort_array(F.collect_list(entry)).alias("held")).where(F.size("held") > 1).select("held"), "lists")
    n = F.size("held").cast("long")
    widest = F.greatest(F.abs(F.element_at("held", 1)["id"]), F.abs(F.element_at("held", -1)["id"])) if kind == "bigint" else F.lit(None)
    total, most = lists.agg(F.sum(n * (n - 1) / 2), F.max(widest)).first()
    held = (lambda name: F.col(f"held.{name}").cast("array<int>")) if fits_int(most) else (lambda name: F.col(f"held.{name}"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((total or 0) / PAIRS))
    lists = lists.repartition(max(1, math.ceil((total or 0) / (4 * PAIRS))))  # what a task sends on stays in memory
    rows = lists.select(held("id").alias("ids"), *([F.col("held.s").alias("ss")] if value else []))
    rows = rows.select("*", F.posexplode("ids").alias("i", "a")).where(F.col("i") + 1 < F.size("ids")).withColumn("at", F.explode(F.sequence(F.col("i") + 2, F.size("ids"), F.lit(TAIL))))
    tail = lambda c: F.slice(c, F.col("at"), F.lit(TAIL))
    dealt = rows.select("a", tail("ids").alias("bs"), *([F.get("ss", F.col("i")).alias("sa"), tail("ss").alias("sbs")] if value else [])).repartition(tasks, "a")
    if value:
        out = dealt.select("a", "sa", F.explode(F.arrays_zip("bs", "sbs")).alias("z")).select("a", F.col("z.bs").alias("b"), "sa", F.col("z.sbs").alias("sb"))
    else:
        out = dealt.select("a", F.explode("bs").alias("b"))
    return out.where("a < b")


def fits_int(most) -> bool:
    """Whether ids up to most go into four bytes."""
    return most is not None and most < 2**31


def exact_pairs(sets: DataFrame, least: float) -> DataFrame:
    """(a, b, sim), a < b, of all sets (id, x) that reach least. Common elements are counted where the pairs are formed; a pair
    with fewer than least times the first set has goes before its second size is looked up."""
    kind = sets.schema["id"].dataType.simpleString()
    sets = sets.select("id", "x").distinct()
    size = store(sets.groupBy("id").agg(F.count("*").alias("n")), "sizes")
    both = meeting(sets).groupBy("a", "b").agg(F.count("*").alias("both"))
    both = both.join(size.select(F.col("id").cast(both.schema["a"].dataType).alias("a"), F.col("n").alias("na")).hint("shuffle_hash"), "a").where(F.col("both") >= least * F.col("na") - 1e-9)
    both = both.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "both", "na")
    common = both.join(size.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    return common.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("sim")).where(F.col("sim") >= least)


def share_band(pairs: DataFrame, sets: DataFrame, n_hashes: int, modulus: int, rows: int = 2) -> DataFrame:
    """Of pairs (a, b, ...) those that share a band, as candidates() finds them: the signatures of their ids are laid side by
    side, so few pairs need no bands of all sets. For pairs that are fewer than the candidates."""
    signed = store(hashes(sets, n_hashes, modulus), "signatures")
    met = pairs.join(signed.select(F.col("id").alias("a"), F.col("hs").alias("ha")), "a").join(signed.select(F.col("id").alias("b"), F.col("hs").alias("hb")), "b")
    same = F.expr(f"exists(sequence(1, {n_hashes}, {rows}), i -> slice(ha, i, {rows}) = slice(hb, i, {rows}))")
    return met.where(same).select(*pairs.columns)


def jaccard(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b, sim) of the pairs whose sets (id, x) reach least. Up to BROADCAST elements, counted first, the sets are
    broadcast, so that pairs times elements are not shuffled; beyond, they are joined."""
    sets = store(sets.select("id", "x").distinct(), "sets")
    near = F.broadcast if sets.count() <= BROADCAST else lambda df: df
    size = sets.groupBy("id").agg(F.count("*").alias("n"))
    common = (
        pairs.join(near(sets.select(F.col("id").alias("a"), "x")), "a").join(near(sets.select(F.col("id").alias("b"), "x")), ["b", "x"]).groupBy("a", "b").agg(F.count("*").alias("both"))
    )
    joined = common.join(size.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    return joined.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("sim")).where(F.col("sim") >= least)


def share_band_by_sets(pairs: DataFrame, sets: DataFrame, n_hashes: int, modulus: int, rows: int = 2) -> DataFrame:
    """share_band() for many hashes: what goes to a pair are its sets, or the values of those with more elements than hashes."""
    ids = store(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    own = store(sets.select("id", F.col("x").cast("long").alias("x")).where("x is not null").join(ids, "id", "left_semi"), "own")
    large = store(own.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > n_hashes).select("id"), "large")
    few = own.join(large, "id", "left_anti").groupBy("id").agg(F.collect_list("x").alias("v")).select("id", "v", F.lit(False).alias("done"))
    each = store(few.unionByName(hashes(own.join(large, "id", "left_semi"), n_hashes, modulus).select("id", F.col("hs").alias("v"), F.lit(True).alias("done"))), "each")

    def values(v, done):
        lengths, flat = v.value_lengths().to_numpy(), v.flatten().to_numpy()
        ready, at = np.asarray(done.to_pylist()), np.repeat(np.arange(len(v)), lengths)
        out, todo = np.empty((len(v), n_hashes), np.int64), ~ready[at]
        out[ready] = flat[~todo].reshape(-1, n_hashes)
        for which, found in _least([pa.RecordBatch.from_arrays([pa.array(at[todo]), pa.array(flat[todo])], names=["id", "x"])], n_hashes, modulus):
            out[which.to_numpy()] = found.T
        return out

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                same = values(part["va"], part["da"]) == values(part["vb"], part["db"])
                same = np.pad(same, ((0, 0), (0, -n_hashes % rows)), constant_values=True)
                yield part.filter(pa.array(same.reshape(part.num_rows, -1, rows).all(axis=2).any(axis=1))).select(pairs_columns)

    pairs_columns = pairs.columns
    side = lambda c: each.select(F.col("id").alias(c), F.col("v").alias(f"v{c}"), F.col("done").alias(f"d{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select(*pairs_columns, "va", "da", "vb", "db")
    return met.mapInArrow(run, pairs.schema)


def similar_pairs(sets: DataFrame, modulus: int, n_hashes: int = 1100, rows: int = 2, least: float = 0.05) -> DataFrame:
    """(a, b, sim) of the pairs that share a band and reach least. Of the two conditions that which leaves the fewer rows to form
    comes first: pairs by common elements, whose bands are then compared, unless frequent elements make these more than CHEAP
    for each value hashed; else candidates by bands, whose sets are then compared. The result is the same."""
    sets = store(sets.select("id", "x").where("id is not null and x is not null").distinct(), "sets")
    n = F.col("n").cast("double")
    met = sets.groupBy("x").agg(F.count("*").alias("n")).agg(F.sum(n * (n - 1) / 2)).first()[0] or 0
    if met <= CHEAP * n_hashes * sets.agg(F.approx_count_distinct("id")).first()[0]:
        return share_band_by_sets(store(exact_pairs(sets, least), "near"), sets, n_hashes, modulus, rows)
    return jaccard(band_pairs(sets, n_hashes, modulus, rows), sets, least)
