"""Frequent itemsets: exact level-wise joins, FP-growth, and chunked mining with a global recount."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.storage import drop, store

#: Candidates that go to every task at most.
SENT = 100_000


def baskets(pairs: DataFrame, min_size: int = 0) -> DataFrame:
    """pairs (basket, item) -> baskets of more than min_size distinct items."""
    return pairs.groupBy("basket").agg(F.array_sort(F.collect_set("item")).alias("items")).where(F.size("items") > min_size)


def frequent_itemsets(pairs: DataFrame, support: int, min_size: int = 0, max_len: int = 99) -> DataFrame:
    """Itemsets in at least support baskets: (itemset array, size, support). Level k joins the baskets' frequent
    (k-1)-sets, which are stored, with their later frequent items, so counting is a grouped sum with a combine and no
    candidate list is sent around."""
    pairs = pairs.select("basket", "item").distinct()
    if min_size:
        pairs = pairs.join(pairs.groupBy("basket").count().where(F.col("count") > min_size).select("basket"), "basket", "left_semi")
    pairs = store(pairs, "pairs")
    one = store(pairs.groupBy("item").agg(F.count("*").alias("support")).where(F.col("support") >= support), "one")
    items = store(pairs.join(one.select("item"), "item").select("basket", "item"), "items")
    have = items.select("basket", F.array("item").alias("itemset"))
    out = one.select(F.array("item").alias("itemset"), "support")
    for _ in range(2, max_len + 1):
        wider = have.join(items, "basket").where(F.col("item") > F.element_at("itemset", -1)).select("basket", F.concat("itemset", F.array("item")).alias("itemset"))
        level = store(wider.groupBy("itemset").agg(F.count("*").alias("support")).where(F.col("support") >= support), "level")
        if level.isEmpty():
            break
        out = out.unionByName(level.select("itemset", "support"))
        now = store(wider.join(level.select("itemset"), "itemset", "left_semi"), "have")
        if hasattr(have, "_stored"):
            drop(have)
        have = now
    return out.withColumn("size", F.size("itemset"))


def vertical_itemsets(pairs: DataFrame, support: int, chunk: int = 10_000) -> DataFrame:
    """The same by intersecting lists of baskets. Baskets are dealt into chunks of about chunk baskets, so that an
    item's list has that length at most in each; a set's support is the sum over the chunks. Two sets of a chunk that agree
    but for their last item meet by an equi-join on the chunk and what they share."""
    pairs = store(pairs.select("basket", "item").distinct(), "pairs")
    one = store(pairs.groupBy("item").agg(F.count("*").alias("support")).where(F.col("support") >= support), "one")
    chunks = max(1, math.ceil(pairs.select("basket").distinct().count() / chunk))
    dealt = pairs.join(one.select("item"), "item").withColumn("part", F.pmod(F.xxhash64("basket"), F.lit(chunks)))
    have = store(dealt.groupBy("part", "item").agg(F.collect_list("basket").alias("held")).select("part", F.slice(F.array("item"), 1, 0).alias("head"), "item", "held"), "lists")
    out = one.select(F.array("item").alias("itemset"), "support")
    while True:
        later = have.select("part", "head", F.col("item").alias("next"), F.col("held").alias("also"))
        met = have.join(later, ["part", "head"]).where(F.col("item") < F.col("next"))
        wider = store(met.select("part", F.concat("head", F.array("item")).alias("head"), F.col("next").alias("item"), F.array_intersect("held", "also").alias("held")).where(F.size("held") > 0), "wider")
        level = store(wider.groupBy("head", "item").agg(F.sum(F.size("held")).alias("support")).where(F.col("support") >= support), "level")
        if level.isEmpty():
            return out.withColumn("size", F.size("itemset"))
        out = out.unionByName(level.select(F.concat("head", F.array("item")).alias("itemset"), "support"))
        now = store(wider.join(level.select("head", "item"), ["head", "item"], "left_semi"), "have")
        drop(have, wider)
        have = now


def fpgrowth_itemsets(pairs: DataFrame, support: int) -> DataFrame:
    """The same by FP-growth. Its threshold is a fraction, so half a basket is taken off against rounding."""
    from pyspark.ml.fpm import FPGrowth

    b = store(baskets(pairs), "baskets")  # read several times
    n = b.count()
    if not n:
        return b.select(F.col("items").alias("itemset"), F.lit(0).cast("long").alias("support"), F.lit(0).alias("size"))
    found = FPGrowth(itemsCol="items", minSupport=max(0.0, (support - 0.5) / n)).fit(b.select("items")).freqItemsets
    return found.select(F.array_sort("items").alias("itemset"), F.col("freq").alias("support"), F.size("items").alias("size"))


def _bits(chunk: pa.ListArray, least: int) -> tuple[list, np.ndarray]:
    """(items in order, bits): items of at least `least` of the chunk's baskets, and of each a bit per basket."""
    flat, basket = chunk.flatten().dictionary_encode(), np.repeat(np.arange(len(chunk)), chunk.value_lengths().to_numpy())
    codes, names = flat.indices.to_numpy(), flat.dictionary
    often = np.flatnonzero(np.bincount(codes, minlength=len(names)) >= least)
    often = often[pc.sort_indices(names.take(pa.array(often))).to_numpy()]
    place = np.full(len(names), -1)
    place[often] = np.arange(len(often))
    rows, kept = place[codes], place[codes] >= 0
    bits = np.zeros((len(often), -(-len(chunk) // 8)), np.uint8)
    np.bitwise_or.at(bits, (rows[kept], basket[kept] >> 3), (1 << (basket[kept] & 7)).astype(np.uint8))
    return names.take(pa.array(often)).to_pylist(), bits


def mine_chunk(chunk: pa.ListArray, threshold: int) -> list[tuple]:
    """Itemsets in at least threshold of the chunk's baskets, by intersecting their bits, a head's followers at once."""
    items, bits = _bits(chunk, threshold)
    found, todo = [], [((), list(range(len(items))), bits)]
    while todo:
        head, last, held = todo.pop()
        for i, x in enumerate(last):
            found.append((*head, items[x]))
            both = held[i + 1 :] & held[i]
            enough = np.flatnonzero(np.bitwise_count(both).sum(axis=1, dtype=np.int64) >= threshold)
            if len(enough):
                todo.append(((*head, items[x]), [last[i + 1 + j] for j in enough], both[enough]))
    return found


def _chunks(batches, chunk: int):
    """The lists that follow on each other, chunk at a time."""
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.column(0).slice(at, chunk - n)
            held.append(part)
            at, n = at + len(part), n + len(part)
            if n == chunk:
                yield pa.concat_arrays(held)
                held, n = [], 0
    if n:
        yield pa.concat_arrays(held)


def son_candidates(b: DataFrame, support: int, chunk: int = 20_000) -> DataFrame:
    """Itemsets that are frequent in some chunk, in proportion to its share of the baskets. A chunk is what follows on
    each other in a partition, of at most chunk baskets, so a task holds no more."""
    total = b.count()

    def mine(batches):
        for held in _chunks(batches, chunk):
            yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in mine_chunk(held, max(1, math.ceil(len(held) * support / total)))], held.type)], names=["itemset"])

    item = b.schema["items"].dataType.simpleString()
    return b.select("items").mapInArrow(mine, f"itemset {item}").distinct()


def son_itemsets(pairs: DataFrame, support: int, min_size: int = 0, candidates: DataFrame | None = None) -> DataFrame:
    """Candidates by chunk, then counted in all baskets. Up to SENT candidates, counted first, go to every task, which counts them by
    bits; of more, each meets the baskets of its rarest item, so that common items multiply little, and those that hold the rest are counted."""
    b = store(baskets(pairs, min_size), "baskets")
    candidates = store(son_candidates(b, support) if candidates is None else candidates.select("itemset"), "candidates")
    if candidates.count() <= SENT:
        return _counted(b, [tuple(r["itemset"]) for r in candidates.collect()]).where(F.col("support") >= support).withColumn("size", F.size("itemset"))
    each = b.select("basket", "items", F.explode("items").alias("item"))
    counts = each.groupBy("item").agg(F.count("*").alias("n"))
    rarest = candidates.select("itemset", F.explode("itemset").alias("item")).join(counts, "item").groupBy("itemset").agg(F.min(F.struct("n", "item"))["item"].alias("item"))
    hit = rarest.join(each, "item").where(F.size(F.array_except("itemset", "items")) == 0)
    return hit.groupBy("itemset").agg(F.count("*").alias("support")).where(F.col("support") >= support).withColumn("size", F.size("itemset"))


def _counted(b: DataFrame, wanted: list[tuple], chunk: int = 20_000) -> DataFrame:
    """(itemset, support) of the itemsets wanted in all baskets; what a task sends on is a row per itemset."""
    wanted = sorted(wanted)

    def count(batches):
        total = np.zeros(len(wanted), np.int64)
        kind = None
        for held in _chunks(batches, chunk):
            kind = held.type
            items, bits = _bits(held, 1)
            place, path = {x: i for i, x in enumerate(items)}, []  # path: the items of the last itemset with the bits of its heads
            for i, itemset in enumerate(wanted):
                same = 0
                while same < min(len(path), len(itemset)) and path[same][0] == itemset[same]:
                    same += 1
                del path[same:]
                for x in itemset[same:]:
                    own = bits[place[x]] if x in place else np.zeros(bits.shape[1], np.uint8)
                    path.append((x, path[-1][1] & own if path else own))
                total[i] += int(np.bitwise_count(path[-1][1]).sum(dtype=np.int64))
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.array(list(map(list, wanted)), kind), pa.array(total)], names=["itemset", "n"])

    item = b.schema["items"].dataType.simpleString()
    return b.select("items").mapInArrow(count, f"itemset {item}, n long").groupBy("itemset").agg(F.sum("n").alias("support"))


def report(itemsets: list[tuple]) -> str:
    """Itemsets as lines, one per size: ('a',),('b',) and ('a', 'b'),..."""
    by_size = defaultdict(list)
    for x in sorted(map(tuple, itemsets), key=lambda x: (len(x), x)):
        by_size[len(x)].append(x)
    one = lambda x: "(" + ", ".join(f"'{v}'" for v in x) + ")"
    return "\n\n".join(",".join(map(one, by_size[k])) for k in sorted(by_size))
