"""SimHash near-dedup with generalised pigeonhole search.

Fingerprints of 64 bits over word shingles; equal ones are collapsed before anything else. If the 64
bits are split into parts with thresholds t_i (-1 or more, -1: never probed) and the t_i + 1 sum up to
LIMIT + 1, two fingerprints within LIMIT bits differ by at most t_i in some part i (generalised
pigeonhole principle). So correlated bits are grouped into parts, thresholds are allocated by dynamic
programming on the candidates estimated from all fingerprints, and for every number of parts the
cheapest allocation is compared. A part with threshold t is probed by its value with each choice of t
bits masked out.

Members of a bucket are verified against each other inside a task, which returns the links of a spanning
forest instead of all pairs; buckets above SPLIT members are cut into slices, and every pair of
slices is verified, in a task of its own, so none is dropped or capped.

near_duplicates() links by the bits of one fingerprint. similar() links by the Jaccard similarity of shingle sets, for which
64 bits say too little (at 0.8 they differ in 8 bits or more): it gives each text several fingerprints, probes each
in this way, and takes the pairs whose bits come near the similarity as candidates. Texts that candidates connect are then
verified against each other by their sets.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import WORD, components, drop, store

SHINGLE, LIMIT, BITS, HASH_SEED = 4, 4, 64, 42
SPLIT = 4096
#: similar(): words of a shingle, least similarity, and fingerprints of a text.
STAGE_SHINGLE, SIMILARITY, TABLES = 5, 0.8, 4
#: similar(): most pairs of just that similarity that may miss each other, whatever the number of texts.
MISS = 0.01
#: similar(): by how many standard deviations of its bits a pair may look less similar and still be verified, and the
#: bytes of sets that one task holds.
MARGIN, SLICE = 2.5, 32_000_000
#: Relative cost of a key that is shuffled and of a pair that is verified, and the most masked keys of a part.
KEY_COST, PAIR_COST, MOST_KEYS = 1.0, 0.01, 600
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of one text; 0 without words."""
    return majority(hashes(text, shingle))


def hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of one text; of the whole sequence where it has fewer words."""
    words = WORD.findall((text or "").translate(LOWER))
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1) if words else 0
    joined = " ".join(words).encode("utf-8", "surrogatepass")
    if n <= 1:
        return np.array([digest(joined, HASH_SEED)] * n, np.uint64)
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], ends + 1])[:n].tolist()
    stops = np.concatenate([ends, [len(joined)]])[shingle - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], HASH_SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def wide(h: np.ndarray, tables: int) -> list[int]:
    """tables fingerprints of a text's shingle hashes: the first is fingerprint()'s, the others come from the same
    hashes, mixed again with the table's number; all 0 without words."""
    out = [majority(h)]
    for k in range(1, tables):
        x = h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(majority(x ^ (x >> np.uint64(31))))
    return out


def wide_fingerprint(text: str | None, shingle: int, tables: int) -> list[int]:
    return wide(hashes(text, shingle), tables)


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    count = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * count > len(h)).tolist()))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) per row, fp as a signed long."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), shingle) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, fp long")


def wide_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, tables: int) -> DataFrame:
    """(id, fp, w0, w1, ..., set, row) per row: a hash of the set of shingles, the tables' fingerprints, all as signed longs, the
    set itself as sorted numbers of 32 bits each (two sets of a thousand shingles differ in truth from what these tell by a
    four-thousandth of a shingle), and a number of the row."""
    names = [f"w{k}" for k in range(tables)]

    def run(batches):
        for b in batches:
            fps, sets = [], []
            for x in b.column(1):
                h = hashes(x.as_py(), shingle)
                own = np.unique(h)
                fps.append([xxhash.xxh64_intdigest(own.tobytes()), *wide(h, tables)])
                sets.append(np.unique(own.astype(np.uint32)).tobytes())
            fps = np.array(fps, np.uint64).reshape(-1, tables + 1).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(fps[:, k])) for k in range(tables + 1)), pa.array(sets, pa.binary())], names=["id", "fp", *names, "set"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, fp long, " + ", ".join(f"{w} long" for w in names) + ", set binary")
    return found.withColumn("row", F.monotonically_increasing_id())


def bits_of(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of fingerprints, share of ones per bit, and bit correlations, over all fingerprints: each
    task sends sums of a fixed size, and Spark adds them up."""

    def run(batches):
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for b in batches:
            x = bits_of(b.column(0).to_numpy(zero_copy_only=False)).astype(np.float64)
            total += (x.T @ x).astype(np.int64)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS + 1, dtype=np.int32)), pa.array([*total.tolist(), [n]], pa.list_(pa.int64()))], names=["i", "row"])

    cells = distinct.mapInArrow(run, "i int, row array<long>").select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    both, n = np.zeros((BITS, BITS)), 0
    for i, j, v in cells.collect():  # 64 x 64 + 1 sums
        if i == BITS:
            n = v
        else:
            both[i, j] = v
    share = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(share, share)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    return n, share, np.abs(cov / np.outer(sd, sd))


def group_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """parts groups of nearly equal size: each grows by the bit most correlated with it."""
    left, out = set(range(BITS)), []
    for p in range(parts):
        size = (BITS + p) // parts
        strongest = max(left, key=lambda b: (sum(corr[b, x] for x in left) - corr[b, b], -b))
        group = [strongest]
        left.remove(strongest)
        while len(group) < size:
            b = max(left, key=lambda b: (sum(corr[b, x] for x in group), -b))
            group.append(b)
            left.remove(b)
        out.append(sorted(group))
    return out


def allocate(n: int, share: np.ndarray, groups: list[list[int]], limit: int = LIMIT) -> tuple[float, list[int]]:
    """Thresholds of the parts, of least cost: keys sent plus candidate pairs estimated from the bits'
    shares of ones, bits taken as independent."""
    cost = []
    for group in groups:
        agree = 1.0
        for b in group:
            agree *= share[b] ** 2 + (1 - share[b]) ** 2
        costs = {-1: 0.0}
        for t in range(min(limit, len(group)) + 1):
            keys = math.comb(len(group), t)
            if keys <= MOST_KEYS:
                per_key = agree * (2.0**t)  # masked bits agree always
                costs[t] = n * keys * KEY_COST + 0.5 * n * n * keys * per_key * PAIR_COST
        cost.append(costs)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for costs in cost:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t, more in costs.items():
                u = used + t + 1
                if u <= limit + 1 and (u not in after or c + more < after[u][0]):
                    after[u] = (c + more, [*ts, t])
        best = after
    return best.get(limit + 1, (math.inf, []))


def plan(n: int, share: np.ndarray, corr: np.ndarray, limit: int = LIMIT) -> list[tuple[list[int], int]]:
    """The parts to probe, with their thresholds."""
    options = [(*allocate(n, share, g := group_bits(corr, m), limit), g) for m in range(2, 2 * limit + 1)]
    _, ts, groups = min(options, key=lambda x: x[0])
    return [(g, t) for g, t in zip(groups, ts, strict=True) if t >= 0]


def rounds(similarity: float, tables: int, limit: int = LIMIT, miss: float = MISS) -> int:
    """How often the bits of each table have to be dealt into limit + 1 parts that are probed whole, so that a pair of
    this similarity meets in none with a chance of at most miss: bits differ independently, and parts of several turns
    share bits, so the chance is taken from 50,000 seeded pairs."""
    differ = np.random.default_rng(0).random((50000, BITS)) < bit_angle(similarity)
    apart, turn = np.ones(len(differ), bool), 0
    while apart.mean() ** tables > miss:
        for group, _ in whole_parts(np.eye(BITS), limit, 0, turn):
            apart &= differ[:, group].any(axis=1)
        turn += 1
    return turn


def whole_parts(corr: np.ndarray, limit: int, table: int, turn: int) -> list[tuple[list[int], int]]:
    """limit + 1 parts to probe whole, whatever the number of fingerprints: correlated bits together in the first
    turn, dealt at random, seeded, in the others."""
    if not turn:
        return [(g, 0) for g in group_bits(corr, limit + 1)]
    dealt = np.random.default_rng([table, turn]).permutation(BITS)
    return [(sorted(g.tolist()), 0) for g in np.array_split(dealt, limit + 1)]


def masks(parts: list[tuple[list[int], int]]) -> list[int]:
    """For each key that a fingerprint sends, the bits that it keeps."""
    out = []
    for group, t in parts:
        for gone in combinations(group, t):
            out.append(sum(1 << b for b in group if b not in gone))
    return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; of rows of several words, over all of them."""
    bits = np.bitwise_count((a ^ b).view(np.uint64))  # which takes the absolute value of signed numbers
    return bits.sum(axis=1, dtype=np.int64) if bits.ndim > 1 else bits


def forest(fps: np.ndarray, limit: int, other: int = 0) -> list[tuple[int, int]]:
    """Links (positions) of a spanning forest of the fingerprints within limit bits of each other; with
    other, of those links only that cross position other. What is linked already is not compared
    again, so a dense group costs little more than its size."""
    n = len(fps)
    root = np.arange(n)
    links = []
    for i in range(n - 1):
        begin = max(i + 1, other)
        open_ = begin + np.flatnonzero(root[begin:] != root[i]) if i < (other or n) else np.empty(0, np.int64)
        near = open_[distance(fps[open_], fps[i]) <= limit]
        for j in near.tolist():
            if root[j] != root[i]:
                links.append((i, j))
                root[root == root[j]] = root[i]
    return links


def small_groups(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between nodes inside groups of equal, adjacent keys: groups of up to 32 all at once, larger ones by forest()."""
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    size = np.diff(np.append(start, len(keys)))
    rank_left = np.repeat(start + size, size) - np.arange(len(keys))  # members from here to the group's end
    small = np.repeat(size <= 32, size)
    a, b = [], []
    for d in range(1, 32):
        at = np.flatnonzero(small & (rank_left > d))
        if not len(at):
            break
        at = at[distance(fps[at], fps[at + d]) <= limit]
        a.append(nodes[at])
        b.append(nodes[at + d])
    for s, n in zip(start[size > 32].tolist(), size[size > 32].tolist(), strict=True):
        own = nodes[s : s + n]
        links = np.array(forest(fps[s : s + n], limit), np.int64).reshape(-1, 2)
        a.append(own[links[:, 0]])
        b.append(own[links[:, 1]])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(distinct: DataFrame, limit: int = LIMIT, split: int = SPLIT, words: tuple[str, ...] = ("fp",), total: int | None = None, turn: int | None = None) -> DataFrame:
    """Links (a, b) between distinct nodes (fp) that connect all those whose fingerprints lie within limit bits.

    A node may have several fingerprints, its columns words: each is probed by a plan of its own for limit
    bits, and a pair that meets in any is a link if all its fingerprints together differ by at most total bits. With
    turn, the parts are that turn's whole_parts() instead."""
    total = limit if total is None else total

    def parts(k: int, word: str) -> list[tuple[list[int], int]]:
        statistics = (0, None, None) if turn else bit_statistics(distinct.select(word))
        return plan(*statistics, limit) if turn is None else whole_parts(statistics[2], limit, k, turn)

    keep = [(k, mask) for k, word in enumerate(words) for mask in masks(parts(k, word))]
    if not keep:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    table, signed = np.array([k for k, _ in keep]), np.array([m for _, m in keep], np.uint64).view(np.int64)
    more = [w for w in words if w != "fp"]
    sent_columns = ["fp", *more]

    def shaped(columns: list[np.ndarray]) -> np.ndarray:
        """The fingerprints of rows (fp, *more): one number a row, or a row of numbers."""
        return np.stack(columns[1:], axis=1) if more else columns[0]

    def keys(batches):
        for b in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            for at in range(0, b.num_rows, 4096):
                own = [c[at : at + 4096] for c in columns]
                fps = shaped(own).reshape(len(own[0]), -1)
                # a mask's number is mixed in, so that equal values under two masks stay apart
                mixed = (fps[:, table] & signed[None, :]).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(len(signed), dtype=np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F)
                mixed ^= mixed >> np.uint64(32)
                yield pa.RecordBatch.from_arrays([pa.array(mixed.view(np.int64).ravel()), *(pa.array(np.repeat(c, len(signed))) for c in own)], names=["k", *sent_columns])

    sent = distinct.select(*sent_columns).mapInArrow(keys, ", ".join(f"{c} long" for c in ["k", *sent_columns]))
    pairs = "a long, b long"

    def verify(batches):
        """Rows come sorted by key; a group that runs on into the next batch is carried over."""
        held = [np.empty(0, np.int64)] * (1 + len(sent_columns))
        for b in chain(batches, [None]):
            if b is not None:
                held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, b.columns, strict=True)]
                upto = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            else:
                upto = len(held[0])
            now, held = [h[:upto] for h in held], [h[upto:] for h in held]
            x, y = small_groups(now[0], now[1], shaped(now[1:]), total)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    large = store(sent.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > split), "large")
    if large.isEmpty():
        return sent.repartition("k").sortWithinPartitions("k").mapInArrow(verify, pairs)
    # members of a large bucket are dealt into slices; the task of slices (s, t) gets both
    sliced = sent.join(large, "k").withColumn("of", F.ceil(F.col("n") / split).cast("int")).withColumn("s", F.pmod(F.xxhash64("fp"), F.col("of")).cast("int"))
    tasks = sliced.select("k", *sent_columns, "s", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("o")).select(
        "k", F.least("s", "o").alias("lo"), F.greatest("s", "o").alias("hi"), (F.col("s") > F.col("o")).alias("right"), *sent_columns
    )

    def cross(group: pa.Table) -> pa.Table:
        right = group["right"].to_numpy()
        order = np.argsort(right, kind="stable")
        own = [group[c].to_numpy()[order] for c in sent_columns]
        other = int((~right).sum()) if group["lo"][0].as_py() != group["hi"][0].as_py() else 0
        at = np.array(forest(shaped(own), total, other), np.int64).reshape(-1, 2)
        return pa.table({"a": own[0][at[:, 0]], "b": own[0][at[:, 1]]})

    rest = sent.join(large, "k", "left_anti").repartition("k").sortWithinPartitions("k").mapInArrow(verify, pairs)
    return rest.unionByName(tasks.groupBy("k", "lo", "hi").applyInArrow(cross, pairs))


def exact_forest(sets: list[np.ndarray], words: np.ndarray, least: float, bits: int, label: np.ndarray | None = None, other: int = 0) -> list[tuple[int, int]]:
    """Links (positions) that connect the sets whose similarity is at least least, of those within bits bits. label: which are
    connected already; with other, only links that cross position other. What is linked is not compared again."""
    n = len(sets)
    root = np.arange(n) if label is None else label.copy()
    size = np.array([len(x) for x in sets], np.int64)
    links = []
    for i in range(min(n - 1, other or n)):
        begin = max(i + 1, other)
        low, high = np.minimum(size[begin:], size[i]), np.maximum(size[begin:], size[i])
        near = begin + np.flatnonzero((root[begin:] != root[i]) & (low >= least * high))
        near = near[distance(words[near], words[i]) <= bits] if len(near) else near
        for j in near.tolist():
            if root[j] != root[i]:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= least * (size[i] + size[j] - both) - 1e-9:
                    links.append((i, j))
                    root[root == root[j]] = root[i]
    return links


def sets_of(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint32) for x in column.to_pylist()]


def exact_links(members: DataFrame, words: list[str], least: float, bits: int, slice_bytes: int = SLICE) -> DataFrame:
    """Links (a, b) between members (root, fp, set, words) of one root whose sets reach least, and whose fingerprints lie within
    bits bits: enough to connect all such.

    The members of a root are compared in one task, which holds slice_bytes of sets at most. Larger ones are dealt into
    slices: each is compared in itself and with the root's own text, with which most are linked in a group of near copies; only
    those that are not then meet the other slices, in a task for each pair of them, so that none is left out."""
    pairs, columns = "a long, b long", ["fp", *words]
    size = F.length("set") + 64
    large = store(members.groupBy("root").agg(F.sum(size).alias("bytes")).where(F.col("bytes") > slice_bytes), "large")

    def parts(group) -> tuple[np.ndarray, list, np.ndarray]:
        # fingerprints may come as a table of chunks
        of = lambda c: np.asarray(group.column(c).to_numpy(zero_copy_only=False) if isinstance(group, pa.RecordBatch) else group.column(c).to_numpy())
        return of("fp"), sets_of(group.column("set")), np.stack([of(w) for w in words], axis=1).reshape(group.num_rows, len(words))

    def rows(fps: np.ndarray, at: list[tuple[int, int]]) -> dict:
        at = np.array(at, np.int64).reshape(-1, 2)
        return {"a": pa.array(fps[at[:, 0]]), "b": pa.array(fps[at[:, 1]])}

    def small(batches):
        """Rows come sorted by root; those that run on into the next batch are carried over."""
        held = None
        for b in chain(batches, [None]):
            if b is not None:
                held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if held is None or not held.num_rows:
                continue
            roots = held.column("root").to_numpy()
            upto = int(np.searchsorted(roots, roots[-1])) if b is not None else len(roots)
            fps, sets, bitwords = parts(held.slice(0, upto))
            cut = [*np.flatnonzero(np.append(True, roots[1:upto] != roots[: upto - 1])).tolist(), upto] if upto else [0]
            at = [(s + i, s + j) for s, e in zip(cut, cut[1:], strict=False) for i, j in exact_forest(sets[s:e], bitwords[s:e], least, bits)]
            held = held.slice(upto)
            yield pa.RecordBatch.from_pydict(rows(fps, at))

    if large.isEmpty():
        return members.repartition("root").sortWithinPartitions("root").mapInArrow(small, pairs)
    found = store(members.join(large.select("root"), "root", "left_anti").repartition("root").sortWithinPartitions("root").mapInArrow(small, pairs), "exact")
    sliced = members.join(large, "root").withColumn("of", F.ceil(F.col("bytes") / slice_bytes).cast("int")).withColumn("s", F.pmod(F.xxhash64("fp"), F.col("of")).cast("int"))
    sliced = store(sliced.select("root", "of", "s", "set", *columns), "sliced")
    own = sliced.where(F.col("fp") == F.col("root")).select("root", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("s"), "set", *columns, F.lit(True).alias("own"))

    def within(group: pa.Table) -> pa.Table:
        group = group.sort_by([("own", "descending")])
        fps, sets, bitwords = parts(group)
        return pa.table(rows(fps, exact_forest(sets, bitwords, least, bits)))

    first = store(own.unionByName(sliced.select("root", "s", "set", *columns, F.lit(False).alias("own"))).groupBy("root", "s").applyInArrow(within, pairs), "exact")
    label = components(first).withColumnRenamed("root", "label")
    label = store(sliced.join(label, F.col("fp") == F.col("node"), "left").select("root", "s", "of", "set", *columns, F.coalesce("label", "fp").alias("label")), "labelled")
    done = label.where(F.col("fp") == F.col("root")).select("root", F.col("label").alias("done"))
    rest = label.join(done, "root").where(F.col("label") != F.col("done"))
    slices = store(rest.groupBy("root").agg(F.ceil(F.sum(size) / slice_bytes).cast("int").alias("q")), "rest")
    right = rest.join(slices, "root").withColumn("r", F.pmod(F.xxhash64("fp"), F.col("q")).cast("int"))
    right = right.select("root", "r", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("s"), "set", *columns, "label", F.lit(True).alias("right"))
    left = label.join(slices, "root").select("root", F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("r"), "s", "set", *columns, "label", F.lit(False).alias("right"))

    def across(group: pa.Table) -> pa.Table:
        group = group.sort_by([("right", "ascending")])
        fps, sets, bitwords = parts(group)
        other = int(pc.sum(pc.invert(group.column("right"))).as_py() or 0)
        _, label = np.unique(group.column("label").to_numpy(), return_inverse=True)
        return pa.table(rows(fps, exact_forest(sets, bitwords, least, bits, label, other) if 0 < other < len(fps) else []))

    return found.unionByName(first).unionByName(left.unionByName(right).groupBy("root", "r", "s").applyInArrow(across, pairs))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, shingle: int = SHINGLE, split: int = SPLIT) -> DataFrame:
    """One row per row of docs: its id, fp (signed long) and component_id, the smallest id reachable
    over links of at most limit bits.

    A null or empty text has the fingerprint 0 and links as any other; rows with a null id take part, and
    their component_id is null only if no id is reachable; repeated rows and ids each keep a row; an
    empty table gives no rows; other columns are not read. A text of any length has one fingerprint, of all its shingles."""
    return classes(store(fingerprints(docs, id_col, text_col, shingle), "fingerprints"), id_col, limit, split)


def bit_angle(similarity: float) -> float:
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def bits_at(similarity: float, bits: int) -> int:
    """The bits in which two texts differ on average whose shingle sets (of one size) have a Jaccard
    similarity of similarity: each bit differs with the angle between the two over pi."""
    return round(bits * bit_angle(similarity))


def loose_bits(similarity: float, bits: int) -> int:
    """Differing bits up to which a pair is verified."""
    p = bit_angle(similarity)
    return math.ceil(bits * p + MARGIN * math.sqrt(bits * p * (1 - p)))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = STAGE_SHINGLE, tables: int = TABLES, limit: int = LIMIT, split: int = SPLIT, slice_bytes: int = SLICE) -> DataFrame:
    """As near_duplicates(), by similarity: texts have tables fingerprints of 64 bits each, and a pair that meets in the probes of
    any, or is connected by such, is a link if its sets of shingles have a Jaccard similarity of similarity or more.

    Pairs within limit bits in one fingerprint are certain to meet; others of just that similarity miss each
    other with a chance of at most MISS, whatever the number of texts: probes are fixed by rounds(), one
    shuffle each, so pairs to compare by their bits grow with the square of the texts. A pair is verified by its sets if its bits
    are within loose_bits() (one of just that similarity is with a chance of over 0.99). Texts without words are one set, a text
    of fewer words than a shingle is one shingle. Nulls, empty texts, ties, repeated rows and empty tables are as there; very
    long texts have large sets, of four bytes a shingle; fp is a hash of the set."""
    words = [f"w{k}" for k in range(tables)]
    bits = loose_bits(similarity, BITS * tables)
    every = store(wide_fingerprints(docs, id_col, text_col, shingle, tables), "fingerprints")
    distinct = store(every.groupBy("fp").agg(F.min("id").alias("least"), F.min(F.struct(*words)).alias("w"), F.min("row").alias("row")).select("fp", "least", "row", "w.*"), "distinct")
    # stored one by one, so that only one turn's shuffle is on disk
    met = [store(links(distinct, limit, split, tuple(words), bits, turn), "links") for turn in range(rounds(similarity, tables, limit))]
    loose = components(reduce(DataFrame.unionByName, met))
    members = distinct.join(loose, F.col("fp") == F.col("node")).select("row", "fp", "root", *words)
    members = store(every.select("row", "set").join(members, "row").select("root", "fp", "set", *words), "members")
    drop(*met)
    found = store(exact_links(members, words, similarity, bits, slice_bytes), "links")
    drop(members)
    return named(every.select("id", "fp"), distinct, found, id_col)


def classes(every: DataFrame, id_col: str, limit: int, split: int) -> DataFrame:
    """id, fp and component_id of each row of every (id, fp)."""
    distinct = store(every.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    return named(every, distinct, links(distinct, limit, split), id_col)


def named(every: DataFrame, distinct: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """Rows with the least id of what the links found between distinct nodes connect."""
    roots = components(found)
    of = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # stored, so that AQE can split the join if one component holds most fingerprints
    least = store(of.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    known = of.select("fp", "root").join(least, "root").select(F.col("fp").alias("f"), "component_id")
    return every.select("id", "fp").join(known, F.col("fp") == F.col("f")).select(F.col("id").alias(id_col), "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = STAGE_SHINGLE, tables: int = TABLES) -> DataFrame:
    """docs, all columns of any name, one row of each component in similar(): that with the smallest id. Texts decide, not ids: rows
    with a null id come after all others, rows of one id are told apart by a hash of the text, and of rows with one id and
    text one stays. A null text is an empty one; an empty table gives no rows."""
    text = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), text.alias("text"))
    found = similar(docs.select(key.alias("row"), F.col(text_col).alias("text")), "row", "text", similarity, shingle, tables)
    kept = store(found.where(F.col("component_id") == F.col("row")).select("row.id", "row.text").distinct(), "kept")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(id_col).alias("of"), text.alias("hash"))
    joined = whole.join(kept, F.col("of").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("text")))
    return joined.dropDuplicates(["of", "hash"]).select("doc.*")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    from siltstone.llm.common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
