"""LM scoring by masked pseudo-likelihood: every word is predicted from both sides.

A bidirectional window network (embeddings of SIDE words on either side, one hidden layer) gives each word a score s in
its context, and P(word | context) = q(word) exp(s) / Z, q being the word's share of the corpus. The vocabulary is all
words of the corpus, told apart by 48 bits: the OWN most frequent have rows of their own in the network's tables, the others
share SHARED rows by hash, and within a row the corpus's exact counts tell them apart. Z is a sum over the HEAD most
frequent rows, the word itself, and a seeded sample of the others in proportion to q (importance-sampled softmax), in
training as in scoring; the word itself is always in it, so no probability exceeds 1.

The network's tables have a fixed size, so it can't remember contexts. A memory that grows with the corpus does:
for each pair of neighbours (the word before, the word after) the words that stand between them, counted by the document, and with
the scored document left out. Of b such occurrences elsewhere, a of which are the word itself, the two are mixed as
(b / (b + 1)) (a / b) + (1 / (b + 1)) P(word | context), the more of the memory, the more often it has seen the context.

Training sees every word of every text as a masked target, once, in ROUNDS rounds: each shard of texts fits the network to a
part of its texts from the last round's parameters, and the results are averaged, each row by the number of its targets. Texts
are dealt into groups and shards by a hash of id and text, and read in an order of hashes, so that any layout of the input
gives the same parameters.

Groups send their distinct words, and their contexts, packed by hash bucket, once; buckets answer in the order in which
they were asked, packed by group. So hot words and contexts cost an entry for each group or document, and no pairs are formed.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.llm.common import drop, new_path, store
from siltstone.llm.words import M1, MIX, Words, blob, dealt, measured, rows

OWN, SHARED = 6144, 2048
SLOTS, NONE = 1 << 16, 2**64 - 1
ROWS, SIDE, WIDTH, HIDDEN = OWN + SHARED, 2, 8, 16
HEAD, NOISE, RATE, SEED, ROUNDS = 32, 32, 0.07, 7, 3
SIDES = (*range(-SIDE, 0), *range(1, SIDE + 1))
#: A batch of training: runs of words, and words of a run.
RUNS, RUN = 16, 128
#: The bits of a word's hash that tell words apart.
BITS48 = np.uint64(2**48 - 1)
#: Scores above this count as this, so that no exponential overflows.
MOST = np.float32(60)
#: Characters of a group, the unit of every exchange, and groups of a shard, the unit of training; entries of a bucket.
GROUP_CHARS, SHARD_GROUPS, BUCKET_ENTRIES, PIECE = 1_500_000, ROUNDS, 1_000_000, 256
#: Parameters by row of the vocabulary (the last row of e, BEYOND, stands for what is beyond a text), and the others.
BEYOND = ROWS
BY_ROW = {"e": (ROWS + 1, WIDTH), "u": (ROWS, HIDDEN), "b": (ROWS, 1)}
OTHERS = {"w": (2 * SIDE * WIDTH, HIDDEN), "c": (1, HIDDEN)}
SHAPES = BY_ROW | OTHERS
FLAT = sum(math.prod(s) for s in SHAPES.values())


class Vocabulary:
    """Rows of words: those of the OWN most frequent that are first in their slot of a hash table, and shared ones; counts of
    each row and in all."""

    def __init__(self, top: list[tuple[int, int]], shared: np.ndarray):
        """top: (48 bits, count) of the most frequent words. shared: counts of all words by shared row, top ones included."""
        shared = np.array(shared, np.float64)
        self.slot, self.row = np.full(SLOTS, NONE, np.uint64), np.zeros(SLOTS, np.uint16)
        self.n = np.zeros(ROWS, np.float64)
        for i, (h, n) in enumerate(sorted(top, key=lambda x: (-x[1], x[0]))):
            if self.slot[h % SLOTS] == NONE:
                self.slot[h % SLOTS], self.row[h % SLOTS], self.n[i] = h, i, n
                shared[h // SLOTS % SHARED] -= n
        self.n[OWN:] = shared
        self.total = max(self.n.sum(), 1.0)
        with np.errstate(divide="ignore"):
            self.log_q = np.log(self.n / self.total).astype(np.float32)
        self.head = np.argsort(-self.n, kind="stable")[:HEAD]
        rest = self.n / self.total
        rest[self.head] = 0
        self.tail = float(rest.sum())
        self.ends = np.cumsum(rest)
        self.is_head = np.full(ROWS, -1, np.int16)
        self.is_head[self.head] = np.arange(HEAD)

    def rows_of(self, h: np.ndarray) -> np.ndarray:
        at = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        other = np.uint16(OWN) + (h // np.uint64(SLOTS)).astype(np.uint16) % np.uint16(SHARED)
        return np.where(self.slot[at] == h, self.row[at], other)

    def noise(self, rng: np.random.Generator, k: int) -> np.ndarray:
        """k rows other than the head in proportion to their counts; none where the head is all."""
        if self.tail <= 0:
            return np.empty(0, np.int64)
        return np.minimum(np.searchsorted(self.ends, rng.random(k) * self.ends[-1], "right"), ROWS - 1)


def start() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    p = {k: rng.standard_normal(s).astype(np.float32) for k, s in SHAPES.items()}
    return p | {"e": p["e"] * np.float32(0.3), "w": p["w"] / np.float32(math.sqrt(2 * SIDE * WIDTH)), "u": p["u"] * np.float32(0.05), "b": np.zeros(SHAPES["b"], np.float32), "c": np.zeros(SHAPES["c"], np.float32)}


def laid_out(ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of all words in a line, with SIDE times BEYOND before, between and after texts, and where each word is."""
    new = text[1:] != text[:-1]
    place = np.arange(len(ids)) + SIDE
    place[1:] += SIDE * np.cumsum(new)
    line = np.full(len(ids) + SIDE * (2 + int(new.sum())), BEYOND, np.uint16)
    line[place] = ids
    return line, place


def windows(e: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The embeddings on both sides of each word of runs (a row each, with SIDE words more at either end)."""
    near, n = e[block], block.shape[1] - 2 * SIDE
    return np.concatenate([near[:, SIDE + d : SIDE + d + n] for d in SIDES], axis=2).reshape(-1, 2 * SIDE * WIDTH)


def forward(p: dict, v: Vocabulary, x: np.ndarray, target: np.ndarray, noise: np.ndarray) -> tuple:
    """(h, selected rows, exp(s) times weight of those, the same of each target, Z): of a batch of windows() and targets.

    The selected rows are the head, each with its share as weight, and the sample, which shares the weight of all rows
    beyond the head. A target beyond the head is added to Z; one of the head is in it already."""
    h = x @ p["w"]
    h += p["c"]
    np.tanh(h, out=h)
    rows_ = np.concatenate([v.head, noise])
    u, bias = p["u"][rows_], p["b"][rows_, 0].copy()
    bias[:HEAD] += v.log_q[v.head]
    if len(noise):
        bias[HEAD:] += np.float32(math.log(v.tail / len(noise)))
    z = h @ u.T
    z += bias
    if np.abs(u).sum(axis=1).max() + np.abs(p["b"][rows_, 0]).max() > MOST:
        np.minimum(z, MOST, out=z)
    np.exp(z, out=z)
    own = np.einsum("ij,ij->i", h, p["u"][target])
    own += p["b"][target, 0]
    own += v.log_q[target]
    own = np.exp(np.minimum(own, MOST))
    return h, rows_, z, own, z.sum(axis=1) + own * (v.is_head[target] < 0)


def target_probs(p: dict, v: Vocabulary, line: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """log P(row | context) of each place of a line; what it says of BEYOND is of no use."""
    out = np.zeros(len(line), np.float64)
    for s in range(SIDE, len(line) - SIDE, 1024):
        block = line[s - SIDE : min(s + 1024, len(line) - SIDE) + SIDE]
        t = np.minimum(block[SIDE:-SIDE], ROWS - 1)
        _, _, _, own, total = forward(p, v, windows(p["e"], block[None]), t, noise)
        out[s : s + len(t)] = np.log(np.maximum(own / total, 1e-30))
    return out


def summed(ids: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and the sums of their rows of g."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    return ids[first], np.add.reduceat(g[order], first, axis=0)


def gradients(p: dict, v: Vocabulary, block: np.ndarray, noise: np.ndarray) -> tuple[float, dict]:
    """The summed loss of runs of words, and its gradients: by row (rows, sums), or whole."""
    target = block[:, SIDE:-SIDE].ravel()
    live = np.flatnonzero(target != BEYOND)
    target = target[live]
    x = windows(p["e"], block)[live]
    h, rows_, z, own, total = forward(p, v, x, target, noise)
    own /= total
    loss = -np.log(np.maximum(own, 1e-30)).sum()
    z /= total[:, None]
    place = v.is_head[target]
    at, tail = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
    z[at, place[at]] -= 1
    t = target[tail]
    miss = (own[tail] - 1)[:, None]
    dh = z @ p["u"][rows_]
    dh[tail] += miss * p["u"][t]
    dh *= 1 - h * h
    du = np.concatenate([z.T @ h, miss * h[tail]])
    db = np.concatenate([z.sum(axis=0), miss[:, 0]])[:, None]
    where = np.concatenate([rows_.astype(np.uint16), t])
    u = summed(where, np.concatenate([du, db], axis=1))
    # what each word gets from the windows that it is in: they are next to each other
    n = block.shape[1] - 2 * SIDE
    dx = np.zeros((block.shape[0] * n, 2 * SIDE * WIDTH), dh.dtype)
    dx[live] = dh @ p["w"].T
    dx = dx.reshape(block.shape[0], n, 2 * SIDE, WIDTH)
    de = np.zeros((*block.shape, WIDTH), dh.dtype)
    for k, d in enumerate(SIDES):
        de[:, SIDE + d : SIDE + d + n] += dx[:, :, k]
    return float(loss), {"u": (u[0], u[1][:, :-1]), "b": (u[0], u[1][:, -1:]), "e": summed(block.ravel(), de.reshape(-1, WIDTH)), "w": x.T @ dh, "c": dh.sum(axis=0)[None]}


def step(p: dict, seen: dict, v: Vocabulary, block: np.ndarray, noise: np.ndarray) -> float:
    """One Adagrad step on a batch, with a rate for each row of a table, of the rows that it touches."""
    loss, every = gradients(p, v, block, noise)
    for k, g in every.items():
        at, g = g if k in BY_ROW else (slice(None), g)
        now = seen[k][at] + np.einsum("ij,ij->i", g, g) / g.shape[1]
        seen[k][at] = now
        p[k][at] -= g * (RATE / np.sqrt(now))[:, None]
    return loss


def fit(p: dict, v: Vocabulary, line: np.ndarray, seed: int) -> dict[str, np.ndarray]:
    """p after one pass over a line. A batch takes runs at even distances, so that it holds words of many texts."""
    p = {k: x.copy() for k, x in p.items()}
    seen = {k: np.ones(len(x), np.float32) for k, x in p.items()}
    runs = -(-(len(line) - 2 * SIDE) // RUN)
    line = np.append(line, np.full(runs * RUN + 2 * SIDE - len(line), BEYOND, np.uint16))
    every = -(-runs // RUNS)
    rng = np.random.default_rng([SEED, seed])
    for s in range(every):
        step(p, seen, v, line[np.arange(s, runs, every)[:, None] * RUN + np.arange(RUN + 2 * SIDE)], v.noise(rng, NOISE))
    return p


def flat(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, s = {}, 0
    for k, shape in SHAPES.items():
        out[k] = flat[s : s + math.prod(shape)].reshape(shape)
        s += math.prod(shape)
    return out


def weights(n: np.ndarray) -> np.ndarray:
    """What each parameter of a fit to n targets by row weighs: its row's targets and one, all targets for the others."""
    by = {"e": np.append(n, n.sum())[:, None] + 1, "u": n[:, None] + 1, "b": n[:, None] + 1}
    return np.concatenate([np.broadcast_to(by[k] if k in by else n.sum() + 1, s).ravel() for k, s in SHAPES.items()])


class Read:
    """The words of a group: their 48 bits, the text of each, and the words of each text. Texts are read in the order of
    their hashes, which any layout gives (equal ones are alike), PIECE at a time."""

    def __init__(self, group: pa.Table):
        self.group = group.sort_by([("order", "ascending")])
        parts = [Words(self.group.slice(at, PIECE), lower=True) for at in range(0, group.num_rows, PIECE)]
        none = np.empty(0, np.int64)
        self.h = np.concatenate([none.astype(np.uint64), *(w.hash for w in parts)]) & BITS48
        self.text = np.concatenate([none, *(w.text + k * PIECE for k, w in enumerate(parts))])
        self.count = np.concatenate([none, *(w.count for w in parts)])


def in_buckets(bucket: np.ndarray, more: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by bucket, the same for the same input, and the bounds of the buckets in it. more: numbers that sort a bucket."""
    bits = np.uint64(64 - max(1, buckets - 1).bit_length())
    order = np.argsort((bucket << bits) | (more >> (np.uint64(64) - bits)))
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts x, where distinct values begin in it, how often each occurs, and which of them each x is."""
    order = np.argsort(x)
    ordered = x[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(x)]
    first = np.flatnonzero(new)
    which = np.empty(len(x), np.int64)
    which[order] = np.cumsum(new) - 1
    return order, first, np.diff(np.append(first, len(x))), which


def word_keys(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words, by bucket: hashes, counts, the bounds of the buckets, and of each word its place in that list."""
    order, first, count, which = distinct(h)
    keys = h[order[first]]
    by, ends = in_buckets((keys >> np.uint64(24)) % np.uint64(buckets), keys << np.uint64(16), buckets)
    return keys[by], count[by].astype(np.uint32), ends, turned(by)[which]


def turned(order: np.ndarray) -> np.ndarray:
    """Where each number stands in an order."""
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = h * MIX
    h ^= h >> np.uint64(32)
    h *= MIX
    h ^= h >> np.uint64(29)
    return h


def context_keys(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word a hash of its neighbours (none beyond the text), and 48 bits that hold 32 of it and 16 of the word."""
    before, after = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64)
    if len(h) > 1:
        same = text[1:] == text[:-1]
        before[1:] = h[:-1] * same
        after[:-1] = h[1:] * same
    c = mixed(before * np.uint64(3) + mixed(after))
    return c, ((c & np.uint64(0xFFFFFFFF)) << np.uint64(16)) | (h >> np.uint64(32))


def asked_contexts(h: np.ndarray, text: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct contexts with words of each text, by bucket: their 48 bits, the bounds of the buckets, and of each word
    its place in that list."""
    c, key = context_keys(h, text)
    # told apart by text, by a hash of all three
    every = mixed(key + c * M1) + mixed(text.astype(np.uint64) + np.uint64(1))
    order, first, _, which = distinct(every)
    at = order[first]
    by, ends = in_buckets((c[at] >> np.uint64(32)) % np.uint64(buckets), every[at], buckets)
    return key[at][by], ends, turned(by)[which]


def six(x: np.ndarray) -> np.ndarray:
    """The low 48 bits of numbers, six bytes each."""
    return np.ascontiguousarray(x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :6])


def eight(column: pa.ChunkedArray) -> np.ndarray:
    """The numbers of blobs of six()."""
    packed = blob(column, np.uint8).reshape(-1, 6)
    out = np.zeros((len(packed), 8), np.uint8)
    out[:, :6] = packed
    return out.view("<u8").ravel()


ASKED = pa.schema([("bucket", pa.int64()), ("g", pa.int64()), ("key", pa.binary()), ("n", pa.binary())])
ASKED_SQL = "bucket long, g long, key binary, n binary"
SAID = pa.schema([("bucket", pa.int64()), ("g", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
SAID_SQL = "bucket long, g long, a binary, b binary"


def ask_words(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        h, c, ends, _ = word_keys(Read(group).h, buckets)
        g, h = group["g"][0].as_py(), six(h)
        return rows([(b, g, h[s:e].tobytes(), c[s:e].tobytes()) for b, (s, e) in enumerate(zip(ends, ends[1:], strict=False)) if e > s], ASKED)

    return run


def tell_words(group: pa.Table) -> pa.Table:
    """The logarithms of the counts in the whole corpus of the words that each group has asked for. g of -1 holds what the
    vocabulary needs of the bucket's words: the OWN most frequent with their counts, and, g of -2, the counts of shared rows."""
    h, c = eight(group["key"]), blob(group["n"], np.uint32)
    known, at = np.unique(h, return_inverse=True)
    n = np.bincount(at, c, len(known)).astype(np.int64)
    top = np.lexsort((known, -n))[:OWN]
    shared = np.bincount(known // SLOTS % SHARED, n, SHARED).astype(np.int64)
    bucket, s = group["bucket"][0].as_py(), 0
    out = [(bucket, -1, known[top].tobytes(), n[top].tobytes()), (bucket, -2, shared.tobytes(), b"")]
    log_n = np.log(n).astype(np.float32)
    for g, key in zip(group["g"].to_pylist(), group["key"].to_pylist(), strict=True):
        e = s + len(key) // 6
        out.append((bucket, g, log_n[at[s:e]].tobytes(), b""))
        s = e
    return rows(out, SAID)


def ask_contexts(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        read = Read(group)
        bits, ends, _ = asked_contexts(read.h, read.text, buckets)
        g = group["g"][0].as_py()
        bits = six(bits)
        return rows([(b, g, bits[s:e].tobytes(), b"") for b, (s, e) in enumerate(zip(ends, ends[1:], strict=False)) if e > s], ASKED)

    return run


def tell_contexts(group: pa.Table) -> pa.Table:
    """Of each entry that a group has sent: how many other entries have its context (b), as far as 16 bits count, and which
    share of those its word too (a)."""
    key = eight(group["key"])
    order = np.argsort(key)
    ordered = key[order]
    a, b = np.empty(len(key), np.float16), np.empty(len(key), np.uint16)

    def others(x: np.ndarray) -> np.ndarray:
        first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        size = np.diff(np.append(first, len(x)))
        return np.repeat(size - 1, size)

    both, context = others(ordered), others(ordered >> np.uint64(16))
    a[order] = both / np.maximum(context, 1)
    b[order] = np.minimum(context, 65535)
    bucket, out, s = group["bucket"][0].as_py(), [], 0
    for g, k in zip(group["g"].to_pylist(), group["key"].to_pylist(), strict=True):
        e = s + len(k) // 6
        out.append((bucket, g, a[s:e].tobytes(), b[s:e].tobytes()))
        s = e
    return rows(out, SAID)


def said(answers: pa.Table, ends: np.ndarray, column: str, kind) -> np.ndarray:
    """A column of the answers, put together in the order of what was asked."""
    out = np.zeros(int(ends[-1]), kind)
    for b, x in zip(answers["bucket"].to_pylist(), answers[column].to_pylist(), strict=True):
        out[ends[b] : ends[b + 1]] = np.frombuffer(x, kind)
    return out


class Corpus:
    """The texts, dealt into groups and shards and written once as a table that is bucketed by shard, so that no pass over
    it shuffles."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        chars, repeats = measured(docs)
        self.shards = chars // (GROUP_CHARS * SHARD_GROUPS) + 1
        self.groups = self.shards * SHARD_GROUPS
        self.tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        #: About six characters are a word; a group has each of its words, a text each of its contexts once.
        self.buckets = 12 + chars // (6 * BUCKET_ENTRIES)
        table = dealt(docs, self.groups, repeats).withColumn("shard", F.pmod("g", F.lit(self.shards))).withColumn("order", F.xxhash64("text"))
        name, self.path = f"siltstone_{uuid.uuid4().hex}", new_path(spark, "texts")
        table.repartition(self.shards, "shard").write.option("compression", "zstd").bucketBy(self.shards, "shard").sortBy("g").option("path", self.path).saveAsTable(name)
        spark.sparkContext._jvm.System.gc()
        self.at = spark.table(name)
        spark.sql(f"DROP TABLE {name}")  # from the catalogue; its files stay, as does what was read of it

    def by_group(self):
        return self.at.groupBy("shard", "g")


def vocabulary(told: DataFrame) -> Vocabulary:
    """From what the buckets have told. The OWN most frequent words of all are among the OWN of each bucket: a top-k."""

    def unpack(batches):
        for b in batches:
            for g, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = np.frombuffer(x, np.int64)
                y = np.frombuffer(y, np.int64) if g == -1 else x
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), g)), pa.array(x if g == -1 else np.arange(len(x))), pa.array(y)], names=["g", "w", "n"])

    counts = told.where("g < 0").select("g", "a", "b").mapInArrow(unpack, "g long, w long, n long")
    top = counts.where("g = -1").orderBy(F.desc("n"), "w").limit(OWN).select("w", "n").collect()
    shared = np.zeros(SHARED, np.int64)
    for r in counts.where("g = -2").groupBy("w").agg(F.sum("n").alias("n")).collect():  # SHARED sums
        shared[r["w"]] = r["n"]
    return Vocabulary([tuple(r) for r in top], shared)


FITTED = "part long, n binary, p binary"


def fitted_row(part: int, n: np.ndarray, flat: np.ndarray) -> pa.Table:
    """Row counts n, by which parameters are averaged, and the parameters."""
    return pa.table({"part": pa.array([part], pa.int64()), "n": pa.array([n.astype(np.int64).tobytes()], pa.binary()), "p": pa.array([flat.astype(np.float32).tobytes()], pa.binary())})


def fit_shard(model, turn: int):
    def run(group: pa.Table) -> pa.Table:
        v, p = model.value
        shard, read = group["shard"][0].as_py(), Read(group)
        line, _ = laid_out(v.rows_of(read.h), read.text)
        p = fit(p, v, line, turn * 1_000_003 + shard) if len(read.h) else p
        return fitted_row(shard, np.bincount(line, minlength=ROWS)[:ROWS], flat(p))

    return run


def add_fits(group: pa.Table) -> pa.Table:
    counts, total, sums = np.zeros(ROWS, np.int64), np.zeros(FLAT), np.zeros(FLAT)
    for n, x in zip(*(group.sort_by("part")[c].to_pylist() for c in ("n", "p")), strict=True):
        n = np.frombuffer(n, np.int64)
        w = weights(n)
        counts, total, sums = counts + n, total + w, sums + w * np.frombuffer(x, np.float32)
    return fitted_row(group["to"][0].as_py(), counts, sums / total)


def train(corpus: Corpus, v: Vocabulary) -> dict[str, np.ndarray]:
    """The parameters after ROUNDS rounds over disjoint parts of the texts, which are all of them together."""
    spark, p = corpus.at.sparkSession, start()
    for turn in range(ROUNDS):
        model = spark.sparkContext.broadcast((v, p))
        part = corpus.at.where((F.col("g") >= turn * corpus.shards) & (F.col("g") < (turn + 1) * corpus.shards))
        fitted = store(part.groupBy("shard").applyInArrow(fit_shard(model, turn), FITTED), "fitted")
        parts = corpus.shards
        while parts > 1:
            parts = -(-parts // 8)
            more = store(fitted.withColumn("to", F.floor(F.col("part") / 8)).groupBy("to").applyInArrow(add_fits, FITTED), "fitted")
            drop(fitted)
            fitted = more
        found = fitted.select("p").collect()  # one row at most: parts are numbered by eights
        drop(fitted)
        if found:
            p = unpacked(np.frombuffer(found[0]["p"], np.float32).copy())
        model.unpersist()
    return p


def score_group(p: dict, v: Vocabulary, group: pa.Table, words: pa.Table, memory: pa.Table, buckets: int) -> pa.Table:
    """Scores of a group's texts, with what the buckets have answered on its words and contexts."""
    read = Read(group)
    _, _, ends, place = word_keys(read.h, buckets)
    log_n = said(words, ends, "a", np.float32)[place]
    _, ends, place = asked_contexts(read.h, read.text, buckets)
    share, seen = said(memory, ends, "a", np.float16)[place].astype(np.float64), said(memory, ends, "b", np.uint16)[place].astype(np.float64)
    ids = v.rows_of(read.h)
    line, at = laid_out(ids, read.text)
    net = target_probs(p, v, line, v.noise(np.random.default_rng(SEED), NOISE))[at] + log_n - np.log(np.maximum(v.n, 1))[ids]
    log_p = np.log((seen * share + np.exp(net)) / (seen + 1))
    sums, known = (np.bincount(read.text, x, len(read.count)) for x in (log_p, seen > 0))
    return pa.table({"id": read.group["id"], "n_words": pa.array(read.count.astype(np.int64)), "log_prob": pa.array(sums), "known": pa.array(known.astype(np.int64))})


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, n_words, log_prob (the sum over its words), mean_log_prob, and memory_share, the share
    of its words whose neighbours other documents have had around a word too.

    A-Z are as a-z. A null or empty text has no words, log_prob 0 and null means; repeated rows are scored (and
    count in training, and in each other's memory) each by themselves; texts of any length are read piece by piece with
    others; an empty table gives no rows; other columns are not read. The same rows in another layout get the same scores, but
    for rows of one id and text that occur over a thousand times."""
    spark = docs.sparkSession
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    corpus = Corpus(picked)
    buckets = corpus.buckets
    asked = corpus.by_group().applyInArrow(ask_words(buckets), ASKED_SQL)
    told = store(asked.repartition(corpus.tasks, "bucket").groupBy("bucket").applyInArrow(tell_words, SAID_SQL), "counts", "zstd")
    v = vocabulary(told)
    p = train(corpus, v)
    asked = corpus.by_group().applyInArrow(ask_contexts(buckets), ASKED_SQL)
    remembered = store(asked.repartition(corpus.tasks, "bucket").groupBy("bucket").applyInArrow(tell_contexts, SAID_SQL), "memory", "zstd")
    model = spark.sparkContext.broadcast((p, v))
    kind = picked.schema["id"].dataType.simpleString()

    none = pa.table({"id": pa.array([], to_arrow_type(picked.schema["id"].dataType)), "n_words": pa.array([], pa.int64()), "log_prob": pa.array([], pa.float64()), "known": pa.array([], pa.int64())})

    def run(shard: pa.Table, answers: pa.Table) -> pa.Table:
        """The groups of a shard, one after the other."""
        out = [none]
        for g in pc.unique(shard["g"]).to_pylist():
            own = answers.filter(pc.equal(answers["g"], g))
            out.append(score_group(*model.value, shard.filter(pc.equal(shard["g"], g)), own.filter(pc.equal(own["kind"], 0)), own.filter(pc.equal(own["kind"], 1)), buckets))
        return pa.concat_tables(out)

    every = told.where("g >= 0").select("g", F.lit(0).alias("kind"), "bucket", "a", "b").unionByName(remembered.select("g", F.lit(1).alias("kind"), "bucket", "a", "b"))
    every = every.withColumn("shard", F.pmod("g", F.lit(corpus.shards)))
    found = corpus.at.groupBy("shard").cogroup(every.groupBy("shard")).applyInArrow(run, f"id {kind}, n_words long, log_prob double, known long")
    mean = lambda x: F.when(F.col("n_words") > 0, F.col(x) / F.col("n_words"))
    return found.select(F.col("id").alias(id_col), "n_words", "log_prob", mean("log_prob").alias("mean_log_prob"), mean("known").alias("memory_share"))


def op4_scoring(spark, sf_dir: str) -> DataFrame:
    from siltstone.llm.common import table

    return score(table(spark, sf_dir, "documents"))
