"""Words of many texts at once as numpy arrays, and the packing of numbers that groups and buckets exchange."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_ID = np.iinfo(np.int64).max
#: Multipliers of two rolling hashes, and of the last mix.
M1, M2, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: A random number for each byte, and the same with A-Z as a-z.
BYTES = np.random.default_rng(0).integers(0, 2**64, 256, np.uint64)
LOWERED = BYTES[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]
#: Bytes of a piece of text, for which powers are held.
PIECE = 1 << 20


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n powers of M1 and of its inverse, modulo 2^64."""
    inverse = np.uint64(pow(int(M1), -1, 2**64))
    return tuple(np.cumprod(np.append(np.uint64(1), np.full(n - 1, x, np.uint64)), dtype=np.uint64) for x in (M1, inverse))


class Words:
    """The words of a group of texts, straight from the bytes of the column: where each starts and ends,
    its text and its hash (with lower, of the word with A-Z as a-z). ids are the texts' ids, NO_ID for null."""

    def __init__(self, group: pa.Table, lower: bool = False):
        text = pa.concat_arrays([c.cast(pa.large_string()).fill_null("") for c in group["text"].chunks]) if group.num_rows else pa.array([], pa.large_string())
        ids = group["id"].combine_chunks() if group.num_rows else pa.array([], pa.int64())
        self.ids = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
        buffers = text.buffers()
        offsets = np.frombuffer(buffers[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.empty(0, np.uint8)
        self.data = data[: offsets[-1]]
        plain = np.zeros(len(self.data) + 1, bool)
        np.logical_not(SPACE[self.data], out=plain[:-1])
        begins = np.zeros(len(self.data) + 1, bool)
        begins[offsets] = True
        starts = plain.copy()
        starts[1:] &= ~plain[:-1] | begins[1:]
        ends = plain.copy()
        ends[:-1] &= ~plain[1:] | begins[1:]
        starts[: offsets[0]] = ends[: offsets[0]] = False
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.text, np.arange(len(text)))
        self.count = np.diff(np.append(self.first, len(self.text)))
        self.hash = self._hash(LOWERED if lower else BYTES)

    def _hash(self, numbers: np.ndarray) -> np.ndarray:
        """Per word, the sum of its bytes' numbers times powers by their place in it; taken from running
        sums over pieces of the text that end with a word."""
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(out):
            base = self.start[at]
            stop = max(at + 1, int(np.searchsorted(self.end, base + PIECE, "right")))
            piece = self.data[base : self.end[stop - 1]]
            up, down = powers(max(PIECE, 1 << (len(piece) - 1).bit_length()))
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(numbers[piece] * up[: len(piece)], dtype=np.uint64, out=sums[1:])
            s, e = self.start[at:stop] - base, self.end[at:stop] - base
            out[at:stop] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
            at = stop
        out ^= out >> np.uint64(32)
        out *= MIX
        out ^= out >> np.uint64(29)
        return out

    def inside(self, width: int) -> np.ndarray:
        """Which runs of width words lie in one text."""
        n = len(self.text) - width + 1
        return self.text[:n] == self.text[width - 1 :] if n > 0 else np.empty(0, bool)


def rolled(words: np.ndarray, width: int, by: np.uint64) -> np.ndarray:
    """A hash of each run of width words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, width):
        out *= by
        out += words[k : k + n]
    out ^= out >> np.uint64(33)
    out *= MIX
    out ^= out >> np.uint64(29)
    return out


def member(x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of x lie in the sorted array, and where."""
    if not len(of):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(of, x), len(of) - 1)
    return of[at] == x, at


def blob(col: pa.ChunkedArray, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in col.to_pylist()] or [np.empty(0, kind)])


def rows(found: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table({f.name: pa.array([r[i] for r in found], f.type) for i, f in enumerate(schema)}, schema=schema)


#: Rows of one id and text beyond this many are told apart by a salt.
REPEATS = 1000


def measured(docs: DataFrame, most: int = REPEATS) -> tuple[int, DataFrame | None]:
    """The characters of docs (id, text), and the hashes (_h, _n) of rows that occur more than most times, None where
    there are no such; one job."""
    counts = docs.groupBy(F.xxhash64("id", "text").alias("_h")).agg(F.count("*").alias("_n"), F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("c"))
    chars, top = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.max("_n")).first()
    return chars, counts.where(F.col("_n") > most).select("_h", "_n") if (top or 0) > most else None


def dealt(docs: DataFrame, groups: int, repeats: DataFrame | None = None, most: int = REPEATS) -> DataFrame:
    """docs (id, text) with a group g below groups, by a hash of both, so that any layout gives the same groups; rows in
    repeats, as measured() finds them, are spread by a salt, else they would all be in one group."""
    hashed = docs.withColumn("_h", F.xxhash64("id", "text"))
    salt = F.lit(0).cast("long")
    if repeats is not None:
        # a row for each most rows of docs at most; beyond a million of them AQE decides
        hashed = hashed.join(F.broadcast(repeats) if repeats.count() <= 1_000_000 else repeats, "_h", "left")
        salt = F.when(F.col("_n").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("_n") / most))).otherwise(salt)
    return hashed.select("id", "text", F.pmod(F.xxhash64("_h", salt), F.lit(groups)).alias("g"))
