"""Benchmark decontamination by greedy string tiling.

Seeds of SEED words, found by rolling hash, join a text with the benchmark items that share them.
Equal words are then marked in tiles, the longest match first, none overlapping (running Karp-Rabin
greedy string tiling), so reordered passages count in full. A text is contaminated by an item of which
tiles cover at least COVERED of the words.

The benchmark is the query set: it is taken in blocks of at most BLOCK_WORDS words (a proven bound on what
a task is sent), and each block is matched against all texts. Its size never depends on the texts.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import drop, store

SEED, COVERED, BLOCK_WORDS = 5, 0.8, 2_000_000
TOKEN = re.compile(r"[^\W_]+")
BY, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def rolled(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of the runs of width ids."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = ids[:n].astype(np.uint64) * MIX
    for k in range(1, width):
        out *= BY
        out += ids[k : k + n].astype(np.uint64) * MIX
    return out


class Index:
    """A block of benchmark items: their words as numbers, and where each seed stands.

    Items of fewer words than SEED have seeds of their own length. Seeds of one hash are places in a row of
    (item, position); their words are kept to tell collisions."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.vocab: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
        for item, text in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in tokens(text)], np.int64)
            if len(ids):
                h = rolled(ids, width := min(SEED, len(ids)))
                found[width].append((h, np.full(len(h), len(self.items)), np.arange(len(h))))
                self.items.append((item, ids))
        #: By width: distinct hashes, their words, and the bounds, items and positions of their places.
        self.seeds = {}
        for width, parts in found.items():
            h, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            h, item, at = h[order], item[order], at[order]
            known, first = np.unique(h, return_index=True)
            words = np.stack([self.items[k][1][i : i + width] for k, i in zip(item[first].tolist(), at[first].tolist(), strict=True)])
            self.seeds[width] = known, words, np.append(first, len(h)), item, at

    def matches(self, text: str | None, covered: float = COVERED) -> list[tuple[int, float]]:
        """(item, share of its words that tiles cover) of the items that reach covered."""
        get = self.vocab.get
        doc = np.array([get(w, 0) for w in tokens(text)], np.int64)
        out = []
        for width, (known, words, bounds, item, at) in self.seeds.items():
            h = rolled(doc, width)
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            j = np.flatnonzero(known[place] == h)
            for k in range(width):  # of equal hashes, those of equal words
                j = j[doc[j + k] == words[place[j], k]]
            if not len(j):
                continue
            order = np.argsort(place[j], kind="stable")
            j, which = j[order], place[j][order]
            met, first = np.unique(which, return_index=True)
            ends = np.append(first[1:], len(j))
            where = dict(zip(met.tolist(), zip(first.tolist(), ends.tolist(), strict=True), strict=True))
            every = np.concatenate([np.arange(bounds[m], bounds[m + 1]) for m in met])
            own = np.repeat(met, bounds[met + 1] - bounds[met])
            for k in np.unique(item[every]).tolist():
                mine = item[every] == k
                i, seed = at[every][mine], own[mine]
                name, ids = self.items[k]
                reach = np.zeros(len(ids) + 1, np.int64)
                np.add.at(reach, i, 1)
                np.add.at(reach, i + width, -1)
                # tiles lie inside seeds, so less can't suffice
                if (np.cumsum(reach[:-1]) > 0).sum() >= covered * len(ids):
                    of = {a: j[slice(*where[b])] for a, b in zip(i.tolist(), seed.tolist(), strict=True)}
                    share = tiled(runs(of, width), width, len(ids), len(doc)) / len(ids)
                    if share >= covered:
                        out.append((name, share))
        return sorted(out)


def runs(seeds: dict[int, np.ndarray], width: int) -> np.ndarray:
    """Maximal matches (length, i, j) from seeds: position in the item -> sorted positions in the text.

    Seeds that follow each other on a diagonal are one match. Only the seeds of two positions of the item are held, so
    memory grows with the text and the matches, not with their product."""
    none = np.empty(0, np.int64)
    out, held, start = [np.empty((0, 3), np.int64)], none, none
    for i in range(min(seeds, default=0), max(seeds, default=-1) + 2):
        now = seeds.get(i, none)
        begun = np.full(len(now), i)
        if len(held) and len(now):
            at = np.minimum(np.searchsorted(held, now - 1), len(held) - 1)
            goes_on = held[at] == now - 1
            begun[goes_on] = start[at[goes_on]]
        at = np.minimum(np.searchsorted(now, held + 1), max(len(now) - 1, 0))
        over = (now[at] != held + 1) if len(now) else np.ones(len(held), bool)
        n = i - 1 - start[over] + width
        out.append(np.stack([n, start[over], held[over] - (i - 1 - start[over])], axis=1))
        held, start = now, begun
    return np.concatenate(out)


def tiled(found: np.ndarray, width: int, n: int, n_text: int) -> int:
    """Words of an item of n words that greedy string tiling marks, from maximal matches. The longest goes first, ties by
    place; what is already marked is cut off, and the rest waits its turn. Ends once no stretch of the item is left that could
    hold a tile."""
    found = found[np.lexsort((found[:, 2], found[:, 1], -found[:, 0]))]
    in_item, in_text, marked, at, cut = bytearray(n), bytearray(n_text), 0, 0, []
    whole = bytes(width)
    while (at < len(found) or cut) and in_item.find(whole) >= 0:
        nearest = (-int(found[at, 0]), int(found[at, 1]), int(found[at, 2])) if at < len(found) else None
        if nearest is None or (cut and cut[0] < nearest):
            length, i, j = heapq.heappop(cut)
        else:
            length, i, j = nearest
            at += 1
        length = -length
        if in_item.find(1, i, i + length) < 0 and in_text.find(1, j, j + length) < 0:
            marked += length
            in_item[i : i + length] = in_text[j : j + length] = b"\1" * length
            continue
        start = None
        for k in range(length + 1):
            ok = k < length and not in_item[i + k] and not in_text[j + k]
            if ok and start is None:
                start = k
            elif not ok and start is not None:
                if k - start >= width:
                    heapq.heappush(cut, (start - k, i + start, j + start))
                start = None
    return marked


def blocks(benchmark: DataFrame, id_col: str, text_col: str, words: int | None = None):
    """The benchmark in lists of (id, text) of at most words words, one item at least. Items stream to the
    driver a partition at a time; no more than a block and a partition are held."""
    words = BLOCK_WORDS if words is None else words
    block, held = [], 0
    for row in benchmark.select(F.col(id_col).cast("long"), text_col).toLocalIterator():
        n = len(tokens(row[1]))
        if block and held + n > words:
            yield block
            block, held = [], 0
        block.append((row[0], row[1]))
        held += n
    if block:
        yield block


def find_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", covered: float = COVERED) -> DataFrame:
    """One row per row of docs that covers an item: its id, item_ids (sorted), best_item (least
    id of the greatest coverage), coverage and contaminated (true).

    Words are letters and digits, lower-cased. Null and empty texts match nothing, items without words
    match nothing, items under SEED words must occur whole; repeated rows and ids are each matched by themselves, whatever the
    number of blocks; memory grows with the longest text, not with its product with an item; empty tables give no
    rows; other columns are not read."""
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.array().cast("array<struct<item: long, coverage: double>>").alias("found"))
    every = waiting = None
    for block in blocks(benchmark, item_col, item_text_col):
        if every is not None:
            # more than one block: the rows wait in a table, so that a task holds one block's index
            now = store(every, "matched")
            if waiting is not None:
                drop(waiting)
            waiting = picked = now
        every = picked.mapInArrow(matching(docs.sparkSession.sparkContext.broadcast(block), covered), picked.schema)
    out = (picked if every is None else every).where(F.size("found") > 0).select("id", "found")
    best = F.array_max(F.transform("found", lambda x: F.struct(x["coverage"].alias("c"), (-x["item"]).alias("i"))))
    return out.select(
        F.col("id").alias(id_col), F.array_sort(F.array_distinct(F.transform("found", lambda x: x["item"]))).alias("item_ids"), (-best["i"]).alias("best_item"), best["c"].alias("coverage"), F.lit(True).alias("contaminated")
    )


def matching(shared, covered: float):
    """Adds a block's matches to the column found of rows (id, text, found)."""

    def run(batches):
        index = Index(shared.value)
        for b in batches:
            new = [[{"item": i, "coverage": c} for i, c in index.matches(x.as_py(), covered)] for x in b.column(1)]
            if any(new):
                found = [[*old, *more] for old, more in zip(b.column(2).to_pylist(), new, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, b.schema.field(2).type)], schema=b.schema)
            else:
                yield b

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", covered: float = COVERED) -> DataFrame:
    """The rows of docs, all columns of any name, that cover no benchmark item: a filter for each block, no shuffle. Each row is
    judged by itself, repeated ones too; nulls, empty texts and empty tables are as in find_contaminated()."""
    at = docs.columns.index(text_col)
    for n, block in enumerate(blocks(benchmark, item_col, item_text_col)):
        if n:
            docs = store(docs, "clean")
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            index = Index(shared.value)
            for b in batches:
                yield b.filter(pa.array([not index.matches(x.as_py(), covered) for x in b.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    from siltstone.llm.common import table

    return find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
