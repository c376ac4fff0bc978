"""Substring dedup by difference-cover anchors.

A cover of the residues modulo PERIOD holds, for any two positions, an offset below PERIOD that takes
both into the cover. So two equal runs of WINDOW words share an anchor: a run of
WINDOW - PERIOD + 1 words that begins at a cover position of both texts. Only cover positions are
hashed; where an anchor is found in two documents, it is extended to the windows around it, which are
compared by 96 bits of two independent rolling hashes.

Texts are dealt into groups by a hash of id and text, written once as a bucketed table, and read from
there without a shuffle. A group sends each distinct hash once, packed by hash bucket, whatever the
number of its copies; answers come back packed by group. A passage that a third of all documents
hold costs one entry for each group, and no pairs are formed.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import new_path, store
from siltstone.llm.words import M1, M2, Words, blob, dealt, measured, member, rolled, rows

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
GROUP_CHARS, BUCKET_ENTRIES = 512_000, 1_000_000


def at_cover(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Cover positions of texts with a window, and the hashes of their anchors."""
    place = (np.arange(len(words.text)) - words.first[words.text]) % PERIOD
    ok = words.inside(ANCHOR)
    ok &= (np.isin(place, COVER) & (words.count[words.text] >= WINDOW))[: len(ok)]
    at = np.flatnonzero(ok)
    return at, rolled(words.hash, ANCHOR, M1)[at]


def windows_near(words: Words, shared: np.ndarray) -> np.ndarray:
    """Positions of the windows that hold a shared anchor at a cover position."""
    ok = words.inside(WINDOW)
    at, own = at_cover(words)
    at = at[member(own, shared)[0]]
    mark = np.zeros(len(ok), bool)
    for p in range(PERIOD):
        begin = at - p
        mark[begin[(begin >= 0) & (begin < len(ok))]] = True
    return np.flatnonzero(mark & ok)


def two_hashes(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return rolled(words, WINDOW, M1)[at], (rolled(words ^ (words >> np.uint64(31)), WINDOW, M2)[at] >> np.uint64(32)).astype(np.uint32)


def packs(g: int, key: np.ndarray, buckets: int, *columns: np.ndarray) -> list[tuple]:
    """Rows (bucket, g, blob of key, blobs of columns), each in the order of key."""
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((key, bucket))
    found, first = np.unique(bucket[order], return_index=True)
    cut = [*first, len(order)]
    return [(int(b), g, *(c[order[s:e]].tobytes() for c in (key, *columns))) for b, s, e in zip(found, cut, cut[1:], strict=False)]


def least_and_many(keys: tuple, ids: np.ndarray) -> tuple:
    """Distinct keys (arrays, the first is most significant), the least id of each, and whether it has several."""
    order = np.lexsort((ids, *keys[::-1]))
    keys, ids = tuple(k[order] for k in keys), ids[order]
    new = np.ones(len(ids), bool)
    if len(ids):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ids)) - 1 if len(ids) else first
    return tuple(k[first] for k in keys), ids[first], ids[last] > ids[first]


SENT = pa.schema([("bucket", pa.int64()), ("g", pa.int64()), ("h", pa.binary()), ("h2", pa.binary()), ("id", pa.binary()), ("many", pa.binary())])
SENT_SQL = "bucket long, g long, h binary, h2 binary, id binary, many binary"
BACK = pa.schema([("g", pa.int64()), ("h", pa.binary()), ("h2", pa.binary()), ("id", pa.binary())])
BACK_SQL = "g long, h binary, h2 binary, id binary"


def send_anchors(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        words = Words(group)
        at, h = at_cover(words)
        (h,), _, many = least_and_many((h,), words.ids[words.text[at]])
        return rows([(b, g, x, b"", b"", y) for b, g, x, y in packs(group["g"][0].as_py(), h, buckets, many)] if len(h) else [], SENT)

    return run


def answer_anchors(group: pa.Table) -> pa.Table:
    every, many = blob(group["h"], np.uint64), blob(group["many"], np.bool_)
    found, count = np.unique(np.concatenate([every, every[many]]), return_counts=True)
    shared = found[count > 1]
    out = []
    for g, h in zip(group["g"].to_pylist(), group["h"].to_pylist(), strict=True):
        own = np.frombuffer(h, np.uint64)
        own = own[member(own, shared)[0]]
        if len(own):
            out.append((g, own.tobytes(), b"", b""))
    return rows(out, BACK)


def send_windows(buckets: int):
    def run(group: pa.Table, shared: pa.Table) -> pa.Table:
        if not shared.num_rows or not group.num_rows:
            return rows([], SENT)
        words = Words(group)
        at = windows_near(words, np.unique(blob(shared["h"], np.uint64)))
        (h, h2), least, many = least_and_many(two_hashes(words.hash, at), words.ids[words.text[at]])
        return rows(packs(group["g"][0].as_py(), h, buckets, h2, least, many) if len(h) else [], SENT)

    return run


def answer_windows(group: pa.Table) -> pa.Table:
    h, h2, ids = blob(group["h"], np.uint64), blob(group["h2"], np.uint32), blob(group["id"], np.int64)
    order = np.lexsort((h2, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    least = np.empty(len(h), np.int64)
    least[order] = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    wanted = (least < ids) | blob(group["many"], np.bool_)
    out, start = [], 0
    for g, x in zip(group["g"].to_pylist(), group["h"].to_pylist(), strict=True):
        at = start + np.flatnonzero(wanted[start : start + len(x) // 8])
        start += len(x) // 8
        if len(at):
            out.append((g, h[at].tobytes(), h2[at].tobytes(), least[at].tobytes()))
    return rows(out, BACK)


KEPT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def covered(words: Words, known: pa.Table) -> np.ndarray:
    """Which words a window covers that starts in a text with a smaller id."""
    h, h2, least = blob(known["h"], np.uint64), blob(known["h2"], np.uint32), blob(known["id"], np.int64)
    gone = np.zeros(len(words.text) + 1, np.int64)
    ok = words.inside(WINDOW)
    if len(h) and len(ok):
        order = np.lexsort((h2, h))
        h, h2, least = h[order], h2[order], least[order]
        starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        most = int(np.diff(np.append(starts, len(h))).max())
        hit = np.flatnonzero(member(rolled(words.hash, WINDOW, M1), h)[0] & ok)
        a, b = two_hashes(words.hash, hit)
        at, found = np.searchsorted(h, a), np.zeros(len(hit), bool)
        for step in range(most):  # entries that share the first hash
            p = np.minimum(at + step, len(h) - 1)
            found |= (h[p] == a) & (h2[p] == b) & (least[p] < words.ids[words.text[hit]])
        gone[hit[found]] += 1
        np.subtract.at(gone, hit[found] + WINDOW, 1)
    return np.cumsum(gone[:-1]) > 0


def cut(digest: bool):
    def run(group: pa.Table, known: pa.Table) -> pa.Table:
        if not group.num_rows:
            return rows([], KEPT)
        words = Words(group)
        kept = ~covered(words, known)
        start, length = words.start[kept], (words.end - words.start)[kept] + 1
        upto = np.cumsum(length)
        source = np.arange(length.sum()) + np.repeat(start - (upto - length), length)
        source[upto - 1] = 0  # the place of the space behind each word
        joined = words.data[source] if len(source) else np.empty(0, np.uint8)
        joined[upto - 1] = 32
        n_kept = np.bincount(words.text[kept], minlength=len(words.ids))
        last = np.cumsum(n_kept)
        edge = np.append(0, upto)
        out = []
        for i, n, k, e in zip(group["id"].to_pylist(), words.count.tolist(), n_kept.tolist(), last.tolist(), strict=True):
            text = joined[edge[e - k] : max(edge[e] - 1, edge[e - k])].tobytes()
            out.append((i, n, n - k, hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8")))
        return rows(out, KEPT)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per row of docs: its id, n_words, n_removed and kept, the words left, joined by one
    space (or their SHA-256 with digest).

    A word goes if a window of 13 words over it also starts in a row with a smaller id. A null text
    has no words; texts under 13 words stay whole; rows of one id never remove each other's words;
    a null id counts as larger than any; an empty table gives no rows; other columns are not read. A text of any
    length is read whole by its task."""
    spark = docs.sparkSession
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    chars, repeats = measured(picked)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups, buckets = max(2 * tasks, chars // GROUP_CHARS + 1), max(tasks, chars * 3 // (PERIOD * 6 * BUCKET_ENTRIES))
    files = max(tasks, groups // 32)
    name = f"siltstone_{uuid.uuid4().hex}"
    path = new_path(spark, "texts")
    dealt(picked, groups, repeats).repartition(files, "g").write.option("compression", "zstd").bucketBy(files, "g").option("path", path).saveAsTable(name)
    spark.sparkContext._jvm.System.gc()
    at = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # from the catalogue; its files stay, as does what was read of it
    sent = at.groupBy("g").applyInArrow(send_anchors(buckets), SENT_SQL)
    shared = store(sent.groupBy("bucket").applyInArrow(answer_anchors, BACK_SQL), "anchors")
    sent = at.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(lambda a, b: send_windows(buckets)(a, b), SENT_SQL)
    known = store(sent.groupBy("bucket").applyInArrow(answer_windows, BACK_SQL), "windows")
    out = at.groupBy("g").cogroup(known.groupBy("g")).applyInArrow(lambda a, b: cut(digest)(a, b), "id long, n_words long, n_removed long, kept string")
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept")


def op8_substrings(spark, sf_dir: str) -> DataFrame:
    from siltstone.llm.common import table

    return remove_repeats(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")
