"""Quality rules: word, line and repetition counts, and compression bands.

Zstandard ratios (compressed / plain bytes) of the whole text and of fixed chunks reject repetitive
text (ratio too low) and incompressible text (ratio too high), by limits that depend on the length:
short texts hardly compress, so their bands lie higher and are wider. The last chunk is shorter than the others and is
judged by the limits of its own length.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import WORD

SYMBOLS = frozenset("#*$%&|<>")
#: Bytes of a chunk, and of the shortest last one that is judged.
CHUNK_BYTES, LEAST_CHUNK = 1024, 128
#: (bytes, least ratio, greatest ratio); between two lengths the limits are interpolated along the length's logarithm, below the
#: first there are none, beyond the last they stay. They were set a little outside of the ratios of the prose labelled good in
#: 20,598 labelled texts of the check tool's small table, none of which they reject.
BANDS = (
    (64, 0.600, 1.40),
    (128, 0.680, 1.15),
    (256, 0.600, 0.92),
    (512, 0.535, 0.80),
    (1024, 0.487, 0.68),
    (2048, 0.458, 0.60),
    (4096, 0.434, 0.54),
    (8192, 0.418, 0.50),
    (16384, 0.404, 0.475),
    (32768, 0.390, 0.46),
    (65536, 0.378, 0.45),
    (131072, 0.370, 0.45),
)
#: The share of a text's judged bytes in chunks outside their band from which it is rejected.
CHUNK_SHARE = 0.5

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, bad_chunks double, base_failed boolean, kept boolean"


def repeat_words(words: list[str]) -> int:
    """Words that lie in a 5-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    found, total, upto = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if found[w] > 1:
            total += i + 5 - max(i, upto)
            upto = i + 5
    return total


def band(n: int) -> tuple[float, float]:
    """The least and greatest ratio of n bytes."""
    if n < BANDS[0][0]:
        return 0.0, math.inf
    for (a, low, high), (b, low2, high2) in itertools.pairwise(BANDS):
        if n < b:
            t = math.log(n / a) / math.log(b / a)
            return low + t * (low2 - low), high + t * (high2 - high)
    return BANDS[-1][1:]


def measure(text: str | None, squeeze=None) -> tuple:
    """The values of FIELDS for one text; a null text has no words."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeats = repeat_words(words)
    raw = text.encode("utf-8", "replace")
    squeeze = squeeze or zstandard.ZstdCompressor(level=3).compress
    outside = lambda part: not (limits := band(len(part)))[0] <= len(squeeze(part)) / len(part) <= limits[1]
    ratio = len(squeeze(raw)) / len(raw) if raw else None
    low, high = band(len(raw))
    chunks = [x for i in range(0, len(raw), CHUNK_BYTES) if len(x := raw[i : i + CHUNK_BYTES]) >= LEAST_CHUNK]
    judged = sum(map(len, chunks))
    bad = sum(len(x) for x in chunks if outside(x)) / judged if judged else 0.0
    failed = n < 10 or 100 * repeats > 20 * n
    kept = not failed and low <= ratio <= high and bad < CHUNK_SHARE
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, ratio, bad, failed, kept


def _run(batches: Iterator[pa.RecordBatch], text: int, schema: pa.Schema, rows_only: bool) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        found = [measure(x.as_py(), squeeze) for x in batch.column(text)]
        if rows_only:
            yield batch.filter(pa.array([x[-1] for x in found], pa.bool_()))
        else:
            columns = [pa.array(c, schema.field(i + 1).type) for i, c in enumerate(zip(*found, strict=True))] if found else [pa.array([], f.type) for f in list(schema)[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema.field(0).type), *columns], schema=schema)


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id and FIELDS.

    Needs no shuffle: each text is read once in Arrow batches. A null or empty text has no words and
    fails; repeated rows and ids are judged each by themselves; an empty table gives no rows; other
    columns are not read. ratio is null for an empty text; bad_chunks is the share of bytes in chunks outside their band. A text of any
    length is judged whole, chunk after chunk."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fields = picked.schema["id"].dataType.simpleString()
    out = f"`{id_col}` {fields}, {FIELDS}"
    schema = to_arrow_schema(_parse_datatype_string(out))
    return picked.mapInArrow(lambda it: _run(it, 1, schema, False), out)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns of any name, that every rule keeps: null and empty texts go, repeated rows are judged each by
    themselves, an empty table gives no rows."""
    at = docs.columns.index(text_col)
    return docs.mapInArrow(lambda it: _run(it, at, None, True), docs.schema)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    from siltstone.llm.common import table

    return assess(table(spark, sf_dir, "documents"))
