"""The corpus pipeline: quality rules, near-dedup, decontamination, personal data, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents; the last
one adds size, source_size, target and taken, and leaves out the rows of which the mix takes nothing.

Every stage judges row by row, whatever the ids: a null id is as any other, rows of one id are told apart. A null text is an
empty one, which the quality rules reject; of repeated rows near-dedup keeps one; a table without rows gives none; further columns
pass through under any name. Texts are read whole at any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import store, table
from siltstone.llm.decontaminate import drop_contaminated
from siltstone.llm.mixing import mix
from siltstone.llm.pii import redact
from siltstone.llm.quality import keep_good
from siltstone.llm.simhash import keep_first


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every quality rule keeps."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the smallest id: a Jaccard similarity of 0.8 over shingles of
    five words, of candidates that four fingerprints find."""
    return keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, with how many; columns of docs that are named as those are replaced. Every row
    is told by a number of its own, so null and repeated ids are no trouble."""
    more = ["size", "source_size", "target", "taken"]
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in more))
    rows = store(docs.select(whole.alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    taken = mix(rows.select("doc.doc_id", "doc.text", "doc.source", "row"), also=("row",)).where(F.col("taken") > 0).select("row", *more)
    return rows.join(taken, "row").select("doc.*", *more)


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontaminate), ("pii", personal_data), ("mixing", mixing)]
#: The fingerprints' and tiles' stages are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
