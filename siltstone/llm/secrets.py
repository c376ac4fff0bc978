"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds (assign, access, hex) are always reported. Weak candidates say little alone: a long opaque
token (opaque) or the address of a service (endpoint). They are reported only when complementary
parts co-occur within a scope: an opaque token needs an access identifier within SCOPE code points, an
endpoint needs an access identifier or a secret assignment. A scope reaches from where a span begins or ends,
so that parts next to each other are linked however long they are.

Positions come from splitting a text at the matches: the gaps' and matches' lengths, summed up in
order, give each span. Only those lengths leave the scan; one shuffle by row serves the running sums,
the interval join (the greatest end so far and the least start from here on, which form no pairs) and the grouping.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import store

SCOPE = 512
#: kind -> (pattern, least length of its secret part, group of that part)
PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    "access": (r"AKIA[A-Z0-9]+", 18, 0),
    "hex": (r"[0-9a-f]{16,}", 16, 0),
    "opaque": (r"[A-Za-z0-9+/_-]{32,}+", 32, 0),
    "endpoint": (r"https?://[A-Za-z0-9.-]++(?::[0-9]{1,5})?", 11, 0),
}
#: kind -> what its matches have to hold besides
HOLDS = {"opaque": ("[0-9]", "[A-Za-z]")}
BASE = ("assign", "access", "hex")


def pieces(text: Column, kind: str) -> Column:
    """For one pattern, an entry per match in order: kind, index, the gap before it, its length, and
    whether it is long enough and holds what it has to. Matches that do not stay, as the sums need their lengths."""
    pattern, least, group = PATTERNS[kind]
    one = F.lit(pattern)
    hits = F.regexp_extract_all(text, one, F.lit(0))
    gaps = F.split(text, pattern, -1)
    parts = F.regexp_extract_all(text, one, F.lit(group)) if group else hits
    ok = lambda part: reduce(Column.__and__, [F.length(part) >= least, *(F.regexp_like(part, F.lit(p)) for p in HOLDS.get(kind, ()))])
    each = F.transform(
        F.arrays_zip(F.slice(F.transform(gaps, lambda g: F.length(g)), F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"), parts.alias("part")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), F.length(x["hit"]).alias("n"), ok(x["part"]).alias("ok")),
    )
    none = F.array().cast("array<struct<kind:string,i:int,gap:int,n:int,ok:boolean>>")
    return F.when(F.regexp_like(text, one), each).otherwise(none)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of docs: its id and spans, an array of (start, rank, kind, end) sorted by start
    and then as PATTERNS lists the kinds; code points, end exclusive.

    A null or empty text has no spans; repeated rows and ids are told apart by a row number of the
    scan and searched each by themselves; an empty table gives no rows; other columns are not read.
    A row's spans are grouped, never the rows of a key, so no group outgrows one text's matches. A text of any length is searched
    whole, by the JVM's matcher."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("id", F.monotonically_increasing_id().alias("row"), F.concat(*(pieces(text, k) for k in PATTERNS)).alias("found"))
    rows = store(rows, "found")  # which fixes the rows' numbers: a task that runs anew could number them otherwise
    flat = rows.select("id", "row", F.explode_outer("found").alias("x")).select("id", "row", "x.*").repartition("row")
    each = Window.partitionBy("row", "kind").orderBy("i")
    spans = flat.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(each)).withColumn("start", F.col("end") - F.col("n")).where("ok is null or ok")
    order = Window.partitionBy("row")
    before, after = (order.orderBy(by("start")).rangeBetween(Window.unboundedPreceding, 0) for by in (F.asc, F.desc))
    part = lambda kind, bound: F.when(F.col("kind") == kind, F.col(bound))
    with_kind = lambda kind: (F.max(part(kind, "end")).over(before) >= F.col("start") - scope) | (F.min(part(kind, "start")).over(after) <= F.col("end") + scope)
    linked = spans.withColumn("access", with_kind("access")).withColumn("secret", with_kind("assign")).withColumn(
        "out",
        F.col("kind").isin(*BASE) | ((F.col("kind") == "opaque") & F.col("access")) | ((F.col("kind") == "endpoint") & (F.col("access") | F.col("secret"))),
    )
    rank = F.array_position(F.array(*map(F.lit, PATTERNS)), F.col("kind"))
    span = F.when(F.col("out"), F.struct("start", rank.alias("rank"), "kind", "end"))
    return linked.groupBy("row").agg(F.first("id").alias(id_col), F.array_sort(F.collect_list(span)).alias("spans")).drop("row")


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    from siltstone.llm.common import table

    found = find_secrets(table(spark, sf_dir, "documents"))
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(named(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))
