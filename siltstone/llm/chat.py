"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log row is (conversation, sequence, operation, message, role, text). Operations:
message starts a message with a text, delta appends to it (and starts it if there is none), edit
replaces its text, regenerate clears it and drops the messages that had followed it until then.
Logs are partitioned by conversation, sorted by sequence and folded with window functions: one
shuffle serves every step. Then turns are rendered between control strings, with the spans that a
loss covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"


def escape_text(text: Column) -> Column:
    """One backslash more between each "<" and "|", so that no text holds a control string."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """Percent signs, line feeds and "<", so that a role stays on its line."""
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def fold(log: DataFrame) -> DataFrame:
    """log (conv_id, seq, op, msg, role, text) -> final messages (conv_id, at, role, text), at being
    their order.

    Rows of one sequence number are ordered by operation, message, role and text, nulls last, so reruns agree.
    A null msg makes a message of the row alone. Null roles and texts are empty. A null conv_id is
    a conversation as any other; an empty log has no messages; other columns are not read. A conversation of any length is one task's,
    and its texts are joined whole."""
    kinds = F.array_position(F.array(*map(F.lit, ("message", "regenerate", "edit", "delta"))), F.col("op"))
    conv = Window.partitionBy("conv_id")
    order = conv.orderBy(F.col("seq").asc_nulls_last(), kinds, F.col("msg").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    rows = log.select("conv_id", "seq", "op", "msg", "role", "text").withColumn("n", F.row_number().over(order)).withColumn("own", F.when(F.col("msg").isNull(), F.col("n")))
    message = Window.partitionBy("conv_id", "msg", "own")
    rows = (
        rows.withColumn("reset", F.max(F.when(F.col("op") != "delta", F.col("n"))).over(message))
        .withColumn("at", F.min("n").over(message))
        .withColumn("redone", F.max(F.when(F.col("op") == "regenerate", F.col("n"))).over(message))
        .withColumn("said", F.first("role", ignorenulls=True).over(message.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .where("n >= coalesce(reset, 0)")
    )
    part = F.struct("n", F.when(F.col("op") == "regenerate", "").otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    folded = rows.groupBy("conv_id", "at").agg(
        F.first("said").alias("role"), F.first("redone").alias("redone"), F.array_sort(F.collect_list(part)).alias("parts")
    )
    before = conv.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return (
        folded.withColumn("dropped", F.coalesce(F.max("redone").over(before) > F.col("at"), F.lit(False)))
        .where("not dropped")
        .select("conv_id", "at", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """messages (conv_id, at, role, text) -> (conv_id, formatted, loss): the whole conversation as one
    text, and the spans (start, end; code points) of it that hold the texts of loss_role."""
    conv = Window.partitionBy("conv_id").orderBy("at")
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    turns = (
        messages.select("conv_id", "at", "role", head.alias("head"), escape_text(F.col("text")).alias("body"))
        .withColumn("turn", F.concat("head", "body", F.lit(END + "\n")))
        .withColumn("end", F.sum(F.length("turn").cast("long")).over(conv) - len(END) - 1)
        .withColumn("span", F.when(F.col("role") == loss_role, F.struct((F.col("end") - F.length("body")).alias("start"), "end")))
    )
    both = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "turn"))).alias("turns"), F.array_sort(F.collect_list("span")).alias("loss"))
    return both.select("conv_id", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), "loss")


def format_chats(log: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """fold() and render(): one row (conv_id, formatted, loss) per conversation with a message."""
    return render(fold(log), loss_role)


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    turns = F.split(formatted, r"\Q" + END + r"\E\n", -1)
    inside = F.transform(F.slice(turns, F.lit(1), F.size(turns) - 1), lambda t: F.substr(t, F.lit(len(START) + 1)))
    return F.transform(
        inside,
        lambda t: F.struct(
            unescape_role(F.substring_index(t, "\n", 1)).alias("role"), unescape_text(F.substr(t, F.position(F.lit("\n"), t) + 1)).alias("text")
        ),
    )


def as_events(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text), the finished turns of conversations, as the log (conv_id, seq, op, msg, role, text) of a
    chat that ends with them: an assistant's text is a draft that is regenerated and then streamed as two deltas, any other is
    begun with its first half and then edited. Rows of one turn are told apart by their place."""
    text, order = F.coalesce("text", F.lit("")), Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    half = F.floor(F.length(text) / 2).cast("int")
    start, end = F.substr(text, F.lit(1), half), F.substr(text, half + 1)
    event = lambda k, op, role, text: F.struct(F.lit(k).alias("k"), F.lit(op).alias("op"), role.alias("role"), text.alias("text"))
    none, own = F.lit(None).cast("string"), F.col("role")
    streamed = F.array(event(0, "message", own, F.concat(F.lit("draft: "), end)), event(1, "regenerate", none, none), event(2, "delta", none, start), event(3, "delta", none, end))
    edited = F.array(event(0, "message", own, start), event(1, "edit", none, text))
    each = rows.withColumn("msg", F.row_number().over(order).cast("long")).select("conv_id", "msg", F.explode(F.when(own == "assistant", streamed).otherwise(edited)).alias("e"))
    return each.select("conv_id", (F.col("msg") * 4 + F.col("e.k")).alias("seq"), "e.op", "msg", "e.role", "e.text")


def op3_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations, from the log of events that leads to each."""
    from siltstone.llm.common import table

    said = END + START + "assistant ok"
    columns = ("conv_id", "turn", "role", "text")
    rows = table(spark, sf_dir, "conversations").select(*columns)
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    out = format_chats(as_events(rows.unionByName(extra))).withColumn("turns", read_back(F.col("formatted")))
    masked = F.array_join(F.transform("loss", lambda s: unescape_text(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return out.withColumn("masked", masked).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
