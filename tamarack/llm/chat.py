"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context, and only
that reply under the loss mask. A conversation that doesn't end with an assistant turn gives
one more example, of all its turns and with nothing trainable, so that no turn is lost.

An example's text is, turn by turn, ``<|im_start|>`` role newline text ``<|im_end|>`` newline.
In roles and texts ``\\`` becomes ``\\\\`` and the characters that begin a control string, ``<`` and
``[``, become ``\\u003c`` and ``\\u005b`` (in roles a newline becomes ``\\u000a`` as well), so no
control string of this or another template can arise from a text, and ``unescape`` undoes it.

Defined cases: null texts and roles are empty ones; rows that share a turn stand in the order
of role, then text; a null turn comes first; a null conv_id is a conversation of its own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"


def escape(text: Column, line: bool = False) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    out = F.replace(F.replace(out, F.lit("<"), F.lit("\\u003c")), F.lit("["), F.lit("\\u005b"))
    return F.replace(out, F.lit("\n"), F.lit("\\u000a")) if line else out


def unescape(text: Column) -> Column:
    def plain(part: Column) -> Column:
        for code, char in (("\\u003c", "<"), ("\\u005b", "["), ("\\u000a", "\n")):
            part = F.replace(part, F.lit(code), F.lit(char))
        return part

    return F.when(
        F.contains(text, F.lit("\\")), F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")
    ).otherwise(text)


def turn_text(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escape(role, line=True), F.lit("\n"), escape(text), F.lit(END))


def expand(conversations: DataFrame) -> DataFrame:
    """``conv_id, example, formatted, loss_start, loss_length``; start counts from 1, in code points.

    The rows of one conversation meet in one task, as its prefixes must; they travel once,
    already escaped, and the prefixes are built there.
    """
    turns = conversations.select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    said = whole.select(
        "conv_id",
        F.transform("turns", lambda t: turn_text(t["role"], t["text"])).alias("said"),
        F.transform("turns", lambda t: F.length(escape(t["text"]))).alias("long"),
        F.transform("turns", lambda t: t["role"] == F.lit(ASSISTANT)).alias("reply"),
    )
    every = F.sequence(F.lit(1), F.size("said"))
    last = lambda i: i == F.size("said")
    made = said.select("*", F.explode(F.filter(every, lambda i: F.element_at("reply", i) | last(i))).alias("example"))
    formatted = F.array_join(F.slice("said", F.lit(1), F.col("example")), "")
    made = made.select(
        "conv_id",
        "example",
        formatted.alias("formatted"),
        F.when(F.element_at("reply", F.col("example")), F.element_at("long", F.col("example"))).alias("loss_length"),
    )
    start = F.length("formatted") - F.lit(len(END)) - F.col("loss_length") + 1
    return made.select(
        "conv_id",
        "example",
        "formatted",
        F.coalesce(start, F.lit(0)).cast("long").alias("loss_start"),
        F.coalesce("loss_length", F.lit(0)).cast("long").alias("loss_length"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted example as ``role newline text`` strings, unescaped."""
    turns = F.slice(F.split(formatted, r"<\|im_start\|>"), F.lit(2), F.greatest(F.size(F.split(formatted, r"<\|im_start\|>")) - 1, F.lit(0)))
    return F.transform(
        turns, lambda t: F.named_struct(
            F.lit("role"), unescape(F.substring_index(t, "\n", 1)),
            F.lit("text"), unescape(F.substring(t, F.instr(t, F.lit("\n")) + 1, F.length(t) - F.instr(t, F.lit("\n")) - F.lit(len(END)))),
        )
    )


def digests(examples: DataFrame) -> DataFrame:
    """One row a conversation, from the examples alone (see ``op10_chat_prefix_targets``)."""
    loss = F.when(F.col("loss_start") > 0, unescape(F.expr("substring(formatted, cast(loss_start as int), cast(loss_length as int))")))
    each = examples.select("conv_id", "example", loss.alias("loss"), F.length("formatted").cast("long").alias("n"), "formatted")
    per = each.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("formatted"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("n").alias("formatted_chars"),
    )
    per = per.withColumn("turns", read_back(F.col("formatted")))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The table's rows and conversation -1, whose texts are made of control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, ASSISTANT, said)], "conv_id long, turn long, role string, text string"
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
