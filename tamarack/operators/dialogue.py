"""Conversations: token estimates, budgeted trimming, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions.text import token_estimate

NOTE = "[earlier messages were cut]"


def characters(messages: DataFrame) -> Column:
    """Characters of a message: its text and, if there is such a column, its ``tool_calls`` (JSON
    text); null counts nothing."""
    said = F.length(F.coalesce("text", F.lit("")))
    return said + F.length(F.coalesce("tool_calls", F.lit(""))) if "tool_calls" in messages.columns else said


def estimate(messages: DataFrame) -> DataFrame:
    """``conv_id, tokens``: of all its messages' characters together, tool calls included."""
    return messages.groupBy("conv_id").agg(token_estimate(F.sum(characters(messages))).alias("tokens"))


def trim(messages: DataFrame, budget: int, note: str = NOTE) -> DataFrame:
    """``conv_id, turn, role, text``: the system head, a note if anything is dropped, and the
    longest run of last messages within the budget, without tool results at its start.

    A message costs its text and its ``tool_calls``, if that column is there. The note stands half a turn before the first message kept (turn is therefore a double).

    Defined cases: a null role is an empty one, a null text an empty one, a null turn comes
    first; messages of one turn go by role, then text, and are kept or cut one by one.
    """
    role, said = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    m = messages.select("conv_id", F.col("turn").cast("double").alias("turn"), role.alias("role"), said.alias("text"), token_estimate(characters(messages)).alias("tok"))
    by = Window.partitionBy("conv_id")
    order = by.orderBy("turn", "role", "text")
    m = m.withColumn("place", F.row_number().over(order))
    m = m.withColumn("is_note", (F.col("role") == "system") & (F.col("text") == note))
    m = m.withColumn("head", (F.col("place") == 1) & (F.col("role") == "system") & ~F.col("is_note"))
    m = m.where(F.col("head") | ~F.col("is_note"))
    m = m.withColumn("base", F.sum(F.when(F.col("head"), F.col("tok")).otherwise(0)).over(by))
    # what is left to the end; the head is counted once, as the base
    after = F.sum(F.when(F.col("head"), 0).otherwise(F.col("tok"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    m = m.withColumn("fits", ~F.col("head") & (after + F.col("base") <= budget))
    real = F.min(F.when(F.col("fits") & (F.col("role") != "tool"), F.col("place"))).over(by)
    m = m.withColumn("stay", F.col("fits") & (F.col("place") >= real))
    m = m.withColumn("stay", F.coalesce("stay", F.lit(False)))
    kept = m.where("head or stay").select("conv_id", "turn", "role", "text")
    lost = m.where("not head").groupBy("conv_id").agg(F.min(F.when(F.col("stay"), F.col("turn"))).alias("first"), F.max("turn").alias("last"), F.count_if(~F.col("stay")).alias("n"))
    notes = lost.where("n > 0").select("conv_id", (F.coalesce(F.col("first"), F.col("last") + 1) - 0.5).alias("turn"), F.lit("system").alias("role"), F.lit(note).alias("text"))
    return kept.unionByName(notes)


def history(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, role, text`` from ``conv_id, turns`` (user and assistant), blanks skipped."""
    rows = conversations.select("conv_id", F.posexplode("turns").alias("i", "t"))
    both = F.array(
        F.struct((F.col("i") * 2).alias("pos"), F.lit("user").alias("role"), F.col("t.user").alias("text")),
        F.struct((F.col("i") * 2 + 1).alias("pos"), F.lit("assistant").alias("role"), F.col("t.assistant").alias("text")),
    )
    return rows.select("conv_id", F.explode(both).alias("m")).select("conv_id", "m.*").where(F.coalesce("text", F.lit("")) != "")


def read_history(spark, path: str) -> DataFrame:
    """Saved histories; a corrupt file is one without turns."""
    schema = "version int, project string, updated_at string, turns array<struct<user:string,assistant:string>>, _corrupt_record string"
    got = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return got.select(F.input_file_name().alias("conv_id"), F.coalesce("turns", F.array().cast("array<struct<user:string,assistant:string>>")).alias("turns"))


def append(histories: DataFrame, said: DataFrame) -> DataFrame:
    """``conv_id, turns`` with the new turns (``conv_id, at, user, assistant``) behind the old
    ones, by ``at``, then text; a conversation without history begins with them. A null conv_id is a conversation too."""
    more = said.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "user", "assistant"))), lambda x: F.struct(x["user"].alias("user"), x["assistant"].alias("assistant"))).alias("more"))
    none = F.array().cast("array<struct<user:string,assistant:string>>")
    more = more.withColumnRenamed("conv_id", "_conv")
    both = histories.select("conv_id", "turns").join(more, F.col("conv_id").eqNullSafe(F.col("_conv")), "full_outer")
    return both.select(F.coalesce("conv_id", "_conv").alias("conv_id"), F.concat(F.coalesce("turns", none), F.coalesce("more", none)).alias("turns"))


def write_history(histories: DataFrame, path: str) -> None:
    """A JSON line a conversation, with version and time of writing, as ``read_saved`` reads it."""
    row = histories.select(F.lit(1).alias("version"), F.col("conv_id").cast("string").alias("project"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("updated_at"), "turns")
    row.write.mode("overwrite").json(path)


def read_saved(spark, path: str) -> DataFrame:
    """``conv_id, turns`` of what ``write_history`` wrote; corrupt lines are left out."""
    got = spark.read.schema("project string, turns array<struct<user:string,assistant:string>>").option("mode", "DROPMALFORMED").json(path)
    return got.where("project is not null").select(F.col("project").alias("conv_id"), F.coalesce("turns", F.array().cast("array<struct<user:string,assistant:string>>")).alias("turns"))


def last_questions(messages: DataFrame, n: int = 20) -> DataFrame:
    """Each conversation's last ``n`` user messages with their place from the first of these."""
    asked = messages.where(F.col("role") == "user")
    w = Window.partitionBy("conv_id")
    last = asked.withColumn("back", F.row_number().over(w.orderBy(F.col("turn").desc()))).where(F.col("back") <= n)
    return last.select("conv_id", "turn", "text", F.row_number().over(w.orderBy("turn")).alias("pos"))
