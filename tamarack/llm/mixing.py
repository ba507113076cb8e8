"""Mixing sources to target weights by capped water-filling.

Every source gets a share of ``budget`` times all words in proportion to its weight,
clamped at ``max_epochs`` times its own words; what a clamp frees is shared again by
weight until no target is above its clamp. A document is then repeated ``whole`` times
(the whole epochs of its source) and, once more, if its seeded draw lies below its source's
cut; the one document on the cut is taken in part, so a source's words meet its target.

Nothing sorts a source: the cut is found from sums over 256 ranges of the draw, then over
256 ranges inside the one that holds the cut, then over the few rows of that last range.

Defined cases: a null text has size 0 and a null source is a source of its own, last in
order; equal rows draw alike and share what the cut leaves (rounded down); an empty table
gives an empty result; a source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import guarded, keep, packed, unpacked, word_count

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
_BITS = 60


def draw(seed: str) -> Column:
    """A 60-bit seeded draw of the row's id and text."""
    said = F.concat(
        F.lit(f"{seed}|"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
        F.lit("|"),
        F.coalesce(F.col("text"), F.lit("")),
    )
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, _BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget=BUDGET, max_epochs=MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, size``; one row a source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("w", F.get(listed, (F.row_number().over(by_name) - 1) % len(weights)))
    per = per.withColumn("cap", F.col("source_size") * F.lit(max_epochs))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    all_rows = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (
        per.withColumn("total", F.sum("source_size").over(all_rows) * F.lit(float(budget)))
        .withColumn("before", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap"))
        .withColumn("rest", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("rest"))
        .withColumn("clamped", F.col("cap") / F.col("w") <= F.col("level"))
        .withColumn("level", F.max(F.when(~F.col("clamped"), F.col("level"))).over(all_rows))
    )
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("w"))
    return per.select("source", "source_size", target.alias("target"))


def _crossing(sums: DataFrame, step: str) -> DataFrame:
    """Of each source's ranges of the draw, the one in which the running sum passes ``left``."""
    run = Window.partitionBy("source_key").orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        sums.withColumn("upto", F.sum("words").over(run))
        .where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("words") <= F.col("left")))
        .select("source_key", step, (F.col("left") - (F.col("upto") - F.col("words"))).alias("left"))
    )


def _key(source: Column) -> Column:
    """A join key that keeps null apart from every text."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def plan(sizes: DataFrame, weights=WEIGHTS, budget=BUDGET, max_epochs=MAX_EPOCHS) -> DataFrame:
    """One row a source: ``source_key, source_size, target, whole, cut, on_cut``.

    ``sizes`` has ``source, size, draw``. Rows whose draw is below ``cut`` are taken once
    more; rows at it take ``on_cut`` words each.
    """
    per = source_targets(sizes, weights, budget, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    per = per.withColumn("whole", whole.cast("long")).withColumn(
        "left", F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size")
    )
    full = (F.col("left") >= F.col("source_size")) & (F.col("left") > 0)
    per = per.withColumn("whole", F.col("whole") + full.cast("long")).withColumn("left", F.when(full, 0).otherwise(F.col("left")).cast("long"))
    per = keep(per.withColumn("source_key", _key(F.col("source"))).drop("source"), "mix-sources")
    n = per.count()
    rows = sizes.where("size > 0").select(_key(F.col("source")).alias("source_key"), "size", "draw")
    rows = rows.join(guarded(per.where("left > 0").select("source_key", "left"), n), "source_key")
    first = F.shiftright("draw", _BITS - 8)
    a = rows.groupBy("source_key", "left", first.alias("a")).agg(F.sum("size").alias("words"))
    a = keep(_crossing(a, "a"), "mix-range")
    rows = rows.drop("left").withColumn("a", first).join(guarded(a, n), ["source_key", "a"])
    second = F.shiftright("draw", _BITS - 16)
    b = rows.groupBy("source_key", "left", second.alias("b")).agg(F.sum("size").alias("words"))
    b = _crossing(b, "b")
    rows = rows.drop("left", "a").withColumn("b", second).join(guarded(b, n), ["source_key", "b"])
    c = rows.groupBy("source_key", "left", "draw").agg(F.sum("size").alias("words"), F.count("*").alias("same"))
    same = c.select("source_key", "draw", "same")
    cut = _crossing(c, "draw").join(same, ["source_key", "draw"])
    cut = cut.select("source_key", F.col("draw").alias("cut"), F.floor(F.col("left") / F.col("same")).cast("long").alias("on_cut"))
    return per.drop("left").join(cut, "source_key", "left")


def measured(docs: DataFrame, seed: str = SEED) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw(seed).alias("draw"))


def taken(sizes: DataFrame, weights=WEIGHTS, budget=BUDGET, max_epochs=MAX_EPOCHS) -> DataFrame:
    """``sizes`` (``doc_id, source, size, draw``) with source_size, target and taken."""
    per = keep(plan(sizes, weights, budget, max_epochs), "mix-plan")
    out = sizes.withColumn("source_key", _key(F.col("source"))).join(guarded(per, per.count()), "source_key")
    return out.withColumn("part", _part()).withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))


def _part() -> Column:
    """Words of the fractional repetition that this row takes."""
    return (
        F.when(F.col("draw") < F.col("cut"), F.col("size"))
        .when(F.col("draw") == F.col("cut"), F.least(F.col("on_cut"), F.col("size")))
        .otherwise(F.lit(0).cast("long"))
    )


def mix(docs: DataFrame, weights=WEIGHTS, budget=BUDGET, max_epochs=MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mixed documents themselves: each text once a repetition, all columns kept.

    A partly taken document gives its first ``part`` words as the last repetition. ``docs``
    is read twice: once for sizes, once for texts.
    """
    names = docs.columns
    sizes = keep(measured(docs, seed), "mix-sizes")
    per = keep(plan(sizes, weights, budget, max_epochs), "mix-plan")
    got = docs.select(
        packed(names), _key(F.col("source")).alias("source_key"), word_count(F.col("text")).alias("size"), draw(seed).alias("draw")
    )
    got = got.join(guarded(per, per.count()), "source_key").withColumn("part", _part())
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("whole") + (F.col("part") > 0).cast("long")).cast("int")
    turns = F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))
    got = got.select("row", "size", "whole", "part", F.explode(turns).alias("nth"))
    cut_short = (F.col("nth") > F.col("whole")) & (F.col("part") < F.col("size"))
    bare = F.regexp_replace("row.text", r"^[\x20\x09-\x0D]+", "")
    words = F.split(bare, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    head = F.array_join(F.slice(words, 1, F.greatest(F.col("part"), F.lit(1)).cast("int")), "")
    text = F.when(cut_short, head).otherwise(F.col("row.text"))
    return got.select(*unpacked(names, text=text))
