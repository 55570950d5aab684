"""Mixing sources to target weights, with DataFrame functions only.

Tokens are summed per source, targets and repetition rates follow from the sums, and each document is emitted
floor(rate) times plus once more if its seeded hash falls below the rate's fraction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelsieve.llm.common import count_words, unused


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), max_rate: int = 3) -> DataFrame:
    """Target of each source: its weight's share of all tokens, at most max_rate times its own.

    sizes: (mix_source, mix_size), one row per document. Sources by code point, null last, take the weights in turn.
    What a capped source leaves is shared again by weight. With the sources ordered by cap / weight, the capped ones
    come first, so one ordered pass finds the common level of the others. The table has one row per source.
    """
    total = sizes.groupBy("mix_source").agg(F.sum("mix_size").alias("source_size"))
    by_name, by_ratio = Window.orderBy(F.col("mix_source").asc_nulls_last()), Window.orderBy("ratio", F.col("mix_source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighted = total.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int")).cast("long"))
    cap = F.col("source_size") * F.lit(int(max_rate)).cast("long")
    level = (F.col("all_size") - F.col("cap_before")).cast("double") / F.col("weight_from").cast("double")
    leveled = (
        weighted.withColumn("cap", cap)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("all_size", F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("cap_before", F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap"))
        .withColumn("weight_from", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", level)
        .withColumn("common", F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    target = F.when(F.col("ratio") > F.col("level"), F.col("common") * F.col("weight")).otherwise(F.col("cap").cast("double"))
    return leveled.select("mix_source", "source_size", target.alias("target"))


def unit_hash(column: Column, seed: str) -> Column:
    """A number in [0, 1) from the identifier and the seed; null as the text 'null'."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = (5, 2, 1), max_rate: int = 3, seed: str = "mix") -> DataFrame:
    """The documents with mix_source, mix_size, source_size, target and mix_copies.

    Null text is of size 0; a null source is a source of its own; a source without tokens gets rate 0; repeated rows
    of one identifier get the same copies; an empty table gives an empty result. Other columns pass through, but for those
    named like the results, which are replaced. The table of sources is ordered in one task: its rows, one per source, must
    fit there (millions do).
    """
    key, out_size, out_target = unused(docs, "mix_key", "mix_source_size", "mix_target")
    sized = docs.withColumn("mix_source", F.col(source)).withColumn("mix_size", count_words(F.col(text)))
    targets = source_targets(docs.select(F.col(source).alias("mix_source"), count_words(F.col(text)).alias("mix_size")), weights, max_rate).toDF(key, out_size, out_target)
    # The join is left to Spark: it broadcasts the targets only where their measured size is under its threshold.
    joined = sized.join(targets, F.col("mix_source").eqNullSafe(F.col(key)), "left").drop(key)
    rate = F.when(F.col(out_size) > 0, F.col(out_target) / F.col(out_size)).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    told = joined.withColumn("mix_copies", (whole + (unit_hash(F.col(doc_id), seed) < rate - whole).cast("int")).cast("long"))
    return told.withColumn("source_size", F.col(out_size)).withColumn("target", F.col(out_target)).drop(out_size, out_target)


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = (5, 2, 1), max_rate: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself: each document as often as its plan says, with the columns of `docs`, whatever their names."""
    rows = docs.select(F.col(doc_id).alias("mix_id"), F.col(text).alias("mix_text"), F.col(source).alias("mix_from"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_row"))
    plan = mix_plan(rows, "mix_id", "mix_text", "mix_from", weights, max_rate, seed)
    return plan.filter("mix_copies > 0").select("mix_row", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))).select("mix_row.*")
