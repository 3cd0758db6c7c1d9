"""Weighted blending of several models' predictions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Blend weights per prediction slot.
DEFAULT_WEIGHTS = {1: 0.20, 2: 0.20, 3: 0.20, 4: 0.20, 5: 0.10, 6: 0.10, 7: 0.10}
RAW_WEIGHTS = {1: 0.2, 2: 0.2, 3: 0.2, 4: 0.2, 5: 0.2, 7: 0.1}
RAW_WEIGHTS_SEVEN = {1: 0.25, 2: 0.25, 3: 0.2, 4: 0.15, 5: 0.1, 6: 0.1, 7: 0.1}


def weight_of(slot: Column, weights: Mapping[int, float]) -> Column:
    pairs = [F.lit(x) for pair in weights.items() for x in pair]
    return F.create_map(*pairs)[slot]


def slots_per_id(predictions: DataFrame, score: str = "rule_violation") -> DataFrame:
    """``row_id, slot, rows, value``: the rows of an id in a slot and the sum of their scores (NULL if one is).

    Partitioned by the id alone, so that a following aggregation by id needs no second exchange.
    """
    together = predictions.select("slot", "row_id", score).repartition("row_id")
    whole = F.count(score) == F.count(F.lit(1))
    return together.groupBy("row_id", "slot").agg(
        F.count(F.lit(1)).alias("rows"), F.when(whole, F.sum(score)).alias("value")
    )


def blend(
    predictions: DataFrame,
    weights: Mapping[int, float] = DEFAULT_WEIGHTS,
    normalize: bool = True,
    score: str = "rule_violation",
) -> DataFrame:
    """``row_id`` and the weighted sum over all slots present, in one shuffle for any number of slots.

    Ids missing from a slot drop out. An id that a slot holds twice is an error. A NULL score makes
    the id's result NULL. With ``normalize`` the weights of the present slots are scaled to sum 1.
    Slots are any whole numbers.
    """
    used = predictions.filter(F.col("slot").isin(*weights))
    # At most one entry per weight; both scalars come from one pass.
    found = used.agg(F.collect_set(F.struct("slot", weight_of(F.col("slot"), weights).alias("w"))).alias("present"))
    total = F.aggregate("present", F.lit(0.0), lambda sum_, slot: sum_ + slot["w"])
    present = found.select(F.struct(total.alias("weight"), F.size("present").alias("slots"))).scalar()
    scale = present["weight"] if normalize else F.lit(1.0)

    twice = F.raise_error(F.concat(F.lit("more than one prediction in a slot for row_id "), F.col("row_id").cast("string")))
    per_id = slots_per_id(used, score).groupBy("row_id").agg(
        F.sum(weight_of(F.col("slot"), weights) * F.col("value")).alias("total"),
        F.count(F.lit(1)).alias("slots"),
        F.count("value").alias("scored"),
        F.max("rows").alias("most"),
    )
    aligned = F.when(F.col("most") > 1, twice.cast("boolean")).otherwise(F.col("slots") == present["slots"])
    return per_id.filter(aligned).select(
        "row_id", F.when(F.col("scored") == F.col("slots"), F.col("total") / scale).alias("rule_violation")
    )
