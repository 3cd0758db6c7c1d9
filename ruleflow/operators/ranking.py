"""Average-rank normalisation inside each rule."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleflow.operators.joins import join_counted
from ruleflow.operators.positions import range_totals


def _usable(score: str) -> Column:
    return F.col(score).isNotNull() & ~F.isnan(score)


def rank_within(
    df: DataFrame,
    score: str = "rule_violation",
    group: list[str] | None = None,
    out: str = "rank_score",
    row_key: list[str] | None = None,
) -> DataFrame:
    """Average rank scaled to [0, 1] inside each group; singletons get 0.

    NULL and NaN scores and NULL groups get NULL, but the rows count in the group's size. One plan for
    groups of any size and any number of ties: equal scores collapse to one counted row, those rows
    get their running count over stored range partitions, and the ranks go back by a join that splits
    scores with very many rows and spreads rows that can have no rank. ``row_key`` tells rows of equal
    score apart. The input is read three times, so hand in a stored table, not an unscored model plan.
    """
    group, row_key = group or ["rule"], row_key or ["row_id"]
    keys = [*group, score]
    counted = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .dropna(subset=group)
        .withColumn("_missing", ~_usable(score))
    )
    totals = range_totals(counted, ["_missing", score], ["n"], group)
    before = F.col("n_before") + (F.col("n") - 1) / 2
    scaled = before / F.greatest(F.col("n_total") - 1, F.lit(1))
    ranks = totals.filter(~F.col("_missing")).select(*keys, "n", scaled.alias(out))
    unranked = reduce(or_, [F.col(name).isNull() for name in group], ~_usable(score))
    return join_counted(df, ranks, keys, "n", row_key, unmatched=unranked)
