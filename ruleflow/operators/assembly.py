"""Reshape, union, dedupe, oversample, seeded order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Source names, example columns and the columns that make a row of the frame.
TRAIN, EXAMPLES = "train", "test_examples"
EXAMPLE_COLUMNS = ("positive_example_1", "positive_example_2", "negative_example_1", "negative_example_2")
FRAME_KEY = ("body", "rule", "rule_violation", "source")


def tag_source(df: DataFrame, source: str = TRAIN) -> DataFrame:
    return df.select("body", "rule", "rule_violation", F.lit(source).alias("source"))


def unpivot_examples(test: DataFrame) -> DataFrame:
    """Each example column becomes rows labelled by its polarity; the scored comment itself is not read."""
    return (
        test.unpivot(["rule"], list(EXAMPLE_COLUMNS), "example", "body")
        .select(
            "body",
            "rule",
            F.when(F.startswith("example", F.lit("positive")), 1).otherwise(0).alias("rule_violation"),
            F.lit(EXAMPLES).alias("source"),
        )
    )


def dedupe(df: DataFrame) -> DataFrame:
    """Exact row dedupe. All columns are keys, so copies already collapse before the shuffle."""
    return df.distinct()


def oversample(df: DataFrame, repeats: int, source: str = EXAMPLES) -> DataFrame:
    """``repeats`` copies of the rows from ``source``, one of every other row; adds ``copy_no``."""
    if repeats < 1:
        raise ValueError("repeats must be at least 1")
    copies = F.when(F.col("source") == source, F.lit(repeats)).otherwise(F.lit(1))
    return df.select("*", F.explode(F.sequence(F.lit(1), copies)).alias("copy_no"))


def order_key(seed: int, columns: Sequence[str]) -> Column:
    """A pseudo-random order that depends on the row's content and the seed only, not on partitioning."""
    fields = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *fields))


def with_order_key(df: DataFrame, seed: int, columns: Sequence[str] = (*FRAME_KEY, "copy_no")) -> DataFrame:
    return df.withColumn("shuffle_key", order_key(seed, columns))


def seeded_shuffle(df: DataFrame, seed: int, columns: Sequence[str] = (*FRAME_KEY, "copy_no")) -> DataFrame:
    return with_order_key(df, seed, columns).orderBy("shuffle_key")


def balanced_sample(df: DataFrame, rows: int, label: str = "rule_violation", key: str = "shuffle_key") -> DataFrame:
    """The first ``max(1, rows // 2)`` rows of each label in seeded order.

    The rank filter is pushed below the exchange, so each task sends at most that many rows per label.
    """
    per_label = max(1, rows // 2)
    place = F.row_number().over(Window.partitionBy(label).orderBy(key))
    return df.withColumn("place", place).filter(F.col("place") <= per_label).drop("place")
