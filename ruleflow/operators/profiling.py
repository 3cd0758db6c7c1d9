"""Table profiles and quality gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def table_profile(df: DataFrame, name: str) -> DataFrame:
    """Shape and column types; counting reads no column."""
    types = ", ".join(f"{column} {kind}" for column, kind in df.dtypes)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("table_name"),
        "n_rows",
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.lit(types).alias("column_types"),
    )


def first_rows(df: DataFrame, order: str, n: int = 3) -> DataFrame:
    return df.orderBy(order).limit(n)


def label_distribution(df: DataFrame, label: str = "rule_violation") -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row per label
    return counts.withColumn("percent", F.round(F.col("n") * 100 / total, 2))


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Counts in descending order, ties by value; missing values are left out."""
    counts = df.dropna(subset=[column]).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    ordered = counts.orderBy(F.desc("n"), column)
    return ordered.limit(top) if top is not None else ordered


def frame_summary(frame: DataFrame) -> DataFrame:
    """Row, source and label counts and empty texts of a training frame, in one pass."""
    return frame.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("source") == "train").alias("train_rows"),
        F.count_if(F.col("source") == "test_examples").alias("example_rows"),
        F.count_if(F.col("rule_violation") == 1).alias("positive_rows"),
        F.count_if(F.col("rule_violation") == 0).alias("negative_rows"),
        F.count_if(F.length("body") == 0).alias("empty_body"),
        F.count_if(F.length("rule") == 0).alias("empty_rule"),
    )


def quality_gates(frame: DataFrame, required: Sequence[str] = ("body", "rule", "rule_violation")) -> DataFrame:
    """Violation counts, and the number of required columns that are missing."""
    missing = len(set(required) - set(frame.columns))
    gates = [F.lit(missing).cast("long").alias("missing_columns")]
    present = [c for c in required if c in frame.columns]
    gates += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in present]
    gates += [F.count_if(F.length(c) == 0).alias(f"empty_{c}") for c in present if c != "rule_violation"]
    if "rule_violation" in present:
        bad = ~F.col("rule_violation").cast("string").isin("0", "1")
        gates.append(F.count_if(bad).alias("bad_label"))
    return frame.agg(*gates)


def manifest(frame: DataFrame, train: DataFrame, test: DataFrame, repeats: int) -> DataFrame:
    """One row describing a run: table sizes, the frame's rows per source, and the copy setting."""
    per_source = frame.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return per_source.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("constructed_training_rows"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("constructed_source_counts"),
    ).withColumns(
        {
            "train_rows": train.agg(F.count(F.lit(1))).scalar(),
            "test_rows": test.agg(F.count(F.lit(1))).scalar(),
            "test_example_repeats": F.lit(repeats),
        }
    )
