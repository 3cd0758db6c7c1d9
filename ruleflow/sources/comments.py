"""Comment files: CSV scan, column contract, text column and row ids."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ruleflow.functions.text import na_to_null

# Required columns, and the names a text column may have, in order of preference.
TRAIN_COLUMNS = ("body", "rule", "rule_violation")
TEST_COLUMNS = (
    "row_id", "body", "rule",
    "positive_example_1", "positive_example_2", "negative_example_1", "negative_example_2",
)
TEXT_NAMES = ("body", "comment", "text")

CSV_OPTIONS = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
# The escaping option defaults to the NUL character for this quoting, which would lose NULs before a quote. Files of
# one folder with different headers are an error; otherwise their columns would shift.
READ_OPTIONS = {**CSV_OPTIONS, "charToEscapeQuoteEscaping": '"', "enforceSchema": "false"}


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Iterable[str], name: str) -> DataFrame:
    """Fail on the schema alone, before any row is read."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"{name} lacks required columns: {missing}")
    return df


def read_comments(
    spark: SparkSession,
    path: str,
    required: Iterable[str] = (),
    types: Mapping[str, str] | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """CSV with a header and quoted line breaks; missing-value texts become NULL.

    Columns go by header name and stay strings unless ``types`` names a type. Quoted line breaks make a
    file one split, so large inputs should come as many files; ``multi_line=False`` splits inside files.
    """
    raw = spark.read.options(**READ_OPTIONS).csv(path, multiLine=multi_line)
    require_columns(raw, required, path)
    casts = types or {}
    return raw.select(
        *[na_to_null(F.col(f"`{c}`")).cast(casts.get(c, "string")).alias(c) for c in raw.columns]
    )


def resolve_text_column(df: DataFrame, names: Iterable[str] = TEXT_NAMES) -> DataFrame:
    """Rename the first of ``names`` that exists to ``body``; a ``rule`` column must exist too."""
    found = next((n for n in names if n in df.columns), None)
    if found is None:
        raise KeyError(f"no text column among {df.columns}")
    if "rule" not in df.columns:
        raise KeyError("no rule column")
    return df.withColumnRenamed(found, "body")


def dense_row_ids(df: DataFrame) -> DataFrame:
    """Adds ``row_id`` 0..n-1 in file order; ``df`` must be a plain file scan.

    Rows of one file block follow each other in one task, so their running number only has to be
    shifted by the rows of earlier blocks; nothing is sorted. The blocks' table is joined back, by
    broadcast while Spark finds it small, else by block, and blocks are of even size.
    """
    block = ["_file", "_block"]
    numbered = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seen"),
    )
    blocks = numbered.groupBy(*block).agg(F.min("_seen").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    # One row per file block, so a single ordered window over them is small.
    earlier = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_start", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    return (
        numbered.join(starts, block)
        .withColumn("row_id", F.col("_start") + F.col("_seen") - F.col("_first"))
        .drop(*block, "_seen", "_first", "_start")
    )


def ensure_row_id(df: DataFrame) -> DataFrame:
    return df if "row_id" in df.columns else dense_row_ids(df)
