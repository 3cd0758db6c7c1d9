"""Prediction files of several models."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleflow.functions.text import to_label
from ruleflow.sources.comments import READ_OPTIONS, require_columns
from ruleflow.storage import path_exists

# The columns that every prediction file has.
PREDICTION_COLUMNS = ("row_id", "rule_violation")


def read_predictions(spark: SparkSession, folder: str, slots: Iterable[int]) -> DataFrame:
    """``slot, row_id, rule_violation`` from those of ``submission<slot>.csv`` that exist; none is an error.

    Every slot is read by itself and its columns go by its own header, so files may differ in the order of
    columns and in extra ones. A file that lacks a column is an error, and so is a folder of part files
    with different headers.
    """
    paths = {slot: f"{folder}/submission{slot}.csv" for slot in slots}
    found = {slot: path for slot, path in paths.items() if path_exists(spark, path)}
    if not found:
        raise FileNotFoundError(f"no prediction file in {folder}")
    return reduce(DataFrame.unionByName, [read_slot(spark, path, slot) for slot, path in found.items()])


def read_slot(spark: SparkSession, path: str, slot: int) -> DataFrame:
    raw = require_columns(spark.read.options(**READ_OPTIONS).csv(path), PREDICTION_COLUMNS, path)
    return raw.select(
        F.lit(slot).alias("slot"),
        F.col("row_id").cast("long").alias("row_id"),
        to_label(F.col("rule_violation")).alias("rule_violation"),
    )
