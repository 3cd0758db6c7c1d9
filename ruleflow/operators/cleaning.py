"""Row cleaning: text, labels, domain checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleflow.functions.text import clean_text, has_text, to_label

TEXT_COLUMNS = ("body", "rule")


def clean_texts(df: DataFrame, columns: Sequence[str] = TEXT_COLUMNS) -> DataFrame:
    return df.withColumns({c: clean_text(F.col(c)) for c in columns})


def coerce_label(df: DataFrame, column: str = "rule_violation") -> DataFrame:
    return df.withColumn(column, to_label(F.col(column)))


def drop_missing(df: DataFrame, columns: Sequence[str] = (*TEXT_COLUMNS, "rule_violation")) -> DataFrame:
    return df.dropna(subset=list(columns))


def keep_valid(df: DataFrame, columns: Sequence[str] = TEXT_COLUMNS, label: str = "rule_violation") -> DataFrame:
    """Non-empty texts and a 0/1 label, narrowed to one byte."""
    filled = [F.length(c) > 0 for c in columns]
    valid = F.col(label).isin(0, 1)
    for condition in filled:
        valid = valid & condition
    return df.filter(valid).withColumn(label, F.col(label).cast("byte"))


def clean_labelled_rows(df: DataFrame, columns: Sequence[str] = TEXT_COLUMNS) -> DataFrame:
    """Clean, drop missing, keep valid in one: the same rows as the steps above in that order.

    The cheap checks come first and look at the raw texts, so only rows that stay are cleaned, once.
    """
    labelled = coerce_label(df).filter(F.col("rule_violation").isin(0, 1))
    for column in columns:
        labelled = labelled.filter(has_text(F.col(column)))
    return clean_texts(labelled, columns).withColumn("rule_violation", F.col("rule_violation").cast("byte"))
