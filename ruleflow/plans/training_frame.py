"""Training frames from labelled comments and from the examples of the rows to score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleflow.operators import assembly, cleaning
from ruleflow.sources.comments import TEST_COLUMNS, TRAIN_COLUMNS, require_columns

# Copies of each unique example and the order seeds.
EXAMPLE_REPEATS = 2
DEFAULT_SEED = 1001
ENCODER_SEED = 3001


def cleaned_frame(train: DataFrame, test: DataFrame, repeats: int = EXAMPLE_REPEATS) -> DataFrame:
    """``body, rule, rule_violation, source, copy_no``: clean, union, dedupe, then copy the examples.

    The source is part of the dedupe key, so one dedupe after the union equals one per source.
    """
    require_columns(train, TRAIN_COLUMNS, "train")
    require_columns(test, TEST_COLUMNS, "test")
    labelled = cleaning.clean_labelled_rows(assembly.tag_source(train))
    examples = cleaning.clean_labelled_rows(assembly.unpivot_examples(test))
    return assembly.oversample(assembly.dedupe(labelled.unionByName(examples)), repeats)


def raw_frame(train: DataFrame, test: DataFrame, repeats: int = EXAMPLE_REPEATS) -> DataFrame:
    """The uncleaned variant: labels stay as read, missing bodies survive, dedupe on the raw rows."""
    as_text = F.col("rule_violation").cast("string")
    labelled = assembly.tag_source(train).withColumn("rule_violation", as_text)
    examples = assembly.unpivot_examples(test).withColumn("rule_violation", as_text)
    return assembly.oversample(assembly.dedupe(labelled.unionByName(examples)), repeats)


def shuffled_frame(frame: DataFrame, seed: int = DEFAULT_SEED) -> DataFrame:
    return assembly.seeded_shuffle(frame, seed)


def smoke_sample(frame: DataFrame, rows: int, seed: int = ENCODER_SEED) -> DataFrame:
    """A small label-balanced sample in seeded order."""
    keyed = assembly.with_order_key(frame, seed)
    return assembly.balanced_sample(keyed, rows).orderBy("shuffle_key")
