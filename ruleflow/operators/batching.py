"""Length-ordered batches and round-robin shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleflow.functions import sequences as S
from ruleflow.operators.positions import hash_positions, range_positions
from ruleflow.storage import materialize


def length_batches(
    df: DataFrame, length: str, batch_size: int, max_length: int, row_id: str = "row_id", descending: bool = False,
    digits: int = 3,
) -> DataFrame:
    """Adds ``capped_length``, ``position`` and ``batch_id`` for runs of similar length.

    Equal lengths are ordered by a digest of the id. Many rows share the capped length, so that digest
    also splits them over buckets. ``df`` should hold ids and lengths only; texts can be joined later. A
    NULL length is 0. ``digits`` as in ``hash_positions``.
    """
    capped = F.least(F.coalesce(F.col(length), F.lit(0)), F.lit(max_length))
    keyed = df.withColumns({"capped_length": capped, "_key": F.md5(F.col(row_id).cast("string"))})
    keyed = keyed.withColumn("_rank", -F.col("capped_length") if descending else F.col("capped_length"))
    placed = hash_positions(keyed, "_key", leading=["_rank"], digits=digits)
    return placed.withColumn("batch_id", F.floor(F.col("position") / batch_size)).drop("_key", "_rank", "group_rows")


def with_batch_width(df: DataFrame, length: str = "capped_length") -> DataFrame:
    """Longest sequence of each batch; a batch holds a few rows only."""
    return df.withColumn("width", F.max(length).over(Window.partitionBy("batch_id")))


def batch_sequences(
    df: DataFrame, ids: str, batch_size: int, max_length: int, row_id: str = "row_id", descending: bool = False
) -> DataFrame:
    """``df`` with ``batch_id`` and ``width``.

    The sequences are stored once, so whatever made them runs once; batches are formed on the stored ids
    and lengths. A NULL sequence is an empty one. A NULL id is an error, as its row could not be found again.
    """
    known = F.when(F.col(row_id).isNull(), F.raise_error(F.lit(f"{row_id} is NULL")).cast("boolean")).otherwise(True)
    empty = F.array().cast(df.schema[ids].dataType)
    df = materialize(df.filter(known).withColumn(ids, F.coalesce(F.col(ids), empty)), "sequences")
    lengths = df.select(row_id, F.size(ids).alias("length"))
    batches = with_batch_width(length_batches(lengths, "length", batch_size, max_length, row_id, descending))
    return df.join(batches.select(row_id, "batch_id", "width"), row_id)


def pad_left(df: DataFrame, ids: str, labels: str | None = None) -> DataFrame:
    """Left padding to the batch width, with mask and position ids."""
    ids_col, width = F.col(ids), F.col("width")
    columns = {
        "attention_mask": S.pad_left(S.ones(ids_col), width, 0),
        "position_ids": S.left_position_ids(ids_col, width),
        "padded_ids": S.pad_left(ids_col, width, S.PAD_ID),
    }
    if labels is not None:
        columns["padded_labels"] = S.pad_left(F.col(labels), width, S.IGNORED)
    return df.withColumns(columns)


def pad_right(df: DataFrame, ids: str, multiple: int = 8) -> DataFrame:
    """Right padding to the batch width rounded up to a multiple, with its mask."""
    rounded = df.withColumn("width", S.round_up(F.col("width"), multiple))
    ids_col, width = F.col(ids), F.col("width")
    return rounded.withColumns(
        {
            "attention_mask": S.pad_right(S.ones(ids_col), width, 0),
            "padded_ids": S.pad_right(ids_col, width, S.PAD_ID),
        }
    )


def padding_report(df: DataFrame, length: str = "capped_length") -> DataFrame:
    """Tokens, and padded tokens with batches in length order (``batch_id``) and in id order (``row_batch_id``)."""

    def padded(batch: str) -> DataFrame:
        sizes = df.groupBy(batch).agg(F.max(length).alias("width"), F.count(F.lit(1)).alias("n"))
        return sizes.agg(F.sum(F.col("width") * F.col("n")))

    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(length).alias("tokens")).withColumns(
        {
            "padded_sorted": padded("batch_id").scalar(),
            "padded_unsorted": padded("row_batch_id").scalar(),
        }
    )


def row_order_batches(df: DataFrame, batch_size: int, row_id: str = "row_id") -> DataFrame:
    """``row_batch_id`` for batches taken in id order."""
    placed = range_positions(df, [row_id])
    return placed.withColumn("row_batch_id", F.floor(F.col("position") / batch_size)).drop("position", "group_rows")


def round_robin(df: DataFrame, world: int, row_id: str = "row_id") -> DataFrame:
    """Dense index in id order, and the shard that takes every ``world``-th row."""
    placed = range_positions(df, [row_id])
    return (
        placed.withColumn("shard", (F.col("position") % world).cast("int"))
        .withColumn("shard_position", F.floor(F.col("position") / world))
        .drop("group_rows")
    )
