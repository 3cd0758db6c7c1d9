"""A join back to aggregated keys that does not suffer from keys with very many rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key with more than this share of all rows is split into parts of that share; so at most 10,000 keys are.
SHARE = 10_000


def join_counted(
    rows: DataFrame, counted: DataFrame, keys: Sequence[str], count: str, row_key: Sequence[str],
    unmatched: Column | None = None, share: int = SHARE,
) -> DataFrame:
    """``rows`` left-joined to ``counted``, which has one row per key and the key's row count in ``count``.

    A key with more than ``1 / share`` of all rows gets as many salts as it has such shares: its rows are
    spread over them by a digest of ``row_key``, and its one counted row is copied to each. The list of
    these keys is broadcast; it cannot be longer than ``share``. ``unmatched`` marks rows known to have
    no partner, which are spread over all salts, as they would else meet in one partition.
    """
    total = rows.agg(F.count(F.lit(1))).scalar()
    salts = F.when(F.col(count) * share > total, F.ceil(F.col(count) * share / total)).otherwise(1).cast("int")
    marked = counted.withColumn("_salts", salts)
    hot = marked.filter("_salts > 1").select(*keys, "_salts")
    spread = F.coalesce("_salts", F.lit(1)) if unmatched is None else F.when(unmatched, share).otherwise(F.coalesce("_salts", F.lit(1)))
    salted = (
        rows.join(F.broadcast(hot), list(keys), "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*row_key), spread).cast("int"))
        .drop("_salts")
    )
    copied = marked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts", count)
    return salted.join(copied, [*keys, "_salt"], "left").drop("_salt")
