"""Running totals and dense positions that never put a whole group into one task.

A window over ``partitionBy(rule)`` holds a rule in one task, and there are few rules. Here the order
is first cut into buckets. Rows are ordered inside a bucket only, the bucket totals (one row per group
and bucket) are summed up ahead of each bucket, and both are added.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleflow.storage import materialize


def bucketed_totals(
    df: DataFrame, order: Sequence[str], values: Sequence[str], bucket: Sequence[str], group: Sequence[str] = ()
) -> DataFrame:
    """Adds ``<v>_before`` (sum over earlier rows of the group) and ``<v>_total`` for each value column.

    ``bucket`` columns must sort like ``order`` and must be the same on every evaluation: derived from
    the row, or stored. The exchange for the in-bucket window also serves the join with the totals.
    """
    place = [*group, *bucket]
    earlier = Window.partitionBy(*place).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*group)
    ahead = across.orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)

    sums = df.groupBy(*place).agg(*[F.sum(v).alias(f"_{v}_sum") for v in values])
    offsets = sums.select(
        *place,
        *[F.coalesce(F.sum(f"_{v}_sum").over(ahead), F.lit(0)).alias(f"_{v}_ahead") for v in values],
        *[F.sum(f"_{v}_sum").over(across).alias(f"{v}_total") for v in values],
    )
    inside = df.withColumns({f"_{v}_inside": F.coalesce(F.sum(v).over(earlier), F.lit(0)) for v in values})
    # Null-safe, as a NULL group or bucket is a group like any other.
    named = offsets.withColumnsRenamed({name: f"_of_{name}" for name in place})
    same = reduce(and_, [F.col(name).eqNullSafe(F.col(f"_of_{name}")) for name in place])
    joined = inside.join(named, same).drop(*[f"_of_{name}" for name in place])
    helpers = [name for v in values for name in (f"_{v}_inside", f"_{v}_ahead")]
    return joined.withColumns(
        {f"{v}_before": F.col(f"_{v}_inside") + F.col(f"_{v}_ahead") for v in values}
    ).drop(*helpers)


def hash_positions(
    df: DataFrame, key: str, group: Sequence[str] = (), leading: Sequence[str] = (), digits: int = 3
) -> DataFrame:
    """Adds the 0-based ``position`` in (leading, key) order inside the group, and ``group_rows``.

    ``key`` is a hexadecimal digest, unique per row. Its first ``digits`` digits are the bucket: 4,096
    even buckets per group at the default, whatever the group's size. With ``leading`` columns of few
    values (a capped length) there are that many buckets per value. The bucket totals of a group, not
    its rows, meet in one task; take more ``digits`` for groups of many billions. NULL groups are a
    group, NULL keys come first. ``df`` is stored once, as buckets and totals are both made from it, so
    hand in ids and keys, not texts.
    """
    marked = materialize(df, "positions").withColumns({"_bucket": F.substring(key, 1, digits), "_one": F.lit(1).cast("long")})
    counted = bucketed_totals(marked, [*leading, key], ["_one"], [*leading, "_bucket"], group)
    return counted.withColumnsRenamed({"_one_before": "position", "_one_total": "group_rows"}).drop("_bucket", "_one")


def range_totals(df: DataFrame, order: Sequence[str], values: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """``bucketed_totals`` for an order of any type; the order must be unique inside the group.

    Range partitions are the buckets. Their bounds come from a sample, so the partition number is
    written down once with the rows: two evaluations of the same plan could choose other bounds.
    """
    spread = df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id())
    stored = materialize(spread, "range")
    return bucketed_totals(stored, order, values, ["_part"], group).drop("_part")


def range_positions(df: DataFrame, order: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """0-based ``position`` by a unique order inside the group, and ``group_rows``."""
    counted = range_totals(df.withColumn("_one", F.lit(1).cast("long")), order, ["_one"], group)
    return counted.withColumnsRenamed({"_one_before": "position", "_one_total": "group_rows"}).drop("_one")
