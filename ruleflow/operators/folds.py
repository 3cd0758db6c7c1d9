"""Fold assignment and class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleflow.operators.assembly import order_key
from ruleflow.operators.positions import hash_positions

# Groups that are dealt out one by one, and classes of all others.
LARGEST_GROUPS, GROUP_CLASSES = 10_000, 4_096


def stratified_folds(
    df: DataFrame, k: int, seed: int, label: str = "label", row_id: str = "row_id", out: str = "fold", digits: int = 3
) -> DataFrame:
    """Deal each label's rows out to ``k`` folds in seeded order, so fold sizes per label differ by at most one.

    Rows with a NULL label are dealt out like a label of their own. ``digits`` as in ``hash_positions``.
    """
    keyed = df.withColumn("_key", order_key(seed, [row_id]))
    placed = hash_positions(keyed, "_key", [label], digits=digits)
    return placed.withColumn(out, (F.col("position") % k).cast("int")).drop("_key", "position", "group_rows")


def group_folds(df: DataFrame, k: int, seed: int, group: str, out: str = "fold") -> DataFrame:
    """Keep every row of a group in the same fold; needs no shuffle."""
    digest = F.conv(F.substring(order_key(seed, [group]), 1, 8), 16, 10).cast("long")
    return df.withColumn(out, (digest % k).cast("int"))


def balanced_group_folds(
    df: DataFrame, k: int, seed: int, group: str, out: str = "fold", largest: int = LARGEST_GROUPS, classes: int = GROUP_CLASSES
) -> DataFrame:
    """Keep every row of a group in the same fold, and the folds of like size: each group, largest first, goes to the smallest fold.

    Only counts go to the driver. The ``largest`` groups are dealt out one by one; those after them, of any number, meet
    in ``classes`` by a digest of their name, and a class is dealt out like a group. So no fold is empty while groups
    suffice, and the largest exceeds the smallest by no more than its last group or class. Equal sizes go by name, equal
    folds by number. Rows without a group are a group of their own.
    """
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.desc("n"), F.asc_nulls_first(group))
    placed = counts.orderBy(F.desc("n"), F.asc_nulls_first(group)).limit(largest)
    units = placed.withColumn("_unit", F.row_number().over(order)).select(F.col(group), "_unit", "n")
    known = {row["_unit"]: row["n"] for row in units.select("_unit", "n").collect()}
    digest = F.pmod(F.xxhash64(F.lit(seed), F.col(group)), F.lit(classes)) + F.lit(largest + 1)
    small = counts.join(F.broadcast(units.select(F.col(group).alias("_large"), "_unit")), F.col(group).eqNullSafe(F.col("_large")), "left")
    rest = small.filter("_unit IS NULL").groupBy(digest.alias("_unit")).agg(F.sum("n").alias("n")).collect()  # at most one row for each class
    known |= {row["_unit"]: row["n"] for row in rest}
    loads, fold_of = [0] * k, {}
    for unit in sorted(known, key=lambda u: (-known[u], u)):
        fold_of[unit] = loads.index(min(loads))
        loads[fold_of[unit]] += known[unit]
    spark = df.sparkSession
    folds = spark.createDataFrame([(int(u), f) for u, f in fold_of.items()], f"_unit long, {out} int")
    named = df.join(F.broadcast(units.select(F.col(group).alias("_large"), "_unit")), F.col(group).eqNullSafe(F.col("_large")), "left")
    dealt = named.withColumn("_unit", F.coalesce(F.col("_unit").cast("long"), digest.cast("long"))).drop("_large")
    return dealt.join(F.broadcast(folds), "_unit", "left").drop("_unit")


def shared_across_folds(df: DataFrame, body: str, fold: str = "fold") -> DataFrame:
    """``body_key, folds, n``: texts that several folds have, told by their letters and digits in lower case.

    What is left of a text stands as a digest, so only digests and counts are shuffled. No row means no leak.
    """
    plain = F.regexp_replace(F.lower(F.col(body)), r"[^\p{L}\p{N}]+", "")
    keyed = df.filter(F.length(plain) > 0).select(F.md5(plain).alias("body_key"), F.col(fold).alias("_fold"))
    counted = keyed.groupBy("body_key", "_fold").agg(F.count(F.lit(1)).alias("n"))
    met = counted.groupBy("body_key").agg(F.count(F.lit(1)).alias("folds"), F.sum("n").alias("n"))
    return met.filter("folds > 1")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights: rows / (classes * rows of the class). One row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    classes = Window.partitionBy()
    return counts.withColumn("weight", F.sum("n").over(classes) / (F.count(F.lit(1)).over(classes) * F.col("n")))
