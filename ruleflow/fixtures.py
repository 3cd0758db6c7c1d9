"""Moderation views over the test tables: comments, labelled part, example pool, rows to score, predictions.

Every choice depends on the document id alone. The SQL form of the same views is in
``ruleflow.queries.registry``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleflow.operators.assembly import EXAMPLE_COLUMNS
from ruleflow.operators.positions import hash_positions

PREDICTION_SLOTS = (1, 2, 3, 4, 5, 7)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as comments, with format noise, missing bodies and unusable labels put in."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    kind, text = F.col("doc_id") % 20, F.col("text")
    body = (
        F.when(kind == 0, F.concat(F.lit("  "), text, F.lit("\r\n")))
        .when(kind == 1, F.replace(text, F.lit("\n"), F.lit("\r\n")))
        .when(kind == 2, F.concat(text, F.lit("\0")))
        .when(kind == 3, F.lit("   "))
        .when(kind == 4, F.lit(None))
        .otherwise(text)
    )
    label = (
        F.when(F.col("toxic").isNull(), F.lit(None))
        .when(F.col("doc_id") % 50 == 7, F.lit("bad"))
        .when(F.col("doc_id") % 50 == 8, F.lit("2"))
        .otherwise(F.col("toxic").cast("string"))
    )
    return documents.join(labels.select("doc_id", "toxic"), "doc_id", "left").select(
        F.col("doc_id").alias("row_id"),
        body.alias("body"),
        F.col("source").alias("subreddit"),
        F.concat(F.lit("No "), F.col("lang"), F.lit(" posts")).alias("rule"),
        label.alias("rule_violation"),
    )


def _is_train():
    digit = F.substring(F.md5(F.col("row_id").cast("string")), 1, 1)
    return F.col("rule_violation").isNotNull() & (digit < "c")


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comments(spark, sf_dir).filter(_is_train())


def unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to score, without their examples."""
    return comments(spark, sf_dir).filter(~_is_train()).drop("rule_violation")


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of labelled comments, numbered inside (rule, label) by a digest of the id; ``n`` per (rule, label)."""
    usable = train(spark, sf_dir).filter(F.col("rule_violation").isin("0", "1"))
    keyed = usable.select(
        "rule", "rule_violation", F.col("row_id").alias("example_id"), F.md5(F.col("row_id").cast("string")).alias("key")
    )
    placed = hash_positions(keyed, "key", ["rule", "rule_violation"])
    return placed.select(
        "rule", "rule_violation", "example_id", F.col("position").alias("idx"), F.col("group_rows").alias("n")
    )


def test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to score with two positive and two negative examples of their rule."""
    return with_examples(spark, sf_dir, unlabelled(spark, sf_dir))


def train_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows with a 0/1 label and examples of their rule; a row is never its own example."""
    usable = train(spark, sf_dir).filter(F.col("rule_violation").isin("0", "1"))
    return with_examples(spark, sf_dir, usable).join(usable.select("row_id", "rule_violation"), "row_id")


def with_examples(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """``rows`` with up to four examples from the pool, without one that is the row itself.

    Each row asks the pool for up to four numbered ids through one equi-join; the numbers spread a large
    rule over all keys. The texts of the ids are fetched after that.
    """
    labelled = train(spark, sf_dir)
    sizes = labelled.groupBy("rule").agg(
        F.count_if(F.col("rule_violation") == "1").alias("np"), F.count_if(F.col("rule_violation") == "0").alias("nn")
    )

    def wanted(name: str, label: str, step: int, size: str):
        number = F.when(F.col(size) > 0, (F.col("row_id") + step) % F.greatest(F.col(size), F.lit(1)))
        return F.struct(F.lit(name).alias("example"), F.lit(label).alias("rule_violation"), number.alias("idx"))

    wishes = F.array(
        wanted(EXAMPLE_COLUMNS[0], "1", 0, "np"), wanted(EXAMPLE_COLUMNS[1], "1", 1, "np"),
        wanted(EXAMPLE_COLUMNS[2], "0", 0, "nn"), wanted(EXAMPLE_COLUMNS[3], "0", 1, "nn"),
    )
    requests = rows.select("row_id", "rule").join(sizes, "rule").select("row_id", "rule", F.inline(wishes))
    chosen = requests.dropna(subset=["idx"]).join(pool(spark, sf_dir).drop("n"), ["rule", "rule_violation", "idx"])
    chosen = chosen.filter("example_id <> row_id")
    texts = labelled.select(F.col("row_id").alias("example_id"), F.col("body").alias("example_body"))
    answered = chosen.select("row_id", "example", "example_id").join(texts, "example_id")
    # At most four entries per row.
    gathered = answered.groupBy("row_id").agg(
        F.map_from_entries(F.collect_list(F.struct("example", "example_body"))).alias("found")
    )
    return rows.join(gathered, "row_id", "left").select(
        "row_id", "body", "subreddit", "rule", *[F.col("found")[c].alias(c) for c in EXAMPLE_COLUMNS]
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six models' scores with 101 distinct values, so with ties."""
    slots = F.explode(F.array(*[F.lit(s) for s in PREDICTION_SLOTS])).alias("slot")
    score = ((F.col("row_id") * (17 + 2 * F.col("slot")) + 31 * F.col("slot")) % 101).cast("double") / 100
    return unlabelled(spark, sf_dir).select(slots, "row_id", "rule").withColumn("rule_violation", score)
