"""Word and character n-gram TF-IDF as long tables.

Long form is ``row_id, block, term, tf``; a weight table carries ``index`` and ``weight`` instead of tf.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ruleflow.functions.text import WHITESPACE_RUN, fold_text, words
from ruleflow.storage import materialize_by


@dataclass(frozen=True)
class Block:
    """One TF-IDF block: its name and its vocabulary limits."""

    name: str
    min_df: int
    max_df: float
    max_features: int


# N-gram ranges and vocabulary limits of both blocks.
WORD_BLOCK = Block("word", 2, 0.95, 80_000)
CHAR_BLOCK = Block("char", 2, 1.0, 80_000)
BLOCKS = (WORD_BLOCK, CHAR_BLOCK)
CHAR_SIZES = (3, 4, 5)


def folded_rows(df: DataFrame, text: str, row_id: str = "row_id", keep: Sequence[str] = ()) -> DataFrame:
    """``row_id`` and analyser text, hash-partitioned by row; ``keep`` names row attributes to carry along.

    This is the only exchange of the n-gram stages: all n-grams of a row are made and counted where its
    text is, so the text moves once and the much larger n-gram table does not. The partition number is
    given because adaptive merging would go by the size of the texts, not of their n-grams.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folded = fold_text(F.coalesce(F.col(text), F.lit("")))
    rows = df.select(F.col(row_id).alias("row_id"), *keep, folded.alias("text"))
    return rows.repartition(partitions, "row_id")


def word_counts(folded: DataFrame) -> DataFrame:
    """Words and pairs of neighbouring words."""
    row = [c for c in folded.columns if c != "text"]
    pairs = F.when(
        F.size("tokens") > 1,
        F.zip_with(
            F.slice("tokens", F.lit(1), F.size("tokens") - 1),
            F.slice("tokens", F.lit(2), F.size("tokens") - 1),
            lambda left, right: F.concat(left, F.lit(" "), right),
        ),
    ).otherwise(F.array().cast("array<string>"))
    tokens = folded.select(*row, words(F.col("text")).alias("tokens"))
    terms = tokens.select(*row, F.explode(F.concat("tokens", pairs)).alias("term"))
    return terms.groupBy(*row, "term").agg(F.count(F.lit(1)).alias("tf"))


def char_counts(folded: DataFrame) -> DataFrame:
    """Character n-grams inside words, each word padded with one space on both sides.

    The n-grams of a word depend on the word alone, so a row's words are counted first and each
    distinct word is cut once. A padded word shorter than n has no n-gram of that size.
    """
    row = [c for c in folded.columns if c != "text"]
    pieces = folded.select(*row, F.explode(F.split("text", WHITESPACE_RUN)).alias("word")).filter("word != ''")
    counted = pieces.groupBy(*row, "word").agg(F.count(F.lit(1)).alias("n"))
    padded = counted.select(*row, "n", F.concat(F.lit(" "), "word", F.lit(" ")).alias("word"))
    sized = padded.select("*", F.explode(F.array(*map(F.lit, CHAR_SIZES))).alias("size"))
    room = F.length("word") - F.col("size")
    cut = sized.filter(room >= 0).select("*", F.explode(F.sequence(F.lit(1), room + 1)).alias("start"))
    grams = cut.select(*row, "n", F.substring("word", F.col("start"), F.col("size")).alias("term"))
    return grams.groupBy(*row, "term").agg(F.sum("n").alias("tf"))


def block_counts(folded: DataFrame) -> list[DataFrame]:
    """The long tables of both blocks, word block first."""
    counted = ((WORD_BLOCK, word_counts(folded)), (CHAR_BLOCK, char_counts(folded)))
    return [counts.withColumn("block", F.lit(block.name)) for block, counts in counted]


def term_counts(df: DataFrame, text: str, row_id: str = "row_id", keep: Sequence[str] = ()) -> DataFrame:
    """Both blocks in one table."""
    words_, chars = block_counts(folded_rows(df, text, row_id, keep))
    return words_.unionByName(chars)


def stored_counts(
    df: DataFrame, text: str, row_id: str = "row_id", keep: Sequence[str] = (), blocks: Sequence[Block] = BLOCKS
) -> DataFrame:
    """``term_counts`` of the given blocks, made once and stored by row.

    Statistics, vocabularies and weights of any number of folds then read the table, and whatever groups it
    by row needs no exchange.
    """
    folded = folded_rows(df, text, row_id, keep)
    kept = [counts for block, counts in zip(BLOCKS, block_counts(folded), strict=True) if block in blocks]
    return materialize_by(reduce(DataFrame.unionByName, kept), "row_id", int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "counts")


def term_statistics(counts: DataFrame) -> DataFrame:
    """Rows and corpus occurrences per term; counts are combined before the shuffle."""
    return counts.groupBy("block", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def prune_vocabulary(stats: DataFrame, rows: Column | int, block: Block) -> DataFrame:
    """``block, term, df, tf`` of the terms inside the limits, the most frequent first, ties by term.

    ``stats`` should be stored: it is read twice. The first pass finds about which corpus count the last
    kept term has, from the number of terms per step of a scale, so only about ``max_features`` terms are
    sorted.
    """
    inside = stats.filter(
        (F.col("block") == block.name) & (F.col("df") >= block.min_df) & (F.col("df") <= rows * F.lit(block.max_df))
    )
    # A logarithmic scale of 64 steps per doubling has at most 4,096 steps, whatever the corpus.
    step = F.floor(F.log2("tf") * 64)
    downwards = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = inside.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).withColumn("reached", F.sum("n").over(downwards))
    lowest = reached.filter(F.col("reached") >= block.max_features).agg(F.max("step")).scalar()
    frequent = inside.filter(step >= F.coalesce(lowest, F.lit(0)))
    return frequent.orderBy(F.desc("tf"), "term").limit(block.max_features)


def inverse_frequency(df: Column, rows: Column | int) -> Column:
    return F.log((F.lit(1.0) + rows) / (F.lit(1.0) + df)) + F.lit(1.0)


def raw_weights(counts: DataFrame, vocabulary: DataFrame, rows: Column | int) -> DataFrame:
    """``raw`` weight per row and kept term, before scaling to unit length.

    The vocabulary has at most ``max_features`` terms per block whatever the data's size, so it is
    broadcast; the counts keep their partitioning by row through the join.
    """
    terms = vocabulary.withColumn("idf", inverse_frequency(F.col("df"), rows)).drop("df", "tf")
    joined = counts.join(F.broadcast(terms), ["block", "term"])
    return joined.withColumn("raw", (F.lit(1.0) + F.log("tf")) * F.col("idf")).drop("idf", "tf")


def tfidf_weights(counts: DataFrame, vocabulary: DataFrame, rows: Column | int) -> DataFrame:
    """``weight`` per row and kept term, of unit length per row and block."""
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("row_id", "block")))
    return raw_weights(counts, vocabulary, rows).withColumn("weight", F.col("raw") / length).drop("raw")


def index_vocabulary(vocabulary: DataFrame) -> DataFrame:
    """Adds a dense ``index`` over both blocks; the size bound of a vocabulary makes one ordered window fine."""
    order = Window.orderBy(F.desc("block"), "term")
    return vocabulary.withColumn("index", (F.row_number().over(order) - 1).cast(IntegerType()))
