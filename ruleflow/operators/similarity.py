"""Similarity of a text to other texts of its own row."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleflow.functions.text import fold_text, words
from ruleflow.operators import features, terms
from ruleflow.operators.features import WORD_BLOCK
from ruleflow.storage import materialize


def similarity_features(df: DataFrame, parts: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """``row_id`` and ``similarity_<part>``: cosine of the first part's TF-IDF vector with that of each other part.

    The vocabulary and its weights come from the first part of all rows and are bounded as in the word
    block, so they are broadcast. A row's parts are weighed where they are and no n-gram is stored or shuffled. A part that
    is NULL or has no known term has similarity 0.
    """
    texts = df.select(F.col(row_id).alias("row_id"), *[F.col(p).alias(f"_part{i}") for i, p in enumerate(parts)])
    rows = df.agg(F.count(F.lit(1))).scalar()
    stats = materialize(terms.statistics(terms.analysed(texts, "_part0"), blocks=[WORD_BLOCK.name]), "first-part-terms")
    kept = features.prune_vocabulary(stats, rows, WORD_BLOCK).select("term", features.inverse_frequency(F.col("df"), rows).alias("idf")).toArrow()
    shared = df.sparkSession.sparkContext.broadcast((kept.column("term").to_pylist(), kept.column("idf").to_numpy()))
    number = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = [words(fold_text(F.coalesce(F.col(f"_part{i}"), F.lit("")))).alias(f"_part{i}") for i in range(len(parts))]
    names = [f"similarity_{p}" for p in parts[1:]]
    schema = ", ".join([f"row_id {texts.schema['row_id'].dataType.simpleString()}", *[f"`{n}` double" for n in names]])
    return texts.repartition(number, "row_id").select("row_id", *tokens).mapInArrow(products(shared, names), schema)


def products(shared, names: Sequence[str]) -> Callable:
    """The products of the first part's unit vector with the others', by row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, idf = shared.value
        known = terms.WordTerms(given)

        def vectors(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for index, times in known.rows(lists):
                weight = (1 + np.log(times)) * idf[index]
                yield index, weight / np.sqrt(weight @ weight) if len(index) else weight

        for rows in terms.slices(batches):
            own = np.zeros(len(idf))
            found = np.zeros((rows.num_rows, len(names)))
            for i, (first, *others) in enumerate(zip(*[vectors(rows.column(k + 1)) for k in range(len(names) + 1)], strict=True)):
                own[first[0]] = first[1]
                found[i] = [own[index] @ weight for index, weight in others]
                own[first[0]] = 0.0
            yield pa.RecordBatch.from_arrays([rows.column("row_id"), *[pa.array(c) for c in np.ascontiguousarray(found.T)]], names=["row_id", *names])

    return run


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two arrays of one length; 0 where one of them has no length."""

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    lengths = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.when(lengths > 0, dot(left, right) / lengths).otherwise(0.0)


def centroid_similarity(df: DataFrame, vector: str, group: str, label: str, row_id: str = "row_id") -> DataFrame:
    """``row_id, similarity_positive, similarity_negative``: cosine of a row's vector with those of its group's positives and negatives.

    A centroid is told without the row itself, and as only its direction counts, a sum does: one aggregation with partial
    sums adds up the vectors of each group and label, and every row takes itself out of its own. A row has 0 where
    nothing is left, and NULL where its vector is NULL. Vectors must be of one length.
    """
    rows = df.select(
        F.col(row_id).alias("row_id"), F.col(group).alias("_group"), F.col(label).alias("_label"), F.col(vector).cast("array<double>").alias("_vector")
    )
    known = rows.filter(F.col("_vector").isNotNull() & F.col("_label").isin(0, 1))
    sums = known.groupBy("_group", "_label").agg(vector_to_array(Summarizer.sum(array_to_vector("_vector"))).alias("_sum"))
    named = sums.groupBy("_group").agg(*[F.first(F.when(F.col("_label") == y, F.col("_sum")), ignorenulls=True).alias(f"_sum{y}") for y in (1, 0)])
    joined = rows.join(named.withColumnRenamed("_group", "_of"), F.col("_group").eqNullSafe(F.col("_of")), "left")

    def similarity(y: int) -> Column:
        without = F.zip_with(f"_sum{y}", "_vector", lambda s, x: s - x)
        left = F.when(F.col("_label") == y, without).otherwise(F.col(f"_sum{y}"))
        return F.when(F.col("_vector").isNotNull(), F.coalesce(cosine(F.col("_vector"), left), F.lit(0.0)))

    return joined.select("row_id", similarity(1).alias("similarity_positive"), similarity(0).alias("similarity_negative"))
