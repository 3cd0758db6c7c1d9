"""Batch scoring with a model that the caller supplies."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.resource import ResourceProfile
from pyspark.sql.types import DoubleType

from ruleflow.storage import path_exists

Scorer = Callable[[pd.Series], pd.Series]


def score_batches(
    df: DataFrame, load: Callable[[], Scorer], text: str = "text", batch_size: int = 32, out: str = "logit"
) -> DataFrame:
    """``row_id`` and the scorer's output per row.

    ``load`` runs once per Python worker, however many tasks it gets, and the scorer once per batch. Rows
    are ordered by text length inside their own partitions, so that batches hold texts of similar length
    and no text moves. The result does not depend on the batches. Store it before ranking, which reads
    its input more than once.
    """

    def make() -> Callable[[np.ndarray], np.ndarray]:
        scorer = load()
        return lambda texts: np.asarray(scorer(pd.Series(texts)), dtype="float64")

    predict = predict_batch_udf(make, return_type=DoubleType(), batch_size=batch_size)
    ordered = df.select("row_id", F.col(text).alias("_text")).sortWithinPartitions(F.length("_text"))
    return ordered.select("row_id", predict("_text").alias(out))


def arrow_scorer(load: Callable[[], Scorer], batch_size: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            for low in range(0, batch.num_rows, batch_size):
                rows = batch.slice(low, batch_size)
                scorer = scorer or load()
                logits = np.asarray(scorer(rows.column("_text").to_pandas()), dtype="float64")
                yield pa.RecordBatch.from_arrays([rows.column("row_id"), pa.array(logits)], names=["row_id", "logit"])

    return run


def score_in_waves(
    df: DataFrame, load: Callable[[], Scorer], ledger: str, text: str = "text", parts: int = 64, wave: int = 16, batch_size: int = 32,
    profile: ResourceProfile | None = None, most_waves: int | None = None,
) -> DataFrame:
    """``row_id, logit`` by a run that can be stopped and started again: only what no finished wave has is scored.

    Rows belong to one of ``parts`` by a digest of their id. Each wave scores some parts and stores them below ``ledger``,
    then the list of its parts; a wave without that list does not count, and a job started again with the same
    ``ledger``, ``parts`` and rows goes on behind the last one. ``profile`` asks for the resources of scoring tasks,
    such as accelerators. ``most_waves`` ends a run early; the result has what is scored by then. ``load`` as in ``score_batches``,
    but once per task.
    """
    spark = df.sparkSession
    # Ids that are numbers or texts deal out alike in any run; NULL ids have a part too.
    part = F.pmod(F.xxhash64(F.col("row_id")), F.lit(parts)).cast("int")
    rows = df.select("row_id", part.alias("_part"), F.col(text).alias("_text"))
    kind = df.schema["row_id"].dataType.simpleString()
    done = finished_parts(spark, ledger)
    pending = [p for p in range(parts) if p not in done]
    for chosen in [pending[i : i + wave] for i in range(0, len(pending), wave)][:most_waves]:
        wanted = rows.filter(F.col("_part").isin(chosen)).sortWithinPartitions(F.length("_text"))
        scored = wanted.mapInArrow(arrow_scorer(load, batch_size), f"row_id {kind}, logit double", profile=profile)
        name = f"wave={uuid.uuid4().hex}"
        scored.write.parquet(f"{ledger}/rows/{name}")
        # Its list of parts comes last: a wave without one does not count.
        spark.createDataFrame([(p,) for p in chosen], "part int").coalesce(1).write.parquet(f"{ledger}/parts/{name}")
    waves = sorted(set(finished_parts(spark, ledger).values()))
    if not waves:
        return spark.createDataFrame([], f"row_id {kind}, logit double")
    return spark.read.schema(f"row_id {kind}, logit double").parquet(*[f"{ledger}/rows/wave={w}" for w in waves])


def finished_parts(spark: SparkSession, ledger: str) -> dict[int, str]:
    """The wave of each part that is scored."""
    if not path_exists(spark, f"{ledger}/parts"):
        return {}
    listed = spark.read.schema("part int, wave string").parquet(f"{ledger}/parts")
    return {r["part"]: r["wave"] for r in listed.collect()}  # one row for each part


def length_scorer(slope: float = 0.001, offset: float = -1.0) -> Callable[[], Scorer]:
    """A stand-in model for tests: a line in the text length."""

    def load() -> Scorer:
        return lambda texts: offset + slope * texts.str.len().astype("float64")

    return load
