"""A run's files published together: staged, described by a manifest, and made visible by one rename."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ruleflow.sources import sinks
from ruleflow.storage import path_exists, remove_path, rename_path

MANIFEST = "run_manifest.json"


def content_digest(df: DataFrame) -> list[Column]:
    """``n`` rows, and ``digest`` over all of them in any order: what 60 bits of each row's MD5 come to by exclusive or.

    Columns count in the order of their names, as text; doubles with nine decimals; NULL differs from every text.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def text(name: str) -> Column:
        column = F.col(f"`{name}`")
        if isinstance(kinds[name], (DoubleType, FloatType)):
            column = F.round(column.cast("double"), 9).cast("decimal(38,9)")
        return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("-"))

    row = F.md5(F.concat_ws("\x1f", *[text(name) for name in sorted(kinds)]))
    bits = F.conv(F.substring(row, 1, 15), 16, 10).cast("long")
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(bits), F.lit(0)).alias("digest")]


class Publication:
    """``with Publication(spark, target) as run``: what the block writes becomes visible at ``target`` when it ends, all or nothing.

    Files go to a staging folder beside the target. If the block fails, or the driver is lost, the target does not
    exist; a staging folder that a lost driver leaves can be deleted. A target that exists is never touched.
    """

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target = spark, target.rstrip("/")
        self.staging = f"{self.target}.staging-{uuid.uuid4().hex}"
        self.files: dict[str, tuple[int, int]] = {}
        self.described = False

    def write(self, df: DataFrame, name: str, writer: Callable[[DataFrame, str], None]) -> None:
        """``writer(df, path)`` for one output; ``df`` should be stored, as its rows are counted and digested as well."""
        row = df.agg(*content_digest(df)).first()
        writer(df, f"{self.staging}/{name}")
        self.files[name] = (row["n"], row["digest"])

    def describe(self, facts: DataFrame, **settings: object) -> None:
        """The manifest: one row of ``facts``, the settings, the files written so far with rows and digests, and the time."""
        entries = [F.struct(F.lit(name).alias("name"), F.lit(n).alias("n"), F.lit(digest).alias("digest")) for name, (n, digest) in self.files.items()]
        added = {name: F.lit(value) for name, value in settings.items()}
        added |= {"files": F.array(*entries), "completed_at_utc": F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")}
        sinks.write_metrics(facts.withColumns(added), f"{self.staging}/{MANIFEST}")
        self.described = True

    def __enter__(self) -> Publication:
        if path_exists(self.spark, self.target):
            raise FileExistsError(self.target)
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        try:
            if kind is None:
                if not self.described:
                    raise ValueError("a run needs a manifest")
                rename_path(self.spark, self.staging, self.target)
        finally:
            remove_path(self.spark, self.staging)


def publish_run(
    target: str, outputs: Mapping[str, tuple[DataFrame, Callable[[DataFrame, str], None]]], facts: DataFrame, *, model_id: str, model_revision: str | None,
    seed: int, smoke_rows: int | None = None, submission: str = "submission.csv",
) -> None:
    """A whole run below ``target``: all ``outputs`` by name, and a manifest with ``facts`` on its tables.

    A run on ``smoke_rows`` sample rows is a trial, whose model is not kept.
    """
    with Publication(facts.sparkSession, target) as run:
        for name, (df, writer) in outputs.items():
            run.write(df, name, writer)
        run.describe(
            facts, model_id=model_id, model_revision=model_revision, seed=seed, smoke_rows=smoke_rows, model_saved=not smoke_rows,
            submission=f"{target.rstrip('/')}/{submission}",
        )
