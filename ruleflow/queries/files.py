"""File input and output: what is written is read back and returned."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ruleflow import fixtures
from ruleflow.functions.text import NA_TOKENS
from ruleflow.operators import blending, profiling
from ruleflow.plans import ensemble, training_frame
from ruleflow.queries.registry import CLEAN_FRAME, COMMENTS, ORACLES, PREDICTIONS, query
from ruleflow.queries.scoring import RANKED, blend_sql, rounded, sample
from ruleflow.sources import comments, predictions, publishing, quoted, sinks
from ruleflow.storage import materialize, scratch_path

NA_LIST = ", ".join(f"'{token}'" for token in NA_TOKENS)

# Rows of a file that one task writes.
FILE_ROWS = 20_000


def present(column: str) -> str:
    return f"CASE WHEN {column} NOT IN ({NA_LIST}) THEN {column} END AS {column}"


@query("a1_csv_scan", COMMENTS + f"""
SELECT row_id, {present('body')}, {present('subreddit')}, {present('rule')}, {present('rule_violation')} FROM f_comments""")
def csv_scan(spark, sf_dir):
    path = scratch_path(spark, "comments-csv")
    sinks.write_csv(fixtures.comments(spark, sf_dir), path)
    return comments.read_comments(spark, path, comments.TRAIN_COLUMNS, {"row_id": "long"})


@query("a1_split_scan", ORACLES["a1_csv_scan"])
def split_scan(spark, sf_dir):
    """The same comments from few files, each read by several tasks; a file's rows are bounded, as one task writes it."""
    path = scratch_path(spark, "few-csv")
    rows = fixtures.comments(spark, sf_dir)
    sinks.write_csv(rows.repartition(max(1, math.ceil(rows.count() / FILE_ROWS)), "row_id"), path)
    return quoted.read_quoted(spark, path, comments.TRAIN_COLUMNS, {"row_id": "long"})


@query("a2_required_columns", """
SELECT 'comments' AS table_name, 'none' AS missing, count(*) AS n_rows FROM documents
UNION ALL SELECT 'documents', 'body,rule,rule_violation', count(*) FROM documents
UNION ALL SELECT 'labels', 'body,rule,rule_violation', count(*) FROM labels""")
def required_columns(spark, sf_dir):
    tables = {
        "comments": fixtures.comments(spark, sf_dir),
        "documents": fixtures.table(spark, sf_dir, "documents"),
        "labels": fixtures.table(spark, sf_dir, "labels"),
    }
    reports = []
    for name, df in tables.items():
        missing = ",".join(comments.missing_columns(df, comments.TRAIN_COLUMNS)) or "none"
        reports.append(
            df.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(name).alias("table_name"), F.lit(missing).alias("missing"), "n_rows"
            )
        )
    return reports[0].unionByName(reports[1]).unionByName(reports[2])


@query("a3_text_column_row_id", """
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, text AS body, lang AS rule FROM documents""")
def text_column_row_id(spark, sf_dir):
    path = scratch_path(spark, "texts-csv")
    documents = fixtures.table(spark, sf_dir, "documents").orderBy("doc_id")
    sinks.write_csv(documents.select("text", F.col("lang").alias("rule")), path)
    scan = spark.read.options(**comments.READ_OPTIONS).csv(path, multiLine=True)
    return comments.resolve_text_column(comments.ensure_row_id(scan)).select("row_id", "body", "rule")


@query("a4_prediction_files", PREDICTIONS + """
SELECT slot, row_id, rule_violation FROM f_predictions""")
def prediction_files(spark, sf_dir):
    folder = scratch_path(spark, "predictions")
    sinks.write_predictions(fixtures.predictions(spark, sf_dir), folder, list(fixtures.PREDICTION_SLOTS))
    return predictions.read_predictions(spark, folder, blending.DEFAULT_WEIGHTS)


@query("a4_prediction_files_mixed", PREDICTIONS + """
SELECT slot, row_id, rule_violation FROM f_predictions""")
def prediction_files_mixed(spark, sf_dir):
    """Files that differ in the order of their columns and in extra ones."""
    folder = scratch_path(spark, "predictions-mixed")
    rows = fixtures.predictions(spark, sf_dir)
    orders = (["row_id", "rule_violation"], ["rule_violation", "row_id"], ["row_id", "rule", "rule_violation"], ["rule", "rule_violation", "slot", "row_id"])
    for slot in fixtures.PREDICTION_SLOTS:
        columns = orders[slot % len(orders)]
        sinks.write_csv(rows.filter(F.col("slot") == slot).select(*columns), f"{folder}/submission{slot}.csv")
    return predictions.read_predictions(spark, folder, blending.DEFAULT_WEIGHTS)


@query("a5_submission_sink", PREDICTIONS + blend_sql(blending.DEFAULT_WEIGHTS, "total"))
def submission_sink(spark, sf_dir):
    path = scratch_path(spark, "submission-csv")
    sinks.write_submission(rounded(blending.blend(fixtures.predictions(spark, sf_dir))), path)
    return spark.read.schema("row_id long, rule_violation double").options(**comments.READ_OPTIONS).csv(path)


@query("a6_oof_sink", PREDICTIONS + """
SELECT p.row_id, l.toxic AS rule_violation, p.rule_violation AS oof_pred
FROM f_predictions p JOIN labels l ON p.row_id = l.doc_id WHERE p.slot = 1""")
def oof_sink(spark, sf_dir):
    path = scratch_path(spark, "oof")
    truth = fixtures.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), "toxic")
    first = fixtures.predictions(spark, sf_dir).filter("slot = 1").withColumnRenamed("rule_violation", "oof_pred")
    sinks.write_oof(first.join(truth, "row_id").withColumnRenamed("toxic", "rule_violation"), path)
    return spark.read.parquet(path)


@query("a7_manifest", CLEAN_FRAME + """
SELECT count(*) AS constructed_training_rows, count(*) FILTER (source = 'train') AS train_source,
  count(*) FILTER (source = 'test_examples') AS example_source, (SELECT count(*) FROM f_train) AS train_rows,
  (SELECT count(*) FROM f_rows) AS test_rows, CAST(2 AS BIGINT) AS test_example_repeats FROM f_frame""")
def manifest(spark, sf_dir):
    path = scratch_path(spark, "manifest-json")
    train, test = fixtures.train(spark, sf_dir), fixtures.test(spark, sf_dir)
    frame = training_frame.cleaned_frame(train, test)
    sinks.write_metrics(profiling.manifest(frame, train, fixtures.unlabelled(spark, sf_dir), 2), path)
    schema = (
        "constructed_training_rows long, constructed_source_counts map<string, long>, train_rows long, "
        "test_rows long, test_example_repeats long"
    )
    sources = F.col("constructed_source_counts")
    return spark.read.schema(schema).json(path).select(
        "constructed_training_rows",
        sources["train"].alias("train_source"),
        sources["test_examples"].alias("example_source"),
        "train_rows", "test_rows", "test_example_repeats",
    )


@query("h_ensemble_submission", RANKED + blend_sql(blending.DEFAULT_WEIGHTS, "total", "ranked", "rank_score").replace(
    "SELECT row_id, round", "SELECT row_number() OVER (ORDER BY md5(CAST(row_id AS VARCHAR))) - 1 AS ord, row_id, round"
))
def ensemble_submission(spark, sf_dir):
    """Prediction files to ranked, blended, checked and ordered submission."""
    blended = ensemble.ensemble(fixtures.predictions(spark, sf_dir))
    return rounded(ensemble.submission(blended, sample(spark, sf_dir)))


def digest_sql(columns: dict[str, str]) -> str:
    """Rows and digest of a relation, as ``content_digest`` has them; ``columns`` gives each one's SQL as text."""
    row = "md5(concat_ws(chr(31), " + ", ".join(f"coalesce('=' || {columns[c]}, '-')" for c in sorted(columns)) + "))"
    return f"bit_xor(CAST('0x' || substr({row}, 1, 15) AS BIGINT))"


BLEND_PARTS, BLEND = blend_sql(blending.DEFAULT_WEIGHTS, "total").rsplit("\nSELECT", 1)


@query("a7_published_run", CLEAN_FRAME + f""", f_predictions AS (
  SELECT m.slot, t.row_id, t.rule, CAST((t.row_id * (17 + 2 * m.slot) + 31 * m.slot) % 101 AS DOUBLE) / 100 AS rule_violation
  FROM f_rows t, (SELECT unnest({list(fixtures.PREDICTION_SLOTS)}) AS slot) m){BLEND_PARTS}, s AS (SELECT{BLEND})
SELECT 'encoder' AS model_id, 'r1' AS model_revision, 42 AS seed, 32 AS smoke_rows, false AS model_saved,
  (SELECT count(*) FROM f_frame) AS constructed_training_rows, (SELECT count(*) FROM f_train) AS train_rows, (SELECT count(*) FROM f_rows) AS test_rows,
  CAST(2 AS BIGINT) AS test_example_repeats, 'submission.csv' AS name, count(*) AS n,
  {digest_sql({"row_id": "CAST(row_id AS VARCHAR)", "rule_violation": "CAST(CAST(round(rule_violation, 9) AS DECIMAL(38, 9)) AS VARCHAR)"})} AS digest,
  true AS has_time, true AS has_submission FROM s""")
def published_run(spark, sf_dir):
    """A run's submission and manifest, read from where they were published together."""
    path = scratch_path(spark, "published-run")
    train, test = fixtures.train(spark, sf_dir), fixtures.test(spark, sf_dir)
    facts = profiling.manifest(training_frame.cleaned_frame(train, test), train, fixtures.unlabelled(spark, sf_dir), 2)
    scores = materialize(rounded(blending.blend(fixtures.predictions(spark, sf_dir))), "blended")
    publishing.publish_run(
        path, {"submission.csv": (scores, sinks.write_submission)}, facts, model_id="encoder", model_revision="r1", seed=42, smoke_rows=32
    )
    schema = (
        "model_id string, model_revision string, seed int, smoke_rows int, model_saved boolean, constructed_training_rows long, train_rows long, "
        "test_rows long, test_example_repeats long, files array<struct<name: string, n: long, digest: long>>, completed_at_utc string, submission string"
    )
    run = spark.read.schema(schema).json(f"{path}/{publishing.MANIFEST}")
    told = run.select("*", F.inline("files"), F.col("completed_at_utc").isNotNull().alias("has_time"), F.col("submission").endswith("/submission.csv").alias("has_submission"))
    return told.drop("files", "completed_at_utc", "submission")
