"""Profiles, quality gates, folds, weights and AUC."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleflow import fixtures
from ruleflow.operators import cleaning, folds, metrics, profiling
from ruleflow.plans import training_frame
from ruleflow.queries.registry import CLEAN_FRAME, COMMENTS, PREDICTIONS, TEST, TRAIN, label_sql, order_key_sql, query

TYPES = {
    "train": "row_id bigint, body string, subreddit string, rule string, rule_violation string",
    "test": "row_id bigint, body string, subreddit string, rule string, positive_example_1 string, "
    "positive_example_2 string, negative_example_1 string, negative_example_2 string",
}


@query("i1_table_profile", TEST + f"""
SELECT 'train' AS table_name, count(*) AS n_rows, CAST(5 AS BIGINT) AS n_columns, '{TYPES['train']}' AS column_types
FROM f_train
UNION ALL SELECT 'test', count(*), 8, '{TYPES['test']}' FROM f_test""")
def table_profile(spark, sf_dir):
    tables = {"train": fixtures.train(spark, sf_dir), "test": fixtures.test(spark, sf_dir)}
    first, second = (profiling.table_profile(df, name) for name, df in tables.items())
    return first.unionByName(second)


@query("i1_first_rows", TRAIN + """
SELECT row_id, body, subreddit, rule, rule_violation FROM f_train ORDER BY row_id LIMIT 3""")
def first_rows(spark, sf_dir):
    return profiling.first_rows(fixtures.train(spark, sf_dir), "row_id")


@query("i2_label_distribution", COMMENTS + """
SELECT rule_violation, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 2) AS percent
FROM f_comments WHERE rule_violation IS NOT NULL GROUP BY rule_violation""")
def label_distribution(spark, sf_dir):
    return profiling.label_distribution(fixtures.comments(spark, sf_dir).dropna(subset=["rule_violation"]))


@query("i3_rule_counts", COMMENTS + """
SELECT rule, count(*) AS n FROM f_comments GROUP BY rule""")
def rule_counts(spark, sf_dir):
    return profiling.value_counts(fixtures.comments(spark, sf_dir), "rule")


@query("i4_top_subreddits", COMMENTS + """
SELECT subreddit, count(*) AS n FROM f_comments GROUP BY subreddit ORDER BY n DESC, subreddit LIMIT 20""")
def top_subreddits(spark, sf_dir):
    return profiling.value_counts(fixtures.comments(spark, sf_dir), "subreddit", top=20)


@query("i5_frame_summary", CLEAN_FRAME + """
SELECT count(*) AS n_rows, count(*) FILTER (source = 'train') AS train_rows,
  count(*) FILTER (source = 'test_examples') AS example_rows, count(*) FILTER (rule_violation = 1) AS positive_rows,
  count(*) FILTER (rule_violation = 0) AS negative_rows, count(*) FILTER (length(body) = 0) AS empty_body,
  count(*) FILTER (length(rule) = 0) AS empty_rule FROM f_frame""")
def frame_summary(spark, sf_dir):
    frame = training_frame.cleaned_frame(fixtures.train(spark, sf_dir), fixtures.test(spark, sf_dir))
    return profiling.frame_summary(frame)


@query("i6_quality_gates", COMMENTS + """
SELECT CAST(0 AS BIGINT) AS missing_columns, count(*) FILTER (body IS NULL) AS null_body,
  count(*) FILTER (rule IS NULL) AS null_rule, count(*) FILTER (rule_violation IS NULL) AS null_rule_violation,
  count(*) FILTER (length(body) = 0) AS empty_body, count(*) FILTER (length(rule) = 0) AS empty_rule,
  count(*) FILTER (rule_violation NOT IN ('0', '1')) AS bad_label FROM f_comments""")
def quality_gates(spark, sf_dir):
    return profiling.quality_gates(fixtures.comments(spark, sf_dir))


@query("i6_frame_gates", CLEAN_FRAME + """
SELECT CAST(0 AS BIGINT) AS missing_columns, count(*) FILTER (body IS NULL) AS null_body,
  count(*) FILTER (rule IS NULL) AS null_rule, count(*) FILTER (rule_violation IS NULL) AS null_rule_violation,
  count(*) FILTER (length(body) = 0) AS empty_body, count(*) FILTER (length(rule) = 0) AS empty_rule,
  count(*) FILTER (rule_violation NOT IN (0, 1)) AS bad_label FROM f_frame""")
def frame_gates(spark, sf_dir):
    frame = training_frame.cleaned_frame(fixtures.train(spark, sf_dir), fixtures.test(spark, sf_dir))
    return profiling.quality_gates(frame)


def labelled(spark, sf_dir):
    """Comments with a 0/1 label, without their texts."""
    rows = cleaning.coerce_label(fixtures.comments(spark, sf_dir).select("row_id", "rule", "rule_violation"))
    usable = rows.filter(F.col("rule_violation").isin(0, 1))
    return usable.select("row_id", "rule", F.col("rule_violation").cast("int").alias("label"))


LABELLED = COMMENTS + f""", l AS (
  SELECT row_id, rule, CAST({label_sql('rule_violation')} AS INTEGER) AS label FROM f_comments
  WHERE {label_sql('rule_violation')} IN (0, 1))"""


@query("g1_stratified_folds", LABELLED + f"""
SELECT row_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {order_key_sql(42, ('row_id',))}) - 1) % 5
  AS INTEGER) AS fold FROM l""")
def stratified_folds(spark, sf_dir):
    return folds.stratified_folds(labelled(spark, sf_dir), 5, 42).select("row_id", "label", "fold")


@query("g2_class_weights", LABELLED + """
SELECT label, count(*) AS n, (SELECT count(*) FROM l) / ((SELECT count(DISTINCT label) FROM l) * count(*)) AS weight
FROM l GROUP BY label""")
def class_weights(spark, sf_dir):
    return folds.class_weights(labelled(spark, sf_dir))


def judged(spark, sf_dir):
    """Predictions of the rows that have a known label."""
    truth = fixtures.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), "toxic")
    return fixtures.predictions(spark, sf_dir).join(truth, "row_id")


def auc_sql(group: str) -> str:
    return f""", judged AS (
  SELECT p.slot, p.rule, p.rule_violation AS score, l.toxic FROM f_predictions p JOIN labels l ON p.row_id = l.doc_id),
c AS (SELECT {group}, score, count(*) FILTER (toxic = 1) AS pos, count(*) FILTER (toxic = 0) AS neg FROM judged
  GROUP BY {group}, score),
r AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {group} ORDER BY score
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT {group}, round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0
    THEN sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) END, 6) AS auc,
  CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives FROM r GROUP BY {group}"""


@query("g6_roc_auc", PREDICTIONS + auc_sql("slot"))
def roc_auc(spark, sf_dir):
    auc = metrics.roc_auc(judged(spark, sf_dir), "rule_violation", "toxic", ["slot"])
    return auc.withColumn("auc", F.round("auc", 6))


@query("j4_auc_per_rule", PREDICTIONS + auc_sql("slot, rule"))
def auc_per_rule(spark, sf_dir):
    auc = metrics.roc_auc(judged(spark, sf_dir), "rule_violation", "toxic", ["slot", "rule"])
    return auc.withColumn("auc", F.round("auc", 6))


@query("j1_rule_holdout", LABELLED + f"""
SELECT row_id, rule, CAST(CAST('0x' || substr({order_key_sql(42, ('rule',))}, 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold
FROM l""")
def rule_holdout(spark, sf_dir):
    return folds.group_folds(labelled(spark, sf_dir), 5, 42, "rule").select("row_id", "rule", "fold")


DEALT = LABELLED.replace("WITH ", "WITH RECURSIVE ", 1) + """,
g AS (SELECT rule, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, rule) AS place FROM l GROUP BY rule),
dealt(place, loads, fold) AS (
  SELECT CAST(0 AS BIGINT), [0, 0, 0]::BIGINT[], CAST(NULL AS INTEGER)
  UNION ALL
  SELECT g.place, list_transform(range(1, 4), lambda i: loads[i] + CASE WHEN i = list_position(loads, list_min(loads)) THEN g.n ELSE 0 END),
    CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER)
  FROM dealt JOIN g ON g.place = dealt.place + 1)"""


@query("j1_balanced_holdout", DEALT + """
SELECT l.row_id, l.rule, dealt.fold FROM l JOIN g USING (rule) JOIN dealt ON dealt.place = g.place""")
def balanced_holdout(spark, sf_dir):
    """Whole rules held out in folds of like size."""
    return folds.balanced_group_folds(labelled(spark, sf_dir), 3, 42, "rule").select("row_id", "rule", "fold")


PLAIN = "regexp_replace(lower(body), '[^\\p{L}\\p{N}]+', '', 'g')"


@query("j1_fold_leaks", COMMENTS + f""",
k AS (SELECT md5({PLAIN}) AS body_key, row_id % 5 AS fold FROM f_comments WHERE length({PLAIN}) > 0)
SELECT body_key, count(DISTINCT fold) AS folds, count(*) AS n FROM k GROUP BY body_key HAVING count(DISTINCT fold) > 1""")
def fold_leaks(spark, sf_dir):
    """Near-equal comments that a split by row id would put into several folds."""
    rows = fixtures.comments(spark, sf_dir).withColumn("fold", F.col("row_id") % 5)
    return folds.shared_across_folds(rows, "body")
