"""Cleaning, predicates, reshape and training frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleflow import fixtures
from ruleflow.operators import assembly, cleaning
from ruleflow.operators.positions import hash_positions
from ruleflow.plans import training_frame
from ruleflow.queries.registry import (
    CLEAN_FRAME, COMMENTS, FRAME_COLUMNS, TEST, TRAIN, UNPIVOTED, clean_sql, label_sql, order_key_sql, query,
)


@query("b1_clean_text", COMMENTS + f"""
SELECT row_id, {clean_sql('body')} AS body, {clean_sql('rule')} AS rule FROM f_comments""")
def clean_text(spark, sf_dir):
    return cleaning.clean_texts(fixtures.comments(spark, sf_dir)).select("row_id", "body", "rule")


@query("b2_coerce_label", COMMENTS + f"""
SELECT row_id, {label_sql('rule_violation')} AS rule_violation FROM f_comments""")
def coerce_label(spark, sf_dir):
    return cleaning.coerce_label(fixtures.comments(spark, sf_dir)).select("row_id", "rule_violation")


@query("b3_drop_missing", COMMENTS + f"""
SELECT row_id, body, rule, {label_sql('rule_violation')} AS rule_violation FROM f_comments
WHERE body IS NOT NULL AND rule IS NOT NULL AND {label_sql('rule_violation')} IS NOT NULL""")
def drop_missing(spark, sf_dir):
    rows = cleaning.coerce_label(fixtures.comments(spark, sf_dir))
    return cleaning.drop_missing(rows).select("row_id", "body", "rule", "rule_violation")


@query("b4_keep_valid", COMMENTS + f""", c AS (
  SELECT row_id, {clean_sql('body')} AS body, {clean_sql('rule')} AS rule, {label_sql('rule_violation')} AS label
  FROM f_comments)
SELECT row_id, body, rule, CAST(label AS TINYINT) AS rule_violation FROM c
WHERE length(body) > 0 AND length(rule) > 0 AND label IN (0, 1)""")
def keep_valid(spark, sf_dir):
    rows = cleaning.coerce_label(cleaning.clean_texts(fixtures.comments(spark, sf_dir)))
    return cleaning.keep_valid(cleaning.drop_missing(rows)).select("row_id", "body", "rule", "rule_violation")


@query("b5_fill_text", TEST + """
SELECT row_id, coalesce(body, '') AS body, coalesce(rule, '') AS rule, coalesce(subreddit, '') AS subreddit,
  coalesce(positive_example_1, '') AS positive_example_1, coalesce(positive_example_2, '') AS positive_example_2,
  coalesce(negative_example_1, '') AS negative_example_1, coalesce(negative_example_2, '') AS negative_example_2
FROM f_test""")
def fill_text(spark, sf_dir):
    return fixtures.test(spark, sf_dir).na.fill("")


@query("b6_project_tag", TRAIN + """
SELECT body, rule, rule_violation, 'train' AS source FROM f_train""")
def project_tag(spark, sf_dir):
    return assembly.tag_source(fixtures.train(spark, sf_dir))


@query("c1_unpivot_examples", TEST + f"""
SELECT body, rule, CAST(rule_violation AS INTEGER) AS rule_violation, source FROM {UNPIVOTED}""")
def unpivot_examples(spark, sf_dir):
    return assembly.unpivot_examples(fixtures.test(spark, sf_dir))


@query("c2_union", TEST + f"""
SELECT body, rule, rule_violation, 'train' AS source FROM f_train
UNION ALL SELECT body, rule, CAST(rule_violation AS VARCHAR), source FROM {UNPIVOTED}""")
def union(spark, sf_dir):
    examples = assembly.unpivot_examples(fixtures.test(spark, sf_dir))
    as_text = F.col("rule_violation").cast("string")
    return assembly.tag_source(fixtures.train(spark, sf_dir)).unionByName(
        examples.withColumn("rule_violation", as_text)
    )


@query("c3_dedupe", TEST + f"""
SELECT DISTINCT body, rule, CAST(rule_violation AS INTEGER) AS rule_violation, source FROM {UNPIVOTED}""")
def dedupe(spark, sf_dir):
    return assembly.dedupe(assembly.unpivot_examples(fixtures.test(spark, sf_dir)))


@query("c4_oversample", CLEAN_FRAME + """
SELECT source, rule, rule_violation, copy_no, md5(body) AS body_md5 FROM f_frame""")
def oversample(spark, sf_dir):
    frame = training_frame.cleaned_frame(fixtures.train(spark, sf_dir), fixtures.test(spark, sf_dir))
    return frame.select("source", "rule", "rule_violation", "copy_no", F.md5("body").alias("body_md5"))


SHUFFLE_KEY = order_key_sql(1001, FRAME_COLUMNS)


@query("c5_seeded_shuffle", CLEAN_FRAME + f"""
SELECT source, rule, rule_violation, copy_no, {SHUFFLE_KEY} AS shuffle_key,
  row_number() OVER (ORDER BY {SHUFFLE_KEY}) - 1 AS position FROM f_frame""")
def seeded_shuffle(spark, sf_dir):
    frame = training_frame.cleaned_frame(fixtures.train(spark, sf_dir), fixtures.test(spark, sf_dir))
    keyed = assembly.with_order_key(frame, training_frame.DEFAULT_SEED).drop("body")
    return hash_positions(keyed, "shuffle_key").drop("group_rows").orderBy("shuffle_key")


SMOKE_KEY = order_key_sql(3001, FRAME_COLUMNS)


@query("c6_balanced_sample", CLEAN_FRAME + f"""
SELECT body, rule, rule_violation, source, copy_no, shuffle_key FROM (
  SELECT *, {SMOKE_KEY} AS shuffle_key,
    row_number() OVER (PARTITION BY rule_violation ORDER BY {SMOKE_KEY}) AS place FROM f_frame)
WHERE place <= 16""")
def balanced_sample(spark, sf_dir):
    frame = training_frame.cleaned_frame(fixtures.train(spark, sf_dir), fixtures.test(spark, sf_dir))
    return training_frame.smoke_sample(frame, 32)


@query("c7_cleaned_frame", CLEAN_FRAME + """
SELECT body, rule, rule_violation, source, copy_no FROM f_frame""")
def cleaned_frame(spark, sf_dir):
    return training_frame.cleaned_frame(fixtures.train(spark, sf_dir), fixtures.test(spark, sf_dir))


@query("c8_raw_frame", TEST + f""", f_raw AS (
  SELECT DISTINCT * FROM (
    SELECT body, rule, rule_violation, 'train' AS source FROM f_train
    UNION ALL SELECT body, rule, CAST(rule_violation AS VARCHAR), source FROM {UNPIVOTED})),
f_copied AS (
  SELECT r.*, c.copy_no FROM f_raw r
  JOIN (SELECT unnest([1, 2]) AS copy_no) c ON c.copy_no = 1 OR r.source = 'test_examples')
SELECT body, rule, rule_violation, {SHUFFLE_KEY} AS shuffle_key FROM f_copied""")
def raw_frame(spark, sf_dir):
    frame = training_frame.raw_frame(fixtures.train(spark, sf_dir), fixtures.test(spark, sf_dir))
    return training_frame.shuffled_frame(frame).drop("source", "copy_no")
