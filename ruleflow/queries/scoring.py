"""Probabilities, ranks, blends, contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleflow import fixtures
from ruleflow.functions import scores
from ruleflow.operators import blending, contracts
from ruleflow.operators.positions import hash_positions
from ruleflow.operators.ranking import rank_within
from ruleflow.plans import ensemble
from ruleflow.queries.registry import PREDICTIONS, query

YES, NO = (0, 1, 2, 3, 4), (5, 6, 7, 8, 9)


def log_sum_exp_sql(values: str) -> str:
    return f"list_max({values}) + ln(list_sum(list_transform({values}, lambda x: exp(x - list_max({values})))))"


@query("h1_verdict_probability", f"""
WITH e AS (SELECT vec_id, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
g AS (SELECT vec_id, {log_sum_exp_sql('v')} AS total, {log_sum_exp_sql('v[1:5]')} AS y, {log_sum_exp_sql('v[6:10]')} AS n
  FROM e)
SELECT vec_id, round(y - total, 6) AS yes_score, round(n - total, 6) AS no_score,
  round(exp(y) / (exp(y) + exp(n)), 6) AS p_yes FROM g""")
def verdict_probability(spark, sf_dir):
    yes, no = scores.verdict_scores(F.col("embedding"), YES, NO)
    rows = fixtures.table(spark, sf_dir, "embeddings").select("vec_id", yes.alias("yes"), no.alias("no"))
    return rows.select(
        "vec_id",
        F.round("yes", 6).alias("yes_score"),
        F.round("no", 6).alias("no_score"),
        F.round(scores.pair_softmax(F.col("yes"), F.col("no")), 6).alias("p_yes"),
    )


@query("h2_pair_softmax", """
SELECT vec_id, round(exp(a) / (exp(a) + exp(b)), 6) AS p_yes FROM (
  SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings)""")
def pair_softmax(spark, sf_dir):
    first, second = (F.get("embedding", F.lit(i)).cast("double") for i in (0, 1))
    rows = fixtures.table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.round(scores.pair_softmax(first, second), 6).alias("p_yes"))


@query("h3_sigmoid", """
SELECT vec_id, round(1 / (1 + exp(-CAST(embedding[1] AS DOUBLE))), 6) AS p FROM embeddings""")
def sigmoid(spark, sf_dir):
    logit = F.get("embedding", F.lit(0)).cast("double")
    return fixtures.table(spark, sf_dir, "embeddings").select("vec_id", F.round(scores.sigmoid(logit), 6).alias("p"))


def rank_sql(source: str, group: str = "slot, rule") -> str:
    usable = "rule IS NOT NULL AND rule_violation IS NOT NULL AND NOT isnan(rule_violation)"
    return f"""SELECT slot, row_id, rule, CASE WHEN {usable} THEN
    (rank() OVER (PARTITION BY {group} ORDER BY rule_violation NULLS LAST) - 1
      + (count(*) OVER (PARTITION BY {group}, rule_violation) - 1) / 2.0)
    / greatest(count(*) OVER (PARTITION BY {group}) - 1, 1) END AS rank_score FROM {source}"""


@query("h5_rank_within_rule", PREDICTIONS + "\n" + rank_sql("f_predictions"))
def rank_within_rule(spark, sf_dir):
    rows = fixtures.predictions(spark, sf_dir)
    return rank_within(rows, group=["slot", "rule"]).drop("rule_violation")


@query("h5_rank_by_ranges", PREDICTIONS + "\n" + rank_sql("f_predictions"))
def rank_by_ranges(spark, sf_dir):
    rows = fixtures.predictions(spark, sf_dir)
    return rank_within(rows, group=["slot", "rule"]).drop("rule_violation")


@query("h5_rank_missing", PREDICTIONS + """, gaps AS (
  SELECT slot, row_id, CASE WHEN row_id % 43 > 0 THEN rule END AS rule,
    CASE WHEN row_id % 41 = 0 THEN NULL WHEN row_id % 37 = 0 THEN CAST('NaN' AS DOUBLE) ELSE rule_violation END
      AS rule_violation FROM f_predictions)
""" + rank_sql("gaps"))
def rank_missing(spark, sf_dir):
    """Scores and rules that are missing here and there; all rows stay."""
    n = F.col("row_id")
    rows = fixtures.predictions(spark, sf_dir).withColumns(
        {
            "rule": F.when(n % 43 > 0, F.col("rule")),
            "rule_violation": F.when(n % 41 == 0, None)
            .when(n % 37 == 0, float("nan"))
            .otherwise(F.col("rule_violation")),
        }
    )
    return rank_within(rows, group=["slot", "rule"]).drop("rule_violation")


def blend_sql(weights: dict[int, float], scale: str, source: str = "f_predictions", score: str = "rule_violation") -> str:
    pairs = ", ".join(f"({slot}, {weight})" for slot, weight in weights.items())
    return f""", weights(slot, w) AS (VALUES {pairs}),
used AS (SELECT p.slot, p.row_id, p.{score} AS score, CAST(w.w AS DOUBLE) AS w FROM {source} p JOIN weights w USING (slot)),
present AS (SELECT sum(w) AS total, count(*) AS slots FROM (SELECT DISTINCT slot, w FROM used))
SELECT row_id, round(sum(w * score) / any_value({scale}), 6) AS rule_violation
FROM used, present GROUP BY row_id HAVING count(*) = any_value(slots)"""


def rounded(df):
    return df.withColumn("rule_violation", F.round("rule_violation", 6))


@query("h6_weighted_blend", PREDICTIONS + blend_sql(blending.DEFAULT_WEIGHTS, "total"))
def weighted_blend(spark, sf_dir):
    return rounded(blending.blend(fixtures.predictions(spark, sf_dir))).orderBy("row_id")


@query("h6_blend_incomplete", PREDICTIONS + """, gaps AS (
  SELECT * FROM f_predictions WHERE slot < 7 OR row_id % 13 > 0)""" + blend_sql(blending.DEFAULT_WEIGHTS, "total", "gaps"))
def blend_incomplete(spark, sf_dir):
    """One model lacks some ids, so the blend lacks them too."""
    rows = fixtures.predictions(spark, sf_dir).filter("slot < 7 OR row_id % 13 > 0")
    return rounded(blending.blend(rows)).orderBy("row_id")


@query("h7_raw_blend", PREDICTIONS + blend_sql(blending.RAW_WEIGHTS, "1.0"))
def raw_blend(spark, sf_dir):
    rows = fixtures.predictions(spark, sf_dir)
    return rounded(blending.blend(rows, blending.RAW_WEIGHTS, normalize=False)).orderBy("row_id")


@query("h7_raw_blend_seven", PREDICTIONS + blend_sql(blending.RAW_WEIGHTS_SEVEN, "1.0"))
def raw_blend_seven(spark, sf_dir):
    rows = fixtures.predictions(spark, sf_dir)
    return rounded(blending.blend(rows, blending.RAW_WEIGHTS_SEVEN, normalize=False)).orderBy("row_id")


def doubled(spark, sf_dir):
    """All predictions, and some of slot 3 a second time."""
    rows = fixtures.predictions(spark, sf_dir)
    return rows.unionByName(rows.filter("slot = 3 AND row_id % 97 = 0"))


HIGH_SLOTS = PREDICTIONS + """, far AS (
  SELECT CASE slot WHEN 1 THEN 6 WHEN 2 THEN 64 WHEN 3 THEN 70 WHEN 4 THEN -1 ELSE slot END AS slot, row_id, rule_violation
  FROM f_predictions WHERE slot < 5 AND (slot < 3 OR row_id % 11 > 0))"""
FAR_WEIGHTS = {6: 0.4, 64: 0.3, 70: 0.2, -1: 0.2}


def far_slots(spark, sf_dir):
    """Predictions whose slots are far apart and below zero; two of them lack some ids."""
    rows = fixtures.predictions(spark, sf_dir).filter("slot < 5 AND (slot < 3 OR row_id % 11 > 0)")
    return rows.replace({1: 6, 2: 64, 3: 70, 4: -1}, subset=["slot"])


@query("h6_blend_high_slots", HIGH_SLOTS + blend_sql(FAR_WEIGHTS, "total", "far"))
def blend_high_slots(spark, sf_dir):
    return rounded(blending.blend(far_slots(spark, sf_dir), FAR_WEIGHTS)).orderBy("row_id")


@query("h8_incomplete_high_slots", HIGH_SLOTS + """
SELECT row_id, count(DISTINCT slot) AS slots_held FROM far GROUP BY row_id HAVING count(DISTINCT slot) < 4""")
def incomplete_high_slots(spark, sf_dir):
    return contracts.incomplete_ids(far_slots(spark, sf_dir))


@query("h8_repeated_ids", PREDICTIONS + """, doubled AS (
  SELECT * FROM f_predictions UNION ALL SELECT * FROM f_predictions WHERE slot = 3 AND row_id % 97 = 0)
SELECT slot, row_id, count(*) AS copies FROM doubled GROUP BY slot, row_id HAVING count(*) > 1""")
def repeated_ids(spark, sf_dir):
    return contracts.repeated_ids(doubled(spark, sf_dir))


@query("h8_incomplete_ids", PREDICTIONS + """, gaps AS (
  SELECT * FROM f_predictions WHERE slot < 7 OR row_id % 13 > 0)
SELECT row_id, count(DISTINCT slot) AS slots_held FROM gaps GROUP BY row_id
HAVING count(DISTINCT slot) < (SELECT count(DISTINCT slot) FROM gaps)""")
def incomplete_ids(spark, sf_dir):
    return contracts.incomplete_ids(fixtures.predictions(spark, sf_dir).filter("slot < 7 OR row_id % 13 > 0"))


def first_model(spark, sf_dir):
    return fixtures.predictions(spark, sf_dir).filter("slot = 1").select("row_id", "rule_violation")


def sample(spark, sf_dir):
    """Expected ids in an order of their own, as a sample file would give them."""
    keyed = fixtures.unlabelled(spark, sf_dir).select("row_id", F.md5(F.col("row_id").cast("string")).alias("key"))
    return hash_positions(keyed, "key").select("row_id", F.col("position").alias("ord"))


FAULTY = PREDICTIONS + """, m AS (SELECT row_id, rule_violation FROM f_predictions WHERE slot = 1),
faulty AS (
  SELECT row_id, CASE WHEN row_id % 101 = 0 THEN NULL WHEN row_id % 103 = 0 THEN 1.5 ELSE rule_violation END
    AS rule_violation FROM m WHERE row_id % 89 > 0
  UNION ALL SELECT row_id, rule_violation FROM m WHERE row_id % 97 = 0)"""


def faulty(spark, sf_dir):
    """A submission with lost, repeated, missing and out-of-range predictions put in."""
    rows, n = first_model(spark, sf_dir), F.col("row_id")
    changed = F.when(n % 101 == 0, None).when(n % 103 == 0, 1.5).otherwise(F.col("rule_violation"))
    return (
        rows.filter(n % 89 > 0).withColumn("rule_violation", changed).unionByName(rows.filter(n % 97 == 0))
    )


CHECKED = FAULTY + """, ids AS (SELECT row_id, count(*) AS c FROM faulty GROUP BY row_id),
counts AS (
  SELECT 1 AS ordinal, 'columns' AS "check", CAST(0 AS BIGINT) AS violations
  UNION ALL SELECT 2, 'row_count', abs((SELECT count(*) FROM faulty) - (SELECT count(*) FROM m))
  UNION ALL SELECT 3, 'id_set', (SELECT count(*) FROM ids FULL JOIN m ON ids.row_id = m.row_id
    WHERE ids.row_id IS NULL OR m.row_id IS NULL)
  UNION ALL SELECT 4, 'duplicates', (SELECT CAST(sum(c - 1) AS BIGINT) FROM ids)
  UNION ALL SELECT 5, 'finite', (SELECT count(*) FROM faulty WHERE rule_violation IS NULL)
  UNION ALL SELECT 6, 'range', (SELECT count(*) FROM faulty WHERE rule_violation < 0 OR rule_violation > 1))"""


@query("h9_submission_checks", CHECKED + """
SELECT ordinal, "check", violations, violations = 0 AS passed FROM counts""")
def submission_checks(spark, sf_dir):
    return contracts.check_submission(faulty(spark, sf_dir), sample(spark, sf_dir))


@query("h9_failed_checks", CHECKED + """
SELECT ordinal, "check", violations FROM counts WHERE violations > 0""")
def failed_checks(spark, sf_dir):
    return contracts.failed_checks(faulty(spark, sf_dir), sample(spark, sf_dir))


@query("h10_restore_order", PREDICTIONS + """
SELECT row_number() OVER (ORDER BY md5(CAST(row_id AS VARCHAR))) - 1 AS ord, row_id, rule_violation
FROM f_predictions WHERE slot = 1""")
def restore_order(spark, sf_dir):
    return contracts.restore_order(first_model(spark, sf_dir), sample(spark, sf_dir))


RANKED = PREDICTIONS + ", ranked AS (" + rank_sql("f_predictions") + ")"


@query("j3_rank_blend", RANKED + blend_sql(blending.DEFAULT_WEIGHTS, "total", "ranked", "rank_score"))
def rank_blend(spark, sf_dir):
    return rounded(ensemble.ensemble(fixtures.predictions(spark, sf_dir))).orderBy("row_id")
