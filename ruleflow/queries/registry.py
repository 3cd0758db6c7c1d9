"""Query registry and the SQL building blocks that several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ruleflow.fixtures import PREDICTION_SLOTS
from ruleflow.functions.text import NUMBER, WHITESPACE_CODES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


WHITESPACE_SQL = " || ".join(f"chr({code})" for code in WHITESPACE_CODES)


def clean_sql(column: str) -> str:
    return (
        f"trim(replace(replace(replace({column}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(0), ''), "
        f"{WHITESPACE_SQL})"
    )


def label_sql(column: str) -> str:
    return f"CASE WHEN regexp_matches({column}, '{NUMBER}') THEN TRY_CAST(trim({column}) AS DOUBLE) END"


COMMENTS = """WITH f_comments AS (
  SELECT d.doc_id AS row_id,
    CASE d.doc_id % 20 WHEN 0 THEN '  ' || d.text || chr(13) || chr(10)
                       WHEN 1 THEN replace(d.text, chr(10), chr(13) || chr(10))
                       WHEN 2 THEN d.text || chr(0)
                       WHEN 3 THEN '   '
                       WHEN 4 THEN NULL
                       ELSE d.text END AS body,
    d.source AS subreddit,
    'No ' || d.lang || ' posts' AS rule,
    CASE WHEN l.toxic IS NULL THEN NULL WHEN d.doc_id % 50 = 7 THEN 'bad'
         WHEN d.doc_id % 50 = 8 THEN '2' ELSE CAST(l.toxic AS VARCHAR) END AS rule_violation
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

TRAIN = COMMENTS + """, f_train AS (
  SELECT * FROM f_comments
  WHERE rule_violation IS NOT NULL AND substr(md5(CAST(row_id AS VARCHAR)), 1, 1) < 'c')"""

TEST = TRAIN + """, f_pool AS (
  SELECT row_id, rule, rule_violation, body,
    row_number() OVER (PARTITION BY rule, rule_violation ORDER BY md5(CAST(row_id AS VARCHAR)), row_id) - 1 AS idx,
    count(*) OVER (PARTITION BY rule, rule_violation) AS n
  FROM f_train WHERE rule_violation IN ('0', '1')),
f_rows AS (
  SELECT c.row_id, c.body, c.subreddit, c.rule FROM f_comments c
  LEFT JOIN f_train x ON c.row_id = x.row_id WHERE x.row_id IS NULL),
f_sizes AS (
  SELECT rule, max(CASE WHEN rule_violation = '1' THEN n END) AS np,
         max(CASE WHEN rule_violation = '0' THEN n END) AS nn FROM f_pool GROUP BY rule),
f_test AS (
  SELECT t.row_id, t.body, t.subreddit, t.rule,
         p1.body AS positive_example_1, p2.body AS positive_example_2,
         n1.body AS negative_example_1, n2.body AS negative_example_2
  FROM f_rows t LEFT JOIN f_sizes s ON t.rule = s.rule
  LEFT JOIN f_pool p1 ON p1.rule = t.rule AND p1.rule_violation = '1' AND p1.idx = t.row_id % s.np
  LEFT JOIN f_pool p2 ON p2.rule = t.rule AND p2.rule_violation = '1' AND p2.idx = (t.row_id + 1) % s.np
  LEFT JOIN f_pool n1 ON n1.rule = t.rule AND n1.rule_violation = '0' AND n1.idx = t.row_id % s.nn
  LEFT JOIN f_pool n2 ON n2.rule = t.rule AND n2.rule_violation = '0' AND n2.idx = (t.row_id + 1) % s.nn)"""

TRAIN_PAIRS = TEST + """, f_train_pairs AS (
  SELECT t.row_id, t.body, t.subreddit, t.rule, t.rule_violation,
         p1.body AS positive_example_1, p2.body AS positive_example_2,
         n1.body AS negative_example_1, n2.body AS negative_example_2
  FROM (SELECT * FROM f_train WHERE rule_violation IN ('0', '1')) t LEFT JOIN f_sizes s ON t.rule = s.rule
  LEFT JOIN f_pool p1 ON p1.rule = t.rule AND p1.rule_violation = '1' AND p1.idx = t.row_id % s.np AND p1.row_id <> t.row_id
  LEFT JOIN f_pool p2 ON p2.rule = t.rule AND p2.rule_violation = '1' AND p2.idx = (t.row_id + 1) % s.np AND p2.row_id <> t.row_id
  LEFT JOIN f_pool n1 ON n1.rule = t.rule AND n1.rule_violation = '0' AND n1.idx = t.row_id % s.nn AND n1.row_id <> t.row_id
  LEFT JOIN f_pool n2 ON n2.rule = t.rule AND n2.rule_violation = '0' AND n2.idx = (t.row_id + 1) % s.nn AND n2.row_id <> t.row_id)"""

PREDICTIONS = TRAIN + f""", f_rows AS (
  SELECT c.row_id, c.rule FROM f_comments c
  LEFT JOIN f_train x ON c.row_id = x.row_id WHERE x.row_id IS NULL),
f_predictions AS (
  SELECT m.slot, t.row_id, t.rule,
         CAST((t.row_id * (17 + 2 * m.slot) + 31 * m.slot) % 101 AS DOUBLE) / 100 AS rule_violation
  FROM f_rows t, (SELECT unnest({list(PREDICTION_SLOTS)}) AS slot) m)"""

UNPIVOTED = """(
  SELECT positive_example_1 AS body, rule, 1 AS rule_violation, 'test_examples' AS source FROM f_test
  UNION ALL SELECT positive_example_2, rule, 1, 'test_examples' FROM f_test
  UNION ALL SELECT negative_example_1, rule, 0, 'test_examples' FROM f_test
  UNION ALL SELECT negative_example_2, rule, 0, 'test_examples' FROM f_test)"""

CLEAN_FRAME = TEST + f""", f_examples AS {UNPIVOTED},
f_tagged AS (
  SELECT body, rule, rule_violation, 'train' AS source FROM f_train
  UNION ALL SELECT body, rule, CAST(rule_violation AS VARCHAR), source FROM f_examples),
f_cleaned AS (
  SELECT {clean_sql('body')} AS body, {clean_sql('rule')} AS rule, {label_sql('rule_violation')} AS label, source
  FROM f_tagged),
f_unique AS (
  SELECT DISTINCT body, rule, CAST(label AS TINYINT) AS rule_violation, source FROM f_cleaned
  WHERE length(body) > 0 AND length(rule) > 0 AND label IN (0, 1)),
f_frame AS (
  SELECT u.*, c.copy_no FROM f_unique u
  JOIN (SELECT unnest([1, 2]) AS copy_no) c ON c.copy_no = 1 OR u.source = 'test_examples')"""


def order_key_sql(seed: int, columns: tuple[str, ...]) -> str:
    fields = ", ".join(f"coalesce('=' || CAST({c} AS VARCHAR), '-')" for c in columns)
    return f"md5(concat_ws(chr(31), '{seed}', {fields}))"


FRAME_COLUMNS = ("body", "rule", "rule_violation", "source", "copy_no")
