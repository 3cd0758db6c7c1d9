"""Token sequences: labels, truncation, batches, padding, shards, batch scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleflow import fixtures
from ruleflow.functions import scores
from ruleflow.functions import sequences as S
from ruleflow.functions import templates as T
from ruleflow.functions.text import WORD, to_label
from ruleflow.operators import batching
from ruleflow.operators.scoring import length_scorer, score_batches, score_in_waves
from ruleflow.queries.registry import COMMENTS, ORACLES, query
from ruleflow.queries.rendering import COMPLETION_PROMPT, VERDICT, shown
from ruleflow.storage import scratch_path

# Token limits for training and scoring, batch sizes.
TRAIN_LIMIT, SCORE_LIMIT = 256, 512
CHAT_BATCH, ENCODER_BATCH = 4, 32


def tokens_sql(text: str) -> str:
    return (
        f"list_transform(regexp_extract_all(lower({text}), '{WORD}'), "
        "lambda w: CAST('0x' || substr(md5(w), 1, 7) AS INTEGER) + 2)"
    )


def text_of(column: str) -> str:
    return f"array_to_string({column}, ' ')"


def filled(value: int, count: str) -> str:
    return f"list_transform(range({count}), lambda i: {value})"


def joined(column: str):
    return F.array_join(column, " ").alias(column)


def supervised(spark, sf_dir, last=None):
    """Prompt and completion ids of all rows with a usable label; ``last`` keeps the end of the prompt."""
    rows = fixtures.comments(spark, sf_dir).withColumn("completion", T.verdict(to_label(F.col("rule_violation"))))
    return rows.dropna(subset=["completion"]).select(
        "row_id",
        S.token_ids(T.completion_prompt(F.col("body"), F.col("rule")), last=last).alias("prompt_ids"),
        S.token_ids(F.col("completion")).alias("completion_ids"),
    )


SUPERVISED = COMMENTS + f""", s AS (
  SELECT row_id, {tokens_sql(COMPLETION_PROMPT)} AS p, {tokens_sql(VERDICT)} AS c FROM f_comments
  WHERE {VERDICT} IS NOT NULL),
q AS (
  SELECT row_id, list_concat(list_concat(p, c), [{S.EOS_ID}]) AS input_ids,
    list_concat(list_concat({filled(S.IGNORED, 'len(p)')}, c), [{S.EOS_ID}]) AS labels FROM s)"""


@query("e1_completion_labels", SUPERVISED + f"""
SELECT row_id, {text_of('input_ids')} AS input_ids, {text_of('labels')} AS labels FROM q""")
def completion_labels(spark, sf_dir):
    p, c = F.col("prompt_ids"), F.col("completion_ids")
    rows = supervised(spark, sf_dir).select(
        "row_id", S.completion_inputs(p, c).alias("input_ids"), S.completion_labels(p, c).alias("labels")
    )
    return rows.select("row_id", joined("input_ids"), joined("labels"))


def truncated(spark, sf_dir):
    p, c = F.col("prompt_ids"), F.col("completion_ids")
    return supervised(spark, sf_dir, TRAIN_LIMIT).select(
        "row_id",
        S.keep_last(S.completion_inputs(p, c), TRAIN_LIMIT).alias("input_ids"),
        S.keep_last(S.completion_labels(p, c), TRAIN_LIMIT).alias("labels"),
    )


LAST = f"greatest(len(input_ids) - {TRAIN_LIMIT} + 1, 1) : len(input_ids)"


@query("e2_left_truncation", SUPERVISED + f"""
SELECT row_id, {text_of(f'input_ids[{LAST}]')} AS input_ids, {text_of(f'labels[{LAST}]')} AS labels FROM q""")
def left_truncation(spark, sf_dir):
    return truncated(spark, sf_dir).select("row_id", joined("input_ids"), joined("labels"))


def batches_sql(source: str, batch_size: int, direction: str) -> str:
    return f"""SELECT *, row_number() OVER (ORDER BY n {direction}, md5(CAST(row_id AS VARCHAR))) - 1 AS position,
    (row_number() OVER (ORDER BY n {direction}, md5(CAST(row_id AS VARCHAR))) - 1) // {batch_size} AS batch_id
  FROM {source}"""


@query("e3_left_padding", SUPERVISED + f""",
t AS (SELECT row_id, input_ids[{LAST}] AS ids, labels[{LAST}] AS labs, least(len(input_ids), {TRAIN_LIMIT}) AS n FROM q),
b AS ({batches_sql('t', CHAT_BATCH, '')}),
w AS (SELECT *, max(n) OVER (PARTITION BY batch_id) AS width FROM b)
SELECT row_id, batch_id, CAST(width AS INTEGER) AS width,
  {text_of(f"list_concat({filled(S.PAD_ID, 'width - n')}, ids)")} AS padded_ids,
  {text_of(f"list_concat({filled(S.IGNORED, 'width - n')}, labs)")} AS padded_labels,
  {text_of(f"list_concat({filled(0, 'width - n')}, {filled(1, 'n')})")} AS attention_mask,
  {text_of(f"list_concat({filled(0, 'width - n')}, range(n))")} AS position_ids
FROM w""")
def left_padding(spark, sf_dir):
    batched = batching.batch_sequences(truncated(spark, sf_dir), "input_ids", CHAT_BATCH, TRAIN_LIMIT)
    padded = batching.pad_left(batched, "input_ids", "labels")
    return padded.select(
        "row_id", "batch_id", "width",
        *[joined(c) for c in ("padded_ids", "padded_labels", "attention_mask", "position_ids")],
    )


def encoder_ids(spark, sf_dir):
    ids = S.token_ids(T.encoder_text(F.col("rule"), F.col("body")), first=SCORE_LIMIT)
    return fixtures.comments(spark, sf_dir).select("row_id", ids.alias("input_ids"))


ENCODER_TOKENS = COMMENTS + f""",
a AS (SELECT row_id, {tokens_sql(f"{shown('rule')} || '</s>' || {shown('body')}")} AS all_ids FROM f_comments),
t AS (SELECT row_id, all_ids[1:{SCORE_LIMIT}] AS ids, least(len(all_ids), {SCORE_LIMIT}) AS n FROM a)"""


@query("e4_right_padding", ENCODER_TOKENS + f""",
b AS ({batches_sql('t', ENCODER_BATCH, 'DESC')}),
w AS (SELECT *, CAST(ceil(max(n) OVER (PARTITION BY batch_id) / 8.0) * 8 AS INTEGER) AS width FROM b)
SELECT row_id, batch_id, width, {text_of(f"list_concat(ids, {filled(S.PAD_ID, 'width - n')})")} AS padded_ids,
  {text_of(f"list_concat({filled(1, 'n')}, {filled(0, 'width - n')})")} AS attention_mask FROM w""")
def right_padding(spark, sf_dir):
    batched = batching.batch_sequences(
        encoder_ids(spark, sf_dir), "input_ids", ENCODER_BATCH, SCORE_LIMIT, descending=True
    )
    padded = batching.pad_right(batched, "input_ids")
    return padded.select("row_id", "batch_id", "width", joined("padded_ids"), joined("attention_mask"))


def chat_lengths(spark, sf_dir):
    """Token counts of comment and rule, which order the batches for scoring."""
    def count(column: str):
        return F.size(F.coalesce(F.regexp_extract_all(F.lower(column), F.lit(WORD), F.lit(0)), F.array()))

    return fixtures.comments(spark, sf_dir).select("row_id", (count("body") + count("rule")).alias("length"))


CHAT_LENGTHS = COMMENTS + f""", t AS (
  SELECT row_id, least(coalesce(len(regexp_extract_all(lower(body), '{WORD}')), 0)
    + len(regexp_extract_all(lower(rule), '{WORD}')), {SCORE_LIMIT}) AS n FROM f_comments)"""


@query("e5_length_batches", CHAT_LENGTHS + f"""
SELECT row_id, CAST(n AS INTEGER) AS capped_length, position, batch_id FROM ({batches_sql('t', CHAT_BATCH, '')})""")
def length_batches(spark, sf_dir):
    placed = batching.length_batches(chat_lengths(spark, sf_dir), "length", CHAT_BATCH, SCORE_LIMIT)
    return placed.select("row_id", "capped_length", "position", "batch_id")


@query("e5_padding_saved", CHAT_LENGTHS + f""",
b AS ({batches_sql('t', CHAT_BATCH, '')}),
r AS (SELECT *, (row_number() OVER (ORDER BY row_id) - 1) // {CHAT_BATCH} AS row_batch_id FROM b),
x AS (SELECT max(n) * count(*) AS padded FROM r GROUP BY batch_id),
y AS (SELECT max(n) * count(*) AS padded FROM r GROUP BY row_batch_id)
SELECT (SELECT count(*) FROM r) AS n_rows, CAST((SELECT sum(n) FROM r) AS BIGINT) AS tokens,
  CAST((SELECT sum(padded) FROM x) AS BIGINT) AS padded_sorted,
  CAST((SELECT sum(padded) FROM y) AS BIGINT) AS padded_unsorted""")
def padding_saved(spark, sf_dir):
    placed = batching.length_batches(chat_lengths(spark, sf_dir), "length", CHAT_BATCH, SCORE_LIMIT)
    return batching.padding_report(batching.row_order_batches(placed.drop("position"), CHAT_BATCH))


@query("e6_round_robin", COMMENTS + """, p AS (
  SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS position FROM f_comments)
SELECT row_id, position, CAST(position % 2 AS INTEGER) AS shard, position // 2 AS shard_position FROM p""")
def round_robin(spark, sf_dir):
    return batching.round_robin(fixtures.comments(spark, sf_dir).select("row_id"), 2)


@query("h4_batch_scoring", COMMENTS + f"""
SELECT row_id, round(1 / (1 + exp(-(-1.0 + 0.001 * length({shown('rule')} || '</s>' || {shown('body')})))), 6) AS p
FROM f_comments""")
def batch_scoring(spark, sf_dir):
    texts = fixtures.comments(spark, sf_dir).select(
        "row_id", T.encoder_text(F.col("rule"), F.col("body")).alias("text")
    )
    scored = score_batches(texts, length_scorer(), batch_size=ENCODER_BATCH)
    return scored.select("row_id", F.round(scores.sigmoid(F.col("logit")), 6).alias("p"))


@query("h4_resumed_scoring", ORACLES["h4_batch_scoring"])
def resumed_scoring(spark, sf_dir):
    """The same scores from a run that ends after its first wave and one that goes on from its ledger."""
    texts = fixtures.comments(spark, sf_dir).select("row_id", T.encoder_text(F.col("rule"), F.col("body")).alias("text"))
    ledger = scratch_path(spark, "scoring-ledger")
    for most_waves in (1, None):
        scored = score_in_waves(texts, length_scorer(), ledger, parts=16, wave=6, batch_size=ENCODER_BATCH, most_waves=most_waves)
    return scored.select("row_id", F.round(scores.sigmoid(F.col("logit")), 6).alias("p"))
