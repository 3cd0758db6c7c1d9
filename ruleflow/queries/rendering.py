"""Text rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleflow import fixtures
from ruleflow.functions import templates as T
from ruleflow.functions.text import to_label
from ruleflow.operators import rendering
from ruleflow.queries.registry import COMMENTS, TEST, label_sql, query


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def shown(column: str) -> str:
    return f"coalesce({column}, '{T.MISSING_TEXT}')"


INSTRUCTION = quoted(T.INSTRUCTION)
NL = "chr(10)"
VERDICT = f"CASE {label_sql('rule_violation')} WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' END"
USER_TURN = f"'Comment: ' || {shown('body')} || {NL} || {NL} || 'rule: ' || {shown('rule')}"
COMPLETION_PROMPT = (
    f"{NL} || {INSTRUCTION} || {NL} || {NL} || 'Comment: ' || {shown('body')} || {NL} || {NL} || 'rule: ' || "
    f"{shown('rule')} || {NL} || '---' || {NL} || 'Answer:'"
)


@query("d1_moderation_prompt", COMMENTS + f"""
SELECT row_id, {INSTRUCTION} || {NL} || {NL} || 'Comment: ' || {shown('body')} || {NL} || {NL} || 'Rule: '
  || {shown('rule')} || {NL} || '---' || {NL} || 'Answer:' AS prompt FROM f_comments""")
def moderation_prompt(spark, sf_dir):
    rows = fixtures.comments(spark, sf_dir)
    return rows.select("row_id", T.moderation_prompt(F.col("body"), F.col("rule")).alias("prompt"))


@query("d2_completion_prompt", COMMENTS + f"""
SELECT row_id, {COMPLETION_PROMPT} AS prompt FROM f_comments""")
def completion_prompt(spark, sf_dir):
    rows = fixtures.comments(spark, sf_dir)
    return rows.select("row_id", T.completion_prompt(F.col("body"), F.col("rule")).alias("prompt"))


PAIR_TEXT = f"""'COMMENT: ' || coalesce(body, '') || {NL} || 'SUBREDDIT: ' || coalesce(subreddit, '') || {NL}
  || 'RULE: ' || coalesce(rule, '') || {NL} || 'VIOLATING EXAMPLES: ' || coalesce(positive_example_1, '')
  || ' [SEP] ' || coalesce(positive_example_2, '') || {NL} || 'NON-VIOLATING EXAMPLES: '
  || coalesce(negative_example_1, '') || ' [SEP] ' || coalesce(negative_example_2, '')"""


@query("d3_pair_text", TEST + f"""
SELECT row_id, {PAIR_TEXT} AS pair_text FROM f_test""")
def pair_text(spark, sf_dir):
    return rendering.with_pair_text(fixtures.test(spark, sf_dir)).select("row_id", "pair_text")


@query("d4_encoder_text", COMMENTS + f"""
SELECT row_id, {shown('rule')} || '</s>' || {shown('body')} AS text FROM f_comments""")
def encoder_text(spark, sf_dir):
    rows = fixtures.comments(spark, sf_dir)
    return rows.select("row_id", T.encoder_text(F.col("rule"), F.col("body")).alias("text"))


@query("d5_verdict", COMMENTS + f"""
SELECT row_id, {VERDICT} AS completion FROM f_comments""")
def verdict(spark, sf_dir):
    rows = fixtures.comments(spark, sf_dir)
    return rows.select("row_id", T.verdict(to_label(F.col("rule_violation"))).alias("completion"))


@query("d6_prompt_completion", COMMENTS + f"""
SELECT row_id, {COMPLETION_PROMPT} AS prompt, {VERDICT} AS completion FROM f_comments""")
def prompt_completion(spark, sf_dir):
    return rendering.prompt_table(fixtures.comments(spark, sf_dir))


@query("d7_conversation", COMMENTS + f""", turns AS (
  SELECT row_id, 0 AS turn, 'system' AS role, {INSTRUCTION} AS content FROM f_comments
  UNION ALL SELECT row_id, 1, 'user', {USER_TURN} FROM f_comments
  UNION ALL SELECT row_id, 2, 'assistant', {shown(f'({VERDICT})')} FROM f_comments)
SELECT row_id, turn, role, content FROM turns""")
def conversation(spark, sf_dir):
    chats = rendering.with_conversation(fixtures.comments(spark, sf_dir))
    return chats.select("row_id", F.posexplode("conversation").alias("turn", "t")).select("row_id", "turn", "t.*")


SERIALISED = " UNION ALL ".join(
    f"SELECT row_id, '{family}' AS family, {quoted(system)} || {INSTRUCTION} || {quoted(closer)} || {quoted(user)} || "
    f"{USER_TURN} || {quoted(closer)} || {quoted(assistant)} || {shown(f'({VERDICT})')} AS text FROM f_comments"
    for family, system, user, assistant, closer in T.CHAT_FAMILIES
)


@query("d8_chat_text", COMMENTS + " " + SERIALISED)
def chat_text(spark, sf_dir):
    chats = rendering.with_conversation(fixtures.comments(spark, sf_dir))
    return rendering.chat_texts(chats).select("row_id", "family", "text")


MARKERS = ", ".join(
    f"({quoted(family)}, {quoted(role)}, {quoted(opener)}, {quoted(closer)})"
    for family, system, user, assistant, closer in T.CHAT_FAMILIES
    for role, opener in (("system", system), ("user", user), ("assistant", assistant))
)


@query("d8_chat_turns", f"""
WITH markers(family, role, opener, closer) AS (VALUES {MARKERS}),
last AS (SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id)
SELECT c.conv_id, c.turn, m.family,
  m.opener || c.text || CASE WHEN c.turn < l.last_turn THEN m.closer ELSE '' END AS piece
FROM conversations c JOIN markers m ON m.role = CASE WHEN c.role IN ('system', 'user') THEN c.role ELSE 'assistant' END
JOIN last l ON c.conv_id = l.conv_id""")
def chat_turns(spark, sf_dir):
    return rendering.chat_turn_pieces(fixtures.table(spark, sf_dir, "conversations"))


@query("d8_chat_turns_roles", f"""
WITH markers(family, role, opener, closer) AS (VALUES {MARKERS}),
c AS (SELECT conv_id, turn, text, CASE WHEN (conv_id + turn) % 5 = 0 THEN 'tool' WHEN (conv_id + turn) % 7 > 0 THEN role END AS role
  FROM conversations),
last AS (SELECT conv_id, max(turn) AS last_turn FROM c GROUP BY conv_id),
named AS (SELECT * FROM c LEFT JOIN (SELECT DISTINCT role AS known FROM markers) k ON c.role = k.known)
SELECT n.conv_id, n.turn, m.family,
  m.opener || n.text || CASE WHEN n.turn < l.last_turn THEN m.closer ELSE '' END AS piece
FROM named n JOIN markers m ON m.role = coalesce(n.known, 'assistant') JOIN last l ON n.conv_id = l.conv_id""")
def chat_turns_roles(spark, sf_dir):
    """Turns with another role or none, the last ones among them."""
    place = F.col("conv_id") + F.col("turn")
    role = F.when(place % 5 == 0, "tool").when(place % 7 > 0, F.col("role"))
    return rendering.chat_turn_pieces(fixtures.table(spark, sf_dir, "conversations").withColumn("role", role))
