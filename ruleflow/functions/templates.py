"""Prompt, chat and classifier texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Instruction, answers and the text a missing value is rendered as.
INSTRUCTION = "Reddit moderation: Does the comment violate the rule? Answer 'Yes' or 'No' only."
POSITIVE_ANSWER = "Yes"
NEGATIVE_ANSWER = "No"
MISSING_TEXT = "nan"
DEFAULT_SEPARATOR = "</s>"

# The texts around the columns of each template.
MODERATION_PARTS = (INSTRUCTION + "\n\nComment: ", "\n\nRule: ", "\n---\nAnswer:")
COMPLETION_PARTS = ("\n" + INSTRUCTION + "\n\nComment: ", "\n\nrule: ", "\n---\nAnswer:")
USER_TURN_PARTS = ("Comment: ", "\n\nrule: ", "")
PAIR_PARTS = (
    "COMMENT: ", "\nSUBREDDIT: ", "\nRULE: ", "\nVIOLATING EXAMPLES: ", " [SEP] ",
    "\nNON-VIOLATING EXAMPLES: ", " [SEP] ", "",
)

# How each chat family opens a turn per role and closes it. The closing marker of the
# last turn is cut from training text; its length is the tail length of that family.
CHAT_FAMILIES = [
    # family, system opener, user opener, assistant opener, closer
    ("qwen2.5", "<|im_start|>system\n", "<|im_start|>user\n", "<|im_start|>assistant\n", "<|im_end|>\n"),
    ("qwen3", "<|im_start|>system\n", "<|im_start|>user\n",
     "<|im_start|>assistant\n<think>\n\n</think>\n\n", "<|im_end|>\n"),
    ("llama3", "<|start_header_id|>system<|end_header_id|>\n\n", "<|start_header_id|>user<|end_header_id|>\n\n",
     "<|start_header_id|>assistant<|end_header_id|>\n\n", "<|eot_id|>"),
    ("phi4", "<|im_start|>system<|im_sep|>", "<|im_start|>user<|im_sep|>",
     "<|im_start|>assistant<|im_sep|>", "<|im_end|>"),
]
TAIL_LENGTH = {"qwen2.5": 11, "qwen3": 11, "llama3": 10, "phi4": 10}


def _shown(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(MISSING_TEXT))


def _fill(parts: Sequence[str], columns: Sequence[Column]) -> Column:
    """The parts with a column after each but the last."""
    pieces = [piece for pair in zip(map(F.lit, parts), columns) for piece in pair]
    return F.concat(*pieces, F.lit(parts[-1]))


def moderation_prompt(body: Column, rule: Column) -> Column:
    return _fill(MODERATION_PARTS, [_shown(body), _shown(rule)])


def completion_prompt(body: Column, rule: Column) -> Column:
    """The variant used with a separate completion: a leading newline and a lower-case rule header."""
    return _fill(COMPLETION_PARTS, [_shown(body), _shown(rule)])


def pair_text(
    body: Column, rule: Column, subreddit: Column,
    positive_1: Column, positive_2: Column, negative_1: Column, negative_2: Column,
) -> Column:
    """Sectioned text of a comment, its community, its rule and both kinds of examples."""
    columns = (body, subreddit, rule, positive_1, positive_2, negative_1, negative_2)
    return _fill(PAIR_PARTS, [F.coalesce(c, F.lit("")) for c in columns])


def encoder_text(rule: Column, body: Column, separator: str | None = None) -> Column:
    return F.concat(_shown(rule), F.lit(separator or DEFAULT_SEPARATOR), _shown(body))


def verdict(label: Column) -> Column:
    """1 to Yes, 0 to No, anything else NULL."""
    return F.when(label == 1, F.lit(POSITIVE_ANSWER)).when(label == 0, F.lit(NEGATIVE_ANSWER))


def conversation(body: Column, rule: Column, answer: Column | None = None) -> Column:
    """System and user turn, and the assistant's turn when an answer column is given."""

    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    user = _fill(USER_TURN_PARTS, [_shown(body), _shown(rule)])
    turns = [turn("system", F.lit(INSTRUCTION)), turn("user", user)]
    if answer is not None:
        turns.append(turn("assistant", _shown(answer)))
    return F.array(*turns)


def chat_families(spark: SparkSession) -> DataFrame:
    """Dimension table of role markers, one row per family and role (a dozen fixed rows)."""
    rows = [
        (family, role, opener, closer)
        for family, system, user, assistant, closer in CHAT_FAMILIES
        for role, opener in (("system", system), ("user", user), ("assistant", assistant))
    ]
    return spark.createDataFrame(rows, "family string, role string, opener string, closer string")


def serialise_conversation(turns: Column, family: str) -> Column:
    """One string per conversation array, without the closing marker of its last turn."""
    _, system, user, assistant, closer = next(row for row in CHAT_FAMILIES if row[0] == family)

    def piece(turn: Column) -> Column:
        opener = (
            F.when(turn["role"] == "system", F.lit(system))
            .when(turn["role"] == "user", F.lit(user))
            .otherwise(F.lit(assistant))
        )
        return F.concat(opener, turn["content"], F.lit(closer))

    whole = F.concat_ws("", F.transform(turns, piece))
    return F.substring(whole, F.lit(1), F.length(whole) - F.lit(len(closer)))
