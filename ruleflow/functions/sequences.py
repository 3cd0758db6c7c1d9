"""Token-array columns: labels, truncation, padding, masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ruleflow.functions.text import words

# Label of positions outside the loss, and the two reserved ids.
IGNORED = -100
PAD_ID = 0
EOS_ID = 1


def token_ids(text: Column, first: int | None = None, last: int | None = None) -> Column:
    """Default tokenizer: word hashes of 28 bits, above the reserved ids. Any array<int> column works instead.

    ``first`` or ``last`` keep that many words; words outside are never hashed.
    """
    tokens = words(F.lower(text))
    if first is not None:
        tokens = keep_first(tokens, first)
    if last is not None:
        tokens = keep_last(tokens, last)
    return F.transform(tokens, lambda w: F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("int") + F.lit(2))


def completion_inputs(prompt_ids: Column, completion_ids: Column) -> Column:
    return F.concat(prompt_ids, completion_ids, F.array(F.lit(EOS_ID)))


def completion_labels(prompt_ids: Column, completion_ids: Column) -> Column:
    """Loss only on the completion and the end marker."""
    ignored = F.array_repeat(F.lit(IGNORED), F.size(prompt_ids))
    return F.concat(ignored, completion_ids, F.array(F.lit(EOS_ID)))


def keep_last(ids: Column, n: int) -> Column:
    return F.slice(ids, F.greatest(F.size(ids) - F.lit(n - 1), F.lit(1)), F.lit(n))


def keep_first(ids: Column, n: int) -> Column:
    return F.slice(ids, F.lit(1), F.lit(n))


def pad_left(ids: Column, width: Column, fill: int) -> Column:
    return F.concat(F.array_repeat(F.lit(fill), (width - F.size(ids)).cast("int")), ids)


def pad_right(ids: Column, width: Column, fill: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(fill), (width - F.size(ids)).cast("int")))


def ones(ids: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(ids))


def left_position_ids(ids: Column, width: Column) -> Column:
    """0 on the padding, then 0, 1, 2, ... on the tokens."""
    running = F.when(F.size(ids) > 0, F.sequence(F.lit(0), F.size(ids) - 1)).otherwise(F.array().cast("array<int>"))
    return pad_left(running, width, 0)


def round_up(length: Column, multiple: int) -> Column:
    return (F.ceil(length / F.lit(multiple)) * F.lit(multiple)).cast("int")
