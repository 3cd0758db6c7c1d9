"""Quality rules whose cutoffs are chosen on labelled holdouts so that false rejections stay limited.

A rule rejects a document when a measure exceeds a cutoff. The labelled documents are halved. One half
proposes cutoffs for each stratum and rule: quantiles of the measure among good documents. The other half
tests them, laxest first, with the exact binomial test of "this cutoff rejects more than ``alpha`` of the
good documents", and stops at the first that isn't refuted (fixed-sequence testing, so the cutoffs of one
rule need no further correction). The level is ``delta`` divided by the number of strata and rules
(Bonferroni). With probability ``1 - delta``, every chosen cutoff in every stratum falsely rejects at most
``alpha`` of the good documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleflow.llm.blocks import text_blocks
from ruleflow.storage import Scratch, materialize

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Largest share of good documents that one rule may reject in a stratum, and the chance of any breach.
ALPHA, DELTA = 0.01, 0.05
# Quantiles of the measure among good documents that are proposed as cutoffs.
QUANTILES = tuple(1 - q / 2000 for q in range(21))

METRICS = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"
COUNTS = METRICS.replace(" long", "").replace(" string", "").split(", ")[2:]

# What each rule measures; a document without words has none of it.
RULES = {
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "word_length": ("word_chars", "n_words"),
}

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def repeat_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that is found twice or more in the text, the first one included."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(word, len(number)) for word in words), np.int64, len(words))
    _, pairs = np.unique(ids[:-2] * len(number) + ids[1:-1], return_inverse=True)
    _, window, counts = np.unique(pairs * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[window] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + n] |= again
    return int(covered.sum())


def measure(text: str) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``."""
    words = text.encode().split()
    seen: set[str] = set()
    lines = repeated = 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            lines += 1
            repeated += line in seen
            seen.add(line)
    return (
        len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), repeated, repeat_words(words),
        lines, sum(map(text.count, CAPITALS)),
    )


def metrics(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``METRICS`` of every row; a NULL text has no words, a NULL stratum is one of its own (the empty string)."""

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            found = [measure(text or "") for text in block.column("text").to_pylist()]
            counts = [pa.array(column, pa.int64()) for column in zip(*found, strict=True)]
            columns = [block.column("doc_id"), block.column("stratum"), *counts]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "stratum", *COUNTS])

    rows = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(compute, METRICS)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def measures() -> dict[str, Column]:
    return {rule: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)) for rule, (a, b) in RULES.items()}


def log_binomial_tail(k: int, n: int, p: float) -> float:
    """ln P(X <= k) for X ~ Binomial(n, p), summed exactly from the largest term down."""
    if k >= n:
        return 0.0
    i = np.arange(k + 1)
    steps = np.log(n - i[:-1]) - np.log(i[:-1] + 1) + math.log(p / (1 - p)) if k else np.empty(0)
    terms = n * math.log1p(-p) + np.r_[0.0, np.cumsum(steps)]
    return float(terms.max() + np.log(np.exp(terms - terms.max()).sum()))


def choose(rejected: list[int], n: int, alpha: float, level: float) -> int | None:
    """Index of the strictest cutoff whose risk is refuted to exceed ``alpha``; cutoffs come laxest first."""
    chosen = None
    for i, k in enumerate(rejected):
        if log_binomial_tail(k, n, alpha) > math.log(level):
            break
        chosen = i
    return chosen


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``(stratum, cutoffs map<rule, cutoff>)``; a stratum or rule without a proven cutoff has none.

    ``labels(doc_id, quality)`` with 1 for good; documents with no label, two different ones or one that
    base rules reject are left out. What is gathered is bounded by strata, rules and quantiles.
    """
    good = (
        labels.filter("doc_id is not null and quality is not null")
        .groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        .filter("low = 1 and high = 1").select(F.col("doc_id").cast("long"))
    )
    rules = list(RULES)
    values = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), c.alias("value")) for r, c in measures().items()]))
    labelled = (
        measured.filter(~base_failed()).join(good, "doc_id")
        .withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(2)))
        .select("stratum", "half", values.alias("m")).select("stratum", "half", "m.rule", "m.value")
    )
    proposed = (
        labelled.filter("half = 0").groupBy("stratum", "rule")
        .agg(F.percentile_approx("value", list(QUANTILES), 100_000).alias("proposed"))
    )
    holdout = labelled.filter("half = 1").join(proposed, ["stratum", "rule"])
    counted = holdout.groupBy("stratum", "rule").agg(
        F.count(F.lit(1)).alias("n"), F.first("proposed").alias("proposed"),
        *[F.count_if(F.col("value") > F.col("proposed")[i]).alias(f"k{i}") for i in range(len(QUANTILES))],
    )
    strata = measured.agg(F.count_distinct("stratum")).scalar()
    tested = counted.withColumn("strata", strata)

    def test(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                rejected = [getattr(row, f"k{i}") for i in range(len(QUANTILES))]
                chosen = choose(rejected, row.n, alpha, delta / (max(row.strata, 1) * len(rules)))
                if chosen is not None:
                    rows.append((row.stratum, row.rule, float(row.proposed[chosen])))
            yield pd.DataFrame(rows, columns=["stratum", "rule", "cutoff"])

    chosen = tested.mapInPandas(test, "stratum string, rule string, cutoff double")
    return chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def apply_rules(
    docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA
) -> DataFrame:
    """One row per row of ``docs(doc_id, text, <stratum>)`` with its counts, ``base_failed``, ``failed`` and ``kept``.

    ``failed`` names the rules beyond their cutoffs. A document that base rules reject is not kept, whatever
    the rules say; neither is a NULL or empty text, which has no words. Repeated rows and NULL ids stay.
    """
    with Scratch(docs.sparkSession, "quality-rules") as scratch:
        measured = scratch.store(metrics(docs, stratum), "metrics")
        chosen = scratch.store(cutoffs(measured, labels, alpha, delta), "cutoffs")
        names = [
            F.when(value > F.element_at("cutoffs", rule), F.lit(rule)) for rule, value in measures().items()
        ]
        judged = measured.join(chosen, "stratum", "left").withColumn("failed", F.array_compact(F.array(*names)))
        found = judged.select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            base_failed().alias("base_failed"), (~base_failed() & (F.size("failed") == 0)).alias("kept"),
            "stratum", F.concat_ws(",", "failed").alias("failed_rules"),
        )
        return materialize(found, "quality-rules-result")
