"""From several models' raw scores to a checked submission."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from ruleflow.operators import contracts
from ruleflow.operators.blending import DEFAULT_WEIGHTS, blend
from ruleflow.operators.ranking import rank_within
from ruleflow.storage import materialize


def ensemble(scored: DataFrame, weights: Mapping[int, float] = DEFAULT_WEIGHTS) -> DataFrame:
    """``row_id, rule_violation``: ranks inside (slot, rule), blended over the slots.

    ``scored`` holds ``slot, row_id, rule, rule_violation`` and should be stored.
    """
    ranked = rank_within(scored, group=["slot", "rule"])
    return blend(ranked, weights, score="rank_score")


def submission(blended: DataFrame, sample: DataFrame) -> DataFrame:
    """Check the blend against the sample and put it into the sample's order; raises on the first failed check.

    The blend is stored first, so ranks and weights are worked out once for both.
    """
    stored = materialize(blended, "blended")
    contracts.require_valid(stored, sample.select("row_id"))
    return contracts.restore_order(stored, sample)
