"""Registered queries, each next to the SQL that must give the same rows."""

from ruleflow.queries import cleaning, features, files, modeling, profiling, rendering, scoring, sequences  # noqa: F401
from ruleflow.queries.registry import ORACLES, QUERIES  # noqa: F401
