"""Run a registered query and its SQL on the same files and compare rows.

``python -m tests.oracle <sf_dir> [name ...]`` prints one line per query.
"""

from __future__ import annotations

import sys
import time

import duckdb
import numpy as np
import pandas as pd

from ruleflow.queries import ORACLES, QUERIES
from ruleflow.storage import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def expected(sf_dir: str, sql: str) -> pd.DataFrame:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection.execute(sql).df()


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    frame = frame.astype(object).where(frame.notna(), None)
    frame = frame.map(lambda v: repr(float(v)) if isinstance(v, (float, np.floating)) else None if v is None else str(v))
    return frame.sort_values(list(frame.columns), na_position="first").reset_index(drop=True)


def differences(actual: pd.DataFrame, wanted: pd.DataFrame) -> str | None:
    if sorted(actual.columns) != sorted(wanted.columns):
        return f"columns {sorted(actual.columns)} != {sorted(wanted.columns)}"
    if len(actual) != len(wanted):
        return f"rows {len(actual)} != {len(wanted)}"
    kinds = {c: (actual[c].dtype, wanted[c].dtype) for c in actual.columns}
    mixed = {c: k for c, k in kinds.items() if k[0] != k[1] and len(actual)}
    if mixed:
        return f"types {mixed}"
    left, right = canonical(actual), canonical(wanted)
    wrong = (left != right) & ~(left.isna() & right.isna())
    if wrong.any().any():
        row = wrong.any(axis=1).idxmax()
        return f"{int(wrong.any(axis=1).sum())} rows differ, first: {str(left.loc[row].to_dict())[:600]} / {str(right.loc[row].to_dict())[:600]}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in names or list(QUERIES):
        start = time.time()
        try:
            actual = QUERIES[name](spark, sf_dir).toPandas()
            took = time.time() - start
            problem = differences(actual, expected(sf_dir, ORACLES[name])) if name in ORACLES else "(no SQL)"
        except Exception as error:  # noqa: BLE001
            actual, took, problem = [], time.time() - start, f"{type(error).__name__}: {str(error)[:1500]}"
        total = time.time() - start
        failed += problem not in (None, "(no SQL)")
        print(f"{name:32} {len(actual):8} rows {took:6.1f}s (all {total:5.1f}s) {problem or 'ok'}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
