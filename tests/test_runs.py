"""Published runs, restartable scoring, balanced hold-outs and centroid similarity."""

import os
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ruleflow.operators import folds, scoring, similarity
from ruleflow.sources import publishing, sinks


def scores(spark):
    return spark.createDataFrame([(1, 0.25), (2, 0.5), (3, None)], "row_id long, rule_violation double")


def test_published_run_is_whole(spark, tmp_path):
    target = f"{tmp_path}/run"
    facts = spark.createDataFrame([(7,)], "train_rows long")
    outputs = {"submission.csv": (scores(spark), sinks.write_submission), "copy": (scores(spark), lambda df, path: df.write.parquet(path))}
    publishing.publish_run(target, outputs, facts, model_id="m", model_revision=None, seed=5)
    row = spark.read.json(f"{target}/{publishing.MANIFEST}").first()
    assert (row.model_id, row.seed, row.model_saved, row.train_rows) == ("m", 5, True, 7)
    assert [f.n for f in row.files] == [3, 3] and row.files[0].digest == row.files[1].digest
    assert spark.read.parquet(f"{target}/copy").count() == 3
    assert os.listdir(tmp_path) == ["run"]
    with pytest.raises(FileExistsError):
        publishing.publish_run(target, outputs, facts, model_id="m", model_revision=None, seed=5)


def test_run_stopped_midway_leaves_nothing(spark, tmp_path):
    target = f"{tmp_path}/run"

    def broken(df, path):
        raise RuntimeError("stopped")

    facts = spark.createDataFrame([(7,)], "train_rows long")
    outputs = {"submission.csv": (scores(spark), sinks.write_submission), "oof": (scores(spark), broken)}
    with pytest.raises(RuntimeError, match="stopped"):
        publishing.publish_run(target, outputs, facts, model_id="m", model_revision="r", seed=5)
    assert os.listdir(tmp_path) == []
    with pytest.raises(ValueError, match="manifest"), publishing.Publication(spark, target) as run:
        run.write(scores(spark), "submission.csv", sinks.write_submission)
    assert os.listdir(tmp_path) == []


def test_digest_tells_contents_apart(spark):
    def digest(rows):
        return tuple(spark.createDataFrame(rows, "a string, b double").agg(*publishing.content_digest(spark.createDataFrame(rows, "a string, b double"))).first())

    assert digest([("x", 1.0), ("y", 2.0)]) == digest([("y", 2.0), ("x", 1.0)])
    others = [[("x", 1.0), ("y", 2.1)], [(None, 1.0), ("y", 2.0)], [("-", 1.0), ("y", 2.0)], [("x", 1.0)], []]
    assert len({digest(rows) for rows in [[("x", 1.0), ("y", 2.0)], *others]}) == 6


def test_stopped_scoring_goes_on_behind_its_ledger(spark, tmp_path):
    calls = f"{tmp_path}/calls"
    os.mkdir(calls)

    def load(fails):
        def scorer(texts: pd.Series) -> pd.Series:
            if fails and "t90" in set(texts):
                raise RuntimeError("lost")
            for text in texts:
                with open(f"{calls}/{text}", "a") as file:
                    file.write("x")
            return texts.map(lambda t: float(zlib.crc32(t.encode()) % 97))

        return lambda: scorer

    df = spark.createDataFrame([(i, f"t{i}") for i in range(100)] + [(None, "none")], "row_id long, text string")
    ledger = f"{tmp_path}/ledger"
    with pytest.raises(Exception, match="lost"):
        scoring.score_in_waves(df, load(True), ledger, parts=10, wave=2, batch_size=4)
    finished = scoring.finished_parts(spark, ledger)
    first = {name for name in os.listdir(calls)}
    assert 0 < len(finished) < 10
    found = {r.row_id: r.logit for r in scoring.score_in_waves(df, load(False), ledger, parts=10, wave=2, batch_size=4).collect()}
    assert found == {r.row_id: float(zlib.crc32(r.text.encode()) % 97) for r in df.collect()}
    part = F.pmod(F.xxhash64("row_id"), F.lit(10)).cast("int")
    kept = {r.text for r in df.withColumn("p", part).collect() if r.p in finished}
    assert kept <= first and all(os.path.getsize(f"{calls}/{t}") == 1 for t in kept)
    before = {t: os.path.getsize(f"{calls}/{t}") for t in os.listdir(calls)}
    scoring.score_in_waves(df, load(False), ledger, parts=10, wave=2).collect()
    assert before == {t: os.path.getsize(f"{calls}/{t}") for t in os.listdir(calls)}


@pytest.mark.parametrize("limits", [{}, {"largest": 3, "classes": 50}])
def test_group_folds_are_whole_and_balanced(spark, limits):
    rng = random.Random(1)
    sizes = [rng.randint(1, 30) for _ in range(40)] + [200]
    rows = [(f"g{g}" if g else None,) for g, n in enumerate(sizes) for _ in range(n)]
    dealt = folds.balanced_group_folds(spark.createDataFrame(rows, "name string"), 4, 3, "name", **limits)
    counts = dealt.groupBy("name", "fold").count().collect()
    assert len(counts) == len(sizes) and sum(r["count"] for r in counts) == len(rows)
    loads = [sum(r["count"] for r in counts if r.fold == f) for f in range(4)]
    assert min(loads) > 0 and max(loads) <= max(200, sum(sizes) / 4 + (30 if not limits else 120))
    again = folds.balanced_group_folds(spark.createDataFrame(rows[::-1], "name string"), 4, 3, "name", **limits)
    assert {(r.name, r.fold) for r in counts} == {(r.name, r.fold) for r in again.distinct().collect()}


def test_four_groups_fill_four_folds(spark):
    rows = [(g,) for g, n in (("a", 5), ("b", 5), ("c", 1), ("d", 90)) for _ in range(n)]
    dealt = folds.balanced_group_folds(spark.createDataFrame(rows, "name string"), 4, 0, "name")
    assert {(r.name, r.fold) for r in dealt.distinct().collect()} == {("d", 0), ("a", 1), ("b", 2), ("c", 3)}


def test_leaks_are_near_equal_texts_of_several_folds(spark):
    rows = [("Same, text!", 0), ("same text", 1), ("other", 0), ("OTHER", 0), ("...", 0), ("!", 1), (None, 2)]
    found = folds.shared_across_folds(spark.createDataFrame(rows, "body string, fold int"), "body").collect()
    assert [(r.folds, r.n) for r in found] == [(2, 2)]


def test_centroid_similarity_leaves_the_row_out(spark):
    rng = np.random.default_rng(2)
    rows = [(i, ["a", "b", None][i % 3], [0, 1, None][i % 4 % 3], rng.normal(size=3).tolist()) for i in range(40)]
    rows += [(100, "c", 1, [1.0, 0.0, 0.0]), (101, "c", 0, [0.0, 0.0, 0.0]), (102, "c", 0, None)]
    df = spark.createDataFrame(rows, "row_id long, rule string, y int, v array<double>")
    found = {r.row_id: (r.similarity_positive, r.similarity_negative) for r in similarity.centroid_similarity(df, "v", "rule", "y").collect()}
    for i, rule, _, v in rows:
        for side, y in enumerate((1, 0)):
            if v is None:
                assert found[i][side] is None
                continue
            others = [np.array(w) for j, r, z, w in rows if r == rule and z == y and j != i and w is not None]
            total = np.sum(others, axis=0) if others else np.zeros(3)
            length = np.linalg.norm(total) * np.linalg.norm(v)
            assert found[i][side] == pytest.approx(float(total @ v / length) if length > 1e-12 else 0.0, abs=1e-9)
