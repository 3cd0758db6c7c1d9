from itertools import combinations
from zlib import crc32

import numpy as np
import pytest

from ruleflow.llm import classifier as fm

SF = "/root/testdata/sf0.01"


def random_documents(rng, n):
    sizes = rng.integers(1, 30, n)
    return [
        (np.sort(rng.choice(fm.FEATURES, k, replace=False)).astype(np.int32), rng.random(k).astype(np.float32)) for k in sizes
    ]


def test_linear_time_scores_equal_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    machine = fm.Machine(0.3, rng.normal(size=fm.FEATURES).astype(np.float32), rng.normal(size=(fm.FEATURES, fm.FACTORS)).astype(np.float32))
    documents = random_documents(rng, 20)
    margins, _ = machine.margins(*fm.packed(documents))
    for margin, (features, values) in zip(margins, documents, strict=True):
        pairs = sum(
            float(machine.factors[features[i]] @ machine.factors[features[j]]) * values[i] * values[j]
            for i, j in combinations(range(len(features)), 2)
        )
        assert margin == pytest.approx(0.3 + float(machine.weights[features] @ values) + pairs, rel=1e-3, abs=1e-3)
    again = fm.Machine.unpack(machine.pack())
    assert np.array_equal(again.scores(documents), machine.scores(documents))


def test_fit_learns_an_interaction_that_no_single_feature_shows():
    rng = np.random.default_rng(1)
    documents, labels = [], []
    for _ in range(4000):
        a, b = rng.integers(0, 2, 2)
        documents.append((np.array([a, 2 + b], np.int32), np.ones(2, np.float32)))
        labels.append(float(a == b))
    machine = fm.fit(documents, np.array(labels))
    assert ((machine.scores(documents) >= 0.5) == np.array(labels)).mean() > 0.95


def test_one_class_or_no_rows():
    documents = [(np.array([1], np.int32), np.ones(1, np.float32))]
    assert fm.fit(documents, np.array([1.0])).scores(documents)[0] > 0.5
    assert 0 <= fm.fit([], np.empty(0)).scores(documents)[0] <= 1


@pytest.mark.parametrize("text", ["", "\n", "x", "#" * 10, "A B\nA B\n" * 50, "é日🙂 " * 3])
def test_features_of_odd_texts(text):
    features, values = fm.featurise(text, None)
    assert len(features) == len(set(features.tolist())) and np.isfinite(values).all() and features.max() < fm.FEATURES


def test_held_out_accuracy_and_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "s", None), (10**9, "", "en", "s", None)], docs.schema)
    found = fm.quality_scores(docs.unionByName(odd).withColumn("score", docs.lang), labels).toPandas()
    assert len(found) == docs.count() + 3 and found.score.between(0, 1).all()
    known = found[found.doc_id.notna()]
    assert (known.held_out == [crc32(str(int(i)).encode()) % 4 == 2 for i in known.doc_id]).all()
    assert (found.predicted == (found.score >= 0.7)).all() and not found[found.doc_id.isna()].held_out.any()
    truth = labels.toPandas()
    joined = known[known.held_out].merge(truth, on="doc_id")
    good, bad = joined[joined.quality == 1], joined[joined.quality == 0]
    assert (good.predicted == 1).mean() > 0.95 and (bad.predicted == 0).mean() > 0.7
    assert joined.score[joined.quality == 1].mean() > joined.score[joined.quality == 0].mean() + 0.4


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = [r.doc_id for r in labels.collect() if crc32(str(r.doc_id).encode()) % 4 == 2]
    turned = labels.selectExpr("doc_id", f"if(doc_id in ({','.join(map(str, held))}), 1 - quality, quality) as quality", "toxic")
    assert fm.train(docs, labels).pack() == fm.train(docs, turned).pack()


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert fm.quality_scores(docs, labels).count() == 1
    assert fm.quality_scores(docs.limit(0), labels).count() == 0
