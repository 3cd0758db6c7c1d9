"""N-grams, vocabulary, TF-IDF, folds by subtraction, classifier and calibration against brute force."""

import math
import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ruleflow.functions.text import strip_accents_py
from ruleflow.operators import calibration, features, linear, similarity, terms
from ruleflow.plans import baseline
from ruleflow.queries import QUERIES

TEXTS = [
    "Buy my course! Buy MY course at http://x.y", "a b cd  ef\tgh\n\nij", "", "éé Éé naïve ﬁne", "one",
    "x", "under_score 42 ½", "　wide space here ", "같은 단어 같은", "!!! ???",
]


def python_words(text):
    text = strip_accents_py(text.lower())
    cleaned = "".join(c if c == "_" or c.isalnum() else " " for c in text)
    tokens = [t for t in cleaned.split(" ") if len(t) > 1]
    return Counter(tokens + [" ".join(pair) for pair in zip(tokens, tokens[1:])])


def python_chars(text):
    grams = Counter()
    for word in strip_accents_py(text.lower()).split():
        padded = f" {word} "
        for size in (3, 4, 5):
            grams.update(padded[i : i + size] for i in range(len(padded) - size + 1))
    return grams


def as_counter(rows):
    return {(r.row_id, r.term): r.tf for r in rows}


@pytest.mark.parametrize("count, brute", [(features.word_counts, python_words), (features.char_counts, python_chars)])
def test_ngrams_equal_brute_force(spark, count, brute):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "row_id long, text string")
    got = as_counter(count(features.folded_rows(df, "text")).collect())
    assert got == {(i, term): n for i, text in enumerate(TEXTS) for term, n in brute(text).items()}


def test_ngrams_need_one_exchange(spark):
    """The text moves once; making and counting the n-grams moves nothing."""
    df = spark.createDataFrame(list(enumerate(TEXTS)), "row_id long, text string")
    counted = features.term_counts(df, "text").groupBy("row_id", "block").count()
    plan = counted._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert all("REPARTITION_BY_NUM" in line or "block" in line for line in moved)


def test_stored_counts_are_grouped_by_row_without_an_exchange(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "row_id long, text string")
    counts = features.stored_counts(df, "text")
    kept = features.prune_vocabulary(features.term_statistics(counts), len(TEXTS), features.CHAR_BLOCK)
    weights = features.tfidf_weights(counts, kept, len(TEXTS))
    plan = weights._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(row_id" not in plan and "Python" not in plan and "Arrow" not in plan
    assert as_counter(counts.filter("block = 'word'").collect()) == as_counter(features.word_counts(features.folded_rows(df, "text")).collect())


def corpus(spark, rows=60, seed=5):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = [" ".join(random.choices(vocabulary, weights=range(1, 41), k=random.randrange(3, 15))) for _ in range(rows)]
    return texts, spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")


def brute_vocabulary(texts, block, brute):
    counts = [brute(t) for t in texts]
    df, tf = Counter(), Counter()
    for c in counts:
        df.update(c.keys())
        tf.update(c)
    kept = [t for t in df if df[t] >= block.min_df and df[t] <= block.max_df * len(texts)]
    return sorted(kept, key=lambda t: (-tf[t], t))[: block.max_features], df, tf


@pytest.mark.parametrize("cap", [1, 7, 50, 100_000])
def test_vocabulary_limits_and_ties(spark, cap):
    texts, df = corpus(spark)
    block = replace(features.WORD_BLOCK, max_features=cap, max_df=0.5)
    stats = features.term_statistics(features.term_counts(df, "text")).cache()
    got = features.prune_vocabulary(stats, len(texts), block).collect()
    wanted, rows, occurrences = brute_vocabulary(texts, block, python_words)
    assert [r.term for r in got] == wanted
    assert all((r.df, r.tf) == (rows[r.term], occurrences[r.term]) for r in got)


def test_tfidf_equals_brute_force(spark):
    texts, df = corpus(spark)
    counts = features.term_counts(df, "text").filter("block = 'word'")
    stats = features.term_statistics(counts).cache()
    kept = features.prune_vocabulary(stats, len(texts), features.WORD_BLOCK)
    got = {(r.row_id, r.term): r.weight for r in features.tfidf_weights(counts, kept, len(texts)).collect()}
    terms, rows, _ = brute_vocabulary(texts, features.WORD_BLOCK, python_words)
    wanted = {}
    for i, text in enumerate(texts):
        raw = {
            t: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + rows[t])) + 1)
            for t, n in python_words(text).items() if t in terms
        }
        length = math.sqrt(sum(v * v for v in raw.values()))
        wanted.update({(i, t): v / length for t, v in raw.items()})
    assert got.keys() == wanted.keys()
    assert all(got[k] == pytest.approx(wanted[k]) for k in wanted)


@pytest.fixture(scope="module")
def labelled(spark):
    random.seed(11)
    texts, _ = corpus(spark, 90, 11)
    rows = [(i * 7, int("w1 " in t + " " or random.random() < 0.3), t) for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "row_id long, label int, text string")


@pytest.fixture(scope="module")
def prepared(labelled):
    return baseline.prepare(labelled[1])


def test_fold_statistics_by_subtraction(prepared):
    for held in (0, 3):
        stats, rows = baseline.training_statistics(prepared, held)
        direct = features.term_statistics(features.term_counts(prepared.texts.filter(F.col("fold") != held), "text"))
        got = {(r.block, r.term): (r.df, r.tf) for r in stats.filter("df > 0").collect()}
        assert got == {(r.block, r.term): (r.df, r.tf) for r in direct.collect()}
        assert rows == prepared.rows.filter(F.col("fold") != held).count()


def test_inner_folds_renumber_the_remaining_rows(prepared):
    for held in (None, 0, 2, 4):
        rows = prepared.rows.withColumn("inner", baseline.inner_fold(prepared, held)).collect()
        for label in (0, 1):
            left = sorted((r.position, r.inner) for r in rows if r.label == label and r.fold != held)
            assert [inner for _, inner in left] == [i % 3 for i in range(len(left))]


def newton(x, y, weight, penalty, steps=60):
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        w -= np.linalg.solve(hessian, gradient)
    return w


def dense(rows, size):
    x = np.zeros((len(rows), size))
    for i, r in enumerate(rows):
        x[i, r["indices"]] = r["values"]
    return x


@pytest.fixture(scope="module")
def whole(prepared):
    kept = baseline.space(prepared, [None])
    return kept, baseline.stored_vectors(prepared, kept)


@pytest.mark.parametrize("task_cells", [linear.TASK_CELLS, 2_000])
def test_classifier_minimises_the_balanced_objective(prepared, whole, task_cells):
    """In one task, and in several that add up their changes."""
    kept, stored = whole
    costs = baseline.balanced_costs(prepared.rows, [F.lit(True)])
    fitted = linear.fit(stored, [costs], [kept.design(0, 1)], task_cells=task_cells)[0]
    rows = linear.weighed(stored, fitted.design).collect()
    x, y = dense(rows, len(fitted.coefficients)), np.array([r["label"] for r in rows])
    balance = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    exact = newton(x, y, linear.STRENGTH * balance, np.ones(x.shape[1]))
    assert np.linalg.norm(fitted.coefficients[:, 0] - exact) <= fitted.bound[0] + 1e-9
    assert fitted.bound[0] <= (linear.TOLERANCE if task_cells == linear.TASK_CELLS else linear.SHARED_TOLERANCE)


def test_models_fitted_together_equal_separate_fits(prepared):
    held_out = [None, 1, 3]
    kept = baseline.space(prepared, held_out)
    stored = baseline.stored_vectors(prepared, kept)
    together, _ = baseline.fit_calibrated(prepared, held_out, kept, stored)
    for number, held in enumerate(held_out):
        alone = baseline.space(prepared, [held])
        own, margins = baseline.fit_calibrated(prepared, [held], alone, baseline.stored_vectors(prepared, alone))
        left = linear.margins(stored, together[number].fitted).select("row_id", "margins").collect()
        right = {r["row_id"]: r["margins"] for r in margins.collect()}
        assert all(np.allclose(r["margins"], right[r["row_id"]], atol=1e-4) for r in left)
        for a, b in zip(together[number].sigmoids, own[0].sigmoids, strict=True):
            assert (a.slope, a.intercept) == pytest.approx((b.slope, b.intercept), abs=1e-4)


def test_bound_holds_for_a_fit_that_stops_early(prepared, whole):
    kept, stored = whole
    costs = baseline.balanced_costs(prepared.rows, [F.lit(True)])
    rough = linear.fit(stored, [costs], [kept.design(0, 1)], tolerance=0.5)[0]
    fine = linear.fit(stored, [costs], [kept.design(0, 1)])[0]
    distance = np.linalg.norm(rough.coefficients - fine.coefficients)
    assert 1e-6 < distance <= rough.bound[0] + fine.bound[0] and rough.bound[0] <= 0.5


def test_vectors_have_unit_blocks_and_the_constant(whole):
    kept, stored = whole
    rows = linear.weighed(stored, kept.design(0, 1)).collect()
    words = len(kept.terms["word"])
    for x in dense(rows, len(kept.factors[0]) + 1):
        assert x[-1] == 1.0
        assert np.linalg.norm(x[:words]) == pytest.approx(1.0)
        assert np.linalg.norm(x[words:-1]) == pytest.approx(1.0)


def test_vectors_equal_the_long_table(spark, labelled, prepared, whole):
    """Weights from Arrow batches and from n-grams as rows."""
    kept, stored = whole
    counts = features.term_counts(labelled[1], "text")
    vocabulary = baseline.vocabularies(prepared, [None]).drop("held_out")
    long = {(r.row_id, r.block, r.term): r.weight for r in features.tfidf_weights(counts, vocabulary, baseline.training_rows(prepared, None)).collect()}
    names = [(b, t) for b in ("word", "char") for t in kept.terms[b]]
    found = {(r.row_id, *names[i]): v for r in linear.weighed(stored, kept.design(0, 1)).collect() for i, v in zip(r["indices"][:-1], r["values"], strict=False)}
    assert found.keys() == long.keys() and all(found[k] == pytest.approx(long[k]) for k in long)


@pytest.mark.parametrize("block, brute", [("word", python_words), ("char", python_chars)])
def test_rows_of_terms_equal_brute_force(spark, block, brute):
    df = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "row_id long, text string")
    rows = terms.analysed(df, "text")
    wanted = {(i, term): n for i, text in enumerate(TEXTS) for term, n in brute(text).items()}
    assert as_counter(terms.row_counts(rows, block).collect()) == wanted
    sums = {r.row_id: (r.terms, r.grams, r.checksum) for r in terms.char_sums(rows, len).collect()}
    counts = {i: python_chars(t) for i, t in enumerate(TEXTS)}
    assert sums == {i: (len(c), sum(c.values()), sum(len(t) * n for t, n in c.items())) for i, c in counts.items() if c}


def test_a_task_sends_terms_in_small_batches():
    """What a task holds and sends does not grow with the terms that it has met."""
    texts = [[f"w{i}x{j}" for j in range(3000)] for i in range(100)]
    rows = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([0, 1] * 50)], names=["tokens", "fold"])
    found = list(terms.add_up(2, ["word"], 1 << 18)([rows]))
    assert sum(b.num_rows for b in found) == 100 * 5999 and max(b.num_rows for b in found) <= 1 << 16


def test_similarity_stores_no_ngrams(spark, monkeypatch):
    monkeypatch.setattr(features, "stored_counts", None)
    df = spark.createDataFrame([(1, "red green", "red"), (2, "red green", "red green")], "row_id long, body string, rule string")
    monkeypatch.setattr(similarity, "WORD_BLOCK", replace(features.WORD_BLOCK, max_df=1.0))
    got = {r.row_id: r.similarity_rule for r in similarity.similarity_features(df, ["body", "rule"]).collect()}
    assert got[2] == pytest.approx(1.0) and got[1] == pytest.approx(3**-0.5)


def test_finished_models_ask_for_no_more_passes(spark, monkeypatch):
    """One job serves all designs, and a model that is done from the start does not keep the others' steps going."""
    passes, add_up = [], linear.add_up
    monkeypatch.setattr(linear, "add_up", lambda *a: passes.append(1) or add_up(*a))
    rows = [(i, i % 2, [0, 1], [1 + i % 2, 1 + i % 3]) for i in range(40)]
    stored = spark.createDataFrame(rows, "row_id long, label int, indices array<int>, tfs array<int>")
    designs = [linear.Design(np.ones(2), 1, 1), linear.Design(np.ones(2), 1, 2)]
    fitted = linear.fit(stored, [[F.lit(1.0)], [F.lit(0.0), F.lit(2.0)]], designs, task_cells=10)
    assert len(passes) < 60 and all((f.bound <= linear.SHARED_TOLERANCE).all() for f in fitted)
    assert (fitted[1].coefficients[:, 0] == 0).all() and [f.coefficients.shape for f in fitted] == [(3, 1), (3, 2)]


def test_fold_rows_read_no_texts(spark, monkeypatch):
    monkeypatch.setattr(terms, "statistics", None)
    assert QUERIES["g5_fold_rows"](spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("most_terms", [terms.MOST_TERMS, 50])
def test_statistics_equal_the_long_table(labelled, most_terms):
    df = labelled[1].withColumn("fold", F.col("label"))
    found = terms.statistics(terms.analysed(df, "text", keep=["fold"]), 2, most_terms=most_terms)
    for held in (0, 1):
        direct = features.term_statistics(features.term_counts(df.filter(F.col("fold") == held), "text"))
        got = {(r.block, r.term): (r[f"df_{held}"], r[f"tf_{held}"]) for r in found.filter(f"df_{held} > 0").collect()}
        assert got == {(r.block, r.term): (r.df, r.tf) for r in direct.collect()}


def test_rows_without_known_terms_keep_the_constant(spark, whole):
    kept, _ = whole
    df = spark.createDataFrame([(1, "??? zzz"), (2, "w1 w2"), (3, None)], "row_id long, text string")
    found = {r.row_id: r for r in linear.weighed(baseline.vectors(df, kept), kept.design(0, 1)).collect()}
    assert found[1]["values"] == found[3]["values"] == [1.0] and len(found[2]["values"]) > 1


def test_sigmoid_fit_equals_brute_force(spark):
    random.seed(2)
    rows = [(random.gauss(1.0 if y else -0.5, 1.0), y) for y in [1] * 20 + [0] * 40]
    fitted = calibration.fit_sigmoids(spark.createDataFrame([(0, *r) for r in rows], "model int, margin double, label int"), 2)
    slope, intercept = fitted[0].slope, fitted[0].intercept
    assert fitted[1] == calibration.Sigmoid(0.0, 0.0)
    margins = np.array([m for m, _ in rows])
    y = np.array([y for _, y in rows])
    target = np.where(y == 1, (20 + 1) / (20 + 2), 1 / (40 + 2))
    exact = newton(np.column_stack([margins, np.ones(len(y))]), target, np.ones(len(y)), np.zeros(2))
    assert (slope, intercept) == pytest.approx(tuple(exact), abs=1e-3)


def test_out_of_fold_and_final_scores(spark, labelled, prepared):
    rows, df = labelled
    scored = baseline.out_of_fold(prepared).collect()
    assert sorted(r.row_id for r in scored) == [i for i, _, _ in rows]
    assert all(0 < r.oof_pred < 1 for r in scored)
    truth = {i: y for i, y, _ in rows}
    pos = [r.oof_pred for r in scored if truth[r.row_id]]
    neg = [r.oof_pred for r in scored if not truth[r.row_id]]
    assert sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) > 0.6
    assert all(0 <= r.error < 1e-3 for r in baseline.out_of_fold_scores(prepared).collect())
    final = baseline.final_scores(prepared, df.select("row_id", "text")).collect()
    assert len(final) == len(rows) and all(0 < r.rule_violation < 1 for r in final)


def test_rows_to_score_must_not_be_training_rows(spark):
    train = spark.createDataFrame([(1, 0, "a"), (2, 1, "b")], "row_id long, label int, text string")
    baseline.require_disjoint(train, spark.createDataFrame([(3, "c")], "row_id long, text string"))
    with pytest.raises(ValueError, match="row_id 2"):
        baseline.require_disjoint(train, spark.createDataFrame([(2, "c")], "row_id long, text string"))


def test_similarity_of_equal_and_foreign_texts(spark):
    rows = [(1, "red green blue", "red green blue", None), (2, "red green", "yellow", "green red red"), (3, "", "red", "red")]
    df = spark.createDataFrame(rows, "row_id long, body string, rule string, example string")
    got = {r.row_id: (r.similarity_rule, r.similarity_example) for r in similarity.similarity_features(df, ["body", "rule", "example"]).collect()}
    assert got[1] == (pytest.approx(1.0), 0.0) and got[2][0] == 0.0 and 0.7 < got[2][1] < 1 and got[3] == (0.0, 0.0)


ODD = ["한국어 단어", "x" * 300, "ﬁne gap\0nul", "áb 𝒳𝒴𝒵 42_", " \n ", "", None, "w1 w1 w2 w1", "😀😀😀 ok"]


@pytest.mark.parametrize("bits", [terms.CHAR_BITS, 5, 2])
def test_keys_of_characters_equal_brute_force(monkeypatch, spark, bits):
    """Sums by fold and vectors, also where a task or a single slice has more characters than keys have room for."""
    df = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(ODD + TEXTS)], "row_id long, fold int, text string")
    rows = terms.analysed(df, "text", keep=["fold"])
    folded = rows.select("row_id", "fold", "folded").toArrow().combine_chunks().to_batches()[0]
    monkeypatch.setattr(terms, "CHAR_BITS", bits)
    monkeypatch.setattr(terms, "SLICE_CHARS", 40)
    ranges = terms.word_ranges(spark)
    found = pa.Table.from_batches(terms.add_up(2, ["word", "char"], 1 << 18, ranges)([folded])).to_pylist()
    sums, wanted = Counter(), Counter()
    for r in found:
        for f in (0, 1):
            sums[r["block"], r["term"], f] += r[f"df_{f}"]
            sums[r["block"], r["term"], f, "tf"] += r[f"tf_{f}"]
    for i, text in enumerate(ODD + TEXTS):
        for block, brute in (("word", python_words), ("char", python_chars)):
            for term, n in brute(text or "").items():
                wanted[block, term, i % 2] += 1
                wanted[block, term, i % 2, "tf"] += n
    assert +sums == wanted
    given = {b: sorted({t for k, t, *_ in wanted if k == b})[::2] for b in ("word", "char")}

    class Shared:
        value = given

    made = pa.Table.from_batches(terms.look_up(Shared, len(given["word"]), ranges)([folded])).to_pylist()
    names = given["word"] + given["char"]
    for r in made:
        text = (ODD + TEXTS)[r["row_id"]] or ""
        counts = {**{i: python_words(text)[t] for i, t in enumerate(given["word"])}, **{len(given["word"]) + i: python_chars(text)[t] for i, t in enumerate(given["char"])}}
        assert dict(zip(r["indices"], r["tfs"], strict=True)) == {i: n for i, n in counts.items() if n} and r["indices"] == sorted(r["indices"])


def test_statistics_cut_no_words_in_the_jvm(labelled):
    """Only folded texts leave the JVM."""
    found = terms.statistics(terms.analysed(labelled[1].withColumn("fold", F.col("label")), "text", keep=["fold"]), 2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_rows_are_laid_out_once_for_all_passes(spark, monkeypatch):
    """A pass reads tiles that were laid out before the first one, whatever occurrences or values they have."""
    made, laid_out = spark.sparkContext.accumulator(0), linear.laid_out

    def counted(designs):
        def run(batches, lay=laid_out(designs)):
            for batch in lay(batches):
                made.add(1)
                yield batch

        return run

    passes, add_up = [], linear.add_up
    monkeypatch.setattr(linear, "add_up", lambda *a: passes.append(1) or add_up(*a))
    rng = np.random.default_rng(3)
    index = [np.flatnonzero(rng.random(60) < 0.4).tolist() for _ in range(600)]
    big = [(i, i % 2, x, [int(v) for v in rng.integers(1, 70_000, len(x))]) for i, x in enumerate(index)]
    given = [linear.Design(np.ones(60), 20, 1), linear.Design(np.where(np.arange(60) % 3, 1.0, 0.0), 20, 2)]
    costs = [[F.lit(1.0)], [F.lit(2.0), F.when(F.col("row_id") % 5 > 0, 1.0)]]
    stored = spark.createDataFrame(big, "row_id long, label int, indices array<int>, tfs array<int>").coalesce(1)
    monkeypatch.setattr(linear, "laid_out", counted)
    shared = linear.fit(stored, costs, given, task_cells=10)
    own = linear.fit(stored, costs, given)
    assert all(np.abs(a.coefficients - b.coefficients).max() < 1e-4 for a, b in zip(shared, own, strict=True))
    assert len(passes) > 5 and made.value == 3
