import math
import re
from fractions import Fraction

import numpy as np
import pytest

from ruleflow.llm import quality_rules as rules

WORD = r"[^\x20\x09-\x0D]+"


def slow_measure(text):
    words = re.findall(WORD, text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if re.search(WORD, line)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        sum(line in lines[:i] for i, line in enumerate(lines)), len(inside), len(lines), len(re.findall("[A-Z]", text)),
    )


@pytest.mark.parametrize("text", [
    "", " \n\t", "a", "a a a a", "a b c a b c d", "one\ntwo\none\n \n \none", "x|y #z\x1f\x85 É\xa0q\n\nX", "a b a b a b", "a\r\nb\r\na\r\nb\n",
    "p q r s p q r t p q r", "日本 語 <>&%$",
])
def test_counts_equal_definition(text):
    assert rules.measure(text) == slow_measure(text)


def test_random_counts():
    rng = np.random.default_rng(0)
    for _ in range(100):
        text = "".join(rng.choice(list("ab \n#"), rng.integers(0, 60)))
        assert rules.measure(text) == slow_measure(text)


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, 0.1), (3, 50, 0.02), (7, 7, 0.5), (0, 0, 0.1), (20, 400, 0.1)])
def test_binomial_tail_is_exact(k, n, p):
    q = Fraction(p)
    exact = sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(min(k, n) + 1))
    assert math.isclose(rules.log_binomial_tail(k, n, p), math.log(exact), rel_tol=1e-9, abs_tol=1e-12)


def test_choice_stops_at_the_first_cutoff_that_is_not_proven():
    assert rules.choose([0, 0, 50, 0], 1000, 0.01, 0.01) == 1
    assert rules.choose([0], 10, 0.01, 0.01) is None


def test_guarantee_holds_over_many_holdouts():
    rng = np.random.default_rng(4)
    alpha, level, breaches = 0.05, 0.1, 0
    risks = [0.0, 0.02, 0.04, 0.06, 0.1]
    for _ in range(2000):
        values = rng.random(300)
        chosen = rules.choose([int((values < r).sum()) for r in risks], 300, alpha, level)
        breaches += chosen is not None and risks[chosen] > alpha
    assert breaches / 2000 <= level


def corpus(spark, n):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.integers(0, 5000)}" for _ in range(60)]
        good = i % 5 > 0
        rows.append((i, " ".join(words if good else [w + "###" for w in words]), "en" if i % 2 else "de", "x"))
        labels.append((i, int(good), 0))
    rows += [(n, None, "en", None), (n + 1, "", None, None), (None, "lone words", "en", None), (3, rows[3][1], "en", "again")]
    return (
        spark.createDataFrame(rows, "doc_id long, text string, lang string, failed string"),
        spark.createDataFrame([*labels, (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int"),
    )


def test_rules_reject_the_bad_and_keep_the_good(spark):
    docs, labels = corpus(spark, 6000)
    found = rules.apply_rules(docs, labels).toPandas()
    assert len(found) == 6004
    main = found[found.doc_id.notna() & (found.doc_id < 6000)]
    good = main[main.doc_id % 5 > 0]
    assert good.kept.mean() > 0.97 and not main[main.doc_id % 5 == 0].kept.any()
    odd = found[found.doc_id.isna() | (found.doc_id >= 6000)]
    assert odd.base_failed.all() and not odd.kept.any()
    assert set(main[main.doc_id % 5 == 0].failed_rules.str.contains("symbol_share")) == {True}


def test_few_labels_prove_nothing_and_reject_nothing(spark):
    docs, labels = corpus(spark, 200)
    found = rules.apply_rules(docs, labels).toPandas()
    assert (found.kept == ~found.base_failed).all()


def test_empty_tables(spark):
    docs, labels = corpus(spark, 50)
    assert rules.apply_rules(docs.limit(0), labels).count() == 0
    assert rules.apply_rules(docs, labels.limit(0)).count() == 54
