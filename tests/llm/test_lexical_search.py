import math
import re
from collections import Counter

import numpy as np
import pytest

from ruleflow.llm import lexical_search as search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def slow_ranks(docs, items):
    """Every document scored for every item with Python's integers."""
    split = [(i, Counter(terms(t))) for i, t in docs]
    split = [(i, c) for i, c in split if c]
    total, length = len(split), sum(c.total() for _, c in split)
    holding = Counter(t for _, c in split for t in c)
    rows = []
    for item, text in set(items):
        scored = []
        for doc, counts in split:
            m = 25 + (75 * counts.total() * total) // length
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * holding[t] + 1))) * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 8 * m))
                for t in terms(text) if t in counts
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        rows += [(item, rank + 1, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(scored, key=lambda s: s[:3])[:10])]
    return sorted(rows, key=str)


def corpus(seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)] + ["É", "é", "ß", "漢字", "THE", "the", "a-b", "x_y"]
    weights = 1 / (np.arange(len(words)) + 1.0)
    some = lambda k: " ".join(rng.choice(words, k, p=weights / weights.sum()).tolist())
    docs = [(int(i), some(int(rng.geometric(0.02)))) for i in rng.permutation(400)]
    items = [(i, some(int(rng.integers(1, 30)))) for i in range(25)]
    docs += [(1000 + i, items[i % 5][1] + " tail") for i in range(30)]  # ties, and more than ten good ones
    docs += [(7, docs[0][1]), (7, docs[0][1]), (None, items[0][1]), (2000, None), (2001, ""), (2002, " .,- "), (2003, "w1 " * 30_000), (2004, "Ä\x85ö \x7f w5")]
    items += [(25, None), (26, ""), (27, "nowhere"), (3, "w3 w3 w3 the THE"), (3, "w3 w3 w3 the THE"), (28, "ä\x85Ö Ä\x85ö")]
    return docs, items


def frames(spark, docs, items):
    made = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, terms string").repartition(6)
    return made, spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, norm double")


@pytest.mark.parametrize(("seed", "limits"), [(0, {}), (1, {"head_rows": 20}), (2, {"pass_chars": 500, "head_rows": 5})])
def test_ranks_equal_scoring_everything(spark, seed, limits):
    docs, items = corpus(seed)
    found = search.rank_documents(*frames(spark, docs, items), **limits)
    assert sorted((tuple(r) for r in found.collect()), key=str) == slow_ranks(docs, items)


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "a b")], [(1, "a")])
    assert search.rank_documents(docs.limit(0), items).collect() == []
    assert search.rank_documents(docs, items.limit(0)).collect() == []


def test_bounds_sort_out_most_pairs():
    """With thresholds from the best documents, few pairs of a bucket are scored exactly, and no good one is lost."""
    rng = np.random.default_rng(3)
    items = search.Items([" ".join(f"t{i}" for i in rng.integers(0, 400, 20)) for _ in range(50)])
    width = len(items.vocabulary)
    weights = rng.integers(100, 9000, width)
    items.weigh(weights)
    block = np.zeros((512, width + 1), np.int64)
    block[:, :width] = rng.integers(1, 900_000, (512, width)) * (rng.random((512, width)) < 0.05)
    norms = np.sqrt((weights * block[:, :width].astype(float) ** 2).sum(axis=1))
    every_row, every_item = np.divmod(np.arange(512 * 50), 50)
    scores = items.scores(block, every_row, every_item).reshape(512, 50)
    assert (scores == block[:, items.term] @ (items.factor[:, None] * (np.repeat(np.arange(50), items.size)[:, None] == np.arange(50)))).all()
    thresholds = np.sort(scores, axis=0)[-10]
    row, item = items.survivors(block, norms, thresholds)
    kept = np.zeros((512, 50), bool)
    kept[row, item] = True
    assert kept[scores >= thresholds].all()
    assert kept.mean() < 0.25
    assert len(items.survivors(block, norms, np.full(50, 1 << 60))[0]) == 0
