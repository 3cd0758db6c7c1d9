import hashlib

import numpy as np
import pytest

from ruleflow.llm import substring_dedup as dedup


def slow_rows(docs):
    """Every window of every row against all windows of rows with a smaller id."""
    last = np.iinfo(np.int64).max
    split = [(i, last if i is None else i, (t or "").encode().split()) for i, t in docs]
    first = {}
    for _, order, words in split:
        for p in range(len(words) - 12):
            window = tuple(words[p : p + 13])
            first[window] = min(first.get(window, order), order)
    rows = []
    for i, order, words in split:
        gone = [False] * len(words)
        for p in range(len(words) - 12):
            if first[tuple(words[p : p + 13])] < order:
                gone[p : p + 13] = [True] * 13
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        rows.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(rows, key=str)


def corpus(seed, n=80):
    rng = np.random.default_rng(seed)
    letters = [f"w{i}" for i in range(12)] + ["é", "x" * 70, "x" * 70 + "y", "ﬁ", "漢字"]
    some = lambda k: rng.choice(letters, k).tolist()
    passages = [some(int(k)) for k in (12, 13, 14, 20, 60, 300)]
    docs = []
    for i in rng.permutation(n).tolist():
        words = some(int(rng.integers(0, 30)))
        for _ in range(int(rng.integers(0, 4))):
            p = passages[int(rng.integers(0, len(passages)))]
            low = int(rng.integers(0, 12))
            words += p[low : low + int(rng.integers(5, 200))] + some(int(rng.integers(0, 9)))
        gaps = rng.choice([" ", "  ", "\n", "\t \x0b", "\r\n"], len(words)).tolist() if i % 3 else [" "] * len(words)
        docs.append((int(i), "".join(a + b for a, b in zip(words, gaps, strict=True))))
    docs += [(5, docs[0][1]), (1000, docs[0][1]), (None, docs[1][1]), (None, docs[1][1]), (2000, None), (2001, ""), (2002, "a " * 400)]
    docs += [(2003, "b " + "a " * 120), (2004, "a " * 12), (3, "a " * 14), (2005, "a b " * 60), (2006, "a b " * 9), (2007, " \n "), (2008, "\x85".join("abcdefghijklmnop"))]
    return docs


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, kept_sha256 string, anchor int").repartition(5)


@pytest.mark.parametrize(("seed", "limits"), [(0, {}), (1, {"hot_texts": 2}), (2, {"shard_rows": 3, "shard_bytes": 300}), (3, {"hot_texts": 2, "shard_rows": 2})])
def test_rows_equal_comparing_all_windows(spark, seed, limits):
    docs = corpus(seed)
    expected = slow_rows(docs)
    assert sum(r[2] for r in expected) > 500
    assert rows_of(dedup.remove_repeats(frame(spark, docs), **limits)) == expected


def test_long_texts_over_many_chunks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = [f"v{i}" for i in rng.integers(0, 3000, 400_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[100_000:300_000])), (3, "q " + " ".join(words[-40:]) + " z"), (4, "x" * 3_000_000 + " y " * 30)]
    assert rows_of(dedup.remove_repeats(frame(spark, docs))) == slow_rows(docs)


def test_kept_text(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = [(1, f"a {passage} b"), (2, f"c {passage}\nd"), (3, passage)]
    found = dedup.remove_repeats(frame(spark, docs), with_text=True)
    assert {r["doc_id"]: r["kept_text"] for r in found.collect()} == {1: f"a {passage} b", 2: "c d", 3: ""}


def test_empty_table(spark):
    assert dedup.remove_repeats(frame(spark, []).limit(0)).collect() == []


def test_very_common_line_is_one_row_per_chunk_and_window():
    """A passage in every text: what a shard is sent does not grow with the texts of a chunk."""
    line = b" ".join(b"c%d" % i for i in range(30))
    data = b"".join(b"u%d %s v%d\n" % (i, line, i) for i in range(500))
    sizes = [len(b"u%d %s v%d\n" % (i, line, i)) for i in range(500)]
    row = {"chunk": 0, "ids": list(range(500)), "sizes": sizes, "data": dedup.chunks.__globals__["squeeze"](np.frombuffer(data, np.uint8))}
    words = dedup.Words(row, dedup.WordHashes())
    runs = dedup.Runs(words.hashes, words.counts)
    anchors = [{"anchor": int(a), "hot": True} for a in np.unique(runs.key).view(np.int64)]
    shared = dedup.SharedRuns(words, anchors)
    inside = [i for i, f in enumerate(shared.first) if words.content(shared.start[f], shared.count[f]) in line]
    assert len(inside) == 18  # windows of the line, once each
    assert set(shared.doc[inside]) == {0}
