import unicodedata
from collections import Counter
from functools import cache

import numpy as np
import pytest

from ruleflow.llm import decontamination as dec


@cache
def slow_words(text):
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    found, word = [], ""
    for c in folded + " ":
        if c.isalnum() or (ord(c) > 127 and unicodedata.category(c)[0] == "M"):
            word += c
        else:
            found += [word.encode()] if word else []
            word = ""
    return found


def slow_shingles(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)])


def slow_leaks(docs, items):
    found = {}
    for row, (_, text) in enumerate(docs):
        words = slow_words(text)
        for item, benchmark in items:
            wanted = slow_words(benchmark)
            if benchmark is None or not wanted or not words:
                continue
            best, b = None, slow_shingles(wanted)
            if not b & slow_shingles(words) and len(wanted) >= 5:
                continue
            for start in range(max(1, len(words) - len(wanted) + 1)):
                a = slow_shingles(words[start : start + len(wanted)])
                value = sum((a & b).values()) / sum((a | b).values())
                if value >= 0.8 and (best is None or value > best[0]):
                    best = (value, start)
            if best:
                found[row, item] = best
    return found


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "to"] * 60 + ["Ä", "e\u0301t", "日本", "l’ß", "क्ष"]
    some = lambda n: [str(w) for w in rng.choice(vocabulary, n)]
    items = [(i, " ".join(some(int(rng.integers(8, 60))))) for i in range(30)]
    items += [(100, "one two three"), (101, "Lone"), (102, ""), (103, None), (104, items[0][1]), (105, "the of to the of to the of")]
    docs = []
    for i in range(160):
        body = some(int(rng.integers(0, 200)))
        if i % 2:
            inside = items[int(rng.integers(0, 30))][1].split()
            for _ in range(int(rng.integers(0, 3))):
                inside[int(rng.integers(0, len(inside)))] = "changed"
            place = int(rng.integers(0, len(body) + 1))
            body = body[:place] + [w.upper() + "," for w in inside] + body[place:]
        docs.append((i, " ".join(body)))
    docs += [(None, items[3][1]), (5, None), (6, ""), (7, "one two THREE!"), (8, "x one two three y z q"), (9, "lone"), (9, "lone"), (10, "a lone b c d e")]
    docs += [(11, " ".join(items[4][1].split()[:-1])), (12, "the of to " * 30)]
    return docs, items


def blocks(docs):
    return dec.joined(t or "" for _, t in docs)


def test_words_equal_definition():
    docs, _ = corpus(3)
    words = dec.cut(*blocks(docs))
    for i, (_, text) in enumerate(docs):
        assert words.text(words.first[i], words.first[i + 1]) == slow_words(text)
    by_hash = {}
    for value, a, b in zip(words.hashes.tolist(), words.starts, words.ends, strict=True):
        assert by_hash.setdefault(value, words.data[a:b].tobytes()) == words.data[a:b].tobytes()
    assert len(set(by_hash.values())) == len(by_hash)


def test_multi_index_misses_nothing_within_the_radius():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    queries = np.array([int(v) ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for v in items for n in (0, 3, 24, 25)], np.uint64)
    found = set(zip(*[x.tolist() for x in dec.MultiIndex(items, 24).search(queries)[:2]], strict=True))
    near = np.bitwise_count(queries[:, None] ^ items[None, :]) <= 24
    assert found == set(zip(*[x.tolist() for x in np.nonzero(near)], strict=True))


@pytest.mark.parametrize("seed", range(4))
def test_matches_equal_comparing_every_window(seed, monkeypatch):
    monkeypatch.setattr(dec, "PART_WINDOWS", 7 if seed % 2 else 4096)
    monkeypatch.setattr(dec, "PART_PAIRS", 10 if seed > 1 else 1 << 18)
    docs, items = corpus(seed)
    benchmark = dec.Benchmark([i for i in items if i[1] is not None])
    found = {(t, benchmark.ids[i]): (v, s) for t, i, v, _, s, _ in dec.matches(dec.cut(*blocks(docs)), benchmark)}
    wanted = slow_leaks(docs, items)
    assert {k: (pytest.approx(v), s) for k, (v, s) in wanted.items()} == found


def test_rows_in_several_passes(spark):
    docs, items = corpus(7)
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame([(i, t, i) for i, t in items], "item_id long, text string, doc_id long")
    wanted = sorted(((docs[row][0], item, round(v, 9), s) for (row, item), (v, s) in slow_leaks(docs, items).items()), key=str)
    for pass_chars in (1 << 20, 900):
        found = dec.leaks(frame, benchmark, pass_chars=pass_chars).collect()
        assert sorted(((r.doc_id, r.item_id, round(r.similarity, 9), r.first_word) for r in found), key=str) == wanted
    assert dec.leaks(frame.limit(0), benchmark).count() == 0
    assert dec.leaks(frame, benchmark.limit(0)).count() == 0


def test_rows_without_leaks(spark):
    docs, items = corpus(8)
    frame = spark.createDataFrame([(d, t, str(row)) for row, (d, t) in enumerate(docs)], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    bad = {str(row) for row, _ in slow_leaks(docs, items)}
    kept = dec.without_leaks(frame, benchmark, pass_chars=900)
    assert kept.schema == frame.schema
    assert sorted(r.item_id for r in kept.collect()) == sorted({str(row) for row in range(len(docs))} - bad)


@pytest.mark.parametrize(("text", "item"), [
    ("So it’s true that we don’t know “what” he said", "so it's true that we don't know \"what\" he said"),
    ("L’ÉCOLE EST FERMÉE POUR LES ÉLÈVES", "l'école est fermée pour les élèves"),
    ("one\u00a0two three—four five… six", "one two three-four five six"),
    ("cafe\u0301 au lait pour tout le monde", "CAFÉ au lait pour tout le monde"),
    ("ﬁrst of all Ｆｕｌｌ width words in here", "first of all full width words in here"),
    ("ΟΔΟΣ και STRASSE für alle Leute hier", "οδος και straße für alle leute hier"),
])
def test_typographic_forms_are_found(text, item):
    words = dec.cut(*dec.joined(["before that. " + text + " After that."]))
    assert [(t, i, v) for t, i, v, *_ in dec.matches(words, dec.Benchmark([(7, item)]))] == [(0, 0, 1.0)]


def test_windows_with_few_shared_shingles_are_no_candidates():
    """Items of one length that share a lead-in are looked for by what they don't share."""
    lead = "which of the following statements about the text above is true"
    benchmark = dec.Benchmark([(i, f"{lead} " + " ".join(f"i{i}w{j}" for j in range(20))) for i in range(500)])
    text = " ".join(f"{lead} and x{i} y{i} z{i}" for i in range(50)) + f" {lead} " + " ".join(f"i7w{j}" for j in range(20))
    words = dec.cut(*dec.joined([text]))
    hits = benchmark.touched(dec.shingles(words))
    assert benchmark.looked_for(dec.shingles(words)[hits]).tolist() == [7]
    assert [(i, v) for _, i, v, *_ in dec.matches(words, benchmark)] == [(7, 1.0)]


def test_long_repeated_text():
    benchmark = dec.Benchmark([(1, "a b c d e f g h i j k l"), (2, "x " * 40)])
    words = dec.cut(*dec.joined(["z " * 100_000 + "a b c d e f g h i j k l " + "x " * 100_000]))
    assert [(i, v, s) for _, i, v, _, s, _ in dec.matches(words, benchmark)] == [(0, 1.0, 100_000), (1, 1.0, 100_012)]
