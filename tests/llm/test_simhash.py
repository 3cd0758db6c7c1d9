from itertools import combinations

import numpy as np
import pytest
import xxhash

from ruleflow.llm import simhash

HOT = [0b1011 ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)]


def slow_fingerprint(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words, word = [], ""
    for c in (text or "").translate(table) + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = (words + [word] if word else words), ""
        else:
            word += c
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values, radius):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= radius:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {v: find(v) for v in root}


def values_with_neighbours(seed, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n, dtype=np.int64)
    near = [int(v) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)) for v in base for _ in range(3)]
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in near]
    return sorted({*map(int, base), *signed})


def unsigned(v):
    return v % (1 << 64)


@pytest.mark.parametrize("text", ["", "  \n", "One", "one TWO", "a b c", "É a\xa0b c\tÄ d e f", "x " * 700, "a\x1fb c d"])
def test_fingerprint_equals_definition(text):
    assert simhash.majority(simhash.shingle_hashes(text.encode(), 3)) == slow_fingerprint(text)


def test_every_pair_of_the_radius_shares_a_route():
    masks = [sum(((1 << w) - 1) << s for s, w in slices) for _, slices in simhash.routes()]
    assert all(bin(m).count("1") == 28 for m in masks)
    for bits in combinations(range(64), 3):
        difference = sum(1 << b for b in bits)
        assert any(m & difference == 0 for m in masks)


@pytest.mark.parametrize("fanout", [2, 8])
def test_index_finds_exactly_the_pairs_of_each_group(fanout):
    values = np.array([unsigned(v) for v in values_with_neighbours(3, 60)] + HOT[:200], np.uint64)
    groups = np.arange(len(values)) % 3
    found = [
        tuple(sorted((int(a), int(b))))
        for left, right in simhash.GrayIndex(groups, values, fanout).pairs(3)
        for a, b in zip(left, right, strict=True)
    ]
    wanted = {
        (a, b)
        for a, b in combinations(range(len(values)), 2)
        if groups[a] == groups[b] and (int(values[a]) ^ int(values[b])).bit_count() <= 3
    }
    assert len(found) == len(set(found)) and set(found) == wanted


@pytest.mark.parametrize("part_rows", [8192, 7])
def test_links_keep_all_components(spark, part_rows):
    values = values_with_neighbours(5, 80) + [v - (1 << 64) if v >= 1 << 63 else v for v in HOT[:300]]
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    links = simhash.near_links(frame, 3, part_rows).collect()
    wanted = slow_components([unsigned(v) for v in values], 3)
    root = {v: v for v in wanted}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        assert wanted[unsigned(a)] == wanted[unsigned(b)]
        x, y = sorted((find(unsigned(a)), find(unsigned(b))))
        root[y] = x
    assert {v: find(v) for v in wanted} == wanted


def test_near_duplicates_with_odd_rows(spark):
    long = " ".join(f"w{i * 7919 % 1009}" for i in range(3000))
    rows = [
        (5, long, 1), (3, long + " tail", 2), (9, None, 3), (8, "", 4), (7, " \t", 5), (None, "", 6), (1, "alone here", 7),
        (2, "ALONE here", 8), (2, "alone  HERE", 9), (11, "quite another text of some words", None), (None, "unseen words only", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long").withColumnRenamed("fp", "component_id")
    found = simhash.near_duplicates(docs).collect()
    prints = {i: slow_fingerprint(t) for i, (_, t, _) in enumerate(rows)}
    roots = slow_components(list(prints.values()), 3)
    wanted = []
    for i, (doc, _, _) in enumerate(rows):
        members = [d for j, (d, _, _) in enumerate(rows) if roots[prints[j]] == roots[prints[i]] and d is not None]
        wanted.append((doc, f"{prints[i]:016x}", min(members, default=None)))
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)
    assert {r.component_id for r in found if r.doc_id in (3, 5)} == {3}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0


def test_representatives_with_odd_rows(spark):
    long = " ".join(f"w{i * 7919 % 1009}" for i in range(3000))
    rows = [(5, long, "a"), (3, long + " tail", "b"), (3, long + " tail", "b"), (3, long, "c"), (None, long, "d"), (8, "", "e"), (9, None, "f")]
    rows += [(None, "unseen words only here", "g"), (None, "unseen words only here", "g"), (None, "other new words too", "h"), (8, "one more text here", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string")
    kept = simhash.representatives(docs)
    assert kept.schema == docs.schema
    found = sorted(((r.doc_id, r.root) for r in kept.collect()), key=str)
    assert len(found) == 5 and {f for f in found if f[0] != 3} == {(8, "e"), (8, "i"), (None, "g"), (None, "h")}
    assert simhash.representatives(docs.limit(0)).count() == 0


def test_columns_named_like_helpers_come_back_as_they_are(spark):
    text = " ".join(f"w{i}" for i in range(30))
    names = ["_text_digest", "_doc", "_id", "_digest", "row", "root", "route", "fp", "first", "digest"]
    rows = [(1, text, *["keep1"] * len(names)), (2, text, *["keep2"] * len(names)), (None, "other words", *["keep3"] * len(names)), (3, None, *[None] * len(names))]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *[f"{n} string" for n in names]]))
    found = simhash.representatives(docs)
    assert found.dtypes == docs.dtypes
    assert sorted(map(tuple, found.collect()), key=str) == sorted([rows[0], rows[2], rows[3]], key=str)
