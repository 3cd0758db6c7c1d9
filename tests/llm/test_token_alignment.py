import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ruleflow.llm import token_alignment as alignment

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def slow_groups(libraries, text):
    """Groups of whole-text encodings, cut where both have an end; None if the bytes differ."""
    a, b = libraries
    letters = alignment.byte_letters()
    if not text:
        return None
    one = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    if not b"".join(x for _, x in one) == b"".join(x for _, x in two) == (" " + text).encode():
        return None
    ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (one, two)]
    groups, low_a, low_b = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        high_a, high_b = ends[0].index(end) + 1, ends[1].index(end) + 1
        groups.append(([i for i, _ in one[low_a:high_a]], [i for i, _ in two[low_b:high_b]]))
        low_a, low_b = high_a, high_b
    return groups


def slow_rows(libraries, docs):
    found = [slow_groups(libraries, text) or [] for _, text in docs]
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for groups in found]
    count = Counter(pair for own in links for pair in own)
    highest = defaultdict(int)
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    rows = []
    for (i, _), groups, own in zip(docs, found, links, strict=True):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        rows.append((
            i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), own.total(),
            sum(n for p, n in own.items() if count[p] == highest[p[0]]), sum(n * count[p] for p, n in own.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return sorted(rows, key=str)


def corpus(seed):
    rng = random.Random(seed)
    letters = [*"  \t\n\r'asS09.!é́ 　中😀​\x85 ٠²Ⅰ_\x00\x7f", "▁", "the ", "Token", "<s>", "<|endoftext|>", "<0x0A>", "\r\n", "ﬁ", "한국어", "\x1c", "  "]
    docs = [(i, "".join(rng.choices(letters, k=rng.randint(0, 30)))) for i in range(400)]
    words = ["the", "tokenizer", "splits", "antidisestablishment", "Wörter", "24be64439e3e49cf", "naïve", "x=1;", "...", "don't"]
    docs += [(1000 + i, " ".join(rng.choices(words, k=rng.randint(1, 80)))) for i in range(60)]
    docs += [(1000, docs[-1][1]), (None, docs[-1][1]), (None, None), (2000, None), (2001, ""), (2002, " "), (2003, "\n"), (2004, "中文" * 300), (2005, "a" * 5000)]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, pairs string").repartition(5)


@pytest.mark.parametrize(("seed", "limits"), [(0, {}), (1, {"piece": 3, "slice_pairs": 200})])
def test_rows_equal_whole_text_encodings(spark, libraries, seed, limits):
    docs = corpus(seed)
    expected = slow_rows(libraries, docs)
    assert sum(r[1] > 0 for r in expected) > 250
    assert any(r[1] == 0 and r[0] is not None and r[0] < 400 for r in expected)
    assert sorted((tuple(r) for r in alignment.align(frame(spark, docs), BYTES, PIECES, **limits).collect()), key=str) == expected


def test_groups_as_text(spark, libraries):
    found = alignment.align(frame(spark, [(1, "the tokenizer"), (2, "")]), BYTES, PIECES, with_groups=True)
    groups = slow_groups(libraries, "the tokenizer")
    assert {r["doc_id"]: r["groups"] for r in found.collect()} == {1: ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups), 2: ""}


@pytest.mark.parametrize("piece", [1, 2, 5, 64, 10_000])
def test_pieces_find_every_common_end(piece):
    rng = np.random.default_rng(piece)
    for n, m in ((0, 5), (5, 0), (1, 1), (40, 60), (500, 3), (3, 500), (700, 700)):
        a, b = (np.sort(rng.choice(1500, k, replace=False)) for k in (n, m))
        in_a, in_b = alignment.common_ends(a, b, piece)
        assert a[in_a].tolist() == b[in_b].tolist() == np.intersect1d(a, b).tolist()


def test_pieces_have_equal_work():
    """A border takes the elements before it from both lists, whatever their lengths."""
    a, b = np.arange(0, 100_000, 2), np.arange(0, 100_000, 31)
    diagonals = np.arange(0, len(a) + len(b), 1000)
    in_a = alignment.crossings(a, b, diagonals)
    assert set(np.diff(in_a + (diagonals - in_a)).tolist()) == {1000}
    merged = np.sort(np.r_[a * 2, b * 2 + 1], kind="stable")
    assert in_a.tolist() == [int((merged[:d] % 2 == 0).sum()) for d in diagonals]


def test_large_group_is_linked_by_distinct_ids(spark, libraries, monkeypatch):
    """Tokens that never end together make one group; its links are counted, not written out."""
    docs = [(1, "​﻿" * 40 + "x"), (2, "​﻿" * 40 + "y")]
    monkeypatch.setattr(alignment, "LINK_ROWS", 2)
    found = alignment.align(frame(spark, docs), BYTES, PIECES).collect()
    assert sorted((tuple(r) for r in found), key=str) == slow_rows(libraries, docs)


def test_empty_table(spark):
    assert alignment.align(frame(spark, [(1, "a")]).limit(0), BYTES, PIECES).collect() == []
