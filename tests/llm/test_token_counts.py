import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from ruleflow.llm import token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
MERGES = token_counts.Merges(MODEL)

ODD = [
    "", " ", "  ", "a", " a", "a ", "  a  b\n\nc\t", "\n", " \n ", "\n \n", "x" + " " * 50 + "y", " " * 33, "<s>hi</s> <unk> <0x0A>",
    "▁x▁▁y", "é ① \x00 é", "aaaaaaa" * 9, "ababababa", "日本語のテキスト", "\r\n\r\n", "𝒳🙂🙂 a\xa0b　c", "the" * 300,
    "http://www.example.com/a?b=c&d=1234567890", "    def f(x):\n        return x  # " + "=" * 40, "a" + " " * 17 + "\n" + " " * 16 + "①",
]


def counts(texts, kept=None):
    return token_counts.count_block(texts, MERGES, {} if kept is None else kept)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_equal_the_library(text):
    assert counts([text]) == [len(LIBRARY.encode(text))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" \n\tabethinsorzA09.,-_é①日🙂▁")), max_size=60), min_size=1, max_size=4))
def test_random_texts_equal_the_library(texts):
    assert counts(texts) == [len(ids) for ids in LIBRARY.encode(texts)]


def test_random_pieces_equal_the_library():
    rng = np.random.default_rng(1)
    pieces = [LIBRARY.id_to_piece(int(i)).replace("▁", " ") for i in rng.integers(259, 32000, 6000)]
    texts = ["".join(pieces[i : i + 30]) for i in range(0, 6000, 30)]
    assert counts(texts) == [len(ids) for ids in LIBRARY.encode(texts)]


def test_small_rounds_and_a_full_store(monkeypatch):
    monkeypatch.setattr(token_counts, "ROUND_SYMBOLS", 5)
    monkeypatch.setattr(token_counts, "KEPT", 3)
    monkeypatch.setattr(token_counts, "KEPT_CHARS", 4)
    kept = {}
    for _ in range(2):
        assert counts(ODD, kept) == [len(ids) for ids in LIBRARY.encode(ODD)]
    assert max(map(len, kept)) <= 4


def test_rows(spark):
    rows = [(1, "Hello there", "x"), (2, None, None), (None, "a\nb", "y"), (1, "Hello there", "z"), (3, "word " * 5000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    found = sorted(map(tuple, token_counts.count_tokens(docs, MODEL).collect()), key=str)
    wanted = [(i, len((t or "").encode()), n := len(LIBRARY.encode(t or "")), n > 4096) for i, t, _ in rows]
    assert found == sorted(wanted, key=str)
    assert token_counts.count_tokens(docs.limit(0), MODEL).count() == 0
