import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from ruleflow.llm import piece_coding as coding

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PIECES = coding.Pieces(MODEL)

ODD = [
    "", " ", "a", " a  b ", "\n\n x\n", "x" * 300, "▁x", "é① 🙂\x00", "日本語のテキスト", "the theory of thermodynamics", " " * 40 + "y",
    "ab" * 5000, "<s> <unk> <0x0A>", "a\tb\r\nc", "ing" * 77 + "①" * 9, "1234567890" * 30,
]


def slow_best(word):
    """Viterbi over the whole text with full tables."""
    best, back = [0] + [None] * len(word), [0] * (len(word) + 1)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - PIECES.longest), end):
            piece = word[start:end]
            value = PIECES.score.get(piece, PIECES.unknown if len(piece) == 1 else None)
            if value is not None and (best[end] is None or best[start] + value > best[end]):
                best[end], back[end] = best[start] + value, start
    found, end = [], len(word)
    while end:
        found.append(word[back[end] : end])
        end = back[end]
    return found[::-1]


def normal(text):
    return "▁" + text.replace(" ", "▁") if text else ""


@pytest.mark.parametrize("text", ODD)
def test_ids_equal_one_search_over_the_whole_text(text):
    assert coding.encode(text, PIECES, {}).tolist() == PIECES.ids(slow_best(normal(text)))


@pytest.mark.parametrize("part", [1, 7, 4096])
def test_parts_do_not_matter(part):
    rng = np.random.default_rng(part)
    for _ in range(20):
        word = "".join(rng.choice(list("ethanios▁ngr①"), 400))
        assert list(coding.segment(word, PIECES, part)) == slow_best(word)


def test_window_stays_short():
    stream, longest = coding.Stream(PIECES), 0
    for _ in range(2000):
        for _ in stream.feed("thenationing"):
            pass
        longest = max(longest, len(stream.window))
    assert longest < 20 * PIECES.longest


def test_equals_the_library_on_the_same_scores():
    proto = model_pb2.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.trainer_spec.model_type = 1  # its lattice search for the best sum of scores
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    rng = np.random.default_rng(2)
    words = ["the", "nation", "hello", "streaming", "ation", "qu", "is", "x1", "Zebra", "undecided"]
    for _ in range(50):
        text = " ".join(rng.choice(words, 12))
        ours, theirs = coding.encode(text, PIECES, {}).tolist(), library.nbest_encode_as_ids(text, 2)[0]
        scores = [sum(PIECES.score[library.id_to_piece(i)] for i in ids) for ids in (ours, theirs)]
        assert scores[0] == scores[1] and library.decode(ours) == text


def test_round_trip_of_odd_and_random_texts():
    rng = np.random.default_rng(3)
    texts = ODD + ["".join(map(chr, rng.integers(1, 0x2FFF, 50))) for _ in range(50)]
    for text in texts:
        assert coding.decode(coding.encode(text, PIECES, {}), PIECES) == text.replace("▁", " ")


def test_full_store(monkeypatch):
    monkeypatch.setattr(coding, "KEPT", 2)
    monkeypatch.setattr(coding, "KEPT_CHARS", 3)
    kept = {}
    for text in ODD * 2:
        assert coding.encode(text, PIECES, kept).tolist() == PIECES.ids(slow_best(normal(text)))
    assert max(map(len, kept)) <= 3


def test_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "some text", None), (5, None, "y"), (5, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = coding.code(docs, MODEL)
    got = sorted(map(tuple, found.collect()), key=str)
    wanted = [(i, ids := PIECES.ids(slow_best(normal(t or ""))), len(ids), True) for i, t, _ in rows]
    assert got == sorted(wanted, key=str)
    texts = sorted(map(tuple, coding.decoded(found, MODEL).collect()), key=str)
    assert texts == sorted([(i, (t or "").replace("▁", " ")) for i, t, _ in rows], key=str)
    assert coding.code(docs.limit(0), MODEL).count() == 0
