"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search goes over the characters of a text and keeps, for the boundaries reached so far, the best
score and the boundary before. The window holds what no decision has been made on. Whenever all paths
that can still win, one for each boundary within the longest piece of the last character, come from one
boundary, everything before it is committed and leaves the window, so a text of any length needs a window
of a few pieces. Scores are whole numbers, so sums are exact at any length.

No piece crosses from a word into the space before the next one, or a line break. All paths converge
there, so the words of a text are searched one by one and the ids of short words are kept.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleflow.llm.blocks import text_blocks
from ruleflow.llm.token_counts import SPACE, pre_tokens

# Words whose ids a worker keeps; longer ones than KEPT_CHARS are searched each time.
KEPT, KEPT_CHARS = 500_000, 64
# A character without a piece costs this much more than the worst piece, as in the library.
UNKNOWN_PENALTY = 10
NEVER = float("-inf")


class Pieces:
    """A model's pieces, their scores and, for every piece, its beginnings."""

    def __init__(self, model: str):
        library = sentencepiece.SentencePieceProcessor(model_file=model)
        self.size = library.get_piece_size()
        self.score: dict[str, int] = {}
        self.id: dict[str, int] = {}
        self.bytes: list[bytes] = []
        byte_ids: dict[int, int] = {}
        for i in range(self.size):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif library.is_control(i) or library.is_unknown(i) or library.is_unused(i):
                self.bytes.append(b"")
            else:
                score = library.get_score(i)
                if score != int(score):
                    raise ValueError("scores must be whole numbers to add up exactly")
                self.score[piece], self.id[piece] = int(score), i
                self.bytes.append(piece.replace(SPACE, " ").encode())
        if len(byte_ids) != 256:
            raise ValueError("the model has no byte pieces")
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.score):
            raise ValueError("a piece crosses a word or line boundary")
        self.byte_id = [byte_ids[b] for b in range(256)]
        self.longest = max(map(len, self.score))
        # Score of every piece, and of what is only the beginning of some: never chosen, but worth going on.
        self.reach = {p[:n]: NEVER for p in self.score for n in range(1, len(p))} | self.score
        self.unknown = min(self.score.values()) - UNKNOWN_PENALTY

    def ids(self, pieces: Iterable[str]) -> list[int]:
        """The ids of pieces; a character without one becomes its bytes."""
        found: list[int] = []
        for piece in pieces:
            i = self.id.get(piece)
            found.extend([i] if i is not None else [self.byte_id[b] for b in piece.encode()])
        return found


def extend(text: str, start: int, best: list, back: list[int], pieces: Pieces) -> None:
    """Try every piece that starts at a boundary that has its best score."""
    reach, base = pieces.reach, best[start]
    end = start + 1
    score = reach.get(text[start:end], NEVER)
    value = base + (score if score > NEVER else pieces.unknown)
    if value > best[end]:
        best[end], back[end] = value, start
    for end in range(start + 2, min(len(text), start + pieces.longest) + 1): 
        score = reach.get(text[start:end])
        if score is None:
            return
        value = base + score
        if value > best[end]:
            best[end], back[end] = value, start


def trace(text: str, back: list[int], end: int) -> list[str]:
    """The pieces on the way to a boundary."""
    found = []
    while end:
        found.append(text[back[end] : end])
        end = back[end]
    return found[::-1]


class Stream:
    """Committed pieces of one text, given in parts of any size.

    Of two segmentations with one score the one that ends in the longer piece wins at every boundary.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.window = ""  # characters not committed yet
        self.best: list = [0]  # score of every boundary of the window
        self.back = [0]  # the boundary before
        self.done = 0  # boundaries from which all pieces have been tried

    def feed(self, text: str) -> Iterator[str]:
        self.window += text
        self.best += [NEVER] * len(text)
        self.back += [0] * len(text)
        # Only boundaries from which the longest piece fits, so that no piece is missed; the rest waits for more.
        while self.done < len(self.window) - self.pieces.longest:
            step = min(len(self.window) - self.pieces.longest, self.done + 4 * self.pieces.longest)
            while self.done < step:
                self._extend(self.done)
                self.done += 1
            yield from self._commit(self._converged())

    def finish(self) -> Iterator[str]:
        while self.done < len(self.window):
            self._extend(self.done)
            self.done += 1
        yield from self._commit(len(self.window))

    def _extend(self, start: int) -> None:
        extend(self.window, start, self.best, self.back, self.pieces)

    def _converged(self) -> int:
        """The last boundary that every path which can still win goes through."""
        live = {b for b in range(self.done, min(len(self.window), self.done + self.pieces.longest) + 1) if self.best[b] > NEVER}
        while len(live) > 1:
            furthest = max(live)
            live.remove(furthest)
            live.add(self.back[furthest])
        return live.pop()

    def _commit(self, boundary: int) -> list[str]:
        found = trace(self.window, self.back, boundary)
        base = self.best[boundary]
        self.window = self.window[boundary:]
        self.best, self.back = [b - base for b in self.best[boundary:]], [max(b - boundary, 0) for b in self.back[boundary:]]
        self.done -= boundary
        return found


def one_window(word: str, pieces: Pieces) -> list[str]:
    """The pieces of a word that is no longer than a window: all paths converge at its end."""
    best, back = [0, *[NEVER] * len(word)], [0] * (len(word) + 1)
    for start in range(len(word)):
        extend(word, start, best, back, pieces)
    return trace(word, back, len(word))


def segment(word: str, pieces: Pieces, part: int = 4096) -> Iterator[str]:
    """The pieces of a word or run of words, searched in parts."""
    stream = Stream(pieces)
    for start in range(0, len(word), part):
        yield from stream.feed(word[start : start + part])
    yield from stream.finish()


@lru_cache(maxsize=4)
def load(model: str) -> tuple[Pieces, dict[str, bytes]]:
    """The pieces of a model and the ids kept so far, once per worker."""
    return Pieces(model), {}


def encode(text: str, pieces: Pieces, kept: dict[str, bytes]) -> np.ndarray:
    """The ids of a text."""
    words = pre_tokens(text)
    if len(kept) > KEPT:
        kept.clear()
    kept[""] = b""
    try:
        return np.frombuffer(b"".join(map(kept.__getitem__, words)), np.int32)
    except KeyError:
        pass
    long: dict[str, bytes] = {}
    for word in [word for word in set(words) if word not in kept]:
        found = one_window(word, pieces) if len(word) <= KEPT_CHARS else segment(word, pieces)
        ids = array("i", pieces.ids(found)).tobytes()
        (kept if len(word) <= KEPT_CHARS else long)[word] = ids
    get = kept.__getitem__ if not long else lambda word: kept[word] if word in kept else long[word]
    return np.frombuffer(b"".join(map(get, words)), np.int32)


def decode(ids: np.ndarray, pieces: Pieces) -> str:
    """The text of ids, without the space that encoding puts before the first word; broken UTF-8 is replaced."""
    text = b"".join(map(pieces.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


CODED = "doc_id long, ids array<int>, n_tokens long, round_trip boolean"


def code(docs: DataFrame, model: str) -> DataFrame:
    """``CODED`` for every row of ``docs(doc_id, text)``: its ids and whether they decode to the text.

    The ids are those of the segmentation with the highest sum of piece scores. The model's own space mark
    in a text counts as a space, as in the library. A NULL or empty text has no ids and decodes to an
    empty text; NULL ids of rows and repeated rows stay; other columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, kept = load(model)
        for block in text_blocks(batches, "text"):
            texts = [text or "" for text in block.column("text").to_pylist()]
            ids = [encode(text, pieces, kept) for text in texts]
            same = [decode(i, pieces) == t.replace(SPACE, " ") for i, t in zip(ids, texts, strict=True)]
            counts = np.array([len(i) for i in ids], np.int64)
            lists = pa.ListArray.from_arrays(
                pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(np.concatenate(ids), pa.int32())
            )
            columns = [block.column("doc_id"), lists, pa.array(counts), pa.array(same)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "n_tokens", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, CODED)


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """``(doc_id, text)`` of ``rows(doc_id, ids)``; NULL ids give an empty text, ids out of range fail."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, _ = load(model)
        for batch in batches:
            found = [decode(np.array(ids or [], np.int32), pieces) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
