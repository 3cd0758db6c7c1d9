"""Token counts of a byte-fallback BPE model by rank-synchronous merging of ragged arrays.

A text is cut into pre-tokens that no piece of the vocabulary crosses. The pre-tokens of a block that
have not been seen yet are held as one flat symbol array with an owner per symbol. In each round every
pre-token applies its own lowest-rank pair, all of them at once; symbols that survive are counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleflow.llm.blocks import text_blocks

SPACE = "▁"
LIMIT = 4096
# Pre-tokens whose counts a worker keeps; longer ones than KEPT_CHARS are counted each time.
KEPT, KEPT_CHARS = 400_000, 64
# Symbols that are merged at once; one longer pre-token is merged alone.
ROUND_SYMBOLS = 1 << 20

PRE_TOKEN = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


class Merges:
    """The pairs of a model's vocabulary, as ranks, and which merges may be applied to all places at once."""

    def __init__(self, model: str):
        pieces = sentencepiece.SentencePieceProcessor(model_file=model)
        normal = [
            i for i in range(pieces.get_piece_size())
            if not (pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_byte(i) or pieces.is_unused(i))
        ]
        score = {pieces.id_to_piece(i): pieces.get_score(i) for i in normal}
        spaces = {piece for piece in score if set(piece) == {SPACE}}
        ranked = sorted((p for p in score if len(p) > 1 and p not in spaces), key=lambda p: -score[p])
        self.space_runs = {len(p) for p in spaces}
        # What the cuts below rest on.
        if any(SPACE in p[1:] or "\n" in p for p in ranked):
            raise ValueError("a piece crosses a word or line boundary")
        if len({score[p] for p in spaces - {SPACE}}) > 1 or any(score[p] >= score[ranked[-1]] for p in spaces - {SPACE}):
            raise ValueError("runs of spaces must rank alike and last")
        symbols = [*ranked, *sorted({c for p in ranked for c in p} - set(ranked))]
        self.symbol = {piece: i for i, piece in enumerate(symbols)}  # a merged piece's symbol is its rank
        rank = {piece: i for i, piece in enumerate(ranked)}
        if len({score[p] for p in ranked}) < len(ranked):
            raise ValueError("two pieces share a score")
        left, right, out = [], [], []
        # A merge is safe everywhere at once if nothing that it makes possible ranks before it.
        unsafe = set()
        for piece, r in rank.items():
            for cut in range(1, len(piece)):
                a, b = piece[:cut], piece[cut:]
                if a in self.symbol and b in self.symbol:
                    left.append(self.symbol[a])
                    right.append(self.symbol[b])
                    out.append(r)
                    unsafe.update(rank[x] for x in (a, b) if x in rank and rank[x] > r)
        self.width = len(symbols) + 1  # the last symbol number stands for characters that merge with nothing
        keys = np.array(left, np.int64) * self.width + np.array(right, np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = np.r_[keys[order], np.iinfo(np.int64).max], np.r_[np.array(out, np.int64)[order], -1]
        self.safe = np.ones(self.width, bool)
        self.safe[list(unsafe)] = False
        self.single = {p for p in score if len(p) == 1}
        self.code = {ord(c): i for c, i in self.symbol.items() if len(c) == 1}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or the number of symbols where there is none."""
        wanted = left * self.width + right
        place = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[place] == wanted, self.ranks[place], self.width)

    def unmerged_tokens(self, char: str) -> int:
        """Tokens of a character that stays alone: itself, or its bytes."""
        return 1 if char in self.single else len(char.encode())

    def count_spaces(self, n: int) -> int:
        """Tokens of ``n`` spaces: their pieces rank alike, so the leftmost pair that is a piece always goes first."""
        stack: list[int] = []
        for _ in range(n):
            stack.append(1)
            while len(stack) > 1 and stack[-1] + stack[-2] in self.space_runs:
                stack.append(stack.pop() + stack.pop())
        return len(stack)

    def count(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each word (not empty), and whether its first symbol is left a bare space."""
        sizes = np.array([len(word) for word in words], np.int64)
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        distinct, inverse = np.unique(chars, return_inverse=True)
        symbol = np.array([self.code.get(int(c), self.width - 1) for c in distinct], np.int64)[inverse]
        alone = np.array([self.unmerged_tokens(chr(c)) for c in distinct], np.int64)[inverse]
        owner = np.repeat(np.arange(len(words)), sizes)
        first = np.cumsum(sizes) - sizes
        tokens = np.zeros(len(words), np.int64)
        bare = np.zeros(len(words), bool)
        lead = np.zeros(len(symbol), bool)
        lead[first] = chars[first] == ord(SPACE)
        while len(symbol):
            rank = np.full(len(symbol), self.width, np.int64)
            rank[:-1] = np.where(owner[:-1] == owner[1:], self.pair_ranks(symbol[:-1], symbol[1:]), self.width)
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[heads, len(symbol)])
            lowest = np.minimum.reduceat(rank, heads)
            open_ = lowest < self.width
            done = np.repeat(~open_, lengths)
            np.add.at(tokens, owner[done], alone[done])
            bare[owner[heads[~open_]]] = lead[heads[~open_]]
            low = np.repeat(lowest, lengths)
            merge = (rank == low) & ~done
            # Overlapping places of one pair go from the left, every other one.
            place = np.arange(len(symbol))
            run = place - np.maximum.accumulate(np.where(merge & ~np.r_[False, merge[:-1]], place, 0))
            merge &= run % 2 == 0
            only_first = ~self.safe[np.minimum(low, self.width - 1)] & merge
            if only_first.any():
                where = np.flatnonzero(only_first)
                merge[where[np.r_[False, owner[where][1:] == owner[where][:-1]]]] = False
            symbol = np.where(merge, low, symbol)
            alone = np.where(merge, 1, alone)
            lead &= ~merge
            keep = ~np.r_[False, merge[:-1]] & ~done
            symbol, alone, owner, lead = symbol[keep], alone[keep], owner[keep], lead[keep]
        return tokens, bare


@lru_cache(maxsize=4)
def load(model: str) -> tuple[Merges, dict[str, int]]:
    """The merges of a model and the counts kept so far, once per worker."""
    return Merges(model), {}


def in_rounds(words: Iterable[str]) -> Iterator[list[str]]:
    """Words in lists of about ``ROUND_SYMBOLS`` characters."""
    held: list[str] = []
    size = 0
    for word in words:
        if held and size + len(word) > ROUND_SYMBOLS:
            yield held
            held, size = [], 0
        held.append(word)
        size += len(word)
    if held:
        yield held


def pre_tokens(text: str) -> list[str]:
    """The text after the model's normalisation, cut before every run of spaces and around line breaks.

    May hold empty strings.
    """
    if not text:
        return []
    marked = SPACE + text.replace(" ", SPACE)
    if SPACE * 2 in marked or f"{SPACE}\n" in marked or marked.endswith(SPACE):
        return PRE_TOKEN.findall(marked)
    return marked.replace(SPACE, f" {SPACE}").replace("\n", " \n ").split(" ")


def count_block(texts: list[str], merges: Merges, kept: dict[str, int]) -> list[int]:
    """The number of tokens of each text."""
    cut = [pre_tokens(text) for text in texts]
    if len(kept) > KEPT:
        kept.clear()
    kept[""] = 0
    fresh = set().union(*cut) - kept.keys()
    for words in in_rounds(fresh):
        kept.update(zip(words, token_counts(words, merges), strict=True))
    found = [sum(map(kept.__getitem__, words)) for words in cut]
    for word in fresh:
        if len(word) > KEPT_CHARS:
            del kept[word]
    return found


def token_counts(words: list[str], merges: Merges) -> list[int]:
    """Tokens of pre-tokens, runs of spaces included.

    Pieces of two and more spaces rank after all others, so a run merges when the word behind it is done.
    """
    spaces = [len(word) - len(word.lstrip(SPACE)) for word in words]
    cores = [word[max(n - 1, 0) :] if n < len(word) else "" for word, n in zip(words, spaces, strict=True)]
    filled = [i for i, core in enumerate(cores) if core]
    tokens, bare = merges.count([cores[i] for i in filled]) if filled else ((), ())
    found = [0 if core else merges.count_spaces(n) for core, n in zip(cores, spaces, strict=True)]
    for i, n, left_bare in zip(filled, map(int, tokens), bare, strict=True):
        run = spaces[i] - 1 + bool(left_bare) if spaces[i] else 0
        found[i] = n - bool(left_bare) + merges.count_spaces(run)
    return found


def count_tokens(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row of ``docs(doc_id, text)``.

    Equal to the library's encoding without begin and end tokens. A NULL or empty text has no bytes and no
    tokens; a NULL ``doc_id`` and repeated rows keep their rows; other columns of ``docs`` are not read.
    ``model`` must lie at the same path on every worker, like the library.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, kept = load(model)
        for block in text_blocks(batches, "text"):
            texts = [text or "" for text in block.column("text").to_pylist()]
            tokens = np.array(count_block(texts, merges, kept), np.int64)
            sizes = pa.array([len(text.encode()) for text in texts], pa.int64())
            columns = [block.column("doc_id"), sizes, pa.array(tokens), pa.array(tokens > limit)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
