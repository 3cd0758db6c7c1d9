"""Term statistics and term vectors made in Arrow batches, for jobs that do not need n-grams as rows.

Texts are folded in the JVM, as in ``features``. Statistics and vectors cut folded texts as arrays of characters, some rows
at once: words are runs of characters, a character n-gram is a key made of its characters' numbers, a pair of words one of
theirs, and terms of rows are sorted and counted as arrays. Rows of terms are made from words that were cut in the JVM; a
word's character n-grams are cut once there. A task adds up its rows' terms before anything is shuffled, so statistics
move a term at most once for each task and each ``MOST_TERMS`` terms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleflow.functions.text import WHITESPACE_CODES, WHITESPACE_RUN, WORD, fold_text, words
from ruleflow.operators.features import BLOCKS, CHAR_BLOCK, CHAR_SIZES, WORD_BLOCK

# Terms that a task adds up before it sends them on, words and n-grams that it keeps numbers of, and terms that wait to be added up.
MOST_TERMS, KEPT_WORDS, WAITING = 1 << 19, 400_000, 1 << 19
# Rows of texts that are cut at once, characters of folded texts that are, and rows of a batch of terms.
SLICE_ROWS, SLICE_CHARS, SENT_ROWS = 64, 1 << 19, 1 << 16
# Bits of a character's number in the key of an n-gram; five characters fit into 63.
CHAR_BITS = 12
# What a character is: one of a word, or white space.
IN_WORD, WHITE = 1, 2
# The column that a block's terms are cut from.
SOURCES = {WORD_BLOCK.name: "tokens", CHAR_BLOCK.name: "pieces"}


def analysed(df: DataFrame, text: str, row_id: str = "row_id", keep: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """``row_id``, ``keep``, the ``folded`` text, the ``tokens`` of the word block and the ``pieces`` whose characters the other block counts.

    The texts are dealt out by id to ``partitions`` tasks, by default the session's number of shuffle partitions.
    """
    number = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.select(F.col(row_id).alias("row_id"), *keep, F.col(text).alias("_text")).repartition(number, "row_id")
    folded = fold_text(F.coalesce(F.col("_text"), F.lit("")))
    return spread.withColumn("folded", folded).select("row_id", *keep, "folded", words(F.col("folded")).alias("tokens"), F.split("folded", WHITESPACE_RUN).alias("pieces"))


@lru_cache(maxsize=1)
def word_ranges(spark) -> np.ndarray:
    """First and last code of all ranges of characters that are in words, as the JVM's regular expressions see them."""
    every = np.r_[0:0xD800, 0xE000:0x110000].astype(np.uint32)
    pattern = spark.sparkContext._jvm.java.util.regex.Pattern.compile(WORD.partition("{2")[0] + "+")
    others = pattern.matcher(every.tobytes().decode("utf-32-le")).replaceAll("")
    inside = np.zeros(0x110000, bool)
    inside[every] = True
    inside[np.frombuffer(others.encode("utf-32-le"), np.uint32)] = False
    return ends_of_runs(inside, 1)


def kinds(ranges: np.ndarray) -> np.ndarray:
    """What each character is, by its code."""
    found = np.zeros(0x110000, np.uint8)
    for first, last in ranges.tolist():
        found[first:last] = IN_WORD
    found[WHITESPACE_CODES] = WHITE
    return found


def ends_of_runs(inside: np.ndarray, least: int) -> np.ndarray:
    """Begin and end of the runs of at least so many places."""
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))).reshape(-1, 2)
    return edges[edges[:, 1] - edges[:, 0] >= least]


def stretches(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each first one on, so many of each."""
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def as_texts(codes: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Characters, so many of each text, as texts."""
    data = codes.astype(np.uint32).tobytes().decode("utf-32-le").encode()
    ends = np.r_[0, np.cumsum(sizes)]
    if len(data) > len(codes):
        width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        ends = np.r_[0, np.cumsum(width)][ends]
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))


class Cut:
    """The rows of a slice, cut into words and pieces: distinct ones, which of them each one is, and its row."""

    def __init__(self, rows: pa.RecordBatch, kind: np.ndarray | None):
        self.rows, self.kind = rows, kind
        if kind is not None:
            texts = [t or "" for t in rows.column("folded").to_pylist()]
            self.codes = np.frombuffer("".join(f"{t}\n" for t in texts).encode("utf-32-le"), np.uint32)
            self.begin = np.r_[0, np.cumsum([len(t) + 1 for t in texts])][:-1]
            self.kinds = kind[self.codes]

    def of(self, block: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        if self.kind is None:
            lists = self.rows.column(SOURCES[block])
            row, coded = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().dictionary_encode()
        else:
            ends = ends_of_runs(self.kinds == IN_WORD, 2) if block == WORD_BLOCK.name else ends_of_runs(self.kinds != WHITE, 1)
            first, sizes = ends[:, 0], ends[:, 1] - ends[:, 0]
            row = np.searchsorted(self.begin, first, "right") - 1
            coded = as_texts(self.codes[stretches(first, sizes)], sizes).dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), row


def text_slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose folded texts have about ``SLICE_CHARS`` bytes, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("folded")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SLICE_CHARS, "right")))
            yield batch.slice(low, high - low)
            low = high


def counted(row: np.ndarray, place: np.ndarray, times: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows and places, ascending, and how many times they come in all."""
    bits = int(times.max(initial=1)).bit_length()
    packed = np.sort(((row * places + place) << bits) | times)
    both = packed >> bits
    begin = np.flatnonzero(np.diff(both, prepend=-1))
    sums = np.add.reduceat(packed & ((1 << bits) - 1), begin) if len(begin) else np.empty(0, np.int64)
    return both[begin] // max(1, places), both[begin] % max(1, places), sums


class TooManyCharacters(Exception):
    """More characters than keys have room for."""


def char_terms(piece: str) -> list[str]:
    padded = f" {piece} " if piece else ""
    return [padded[i : i + n] for n in CHAR_SIZES for i in range(len(padded) - n + 1)]


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(low, SLICE_ROWS)


def looked_up(keys: np.ndarray, given: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Places of keys among given ones, which ascend, -1 for others; ``order`` has the places."""
    if not len(given):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(given, keys), len(given) - 1)
    return np.where(given[at] == keys, order[at], -1)


class WordTerms:
    """Words and pairs of neighbouring words as numbers: that of a word, or the first one's plus 1 times 2 ** 32 plus the second's.

    With ``given`` terms only their words have numbers; a row's terms are then looked up among them.
    """

    def __init__(self, given: Sequence[str] | None = None):
        self.numbers: dict[str, int] = {}
        self.given = None
        if given is not None:
            parts = [[self.number(w) for w in term.split(" ")] for term in given]
            keys = np.array([p[0] if len(p) == 1 else (p[0] + 1 << 32) | p[1] for p in parts], np.int64)
            order = np.argsort(keys)
            self.given = keys[order], order

    def held(self) -> int:
        return len(self.numbers)

    def number(self, word: str) -> int:
        return self.numbers.setdefault(word, len(self.numbers))

    def rows(self, lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct terms of each row, ascending, and their occurrences."""
        coded, ends = lists.flatten().dictionary_encode(), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        number = self.number if self.given is None else lambda w: self.numbers.get(w, -1)
        ids = np.array([number(w) for w in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        low = 0
        for high in ends.tolist():
            own, low = ids[low:high], high
            left, right = own[:-1], own[1:]
            if self.given is None:
                yield np.unique(np.concatenate([own, (left + 1 << 32) | right]), return_counts=True)
                continue
            both = (left >= 0) & (right >= 0)
            found, times = np.unique(np.concatenate([own[own >= 0], (left[both] + 1 << 32) | right[both]]), return_counts=True)
            keys, order = self.given
            place = np.minimum(np.searchsorted(keys, found), max(0, len(keys) - 1))
            known = keys[place] == found if len(keys) else np.zeros(len(found), bool)
            index, times = order[place[known]], times[known]
            ascending = np.argsort(index)
            yield index[ascending], times[ascending]

    def cells(self, cut: Cut) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, place and times of the terms in a slice, and the keys of the places; with ``given`` terms places are theirs."""
        texts, code, row = cut.of(WORD_BLOCK.name)
        number = self.number if self.given is None else lambda w: self.numbers.get(w, -1)
        ids = np.array([number(w) for w in texts.to_pylist()], np.int64)[code]
        pair = (row[1:] == row[:-1]) & (ids[1:] >= 0) & (ids[:-1] >= 0)
        single = ids >= 0
        keys = np.concatenate([ids[single], (ids[:-1][pair] + 1 << 32) | ids[1:][pair]])
        row = np.concatenate([row[single], row[1:][pair]])
        keys, place = np.unique(keys, return_inverse=True)
        if self.given is None:
            return row, place, np.ones(len(row), np.int64), keys
        known = looked_up(keys, *self.given)[place]
        return row[known >= 0], known[known >= 0], np.ones(int((known >= 0).sum()), np.int64), keys

    def names(self, keys: np.ndarray) -> pa.Array:
        """The texts of terms."""
        known = pa.array(list(self.numbers), pa.string())
        single = keys < 1 << 32
        found = known.take(pa.array(keys & 0xFFFFFFFF))
        first = known.take(pa.array(np.where(single, 0, (keys >> 32) - 1)))
        return pc.if_else(pa.array(single), found, pc.binary_join_element_wise(first, found, " "))


class CharTerms:
    """Character n-grams of words as numbers, those of a word cut once; with ``given`` terms all others are left out."""

    def __init__(self, given: Sequence[str] | None = None):
        self.numbers: dict[str, int] = {} if given is None else {t: i for i, t in enumerate(given)}
        self.fixed = given is not None
        self.cut: dict[str, np.ndarray] = {}

    def held(self) -> int:
        return len(self.numbers) + len(self.cut)

    def of(self, piece: str) -> np.ndarray:
        if piece not in self.cut:
            if self.fixed and len(self.cut) >= KEPT_WORDS:
                self.cut.clear()
            numbers, terms = self.numbers, char_terms(piece)
            found = [n for n in map(numbers.get, terms) if n is not None] if self.fixed else [numbers.setdefault(t, len(numbers)) for t in terms]
            self.cut[piece] = np.array(found, np.int64)
        return self.cut[piece]

    def rows(self, lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct terms of each row, ascending, and their occurrences."""
        coded, ends = lists.flatten().dictionary_encode(), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        terms = [self.of(piece) for piece in coded.dictionary.to_pylist()]
        sizes, codes = np.array([len(t) for t in terms], np.int64), coded.indices.to_numpy(zero_copy_only=False)
        low = 0
        for high in ends.tolist():
            pieces, times = np.unique(codes[low:high], return_counts=True)
            low = high
            found = np.concatenate([np.empty(0, np.int64), *[terms[p] for p in pieces.tolist()]])
            index, place = np.unique(found, return_inverse=True)
            yield index, np.bincount(place, weights=np.repeat(times, sizes[pieces]), minlength=len(index)).astype(np.int64)

    def cells(self, cut: Cut) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As those of words."""
        texts, code, row = cut.of(CHAR_BLOCK.name)
        terms = [self.of(piece) for piece in texts.to_pylist()]
        row, place, times = spread(row, code, np.concatenate([np.empty(0, np.int64), *terms]), np.r_[0, np.cumsum([len(t) for t in terms], dtype=np.int64)])
        if self.fixed:
            return row, place, times, np.empty(0, np.int64)
        keys, place = np.unique(place, return_inverse=True)
        return row, place, times, keys

    def names(self, keys: np.ndarray) -> pa.Array:
        return pa.array(list(self.numbers), pa.string()).take(pa.array(keys))


def spread(row: np.ndarray, code: np.ndarray, grams: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, n-gram and times of the n-grams of pieces; those of a piece stand from its ``begin`` on."""
    texts = len(begin) - 1
    both, times = np.unique(row * max(1, texts) + code, return_counts=True)
    row, code = both // max(1, texts), both % max(1, texts)
    sizes = np.diff(begin)[code]
    return np.repeat(row, sizes), grams[stretches(begin[code], sizes)], np.repeat(times, sizes)


class CharKeys:
    """Character n-grams as keys made of their characters' numbers, of which a task has less than 2 ** ``CHAR_BITS``.

    With ``given`` terms only their characters have numbers, all others share the last one.
    """

    def __init__(self, given: Sequence[str] | None = None):
        self.number, self.letters = np.zeros(0x110000, np.int16), np.zeros(1, np.uint32)
        self.given = None
        self.fixed = False
        self.numbered(np.array([ord(" ")], np.uint32))
        if given is not None:
            sizes = np.array([len(t) for t in given], np.int64)
            number = self.numbered(np.frombuffer("".join(given).encode("utf-32-le"), np.uint32))
            if len(self.letters) >= (1 << CHAR_BITS) - 1:
                raise TooManyCharacters
            self.fixed = True
            begin, keys = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.int64)
            for i in range(max(CHAR_SIZES)):
                keys[sizes > i] = keys[sizes > i] << CHAR_BITS | number[begin[sizes > i] + i]
            keys[sizes > max(CHAR_SIZES)] = -1
            order = np.argsort(keys)
            self.given = keys[order], order

    def held(self) -> int:
        return 0  # keys need no table

    def numbered(self, codes: np.ndarray) -> np.ndarray:
        """The numbers of characters; new ones get the next."""
        found = self.number[codes]
        if self.fixed:
            return np.where(found, found, (1 << CHAR_BITS) - 1).astype(np.int64)
        if not found.all():
            new = np.unique(codes[found == 0])
            if len(self.letters) + len(new) > 1 << CHAR_BITS:
                raise TooManyCharacters
            self.number[new] = np.arange(len(self.letters), len(self.letters) + len(new))
            self.letters = np.concatenate([self.letters, new])
            found = self.number[codes]
        return found.astype(np.int64)

    def grams(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The keys of each text's n-grams, text by text, and where those of each begin."""
        if not len(texts):
            return np.empty(0, np.int64), np.zeros(1, np.int64)
        codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
        sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 2
        ends = np.cumsum(sizes)
        inner = np.ones(ends[-1], bool)
        inner[ends - 1] = inner[ends - sizes] = False
        longest = max(CHAR_SIZES)
        number = np.zeros(ends[-1] + longest, np.int64)
        number[: ends[-1]] = self.number[ord(" ")]
        number[: ends[-1]][inner] = self.numbered(codes)
        left = np.repeat(ends, sizes) - np.arange(ends[-1])
        key, keys = np.zeros(ends[-1], np.int64), []
        for i in range(longest):
            key = key << CHAR_BITS | number[i : i + len(key)]
            keys += [key] if i + 1 in CHAR_SIZES else []
        inside = left[:, None] >= np.array(CHAR_SIZES)
        per_text = np.add.reduceat(inside.sum(axis=1), ends - sizes)
        return np.stack(keys, axis=1)[inside], np.r_[0, np.cumsum(per_text)]

    def cells(self, cut: Cut) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As those of words."""
        texts, code, row = cut.of(CHAR_BLOCK.name)
        keys, begin = self.grams(texts)
        if self.given is None:
            keys, place = np.unique(keys, return_inverse=True)
        else:
            place = looked_up(keys, *self.given)
            begin, place = np.r_[0, np.cumsum(place >= 0)][begin], place[place >= 0]
        return *spread(row, code, place, begin), keys

    def names(self, keys: np.ndarray) -> pa.Array:
        """The texts of n-grams."""
        number = keys[:, None] >> np.arange(max(CHAR_SIZES))[::-1] * CHAR_BITS & (1 << CHAR_BITS) - 1
        return as_texts(self.letters[number[number > 0]], (number > 0).sum(axis=1))


TERMS = {WORD_BLOCK.name: WordTerms, CHAR_BLOCK.name: CharTerms}
# The terms that folded texts are cut into.
KEYED = {WORD_BLOCK.name: WordTerms, CHAR_BLOCK.name: CharKeys}


class Sums:
    """Rows and occurrences of a block's terms, overall or by fold."""

    def __init__(self, block: str, folds: int, kind: type | None = None):
        self.block, self.folds, self.terms = block, max(1, folds), (kind or KEYED[block])()
        self.names = sum_columns(folds)
        self.waiting = [(np.empty(0, np.int64), np.zeros((0, len(self.names)), np.int64))]

    def add(self, cut: Cut, fold: np.ndarray) -> None:
        row, place, times, keys = self.terms.cells(cut)
        row, place, times = counted(row, place, times, len(keys))
        at, size = place * self.folds + fold[row], len(keys) * self.folds
        tf = np.bincount(at, weights=times, minlength=size).astype(np.int64)
        self.waiting.append((keys, np.concatenate([x.reshape(-1, self.folds) for x in (np.bincount(at, minlength=size), tf)], axis=1)))
        if sum(len(k) for k, _ in self.waiting[1:]) >= WAITING:
            self.settle()

    def settle(self) -> None:
        keys = np.concatenate([k for k, _ in self.waiting])
        order = np.argsort(keys, kind="stable")
        keys, sums = keys[order], np.concatenate([x for _, x in self.waiting])[order]
        begin = np.flatnonzero(np.diff(keys, prepend=-1))
        self.waiting = [(keys[begin], np.add.reduceat(sums, begin, axis=0) if len(begin) else sums)]

    def full(self, most_terms: int) -> bool:
        return len(self.waiting[0][0]) >= most_terms or self.terms.held() >= KEPT_WORDS

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        for low in range(0, len(self.waiting[0][0]), SENT_ROWS):
            keys, sums = (x[low : low + SENT_ROWS] for x in self.waiting[0])
            columns = [pa.array([self.block] * len(keys), pa.string()), self.terms.names(keys), *[pa.array(c) for c in np.ascontiguousarray(sums.T)]]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "term", *self.names])


def sum_columns(folds: int) -> list[str]:
    return [f"{kind}_{f}" for kind in ("df", "tf") for f in range(folds)] if folds else ["df", "tf"]


def add_up(folds: int, blocks: Sequence[str], most_terms: int, ranges: np.ndarray | None = None) -> Callable:
    """Sums of ``folded`` texts, whose words are told by ``ranges``; without them of rows that are cut already."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {block: Sums(block, folds) for block in blocks}
        kind = None if ranges is None else kinds(ranges)
        for rows in slices(batches) if ranges is None else text_slices(batches):
            fold = rows.column("fold").to_numpy(zero_copy_only=False).astype(np.int64) if folds else np.zeros(rows.num_rows, np.int64)
            cut = Cut(rows, kind)
            for block in blocks:
                try:
                    sums[block].add(cut, fold)
                except TooManyCharacters:  # the next keys start anew; a slice that has too many by itself is counted by texts
                    yield from sums[block].rows()
                    sums[block] = Sums(block, folds)
                    try:
                        sums[block].add(cut, fold)
                    except TooManyCharacters:
                        alone, sums[block] = Sums(block, folds, TERMS[block]), Sums(block, folds)
                        alone.add(cut, fold)
                        yield from alone.rows()
                if sums[block].full(most_terms):
                    yield from sums[block].rows()
                    sums[block] = Sums(block, folds)
        for block in blocks:
            yield from sums[block].rows()

    return run


def statistics(rows: DataFrame, folds: int = 0, blocks: Sequence[str] = (WORD_BLOCK.name, CHAR_BLOCK.name), most_terms: int = MOST_TERMS) -> DataFrame:
    """``block, term, df, tf`` of ``analysed`` rows, and with ``folds`` also ``df_<f>`` and ``tf_<f>`` for each value of ``fold``."""
    names = sum_columns(folds)
    schema = "block string, term string, " + ", ".join(f"{n} long" for n in names)
    run = add_up(folds, blocks, most_terms, word_ranges(rows.sparkSession))
    summed = rows.select("folded", *(["fold"] if folds else [])).mapInArrow(run, schema).groupBy("block", "term").agg(*[F.sum(n).alias(n) for n in names])
    if not folds:
        return summed
    whole = [sum((F.col(f"{kind}_{f}") for f in range(1, folds)), F.col(f"{kind}_0")).alias(kind) for kind in ("df", "tf")]
    return summed.select("block", "term", *whole, *names)


def cut_rows(block: str) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = TERMS[block]()
        for rows in slices(batches):
            if terms.held() >= KEPT_WORDS:
                terms = TERMS[block]()
            found = list(terms.rows(rows.column(SOURCES[block])))
            sizes = [len(keys) for keys, _ in found]
            names = terms.names(np.concatenate([keys for keys, _ in found]))
            row = rows.column("row_id").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            whole = pa.RecordBatch.from_arrays([row, names, pa.array(np.concatenate([t for _, t in found]))], names=["row_id", "term", "tf"])
            for low in range(0, whole.num_rows, SENT_ROWS):
                yield whole.slice(low, SENT_ROWS)

    return run


def row_counts(rows: DataFrame, block: str) -> DataFrame:
    """``row_id, term, tf`` of ``analysed`` rows: the n-grams of a block as rows."""
    return rows.select("row_id", SOURCES[block]).mapInArrow(cut_rows(block), f"row_id {rows.schema['row_id'].dataType.simpleString()}, term string, tf long")


def sum_rows(value: Callable[[str], int]) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, values = CharTerms(), np.empty(0, np.int64)
        for rows in slices(batches):
            if terms.held() >= KEPT_WORDS:
                terms, values = CharTerms(), np.empty(0, np.int64)
            found = list(terms.rows(rows.column("pieces")))
            values = np.r_[values, np.array([value(t) for t in list(terms.numbers)[len(values) :]], np.int64)]
            kept = [i for i, (keys, _) in enumerate(found) if len(keys)]
            sums = [[len(found[i][0]), int(found[i][1].sum()), int(found[i][1] @ values[found[i][0]])] for i in kept]
            columns = [rows.column("row_id").take(pa.array(kept, pa.int64())), *[pa.array([s[i] for s in sums], pa.int64()) for i in range(3)]]
            yield pa.RecordBatch.from_arrays(columns, names=["row_id", "terms", "grams", "checksum"])

    return run


def char_sums(rows: DataFrame, value: Callable[[str], int]) -> DataFrame:
    """``row_id, terms, grams, checksum`` of ``analysed`` rows: how many distinct character n-grams and n-grams a row has, and the sum
    of ``value`` over all its n-grams. Rows without any are left out. A value is made once for each n-gram that a task keeps.
    """
    return rows.select("row_id", "pieces").mapInArrow(sum_rows(value), f"row_id {rows.schema['row_id'].dataType.simpleString()}, terms long, grams long, checksum long")


def vocabularies(stats: DataFrame, rows: dict[int | None, int]) -> DataFrame:
    """``held_out, block, term, df, tf``: the vocabularies fitted without each fold that ``rows`` names, -1 for all rows.

    ``rows`` has each one's number of training rows. ``stats`` should be stored: two jobs read it, however many folds there
    are. The first counts terms on a logarithmic scale of occurrences, at most 4,096 steps for each vocabulary and
    block; so only about ``max_features`` terms of each are sorted in the second.
    """

    def side(held: int | None) -> Column:
        df, tf = (F.col(k) if held is None else F.col(k) - F.col(f"{k}_{held}") for k in ("df", "tf"))
        most = [F.when(F.col("block") == b.name, F.lit(rows[held] * b.max_df)) for b in BLOCKS]
        least = [F.when(F.col("block") == b.name, F.lit(b.min_df)) for b in BLOCKS]
        inside = (df >= F.coalesce(*least)) & (df <= F.coalesce(*most))
        return F.when(inside, F.struct(F.lit(-1 if held is None else held).alias("held_out"), df.alias("df"), tf.alias("tf")))

    sides = F.filter(F.array(*[side(held) for held in rows]), lambda s: s.isNotNull())
    inside = stats.select("block", "term", F.inline(sides)).withColumn("step", F.floor(F.log2("tf") * 64))
    size = F.coalesce(*[F.when(F.col("block") == b.name, F.lit(b.max_features)) for b in BLOCKS])
    downwards = Window.partitionBy("held_out", "block").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = inside.groupBy("held_out", "block", "step").agg(F.count(F.lit(1)).alias("n")).withColumn("reached", F.sum("n").over(downwards))
    lowest = reached.filter(F.col("reached") >= size).groupBy("held_out", "block").agg(F.max("step").alias("lowest"))
    frequent = inside.join(F.broadcast(lowest), ["held_out", "block"], "left").filter(F.col("step") >= F.coalesce("lowest", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("held_out", "block").orderBy(F.desc("tf"), "term"))
    return frequent.withColumn("place", place).filter(F.col("place") <= size).select("held_out", "block", "term", "df", "tf")


def look_up(shared, words_end: int, ranges: np.ndarray) -> Callable:
    """Distinct term numbers of each row, ascending, and their occurrences."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, kind, blocks = shared.value, kinds(ranges), []
        for block, first in ((WORD_BLOCK.name, 0), (CHAR_BLOCK.name, words_end)):
            try:
                terms = KEYED[block](given[block])
            except TooManyCharacters:
                terms = TERMS[block](given[block])
            blocks += [(terms, first)] if given[block] else []
        end = words_end + len(given[CHAR_BLOCK.name])
        for rows in text_slices(batches):
            cut = Cut(rows, kind)
            none = np.empty(0, np.int64)
            found = [(none, none, none), *((row, place + first, times) for terms, first in blocks for row, place, times, _ in [terms.cells(cut)])]
            row, index, times = counted(*(np.concatenate(x) for x in zip(*found, strict=True)), end)
            offsets = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=rows.num_rows))].astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (index, times)]
            kept = [n for n in rows.schema.names if n != "folded"]
            yield pa.RecordBatch.from_arrays([*[rows.column(n) for n in kept], *lists], names=[*kept, "indices", "tfs"])

    return run


def term_vectors(rows: DataFrame, terms: dict[str, list[str]]) -> DataFrame:
    """``analysed`` rows with their ``indices`` in the vocabulary and ``tfs`` instead of words.

    ``terms`` has the terms of each block; numbers go through the word block first. Vocabularies are bounded by
    configuration, so their broadcast is.
    """
    given = {b.name: terms.get(b.name, []) for b in BLOCKS}
    shared = rows.sparkSession.sparkContext.broadcast(given)
    needed = rows.drop("tokens", "pieces")
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in needed.schema.fields if f.name != "folded"]
    run = look_up(shared, len(given[WORD_BLOCK.name]), word_ranges(rows.sparkSession))
    return needed.mapInArrow(run, ", ".join([*kept, "indices array<int>", "tfs array<int>"]))
