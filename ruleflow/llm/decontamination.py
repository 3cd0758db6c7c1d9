"""Benchmark decontamination: SimHash over item-sized windows, multi-index Hamming blocks, exact verification.

A window as long as a benchmark item slides over the words of a document. Two texts with similarity ``s``
share a fixed part of their shingles, so an item is looked for only where a text holds one of its rarest
shingles (as many as leave too few others), and only windows with enough of its shingles get a
fingerprint, from running sums, so that a window costs the same whatever its length. Fingerprints are
searched in tables over ``radius + 1`` blocks: two within the radius differ in at most ``radius`` blocks, so
at least one block is the same and no such item is missed. What is left is verified by the weighted
similarity of the shingles themselves.

Shingles that many items have in common bring nothing together unless an item has no others.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleflow.llm.blocks import text_blocks, texts

WORDS = 5
SIMILARITY = 0.8
# At similarity 0.8 a fingerprint bit differs with a chance of about 0.15 (9.7 of 64 bits); 24 is five
# standard deviations above that.
RADIUS = 24
# Characters of benchmark texts that are sent to every task at once; a larger benchmark takes more passes.
PASS_CHARS = 16 << 20
# Bits of the table that tells most shingles apart from those of the benchmark.
GATE_BITS = 24
# Windows whose running sums are held at once, and the gap in words at which they are parted before.
PART_WINDOWS, PART_GAP = 4096, 64
# Pairs of a window and an item that one search of the index may meet in a block.
PART_PAIRS = 1 << 18

NO_WORD = re.compile(r"[^\x00-\x7f\w]+")
# Word bytes of a folded text: ASCII letters and digits, and every byte of a longer UTF-8 sequence.
IN_WORD = np.array([chr(c).isalnum() if c < 128 else True for c in range(256)])
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def folded(text: str) -> bytes:
    """A text in which words are runs of ``IN_WORD``: compatible forms and cases are one, other characters than
    letters, digits and marks are white space outside ASCII."""
    if text.isascii():
        return text.lower().encode()
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    parts = NO_WORD.sub(apart, text)
    return parts.encode()


def apart(found: re.Match) -> str:
    """Marks stay, as they belong to the letter before them; anything else parts words."""
    return "".join(c if unicodedata.category(c)[0] == "M" else " " for c in found[0])


def joined(parts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """The folded bytes of texts one after the other, and the n + 1 offsets of the texts in them."""
    encoded = [folded(text) for text in parts]
    return np.frombuffer(b"".join(encoded), np.uint8), np.cumsum([0, *map(len, encoded)])


def mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return values ^ (values >> np.uint64(33))


@dataclass
class Words:
    """The words of several texts: hash, first byte, end byte, and the first word of each text (n + 1)."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def text(self, start: int, end: int) -> list[bytes]:
        return [self.data[a:b].tobytes() for a, b in zip(self.starts[start:end], self.ends[start:end], strict=True)]


def cut(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of folded texts, hashed by a running polynomial over all bytes at once."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = IN_WORD[data]
    before = np.r_[False, inside[:-1]]
    new_text = np.zeros(len(data) + 1, bool)
    new_text[offsets[:-1]] = True  # a word does not go on in the next text
    starts = np.flatnonzero(inside & (~before | new_text))
    ends = np.flatnonzero(before & (~inside | new_text))
    powers, inverse = power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * powers[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * STEP)
    return Words(data, hashes, starts, ends, np.searchsorted(starts, offsets))


TABLES: dict[str, np.ndarray] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept for the longest block so far."""
    if len(TABLES.get("powers", ())) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("powers", BASE), ("inverse", UNBASE)):
            values = np.full(size, base, np.uint64)
            values[0] = 1
            TABLES[name] = np.multiply.accumulate(values)
    return TABLES["powers"], TABLES["inverse"]


def shingles(words: Words, size: int = WORDS) -> np.ndarray:
    """A hash for the ``size`` words from each word on; those that run over the end of a text mean nothing."""
    n = len(words.hashes)
    padded = np.r_[words.hashes, np.zeros(size, np.uint64)]
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = total * BASE + padded[i : i + n]
    return mix(total)


def whole(words: Words, first: int, end: int) -> np.ndarray:
    """The one shingle of a text with fewer words than a shingle: its whole sequence."""
    total = np.full(1, 12345 + end - first, np.uint64)
    for value in words.hashes[first:end]:
        total = total * BASE + value
    return mix(total)


def weighted_similarity(left: Counter, right: Counter) -> float:
    """Sum of the smaller weights over the sum of the larger ones; a shingle's weight is its count."""
    common = sum((left & right).values())
    return common / (left.total() + right.total() - common)


def counted(words: list[bytes], size: int = WORDS) -> Counter:
    if len(words) < size:
        return Counter([tuple(words)]) if words else Counter()
    return Counter(zip(*[words[i:] for i in range(size)], strict=False))


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each hash."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return 2 * bits.astype(np.int32) - 1


def to_print(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]


class MultiIndex:
    """Fingerprints by the values of ``radius + 1`` blocks."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        bounds = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = []
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            mask = np.uint64((1 << int(high - low)) - 1)
            table = defaultdict(list)
            for i, value in enumerate(((prints >> np.uint64(low)) & mask).tolist()):
                table[value].append(i)
            self.blocks.append((np.uint64(low), mask, {v: np.array(i) for v, i in table.items()}))

    def search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, item, distance) of all pairs within the radius."""
        met = []
        for low, mask, table in self.blocks:
            values = (prints >> low) & mask
            for value, items in table.items():
                queries = np.flatnonzero(values == np.uint64(value))
                met.append(np.repeat(queries, len(items)) * len(self.prints) + np.tile(items, len(queries)))
        pairs = np.unique(np.concatenate(met))
        query, item = np.divmod(pairs, len(self.prints))
        distance = np.bitwise_count(prints[query] ^ self.prints[item])
        near = distance <= self.radius
        return query[near], item[near], distance[near]


class Benchmark:
    """The items of one pass: fingerprints, words, shingles as hashes, and the items by their rarest shingles."""

    def __init__(self, items: list[tuple[int, str]], size: int = WORDS, radius: int = RADIUS, similarity: float = SIMILARITY):
        self.size, self.radius, self.similarity = size, radius, similarity
        self.ids = [item for item, _ in items]
        words = cut(*joined(text for _, text in items))
        hashes = shingles(words, size)
        self.lengths = np.diff(words.first)
        self.prints = np.zeros(len(items), np.uint64)
        self.words, self.own = words, []
        for i, n in enumerate(self.lengths.tolist()):
            first, end = int(words.first[i]), int(words.first[i + 1])
            own = hashes[first : end - size + 1] if n >= size else whole(words, first, end) if n else hashes[:0]
            self.own.append(own)
            if n:
                self.prints[i] = to_print(signs(own).sum(axis=0, keepdims=True))[0]
        short = np.flatnonzero((self.lengths > 0) & (self.lengths < size))
        self.short = {n: short[self.lengths[short] == n] for n in np.unique(self.lengths[short]).tolist()}
        self.gate, self.gate_items = self.rarest(np.flatnonzero(self.lengths >= size).tolist())
        self.flags = np.zeros(1 << GATE_BITS, bool)
        self.flags[self.gate & np.uint64((1 << GATE_BITS) - 1)] = True

    def counts(self, item: int) -> Counter:
        return counted(self.words.text(int(self.words.first[item]), int(self.words.first[item + 1])), self.size)

    def rarest(self, items: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Shingles and the items that are looked for where a text has them, in order of the shingles.

        A window of the similarity shares at least ``least`` of an item's shingles, so it has one of any that
        are one more than the rest; these are the ones that fewest items have.
        """
        if not items:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        distinct = [np.unique(self.own[i]) for i in items]
        every, held = np.unique(np.concatenate(distinct), return_counts=True)
        keys, owners = [], []
        for i in items:
            own = self.own[i]
            order = np.argsort(held[np.searchsorted(every, own)], kind="stable")
            found = np.unique(own[order[: len(own) - self.least(0, len(own)) + 1]])
            keys.append(found)
            owners.append(np.full(len(found), i))
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key, kind="stable")
        return key[order], owner[order]

    def least(self, window: int, item: int) -> int:
        """The least shared weight at which a window and an item of so many shingles can be similar enough.

        Sharing ``c`` makes a similarity of ``c / (window + item - c)`` and at most ``c / item``.
        """
        s = self.similarity
        return max(1, math.ceil(max(s * item, s * (window + item) / (1 + s)) - 1e-6))

    def touched(self, hashes: np.ndarray) -> np.ndarray:
        """Positions whose shingle is one that items are looked for by."""
        maybe = np.flatnonzero(self.flags[hashes & np.uint64((1 << GATE_BITS) - 1)])
        place = np.searchsorted(self.gate, hashes[maybe])
        place[place == len(self.gate)] = 0
        return maybe[self.gate[place] == hashes[maybe]] if len(self.gate) else maybe[:0]

    def looked_for(self, values: np.ndarray) -> np.ndarray:
        """The items that are looked for by any of the shingles."""
        values = np.unique(values)
        low, high = np.searchsorted(self.gate, values, "left"), np.searchsorted(self.gate, values, "right")
        width = high - low
        return np.unique(self.gate_items[np.arange(width.sum()) + np.repeat(low - (np.cumsum(width) - width), width)])


Match = tuple[int, int, float, int, int, int]


def matches(words: Words, benchmark: Benchmark) -> Iterator[Match]:
    """(text, item, similarity, distance, first word, words) of the best window for each text and item."""
    size = benchmark.size
    hashes = shingles(words, size)
    counts = np.diff(words.first)
    owner = np.repeat(np.arange(len(counts)), counts)
    left = words.first[1:][owner] - np.arange(len(owner))  # words of the text from here on
    hits = benchmark.touched(hashes)
    hits = hits[left[hits] >= size]
    for found in np.split(hits, np.flatnonzero(np.diff(owner[hits])) + 1) if len(hits) else []:
        text = int(owner[found[0]])
        first, end = int(words.first[text]), int(words.first[text + 1])
        own = hashes[first : end - size + 1]
        order = np.argsort(own)
        windows: dict[int, dict[int, np.ndarray]] = defaultdict(dict)
        for item in benchmark.looked_for(hashes[found]).tolist():
            starts = window_starts(own, order, benchmark, item)
            if len(starts):
                windows[int(benchmark.lengths[item])][item] = starts + first
        for n, by_item in windows.items():
            yield from best_windows(words, hashes, benchmark, text, n, by_item)
    for text in np.flatnonzero((counts > 0) & (counts < size)).tolist():
        yield from short_matches(words, benchmark, text)
    if benchmark.short:
        yield from short_items(words, benchmark, owner, left)


def window_starts(own: np.ndarray, order: np.ndarray, benchmark: Benchmark, item: int) -> np.ndarray:
    """Where windows of a text start that hold enough shingles of the item; a shorter text is one window.

    ``own`` are the text's shingles and ``order`` sorts them.
    """
    wanted = np.unique(benchmark.own[item])
    low = np.searchsorted(own, wanted, "left", sorter=order)
    width = np.searchsorted(own, wanted, "right", sorter=order) - low
    places = np.sort(order[np.arange(width.sum()) + np.repeat(low - (np.cumsum(width) - width), width)])
    whole_item = len(benchmark.own[item])
    window = min(whole_item, len(own))
    least = benchmark.least(window, whole_item)
    if len(places) < least:
        return places[:0]
    from_, to = places[: len(places) - least + 1], places[least - 1 :]
    # ``least`` shingles that follow each other are inside the windows that start between these two.
    low, high = np.maximum(to - window + 1, 0), np.minimum(from_, len(own) - window)
    low, high = low[low <= high], high[low <= high]
    if not len(low):
        return low
    edge = np.zeros(int(high.max()) + 2 - int(low.min()), np.int64)
    np.add.at(edge, low - low.min(), 1)
    np.add.at(edge, high + 1 - low.min(), -1)
    return np.flatnonzero(np.cumsum(edge) > 0) + low.min()


def best_windows(words: Words, hashes: np.ndarray, benchmark: Benchmark, text: int, n: int, by_item: dict[int, np.ndarray]) -> Iterator[Match]:
    """The best windows for the items of ``n`` words, of those that each item allows."""
    size, first, end = benchmark.size, int(words.first[text]), int(words.first[text + 1])
    best: dict[int, tuple] = {}
    counts: dict[int, Counter] = {}
    items = np.array(list(by_item))
    for some in np.split(items, range(PART_WINDOWS, len(items), PART_WINDOWS)):
        index = MultiIndex(benchmark.prints[some], benchmark.radius)
        counts.clear()
        starts = np.unique(np.concatenate([by_item[i] for i in some.tolist()]))
        step = max(1, min(PART_WINDOWS, PART_PAIRS // len(some)))
        breaks = np.flatnonzero(np.diff(starts) > PART_GAP) + 1
        for part in (p[i : i + step] for p in np.split(starts, breaks) for i in range(0, len(p), step)):
            stops = np.minimum(part + n, end)
            low, high = int(part[0]), int(stops[-1]) - size + 1
            sums = np.zeros((high - low + 1, 64), np.int32)
            np.cumsum(signs(hashes[low:high]), axis=0, out=sums[1:])
            prints = to_print(sums[stops - size + 1 - low] - sums[part - low])
            held, seen = None, Counter()
            for query, number, distance in zip(*index.search(prints), strict=True):
                item, start, stop = int(some[number]), int(part[query]), int(stops[query])
                if item in best and best[item][0] == -1.0:
                    continue  # the same shingles, earlier in the text
                if start != held:
                    held, seen = start, counted(words.text(start, stop), size)
                if item not in counts:
                    counts[item] = benchmark.counts(item)
                found = weighted_similarity(seen, counts[item])
                if found >= benchmark.similarity:
                    row = (-found, start - first, int(distance), stop - start)
                    best[item] = min(best.get(item, row), row)
    for item, (negative, start, distance, length) in sorted(best.items()):
        yield text, item, -negative, distance, start, length


def short_matches(words: Words, benchmark: Benchmark, text: int) -> Iterator[Match]:
    """A text with fewer words than a shingle: its one window is itself."""
    first, end = int(words.first[text]), int(words.first[text + 1])
    n = end - first
    items = benchmark.short.get(n, np.empty(0, np.int64))
    own = counted(words.text(first, end), benchmark.size)
    for item in items[benchmark.prints[items] == whole(words, first, end)].tolist():
        if own == benchmark.counts(item):
            yield text, item, 1.0, 0, 0, n


def short_items(words: Words, benchmark: Benchmark, owner: np.ndarray, left: np.ndarray) -> Iterator[Match]:
    """Items with fewer words than a shingle inside longer texts: their windows are their own only shingle."""
    counts = np.diff(words.first)
    padded = np.r_[words.hashes, np.zeros(benchmark.size, np.uint64)]
    for n, items in benchmark.short.items():
        item_prints = benchmark.prints[items]
        total = np.full(len(words.hashes), 12345 + n, np.uint64)
        for i in range(n):
            total = total * BASE + padded[i : i + len(total)]
        prints = mix(total)  # of one shingle, the fingerprint is its hash
        wanted = np.isin(prints, item_prints) & (left >= n) & (counts[owner] >= benchmark.size)
        seen = set()
        for position in np.flatnonzero(wanted).tolist():
            text = int(owner[position])
            own = counted(words.text(position, position + n), benchmark.size)
            for item in items[item_prints == prints[position]].tolist():
                if (text, item) not in seen and own == benchmark.counts(item):
                    seen.add((text, item))
                    yield text, item, 1.0, 0, position - int(words.first[text]), n


Sent = tuple[str, Broadcast]
SCHEMA = "doc_id long, item_id long, similarity double, distance int, first_word long, n_words long"


def leaks(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, radius: int = RADIUS,
    pass_chars: int = PASS_CHARS,
) -> DataFrame:
    """``SCHEMA``: for each row of ``docs`` and each item with a window of the item's length at ``similarity`` or
    more, the best such window (the first of equal ones).

    Words are runs of letters, digits and marks of any script (beyond ASCII also what Unicode counts as a part of
    words), with compatible forms and cases as one, so that case, accents' encoding, typographic quotes and other
    punctuation do not matter; shingles of ``words`` words weigh as often as they occur. An item
    or text with fewer words is one shingle, one without words matches nothing; a text shorter than an item
    is one window. NULL texts count as empty, NULL items are left out, repeated rows and NULL ids stay.
    The benchmark is sent to the tasks in passes of about ``pass_chars`` characters, one pass over the
    documents for each: a larger benchmark takes more passes, not more memory.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    found = None
    for sent in in_passes(benchmark, pass_chars):
        one = rows.mapInArrow(searcher(sent, similarity, words, radius), SCHEMA)
        found = one if found is None else found.unionByName(one)
    return found


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, radius: int = RADIUS,
    pass_chars: int = PASS_CHARS,
) -> DataFrame:
    """The rows of ``docs(text, …)`` that ``leaks`` finds nothing in, with all their columns; nothing is shuffled."""
    for sent in in_passes(benchmark, pass_chars):
        docs = docs.mapInArrow(cleaner(sent, similarity, words, radius), docs.schema)
    return docs


def in_passes(benchmark: DataFrame, pass_chars: int) -> Iterator[Sent]:
    """The items, about ``pass_chars`` characters at a time, each time with a name of its own."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text")).filter("text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-total // pass_chars))
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    for i in range(passes):
        part = [(row.item_id, row.text) for row in items.filter(number == i).collect()]
        yield uuid.uuid4().hex, benchmark.sparkSession.sparkContext.broadcast(part)


# The index that a Python worker made last, by the name of its pass and its settings.
KEPT: dict[tuple, Benchmark] = {}


def index_of(sent: Sent, similarity: float, words: int, radius: int) -> Benchmark:
    """The index of a pass, made once per Python worker; only the last one is kept."""
    name, items = sent
    key = (name, similarity, words, radius)
    if key not in KEPT:
        KEPT.clear()
        KEPT[key] = Benchmark(items.value, words, radius, similarity)
    return KEPT[key]


def searcher(sent: Sent, similarity: float, words: int, radius: int) -> Callable:
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = index_of(sent, similarity, words, radius)
        for block in text_blocks(batches, "text"):
            found = list(matches(cut(*joined(texts(block, "text"))), benchmark))
            if found:
                text, item, value, distance, start, length = map(list, zip(*found, strict=True))
                columns = [
                    block.column("doc_id").take(pa.array(text)), pa.array([benchmark.ids[i] for i in item], pa.int64()),
                    pa.array(value), pa.array(distance, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                ]
                names = ["doc_id", "item_id", "similarity", "distance", "first_word", "n_words"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return search


def cleaner(sent: Sent, similarity: float, words: int, radius: int) -> Callable:
    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = index_of(sent, similarity, words, radius)
        for block in text_blocks(batches, "text"):
            keep = np.ones(block.num_rows, bool)
            for text, *_ in matches(cut(*joined(texts(block, "text"))), benchmark):
                keep[text] = False
            yield block.filter(pa.array(keep))

    return clean
