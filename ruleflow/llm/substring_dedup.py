"""Removal of word passages that occur in an earlier document, by repeated-phrase automata.

A window of 13 words goes if its words also start in a document with a smaller id. Equal windows share
their anchor, the smallest hash among the 4-word phrases inside, and neighbouring windows with one anchor
form a run of few words. So documents meet by anchors only:

1. Texts are packed into chunks and stored once, bucketed by chunk, so later passes don't move them.
2. Every chunk sends the distinct anchors of its runs, one row each. Spark sorts them; a task streams through
   and returns those that several documents have.
3. Every chunk sends the words of its distinct runs with such anchors, each with the smallest id there.
   Rows are sharded and sorted by anchor and id.
4. A shard confirms which windows recur, compiles them with their earliest document into an Aho-Corasick
   automaton over the shard's words (a word is one character), and streams all runs of all documents
   through it. A match with a smaller document marks the window.
5. The marks go back to the chunk, whose covered words are removed.

An anchor that very many documents have, as at the edge of a common passage, would bring as many different
runs together. Its windows go out one by one, each sharded by its own words; equal ones are one row per
chunk. A shard holds a bounded stretch of rows at a time and carries over the windows of a key that goes on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleflow.llm.span_dedup import CHUNK, bucketed, chunks, each_row, mix, unpack
from ruleflow.storage import Scratch, materialize

WINDOW, PHRASE = 13, 4
# Windows of a run at most, one bit each.
RUN = 16
# An anchor in more texts than this sends its windows one by one.
HOT_TEXTS = 1024
# Bytes of text that one chunk table's bucket gets, and how many buckets Spark allows.
BUCKET_BYTES, MOST_BUCKETS = 8 << 20, 1 << 16
# Rows and bytes that a shard's automaton is compiled from.
SHARD_ROWS, SHARD_BYTES = 32_768, 4 << 20
STEP_ROWS = 4096
# A longer word is sent as its digest; 0xFF is in no UTF-8 text.
LONG_WORD = 64
KEPT_WORDS = 400_000
# An odd number, as the base of hashes of word sequences.
STEP = np.uint64(0x9E3779B97F4A7C15)

Step = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]


class WordHashes(dict):
    """The hash of a word, kept for words seen before."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(word) <= LONG_WORD:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = found
        return found


class Words:
    """The words of a chunk, how many each text has, and their hashes."""

    def __init__(self, row: dict, hashes: WordHashes):
        data, sizes, self.order = unpack(row)
        view, end, self.words, counts = data.tobytes(), 0, [], []
        for size in sizes.tolist():
            found = view[end : end + size].split()
            self.words += found
            counts.append(len(found))
            end += size
        self.counts = np.array(counts, np.int64)
        self.hashes = np.fromiter(map(hashes.__getitem__, self.words), np.uint64, len(self.words))
        self.long = max(map(len, self.words), default=0) > LONG_WORD

    def content(self, start: int, count: int) -> bytes:
        """The words of ``count`` windows from ``start`` on."""
        words = self.words[start : start + count + WINDOW - 1]
        if self.long:
            words = [w if len(w) <= LONG_WORD else b"\xff" + hashlib.sha256(w).hexdigest().encode() for w in words]
        return b" ".join(words)


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` words from each place on that has as many."""
    n = max(0, len(hashes) - size + 1)
    found = np.zeros(n, np.uint64)
    for i in range(size if n else 0):
        found = mix(found * np.uint64(3) + hashes[i : i + n])
    return found


def stretch_hashes(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The hash of ``sizes`` words from ``starts`` on, from running sums of a polynomial modulo 2 ** 64."""
    powers = np.full(len(hashes) + 1, STEP, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.r_[np.uint64(0), np.cumsum(mix(hashes) * powers[:-1])]
    return mix((sums[starts + sizes] - sums[starts]) * powers[len(hashes) - starts])


def smallest(values: np.ndarray, span: int) -> np.ndarray:
    """The smallest of ``span`` neighbours from each place on, by doubling."""
    width = 1
    while width < span:
        step = min(width, span - width)
        values = np.minimum(values[:-step], values[step:])
        width += step
    return values


class Runs:
    """Runs of windows of a chunk: text number, first word, number of windows and anchor key."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.text = self.start = self.size = np.empty(0, np.int64)
        self.key = np.empty(0, np.uint64)
        if len(hashes) < WINDOW:
            return
        keys = smallest(gram_hashes(hashes, PHRASE), WINDOW - PHRASE + 1)
        n = len(keys)
        text = np.repeat(np.arange(len(counts)), counts)[:n]
        room = np.cumsum(counts)[text] - np.arange(n) >= WINDOW
        change = np.r_[True, (keys[1:] != keys[:-1]) | (text[1:] != text[:-1]) | (room[1:] != room[:-1])]
        starts = np.flatnonzero(change)
        lengths = np.diff(np.r_[starts, n])
        keep = room[starts]
        starts, lengths = starts[keep], lengths[keep]
        parts = -(-lengths // RUN)
        number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        self.start = np.repeat(starts, parts) + number * RUN
        self.size = np.minimum(np.repeat(lengths, parts) - number * RUN, RUN)
        self.text = text[self.start]
        self.key = mix(keys[self.start])


# 2. Anchors


def send_anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(anchor, chunk, texts)``: each distinct anchor of a chunk and how many of its texts have it."""
    hashes = WordHashes()
    for row in each_row(batches):
        words = Words(row, hashes)
        runs = Runs(words.hashes, words.counts)
        order = np.lexsort((runs.text, runs.key))
        key, text = runs.key[order], runs.text[order]
        other = np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])][: len(key)]
        distinct, texts = np.unique(key[other], return_counts=True)
        columns = [pa.array(distinct.view(np.int64)), pa.array(np.full(len(distinct), row["chunk"])), pa.array(texts.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=["anchor", "chunk", "texts"])


def shared_anchors(hot_texts: int) -> Step:
    """``(anchor, chunk, hot)`` of the anchors that several texts have, from rows sorted by anchor.

    A group that goes on past a batch is held back until it ends or is known to be hot.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = [np.empty(0, np.int64)] * 3
        hot_anchor = None

        def decided(anchor: np.ndarray, chunk: np.ndarray, texts: np.ndarray) -> pa.RecordBatch:
            _, number = np.unique(anchor, return_inverse=True)
            total = np.bincount(number, weights=texts)[number]
            hot = total > hot_texts
            if hot_anchor is not None:
                hot |= anchor == hot_anchor
            keep = (total > 1) | hot
            columns = [pa.array(anchor[keep]), pa.array(chunk[keep]), pa.array(hot[keep])]
            return pa.RecordBatch.from_arrays(columns, names=["anchor", "chunk", "hot"])

        for batch in batches:
            rows = [np.r_[old, batch.column(i).to_numpy(zero_copy_only=False)] for i, old in enumerate(rest)]
            if not len(rows[0]):
                continue
            last = rows[0][-1]
            cut = int(np.searchsorted(rows[0], last))
            open_ = rows[2][cut:].sum()
            if open_ > hot_texts or last == hot_anchor:
                yield decided(*rows)
                rest, hot_anchor = [r[:0] for r in rows], last
            else:
                yield decided(*[r[:cut] for r in rows])
                rest = [r[cut:] for r in rows]
        if len(rest[0]):
            yield decided(*rest)

    return run


# 3. Runs


class SharedRuns:
    """What a chunk sends and has to know again: its occurrences of shared runs and the distinct ones among them."""

    def __init__(self, words: Words, shared: list[dict]):
        runs = Runs(words.hashes, words.counts)
        known = np.array([s["anchor"] for s in shared], np.int64).view(np.uint64)
        hot = np.array([s["hot"] for s in shared], bool)
        order = np.argsort(known)
        known, hot = known[order], hot[order]
        place = np.minimum(np.searchsorted(known, runs.key), max(0, len(known) - 1))
        flag = np.where(known[place] == runs.key, 1 + hot[place], 0) if len(known) else np.zeros(len(runs.key), np.int64)
        warm, alone = np.flatnonzero(flag == 1), np.flatnonzero(flag == 2)
        size = runs.size[alone]
        single = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(runs.start[alone], size)
        windows = gram_hashes(words.hashes, WINDOW)
        self.text = np.r_[runs.text[warm], np.repeat(runs.text[alone], size)]
        self.start = np.r_[runs.start[warm], single]
        self.count = np.r_[runs.size[warm], np.ones(len(single), np.int64)]
        key = np.r_[runs.key[warm], windows[single]].view(np.int64)
        doc = words.order[self.text]
        # Each distinct run, told by its anchor and a hash of its words, is an entry with the smallest id that has it.
        content = stretch_hashes(words.hashes, self.start, self.count + WINDOW - 1)
        order = np.lexsort((doc, content, key))
        new = np.r_[True, (key[order][1:] != key[order][:-1]) | (content[order][1:] != content[order][:-1])][: len(order)]
        first = order[new]
        self.entry = np.empty(len(key), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.key, self.doc, self.first = key[first], doc[first], first
        self.later = doc > self.doc[self.entry]


SENT = "key long, doc long, chunk long, entry int, content binary"


def send_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for row in each_row(batches):
        if not row["shared"]:
            continue
        words = Words(row, hashes)
        runs = SharedRuns(words, row["shared"])
        content = [words.content(a, n) for a, n in zip(runs.start[runs.first].tolist(), runs.count[runs.first].tolist(), strict=True)]
        columns = [
            pa.array(runs.key), pa.array(runs.doc), pa.array(np.full(len(content), row["chunk"], np.int64)),
            pa.array(np.arange(len(content), dtype=np.int32)), pa.array(content, pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "doc", "chunk", "entry", "content"])


# 4. Shards


class Shard:
    """Rows of several runs, each run a string of one character per distinct word of the shard."""

    def __init__(self, contents: list[bytes]):
        self.alphabet: dict[bytes, int] = {}
        alphabet, ids, sizes = self.alphabet, [], []
        for content in contents:
            words = content.split(b" ")
            ids += [alphabet.setdefault(w, len(alphabet) + 1) for w in words]
            ids.append(0)
            sizes.append(len(words) + 1)
        self.codes = np.array(ids, np.uint32)
        self.codes[self.codes >= 0xD800] += 0x800  # no surrogates
        self.text = self.codes.tobytes().decode("utf-32-le")
        ends = np.cumsum(np.array(sizes, np.int64))
        self.starts = ends - np.array(sizes, np.int64)
        windows = np.array(sizes, np.int64) - WINDOW
        self.row = np.repeat(np.arange(len(sizes)), windows)
        self.place = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + self.starts[self.row]

    def confirmed(self, docs: np.ndarray) -> np.ndarray:
        """The places of windows that at least two rows with different ids have, first ids first."""
        hashes = gram_hashes(mix(self.codes.astype(np.uint64) + np.uint64(1)), WINDOW)[self.place]
        _, number = np.unique(hashes, return_inverse=True)
        doc = docs[self.row]
        low = np.full(number.max(initial=-1) + 1, np.iinfo(np.int64).max)
        high = np.full(len(low), np.iinfo(np.int64).min)
        np.minimum.at(low, number, doc)
        np.maximum.at(high, number, doc)
        found = np.flatnonzero((low < high)[number])
        return found[np.argsort(doc[found], kind="stable")]


def located(contents: list[bytes], docs: np.ndarray, before: dict[bytes, int]) -> np.ndarray:
    """For each run the bits of its windows that a document with a smaller id has.

    ``before`` has windows of the first key that were met before these rows, with their earliest document.
    """
    shard = Shard(contents)
    automaton = ahocorasick.Automaton()
    first: dict[str, int] = {}
    for window, doc in before.items():
        codes = [shard.alphabet.get(w) for w in window.split(b" ")]
        if None not in codes:
            first["".join([chr(c + 0x800 * (c >= 0xD800)) for c in codes])] = doc
    found = shard.confirmed(docs)
    text = shard.text
    for place, doc in zip(shard.place[found].tolist(), docs[shard.row[found]].tolist(), strict=True):
        first.setdefault(text[place : place + WINDOW], doc)
    bits = np.zeros(len(contents), np.int64)
    if not first:
        return bits
    for phrase, doc in first.items():
        automaton.add_word(phrase, doc)
    automaton.make_automaton()
    matches = list(automaton.iter(text))
    if matches:
        end, doc = (np.array(side, np.int64) for side in zip(*matches, strict=True))
        row = np.searchsorted(shard.starts, end, side="right") - 1
        earlier = doc < docs[row]
        row, place = row[earlier], (end - WINDOW + 1)[earlier]
        np.bitwise_or.at(bits, row, np.int64(1) << (place - shard.starts[row]))
    return bits


def windows_of(content: bytes) -> list[bytes]:
    words = content.split(b" ")
    return [b" ".join(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1)]


def marked(keys: np.ndarray, docs: np.ndarray, contents: list[bytes], before: dict[bytes, int]) -> np.ndarray:
    """The bits of all rows of a shard. Equal runs are one text of it, with their first, smallest id; later ids have all bits."""
    numbers: dict[bytes, int] = {}
    number = np.fromiter((numbers.setdefault(c, len(numbers)) for c in contents), np.int64, len(contents))
    first = np.full(len(numbers), len(contents))
    np.minimum.at(first, number, np.arange(len(contents)))
    # Windows of a key with one run are in no other run.
    _, key = np.unique(keys[first], return_inverse=True)
    several = np.bincount(key)[key] > 1
    if before:
        several |= keys[first] == keys[0]
    bits = np.zeros(len(first), np.int64)
    if several.any():
        rows = first[several]
        bits[several] = located([contents[i] for i in rows.tolist()], docs[rows], before)
    return np.where(docs > docs[first[number]], -1, bits[number])


def locate(shard_rows: int, shard_bytes: int) -> Step:
    """``(chunk, entry, bits)`` of the runs with marked windows, from rows sorted by key and id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = size = 0
        carry: dict[bytes, int] = {}
        carry_key = None

        def answer(table: pa.Table, goes_on: bool) -> pa.RecordBatch:
            """Of a key that goes on after these rows, its windows are kept."""
            nonlocal carry, carry_key
            keys, docs = (table.column(n).to_numpy() for n in ("key", "doc"))
            contents = table.column("content").to_pylist()
            old = carry if carry_key == keys[0] else {}
            bits = marked(keys, docs, contents, old)
            carry, carry_key = {}, None
            if goes_on:
                carry, carry_key = old, keys[-1]
                for content, doc in dict(zip(reversed(contents), reversed(docs.tolist()), strict=True)).items():
                    for window in windows_of(content):
                        carry[window] = min(doc, carry.get(window, doc))
            found = np.flatnonzero(bits)
            columns = [pa.array(table.column("chunk").to_numpy()[found]), pa.array(table.column("entry").to_numpy()[found]), pa.array(bits[found].astype(np.int32))]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "entry", "bits"])

        for batch in batches:
            for low in range(0, batch.num_rows, STEP_ROWS):
                piece = batch.slice(low, STEP_ROWS)
                held.append(piece)
                rows, size = rows + piece.num_rows, size + piece.column("content").nbytes
                if rows < shard_rows and size < shard_bytes:
                    continue
                table = pa.Table.from_batches(held)
                keys = table.column("key").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield answer(table.slice(0, cut), False)
                rest = table.slice(cut)
                if rest.num_rows >= shard_rows or size >= shard_bytes and not cut:
                    yield answer(rest, True)
                    rest = rest.slice(0, 0)
                held = rest.combine_chunks().to_batches()
                rows, size = rest.num_rows, sum(b.column("content").nbytes for b in held)
        if rows:
            yield answer(pa.Table.from_batches(held), False)

    return run


# 5. Removal


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def remove(with_text: bool) -> Step:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for row in each_row(batches):
            words = Words(row, hashes)
            gone = np.zeros(len(words.words) + 1, np.int32)
            if row["shared"]:
                runs = SharedRuns(words, row["shared"])
                bits = np.zeros(len(runs.first), np.int64)
                for mark in row["marks"] or []:
                    bits[mark["entry"]] = mark["bits"]
                mask = np.where(runs.later, -1, bits[runs.entry])
                for bit in range(RUN):
                    place = runs.start[(runs.count > bit) & (mask >> bit & 1 == 1)] + bit
                    np.add.at(gone, place, 1)
                    np.add.at(gone, place + WINDOW, -1)
            kept = np.cumsum(gone[:-1]) == 0
            rows, texts, end = [], [], 0
            for doc, count in zip(row["ids"], words.counts.tolist(), strict=True):
                keep = kept[end : end + count]
                text = b" ".join(compress(words.words[end : end + count], keep.tolist()))
                end += count
                rows.append((doc, count, count - int(keep.sum()), hashlib.sha256(text).hexdigest()))
                texts.append(text.decode() if with_text else None)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(texts, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def remove_repeats(
    docs: DataFrame, with_text: bool = False, hot_texts: int = HOT_TEXTS, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """``RESULT`` (and ``kept_text``, the kept words joined by spaces) for every row of ``docs(doc_id, text)``.

    Each word goes that is covered by a window of 13 words which also starts in a row with a smaller
    ``doc_id``, judged on the texts as given. Repeats inside one text, or in rows with the same id, stay. A NULL
    id comes after all others; a NULL text has no words; an empty table gives no rows; other columns, whatever
    their names, are not read. Long texts and long words are taken whole.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = min(max(1, total // BUCKET_BYTES), MOST_BUCKETS)
    with Scratch(spark, "substring-dedup") as scratch:
        name = bucketed(spark, rows.mapInArrow(chunks, CHUNK), "chunk", buckets, f"{scratch.path}/chunks")
        try:
            stored = spark.table(name)
            anchors = stored.mapInArrow(send_anchors, "anchor long, chunk long, texts int")
            grouped = anchors.repartition("anchor").sortWithinPartitions("anchor")
            shared = grouped.mapInArrow(shared_anchors(hot_texts), "anchor long, chunk long, hot boolean")
            told = shared.repartition(buckets, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("anchor", "hot")).alias("shared"))
            known = scratch.store(told, "shared")
            sent = stored.join(known, "chunk").mapInArrow(send_runs, SENT)
            shards = sent.repartition("key").sortWithinPartitions("key", "doc")
            marks = shards.mapInArrow(locate(shard_rows, shard_bytes), "chunk long, entry int, bits int")
            marked = marks.repartition(buckets, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("entry", "bits")).alias("marks"))
            last = stored.join(known, "chunk", "left").join(marked, "chunk", "left")
            schema = f"{RESULT}, kept_text string" if with_text else RESULT
            return materialize(last.mapInArrow(remove(with_text), schema), "substring-dedup-result")
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
