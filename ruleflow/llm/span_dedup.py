"""Removal of passages that occur in an earlier document, by longest-previous-factor arrays.

A window of 50 bytes goes if it also starts in a document with a smaller id. Windows that are equal share
their anchor, the smallest hash among the 16-byte strings inside. So neighbouring windows with one
anchor form a run, and only runs that share an anchor with another document have to meet:

1. Texts are packed into chunks and stored once, bucketed by chunk, so later passes don't move them.
2. Every chunk sends its anchors; a task gets all of an anchor and answers whether other documents have it.
3. Every chunk sends the bytes of its runs with shared anchors, equal ones once, with the smallest id.
4. Where the runs of an anchor meet, their windows are suffixes, cut at 50 bytes, in suffix order. The
   previous and next positions in that order with a smaller document give the longest match with an
   earlier document (the longest previous factor); 50 bytes or more mark the window.
5. The marks go back to the chunk, whose covered bytes are removed.

An anchor that very many documents have, as at the edge of a common passage, would bring as many
different runs to one task. Its windows go out one by one instead, each under its own hash; equal ones
are one row per chunk, and different ones spread over all tasks.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleflow.llm.blocks import joined_bytes, text_blocks
from ruleflow.storage import Scratch, materialize

WINDOW, ANCHOR = 50, 16
SPAN = WINDOW - ANCHOR + 1  # anchors in a window
RUN = 64  # windows of a run at most, one bit each
# Bytes of text that one chunk holds, that are hashed at once, and whose anchors one bucket gets.
CHUNK_BYTES, BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 1 << 20, 4 << 20
MOST_BUCKETS = 1 << 16
# An anchor in more documents than this sends its windows one by one.
HOT_DOCUMENTS = 20_000

ALL = np.iinfo(np.uint64).max
LAST_ID = np.iinfo(np.int64).max


def mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return values ^ (values >> np.uint64(33))


def lanes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number; the places past the end read zeros."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    views = [padded[i : i + (len(data) + 8 - i) // 8 * 8].view(np.uint64) for i in range(8)]
    found = np.empty(len(data) + 8, np.uint64)
    for i, view in enumerate(views):
        found[i : i + 8 * len(view) : 8] = view
    return found[: len(data)]


def anchors(data: np.ndarray) -> np.ndarray:
    """The smallest anchor hash of the window that starts at each place of ``data`` that has room for one."""
    lane = lanes(data)
    n = len(data) - ANCHOR + 1
    hashes = mix(lane[:n] * np.uint64(0x9E3779B97F4A7C15) + lane[8 : 8 + n])
    # The smallest of SPAN neighbours: of the end of one stretch and the beginning of the next.
    padded = np.full(-(-n // SPAN) * SPAN, ALL, np.uint64)
    padded[:n] = hashes
    table = padded.reshape(-1, SPAN)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(data) - WINDOW + 1
    return np.minimum(behind[:windows], ahead[SPAN - 1 : SPAN - 1 + windows])


class Runs:
    """Runs of windows of a chunk: text number, first byte in the chunk, number of windows and anchor key."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray):
        ends = np.cumsum(sizes)
        found = []
        for low in range(0, len(data), BLOCK_BYTES):
            high = min(low + BLOCK_BYTES, len(data))
            part = data[low : high + WINDOW - 1]
            if len(part) < WINDOW:
                continue
            keys = anchors(part)
            first = int(np.searchsorted(ends, low, side="right"))
            last = int(np.searchsorted(ends, low + len(keys) - 1, side="right"))
            inside = np.diff(np.r_[low, np.minimum(ends[first : last + 1], low + len(keys))])
            text = np.repeat(np.arange(first, last + 1), inside)
            room = np.repeat(ends[first : last + 1], inside) - np.arange(low, low + len(keys)) >= WINDOW
            change = np.r_[True, (keys[1:] != keys[:-1]) | (text[1:] != text[:-1]) | (room[1:] != room[:-1])]
            starts = np.flatnonzero(change)
            lengths = np.diff(np.r_[starts, len(keys)])
            keep = room[starts]
            starts, lengths = starts[keep], lengths[keep]
            parts = -(-lengths // RUN)
            number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            begin = np.repeat(starts, parts) + number * RUN
            size = np.minimum(np.repeat(lengths, parts) - number * RUN, RUN)
            found.append((text[begin], begin + low, size, mix(keys[begin])))
        if not found:
            found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))]
        self.text, self.start, self.size, self.key = map(np.concatenate, zip(*found, strict=True))


class AnchorEntries:
    """The distinct anchors of a chunk by bucket and key, how many texts have each, and each run's anchor."""

    def __init__(self, runs: Runs, buckets: int):
        order = np.lexsort((runs.text, runs.key, runs.key % np.uint64(buckets)))
        key, text = runs.key[order], runs.text[order]
        new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.empty(0, bool)
        number = np.cumsum(new) - 1
        self.key = key[new]
        self.bucket = (self.key % np.uint64(buckets)).astype(np.int64)
        other = np.r_[True, (text[1:] != text[:-1])] | new if len(key) else new
        self.texts = np.minimum(np.bincount(number[other], minlength=len(self.key)), 65_535).astype(np.uint16)
        self.of_run = np.empty(len(key), np.int64)
        self.of_run[order] = number


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The stretch of each bucket in an ascending array."""
    numbers, starts = np.unique(bucket, return_index=True)
    for number, low, high in zip(numbers.tolist(), starts, [*starts[1:], len(bucket)], strict=False):
        yield number, slice(int(low), int(high))


def squeeze(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(a.tobytes() for a in arrays), 1)


class Reader:
    """Takes arrays from what ``squeeze`` wrote, in the same order."""

    def __init__(self, data: bytes):
        self.data, self.place = zstandard.decompress(data) if data else b"", 0

    def take(self, dtype: type, count: int) -> np.ndarray:
        found = np.frombuffer(self.data, dtype, count, self.place)
        self.place += found.nbytes
        return found


# 1. Chunks


CHUNK = "chunk long, ids array<long>, sizes array<long>, data binary"


def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs the rows of a partition; the ids of chunks follow from the partition and their order in it."""
    number = TaskContext.get().partitionId() << 32
    for block in text_blocks(batches, "text", CHUNK_BYTES, 1 << 20):
        data, offsets = joined_bytes(block, "text")
        columns = [
            pa.array([number]), pa.array([block.column("doc_id").to_pylist()], pa.list_(pa.int64())),
            pa.array([np.diff(offsets)]), pa.array([squeeze(data)], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "sizes", "data"])
        number += 1


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, sizes and order of the texts of a chunk; a NULL id comes after all others."""
    data = np.frombuffer(zstandard.decompress(row["data"]), np.uint8) if row["data"] else np.empty(0, np.uint8)
    order = np.array([LAST_ID if i is None else i for i in row["ids"]], np.int64)
    return data, np.array(row["sizes"], np.int64), order


# 2. Anchors


PART = "chunk long, bucket int, data binary"


def parts(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    chunk, bucket, data = zip(*rows, strict=True) if rows else ((), (), ())
    columns = [pa.array(chunk, pa.int64()), pa.array(bucket, pa.int32()), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["chunk", "bucket", "data"])


def pack_anchors(keys: np.ndarray, texts: np.ndarray) -> bytes:
    """Keys are as good as random and stay as they are; the counts, most of them one, are compressed."""
    return np.int64(len(keys)).tobytes() + keys.tobytes() + squeeze(texts)


def unpack_anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    return np.frombuffer(data, np.uint64, n, 8), Reader(data[8 + 8 * n :]).take(np.uint16, n)


def send_anchors(buckets: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            data, sizes, _ = unpack(row)
            entries = AnchorEntries(Runs(data, sizes), buckets)
            yield parts([
                (row["chunk"], bucket, pack_anchors(entries.key[s], entries.texts[s]))
                for bucket, s in by_bucket(entries.bucket)
            ])

    return run


def each_row(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def each_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """(bucket, chunks, data) of rows that come by bucket."""
    bucket, chunk, data = None, [], []
    for batch in batches:
        for c, b, d in zip(*[batch.column(n).to_pylist() for n in ("chunk", "bucket", "data")], strict=True):
            if b != bucket and chunk:
                yield bucket, chunk, data
                chunk, data = [], []
            bucket = b
            chunk.append(c)
            data.append(d)
    if chunk:
        yield bucket, chunk, data


def answer_anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each anchor 0 if one text has it, 1 if more have, 2 if very many have."""
    for bucket, chunk, data in each_bucket(batches):
        keys, texts = zip(*map(unpack_anchors, data), strict=True)
        counts = list(map(len, keys))
        keys, texts = np.concatenate(keys), np.concatenate(texts)
        _, number = np.unique(keys, return_inverse=True)
        total = np.bincount(number, weights=texts)[number]
        flags = np.where(total < 2, 0, np.where(total <= HOT_DOCUMENTS, 1, 2)).astype(np.uint8)
        ends = np.cumsum(counts)
        yield parts([
            (c, bucket, squeeze(flags[end - n : end])) for c, n, end in zip(chunk, counts, ends, strict=True)
        ])


# 3. Runs


def answers(row: dict) -> dict[int, bytes]:
    return {a["bucket"]: a["data"] for a in row["answers"] or []}


def send_runs(buckets: int) -> Callable:
    """The distinct shared runs by bucket, and under a bucket below zero what the chunk has to remember of its runs.

    That one passes through the next step unchanged, so both need one exchange and nothing is stored between.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            data, sizes, order = unpack(row)
            runs = Runs(data, sizes)
            entries = AnchorEntries(runs, buckets)
            given = answers(row)
            flags = np.zeros(len(entries.key), np.uint8)
            for bucket, s in by_bucket(entries.bucket):
                flags[s] = Reader(given[bucket]).take(np.uint8, s.stop - s.start)
            own = -1 - hash(row["chunk"]) % buckets
            rows = shared_runs(data, runs, order, flags[entries.of_run], buckets)
            yield parts([(row["chunk"], own if b is None else b, d) for b, d in rows])

    return run


def shared_runs(data, runs: Runs, order, flags, buckets: int) -> Iterator[tuple[int | None, bytes]]:
    warm, hot = np.flatnonzero(flags == 1), np.flatnonzero(flags == 2)
    size = runs.size[hot]
    single = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(runs.start[hot], size)
    text = np.r_[runs.text[warm], np.repeat(runs.text[hot], size)]
    start = np.r_[runs.start[warm], single]
    count = np.r_[runs.size[warm], np.ones(len(single), np.int64)]
    content = hashes_of(data, start, start + count + WINDOW - 1)
    key = np.r_[runs.key[warm], content[len(warm) :]]  # a window by itself goes under its own hash
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    place = np.lexsort((order[text], content, key, bucket))
    new = np.r_[True, (key[place][1:] != key[place][:-1]) | (content[place][1:] != content[place][:-1])][: len(place)]
    first = place[new]  # of each distinct run, one in the text with the smallest id
    entry = np.empty(len(place), np.int64)
    entry[place] = np.cumsum(new) - 1
    later = order[text] > order[text][first][entry] if len(place) else np.empty(0, bool)
    yield None, squeeze(text.astype(np.int32), start, count.astype(np.uint8), entry.astype(np.int32), later)
    view = memoryview(data)
    for number, s in by_bucket(bucket[first]):
        chosen = first[s]
        bytes_of = [view[a : a + n + WINDOW - 1] for a, n in zip(start[chosen].tolist(), count[chosen].tolist(), strict=True)]
        joined = np.frombuffer(b"".join(bytes_of), np.uint8)
        yield number, squeeze(
            np.array([len(chosen)], np.int64), key[chosen], order[text[chosen]], count[chosen].astype(np.uint8), joined
        )


def hashes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh64_intdigest
    return np.fromiter((digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


# 4. Longest previous factors


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """The nearest place before each one with a smaller value, or -1, by jumping along the answers so far."""
    found = np.arange(len(values)) - 1
    open_ = np.flatnonzero(found >= 0)
    while len(open_):
        open_ = open_[values[found[open_]] >= values[open_]]
        found[open_] = found[found[open_]]
        open_ = open_[found[open_] >= 0]
    return found


def next_smaller(values: np.ndarray) -> np.ndarray:
    """The nearest place after each one with a smaller value, or -1."""
    found = previous_smaller(values[::-1])[::-1]
    return np.where(found < 0, -1, len(values) - 1 - found)


def common_prefix(windows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Equal leading bytes of pairs of windows; none where the right one is -1."""
    differ = windows[left] != windows[right]
    length = np.where(differ.any(axis=1), differ.argmax(axis=1), windows.shape[1])
    return np.where(right < 0, 0, length)


def longest_previous(windows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each window (a row of bytes) the longest match with a window of a text with a smaller order."""
    rows = np.ascontiguousarray(windows).view(f"S{windows.shape[1]}")[:, 0]
    place = np.argsort(rows, kind="stable")  # suffix order
    sorted_windows, ranks = windows[place], order[place]
    here = np.arange(len(place))
    longest = np.maximum(
        common_prefix(sorted_windows, here, previous_smaller(ranks)), common_prefix(sorted_windows, here, next_smaller(ranks))
    )
    found = np.empty(len(place), np.int64)
    found[place] = longest
    return found


def marks(key: np.ndarray, order: np.ndarray, count: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For each run the bits of its windows that a text with a smaller order has."""
    ends = np.cumsum(count + WINDOW - 1)
    starts = ends - count - WINDOW + 1
    content = hashes_of(data, starts, ends)
    place = np.lexsort((order, content, key))
    new_key = np.r_[True, key[place][1:] != key[place][:-1]]
    new = new_key | np.r_[True, content[place][1:] != content[place][:-1]]
    entry = np.empty(len(place), np.int64)
    entry[place] = np.cumsum(new) - 1
    first = place[new]
    key_of = (np.cumsum(new_key) - 1)[new]
    several = np.flatnonzero(np.bincount(key_of)[key_of] > 1)
    found = np.zeros(len(first), np.uint64)
    if len(several):
        found[several] = window_marks(order[first[several]], starts[first[several]], count[first[several]], data)
    return np.where(order > order[first][entry], ALL, found[entry])


def window_marks(order: np.ndarray, starts: np.ndarray, count: np.ndarray, data: np.ndarray) -> np.ndarray:
    run = np.repeat(np.arange(len(starts)), count)
    bit = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place = starts[run] + bit
    lane = lanes(data)
    hashes = np.zeros(len(place), np.uint64)
    for step in (*range(0, WINDOW - 8, 8), WINDOW - 8):
        hashes = mix(hashes + lane[place + step])
    # A window whose hash is there once has no match. The others are compared byte by byte.
    _, number, times = np.unique(hashes, return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[number] > 1)
    found = np.zeros(len(starts), np.uint64)
    if len(again):
        windows = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[place[again]]
        matched = again[longest_previous(windows, order[run[again]]) >= WINDOW]
        np.bitwise_or.at(found, run[matched], np.uint64(1) << bit[matched].astype(np.uint64))
    return found


def answer_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, chunk, data in each_bucket(batches):
        if bucket < 0:
            yield parts([(c, bucket, d) for c, d in zip(chunk, data, strict=True)])
            continue
        sizes, fields = [], []
        for packed in data:
            reader = Reader(packed)
            n = int(reader.take(np.int64, 1)[0])
            sizes.append(n)
            fields.append((reader.take(np.uint64, n), reader.take(np.int64, n), reader.take(np.uint8, n)))
            fields[-1] += (reader.take(np.uint8, int((fields[-1][2].astype(np.int64) + WINDOW - 1).sum())),)
        key, order, count, joined = map(np.concatenate, zip(*fields, strict=True))
        found = marks(key, order, count.astype(np.int64), joined)
        ends = np.cumsum(sizes)
        yield parts([(c, bucket, squeeze(found[e - n : e])) for c, n, e in zip(chunk, sizes, ends, strict=True)])


# 5. Removal


def covered(data: np.ndarray, row: dict) -> np.ndarray:
    """The bytes of a chunk that marked windows cover."""
    given = answers(row)
    state = zstandard.decompress(given.pop(min(given)))
    n = len(state) // 18
    reader = Reader(b"")
    reader.data = state
    _, start, count, entry, later = (reader.take(t, n) for t in (np.int32, np.int64, np.uint8, np.int32, bool))
    bits = [np.frombuffer(zstandard.decompress(given[b]), np.uint64) for b in sorted(given)]
    mask = np.concatenate(bits)[entry] if bits else np.empty(0, np.uint64)
    mask = np.where(later, ALL, mask)
    edge = np.zeros(len(data) + 1, np.int32)
    whole, some = mask == ALL, np.flatnonzero((mask != ALL) & (mask != 0))
    np.add.at(edge, start[whole], 1)
    np.add.at(edge, start[whole] + count[whole] + WINDOW - 1, -1)
    flags = np.unpackbits(mask[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    which, bit = np.nonzero(flags)
    place = start[some][which] + bit
    np.add.at(edge, place, 1)
    np.add.at(edge, place + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove(with_text: bool) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            data, sizes, _ = unpack(row)
            gone = covered(data, row)
            rows, texts, end = [], [], 0
            for doc, size in zip(row["ids"], sizes.tolist(), strict=True):
                text, out = data[end : end + size], gone[end : end + size]
                end += size
                kept = text[~out].tobytes()
                spans = int(out[:1].sum() + (out[1:] & ~out[:-1]).sum())
                rows.append((doc, size, size - len(kept), spans, hashlib.sha256(kept).hexdigest()))
                texts.append(kept.decode("utf-8", "ignore") if with_text else None)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(texts, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def bucketed(spark: SparkSession, df: DataFrame, column: str, buckets: int, path: str) -> str:
    """Stores ``df`` so that joins on ``column`` do not move it; returns the table's name."""
    name = f"chunks_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).option("path", path).format("parquet").saveAsTable(name)
    return name


def gathered(rows: DataFrame, groups: int) -> DataFrame:
    """All that a chunk is told, one row per chunk; it is as large as what the chunk asked."""
    told = rows.repartition(groups, "chunk").groupBy("chunk")
    return told.agg(F.collect_list(F.struct("bucket", "data")).alias("answers"))


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """``RESULT`` (and ``kept_text``) for every row of ``docs(doc_id, text)``.

    Each byte goes that is covered by a 50-byte string of the text which also starts in a row with a smaller
    ``doc_id``, judged on the texts as given. Repeats inside one text, or in rows with the same id, stay. A
    NULL id comes after all others; a NULL text is empty; other columns are not read. ``kept_text`` drops
    characters that lost some of their bytes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = min(max(1, total // BUCKET_BYTES), MOST_BUCKETS)
    groups = min(max(1, total // CHUNK_BYTES), MOST_BUCKETS)
    by = ["bucket", "chunk"]
    with Scratch(spark, "span-dedup") as scratch:
        name = bucketed(spark, rows.mapInArrow(chunks, CHUNK), "chunk", groups, f"{scratch.path}/chunks")
        try:
            stored = spark.table(name)
            asked = stored.mapInArrow(send_anchors(buckets), PART)
            shared = asked.repartition(buckets, "bucket").sortWithinPartitions(*by).mapInArrow(answer_anchors, PART)
            told = stored.join(gathered(shared, groups), "chunk", "left")
            met = told.mapInArrow(send_runs(buckets), PART).repartition(buckets, "bucket").sortWithinPartitions(*by)
            marked = scratch.store(met.mapInArrow(answer_runs, PART), "marks")
            last = stored.join(gathered(marked, groups), "chunk", "left")
            schema = f"{RESULT}, kept_text string" if with_text else RESULT
            return materialize(last.mapInArrow(remove(with_text), schema), "span-dedup-result")
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
