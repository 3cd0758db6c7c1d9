"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints that share a routing key lie in one group. A group is sorted by Gray rank, so that
neighbours differ in few bits, and a tree is laid over the sorted order: a node holds the bits on which
everything below it agrees, less the bits that its ancestors hold already. A search adds up the
differences from the root down and drops a node, with all that is below it, once they exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleflow.llm.blocks import text_blocks
from ruleflow.llm.components import connected_components
from ruleflow.storage import Scratch, materialize

RADIUS = 3
WORDS = 3
FANOUT = 8
# Rows of a routing key that one task takes at once; a larger key is worked off in pairs of such parts.
PART_ROWS = 8192
# Rows that a task gathers before it builds trees over them.
TASK_ROWS = 1 << 18
# Query and node pairs that a search holds at a time.
FRONTIER = 1 << 20

BYTE_SUMS = np.uint64(0x0101010101010101)


def shingle_hashes(data: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the ``words``-word shingles of a text, repeats included."""
    found = data.lower().split()  # bytes: lowers A-Z only and splits on \\x20 and \\x09-\\x0D only
    if not found:
        return np.empty(0, np.uint64)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), 42)], np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(word) + 1 for word in found])
    starts = [0, *ends[:-words].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)),
        np.uint64, len(starts),
    )


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; no hashes give zero."""
    counts = np.zeros((8, 8), np.int64)  # [shift, byte]
    for start in range(0, len(hashes), 255):
        part = hashes[start : start + 255]
        for shift in range(8):
            sums = ((part >> np.uint64(shift)) & BYTE_SUMS).sum(dtype=np.uint64)
            counts[shift] += np.frombuffer(sums.tobytes(), np.uint8)
    bits = 2 * counts.T.ravel() > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def digest() -> Column:
    """A hash of the text by which rows of one id are told apart; NULL is empty."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``(doc_id, digest, fp)`` with the 64 bits of the fingerprint as a long; a NULL text is empty, which gives zero."""

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            found = [majority(shingle_hashes((t or "").encode(), words)) for t in block.column("text").to_pylist()]
            fp = np.array(found, np.uint64).view(np.int64)
            columns = [block.column("doc_id"), block.column("digest"), pa.array(fp)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), digest().alias("digest"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(compute, "doc_id long, digest long, fp long")


def routes() -> list[tuple[int, list[tuple[int, int]]]]:
    """The 16 routing keys as lists of (first bit, width) slices.

    Two fingerprints within 3 bits agree on one of four 16-bit blocks. The other 48 bits, cut in four
    again, hold the differences, so they agree on one of those 12-bit slices too.
    """
    found = []
    for block in range(4):
        rest = [bit for other in range(4) if other != block for bit in range(16 * other, 16 * other + 16)]
        for part in range(4):
            bits = rest[12 * part : 12 * part + 12]
            slices, start = [(16 * block, 16)], bits[0]
            for one, following in zip(bits, [*bits[1:], None], strict=True):
                if following != one + 1:
                    slices.append((start, one - start + 1))
                    start = following
            found.append((4 * block + part, slices))
    return found


def routed(distinct: DataFrame) -> DataFrame:
    """``(route, fp)``: every fingerprint under each of its routing keys."""
    keys = []
    for number, slices in routes():
        key = F.lit(number).cast("long")
        for start, width in slices:
            key = F.shiftleft(key, width).bitwiseOR(
                F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            )
        keys.append(key)
    return distinct.select(F.explode(F.array(*keys)).alias("route"), "fp")


def in_parts(rows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """``(route, left_part, right_part, own_part, fp)``: keys with many rows cut into parts, in all pairs of parts.

    A key with ``c`` rows has ``s = ceil(c / part_rows)`` parts. A row goes to the ``s`` pairs that hold its
    part, so no task gets more than two parts of a key and every two rows of the key still meet.
    """
    sizes = rows.groupBy("route").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / part_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    return (
        rows.join(sizes, "route")
        .withColumn("parts", parts)
        .withColumn("own_part", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "route", F.least("own_part", "other").alias("left_part"), F.greatest("own_part", "other").alias("right_part"),
            "own_part", "fp",
        )
    )


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each value in Gray order: neighbours in that order differ in one bit."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Trees over the Gray-sorted fingerprints of each group; ``groups`` are whole numbers, one per fingerprint."""

    def __init__(self, groups: np.ndarray, values: np.ndarray, fanout: int = FANOUT):
        order = np.lexsort((gray_rank(values), groups))
        self.order, self.values = order, values[order]
        first = np.flatnonzero(np.r_[True, np.diff(groups[order]) != 0])
        # A level: first item below each node, shared bits as mask and pattern, first node of each group.
        last = np.r_[np.arange(1, len(values)), len(values)]
        full = np.full(len(values), np.iinfo(np.uint64).max, np.uint64)
        levels = [(np.arange(len(values)), last, full, self.values, first)]
        while len(levels[-1][0]) > len(first):
            low, high, _, _, heads = levels[-1]
            size = np.diff(np.r_[heads, len(low)])
            place = np.arange(len(low)) - np.repeat(heads, size)
            starts = np.flatnonzero(place % fanout == 0)
            ones = np.bitwise_and.reduceat(self._all_ones(levels[-1]), starts)
            zeros = np.bitwise_and.reduceat(self._all_zeros(levels[-1]), starts)
            ends = np.r_[starts[1:], len(low)] - 1
            levels.append((low[starts], high[ends], ones | zeros, ones, np.searchsorted(starts, heads)))
        self.levels = levels
        self.group_of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(values)]))
        # What a node adds to its parent's mask; the parent of a node follows from its place.
        self.residual, self.children = [], []
        for level, (low, _, mask, _, heads) in enumerate(levels):
            if level + 1 == len(levels):
                self.residual.append(mask)
                continue
            above = levels[level + 1]
            parent = np.searchsorted(above[0], low, side="right") - 1
            self.residual.append(mask & ~above[2][parent])
            child = np.searchsorted(low, above[0])
            self.children.append((child, np.r_[child[1:], len(low)]))

    @staticmethod
    def _all_ones(level: tuple) -> np.ndarray:
        return level[2] & level[3]

    @staticmethod
    def _all_zeros(level: tuple) -> np.ndarray:
        return level[2] & ~level[3]

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (in the given order) of all pairs in one group within the radius, each pair once."""
        step = max(1, FRONTIER // 64)
        for start in range(0, len(self.values), step):
            query = np.arange(start, min(start + step, len(self.values)))
            yield from self._search(query, self.group_of[query], np.zeros(len(query), np.int64), len(self.levels) - 1, radius)

    def _search(self, query, node, distance, level, radius) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if len(query) > FRONTIER:
            half = len(query) // 2
            yield from self._search(query[:half], node[:half], distance[:half], level, radius)
            yield from self._search(query[half:], node[half:], distance[half:], level, radius)
            return
        _, high, _, pattern, _ = self.levels[level]
        difference = (self.values[query] ^ pattern[node]) & self.residual[level][node]
        distance = distance + np.bitwise_count(difference)
        keep = (distance <= radius) & (high[node] > query + 1)  # only what follows the query in the order
        query, node, distance = query[keep], node[keep], distance[keep]
        if not len(query):
            return
        if level == 0:
            yield self.order[query], self.order[node]
            return
        first, end = self.children[level - 1]
        width = end[node] - first[node]
        child = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first[node], width)
        yield from self._search(
            np.repeat(query, width), child, np.repeat(distance, width), level - 1, radius
        )


def star_links(groups: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, smallest value linked to it) that keep the components of all pairs within the radius."""
    label = np.arange(len(values))
    for left, right in GrayIndex(groups, values).pairs(radius):
        while len(left):
            a, b = label[left], label[right]
            open_ = a != b
            if not open_.any():
                break
            left, right, a, b = left[open_], right[open_], a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                shorter = label[label]
                if (shorter == label).all():
                    break
                label = shorter
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def near_links(distinct: DataFrame, radius: int = RADIUS, part_rows: int = PART_ROWS) -> DataFrame:
    """``(a, b)`` links between distinct fingerprints: the components of all pairs within ``radius`` bits (3 at most).

    Not all pairs: a task reports one link for each fingerprint and what it hangs on, so a dense group
    gives as many links as it has members.
    """
    if radius > RADIUS:
        raise ValueError("the routing keys guarantee pairs within 3 bits")
    return links_in(routed(distinct), radius, part_rows)


def links_in(rows: DataFrame, radius: int, part_rows: int = PART_ROWS) -> DataFrame:
    """``(a, b)`` links as in ``near_links`` between the fingerprints of each route of ``rows(route, fp)``, for any radius."""

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def links(table: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = [table.column(name).to_numpy() for name in ("route", "left_part", "right_part")]
            change = np.zeros(table.num_rows, bool)
            for key in keys:
                change[1:] |= key[1:] != key[:-1]
            a, b = star_links(np.cumsum(change), table.column("fp").to_numpy().view(np.uint64), radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= TASK_ROWS:
                table = pa.Table.from_batches(held)
                keys = [table.column(name).to_numpy() for name in ("route", "left_part", "right_part")]
                same = np.logical_and.reduce([key == key[-1] for key in keys])
                whole = int(np.argmax(same))  # the last group may go on in the next batch
                if whole:
                    yield from links(table.slice(0, whole))
                    held, count = table.slice(whole).combine_chunks().to_batches(), table.num_rows - whole
        if count:
            yield from links(pa.Table.from_batches(held))

    group = ["route", "left_part", "right_part"]
    met = in_parts(rows, part_rows).select(*group, "fp")
    ordered = met.repartition(*group).sortWithinPartitions(*group)
    return ordered.mapInArrow(search, "a long, b long")


def grouped(docs: DataFrame, scratch: Scratch, words: int, radius: int, part_rows: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, digest, fp)`` of the rows, and ``(fp, root)``: the component that each fingerprint is in."""
    prints = scratch.store(fingerprints(docs, words), "prints")
    distinct = scratch.store(prints.select("fp").distinct(), "distinct")
    links = scratch.store(near_links(distinct, radius, part_rows).distinct(), "near")
    stars = connected_components(links, scratch).withColumnRenamed("node", "fp")
    return prints, distinct.join(stars, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, part_rows: int = PART_ROWS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs(doc_id, text)``.

    Fingerprints of ``words``-word shingles link at ``radius`` or fewer differing bits; a component's id is
    the smallest ``doc_id`` reachable. Documents of one fingerprint, however many, are one row for the
    search. A NULL or wordless text has fingerprint zero and links like any other; repeated rows stay;
    a NULL ``doc_id`` keeps its row and never is a component's id unless there is no other (then NULL).
    Other columns of ``docs`` are not read.
    """
    with Scratch(docs.sparkSession, "simhash") as scratch:
        prints, components = grouped(docs, scratch, words, radius, part_rows)
        smallest = prints.groupBy("fp").agg(F.min("doc_id").alias("smallest"))
        rooted = scratch.store(components.join(smallest, "fp"), "rooted")
        lowest = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
        found = prints.join(rooted.join(lowest, "root").select("fp", "component_id"), "fp").select(
            "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
        )
        return materialize(found, "simhash-result")


def representatives(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, part_rows: int = PART_ROWS) -> DataFrame:
    """One row of ``docs`` for each component of ``near_duplicates``, with all its columns.

    It is the row with the smallest id (NULL comes last) and, if that id is repeated, the smallest digest of
    its text; of rows alike in both any one.
    """
    with Scratch(docs.sparkSession, "simhash") as scratch:
        prints, components = grouped(docs, scratch, words, radius, part_rows)
        place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
        first = prints.groupBy("fp").agg(F.min(place).alias("first"))
        best = components.join(first, "fp").groupBy("root").agg(F.min("first").alias("first"))
        chosen = scratch.store(best.select(F.col("first.doc_id").alias("_id"), F.col("first.digest").alias("_digest")), "chosen")
        # A row goes along whole, so no name of the caller's meets one of these.
        keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_doc"), digest().alias("_text_digest"))
        same = keyed["_doc"].eqNullSafe(chosen["_id"]) & (keyed["_text_digest"] == chosen["_digest"])
        kept = keyed.join(chosen, same).dropDuplicates(["_id", "_text_digest"])
        return materialize(kept.select("row.*"), "representatives")
