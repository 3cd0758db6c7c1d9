"""Ranked lexical search for a set of items over all documents, with norm buckets as in LEMP.

A score is an inner product: an item's term counts times their weights on one side, a document's impacts on
the other. Both sides get the root of the weight, which makes the lengths of vectors tell most:

1. One pass counts the items' terms in every document; corpus statistics come from what it stored.
2. Impact vectors are stored in descending order of length inside each partition.
3. The longest ones are scored first; an item's tenth-best score there is its threshold for all others, and
   files keep only vectors so long that some item can still want them.
4. A task takes its vectors in buckets of like length. Cauchy-Schwarz on the longest vector of a bucket sends
   the bucket away for most items. For the others, an item's heaviest coordinates are multiplied out, and its
   other coordinates are bounded group by group, again by lengths, and by the length that is left in all.
5. What survives is scored exactly, in 64-bit integers, and raises the thresholds as the task goes on.

Bounds are in doubles with some slack; no result rests on them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleflow.llm.blocks import text_blocks
from ruleflow.storage import Scratch, materialize

TOP = 10
# Characters of items that one pass over the documents takes, which bounds what is broadcast.
PASS_CHARS = 4 << 20
# Vectors of a bucket, and how many values of it are laid out at once.
BUCKET_ROWS, BUCKET_VALUES = 512, 4 << 20
# About so many of the longest vectors give the first thresholds.
HEAD_ROWS = 2048
# Heaviest coordinates of an item that are multiplied out before its rest is bounded, in so many groups of coordinates.
FOCUS, GROUPS = 6, 256
SLACK = 1 + 1e-9

# Bytes of a term stay, A-Z in lower case; every other byte parts terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERM_BYTES).split()


class Vocabulary(dict):
    """Term numbers; -1 for a term that no item has."""

    def __missing__(self, term: bytes) -> int:
        return -1


def ragged(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values.astype(np.int32)))


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column and the size of each list."""
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(offsets)


# 1. Term counts


def count_terms(vocabulary: Vocabulary) -> Callable:
    """``(doc_id, n, terms, tfs)``: all terms of each text, and the items' terms in it with their occurrences."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            sizes, numbers = [], []
            for text in block.column("text").to_pylist():
                terms = terms_of(text)
                sizes.append(len(terms))
                numbers.append(np.fromiter(map(vocabulary.__getitem__, terms), np.int64, len(terms)))
            number, doc = np.concatenate(numbers), np.repeat(np.arange(len(sizes)), sizes)
            known = number >= 0
            width = max(1, len(vocabulary))
            pair, tf = np.unique(doc[known] * width + number[known], return_counts=True)
            each = np.bincount(pair // width, minlength=len(sizes))
            columns = [block.column("doc_id"), pa.array(np.array(sizes, np.int64)), ragged(pair % width, each), ragged(tf, each)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tfs"])

    return run


# 2. Impact vectors


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(weights: np.ndarray, documents: int, occurrences: int) -> Callable:
    """``(doc_id, norm, terms, impacts)`` of documents with a term of an item."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy()
            term, sizes = flat(batch.column("terms"))
            tf = flat(batch.column("tfs"))[0].astype(np.int64)
            m = 25 + 75 * n * documents // occurrences
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, sizes))
            row = np.repeat(np.arange(len(n)), sizes)
            norm = np.sqrt(np.bincount(row, weights=weights[term] * impact.astype(np.float64) ** 2, minlength=len(n)))
            columns = [batch.column("doc_id"), pa.array(norm), ragged(term, sizes), ragged(impact, sizes)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "norm", "terms", "impacts"])

    return run


# 4. and 5. Buckets


class Items:
    """The items of a pass: terms with integer factors, lengths, and heaviest coordinates."""

    def __init__(self, texts: list[str | None]):
        self.vocabulary = Vocabulary()
        terms, counts, sizes = [], [], []
        for text in texts:
            own: dict[int, int] = {}
            for term in terms_of(text):
                number = self.vocabulary.setdefault(term, len(self.vocabulary))
                own[number] = own.get(number, 0) + 1
            terms += own
            counts += own.values()
            sizes.append(len(own))
        self.term, self.count, self.size = (np.array(x, np.int64) for x in (terms, counts, sizes))
        self.first = np.cumsum(self.size) - self.size

    def weigh(self, weights: np.ndarray) -> None:
        self.root = np.r_[np.sqrt(weights.astype(np.float64)), 0.0]
        self.factor = self.count * weights[self.term]
        value = self.count * self.root[self.term]
        item = np.repeat(np.arange(len(self.size)), self.size)
        self.norm = np.sqrt(np.bincount(item, weights=value**2, minlength=len(self.size)))
        order = np.lexsort((-value, item))
        place = np.arange(len(order)) - self.first[item]
        heavy = order[place < FOCUS]  # items stay in their order, so a place belongs to the same item before and after
        slot = item[place < FOCUS], place[place < FOCUS]
        # A missing coordinate is the column of zeros behind the last term.
        self.focus = np.full((len(self.size), FOCUS), len(weights), np.int64)
        self.focus_value = np.zeros((len(self.size), FOCUS))
        self.focus[slot], self.focus_value[slot] = self.term[heavy], value[heavy]
        light = value.copy()
        light[heavy] = 0
        self.rest = np.sqrt(np.bincount(item, weights=light**2, minlength=len(self.size)))
        # Frequent terms, which weigh little, go to groups of their own as far as there are any.
        self.group = np.empty(len(weights), np.int64)
        self.group[np.argsort(weights, kind="stable")] = np.arange(len(weights)) % GROUPS
        squares = np.bincount(item * GROUPS + self.group[self.term], weights=light**2, minlength=len(self.size) * GROUPS)
        self.rest_groups = np.sqrt(squares).reshape(-1, GROUPS)

    def survivors(self, block: np.ndarray, norms: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, item) of a bucket that may reach the item's threshold."""
        active = np.flatnonzero((self.size > 0) & (self.norm * norms.max() * SLACK >= thresholds))
        if not len(active):
            return active, active
        value = block * self.root  # one column for each term, and one of zeros
        rows, items = [], []
        squares = norms**2
        row, term = np.nonzero(block)
        groups = np.bincount(row * GROUPS + self.group[term], weights=value[row, term] ** 2, minlength=len(block) * GROUPS)
        groups = np.sqrt(groups).reshape(-1, GROUPS)
        for low in range(0, len(active), 64):
            some = active[low : low + 64]
            focus = value[:, self.focus[some]]
            done = np.einsum("rif,if->ri", focus, self.focus_value[some])
            left = np.sqrt(np.maximum(squares[:, None] * SLACK - np.einsum("rif,rif->ri", focus, focus), 0))
            bound = done + np.minimum(self.rest[some] * left, groups @ self.rest_groups[some].T)
            row, item = np.nonzero(bound * SLACK + 1 >= thresholds[some])
            rows.append(row)
            items.append(some[item])
        return np.concatenate(rows), np.concatenate(items)

    def scores(self, block: np.ndarray, row: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Exact scores of pairs."""
        found = np.zeros(len(row), np.int64)
        for low in range(0, len(row), 1 << 16):
            r, i = row[low : low + (1 << 16)], item[low : low + (1 << 16)]
            size = self.size[i]
            ends = np.cumsum(size)
            place = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(self.first[i], size)
            products = self.factor[place] * block[np.repeat(r, size), self.term[place]]
            found[low : low + len(r)] = np.add.reduceat(products, ends - size)
        return found


class Best:
    """The best documents of each item so far, at most ``TOP``: by score, then by id, NULL last."""

    def __init__(self, thresholds: np.ndarray):
        self.thresholds = thresholds.astype(np.int64).copy()
        self.item = self.score = self.doc = np.empty(0, np.int64)
        self.null = np.empty(0, bool)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        keep = (score > 0) & (score >= self.thresholds[item])
        if not keep.any():
            return
        item, score, doc, null = (np.r_[a, b[keep]] for a, b in zip((self.item, self.score, self.doc, self.null), (item, score, doc, null), strict=True))
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        place = np.arange(len(item)) - np.repeat(starts, np.diff(np.r_[starts, len(item)]))
        order, item = order[place < TOP], item[place < TOP]
        last = place[place < TOP] == TOP - 1
        self.item, self.score, self.doc, self.null = item, score[order], doc[order], null[order]
        self.thresholds[item[last]] = np.maximum(self.thresholds[item[last]], self.score[last])


FOUND = "item int, doc_id long, score long"


def search(items: Items, thresholds: np.ndarray) -> Callable:
    """The best documents of a partition for each item, as far as they reach its threshold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(thresholds)
        width = len(items.vocabulary) + 1
        step = max(8, min(BUCKET_ROWS, BUCKET_VALUES // width))
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                rows = batch.slice(low, step)
                term, sizes = flat(rows.column("terms"))
                block = np.zeros((rows.num_rows, width), np.int64)
                block[np.repeat(np.arange(rows.num_rows), sizes), term] = flat(rows.column("impacts"))[0]
                row, item = items.survivors(block, rows.column("norm").to_numpy(), best.thresholds)
                if len(row):
                    doc = rows.column("doc_id")
                    ids = doc.fill_null(0).to_numpy()
                    best.add(item, items.scores(block, row, item), ids[row], doc.is_null().to_numpy(zero_copy_only=False)[row])
        columns = [pa.array(best.item.astype(np.int32)), pa.array(best.doc, mask=best.null), pa.array(best.score)]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

    return run


def best_of(found: DataFrame, parts: int = 32) -> DataFrame:
    """Rows with their ``rank`` up to ``TOP``; first inside parts of each item, as many tasks may have found some."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    split = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    ranked = split.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= TOP)
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= TOP)


def ranked_pass(docs: DataFrame, rows: list, scratch: Scratch, name: str, head_rows: int) -> DataFrame:
    """``(item_id, rank, doc_id, score)`` for the items of one pass, a list of bounded size."""
    spark = docs.sparkSession
    items = Items([r["text"] for r in rows])
    counted = scratch.store(docs.mapInArrow(count_terms(items.vocabulary), "doc_id long, n long, terms array<int>, tfs array<int>"), f"counted-{name}")
    total = counted.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences")).first()
    holding = np.zeros(len(items.vocabulary), np.int64)
    for row in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # as many as the pass has terms
        holding[row["term"]] = row["count"]
    weights = np.array([weight(total["documents"], int(h)) for h in holding], np.int64)
    items.weigh(weights)
    weighed = counted.filter(F.size("terms") > 0).mapInArrow(
        impacts(weights, total["documents"], total["occurrences"]), "doc_id long, norm double, terms array<int>, impacts array<int>"
    )
    vectors = scratch.store(weighed.sortWithinPartitions(F.desc("norm")), f"vectors-{name}")
    share = 1 - head_rows / max(1, total["documents"])
    cut = vectors.agg(F.percentile_approx("norm", F.lit(max(0.0, share)), F.lit(10_000))).first()[0] or 0.0
    none = np.ones(len(rows), np.int64)  # only scores above 0 count
    head = scratch.store(vectors.filter(F.col("norm") >= cut).mapInArrow(search(items, none), FOUND), f"head-{name}")
    thresholds = none.copy()
    for row in best_of(head).filter(F.col("rank") == TOP).select("item", "score").collect():  # one row for each item
        thresholds[row["item"]] = max(1, row["score"])
    wanted = items.norm > 0
    least = float((thresholds[wanted] / items.norm[wanted]).min() / SLACK) if wanted.any() else math.inf
    rest = vectors.filter((F.col("norm") < cut) & (F.col("norm") >= least)).mapInArrow(search(items, thresholds), FOUND)
    best = best_of(head.unionByName(rest))
    ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item int, item_id long")
    return best.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, pass_chars: int = PASS_CHARS, head_rows: int = HEAD_ROWS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: for each item its ``TOP`` best documents with a score above 0.

    Equal scores are ordered by id, a NULL id last. Every row of ``docs(doc_id, text)`` is a document and every
    distinct row of ``items(item_id, text)`` an item, rows with the same id as well. A NULL or empty text has no terms;
    such items have no rows, and an empty table on either side gives none. Texts of any length count whole.
    Other columns are not read. Items of any number are taken in passes of about ``pass_chars`` characters.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    chars = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-chars // pass_chars))
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    with Scratch(spark, "lexical-search") as scratch:
        found = None
        for i in range(passes):
            rows = asked.filter(number == i).collect()  # about pass_chars characters
            if rows:
                part = scratch.store(ranked_pass(texts, rows, scratch, str(i), head_rows), f"ranked-{i}")
                found = part if found is None else found.unionByName(part)
        if found is None:
            found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
        return materialize(found, "lexical-search-result")
