"""Alignment of two tokenizers' tokens over whole texts, by merge-path partitioning of their ends.

Byte offsets where a token of A and one of B both end cut a text into groups. Both lists of ends ascend, so
finding common ends is a merge. Its path crosses every diagonal of the grid of both lists once, where a binary
search finds it; diagonals at equal distances cut the merge into pieces of equal work that know nothing of
each other, however the texts' lengths differ. A piece emits the common ends in it; where two equal ends fall
on both sides of a border, the neighbouring pieces are stitched there.

A text is encoded in units that no token of either crosses: a run of white space that begins with a space or
a line break, with what follows it. Units seen before are not encoded again. Links of tokens are kept per document as
distinct id pairs with their multiplicity. How many documents hold a pair is counted by one aggregation; the
counts come back to the documents in slices of bounded size, so any number of pairs is met with bounded memory.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleflow.llm.blocks import text_blocks
from ruleflow.storage import Scratch, materialize

BLOCK_BYTES = 1 << 20
# Ends of both lists that one piece merges.
PIECE = 1 << 16
# Distinct pairs whose counts are broadcast at once; a slice has at most the pairs of one id of A more.
SLICE_PAIRS = 2 << 20
# Pairs that are laid out at once.
LINK_ROWS = 2 << 20
# Units that a worker keeps, and their characters.
KEPT_UNITS, KEPT_CHARS = 300_000, 16 << 20

UNIT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
SPACE = "▁"


def byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable bytes stand for themselves, the others follow from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def take(values: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` that begin at ``first``, one after the other."""
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - first, sizes)]


class Ragged:
    """Number lists that are appended and read by their index."""

    def __init__(self):
        self.values, self.sizes, self.ready = [], [], None

    def append(self, values: list[int]) -> None:
        self.values += values
        self.sizes.append(len(values))

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All values, and the first place and size of each list."""
        if self.ready is None or len(self.ready[2]) < len(self.sizes):
            sizes = np.array(self.sizes, np.int64)
            self.ready = np.array(self.values, np.int32), np.cumsum(sizes) - sizes, sizes
        return self.ready


class Tokenizers:
    """Both vocabularies, and the tokens of units seen before."""

    def __init__(self, byte_model: str, piece_model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_model)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        letters = byte_letters()
        self.a_bytes = [b""] * self.a.get_vocab_size(True)
        for piece, i in self.a.get_vocab(True).items():
            self.a_bytes[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        if any(SPACE in p[1:] and set(p) != {SPACE} or "\n" in p for p in pieces):
            raise ValueError("a piece crosses a word or line boundary")
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.a_tokens, self.b_tokens = Ragged(), Ragged()
        self.same: list[bool] = []
        self.chars = 0

    def units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all units of all texts, each text after a space, and the units of each text."""
        if len(self.same) > KEPT_UNITS or self.chars > KEPT_CHARS:
            self.forget()
        split = [UNIT.findall(" " + text) for text in texts]
        numbers = self.numbers
        fresh = list(dict.fromkeys(u for units in split for u in units if u not in numbers))
        if fresh:
            # After a line break a unit of B begins anew; the space that B adds and the break come before it.
            found = zip(fresh, self.a.encode_batch(fresh, add_special_tokens=False), self.b.encode(["\n" + u for u in fresh], num_threads=1), strict=True)
            for unit, a, b in found:
                numbers[unit] = len(self.same)
                self.a_tokens.append(a.ids)
                self.b_tokens.append(b[2:])
                data = unit.encode()
                self.same.append(data == b"".join([self.a_bytes[i] for i in a.ids]) == b"".join([self.b_bytes[i] for i in b[2:]]))
                self.chars += len(unit)
        sizes = np.array([len(units) for units in split], np.int64)
        return np.fromiter((numbers[u] for units in split for u in units), np.int64, sizes.sum()), sizes


# Merge path


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of the first ``d`` merged elements are from ``a``, for each diagonal ``d``; of equals, that of ``a`` comes first."""
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        i, j = middle[open_], (diagonals - middle)[open_] - 1
        from_a = a[i] <= b[j]  # then more than i of them are from a
        low[open_] = np.where(from_a, i + 1, low[open_])
        high[open_] = np.where(from_a, high[open_], i)
    return low


def common_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """The places in ``a`` and in ``b``, both strictly ascending, of the ends they share."""
    diagonals = np.r_[np.arange(0, len(a) + len(b), piece), len(a) + len(b)]
    in_a = crossings(a, b, diagonals)
    in_b = diagonals - in_a
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i0, i1, j0, j1 in zip(in_a[:-1].tolist(), in_a[1:].tolist(), in_b[:-1].tolist(), in_b[1:].tolist(), strict=True):
        if i0 and j0 < len(b) and a[i0 - 1] == b[j0]:  # stitched: the piece before ends between two equal ends
            found_a.append(np.array([i0 - 1]))
            found_b.append(np.array([j0]))
        own, other = a[i0:i1], b[j0:j1]
        if len(other):
            place = np.minimum(np.searchsorted(other, own), len(other) - 1)
            equal = np.flatnonzero(other[place] == own)
            found_a.append(equal + i0)
            found_b.append(place[equal] + j0)
    return np.concatenate(found_a), np.concatenate(found_b)


# Documents


class Digits:
    """Decimal numbers below a bound, as bytes that are laid out together."""

    def __init__(self, bound: int):
        texts = [str(i).encode() for i in range(bound)]
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.first = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.data = np.frombuffer(b"".join(t + b"," for t in texts), np.uint8)

    def write(self, values: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All values, each with its separator, and where each one ends."""
        sizes = self.sizes[values] + 1
        ends = np.cumsum(sizes)
        out = take(self.data, self.first[values], sizes)
        out[ends - 1] = separators
        return out, ends


def counted(owner: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, id) and how often each is there."""
    pair, times = np.unique(owner * width + ids, return_counts=True)
    return pair // width, pair % width, times


class Alignment:
    """The groups and links of a block of texts that both tokenizers render byte by byte."""

    def __init__(self, models: Tokenizers, texts: list[str], digits: Digits, piece: int = PIECE):
        unit, sizes = models.units(texts)
        doc = np.repeat(np.arange(len(texts)), sizes)
        same = np.array(models.same, bool)[unit] if len(unit) else np.empty(0, bool)
        usable = np.array([bool(t) for t in texts], bool)
        usable[doc[~same]] = False
        keep = usable[doc] if len(unit) else same
        unit, doc = unit[keep], doc[keep]
        self.documents = len(texts)
        self.a, a_doc = self.tokens(models.a_tokens, unit, doc)
        self.b, b_doc = self.tokens(models.b_tokens, unit, doc)
        a_cut, b_cut = common_ends(np.cumsum(models.a_lengths[self.a]), np.cumsum(models.b_lengths[self.b]), piece)
        self.a_size, self.b_size = np.diff(np.r_[-1, a_cut]), np.diff(np.r_[-1, b_cut])  # tokens of each group
        self.group_doc = a_doc[a_cut]
        self.n_a, self.n_b = np.bincount(a_doc, minlength=len(texts)), np.bincount(b_doc, minlength=len(texts))
        self.n_groups = np.bincount(self.group_doc, minlength=len(texts))
        before = np.r_[0, np.cumsum(self.a_size * self.b_size)]
        ends = np.cumsum(self.n_groups)
        self.n_links = before[ends] - before[ends - self.n_groups]
        self.digits = digits
        self.width = len(models.b_bytes)

    @staticmethod
    def tokens(kept: Ragged, unit: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values, first, sizes = kept.arrays()
        return take(values, first[unit], sizes[unit]).astype(np.int64), np.repeat(doc, sizes[unit])

    def texts(self) -> list[bytes]:
        """The groups of each text: ids of A, a bar, ids of B; groups are parted by semicolons."""
        a_before = np.cumsum(self.a_size) - self.a_size
        b_before = np.cumsum(self.b_size) - self.b_size
        values = np.empty(len(self.a) + len(self.b), np.int64)
        values[np.arange(len(self.a)) + np.repeat(b_before, self.a_size)] = self.a
        values[np.arange(len(self.b)) + np.repeat(a_before + self.a_size, self.b_size)] = self.b
        separators = np.full(len(values), ord(","), np.uint8)
        ends = np.cumsum(self.a_size + self.b_size)
        separators[ends - self.b_size - 1] = ord("|")
        separators[ends - 1] = ord(";")
        data, stops = self.digits.write(values, separators)
        stops = np.r_[0, stops][np.cumsum(self.n_a + self.n_b)]
        view = memoryview(data)
        return [bytes(view[a : b - 1]) if b > a else b"" for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct linked pairs of each document, ``a * width + b`` in ascending order: document, pair, links."""
        group = np.arange(len(self.a_size))
        a_group, a, a_times = counted(np.repeat(group, self.a_size), self.a, 1 << 32)
        b_group, b, b_times = counted(np.repeat(group, self.b_size), self.b, 1 << 32)
        b_each = np.bincount(b_group, minlength=len(group))
        b_first = np.cumsum(b_each) - b_each
        partners = b_each[a_group]
        total = np.r_[0, np.cumsum(partners)]
        parts = []
        low = 0
        while low < len(a):  # rows of A ids, so many that about LINK_ROWS pairs come of them
            high = max(low + 1, int(np.searchsorted(total, total[low] + LINK_ROWS, side="right")) - 1)
            own = np.repeat(np.arange(low, high), partners[low:high])
            other = take(np.arange(len(b)), b_first[a_group[low:high]], partners[low:high])
            parts.append(self.merged(self.group_doc[a_group[own]], a[own] * self.width + b[other], a_times[own] * b_times[other]))
            low = high
        if not parts:
            return (np.empty(0, np.int64),) * 3
        return parts[0] if len(parts) == 1 else self.merged(*map(np.concatenate, zip(*parts, strict=True)))

    @staticmethod
    def merged(doc: np.ndarray, pair: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort((doc << 40) + pair, kind="stable")
        doc, pair, links = doc[order], pair[order], links[order]
        first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])])
        return doc[first], pair[first], np.add.reduceat(links, first)


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
LINKS = "pairs array<long>, links array<long>, n_best long, count_sum long"


def aligned(byte_model: str, piece_model: str, piece: int, with_groups: bool) -> Callable:
    """``ALIGNED``, the text of groups if wanted, and ``LINKS`` with zeros for what corpus counts tell."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = Tokenizers(byte_model, piece_model)
        digits = Digits(max(len(models.a_bytes), len(models.b_bytes)))
        for block in text_blocks(batches, "text", BLOCK_BYTES):
            found = Alignment(models, [t or "" for t in block.column("text").to_pylist()], digits, piece)
            groups = found.texts()
            doc, pair, links = found.pairs()
            offsets = pa.array(np.r_[0, np.cumsum(np.bincount(doc, minlength=found.documents))].astype(np.int32))
            zeros = pa.array(np.zeros(found.documents, np.int64))
            columns = [
                block.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)),
                pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups]),
                *([pa.array([g.decode() for g in groups], pa.string())] if with_groups else []),
                pa.ListArray.from_arrays(offsets, pa.array(pair)), pa.ListArray.from_arrays(offsets, pa.array(links)), zeros, zeros,
            ]
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if with_groups else [])]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "pairs", "links", "n_best", "count_sum"])

    return run


def add_counts(shared) -> Callable:
    """Adds what a slice of pairs, ascending, with its counts and marks says of each document's links."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            pairs, links = batch.column("pairs"), batch.column("links").flatten().to_numpy()
            offsets = pairs.offsets.to_numpy() - pairs.offsets[0].as_py()
            values = pairs.flatten().to_numpy()
            place = np.minimum(np.searchsorted(known, values), len(known) - 1)
            links = np.where(known[place] == values, links, 0)
            columns = {name: batch.column(name) for name in batch.schema.names}
            for name, added in (("n_best", links * best[place]), ("count_sum", links * counts[place])):
                total = np.r_[0, np.cumsum(added)]
                columns[name] = pa.array(batch.column(name).to_numpy() + total[offsets[1:]] - total[offsets[:-1]])
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def pair_counts(links: DataFrame, width: int) -> DataFrame:
    """``(a, pair, documents, best)``: how many documents hold a pair linked, and whether no pair of its A id has more."""
    held = links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("documents"))
    named = held.withColumn("a", F.expr(f"pair div {width}"))
    highest = named.groupBy("a").agg(F.max("documents").alias("highest"))
    return named.join(highest, "a").select("a", "pair", "documents", (F.col("documents") == F.col("highest")).alias("best"))


def slices(pairs: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges of A ids, ends exclusive, with about ``most`` pairs each; the list of ids is as long as the vocabulary."""
    found, size, start = [], 0, 0
    each = pairs.groupBy("a").count().orderBy("a").collect()
    for row in each:
        if size and size + row["count"] > most:
            found.append((start, row["a"]))
            start, size = row["a"], 0
        size += row["count"]
    return [*found, (start, each[-1]["a"] + 1)] if each else []


def align(
    docs: DataFrame, byte_model: str, piece_model: str, with_groups: bool = False, piece: int = PIECE, slice_pairs: int = SLICE_PAIRS
) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for every row of ``docs(doc_id, text)``.

    ``n_links`` counts token occurrences of A and B in one group, ``n_best`` those whose pair of ids no pair of the same A id
    exceeds in documents, ``count_sum`` adds up the documents of their pairs. ``with_groups`` adds the groups as
    text. Every row is a document, rows with equal or NULL ids as well. A text that is NULL or empty, or
    that one of the models does not render byte by byte after a space, has zeros and ''. An empty table gives no rows. Other columns are
    not read. Long texts are taken whole.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    width = len(Tokenizers(byte_model, piece_model).b_bytes)
    schema = f"{ALIGNED}, {'groups string, ' if with_groups else ''}{LINKS}"
    with Scratch(spark, "token-alignment") as scratch:
        found = scratch.store(rows.mapInArrow(aligned(byte_model, piece_model, piece, with_groups), schema), "aligned")
        pairs = scratch.store(pair_counts(found, width), "pairs")
        for number, (low, high) in enumerate(slices(pairs, slice_pairs)):
            if number:
                found = scratch.store(found, f"counted-{number}")
            part = pairs.filter((F.col("a") >= low) & (F.col("a") < high)).select("pair", "documents", "best").toArrow().sort_by("pair")
            shared = spark.sparkContext.broadcast(tuple(part.column(n).to_numpy() for n in ("pair", "documents", "best")))
            found = found.mapInArrow(add_counts(shared), schema)
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else [])]
        return materialize(found.select(*names), "token-alignment-result")
