"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a document with features x is ``sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)``. The
pairs cost linear time: their sum is half of the square of the sum less the sum of the squares, for each
of the few factors.

Words are hashed into buckets and weigh by the logarithm of their count, scaled to length one. Structure
statistics of the whole text and the row's ``n_chars`` are put into fixed bins, one feature per bin.
Labels, language, source and id are no features.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleflow.llm.blocks import text_blocks
from ruleflow.storage import Scratch

WORD_BUCKETS = 1 << 15
FACTORS = 8
# Labelled documents that the model is fitted on, chosen by a hash of the id; a larger set is sampled.
FIT_ROWS = 12_000
EPOCHS, BATCH, RATE, DECAY, SEED = 8, 128, 0.05, 1e-5, 7
THRESHOLD = 0.7
HELD_OUT = 2  # of the remainders of crc32(doc_id) by 4

# Statistic, and the upper bounds of its bins.
SHARES = (0.0, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.5, 0.8)
SIZES = (0, 4, 16, 64, 256, 1024, 4096, 16384, 65536, 262144)
STATISTICS = {
    "words": SIZES, "chars": SIZES, "lines": SIZES, "word_length": (0, 2, 3, 4, 5, 6, 7, 8, 10, 14), "upper": SHARES,
    "digits": SHARES, "symbols": SHARES, "punctuation": SHARES, "non_ascii": SHARES, "distinct_words": SHARES,
    "commonest_word": SHARES, "distinct_lines": SHARES, "long_words": SHARES, "one_char_words": SHARES,
    "declared_chars": SIZES,
}
BINS = 12  # of one statistic: those under each bound, above all, and missing
FEATURES = WORD_BUCKETS + BINS * len(STATISTICS)

LOWER_CASE, DIGITS, SYMBOLS, PUNCTUATION = b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&|<>{}[]\\^~_=+@/", b".,;:!?'\"()-"
ALL_BYTES = bytes(range(256))


def share_of(data: bytes, kind: bytes) -> float:
    return 1 - len(data.translate(None, kind)) / len(data) if data else 0.0


def statistics(data: bytes, words: list[bytes], counts: Counter, n_chars: int | None) -> list[float | None]:
    lines = [line for line in data.split(b"\n") if line.strip()]
    n = max(len(words), 1)
    letters = len(data) - len(data.translate(None, LOWER_CASE + LOWER_CASE.upper()))
    return [
        len(words), len(data), len(lines), sum(map(len, words)) / n, share_of(data, LOWER_CASE.upper()) * len(data) / max(letters, 1),
        share_of(data, DIGITS), share_of(data, SYMBOLS), share_of(data, PUNCTUATION), share_of(data, ALL_BYTES[128:]), len(counts) / n,
        max(counts.values(), default=0) / n, len(set(lines)) / max(len(lines), 1), sum(len(w) > 20 for w in words) / n,
        sum(len(w) == 1 for w in words) / n, n_chars,
    ]


def featurise(text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(feature, value) of one document; a text without words still has its statistics."""
    data = text.encode()
    words = data.split()
    counts = Counter(words)
    buckets: dict[int, int] = {}
    for word, count in Counter(data.lower().split()).items():
        bucket = crc32(word) % WORD_BUCKETS
        buckets[bucket] = buckets.get(bucket, 0) + count
    values = np.log1p(np.fromiter(buckets.values(), np.float64, len(buckets)))
    if len(values):
        values /= math.sqrt(float(values @ values))
    bins = []
    for i, (value, bounds) in enumerate(zip(statistics(data, words, counts, n_chars), STATISTICS.values(), strict=True)):
        place = BINS - 1 if value is None or value != value else int(np.searchsorted(bounds, value))
        bins.append(WORD_BUCKETS + BINS * i + place)
    scale = 1 / math.sqrt(len(bins))
    return (
        np.r_[np.fromiter(buckets, np.int64, len(buckets)), np.array(bins, np.int64)].astype(np.int32),
        np.r_[values, np.full(len(bins), scale)].astype(np.float32),
    )


class Machine:
    """Weights of a factorisation machine and its scores."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors

    @staticmethod
    def empty(rng: np.random.Generator) -> Machine:
        return Machine(0.0, np.zeros(FEATURES, np.float32), rng.normal(0, 0.05, (FEATURES, FACTORS)).astype(np.float32))

    def margins(self, features: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins of documents (each from a start to the next, none empty) and the factor sums behind them."""
        linear = np.add.reduceat(self.weights[features] * values, starts)
        parts = self.factors[features] * values[:, None]
        sums = np.add.reduceat(parts, starts, axis=0)
        squares = np.add.reduceat((parts * parts).sum(axis=1), starts)
        return self.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def scores(self, documents: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        features, values, starts = packed(documents)
        margins, _ = self.margins(features, values, starts)
        return 1 / (1 + np.exp(-np.clip(margins.astype(np.float64), -40, 40)))

    def pack(self) -> bytes:
        return np.r_[np.float32(self.bias), self.weights, self.factors.ravel()].astype("<f4").tobytes()

    @staticmethod
    def unpack(data: bytes) -> Machine:
        values = np.frombuffer(data, "<f4")
        return Machine(float(values[0]), values[1 : 1 + FEATURES], values[1 + FEATURES :].reshape(FEATURES, FACTORS))


def packed(documents: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(f) for f, _ in documents])
    return np.concatenate([f for f, _ in documents]), np.concatenate([v for _, v in documents]), np.cumsum(sizes) - sizes


def fit(documents: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
    """Logistic loss by AdaGrad in an order that the seed fixes. With one class only, the bias says so."""
    rng = np.random.default_rng(SEED)
    machine = Machine.empty(rng)
    rate = (labels.sum() + 1) / (len(labels) + 2)
    machine.bias = math.log(rate / (1 - rate))
    if not 0 < labels.sum() < len(labels):
        return machine
    weight_sums, factor_sums = np.full(FEATURES, 1e-6, np.float32), np.full((FEATURES, FACTORS), 1e-6, np.float32)
    bias_sum = 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(documents))
        for start in range(0, len(order), BATCH):
            chosen = order[start : start + BATCH]
            features, values, starts = packed([documents[i] for i in chosen])
            margins, sums = machine.margins(features, values, starts)
            slope = 1 / (1 + np.exp(-np.clip(margins, -40, 40))) - labels[chosen]
            sizes = np.diff(np.r_[starts, len(features)])
            one = np.repeat(slope / len(chosen), sizes).astype(np.float32) * values
            own = machine.factors[features]
            many = one[:, None] * (np.repeat(sums, sizes, axis=0) - own * values[:, None])
            order_of = np.argsort(features, kind="stable")
            touched, first = np.unique(features[order_of], return_index=True)
            for grads, params, totals in ((one, machine.weights, weight_sums), (many, machine.factors, factor_sums)):
                step = np.add.reduceat(grads[order_of], first, axis=0) + DECAY * params[touched]
                totals[touched] += step * step
                params[touched] -= RATE * step / np.sqrt(totals[touched])
            grad = float(slope.mean())
            bias_sum += grad * grad
            machine.bias -= RATE * grad / math.sqrt(bias_sum)
    return machine


def remainder() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))


def with_inputs(docs: DataFrame) -> DataFrame:
    """The columns that the classifier reads; ``n_chars`` may be missing."""
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"), n_chars.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Machine:
    """Fit on ``labels(doc_id, quality)`` outside the held-out rows, on ``rows`` documents at most.

    One task fits the model on that bounded sample; only the finished model, of fixed size, goes to the
    driver. An id with two different labels, a NULL label or no document is left out. Repeated rows of an id count
    once: the first text in order.
    """
    known = (
        labels.filter("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long")).agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        .filter("low = high").filter(remainder() != HELD_OUT)
        .select("doc_id", F.col("low").cast("int").alias("label"))
    )
    present = known.join(docs.select(F.col("doc_id").cast("long")), "doc_id", "left_semi")
    with Scratch(docs.sparkSession, "classifier") as scratch:
        chosen = scratch.store(present.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(rows), "chosen")
        sample = with_inputs(docs).join(chosen, "doc_id").groupBy("doc_id").agg(
            F.min("label").alias("label"), F.min(F.struct("text", "n_chars")).alias("d")
        ).select("doc_id", "label", "d.text", "d.n_chars")
        seen = scratch.store(sample.mapInArrow(feature_rows, "doc_id long, label int, features binary, values binary"), "features")
        model = scratch.store(seen.repartition(1).mapInArrow(fit_rows, "model binary"), "model")
        return Machine.unpack(bytes(model.first().model))


def feature_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in text_blocks(batches, "text"):
        pairs = zip(block.column("text").to_pylist(), block.column("n_chars").to_pylist(), strict=True)
        found = [featurise(text or "", n) for text, n in pairs]
        columns = [
            block.column("doc_id"), block.column("label"), pa.array([f.tobytes() for f, _ in found], pa.binary()),
            pa.array([v.tobytes() for _, v in found], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "features", "values"])


def fit_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((row["doc_id"], row["label"], row["features"], row["values"]) for batch in batches for row in batch.to_pylist())
    documents = [(np.frombuffer(f, np.int32), np.frombuffer(v, np.float32)) for _, _, f, v in rows]
    machine = fit(documents, np.array([label for _, label, _, _ in rows], np.float64))
    yield pa.RecordBatch.from_arrays([pa.array([machine.pack()], pa.binary())], names=["model"])


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs(doc_id, text[, n_chars])``.

    A NULL or empty text is scored by its statistics; a NULL ``doc_id`` is not held out; a NULL ``n_chars``
    is a bin of its own; repeated rows stay; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine.pack())  # of fixed size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Machine.unpack(sent.value)
        for block in text_blocks(batches, "text"):
            pairs = zip(block.column("text").to_pylist(), block.column("n_chars").to_pylist(), strict=True)
            scores = model.scores([featurise(text or "", n) for text, n in pairs])
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    return with_inputs(docs).mapInArrow(run, "doc_id long, score double").select(
        "doc_id", F.coalesce(remainder() == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs(text[, n_chars], …)`` that score ``threshold`` or more, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(machine.pack())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Machine.unpack(sent.value)
        for block in text_blocks(batches, "text"):
            declared = block.column("n_chars").to_pylist() if "n_chars" in block.schema.names else [None] * block.num_rows
            pairs = zip(block.column("text").to_pylist(), declared, strict=True)
            yield block.filter(pa.array(model.scores([featurise(text or "", n) for text, n in pairs]) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Train on the labelled documents and score all of them."""
    return score(docs, train(docs, labels, rows), threshold)
