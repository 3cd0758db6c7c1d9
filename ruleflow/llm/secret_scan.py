"""Secret scan through a trigram inverted index.

Each rule's regular expression yields a Boolean query over trigrams that every match must satisfy. The
texts of a block are indexed by the trigrams that any query asks for; a query intersects and unites
their postings, and only the texts that are left are searched with the expression itself. A rule without
mandatory trigrams searches every text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleflow.llm.blocks import joined_bytes, text_blocks

# Strings that a part of an expression may stand for; beyond that many, or longer ones, trigrams are taken out.
MOST_STRINGS, MOST_CHARS = 64, 12
# Characters of a class that are told apart; a larger class stands for anything.
FEW_CHARS = 8


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in ASCII mode; ``least`` is the number of characters that ``group`` must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False

    @property
    def compiled(self) -> re.Pattern:
        return compile_rule(self)

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Leftmost matches that do not overlap, in code points; those too short are dropped afterwards."""
        found = self.compiled.finditer(text)
        return [m.span() for m in found if m.end(self.group) - m.start(self.group) >= self.least]


@lru_cache(maxsize=256)
def compile_rule(rule: Rule) -> re.Pattern:
    return re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.ignore_case else 0))


# In the order in which spans with one start are listed. A greedy class with a least length finds what the
# unbounded one finds after dropping short matches, as such matches are whole runs of the class.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{20,}=*", ignore_case=True),
)
RULES = BASE_RULES + MORE_RULES

# A query is None (any text), a trigram, or ("and" | "or", queries).
Query = None | str | tuple


def both(*queries: Query) -> Query:
    """All of the queries; ``None`` asks nothing."""
    kept = tuple(dict.fromkeys(q for q in queries if q is not None))
    return None if not kept else kept[0] if len(kept) == 1 else ("and", kept)


def either(*queries: Query) -> Query:
    """One of the queries; if one asks nothing, nothing is asked."""
    kept = tuple(dict.fromkeys(queries))
    return None if None in kept else kept[0] if len(kept) == 1 else ("or", kept)


def of_strings(strings: set[str]) -> Query:
    """The trigrams of one of the strings, all of them."""
    return either(*[both(*[s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def trigram_query(rule: Rule) -> Query:
    """What the lower-cased bytes of every text with a match satisfy."""
    flags = re.ASCII | (re.IGNORECASE if rule.ignore_case else 0)
    strings, query = required(parser.parse(rule.pattern, flags))
    return both(query, of_strings(strings) if strings is not None else None)


def required(nodes: Iterable) -> tuple[set[str] | None, Query]:
    """The lower-cased strings that the nodes stand for, if they are few, and a query that holds besides."""
    run: set[str] = {""}
    queries: list[Query] = []
    exact = True  # run holds all that the nodes have stood for so far
    for kind, value in nodes:
        strings, query = required_one(kind, value)
        queries.append(query)
        grown = None if strings is None else {a + b for a in run for b in strings}
        if grown is not None and len(grown) <= MOST_STRINGS and max(map(len, grown), default=0) <= MOST_CHARS:
            run = grown
            continue
        queries.append(of_strings(run))
        exact, run = False, {""} if strings is None else strings
        if len(run) > MOST_STRINGS:
            queries.append(of_strings(run))
            run = {""}
    if exact:
        return run, both(*queries)
    return None, both(*queries, of_strings(run))


def required_one(kind: int, value: object) -> tuple[set[str] | None, Query]:
    if kind is op.LITERAL:
        return ({chr(value).lower()} if value < 128 else None), None
    if kind is op.IN:
        return characters(value), None
    if kind is op.SUBPATTERN:
        return required(value[-1])
    if kind is op.BRANCH:
        parts = [required(part) for part in value[1]]
        if all(strings is not None for strings, _ in parts):
            found = set().union(*[strings for strings, _ in parts])
            if len(found) <= MOST_STRINGS:
                return found, either(*[query for _, query in parts])
        return None, either(*[both(query, None if strings is None else of_strings(strings)) for strings, query in parts])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, part = value
        strings, query = required(part)
        if low == 0:
            return (strings | {""} if high == 1 and strings is not None and query is None else None), None
        if low == high == 1:
            return strings, query
        return None, both(query, None if strings is None else of_strings(strings))
    if kind is op.AT:
        return {""}, None
    return None, None


def characters(items: list) -> set[str] | None:
    """The lower-cased characters of a class, if it has a few ASCII ones."""
    found: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL and value < 128:
            found.add(chr(value).lower())
        elif kind is op.RANGE and value[1] < 128:
            found.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return found if len(found) <= FEW_CHARS else None


def trigrams(query: Query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def code(trigram: str) -> int:
    a, b, c = trigram.encode()
    return a << 16 | b << 8 | c


class TrigramIndex:
    """Postings of the wanted trigrams over the texts of a block: trigram to ascending text numbers."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wanted: set[str]):
        self.rows = len(offsets) - 1
        self.postings: dict[str, np.ndarray] = {}
        if not wanted or len(data) < 3:
            return
        flags, lower = tables(frozenset(wanted))
        folded = lower[data].astype(np.uint32)
        codes = folded[:-2] << 16 | folded[1:-1] << 8 | folded[2:]
        hits = np.flatnonzero(flags[codes])
        row = np.searchsorted(offsets, hits, side="right") - 1
        inside = hits + 3 <= offsets[row + 1]
        found = np.unique(codes[hits[inside]].astype(np.int64) * self.rows + row[inside])
        numbers, starts = np.unique(found // self.rows, return_index=True)
        by_code = dict(zip(numbers.tolist(), np.split(found % self.rows, starts[1:]), strict=True)) if len(found) else {}
        self.postings = {t: by_code[c] for t in wanted if (c := code(t)) in by_code}

    def rows_of(self, query: Query) -> np.ndarray:
        if query is None:
            return np.arange(self.rows)
        if isinstance(query, str):
            return self.postings.get(query, np.empty(0, np.int64))
        parts = [self.rows_of(part) for part in query[1]]
        found = parts[0]
        for part in parts[1:]:
            found = np.intersect1d(found, part, assume_unique=True) if query[0] == "and" else np.union1d(found, part)
        return found


@lru_cache(maxsize=4)
def tables(wanted: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which of all trigrams are wanted, and the lower-case form of every byte."""
    flags = np.zeros(1 << 24, bool)
    flags[[code(t) for t in wanted]] = True
    return flags, np.frombuffer(bytes(range(256)).lower(), np.uint8)


@lru_cache(maxsize=16)
def plan(rules: tuple[Rule, ...]) -> tuple[list[tuple[Rule, Query]], set[str]]:
    queries = [(rule, trigram_query(rule)) for rule in rules]
    return queries, set().union(*[trigrams(query) for _, query in queries])


def find_spans(block: pa.RecordBatch, rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """For each text of the block, ``(start, rule number, end)`` in order."""
    queries, wanted = plan(rules)
    index = TrigramIndex(*joined_bytes(block, "text"), wanted)
    texts = block.column("text").to_pylist()
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for number, (rule, query) in enumerate(queries):
        for row in index.rows_of(query).tolist():
            if texts[row]:
                found[row].extend((start, number, end) for start, end in rule.spans(texts[row]))
    return [sorted(spans) for spans in found]


def listing(spans: Iterable[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[number].kind}:{start}:{end}" for start, number, end in spans)


def scan(docs: DataFrame, more_rules: tuple[Rule, ...] = MORE_RULES) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` for every row of ``docs(doc_id, text)``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then by rule; ``base_sha256`` is
    the digest of those of the base rules alone, which more rules never change. A NULL or empty text has
    none; NULL ids and repeated rows stay; other columns are not read.
    """
    rules = BASE_RULES + tuple(more_rules)

    def rows(block: pa.RecordBatch) -> pa.RecordBatch:
        found = find_spans(block, rules)
        counts = [[sum(n == kind for _, n, _ in spans) for spans in found] for kind in range(len(BASE_RULES))]
        base = [listing((s for s in spans if s[1] < len(BASE_RULES)), rules) for spans in found]
        columns = [
            block.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts],
            pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base]), pa.array([listing(s, rules) for s in found]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    selected = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return selected.mapInArrow(
        each_block(rows), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def each_block(function: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(function, text_blocks(batches, "text"))

    return run


def redact(text: str, spans: Iterable[tuple[int, int, int]], rules: tuple[Rule, ...] = RULES) -> str:
    """The text with every span, overlapping ones as one, replaced by ``[kind]`` of its first rule."""
    out, done = [], 0
    merged: list[list[int]] = []
    for start, number, end in spans:
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([start, number, end])
    for start, number, end in merged:
        out += [text[done:start], f"[{rules[number].kind}]"]
        done = end
    return "".join([*out, text[done:]])


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced and, if there is one, ``n_chars`` counted anew for changed texts."""

    def rows(block: pa.RecordBatch) -> pa.RecordBatch:
        found = find_spans(block, rules)
        before = block.column("text").to_pylist()
        after = [redact(t, spans, rules) if spans else t for t, spans in zip(before, found, strict=True)]
        columns = {name: block.column(name) for name in block.schema.names}
        columns["text"] = pa.array(after, block.schema.field("text").type)
        if "n_chars" in columns:
            counts = [
                len(new) if spans else n
                for new, spans, n in zip(after, found, columns["n_chars"].to_pylist(), strict=True)
            ]
            columns["n_chars"] = pa.array(counts, block.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(each_block(rows), docs.schema)
