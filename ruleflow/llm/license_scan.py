"""Licence scan by sentences: known sentences become identifiers, and identifier sequences match ordered rules.

A text is cut into sentences, which are normalised: lower case, words and version numbers only. A sentence
that is known becomes an identifier, possibly with a version; any other one stands for nothing. Where
identifiers follow each other, rules are tried in their order, longer before shorter, and the first that
matches at a place names the licence and uses up its sentences. An identifier that no rule uses is
reported as unresolved.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleflow.llm.blocks import text_blocks

# Sentences of well-known licences and notices, normalised. "{v}" is a version number.
SENTENCES = {
    "apache-notice": (
        "licensed under the apache license version {v}", "licensed under apache license version {v}",
        "licensed under the apache license version {v} the license",
    ),
    "apache-use": ("you may not use this file except in compliance with the license",),
    "apache-copy": ("you may obtain a copy of the license at",),
    "asis-distributed": (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on "
        "an as is basis without warranties or conditions of any kind either express or implied",
    ),
    "apache-see": ("see the license for the specific language governing permissions and limitations under the license",),
    "mit-notice": (
        "released under the mit license", "licensed under the mit license", "this software is released under the mit license",
        "this project is licensed under the mit license",
    ),
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the rights "
        "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to "
        "whom the software is furnished to do so subject to the following conditions",
    ),
    "mit-keep": (
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "software",
    ),
    "mit-asis": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the "
        "warranties of merchantability fitness for a particular purpose and noninfringement",
    ),
    "bsd-grant": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
    ),
    "bsd-source": (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following "
        "disclaimer",
    ),
    "bsd-binary": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
        "disclaimer in the documentation and or other materials provided with the distribution",
    ),
    "bsd-endorse": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission",
    ),
    "gpl-notice": (
        "this work is licensed under the gnu general public license version {v}",
        "licensed under the gnu general public license version {v}",
    ),
    "gpl-free": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version {v} of the license or at your option any later "
        "version",
    ),
    "gpl-hope": (
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied "
        "warranty of merchantability or fitness for a particular purpose",
    ),
    "gpl-see": ("see the gnu general public license for more details",),
    "lgpl-notice": ("licensed under the gnu lesser general public license version {v}",),
    "mpl-notice": (
        "this source code form is subject to the terms of the mozilla public license v {v}",
        "licensed under the mozilla public license version {v}",
    ),
    "cc-notice": (
        "licensed under cc by {v}", "this work is licensed under a creative commons attribution {v} international license",
    ),
    "cc-nc-notice": (
        "licensed under cc by nc {v}",
        "this work is licensed under a creative commons attribution noncommercial {v} international license",
    ),
    "cc-sa-notice": (
        "licensed under cc by sa {v}",
        "this work is licensed under a creative commons attribution sharealike {v} international license",
    ),
    "reserved": ("all rights reserved",),
}


@dataclass(frozen=True)
class Rule:
    """``licence`` may hold ``{v}``, the first version found in the matched sentences."""

    licence: str
    sequence: tuple[str, ...]


# Tried in this order at every place.
RULES = (
    Rule("Apache-{v}", ("apache-notice", "apache-use", "apache-copy", "asis-distributed", "apache-see")),
    Rule("MIT", ("mit-grant", "mit-keep", "mit-asis")),
    Rule("MIT", ("mit-grant", "mit-keep")),
    Rule("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    Rule("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    Rule("GPL-{v}-or-later", ("gpl-free", "gpl-hope", "gpl-see")),
    Rule("GPL-{v}-or-later", ("gpl-free",)),
    Rule("Apache-{v}", ("apache-notice",)),
    Rule("MIT", ("mit-notice",)),
    Rule("GPL-{v}", ("gpl-notice",)),
    Rule("LGPL-{v}", ("lgpl-notice",)),
    Rule("MPL-{v}", ("mpl-notice",)),
    Rule("CC-BY-NC-{v}", ("cc-nc-notice",)),
    Rule("CC-BY-SA-{v}", ("cc-sa-notice",)),
    Rule("CC-BY-{v}", ("cc-notice",)),
)

# A sentence ends at a line break or at .!?; before white space or the end, so that "2.0" holds together.
# A line that ends inside a sentence is joined to the next one by ``wrapped``.
SENTENCE_END = re.compile(r"[.!?;:](?=\s|$)|\n")
WORD = re.compile(r"\d+(?:\.\d+)*|[^\W\d_]+")
VERSION = re.compile(r"\d+(?:\.\d+)*")
URL = re.compile(r"https?://\S+|www\.\S+")
# A sentence of an address or a list number only, which stands between other sentences without parting them.
EMPTY = re.compile(rf"[\W_]*(?:(?:{URL.pattern})[\W_]*|\d{{1,2}}[\W_]*)")


def normalise(sentence: str) -> str:
    return " ".join(WORD.findall(sentence.lower()))


def known_sentences() -> tuple[dict[str, str], set[str]]:
    """Normalised sentence, its version as "{v}", to its identifier; and the first words of all of them."""
    found = {text: name for name, texts in SENTENCES.items() for text in texts}
    return found, {beginning(text.split()) for text in found}


def beginning(words: list[str]) -> str:
    return " ".join(words[:3])


KNOWN, BEGINNINGS = known_sentences()
LONGEST = max(len(text.split()) for text in KNOWN)
# No known sentence lacks all of these; a text without them needs no further look.
HINT = re.compile("licen[cs]e|permi|redistribut|warrant|rights|copyright|free software", re.IGNORECASE)


def identify(sentence: str) -> tuple[str, str | None] | None:
    """(identifier, version) of a normalised sentence, or nothing."""
    if sentence in KNOWN:
        return KNOWN[sentence], None
    version = VERSION.search(sentence)
    if version is None:
        return None
    name = KNOWN.get(sentence[: version.start()] + "{v}" + sentence[version.end() :])
    return name and (name, version.group())


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end (code points) of the sentences that have a word."""
    found, start = [], 0
    for end in [m.start() for m in SENTENCE_END.finditer(text)] + [len(text)]:
        if WORD.search(text, start, end):
            found.append((start, end))
        start = end + 1
    return found


def identified(text: str) -> list[tuple[int, int, str, str | None]]:
    """(first sentence, last sentence, identifier, version) of the known sentences, in order.

    A known sentence may go over line breaks and stops inside it, as in wrapped text: from a place that
    begins like a known one, further sentences are added up to the length of the longest known one. An
    address at the end of or inside a sentence is no part of it.
    """
    spans = sentences(text)
    words = [(normalise(URL.sub(" ", text[a:b])) or normalise(text[a:b])).split() for a, b in spans]
    found, i = [], 0
    while i < len(words):
        match = None
        if beginning(words[i]) in BEGINNINGS or len(words[i]) < 3:
            joined: list[str] = []
            for j in range(i, len(words)):
                joined += words[j]
                if len(joined) > LONGEST:
                    break
                named = identify(" ".join(joined))
                if named:
                    match = (i, j, *named)
        if match:
            found.append(match)
            i = match[1]
        i += 1
    return found


def empty_sentences(text: str) -> set[int]:
    """The numbers of the sentences that hold nothing but an address or a list number."""
    return {i for i, (a, b) in enumerate(sentences(text)) if EMPTY.fullmatch(text, a, b)}


def recognise(
    found: list[tuple[int, int, str, str | None]], empty: set[int] | frozenset[int] = frozenset()
) -> tuple[list[tuple[str, int, int]], list[str]]:
    """Licences with their first and last sentence, and identifiers that no rule used.

    The identifiers of a rule follow each other with no sentence between that is neither known nor ``empty``.
    """
    licences, unresolved, i = [], [], 0
    while i < len(found):
        for rule in RULES:
            part = found[i : i + len(rule.sequence)]
            adjacent = all(empty.issuperset(range(a[1] + 1, b[0])) for a, b in zip(part, part[1:], strict=False))
            if adjacent and tuple(p[2] for p in part) == rule.sequence:
                version = next((p[3] for p in part if p[3]), "")
                licences.append((rule.licence.replace("{v}", version), part[0][0], part[-1][1]))
                i += len(part)
                break
        else:
            unresolved.append(found[i][2])
            i += 1
    return licences, unresolved


SCHEMA = "doc_id long, licences string, matches string, n_matches long, unresolved string"


def scan(docs: DataFrame) -> DataFrame:
    """``SCHEMA`` for every row of ``docs(doc_id, text)``.

    ``licences`` are the distinct names in order of their first match, ``matches`` are
    ``licence:first:last`` with sentence numbers from 0 (sentences without a word are not counted), and
    ``unresolved`` are known sentences outside every rule, all joined by commas. A NULL or empty text has
    none; NULL ids and repeated rows stay; other columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            rows = []
            for text in block.column("text").to_pylist():
                found = identified(text) if text and HINT.search(text) else []
                licences, unresolved = recognise(found, empty_sentences(text)) if found else ([], [])
                names = ",".join(dict.fromkeys(name for name, _, _ in licences))
                rows.append((names, ",".join(f"{n}:{a}:{b}" for n, a, b in licences), len(licences), ",".join(unresolved)))
            names, matches, counts, unresolved = zip(*rows, strict=True)
            columns = [block.column("doc_id"), pa.array(names), pa.array(matches), pa.array(counts, pa.int64()), pa.array(unresolved)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "licences", "matches", "n_matches", "unresolved"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
