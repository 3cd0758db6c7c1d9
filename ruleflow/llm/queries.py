"""Registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ruleflow.llm import classifier, decontamination, html_text, lexical_search, license_scan, piece_coding, quality_rules, secret_scan, simhash, span_dedup, substring_dedup, token_alignment, token_counts

Query = Callable[[SparkSession, str], DataFrame]

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), PIECES)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_coding.code(table(spark, sf_dir, "documents"), PIECES)


def op5_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), BYTES, PIECES)


def either_case(pattern: str) -> str:
    """Letters of a pattern outside classes and escapes as classes of both cases."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            size = 4 if pattern[i + 1] == "x" else 2
            out.append(pattern[i : i + size])
            i += size
            continue
        inside = c == "[" or (inside and c != "]")
        out.append(f"[{c.upper()}{c.lower()}]" if c.isalpha() and not inside else c)
        i += 1
    return "".join(out)


def spans_sql(number: int, rule: secret_scan.Rule) -> str:
    """Every match of a rule: matches and the pieces between them, whose lengths add up to its start."""
    pattern = (either_case(rule.pattern) if rule.ignore_case else rule.pattern).replace("'", "''")
    enough = f"length(regexp_extract(m[i], '{pattern}', {rule.group})) >= {rule.least}" if rule.least else "true"
    return f"""SELECT doc_id, {number} AS number, '{rule.kind}' AS kind, m[i] AS found,
    coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS p FROM texts)) WHERE {enough}"""


SECRETS = f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(spans_sql(i, rule) for i, rule in enumerate(secret_scan.RULES))}),
listed AS (SELECT *, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(found) AS BIGINT) AS span FROM spans)
SELECT t.doc_id, count(*) FILTER (number = 0) AS n_assign, count(*) FILTER (number = 1) AS n_access, count(*) FILTER (number = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY start, number) FILTER (number < {len(secret_scan.BASE_RULES)}), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY start, number), '') AS spans
FROM texts t LEFT JOIN listed l ON t.doc_id = l.doc_id GROUP BY t.doc_id"""

# The given pages hold one article element each, with paragraphs and a heading, and five character references.
REFERENCES = {"&quot;": '"', "&copy;": "\u00a9", "&middot;": "\u00b7", "&lt;": "<", "&gt;": ">", "&amp;": "&"}
PART = "regexp_replace(x, '<[^>]*>', ' ', 'g')"
for name, char in REFERENCES.items():
    PART = f"replace({PART}, '{name}', '{char}')"
ARTICLES = f"""SELECT page_id, url, text, length(text) AS n_chars FROM (
  SELECT page_id, url, array_to_string(list_filter(list_transform(
    regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>'),
    lambda x: trim(regexp_replace({PART}, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM pages)"""

# Every window of 13 words with the smallest id that has it, and the words that a later text's windows cover.
PASSAGES = """WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
windows AS (SELECT doc_id, p, array_to_string(words[p:p + 12], ' ') AS passage
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS p FROM texts)),
firsts AS (SELECT passage, min(doc_id) AS first_id FROM windows GROUP BY passage),
marked AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS place FROM windows JOIN firsts USING (passage) WHERE first_id < doc_id),
gone AS (SELECT doc_id, list(place) AS places FROM marked GROUP BY doc_id)
SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN places IS NULL THEN words ELSE
    list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: NOT list_contains(places, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM texts t LEFT JOIN gone g ON t.doc_id = g.doc_id"""

TERMS = "regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
RANKS = f"""WITH d AS (SELECT doc_id, unnest({TERMS.format(text="coalesce(text, '')")}) AS term FROM documents),
q AS (SELECT item_id, unnest({TERMS.format(text="coalesce(text, '')")}) AS term FROM benchmark),
lengths AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
corpus AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS occurrences FROM lengths),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0 * max(documents) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM tfs, corpus GROUP BY term),
impacts AS (SELECT t.doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * documents) // occurrences))) AS part
  FROM tfs t JOIN lengths USING (doc_id) JOIN weights USING (term), corpus),
scores AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM q JOIN impacts USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= {lexical_search.TOP}"""


QUERIES: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_token_counts": op2_token_counts,
    "op3_quality_rules": op3_quality_rules,
    "op4_piece_coding": op4_piece_coding,
    "op5_classifier": op5_classifier,
    "op6_decontamination": op6_decontamination,
    "op7_span_dedup": op7_span_dedup,
    "op8_html_text": op8_html_text,
    "op9_secret_scan": op9_secret_scan,
    "op10_license_scan": op10_license_scan,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_lexical_search": op12_lexical_search,
    "op13_token_alignment": op13_token_alignment,
}
ORACLES: dict[str, str] = {
    "op8_html_text": ARTICLES,
    "op9_secret_scan": SECRETS,
    "op11_substring_dedup": PASSAGES,
    "op12_lexical_search": RANKS,
}
