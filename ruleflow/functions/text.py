"""Text cleaning, label parsing and the analysers' text normalisation."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

# The characters Python's str.strip() treats as white space.
WHITESPACE_CODES = (
    [0x09, 0x0A, 0x0B, 0x0C, 0x0D]
    + [0x1C, 0x1D, 0x1E, 0x1F, 0x20]
    + [0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
WHITESPACE = "".join(map(chr, WHITESPACE_CODES))
# The same set as a character class that Java and RE2 both accept.
WHITESPACE_RUN = "[" + "".join(f"\\x{{{code:x}}}" for code in WHITESPACE_CODES) + "]+"

# The texts pandas' CSV reader takes for a missing value by default.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# A decimal number with optional sign, exponent and outer blanks.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# A word of at least two word characters.
WORD = r"[\p{L}\p{N}_]{2,}"


def clean_text(col: Column) -> Column:
    """Unify line ends, drop NUL characters, strip outer white space; keep everything else."""
    unix = F.replace(F.replace(col, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.btrim(F.replace(unix, F.lit("\0"), F.lit("")), F.lit(WHITESPACE))


def has_text(col: Column) -> Column:
    """Whether ``clean_text`` leaves anything: a character that is neither white space nor NUL.

    Stops at the first such character, so a filter on it costs far less than cleaning the whole text.
    """
    return col.rlike("[^\\x{0}" + WHITESPACE_RUN[1:-2] + "]")


def to_label(col: Column) -> Column:
    """Parse a label as a number; anything that is not a plain number becomes NULL."""
    text = col.cast("string")
    return F.when(text.rlike(NUMBER), F.btrim(text).try_cast("double"))


def as_number(df: DataFrame, column: str) -> Column:
    """A column as double: parsed like a label if it holds texts, else only cast."""
    kind = df.schema[column].dataType
    return F.col(column).cast("double") if isinstance(kind, NumericType) else to_label(F.col(column))


def na_to_null(col: Column) -> Column:
    """Missing-value texts to NULL, for columns that come from a CSV file."""
    return F.when(~col.isin(*NA_TOKENS), col)


# Fixed values of the Unicode algorithm: first precomposed syllable and the jamo of each place.
HANGUL_FIRST, HANGUL_LAST = 0xAC00, 0xD7A3
LEADS = "".join(map(chr, range(0x1100, 0x1113)))
VOWELS = "".join(map(chr, range(0x1161, 0x1176)))
TAILS = "".join(map(chr, range(0x11A8, 0x11C3)))


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str, str, dict[str, str]]:
    """Translation strings, a character class and its decompositions, derived from the Unicode tables.

    One-to-one decompositions (and combining marks, which vanish) go into the two strings for
    ``translate``. Characters that decompose into several base characters form the class; those among
    them that are no Hangul syllables, which follow a rule, are in the last value.
    """
    source, target, dropped, several, long = [], [], [], [], {}
    for code in range(0x80, 0x110000):
        char = chr(code)
        if 0xD800 <= code < 0xE000:
            continue
        plain = strip_accents_py(char)
        if plain == char:
            continue
        if len(plain) == 1:
            source.append(char)
            target.append(plain)
        elif not plain:
            dropped.append(char)
        else:
            several.append(code)
            if not HANGUL_FIRST <= code <= HANGUL_LAST:
                long[char] = plain
    ranges, start = [], None
    for code, following in zip(several, several[1:] + [None]):
        start = code if start is None else start
        if following != code + 1:
            ranges.append(f"\\x{{{start:x}}}-\\x{{{code:x}}}")
            start = None
    # The look-ahead lets the many characters below the first of the class fail on one comparison.
    several_class = f"(?=[^\\x00-\\x{{{several[0] - 1:x}}}])[" + "".join(ranges) + "]"
    return "".join(source + dropped), "".join(target), several_class, long


def strip_accents_py(text: str) -> str:
    """NFKD without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def hangul_parts(char: Column) -> Column:
    """The jamo of a precomposed syllable; NULL for any other character."""
    place = F.ascii(char) - F.lit(HANGUL_FIRST)
    inside = place.between(0, HANGUL_LAST - HANGUL_FIRST)
    lead, vowel, tail = F.floor(place / 588).cast("int"), F.floor(place % 588 / 28).cast("int"), place % 28
    jamo = F.concat(
        F.substring(F.lit(LEADS), lead + 1, F.lit(1)), F.substring(F.lit(VOWELS), vowel + 1, F.lit(1)),
        F.when(tail > 0, F.substring(F.lit(TAILS), tail, F.lit(1))).otherwise(F.lit("")),
    )
    return F.when(inside, jamo)


def strip_accents(col: Column) -> Column:
    """NFKD accent stripping, all of it in the JVM.

    Pure ASCII stays as it is and most other text goes through ``translate``. Only texts with a character
    that becomes several (ligatures, Hangul, fractions) are taken apart into characters first.
    """
    source, target, several, long = _accent_table()
    pairs = F.create_map(*[F.lit(x) for pair in long.items() for x in pair])
    taken_apart = F.array_join(
        F.transform(F.split(col, ""), lambda c: F.coalesce(F.try_element_at(pairs, c), hangul_parts(c), c)), ""
    )
    whole = F.when(col.rlike(several), taken_apart).otherwise(col)
    return F.when(col.rlike(r"[^\x00-\x7f]"), F.translate(whole, source, target)).otherwise(col)


def fold_text(col: Column) -> Column:
    """Lower case without accents, as both analysers see the text."""
    return strip_accents(F.lower(col))


def words(col: Column) -> Column:
    """Words of two or more word characters, in text order."""
    return F.regexp_extract_all(col, F.lit(WORD), F.lit(0))
