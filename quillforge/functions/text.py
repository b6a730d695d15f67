"""Text functions as column expressions: tokens, case guards, hashes of words, re-capitalisation."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Keyword characters: letters of any script, digits, underscore.
TOKEN = r"[\p{L}\p{N}_]+"
PIECE = TOKEN + r"|[^\p{L}\p{N}_]+"
#: `$` would also match before a final line feed.
LOWER_WORD = r"\A[a-z]+\z"
TITLE_WORD = r"\A[A-Z][a-z]+\z"
CORRECTION = r"\A[a-z]+( [a-z]+)?\z"
#: Fixed value: the short pair that documentation admits, and that a review may state only if it is documented.
DOCUMENTED_SHORT = (("hte", "the"),)


def tokens(text) -> Column:
    """Array of the maximal keyword runs of a text; null for null."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def pieces(text) -> Column:
    """Array of keyword runs and what is between them; joined, they are the text."""
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def is_lower(w) -> Column:
    return F.col(w).rlike(LOWER_WORD) if isinstance(w, str) else w.rlike(LOWER_WORD)


def is_title(w) -> Column:
    return F.col(w).rlike(TITLE_WORD) if isinstance(w, str) else w.rlike(TITLE_WORD)


def recapitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))


def bucket(w: str) -> Column:
    """Partition 1 to 256 of a word: h * 33 + byte modulo 256, from 0, plus 1."""
    return F.expr(f"CASE WHEN length({w}) = 0 THEN 1L ELSE aggregate(transform(sequence(1, length({w})), i -> ascii(substr({w}, i, 1))), 0L, (h, b) -> (h * 33 + b) % 256) + 1 END")


#: Starts, multipliers and avalanche shifts of the two word hashes.
HASHES = ((5381, 33), (0, 65599))


def word_hash(w: str, start: int, factor: int) -> str:
    """SQL of a 32-bit multiplicative hash with an avalanche at the end, signed, in BIGINT arithmetic."""
    mask = 4294967295
    h = f"aggregate(transform(sequence(1, length({w})), i -> ascii(substr({w}, i, 1))), {start}L, (h, b) -> (h * {factor} + b) & {mask}L)"
    a = f"transform(array({h}), h -> (h + (h << 3)) & {mask}L)"
    b = f"transform({a}, h -> h ^ shiftrightunsigned(h, 11))"
    return f"transform({b}, h -> shiftright(shiftleft(h + (h << 15), 32), 32))[0]"


def _normalized(words: pd.Series) -> pd.Series:
    keep = frozenset("abcdefghijklmnopqrstuvwxyz")
    return words.map(lambda w: None if w is None else "".join(c for c in unicodedata.normalize("NFKD", w).lower() if c in keep))


def normalized(w) -> Column:
    """Compatibility decomposition, ASCII letters only, lower case. Spark has no built-in for it."""
    return F.pandas_udf(_normalized, StringType())(w)


def mapping_hash(key: str, value: str) -> Column:
    """Aggregate: SHA-256 of the rows as a compact JSON object with sorted keys.

    The digest is defined over one string, so the rows meet in one task: for catalogues (a million rows are some 30 MB),
    not for corpora. `sources.publish.content_hash` has the distributed one.
    """
    pairs = F.sort_array(F.collect_list(F.struct(F.col(key), F.concat(F.lit('"'), F.col(key), F.lit('":"'), F.col(value), F.lit('"')).alias("j"))))
    return F.sha2(F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: p["j"]), ","), F.lit("}")), 256)
