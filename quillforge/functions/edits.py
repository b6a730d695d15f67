"""Generators of misspellings, as array expressions over a word column given by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Neighbours of each key, as the policy has them.
KEYS = "qwertyuiopasdfghjklzxcvbnm"
NEIGHBOURS = (
    "wa", "qeas", "wrsd", "etdf", "ryfg", "tugh", "yihj", "uojk", "ipkl", "ol",
    "qwsz", "awedxz", "serfcx", "drtgvc", "ftyhbv", "gyujnb", "huikmn", "jiolm", "kop",
    "asx", "zsdc", "xdfv", "cfgb", "vghn", "bhjm", "njk",
)

_ALPHABET = "transform(sequence(97, 122), x -> chr(x))"
_MAP = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in zip(KEYS, NEIGHBOURS, strict=True)) + ")"


def neighbour_pairs() -> list[tuple[str, str]]:
    return [(k, n) for k, v in zip(KEYS, NEIGHBOURS, strict=True) for n in v]


def _deletions(w: str) -> str:
    return f"transform(sequence(1, length({w})), i -> concat(substr({w}, 1, i - 1), substr({w}, i + 1)))"


def _swaps(w: str) -> str:
    # sequence(1, 0) would count down
    return f"(CASE WHEN length({w}) > 1 THEN transform(sequence(1, length({w}) - 1), i -> concat(substr({w}, 1, i - 1), substr({w}, i + 1, 1), substr({w}, i, 1), substr({w}, i + 2))) ELSE CAST(array() AS ARRAY<STRING>) END)"


def _keep(w: str, array: str, least: int = 0) -> Column:
    return F.expr(f"CASE WHEN length({w}) = 0 THEN CAST(array() AS ARRAY<STRING>) ELSE array_distinct(filter({array}, x -> x <> {w} AND length(x) >= {least})) END")


def adjacent_swaps(w: str) -> Column:
    """Words with one pair of unequal adjacent letters exchanged."""
    return _keep(w, _swaps(w))


def omissions(w: str) -> Column:
    """Words with one letter left out."""
    return _keep(w, _deletions(w))


def one_edit(w: str) -> Column:
    """All words one deletion, exchange, substitution or insertion of a-z away."""
    subs = f"flatten(transform(sequence(1, length({w})), i -> transform({_ALPHABET}, c -> concat(substr({w}, 1, i - 1), c, substr({w}, i + 1)))))"
    ins = f"flatten(transform(sequence(0, length({w})), i -> transform({_ALPHABET}, c -> concat(substr({w}, 1, i), c, substr({w}, i + 1)))))"
    return _keep(w, f"concat({_deletions(w)}, {_swaps(w)}, {subs}, {ins})")


def keyboard_typos(w: str) -> Column:
    """Single keystroke errors of at least three letters: missing, doubled, exchanged, neighbouring or extra key."""
    doubled = f"transform(sequence(1, length({w})), i -> concat(substr({w}, 1, i), substr({w}, i)))"
    near = f"flatten(transform(sequence(1, length({w})), i -> flatten(transform(split({_MAP}[substr({w}, i, 1)], ''), n -> array(concat(substr({w}, 1, i - 1), n, substr({w}, i + 1)), concat(substr({w}, 1, i - 1), n, substr({w}, i)), concat(substr({w}, 1, i), n, substr({w}, i + 1)))))))"
    made = f"concat({_deletions(w)}, {doubled}, {_swaps(w)}, {near})"
    return F.when(F.expr(w).rlike(r"\A[a-z]+\z"), _keep(w, made, 3)).otherwise(F.expr("CAST(array() AS ARRAY<STRING>)"))


def short_word_typos(w: str) -> Column:
    """Keyboard typos of words of three or four letters; none of others."""
    return F.when(F.length(F.expr(w)).isin(3, 4), keyboard_typos(w)).otherwise(F.expr("CAST(array() AS ARRAY<STRING>)"))


def splits(w: str) -> Column:
    """Structs (left, right) of every cut of a word in two."""
    return F.expr(f"CASE WHEN length({w}) > 1 THEN transform(sequence(1, length({w}) - 1), i -> struct(substr({w}, 1, i) AS left, substr({w}, i + 1) AS right)) ELSE CAST(array() AS ARRAY<STRUCT<left: STRING, right: STRING>>) END")


def is_swap(a: str, b: str) -> Column:
    """Whether b is a with one pair of unequal adjacent letters exchanged."""
    return F.expr(f"coalesce(CASE WHEN length({a}) = length({b}) AND {a} <> {b} THEN array_contains({_swaps(a)}, {b}) END, false)")


def is_repeat(typo: str, c: str) -> Column:
    """Whether the typo is the word with one letter doubled."""
    return F.expr(f"coalesce(CASE WHEN length({typo}) = length({c}) + 1 THEN exists(sequence(1, length({c})), i -> concat(substr({c}, 1, i), substr({c}, i)) = {typo}) END, false)")


def is_one_edit(a: str, b: str) -> Column:
    """Levenshtein distance one, or one exchange of adjacent letters."""
    return F.expr(f"levenshtein({a}, {b}, 1) = 1") | is_swap(a, b)
