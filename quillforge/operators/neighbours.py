"""Pairs of words one edit apart, by a join on deletion neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _left_out(w: str, at: str) -> str:
    """SQL of a word without its letter at a place from 1; at 0 it is whole."""
    return f"concat(substr({w}, 1, {at} - 1), substr({w}, {at} + 1))"


def _keyed(words: DataFrame, w: str, at: str) -> DataFrame:
    """A row for each word as it is and without each of its letters: the place, and a hash `k` of what is left."""
    each = words.select("*", F.explode(F.expr(f"sequence(0, length({w}))")).alias(at))
    return each.withColumn("k", F.expr(f"xxhash64({_left_out(w, at)})"))


def edit_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(typo, candidate, swapped, more columns of `right`): distinct words of `right` (column candidate) one edit from
    distinct ones of `left` (column typo), each pair once, and whether the edit is an exchange of adjacent letters.

    Two words that are equal without a letter each, are one edit apart if these letters' places say so:
    * none of the one, any of the other: one letter more (in a run of equal letters, the first place stands for all);
    * the same place in both: another letter there;
    * the next place, and the same letter: an exchange.
    """
    a, b = _keyed(left.select("typo"), "typo", "i"), _keyed(right, "candidate", "j")
    first = lambda w, at: f"({at} = 1 OR substr({w}, {at}, 1) <> substr({w}, {at} - 1, 1))"
    kinds = f"CASE WHEN i = 0 THEN j > 0 AND {first('candidate', 'j')} WHEN j = 0 THEN {first('typo', 'i')} WHEN i = j THEN typo <> candidate WHEN j = i + 1 THEN typo <> candidate AND substr(typo, i, 1) = substr(candidate, j, 1) ELSE false END"
    met = a.join(b, "k").where(F.expr(f"{kinds} AND {_left_out('typo', 'i')} = {_left_out('candidate', 'j')}"))
    return met.select("typo", "candidate", F.expr("i > 0 AND j = i + 1").alias("swapped"), *[c for c in right.columns if c != "candidate"])


def one_edit_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(typo, candidate): words of `right` (column word) one edit from those of `left` (column typo).

    Each word gives length + 1 keys instead of some 54 * length edits; all pairs one edit apart share one, and the
    places of the letters left out tell them from the others.
    """
    return edit_pairs(left.select("typo").distinct(), right.select(F.col("word").alias("candidate")).distinct()).select("typo", "candidate")
