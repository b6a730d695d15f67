"""Generators of new catalogue entries: each proposes pairs from frequent words and says what became of them.

Every function takes the same tables and returns all proposals with a `verdict`: `added`, `existing`, or the reason of
rejection (the first that holds).

* entries (typo, correction): the catalogue so far
* lexicon (word, is_protected, is_real, is_alternative, is_destination)
* frequencies (word, n) and their `total`
* documented (typo, correction); reviewed (typo, correction)
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.edits import adjacent_swaps, keyboard_typos, omissions, short_word_typos, splits
from .neighbours import edit_pairs
from .policy import COMMON, FREQUENT, accepted, at_least, corpus_exception, five_rule, length_gate, outcome, preferences, short_rule, six_rule


@dataclass
class Evidence:
    entries: DataFrame
    lexicon: DataFrame
    frequencies: DataFrame
    total: Column
    documented: DataFrame
    reviewed: DataFrame

    def words(self, flag: str) -> DataFrame:
        return self.lexicon.where(flag).select("word")

    def candidates(self, typos: DataFrame) -> DataFrame:
        """(typo, candidate, swapped, n) of the alternatives one edit away; no count is zero."""
        words = self.words("is_alternative").distinct().join(self.frequencies.groupBy("word").agg(F.max("n").alias("n")), "word", "left")
        return edit_pairs(typos.select("typo").distinct(), words.select(F.col("word").alias("candidate"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n")))

    def facts(self) -> DataFrame:
        """(word, n, counted, protected, destination, documented, reviewed, entry): one row a word, from one shuffle.

        All evidence by word in one table, so that the pairs meet it twice (by typo, by correction) and not eight times.
        """
        text, yes, no = "CAST(NULL AS STRING)", "true", "false"
        row = lambda df, key, **has: df.selectExpr(f"{key} AS word", *[f"{has.get(k, d)} AS {k}" for k, d in (("n", "CAST(NULL AS BIGINT)"), ("counted", no), ("protected", no), ("destination", no), ("documented", text), ("reviewed", text), ("entry", text))])
        parts = [
            row(self.frequencies, "word", n="n", counted=yes),
            row(self.lexicon.where("is_protected OR is_destination"), "word", protected="is_protected", destination="is_destination"),
            row(self.documented, "typo", documented="correction"),
            row(self.reviewed, "typo", reviewed="correction"),
            row(self.entries, "typo", entry="correction"),
        ]
        every = reduce(DataFrame.union, parts).groupBy("word")
        return every.agg(F.max("n").alias("n"), *[F.bool_or(k).alias(k) for k in ("counted", "protected", "destination")], *[F.max(k).alias(k) for k in ("documented", "reviewed", "entry")])

    def described(self, pairs: DataFrame) -> DataFrame:
        """(typo, correction) with all that the rules look at."""
        pairs = pairs.select("typo", "correction").distinct()
        choice = preferences(self.candidates(pairs.select("typo").distinct()), self.total, self.documented).drop("documented")
        facts = self.facts()
        of_typo = facts.select(F.col("word").alias("typo"), F.col("counted").alias("in_corpus"), "protected", "documented", "reviewed", "entry")
        of_correction = facts.select(F.col("word").alias("correction"), "n", "destination")
        df = pairs.join(choice, "typo", "left").join(of_typo, "typo", "left").join(of_correction, "correction", "left")
        no = F.lit(False)
        empty = F.expr("CAST(array() AS ARRAY<STRUCT<neg: BIGINT, w: STRING>>)")
        return df.withColumns({"n": F.coalesce("n", F.lit(0).cast("bigint")), "in_corpus": F.coalesce("in_corpus", no), "protected": F.coalesce("protected", no), "destination": F.coalesce("destination", no), "cands": F.coalesce("cands", empty)})


def ordered_destinations(e: Evidence) -> DataFrame:
    """(word, n) of the destinations that occur, the most frequent first, then by word: the order of proposals."""
    return e.words("is_destination").join(e.frequencies, "word").select("word", "n").orderBy(F.desc("n"), "word")


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct (typo, correction) in order of typos, then corrections: the order in which entries are examined."""
    return pairs.select("typo", "correction").distinct().orderBy("typo", "correction")


def joined_splits(typos: DataFrame, known: DataFrame) -> DataFrame:
    """(typo, left, right): every cut of a typo into two known words."""
    cuts = typos.select("typo", F.explode(splits("typo")).alias("s")).select("typo", "s.left", "s.right")
    return cuts.join(known.select(F.col("word").alias("left")), "left", "left_semi").join(known.select(F.col("word").alias("right")), "right", "left_semi").select("typo", "left", "right")


def joined_evidence(pairs: DataFrame, e: Evidence) -> DataFrame:
    """(typo, correction, cuts, cut, strong) of two-word corrections: the cuts of a typo into known words, one of them,
    and whether both words are real and frequent."""
    two = pairs.where(F.col("correction").contains(" ")).select("typo", "correction").distinct()
    parts = F.split("correction", " ")
    two = two.withColumns({"a": parts[0], "b": parts[1]})
    cuts = joined_splits(two.select("typo").distinct(), e.words("is_alternative")).groupBy("typo").agg(F.count(F.lit(1)).alias("cuts"), F.min(F.concat_ws(" ", "left", "right")).alias("cut"))
    real = e.words("is_real").join(e.frequencies.where(at_least(F.col("n"), e.total, FREQUENT)), "word").select("word")
    df = two.join(cuts, "typo", "left")
    for side in ("a", "b"):
        df = df.join(real.select(F.col("word").alias(side), F.lit(True).alias(f"strong_{side}")), side, "left")
    return df.select("typo", "correction", "cuts", "cut", (F.col("strong_a") & F.col("strong_b")).alias("strong"))


def joined_ok() -> Column:
    """The rule for two-word corrections, on `described` rows with their `joined_evidence`.

    Documented exactly, of two real frequent words, at least six letters, no other cut and no word one edit away.
    """
    c = F.col("correction")
    fits = c.rlike(r"\A[a-z]+ [a-z]+\z") & (F.length("typo") >= 6) & (F.col("typo") == F.replace(c, F.lit(" "), F.lit(""))) & F.col("documented").eqNullSafe(c)
    return F.coalesce(fits & (F.size("cands") == 0) & (F.col("cuts") == 1) & (F.col("cut") == c) & F.col("strong"), F.lit(False))


def joined_valid(pairs: DataFrame, e: Evidence) -> DataFrame:
    """(typo, correction, joined_ok) for the two-word corrections among pairs."""
    two = pairs.where(F.col("correction").contains(" "))
    df = e.described(two).join(joined_evidence(two, e), ["typo", "correction"], "left")
    return df.select("typo", "correction", joined_ok().alias("joined_ok"))


def _undocumented() -> Column:
    return F.col("in_corpus") & ~F.col("documented").eqNullSafe(F.col("correction"))


def expand_transpositions(e: Evidence, destinations: DataFrame) -> DataFrame:
    """(typo, correction, verdict): exchanges in destinations (word) of five letters or more that only the refined
    rule decides."""
    words = destinations.where((F.length("word") >= 5) & F.col("word").rlike(r"\A[a-z]+\z")).join(e.frequencies.where(at_least(F.col("n"), e.total, COMMON)), "word", "left_semi")
    proposed = words.select(F.explode(adjacent_swaps("word")).alias("typo"), F.col("word").alias("correction"))
    df = e.described(proposed)
    winner_short = F.coalesce(short_rule(e.total, "by_frequency", "top_n"), F.lit(False))
    df = df.withColumn("top_n", F.coalesce(-F.get("cands", F.lit(0))["neg"], F.lit(0).cast("bigint")))
    verdict = (
        F.when(F.col("entry") == F.col("correction"), "existing")
        .when(F.col("protected"), "protected_word_or_name")
        .when(_undocumented(), "undocumented_corpus_token")
        .when(winner_short, "short_word_preference")
        .when(F.col("swap_basic").isNotNull(), "basic_rule")
        .when(~F.col("swap").eqNullSafe(F.col("correction")), "frequency_or_ambiguity")
        .when(F.col("entry").isNotNull(), "conflict")
        .otherwise("added")
    )
    return df.select("typo", "correction", verdict.alias("verdict"))


def expand_short_words(e: Evidence, destinations: DataFrame) -> DataFrame:
    """(typo, correction, verdict): keyboard typos of frequent destinations of three or four letters."""
    words = destinations.where(F.length("word").isin(3, 4)).join(e.frequencies.where(at_least(F.col("n"), e.total, FREQUENT)), "word", "left_semi")
    proposed = words.select(F.explode(short_word_typos("word")).alias("typo"), F.col("word").alias("correction"))
    verdict = (
        F.when(F.col("entry").isNotNull(), "existing")
        .when(F.col("protected"), "protected_word_or_name")
        .when(F.col("in_corpus") & ~corpus_exception(), "unsafe_or_undocumented_corpus_token")
        .when(~short_rule(e.total), "frequency_or_ambiguity")
        .otherwise("added")
    )
    return e.described(proposed).select("typo", "correction", verdict.alias("verdict"))


def propose_common_words(e: Evidence, destinations: DataFrame) -> DataFrame:
    """(typo, correction): reviewed pairs, documented joined words, keyboard typos of frequent five-letter words and
    omissions in frequent six-letter words that no corpus word equals."""
    frequent = destinations.join(e.frequencies.where(at_least(F.col("n"), e.total, FREQUENT)), "word", "left_semi")
    five = frequent.where(F.length("word") == 5).select(F.explode(keyboard_typos("word")).alias("typo"), F.col("word").alias("correction")).where(F.length("typo").isin(4, 5))
    six = frequent.where(F.length("word") == 6).select(F.explode(omissions("word")).alias("typo"), F.col("word").alias("correction"))
    six = six.join(e.frequencies.select(F.col("word").alias("typo")), "typo", "left_anti")
    joined = e.documented.where(F.col("correction").contains(" ")).select("typo", "correction")
    return e.reviewed.select("typo", "correction").union(joined).union(five).union(six.select("typo", "correction")).distinct()


def expand_common_words(e: Evidence, destinations: DataFrame) -> DataFrame:
    """(typo, correction, verdict, category) of `propose_common_words`."""
    pairs = propose_common_words(e, destinations)
    df = e.described(pairs).withColumn("outcome", outcome(e.total))
    df = df.join(joined_evidence(pairs, e), ["typo", "correction"], "left").withColumn("joined_ok", joined_ok())
    joined = F.col("correction").contains(" ")
    documented = F.col("documented").eqNullSafe(F.col("correction"))
    short_corpus = F.col("in_corpus") & (F.length("typo") < 5) & F.length("correction").isin(3, 4) & ~corpus_exception()
    verdict = (
        F.when(F.col("entry") == F.col("correction"), "existing")
        .when(~joined & ~F.col("destination"), "unverified_destination")
        .when(F.col("protected"), "protected_word_or_name")
        .when(F.col("in_corpus") & ~documented, "undocumented_corpus_token")
        .when(short_corpus, "unsafe_short_corpus_token")
        .when(joined & ~F.col("joined_ok"), "unsafe_joined_word_correction")
        .when(joined & F.col("entry").isNotNull(), "conflict")
        .when(joined, "added")
        .when(~length_gate(e.total), "length")
        .when(F.col("reviewed").isNull() & ~five_rule(e.total) & ~six_rule(e.total), "frequency_or_ambiguity")
        .when(~accepted(), "frequency_or_ambiguity")
        .when(F.col("entry").isNotNull(), "conflict")
        .otherwise("added")
    )
    category = F.when(joined, "joined_words").when(F.col("reviewed").isNotNull(), "reviewed").when(six_rule(e.total), "six_letter_omission").otherwise("five_letter_keyboard")
    return df.select("typo", "correction", verdict.alias("verdict"), F.when(verdict == "added", category).alias("category"))


def merged(entries: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The catalogue with the additions; entries that exist stay."""
    new = verdicts.where("verdict = 'added'").select("typo", "correction").distinct()
    return entries.select("typo", "correction").union(new.join(entries, "typo", "left_anti"))


def rejections(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("pairs"))


def report(verdicts: DataFrame, entries: DataFrame) -> DataFrame:
    """(metric, key, value): what an expansion added and rejected, with the lengths of the additions."""
    new = verdicts.where("verdict = 'added'")
    count = F.count(F.lit(1)).cast("bigint").alias("value")
    none = F.lit("").alias("key")
    parts = [
        new.agg(count).select(F.lit("added").alias("metric"), none, "value"),
        new.agg(F.count_distinct("correction").alias("value")).select(F.lit("destinations_added_to"), none, "value"),
        merged(entries, verdicts).agg(count).select(F.lit("entries"), none, "value"),
        new.groupBy(F.length("typo").cast("string").alias("key")).agg(count).select(F.lit("additions_by_typo_length"), "key", "value"),
        new.groupBy(F.length("correction").cast("string").alias("key")).agg(count).select(F.lit("additions_by_destination_length"), "key", "value"),
        verdicts.where("verdict NOT IN ('added', 'existing')").groupBy(F.col("verdict").alias("key")).agg(count).select(F.lit("rejected_candidate_pairs"), "key", "value"),
    ]
    return reduce(DataFrame.union, parts)


def select_batch(candidates: DataFrame, per_destination: int, most: int) -> DataFrame:
    """A batch of (typo, correction, edits, n, sources): few edits first, frequent destinations, many sources, then
    alphabetical; at most so many of a destination and altogether."""
    order = [F.asc("edits"), F.desc("n"), F.desc("sources"), F.asc("typo"), F.asc("correction")]
    rank = F.row_number().over(Window.partitionBy("correction").orderBy(*order))
    return candidates.withColumn("rank", rank).where(F.col("rank") <= per_destination).orderBy(*order).limit(most).drop("rank")
