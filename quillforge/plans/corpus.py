"""Tables that the queries derive from the documents: tokens, vocabulary, a catalogue with its evidence."""

from __future__ import annotations

from contextlib import suppress
from functools import cached_property
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.edits import adjacent_swaps
from ..functions.text import bucket
from ..operators.correct import word_table
from ..operators.counts import lower_counts, lower_words
from ..operators.expand import Evidence

#: Occurrences from which a vocabulary word counts as known.
KNOWN = 3
#: Occurrences from which two words in a row count as a phrase.
PHRASE = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Corpus:
    """Lazy views of one set of documents. What an earlier one has cached is given up when the next one is made."""

    held: ClassVar[list[DataFrame]] = []

    def __init__(self, spark: SparkSession, sf_dir: str):
        while Corpus.held:
            with suppress(Exception):  # its session may have ended
                Corpus.held.pop().unpersist()
        self.spark, self.sf_dir = spark, sf_dir
        self.docs = table(spark, sf_dir, "documents")
        self.words = word_table(self.docs)

    def _keep(self, df: DataFrame) -> DataFrame:
        Corpus.held.append(df.cache())
        return df

    @cached_property
    def counted(self) -> DataFrame:
        """(w, n): the words of the vocabulary, and the phrases, from one reading of the texts."""
        return self._keep(lower_counts(self.docs, least=PHRASE))

    @cached_property
    def vocab(self) -> DataFrame:
        return self._keep(lower_words(self.docs))

    @cached_property
    def total(self):
        return F.lit(self.vocab.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])

    @property
    def known(self) -> DataFrame:
        return self.vocab.where(F.col("n") >= KNOWN).select(F.col("w").alias("word"), "n")

    @property
    def frequent(self) -> DataFrame:
        return self.known.where(F.col("n") * 10_000 >= self.total)

    @cached_property
    def catalog(self) -> DataFrame:
        """Letters two and three exchanged in words of six letters or more, where that makes no vocabulary word."""
        made = self.vocab.where(F.length("w") >= 6).select(swapped("w").alias("typo"), F.col("w").alias("correction")).where("typo <> correction")
        return self._keep(made.join(self.vocab.select(F.col("w").alias("typo")), "typo", "left_anti").select("typo", "correction", (bucket("typo") % 4 == 0).alias("capitalized_ok")))

    @cached_property
    def entries(self) -> DataFrame:
        """(typo, correction) of `numbered`."""
        return self.numbered.select("typo", "correction")

    @cached_property
    def numbered(self) -> DataFrame:
        """(typo, correction, bucket): a catalogue for audits, with entries that pass and others that fail: exchanges in known words, last letters
        left out of frequent six-letter words, and two words run together."""
        phrases = self.counted.where(F.col("w").contains(" "))
        self.vocab = self.counted.where(~F.col("w").contains(" "))
        swaps = self.known.where(F.length("word") >= 3).select(swapped("word").alias("typo"), F.col("word").alias("correction")).where("typo <> correction")
        cuts = self.frequent.where(F.length("word") == 6).groupBy(F.substring("word", 1, 5).alias("typo")).agg(F.min("word").alias("correction"))
        # of the phrases that make one word the least is the one whose blank comes first
        joined = phrases.groupBy(F.replace("w", F.lit(" "), F.lit("")).alias("typo")).agg(F.min(F.instr("w", " ")).alias("at")).where(F.length("typo") >= 3)
        joined = joined.select("typo", F.expr("concat(substr(typo, 1, at - 1), ' ', substr(typo, at))").alias("correction"))
        first = swaps.union(cuts.join(swaps, "typo", "left_anti"))
        return self._keep(first.union(joined.join(first, "typo", "left_anti")).withColumn("bucket", bucket("typo")))

    def evidence(self, entries: DataFrame) -> Evidence:
        """Every fourth bucket is documented, every sixteenth reviewed; known words are protected and real."""
        lexicon = self.known.select("word", *[F.lit(True).alias(f) for f in ("is_protected", "is_real", "is_alternative", "is_destination")])
        numbered = self.numbered if entries is vars(self).get("entries") else entries.withColumn("bucket", bucket("typo"))
        documented, reviewed = [numbered.where(F.col("bucket") % k == 0).select("typo", "correction") for k in (4, 16)]
        return Evidence(entries, lexicon, self.vocab.select(F.col("w").alias("word"), "n"), self.total, documented, reviewed)


def swapped(w: str):
    """Letters two and three exchanged."""
    return F.expr(f"concat(substr({w}, 1, 1), substr({w}, 3, 1), substr({w}, 2, 1), substr({w}, 4))")


def all_swaps(words: DataFrame) -> DataFrame:
    return words.select(F.explode(adjacent_swaps("word")).alias("typo"), F.col("word").alias("correction"))
