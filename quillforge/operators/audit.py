"""Audit of a catalogue: counters and failures of every entry, recomputed from the evidence."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mapping_hash
from ..sources.publish import replace_file, write_grouped
from .expand import Evidence, joined_evidence, joined_ok
from .policy import COMMON, FREQUENT, LEAD, corpus_exception, documented_short, five_rule, length_gate, outcome, rivals, short_rule, six_rule

EXAMPLES = 20


def audited(e: Evidence) -> DataFrame:
    """Entries with a flag for each counter and the array `failures` of failure kinds.

    Two-word entries are checked by their own rule only; an entry may fail in several ways.
    """
    df = e.described(e.entries).withColumn("outcome", outcome(e.total))
    df = df.join(joined_evidence(e.entries, e), ["typo", "correction"], "left").withColumn("joined_ok", joined_ok())
    joined = F.col("correction").contains(" ")
    single = ~joined
    documented = F.col("documented").eqNullSafe(F.col("correction"))
    gate, five, short = length_gate(e.total), five_rule(e.total), documented_short()
    known = F.exists("cands", lambda c: c["w"] == F.col("correction"))
    unsafe = F.col("in_corpus") & documented & (F.length("typo") < 5) & F.length("correction").isin(3, 4) & ~short & ~corpus_exception()
    swap_won = single & (F.col("outcome") == "swap")
    by_document = F.col("swap_common").isNull()
    flags = {
        "unique_six_letter_omissions": six_rule(e.total),
        "frequency_five_letter_corrections": five,
        "reviewed_corrections": F.col("reviewed").eqNullSafe(F.col("correction")),
        "reviewed_corpus_exceptions": F.col("reviewed").eqNullSafe(F.col("correction")) & F.col("in_corpus"),
        "joined_word_corrections": joined,
        "documented_frequency_exceptions": F.col("in_corpus") & documented & (joined | ~unsafe),
        "five_letter_transposition_exceptions": single & gate & (F.length("typo") == 5) & (F.length("correction") == 5) & ~documented & ~five,
        "frequency_short_corrections": single & short_rule(e.total) & ~short,
        "documented_short_corrections": single & short,
        "preferred_frequency_corrections": single & (F.col("outcome") == "frequency"),
        "preferred_transposition_corrections": swap_won,
        "documented_transposition_corrections": swap_won & by_document,
        "rare_alternative_transposition_corrections": swap_won & ~by_document & F.col("swap_basic").isNull(),
        "single_edit_corrections": single & known,
    }
    failing = {
        "protected_word_or_name": F.col("protected"),
        "unsafe_joined_word_correction": joined & ~F.col("joined_ok"),
        "short_ambiguous_token": single & ~gate,
        "unverified_destination": single & ~F.col("destination"),
        "undocumented_corpus_token": single & F.col("in_corpus") & ~documented,
        "unsafe_short_corpus_token": single & unsafe,
        "competing_correction": single & (F.col("outcome") == "competing"),
        "undocumented_multi_edit": single & ~known & ~documented,
    }
    kinds = F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in failing.items()]), lambda x: x.isNotNull())
    return df.select("typo", "correction", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in flags.items()], kinds.alias("failures"), F.sort_array(rivals()).alias("rivals"))


def counters(rows: DataFrame) -> DataFrame:
    """(metric, value): every counter of `audited` in one pass, and the derived ones."""
    names = [c for c in rows.columns if c not in ("typo", "correction", "failures", "rivals")]
    sums = rows.agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("correction").alias("destinations"), F.count_distinct(F.when(F.length("correction").isin(3, 4), F.col("correction"))).alias("short_word_destinations"), *[F.count_if(F.col(n)).alias(n) for n in names])
    sums = sums.withColumn("documented_multi_edit_corrections", F.col("entries") - F.col("single_edit_corrections") - F.col("joined_word_corrections"))
    return sums.unpivot([], sums.columns, "metric", "value")


def failures(rows: DataFrame) -> DataFrame:
    """(kind, typo, correction), one row for each way in which an entry fails."""
    return rows.select(F.explode("failures").alias("kind"), "typo", "correction")


def rejected_typos(rows: DataFrame) -> DataFrame:
    """(typo): those that fail in any way."""
    return rows.where(F.size("failures") > 0).select("typo").distinct()


def competing(rows: DataFrame) -> DataFrame:
    """(typo, correction, rivals) of the entries that lose against another word, with those words in order."""
    return rows.where(F.array_contains("failures", "competing_correction")).select("typo", "correction", "rivals")


def failure_examples(rows: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """The first examples of each kind, with their number from 1."""
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("typo", "correction"))
    failed = rows.select(F.explode("failures").alias("kind"), "typo", "correction", "rivals")
    return failed.withColumn("rank", rank).where(F.col("rank") <= most)


#: How the rules read in the report.
POLICIES = {
    "capitalized_policy": {"minimum_input_length": 6, "destination_words": 1, "documentation_required": True, "input_case": "initial capital only"},
    "joined_word_policy": {"minimum_input_length": 6, "minimum_component_frequency": 1 / FREQUENT, "destination_words": 2, "documentation_required": True, "single_word_alternatives": "block", "alternative_splits": "block"},
    "transposition_preference": {
        "rare_alternative_minimum_length": 5, "minimum_frequency": 1 / COMMON, "minimum_ratio": LEAD, "frequency_competitors": "same-length non-swap alternatives",
        "longer_alternatives": "block", "documented_swap_competitors": "strictly less frequent same-length alternatives",
    },
    "six_letter_omission_policy": {"minimum_frequency": 1 / FREQUENT, "destination_length": 6, "typo_length": 5, "edit": "one missing letter", "alternatives": "block regardless of frequency"},
    "five_letter_preference": {"minimum_frequency": 1 / FREQUENT, "minimum_ratio": LEAD, "destination_lengths": [5], "typo_lengths": [4, 5]},
    "short_word_preference": {"minimum_frequency": 1 / FREQUENT, "minimum_ratio": LEAD, "destination_lengths": [3, 4], "typo_lengths": [3, 4, 5], "three_four_letter_corpus_exceptions": "documented adjacent swap or repeated letter"},
    "frequency_preference": {"minimum_frequency": 1 / COMMON, "minimum_ratio": LEAD},
}


def names(df: DataFrame, column: str) -> list[str]:
    """A column's strings in order; they travel as Arrow, as collected rows take many times their bytes."""
    return df.select(column).orderBy(column).toArrow().column(0).to_pylist()


def records(df: DataFrame, key: str, *fields: str) -> tuple[int, str]:
    """How many records an evidence table has, and the `digest` of them as a dictionary of dictionaries, record by record."""
    total, n, last = hashlib.sha256(b"{"), 0, None
    for batch in df.select(key, *fields).orderBy(key, *fields).toArrow().to_batches(max_chunksize=1 << 12):
        for r in batch.to_pylist():
            if n == 0 or r[key] != last:
                record = json.dumps({r[key]: {f: r[f] for f in fields}}, sort_keys=True, separators=(",", ":"))[1:-1]
                total.update((("," if n else "") + record).encode())
                n, last = n + 1, r[key]
    total.update(b"}")
    return n, total.hexdigest()


def digest(data) -> str:
    return hashlib.sha256(json.dumps(data, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def report(e: Evidence, expected: int | None = None, protected: DataFrame | None = None, lists_sha256: str | None = None, listed: bool = True) -> dict:
    """The audit's report as a dictionary; `passed` says whether anything failed.

    `protected` (word, evidence) has the supplemental exclusions, and `lists_sha256` is the hash of the word lists; the
    parts of the report that need them are there if they are given. The names of rejected typos and technical
    destinations are all there, and grow with the catalogue; where they aren't `listed`, their numbers stand for them.
    """
    rows = audited(e).cache()
    try:
        found: dict = {r["metric"]: r["value"] for r in counters(rows).collect()}
        counts = {r["kind"]: r["n"] for r in failures(rows).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
        examples: dict[str, list] = {}
        for r in failure_examples(rows).orderBy("kind", "rank").collect():
            examples.setdefault(r["kind"], []).append([r["typo"], r["correction"], *([list(r["rivals"])] if r["kind"] == "competing_correction" else [])])
        rejected = rejected_typos(rows)
        rejected = names(rejected, "typo") if listed else rejected.count()
    finally:
        rows.unpersist()
    if expected is not None and found["entries"] != expected:
        counts["entry_count"] = 2
        examples["entry_count"] = [found["entries"], expected]
    capital = capitalised(e.entries, e.documented)
    lexicon = e.lexicon.agg(F.count_if("is_protected").alias("p"), F.count_if("is_alternative").alias("a")).first()
    own = ["correction", *[c for c in ("reason", "source") if c in e.reviewed.columns]]
    reviewed, reviewed_sha256 = records(e.reviewed, "typo", *own)
    real = e.words("is_real").select(F.col("word").alias("correction"))
    technical = e.entries.select("correction").distinct().where(~F.col("correction").contains(" ")).join(real, "correction", "left_anti")
    more = {
        "capitalized_corrections": capital.count(),
        "capitalized_sha256": capital.agg(mapping_hash("typo", "correction").alias("h")).first()["h"],
        "mapping_sha256": e.entries.agg(mapping_hash("typo", "correction").alias("h")).first()["h"],
        "reviewed_records": reviewed,
        "reviewed_sha256": reviewed_sha256,
        "protected_dictionary_tokens": lexicon["p"],
        "alternative_dictionary_tokens": lexicon["a"],
        "protected_frequency_tokens": e.frequencies.count(),
        "technical_destinations": names(technical, "correction") if listed else technical.count(),
        "rejected_typos": rejected,
    }
    if protected is not None:
        extra = {r["word"]: r["evidence"].asDict() for r in protected.select("word", "evidence").collect()}
        more |= {"supplemental_protected_tokens": len(extra), "supplemental_protected_sha256": digest(extra)}
    if lists_sha256 is not None:
        more["word_lists_sha256"] = lists_sha256
    return {**POLICIES, **found, **more, "failure_counts": counts, "failure_examples": examples, "passed": not counts}


def report_json(e: Evidence, expected: int | None = None, path: str | None = None, **evidence) -> tuple[str, int]:
    """The report as text with sorted keys, also written to `path` if given, and the exit status: 1 if anything failed."""
    found = report(e, expected, **evidence)
    text = json.dumps(found, indent=2, sort_keys=True) + "\n"
    if path is not None:
        replace_file(e.entries.sparkSession, path, text)
    return text, int(not found["passed"])


def capitalised(entries: DataFrame, documented: DataFrame) -> DataFrame:
    """Entries that may correct capitalised words: six letters or more, one word, documented exactly."""
    return entries.where((F.length("typo") >= 6) & ~F.col("correction").contains(" ")).join(documented.select("typo", "correction"), ["typo", "correction"], "left_semi").select("typo", "correction")


def write_capitalised(entries: DataFrame, documented: DataFrame, path: str, check: bool = False) -> int:
    """Write the capitalised subset as grouped JSON, or with `check` raise if the file is stale; returns its entries."""
    return write_grouped(capitalised(entries, documented), path, check)
