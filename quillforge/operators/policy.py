"""Which correction of a typo is preferred, from all known words one edit away and their frequencies.

Frequencies are counts with a total, so that every comparison is one of integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.edits import is_repeat, is_swap, keyboard_typos
from ..functions.text import DOCUMENTED_SHORT

#: Occurrences per so many words, and the lead that a winner needs.
COMMON = 100_000
FREQUENT = 10_000
LEAD = 100


def at_least(n: Column, total: Column, per: int) -> Column:
    return (n > 0) & (n * per >= total)


def ranked(pairs: DataFrame) -> DataFrame:
    """(typo, cands, swaps): for (typo, candidate, n), the candidates as structs (neg, w) in order of rank, and those that
    exchange two letters.

    A typo's candidates are at most its one-edit words, so the arrays are bounded by its length.
    """
    if "swapped" not in pairs.columns:
        pairs = pairs.withColumn("swapped", is_swap("typo", "candidate"))
    one = F.struct((-F.col("n")).alias("neg"), F.col("candidate").alias("w"))
    return pairs.groupBy("typo").agg(F.sort_array(F.collect_set(one)).alias("cands"), F.collect_set(F.when(F.col("swapped"), one)).alias("swaps"))


def _winner(cands: Column, total: Column) -> Column:
    """The first of ranked candidates if it is common and leads the second by far."""
    first, second = -F.get(cands, F.lit(0))["neg"], F.coalesce(-F.get(cands, F.lit(1))["neg"], F.lit(0).cast("bigint"))
    return F.when(at_least(first, total, COMMON) & (first >= LEAD * second), F.get(cands, F.lit(0))["w"])


def preferences(pairs: DataFrame, total: Column, documented: DataFrame) -> DataFrame:
    """(typo, cands, documented, by_frequency, swap_basic, swap_common, swap) for (typo, candidate, n).

    by_frequency: the dominant candidate. swap_basic, swap_common, swap: the preferred exchange of letters without
    frequencies, with them, and with documentation too. Each is null if there is none.
    """
    df = ranked(pairs).join(documented.select("typo", F.col("correction").alias("documented")), "typo", "left")
    df = df.withColumns({"same": F.filter("cands", lambda c: F.length(c["w"]) == F.length("typo")), "by_frequency": _winner(F.col("cands"), total)})
    fitting = ~F.exists("cands", lambda c: (F.length(c["w"]) > F.length("typo")) | (F.length(c["w"]) < F.length("typo") - 1))
    only = F.when(fitting & (F.size("swaps") == 1), F.col("swaps")[0])
    df = df.withColumn("only", only)
    word, n = F.col("only.w"), -F.col("only.neg")
    long_ = F.length("typo") >= 5
    basic = F.when(F.size("same") == 1, word)
    common = F.when(long_ & (_winner(F.col("same"), total) == word), word)
    ahead = ~F.exists("same", lambda c: (c["w"] != word) & (-c["neg"] >= n))
    by_document = F.when(long_ & (F.col("documented") == word) & at_least(n, total, COMMON) & ahead, word)
    out = df.withColumns({"swap_basic": basic, "swap_common": F.coalesce(basic, common), "swap": F.coalesce(basic, common, by_document)})
    return out.drop("same", "swaps", "only")


def _then(cheap: Column, dear: Column) -> Column:
    """Both, with `dear` computed only where `cheap` holds.

    Spark computes what several rules have in common for every row beforehand, behind an AND too, but not behind a CASE.
    """
    return F.coalesce(F.when(cheap, dear), F.lit(False))


# ---- rules on rows (typo, correction, n, documented, cands, by_frequency, swap) -----------------------


def documented_short() -> Column:
    """The one short pair that documentation admits."""
    hit = F.lit(False)
    for t, c in DOCUMENTED_SHORT:
        hit = hit | ((F.col("typo") == t) & (F.col("correction") == c))
    return hit & F.col("documented").eqNullSafe(F.col("correction"))


def short_rule(total: Column, correction: str = "correction", n: str = "n") -> Column:
    """Destinations of three or four letters: frequent, a keystroke away, dominant."""
    c = F.col(correction)
    return _then(F.length(c).isin(3, 4) & at_least(F.col(n), total, FREQUENT) & (F.col("by_frequency") == c), F.array_contains(keyboard_typos(correction), F.col("typo")))


def five_rule(total: Column) -> Column:
    c = F.col("correction")
    return _then((F.length(c) == 5) & F.length("typo").isin(4, 5) & at_least(F.col("n"), total, FREQUENT) & (F.col("by_frequency") == c), F.array_contains(keyboard_typos("correction"), F.col("typo")))


def six_rule(total: Column) -> Column:
    alone = (F.size("cands") == 1) & (F.get("cands", F.lit(0))["w"] == F.col("correction"))
    left_out = F.expr("exists(sequence(1, 6), i -> concat(substr(correction, 1, i - 1), substr(correction, i + 1)) = typo)")
    return _then((F.length("typo") == 5) & (F.length("correction") == 6) & F.col("correction").rlike(r"\A[a-z]+\z") & at_least(F.col("n"), total, FREQUENT) & alone, left_out)


def length_gate(total: Column) -> Column:
    """Whether a typo is long enough for its correction; the order of the rules matters."""
    documented = F.col("documented").eqNullSafe(F.col("correction"))
    five = F.length("typo") == 5
    swap = F.col("swap").eqNullSafe(F.col("correction")) | (is_swap("typo", "correction") & F.col("swap").isNull() & F.col("by_frequency").eqNullSafe(F.col("correction")))
    return (
        F.when(F.length("typo") >= 6, True)
        .when(documented_short(), True)
        .when(five & documented, True)
        .when(F.length("correction").isin(3, 4), short_rule(total))
        .when(five_rule(total), True)
        .when(six_rule(total), True)
        .otherwise(five & swap)
    )


def corpus_exception() -> Column:
    """Short corpus tokens need a documented exchange or doubled letter."""
    return F.col("documented").eqNullSafe(F.col("correction")) & (is_swap("typo", "correction") | is_repeat("typo", "correction"))


def rivals() -> Column:
    return F.array_except(F.transform("cands", lambda c: c["w"]), F.array("correction"))


def outcome(total: Column) -> Column:
    """How the correction stands against its rivals: `alone`, `short`, `frequency`, `swap` or `competing`."""
    rival = F.length("by_frequency").isin(3, 4) & at_least(-F.get("cands", F.lit(0))["neg"], total, FREQUENT) & (F.col("by_frequency") != F.col("correction"))
    rival_short = _then(rival, F.array_contains(keyboard_typos("by_frequency"), F.col("typo")))
    return (
        F.when(F.size(rivals()) == 0, "alone")
        .when(documented_short(), "short")
        .when(short_rule(total), "frequency")
        .when(rival_short, "competing")
        .when(F.col("swap") == F.col("correction"), "swap")
        .when(F.col("swap").isNull() & (F.col("by_frequency") == F.col("correction")), "frequency")
        .otherwise("competing")
    )


def accepted() -> Column:
    """For proposals: the correction wins, or stands alone and is known or documented."""
    known = F.exists("cands", lambda c: c["w"] == F.col("correction")) | F.col("documented").eqNullSafe(F.col("correction"))
    return F.col("outcome").isin("short", "frequency", "swap") | ((F.col("outcome") == "alone") & known)
