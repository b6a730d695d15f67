"""The ambiguity rules at their boundaries. Frequencies are counts of a total of ten million."""

import pytest
from pyspark.sql import functions as F

from quillforge.operators import policy

TOTAL = 10_000_000


def described(spark, typo, correction, cands, documented=None):
    pairs = spark.createDataFrame([(typo, w, n) for w, n in cands.items()], "typo string, candidate string, n bigint")
    doc = spark.createDataFrame([(typo, documented)] if documented else [], "typo string, correction string")
    df = policy.preferences(pairs, F.lit(TOTAL), doc).withColumn("correction", F.lit(correction)).withColumn("n", F.lit(cands.get(correction, 0)).cast("bigint"))
    return df


@pytest.mark.parametrize(
    ("cands", "want"),
    [
        ({"the": 100}, "the"),
        ({"the": 99}, None),
        ({"the": 1000, "he": 10}, "the"),
        ({"the": 1000, "he": 11}, None),
        ({"the": 1000, "tee": 1000}, None),
        ({"the": 1000, "he": 0, "hate": 0}, "the"),
    ],
)
def test_dominant_candidate(spark, cands, want):
    assert described(spark, "hte", "the", cands).first()["by_frequency"] == want


@pytest.mark.parametrize(
    ("typo", "cands", "documented", "want"),
    [
        ("abotu", {"about": 0}, None, ("about", "about", "about")),
        ("abotu", {"about": 0, "abot": 9}, None, ("about", "about", "about")),  # shorter ones don't matter
        ("abotu", {"about": 0, "abotus": 0}, None, (None, None, None)),  # a longer one blocks
        ("abotu", {"about": 1000, "abots": 10}, None, (None, "about", "about")),
        ("abotu", {"about": 1000, "abots": 11}, None, (None, None, None)),
        ("abotu", {"about": 1000, "abots": 999}, "about", (None, None, "about")),
        ("abotu", {"about": 1000, "abots": 1000}, "about", (None, None, None)),
        ("abotu", {"about": 99, "abots": 1}, "about", (None, None, None)),
        ("abotu", {"about": 5, "baotu": 5}, None, (None, None, None)),  # two exchanges
        ("taht", {"that": 1000, "tact": 1}, None, (None, None, None)),  # four letters
    ],
)
def test_preferred_exchange(spark, typo, cands, documented, want):
    r = described(spark, typo, "about", cands, documented).first()
    assert (r["swap_basic"], r["swap_common"], r["swap"]) == want


@pytest.mark.parametrize(
    ("typo", "correction", "cands", "documented", "want"),
    [
        ("seperate", "separate", {"separate": 0}, None, True),
        ("hte", "the", {"the": 0}, "the", True),
        ("wht", "what", {"what": 0}, "what", False),
        ("speel", "spell", {"spell": 0, "speed": 0}, "spell", True),
        ("teh", "the", {"the": 1000}, None, True),
        ("teh", "the", {"the": 990}, None, False),
        ("teh", "the", {"the": 1000, "ten": 11}, None, False),
        ("wich", "which", {"which": 1000}, None, True),
        ("wich", "which", {"which": 999}, None, False),
        ("mebmr", "member", {"member": 1000}, None, False),  # not an omission
        ("membe", "member", {"member": 1000}, None, True),
        ("membe", "member", {"member": 1000, "membo": 0}, None, False),
        ("mgiht", "might", {"might": 0}, None, True),
        ("mgiht", "might", {"might": 100, "night": 99}, None, False),
    ],
)
def test_length_gate(spark, typo, correction, cands, documented, want):
    got = described(spark, typo, correction, cands, documented).select(policy.length_gate(F.lit(TOTAL)).alias("g")).first()["g"]
    assert bool(got) is want


def test_outcomes(spark):
    cases = [
        ("abotu", "about", {"about": 5}, None, "alone"),
        ("hte", "the", {"the": 5, "hate": 5}, "the", "short"),
        ("teh", "the", {"the": 1000, "tech": 1}, None, "frequency"),
        ("tehn", "then", {"then": 5, "the": 1}, None, "swap"),
        ("tehx", "text", {"text": 5, "teh": 9, "the": 3}, None, "competing"),
    ]
    for typo, correction, cands, documented, want in cases:
        got = described(spark, typo, correction, cands, documented).select(policy.outcome(F.lit(TOTAL)).alias("o")).first()["o"]
        assert got == want, (typo, got)
