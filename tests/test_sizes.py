"""Memory, shuffles and repeated work that would grow with the data, and results that only large tables showed."""

import json
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillforge.operators import audit, correct
from quillforge.operators.expand import Evidence
from quillforge.plans import queries
from quillforge.plans.corpus import Corpus


def pairs(spark, rows):
    return spark.createDataFrame(rows, "typo string, correction string")


def test_the_report_can_leave_its_lists_out(spark):
    words = spark.createDataFrame([(w, True, True, True, True) for w in ("about", "the")], "word string, is_protected boolean, is_real boolean, is_alternative boolean, is_destination boolean")
    reviewed = pairs(spark, [("zzz", "nowhere"), ("abotu", "about"), ("é", 'a "b"')])
    e = Evidence(pairs(spark, [("abotu", "about"), ("the", "which"), ("zzz", "nowhere")]), words, spark.createDataFrame([("about", 5), ("the", 5)], "word string, n bigint"), F.lit(10), pairs(spark, []), reviewed)
    full, short = audit.report(e), audit.report(e, listed=False)
    assert full["rejected_typos"] == ["the", "zzz"] and full["technical_destinations"] == ["nowhere", "which"]
    assert short == {**full, "rejected_typos": 2, "technical_destinations": 2}
    assert full["reviewed_records"] == 3 and full["reviewed_sha256"] == audit.digest({r["typo"]: {"correction": r["correction"]} for r in reviewed.collect()})


def test_noise_looks_behind_by_code_points(spark):
    texts = ["\U00010400abcdef abcdef", "\U0001d400hijklm", "\U0001f600abcdef"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(queries._noise(F.col("text"))).collect()]
    assert got == ["\U00010400abcdef acbdef", "\U0001d400hijklm", "\U0001f600acbdef"]


def test_texts_without_a_character_are_in_neither_result(spark, tmp_path, duck):
    rows = [(1, "abcdefg acbdefh"), (2, ""), (3, None), (4, "\U00010400abcdefg - abcdefg"), (5, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duck.cursor()
    con.execute("CREATE SCHEMA odd; SET search_path = 'odd,main'")
    con.execute(f"CREATE VIEW odd.documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.SQL["correct_text"]).fetchall()
    con.execute("DROP SCHEMA odd CASCADE")
    got = queries.QUERIES["correct_text"](spark, str(tmp_path)).select("doc_id", "n_fixed", "corrected").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 3


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_places_leave_in_small_batches(spark, monkeypatch, limit):
    """10,000 texts in one task were one batch, and all their places were held at once."""
    monkeypatch.setattr(correct, "BROADCAST_BYTES", limit)
    from quillforge.functions import batches

    docs = spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), F.lit("text").alias("filetype"), F.repeat(F.lit("hte\n"), 2000).alias("text"))
    found = correct.corrections_in_context(docs, pairs(spark, [("hte", "the")]))
    sizes = found.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in bs), "n long").collect()
    assert sum(r["n"] for r in sizes) == 80_000 and max(r["n"] for r in sizes) <= batches.ROWS
    held = [b.num_rows for b in batches.gathered(((i,) for i in range(100_000)), pa.schema([("i", pa.int64())]))]
    assert sum(held) == 100_000 and max(held) <= batches.ROWS
    assert [b.num_rows for b in batches.gathered((("x" * (3 << 20),) for _ in range(5)), pa.schema([("t", pa.string())]), lambda r: len(r[0]))] == [2, 2, 1]


def test_only_words_of_a_fitting_length_are_joined(spark, monkeypatch):
    monkeypatch.setattr(correct, "BROADCAST_BYTES", 0)
    words = spark.createDataFrame([(w,) for w in ["a", "abc", "abcd", "Abcd", "abcde", "abcdef", "wxyzab"] * 3], "w string")
    met = correct.lookup(words, pairs(spark, [("abcd", "abdc"), ("abcde", "abced")]))
    assert Counter(r["w"] for r in met.collect()) == {"abcd": 3, "abcde": 3}
    assert "octet_length(w" in met._jdf.queryExecution().optimizedPlan().toString()
    assert correct.measured(pairs(spark, [])) == (0, 0, 0)


def test_counts_by_brute_force(spark, monkeypatch):
    from quillforge.operators import counts

    texts = ["the cat, the cat\nThe dog 1 the cat", "", None, "cat été cat the_x the", "the"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    monkeypatch.setattr(counts, "TOGETHER", 4)
    lists = [re.findall(r"\w+", t or "") for t in texts]
    low = re.compile("[a-z]+").fullmatch
    assert {r["w"]: r["n"] for r in counts.lower_words(docs).collect()} == Counter(w for ws in lists for w in ws if low(w))
    want = Counter(f"{a} {b}" for ws in lists for a, b in zip(ws, ws[1:], strict=False) if low(a) and low(b))
    assert {r["pair"]: r["n"] for r in counts.lower_pairs(docs).collect()} == want
    want = Counter((w, (k + 1) % 2) for ws in lists for k, w in enumerate(ws))
    assert {(r["w"], r["at"]): r["n"] for r in counts.words_by_place(docs, 2).collect()} == want


def test_catalogues_are_parsed_once_a_row(spark, tmp_path):
    """A filter on the error took in all that it is made of, many times over."""
    from quillforge.sources import catalog as catalogs

    raw = spark.createDataFrame([(json.dumps({"the": ["hte"]}),)], "source string")
    plan = catalogs.flattened(catalogs.parsed(raw))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") <= 4, plan


def test_lookups_count_before_they_join(spark):
    from shared import SF

    for name in ("lookup_exact", "lookup_capitalized"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "posexplode" not in plan.lower()
    vocab = Corpus(spark, SF).vocab._jdf.queryExecution().logical().toString()
    assert "regexp_extract_all" not in vocab


def test_entries_read_the_texts_once(spark, monkeypatch):
    """Words and words in a row were counted by two passes over the texts."""
    from shared import SF

    from quillforge.operators import counts
    from quillforge.plans import corpus

    passes, counted = [], counts.lower_counts
    monkeypatch.setattr(counts, "lower_counts", lambda *a, **b: passes.append(a) or counted(*a, **b))
    monkeypatch.setattr(corpus, "lower_counts", counts.lower_counts)
    c = Corpus(spark, SF)
    assert c.entries.count() > 10 and c.known.count() > 10 and c.evidence(c.entries).frequencies.count() > 10
    assert len(passes) == 1


@pytest.mark.parametrize("parts", [1, 7, 1 << 13])
def test_counts_of_odd_texts(spark, monkeypatch, parts):
    """Signs of two to four bytes, texts that end and begin within a word, and counts that meet from several tasks."""
    import random

    from quillforge.operators import counts

    monkeypatch.setattr(counts, "_parts", lambda _: parts)
    some, signs = random.Random(3), ["a", "b", "zz", "A", "1", "_", " ", " ", ".", "é", "中", "\U00010400", "\U0001f600", "\n", "²"]
    texts = [None, ""] + ["".join(some.choice(signs) for _ in range(some.randrange(30))) for _ in range(400)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    lists, low = [re.findall(r"\w+", t or "") for t in texts], re.compile("[a-z]+").fullmatch
    want = Counter(f"{a} {b}" for ws in lists for a, b in zip(ws, ws[1:], strict=False) if low(a) and low(b))
    want = {**Counter(w for ws in lists for w in ws if low(w)), **{w: n for w, n in want.items() if n >= 5}}
    got = [tuple(r) for r in counts.lower_counts(docs, least=5).select("w", "n").collect()]
    assert len(got) == len(dict(got)) and dict(got) == want


def test_one_edit_pairs_by_brute_force(spark):
    """Each pair came many times from its keys and was told from the others by distances; now it comes once."""
    from itertools import product

    from quillforge.functions.edits import is_one_edit, is_swap
    from quillforge.operators.neighbours import edit_pairs

    words = spark.createDataFrame([("".join(p), k) for k in range(1, 5) for p in product("ab", repeat=k)] + [("".join(p), 9) for p in product("abc", repeat=3)] + [("aabbcc", 6), ("abbcc", 5), ("aabcbc", 6), ("", 1), ("z", 1)], "candidate string, n long").dropDuplicates(["candidate"])
    typos = words.select(F.col("candidate").alias("typo"))
    made = edit_pairs(typos, words)
    want = typos.crossJoin(words).where(is_one_edit("typo", "candidate")).select("typo", "candidate", is_swap("typo", "candidate").alias("swapped"), "n")
    got = sorted(map(tuple, made.collect()))
    assert got == sorted(map(tuple, want.collect())) and len(got) > 100
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan and "lambda" not in plan


def test_dear_rules_are_computed_only_where_they_count(spark):
    """What several rules share was computed for every row beforehand: 150 misspellings a word for most words in vain."""
    from quillforge.operators import policy

    rows = spark.createDataFrame([("abotu", "about", 5, None, "about", None, [(-5, "about")])], "typo string, correction string, n long, documented string, by_frequency string, swap string, cands array<struct<neg: long, w: string>>")
    total = F.lit(10)
    made = rows.select(policy.five_rule(total).alias("a"), policy.length_gate(total).alias("b"), policy.outcome(total).alias("c"), policy.corpus_exception().alias("d"), policy.six_rule(total).alias("e"))
    assert tuple(made.first()) == (True, True, "alone", False, False)
    for rule in (policy.short_rule(total), policy.five_rule(total), policy.six_rule(total), policy.corpus_exception()):
        plan = rows.select(rule.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        before, guard, _ = plan.partition("CASE WHEN")
        assert guard and "lambda" not in before and "AND array_contains" not in plan and "AND exists" not in plan, plan
