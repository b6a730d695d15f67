from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from quillforge.llm import sharding


def test_draws_have_the_hypergeometric_law(spark):
    """Narrow supports by inversion, wide ones by rejection; chi-square against the exact law."""
    for good, bad, draws in [(5, 9, 6), (3, 40, 20), (400, 900, 300), (900, 400, 1000)]:
        n = 6000
        expr = sharding.hypergeometric(f"{good}L", f"{bad}L", f"{draws}L", "xxhash64(id, 5)")
        got = Counter(r[0] for r in spark.range(n).select(F.expr(expr).alias("k")).collect())
        law = {k: comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws) for k in range(max(0, draws - bad), min(good, draws) + 1)}
        assert set(got) <= set(law)
        usual = [k for k, p in law.items() if p * n >= 8]
        chi = sum((got[k] - law[k] * n) ** 2 / (law[k] * n) for k in usual)
        assert chi < len(usual) + 5 * (2 * len(usual)) ** 0.5, (good, bad, draws, chi)


def test_matrix_has_exact_margins(spark):
    sizes = spark.createDataFrame([(k, 37 * k + 5) for k in range(9)], "block long, n long")
    rows = sharding.matrix(sizes, 24, 3).collect()
    total = sum(37 * k + 5 for k in range(9))
    assert {r["block"]: r["upto"][-1] for r in rows} == {k: 37 * k + 5 for k in range(9)}
    columns = [sum(r["upto"][j] - (r["upto"][j - 1] if j else 0) for r in rows) for j in range(24)]
    assert columns == [total // 24 + (j < total % 24) for j in range(24)]


@pytest.mark.parametrize("n", [0, 5, 24, 1003])
def test_shards_are_exact_and_gapless(spark, monkeypatch, n):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 10)
    df = spark.range(n).select(F.when(F.col("id") % 3 != 0, F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    out, shard, slot = sharding.shuffle_into_shards(df, 24)
    rows = out.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in df.collect())
    by = {}
    for r in rows:
        by.setdefault(r[shard], []).append(r[slot])
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert {s: len(x) for s, x in by.items()} == {j: n // 24 + (j < n % 24) for j in range(24) if n // 24 + (j < n % 24)}


def test_shuffle_is_uniform(spark):
    """Where one row lands is uniform over seeds, and two rows land together as often as chance has it."""
    df = spark.range(48).select(F.col("id").alias("doc_id"))
    first, together = Counter(), 0
    runs = 60
    for seed in range(runs):
        out, shard, _ = sharding.shuffle_into_shards(df, 4, seed)
        at = {r["doc_id"]: r[shard] for r in out.collect()}
        first[at[0]] += 1
        together += sum(at[k] == at[k + 1] for k in range(47))
    assert all(abs(first[s] - runs / 4) < 15 for s in range(4))
    assert abs(together / (47 * runs) - 11 / 47) < 0.03


def test_copies_of_a_row_part(spark):
    """Six copies of each of eight rows, in few blocks: two copies share a shard as often as chance has it."""
    df = spark.range(48).select((F.col("id") % 8).alias("doc_id")).coalesce(1)
    together = pairs = 0
    for seed in range(25):
        out, shard, _ = sharding.shuffle_into_shards(df, 4, seed)
        for n in Counter((r["doc_id"], r[shard]) for r in out.collect()).values():
            together += comb(n, 2)
        pairs += 8 * comb(6, 2)
    assert abs(together / pairs - 11 / 47) < 0.05


def test_main_path_is_native(spark):
    plan = sharding.shuffle_into_shards(spark.range(10).toDF("doc_id"), 3)[0]._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_write_shards(spark, tmp_path):
    df = spark.range(100).toDF("doc_id")
    sharding.write_shards(df, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()} == dict.fromkeys(range(5), 20)


def test_whole_table_by_brute_force(spark):
    """Sizes, checksums and the law, row by row, with null and repeated texts."""
    import zlib

    from shared import SF

    from quillforge.llm import queries

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.op4_sharding(spark, SF).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    by = {}
    for r in rows:
        assert r["law"] == "rows" and r["grown_shard"] is None
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(24)) and all(sorted(x) == list(range(len(x))) for x in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
