import math
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillforge.llm import jaccard, neighbours
from quillforge.llm.graph import components


@pytest.mark.parametrize(("n", "dim"), [(700, 16), (300, 64)])
def test_neighbours_equal_brute_force(spark, monkeypatch, n, dim):
    monkeypatch.setattr(neighbours, "TILE_ROWS", 64)
    monkeypatch.setattr(neighbours, "CELL_CANDIDATES", 128)
    monkeypatch.setattr(neighbours, "CELL_QUERIES", 32)
    monkeypatch.setattr(neighbours, "FAN_IN", 2)
    x = np.random.default_rng(1).normal(size=(n, dim)).astype(np.float32)
    x[n // 2 : n // 2 + 60] = x[0]  # a group of copies
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    got = neighbours.nearest_neighbours(df.where("vec_id % 7 = 0"), df, 10).collect()
    y = x.astype(np.float64)
    want = {}
    for q in range(0, n, 7):
        d = np.array([math.sqrt(reduce(lambda a, t: a + t * t, (v - y[q]).tolist(), 0.0)) for v in y])
        order = [k for k in np.lexsort((np.arange(n), d)) if k != q][:10]
        want |= {(q, r + 1): (k, d[k]) for r, k in enumerate(order)}
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == want


@pytest.mark.parametrize("parts", [1, 3])
def test_repeated_rows_push_no_neighbour_out(spark, parts):
    """More than k rows equal in id and vector, and one id with two vectors at one distance, which are two rows."""
    rows = [(0, [10.0, 0.0])] + [(1, [11.0, 0.0])] * 12 + [(k, [12.0, 0.0]) for k in range(3, 13)] * 2 + [(2, [12.0, 0.0]), (2, [8.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)
    got = {r["rank"]: (r["vec_id"], r["score"]) for r in neighbours.nearest_neighbours(df.where("vec_id = 0"), df, 10).collect()}
    assert got == dict(enumerate([(1, 1.0), (2, 2.0), (2, 2.0), *((k, 2.0) for k in range(3, 10))], 1))


@pytest.mark.parametrize(("parts", "tile"), [(1, 2048), (4, 32)])
def test_repeated_rows_and_wild_values(spark, monkeypatch, parts, tile):
    """Rows repeated 1 to 30 times, in one tile and across tiles, with components from 1e-320 to 1e200."""
    monkeypatch.setattr(neighbours, "TILE_ROWS", tile)
    monkeypatch.setattr(neighbours, "CELL_CANDIDATES", 4 * tile)
    rng = np.random.default_rng(11)
    distinct = [(k, (rng.normal(size=4) * 10.0 ** float(rng.choice([-320, -300, -160, -3, 0, 0, 0, 5, 150, 200]))).tolist()) for k in range(90)]
    distinct = [(k, v) for k, v in distinct if any(v)]
    rows = [r for r in distinct for _ in range(int(rng.integers(1, 31)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
    got = {}
    for r in neighbours.nearest_neighbours(df.where("vec_id % 9 = 0"), df, 10).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    for q, x in distinct:
        if q % 9 == 0:
            with np.errstate(over="ignore"):
                d = [(float(np.sqrt(reduce(lambda a, t: a + t * t, (np.array(v) - np.array(x)), np.float64(0)))), k) for k, v in distinct if k != q]
            assert got[q] == dict(enumerate(sorted(d)[:10], 1))


def test_error_bounds_hold():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(50, 1500)), rng.normal(size=(60, 1500)) * rng.uniform(0.01, 9, (60, 1))
    (cx, sx, nx, ex), (cy, sy, ny, ey) = neighbours.quantise(x), neighbours.quantise(y)
    approx = neighbours.products(cx, cy) * sx[:, None] * sy[None]
    assert (np.abs(approx - x @ y.T) <= nx[:, None] * ey[None] + ex[:, None] * (ny + ey)[None] + 1e-9).all()
    assert (neighbours.products(cx, cy) == cx.astype(np.int64) @ cy.astype(np.int64).T).all()


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 202), (202, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)} | {k: 200 for k in (200, 201, 202)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_classes(texts):
    """(least index of the class, links) of each text, by comparing all pairs."""
    import re

    words = [re.findall(rb"[0-9a-z\x80-\xff]+", bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode())) for t in texts]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None for w in words]
    root = list(range(len(texts)))
    links = [set() for _ in texts]

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if texts[i] == texts[j] if not (a and b) else (a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9):
                root[max(find(i), find(j))] = min(find(i), find(j))
                if a and a != b:
                    links[i].add(b)
                    links[j].add(a)
    return [(find(k), len(links[k])) for k in range(len(texts))]


def near_copies(seed, groups=12, members=14, words=80):
    rng = np.random.default_rng(seed)
    vocab = [f"w{k}" for k in range(4000)]
    texts = []
    for _ in range(groups):
        base = rng.choice(vocab, words).tolist()
        for m in range(members):
            copy = list(base)
            for _ in range(int(rng.integers(0, 5))):
                copy[int(rng.integers(words))] = str(rng.choice(vocab))
            texts.append(" ".join(copy) + ("." if m % 3 else ""))
    texts += [texts[0]] * 5 + ["", "", " . ", "?", " . ", "one two", "one two", "One, two!", "a b c d e", "a b c d e f"]
    return texts


def test_jaccard_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL_SETS", 6)  # many cells for a group
    texts = near_copies(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.classes(docs).collect()}
    assert [got[k] for k in range(len(texts))] == brute_classes(texts)


def chain(n, step=12, width=80):
    """Texts that each share all but `step` words with the next one: one component of band links, few pairs."""
    words = [f"c{k}" for k in range(step * n + width)]
    return [" ".join(words[step * k : step * k + width]) for k in range(n)]


def test_chains_are_compared_within_buckets(spark, monkeypatch):
    """A chain far larger than a cell: pairs within its buckets, each once, and no more links than brute force finds."""
    monkeypatch.setattr(jaccard, "CELL_SETS", 24)
    texts = chain(500, 8) + near_copies(8, 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    dealt = []
    real = jaccard.groups
    monkeypatch.setattr(jaccard, "groups", lambda sets: dealt.append(real(sets)) or dealt[0])
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.classes(docs).collect()}
    assert [got[k] for k in range(len(texts))] == brute_classes(texts)
    assert dealt[0].where("band >= 0").count() > 0 and dealt[0].where("band < 0").count() > 0


def test_work_in_a_long_chain_is_linear(spark, monkeypatch):
    """Four times the documents in one chain, about four times the pairs that are compared, and not sixteen times."""
    monkeypatch.setattr(jaccard, "CELL_SETS", 64)

    def pairs(n):
        docs = spark.createDataFrame(list(enumerate(chain(n, 8))), "doc_id long, text string").repartition(4)
        sets = jaccard.sketches(docs, "text", "doc_id").selectExpr("xxhash64(digest) AS node", "n", "sketch")
        sizes = jaccard.groups(sets).groupBy("cell", "band").count()
        return sizes.agg(F.sum(F.col("count") * F.col("count"))).first()[0]

    assert pairs(2000) < 5 * pairs(500)


def test_equal_rows_and_extra_columns(spark):
    """Of rows equal in id and text one stays whatever its other columns; null texts all stay."""
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (2, "a b c d e f g", "z"), (3, None, "n"), (3, None, "m"), (3, "", "e"), (4, "", "e"), (None, "q r s t u v", None), (None, "q r s t u v", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, copies string")
    got = sorted((str(r["doc_id"]), str(r["text"]), r["copies"] or "") for r in jaccard.drop_near_duplicates(docs).collect())
    assert [g[:2] for g in got] == [("1", "a b c d e f g"), ("3", ""), ("3", "None"), ("3", "None"), ("None", "q r s t u v")]
    assert {g[2] for g in got if g[1] == "None"} == {"n", "m"} and got[0][2] in ("x", "y")


def test_recall_of_all_pairs(spark):
    """Every pair at the threshold among the documents of a small data set, by brute force."""
    from shared import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.classes(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    want = brute_classes([r["text"] for r in docs])
    assert [got[r["doc_id"]] for r in docs] == [(docs[c]["doc_id"], n) for c, n in want]


def test_one_of_each_class_stays(spark):
    texts = near_copies(4)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in jaccard.drop_near_duplicates(docs).collect())
    assert kept == sorted({c for c, _ in brute_classes(texts)})


def test_dense_and_sparse_verification_agree():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 60, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) < 0.9], rng.integers(0, 1 << 60, 9).astype(np.uint64)])) for _ in range(90)]
    i, j = (x.ravel() for x in np.triu_indices(90, 1))
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
    assert jaccard.shared_grams(sets, sets, i, j).tolist() == want


def test_pruning_tolerance():
    from math import comb

    for n in (42, 252):
        m = jaccard.least_matches(0.8, n, 1e-6)
        lost = sum(comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(m))
        assert lost < 1e-5 and m > 0.45 * n
