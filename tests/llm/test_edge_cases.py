"""Every operator and stage on odd rows, on no rows and with columns named like its own."""

import pytest
from shared import SF
from pyspark.sql import functions as F

from quillforge.llm import chat, decontaminate, jaccard, neighbours, packing, private, quality, queries, sharding, substrings, toxicity
from quillforge.llm.labels import fold, sample

LABELS = "doc_id long, quality int, toxic int"
BENCH = "item_id long, text string"


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0), (5, 0, 1), (6, 1, 0), (7, 0, 1), (9, 1, 0), (9, 1, 1), (None, 1, 1), (7, None, None), (99, 1, 1)], LABELS)


def bench(spark):
    return spark.createDataFrame([(1, "the cat sat on the mat and then it went home"), (2, "one"), (None, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet"), (3, None), (4, ""), (4, "zzz")], BENCH)


@pytest.fixture(scope="module")
def odd_dir(spark, odd_docs, write_tables):
    return write_tables(documents=odd_docs, labels=labels(spark), benchmark=bench(spark), conversations=spark.createDataFrame([(1, 1, "user", "hi"), (1, 1, "user", "hi"), (None, None, None, None), (2, 1, "user", None)], "conv_id long, turn long, role string, text string"),
                        embeddings=spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, None), (3, [None, 1.0]), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, 0.5]), (None, [1.0, 1.0]), (7, [1.0]), (8, []), (100, [0.5, 0.5])], "vec_id long, embedding array<float>"))


@pytest.fixture(scope="module")
def empty_dir(spark, no_docs, write_tables):
    make = spark.createDataFrame
    return write_tables(documents=no_docs, labels=make([], LABELS), benchmark=make([], BENCH), conversations=make([], "conv_id long, turn long, role string, text string"), embeddings=make([], "vec_id long, embedding array<float>"))


DOCUMENT_QUERIES = ["op2_substrings", "op4_sharding", "op6_toxicity", "op7_private", "op8_jaccard", "op9_quality", "op10_decontamination"]


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_one_row_per_document(spark, odd_dir, odd_docs, name):
    rows = queries.QUERIES[name](spark, odd_dir).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd_docs.collect())
    if "score" in rows[0].asDict():
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_give_no_rows(spark, empty_dir, name):
    assert queries.QUERIES[name](spark, empty_dir).count() == 0


def test_odd_vectors(spark, odd_dir):
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in queries.op1_neighbours(spark, odd_dir).collect()}
    assert got == {(0, 1): 1, (0, 2): 6, (0, 3): 100, (100, 1): 1, (100, 2): 6, (100, 3): 0}


def test_odd_conversations(spark, odd_dir):
    got = {r["conv_id"]: (r["n_turns"], r["rendered"]) for r in queries.op3_chat(spark, odd_dir).collect()}
    assert got == {1: (1, "<|user|>\nhi\n"), None: (1, "<|unknown|>\n\n"), 2: (1, "<|user|>\n\n")}


def test_clashing_columns_stay(spark, odd_docs):
    """Operators that return the input's columns keep their values, whatever their names."""
    own = odd_docs.columns
    outs = [
        sharding.shuffle_into_shards(odd_docs, 3)[0],
        private.find_private(odd_docs),
        decontaminate.decontaminate(odd_docs, bench(spark)),
        jaccard.drop_near_duplicates(odd_docs),
        quality.classify(odd_docs, quality.neutral())[0],
        toxicity.score_toxicity(odd_docs, toxicity.Model(toxicity.CharModel(__import__("numpy").zeros(toxicity.SIZE**4)), [], __import__("numpy").zeros(0), 0.0))[0],
    ]
    want = {tuple(r)[5:] for r in odd_docs.collect()}
    for df in outs:
        assert df.columns[: len(own)] == own
        assert {tuple(r)[5 : len(own)] for r in df.collect()} == want


def test_stages_keep_the_columns(spark, odd_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, odd_dir).count() >= docs.count()


def test_stages_on_no_rows(spark, empty_dir):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_samples_are_bounded(spark):
    picked = sample(labels(spark), "quality", F.lit(True), 3)
    assert picked.count() == 3
    assert sample(labels(spark), "quality", fold("doc_id", 3) != 1, 100).where(fold("_id", 3) == 1).count() == 0


def test_modules_name_their_cases():
    for m in (chat, decontaminate, jaccard, neighbours, packing, private, quality, sharding, substrings, toxicity):
        assert "Edge cases" in m.__doc__


def test_sql_agrees(spark, duck):
    from shared import assert_same

    for name, sql in queries.ORACLES.items():
        assert_same(queries.QUERIES[name](spark, SF), duck, sql)
