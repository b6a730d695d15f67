import pytest

LONG = "lorem ipsum dolor sit amet " * 40_000
TEXTS = [None, "", "   \n\t ", "one", "a b c d", "Mail me@example.com or +49 30 1234567, 10.0.0.1. 4111 1111 1111 1111", LONG, "überall naïve Wörter 日本語 🙂 <|endoftext|>", "the cat sat on the mat and then it went home again", "the cat sat on the mat and then it went home again"]
CLASHING = ("shard", "slot", "features", "scanned", "private", "decontamination", "quality_score", "toxicity", "class_id", "text_key", "id_key", "copy", "alone", "new_text", "label", "score", "digest", "row", "piece", "length", "uid", "group", "bin", "_text", "_id", "_label", "r", "id", "k1", "bucket")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, null and repeated ids, clashing names."""
    rows = [(k if k % 4 else None, t, None if k % 2 else "en", None if k % 3 else "s", None if t is None else len(t)) for k, t in enumerate(TEXTS)]
    rows += rows[4:6] + [(5, "another text under the same id", "en", "s", 30), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def write_tables(spark, tmp_path_factory):
    """A folder with the given tables as Parquet."""

    def write(**tables):
        top = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"{top}/{name}.parquet")
        return str(top)

    return write
