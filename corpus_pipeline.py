"""The corpus pipeline: quality, near duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of documents
(the last one returns packed sequences). `run` writes each stage's result as Parquet and reads it again.

Edge cases are those of the operators: null texts pass every filter by their score, stay single among near
duplicates, and pack as the end token alone; repeated ids stay apart unless their texts are near duplicates; further
columns of the input pass through all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.llm import decontaminate, jaccard, packing, private, quality
from quillforge.llm.common import fresh, shared_folder, table
from quillforge.llm.labels import fold, sample


def _with_text(docs: DataFrame, text) -> DataFrame:
    """`docs` with another text and, if it has the column, its new length in characters."""
    name = fresh(docs, "new_text")
    changed = docs.withColumn(name, text)
    own = {"text": F.col(name), "n_chars": F.when(F.col(name).eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length(name).cast("long")) if "n_chars" in docs.columns else None}
    return changed.select(*[own[c].alias(c) if c in own else F.col(f"`{c}`") for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; labels of one fold in three are never learnt from, as in its query."""
    picked = sample(table(spark, sf_dir, "labels"), "quality", fold("doc_id", 3) != 1, quality.SAMPLE)
    scored, name = quality.classify(docs, quality.fit(docs, picked))
    return scored.where(F.col(name) >= 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return jaccard.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans that the benchmark has too."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    name = found.columns[-1]
    return _with_text(found, F.coalesce(F.col(name)["clean"], F.col("text"))).drop(name)


def private_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose personal data are replaced by their kinds."""
    found = private.find_private(docs)
    name = found.columns[-1]
    return _with_text(found, F.coalesce(F.col(name)["masked"], F.col("text"))).drop(name)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences and places."""
    return packing.pack(packing.pieces(docs)).select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality", quality_stage),
    ("jaccard", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("private", private_stage),
    ("packing", packing_stage),
]

#: The classifier and the packing have no counterpart in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage is written to the shared folder, and goes when its successor is there."""
    top, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{top}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        before = path
    return docs
