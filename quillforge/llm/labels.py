"""Bounded, documented training samples of labelled rows, for the two classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def fold(id_col, n: int):
    """crc32(id as text) modulo n; null ids go to fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def sample(labels: DataFrame, label: str, wanted, bound: int, id_col: str = "doc_id") -> DataFrame:
    """At most `bound` rows (_id, _label) where `wanted`, the first by a hash of the id.

    Rows with a null id or label are left out; of repeated ids the largest label counts. The result's size is
    proven by `bound`, so it may be broadcast (some 20 bytes a row).
    """
    rows = labels.where(wanted & F.col(id_col).isNotNull() & F.col(label).isNotNull())
    rows = rows.groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    return rows.orderBy(F.xxhash64("_id"), "_id").limit(bound)


def labelled(docs: DataFrame, picked: DataFrame, text_col: str, id_col: str = "doc_id") -> DataFrame:
    """(_id, _label, _text) of the documents in the sample, one row an id, so that the sample's bound is the result's.

    Of documents with one id the one with the least hash of its text counts. One scan; only texts of the sample are
    shuffled, and those of a repeated id are summed up on the way. Cut, as the fit looks at it more than once.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    met = texts.join(F.broadcast(picked), "_id")
    one = F.min(F.struct(F.xxhash64("_text").alias("h"), "_label", "_text")).alias("r")
    return cut(met.groupBy("_id").agg(one).select("_id", "r._label", "r._text"))
