"""Bloom filters of word buckets, as sets of bit positions: twelve bits an entry, eight probes.

In production Spark's own runtime filters do this; these expressions keep the documented layout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import HASHES, bucket, word_hash

BITS, PROBES = 12, 8
#: Bytes of filters up to which they are broadcast.
BROADCAST_BYTES = 32 << 20


def probes(words: DataFrame, w: str = "typo", bits: str = "bits") -> DataFrame:
    """`words` with `probes`: the positions of each word in a filter of so many bits."""
    first, step = (f"pmod({word_hash(w, a, f)}, {bits})" for a, f in HASHES)
    # the struct is bound once; columns of their own would be evaluated again for every probe
    each = f"transform(sequence(0, {PROBES - 1}), k -> (s.first + k * s.step) % {bits})"
    return words.withColumn("probes", F.expr(f"transform(array(struct({first} AS first, {step} AS step)), s -> {each})[0]"))


def build(catalog: DataFrame) -> DataFrame:
    """(bucket, entries, bits, bytes, checksum): each bucket's filter as bytes, with the first 16 digits of its SHA-256.

    All 256 buckets have one, so that a filter that is not there is known to be missing. A bucket's positions are at most
    its bits; large buckets would be split by more buckets, not by one task.
    """
    keyed = catalog.withColumn("bucket", bucket("typo"))
    every = catalog.sparkSession.range(1, 257).select(F.col("id").alias("bucket"))
    sizes = every.join(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("entries")), "bucket", "left")
    sizes = sizes.select("bucket", F.coalesce("entries", F.lit(0).cast("bigint")).alias("entries")).withColumn("bits", F.greatest(F.lit(1), F.ceil(F.col("entries") * BITS / 8)) * 8)
    places = probes(keyed.join(sizes, "bucket")).select("bucket", "entries", "bits", F.explode("probes").alias("p")).distinct()
    byte = places.groupBy("bucket", F.floor(F.col("p") / 8).alias("at")).agg(F.sum(F.expr("CAST(1 << CAST(p % 8 AS INT) AS BIGINT)")).alias("v"))
    every = sizes.select("bucket", "entries", "bits", F.explode(F.expr("sequence(0L, bits div 8 - 1)")).alias("at"))
    digits = F.lpad(F.hex(F.coalesce("v", F.lit(0))), 2, "0")
    rows = every.join(byte, ["bucket", "at"], "left").groupBy("bucket", "entries", "bits").agg(F.sort_array(F.collect_list(F.struct("at", digits.alias("d")))).alias("all"))
    return rows.select("bucket", "entries", "bits", F.unhex(F.array_join("all.d", "")).alias("bytes")).withColumn("checksum", F.substring(F.sha2("bytes", 256), 1, 16))


def contains(words: DataFrame, filters: DataFrame, w: str = "typo") -> DataFrame:
    """`words` with `maybe`: whether the filter of the word's bucket has all its probes. Never false for an entry.

    A filter that is missing, or that its checksum shows to be damaged, rules nothing out; so does one of another size.
    """
    whole = (F.substring(F.sha2("bytes", 256), 1, 16) == F.col("checksum")) & (F.length("bytes") * 8 == F.col("bits"))
    fit = filters.select("bucket", F.when(F.coalesce(whole, F.lit(False)), F.col("bits")).alias("bits"), "bytes")
    # 256 filters of twelve bits an entry: what the broadcast costs is known before it is made
    size = filters.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0)).alias("n")).first()["n"]
    keyed = words.withColumn("bucket", bucket(w)).join(F.broadcast(fit) if size <= BROADCAST_BYTES else fit, "bucket", "left")
    found = probes(keyed.withColumn("known", F.col("bits").isNotNull()).withColumn("bits", F.coalesce("bits", F.lit(8).cast("bigint"))), w)
    hit = F.expr("forall(probes, p -> (CAST(conv(hex(substring(bytes, CAST(p div 8 AS INT) + 1, 1)), 16, 10) AS INT) & (1 << CAST(p % 8 AS INT))) <> 0)")
    return found.withColumn("maybe", ~F.col("known") | F.coalesce(hit, F.lit(True))).drop("probes", "bits", "bytes", "bucket", "known")


def candidates(words: DataFrame, filters: DataFrame, catalog: DataFrame, w: str = "typo") -> DataFrame:
    """Lookups with the filters before them: only words that may be entries reach the join."""
    maybe = contains(words, filters, w).where("maybe").drop("maybe")
    return maybe.join(catalog.select(F.col("typo").alias(w), "correction"), w)
