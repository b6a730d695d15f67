"""Writing catalogues: grouped JSON, partitioned Parquet, versions that readers see whole or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bucket
from ..operators import bloom

VERSION = 6
#: Underscored, so that readers of the folder pass them over.
MANIFEST, FILTERS = "_manifest.json", "_filters"


def grouped(flat: DataFrame) -> DataFrame:
    """(correction, typos): sorted lists of typos."""
    return flat.groupBy("correction").agg(F.sort_array(F.collect_list("typo")).alias("typos"))


def content_hash(flat: DataFrame) -> str:
    """SHA-256 over sums of row digests in 4,096 parts: the same rows have the same hash, in whatever order and layout.

    Rows are digested where they are; a part's digest is over its count and the sums of its rows' digests in 16 words.
    """
    digest = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(flat.columns)])), 256)
    words = [F.conv(F.substring(digest, 1 + 4 * k, 4), 16, 10).cast("bigint").alias(f"w{k}") for k in range(16)]
    rows = flat.select(F.pmod(F.xxhash64(*sorted(flat.columns)), F.lit(4096)).alias("part"), *words)
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"w{k}").alias(f"w{k}") for k in range(16)])
    each = F.concat_ws(",", *[F.col(c).cast("string") for c in parts.columns])
    return parts.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(each)), ";"), 256).alias("h")).first()["h"]


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # local files have their checksums in files beside them, which can't be replaced together with them
    return where, fs.getRawFileSystem() if fs.getUri().getScheme() == "file" else fs


def current_version(spark: SparkSession, path: str) -> str | None:
    """The version that readers of `path` see."""
    where, fs = _folder(spark, f"{path}/CURRENT")
    if not fs.exists(where):
        return None
    opened = fs.open(where)
    try:  # a file of one line; as a table it would be listed first and read later, when it may have been replaced
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8").strip()
    finally:
        opened.close()


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that readers see the old one or the new one, and a crash leaves either."""
    jvm = spark.sparkContext._jvm
    where, _ = _folder(spark, path)
    new, fs = _folder(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.getUri().getScheme() == "file":
        fs.rename(new, where)
        return
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, where, options)


def publish(flat: DataFrame, path: str, check: bool = False, inputs=None) -> str:
    """Write a version of the catalogue by buckets, with their filters, and point to it, unless it is current already.

    With `check` a stale version raises. Each version has a folder of its own that is written once, with a manifest of
    its rows by bucket; readers hold on to the version they opened, and the pointer is replaced by one rename. `inputs`
    is a function whose value must be the same before and after (a fingerprint of what the catalogue is built from).
    """
    spark = flat.sparkSession
    before = inputs() if inputs else None
    version = f"{VERSION}-{content_hash(flat)[:16]}"
    if current_version(spark, path) == version:
        return version
    if check:
        raise RuntimeError(f"{path} is stale")
    done, fs = _folder(spark, f"{path}/{version}/{MANIFEST}")
    if not fs.exists(done):
        # a folder that another writer has not finished, or never will, is left alone
        folder, fs = _folder(spark, f"{path}/{version}")
        work, _ = _folder(spark, f"{path}/_{version}.{uuid.uuid4().hex}")
        keyed = flat.withColumn("bucket", bucket("typo"))
        keyed.repartition("bucket").sortWithinPartitions("bucket", "typo").write.partitionBy("bucket").parquet(str(work))
        bloom.build(flat).coalesce(1).write.parquet(f"{work}/{FILTERS}")  # 256 rows
        rows = {str(r["bucket"]): r["count"] for r in spark.read.parquet(str(work)).groupBy("bucket").count().collect()}  # 256 at most
        replace_file(spark, f"{work}/{MANIFEST}", json.dumps({"version": VERSION, "rows": rows}, sort_keys=True))
        if inputs and inputs() != before:
            fs.delete(work, True)
            raise RuntimeError("the inputs changed meanwhile")
        if not fs.rename(work, folder) and not fs.exists(done):
            raise RuntimeError(f"{path}/{version} is there but not complete")
    elif inputs and inputs() != before:
        raise RuntimeError("the inputs changed meanwhile")
    replace_file(spark, f"{path}/CURRENT", f"{version}\n")
    return version


def open_catalog(spark: SparkSession, path: str, verify: bool = False) -> DataFrame:
    """The current version's rows (typo, correction, ..., bucket).

    Raises without a version, with one of another format, or without its manifest; with `verify` also if a bucket has
    other rows than the manifest says (one count over the files' footers and their bucket folders).
    """
    version = current_version(spark, path)
    if version is None or not version.startswith(f"{VERSION}-"):
        raise RuntimeError(f"no readable catalogue in {path}")
    where, fs = _folder(spark, f"{path}/{version}/{MANIFEST}")
    if not fs.exists(where):
        raise RuntimeError(f"{path}/{version} is not complete")
    rows = spark.read.parquet(f"{path}/{version}")
    if verify:
        opened = fs.open(where)
        stated = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8"))["rows"]
        opened.close()
        found = {str(r["bucket"]): r["count"] for r in rows.groupBy("bucket").count().collect()}
        if found != stated:
            raise RuntimeError(f"{path}/{version} is damaged")
    return rows


def open_filters(spark: SparkSession, path: str) -> DataFrame:
    """The filters of the current version's buckets, for `operators.bloom.candidates`."""
    version = current_version(spark, path)
    if version is None or not version.startswith(f"{VERSION}-"):
        raise RuntimeError(f"no readable catalogue in {path}")
    return spark.read.parquet(f"{path}/{version}/{FILTERS}")


def grouped_json(flat: DataFrame) -> str:
    """The grouped catalogue as JSON text, sorted, with two blanks of indentation. For files that people review."""
    rows = {r["correction"]: list(r["typos"]) for r in grouped(flat).collect()}
    return json.dumps(rows, indent=2, sort_keys=True) + "\n"


def write_grouped(flat: DataFrame, path: str, check: bool = False) -> int:
    """Write the grouped catalogue as one JSON file; with `check` raise if the file differs. Returns the entries."""
    spark = flat.sparkSession
    text = grouped_json(flat)
    if check:
        where, fs = _folder(spark, path)
        if not fs.exists(where) or spark.read.text(path, wholetext=True).first()["value"] != text:
            raise RuntimeError(f"{path} is stale")
    else:
        replace_file(spark, path, text)
    return flat.count()


def statistics(flat: DataFrame) -> DataFrame:
    """(entries, max_length, destinations) of a catalogue."""
    return flat.agg(F.count(F.lit(1)).alias("entries"), F.max(F.length("typo")).alias("max_length"), F.count_distinct("correction").alias("destinations"))
