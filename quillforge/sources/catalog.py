"""Catalogues and evidence: loading, validation, flattening.

A grouped catalogue is a JSON object of correction -> list of typos. Flat, it has rows (typo, correction) with unique
typos. Rules: corrections are one lower-case ASCII word or two with one blank, typos are one such word, lists aren't
empty, a typo differs from its correction and has only one.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import reduce
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import once
from ..functions.text import CORRECTION, DOCUMENTED_SHORT, LOWER_WORD

FLAT = T.StructType([T.StructField("typo", T.StringType(), False), T.StructField("correction", T.StringType(), False)])
PROTECTED = "word string, evidence struct<reason:string,source:string>"
REVIEWED = "typo string, correction string, reason string, source string"


class InvalidCatalog(ValueError):
    """A catalogue or an evidence file breaks a rule."""


def parsed(raw: DataFrame, text_col: str = "source") -> DataFrame:
    """`raw` with `entries` (map of correction to typos) and `error` (the broken rule, or null), one row a catalogue.

    Everything is checked with JSON and array functions; nothing is inferred. A list that isn't one of strings
    makes the strict parse fail.
    """
    source = F.col(f"`{text_col}`")
    keys = F.json_object_keys(source)
    variant = F.try_parse_json(source)
    strict = F.try_variant_get(variant, "$", "map<string,array<string>>")
    kinds = F.schema_of_variant(variant)
    typos = F.flatten(F.map_values("entries"))
    df = once(raw, keys=keys, kind=kinds, entries=strict, read=variant.isNotNull() | source.isNull())
    pairs = F.flatten(F.transform(F.map_entries("entries"), lambda e: F.transform(e["value"], lambda t: F.struct(t.alias("typo"), e["key"].alias("correction")))))
    df = once(df, pairs=pairs)
    wrong_values = ~F.col("kind").rlike(r"(?s)\AOBJECT<.*>\z")
    error = (
        F.when(~F.col("read") & F.col("keys").isNull(), "malformed")
        .when(F.size("keys") != F.size(F.array_distinct("keys")), "duplicate key")  # first, as variants have no such objects
        .when(F.col("kind").isNull() | wrong_values, "root is no object")
        .when(F.col("entries").isNull(), "value is no list of strings")
        .when(F.exists(F.map_values("entries"), lambda v: v.isNull()), "value is no list of strings")
        .when(F.exists(F.map_values("entries"), lambda v: F.size(v) == 0), "empty list")
        .when(F.exists(F.map_keys("entries"), lambda k: ~k.rlike(CORRECTION)), "invalid correction")
        .when(F.exists(typos, lambda t: t.isNull()), "typo is no string")
        .when(F.exists(typos, lambda t: ~t.rlike(LOWER_WORD)), "invalid typo")
        .when(F.exists("pairs", lambda p: p["typo"] == p["correction"]), "typo equals correction")
        .when(F.size(typos) != F.size(F.array_distinct(typos)), "typo has two corrections")
    )
    return once(df, error=error).drop("kind", "read")


def flattened(df: DataFrame) -> DataFrame:
    """(typo, correction) rows of parsed catalogues without errors; other columns of `df` come before."""
    rest = [c for c in df.columns if c not in ("keys", "entries", "pairs", "error", "source")]
    return df.where("error IS NULL").select(*rest, F.explode("pairs").alias("p")).select(*rest, "p.typo", "p.correction")


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Flat catalogue from a grouped JSON file, or `InvalidCatalog`."""
    df = parsed(spark.read.text(path, wholetext=True).withColumnRenamed("value", "source"))
    broken = df.where("error IS NOT NULL").select("error").first()
    if broken:
        raise InvalidCatalog(broken["error"])
    return flattened(df).select("typo", "correction")


def validate_flat(flat: DataFrame) -> DataFrame:
    """(rule, rows): how many rows of a flat catalogue break each rule; all zero in a valid one."""
    rules = {
        "invalid_correction": ~F.coalesce(F.col("correction").rlike(CORRECTION), F.lit(False)),
        "invalid_typo": ~F.coalesce(F.col("typo").rlike(LOWER_WORD), F.lit(False)),
        "identity": F.col("typo").eqNullSafe(F.col("correction")),
        "short_typo": F.length("typo") < 3,
    }
    counts = flat.agg(*[F.count_if(v).alias(k) for k, v in rules.items()])
    twice = flat.groupBy("typo").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("conflict"))
    return counts.crossJoin(twice).select(F.explode(F.create_map(*[x for k in (*rules, "conflict") for x in (F.lit(k), F.col(k))])).alias("rule", "rows"))


# ---- evidence ----------------------------------------------------------------------------------------


def _unique(pairs):
    found = dict(pairs)
    if len(found) != len(pairs):
        raise InvalidCatalog("duplicate key")
    return found


def _evidence(text: str, extra: tuple[str, ...]) -> dict[str, dict]:
    """A small nested evidence file, checked on the driver: exactly the named fields, all filled, sources on the web."""
    try:
        data = json.loads(text, object_pairs_hook=_unique)
    except ValueError as e:
        raise InvalidCatalog(str(e)) from e
    if not isinstance(data, dict):
        raise InvalidCatalog("root is no object")
    for word, record in data.items():
        if not re.fullmatch("[a-z]+", word):
            raise InvalidCatalog(f"invalid word: {word!r}")
        if not isinstance(record, dict) or set(record) != {"reason", "source", *extra}:
            raise InvalidCatalog(f"invalid evidence for {word}")
        if not all(isinstance(x, str) and x.strip() for x in record.values()):
            raise InvalidCatalog(f"empty evidence for {word}")
        try:
            url = urlsplit(record["source"])
            host = url.hostname
        except ValueError as e:
            raise InvalidCatalog(f"invalid source for {word}") from e
        if url.scheme not in ("http", "https") or not host or re.search(r"\s", record["source"]):
            raise InvalidCatalog(f"invalid source for {word}")
        if "correction" in extra and (not re.fullmatch("[a-z]+( [a-z]+)?", record["correction"]) or record["correction"] == word):
            raise InvalidCatalog(f"invalid correction for {word}")
    return data


def protected_words(spark: SparkSession, text: str) -> DataFrame:
    data = _evidence(text, ())
    return spark.createDataFrame([(w, (r["reason"], r["source"])) for w, r in data.items()], PROTECTED)


def reviewed_corrections(spark: SparkSession, text: str) -> DataFrame:
    data = _evidence(text, ("correction",))
    return spark.createDataFrame([(w, r["correction"], r["reason"], r["source"]) for w, r in data.items()], REVIEWED)


def documented_lines(lines: DataFrame, reviewed: DataFrame | None = None, value_col: str = "value") -> DataFrame:
    """(typo, correction), one row a typo, from `typo->correction` lines with reviewed pairs laid over them.

    Lines without an arrow and corrections that aren't words (several suggestions have commas) document nothing. Of
    lines with one typo the last counts; `lines` has their order in a column `number` if it has one, and the greatest
    correction counts otherwise. A reviewed pair raises if any line, also one with several suggestions, has its typo
    with another correction, or if it is one of the short pairs that lines must confirm and none does.
    """
    parts = F.split(F.col(value_col), "->", 2)
    order = F.col("number") if "number" in lines.columns else F.lit(0)
    stated = lines.where(F.col(value_col).contains("->")).select(parts[0].alias("typo"), parts[1].alias("correction"), order.alias("number"))
    pairs = stated.where(F.col("correction").rlike(CORRECTION)).groupBy("typo").agg(F.max(F.struct("number", "correction"))["correction"].alias("correction"))
    if reviewed is None:
        return pairs
    clash = documentation_conflicts(stated, pairs, reviewed).first()
    if clash:
        raise InvalidCatalog(f"{clash['problem']}: {clash['typo']}")
    extra = reviewed.select("typo", "correction")
    return pairs.join(extra, "typo", "left_anti").union(extra)


def documentation_conflicts(stated: DataFrame, pairs: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(typo, problem) of reviewed pairs that the stated lines contradict, or that they would have to confirm."""
    extra = reviewed.select("typo", F.col("correction").alias("own"))
    against = stated.join(extra, "typo").where(~F.col("correction").eqNullSafe(F.col("own"))).select("typo", F.lit("conflicting documentation").alias("problem"))
    short = extra.where(F.col("typo").isin(*[t for t, _ in DOCUMENTED_SHORT])).join(pairs, "typo", "left").where(~F.col("correction").eqNullSafe(F.col("own")))
    return against.union(short.select("typo", F.lit("short pair without documentation"))).distinct()


def word_lists(spark: SparkSession, folder: str) -> DataFrame:
    """(word, level, list) from a folder of Latin-1 lists whose file suffix is the level."""
    files = spark.read.format("binaryFile").load(folder)  # the text reader knows UTF-8 only
    name = F.element_at(F.split("path", "/"), -1)
    lines = F.split(F.regexp_replace(F.decode("content", "ISO-8859-1"), r"\r?\n\z", ""), r"\r?\n")
    return files.select(F.explode(lines).alias("word"), F.regexp_extract(name, r"\.([0-9]+)\z", 1).cast("int").alias("level"), name.alias("list"))


def pronounced_words(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a pronunciation list: lines of a word and its sounds, in lower case, each word once.

    Variants are numbered (`word(2)`); lines that begin with three semicolons, or with no letter, are left out.
    """
    word = F.lower(F.regexp_extract("value", r"\A([A-Za-z][^\s(]*)(\([0-9]+\))?\s", 1))
    return spark.read.text(path).select(word.alias("word")).where("word <> ''").distinct()


def frequency_table(words: DataFrame, w: str = "w") -> DataFrame:
    """(word, n) counts of a column of words."""
    return words.groupBy(F.col(w).alias("word")).agg(F.count(F.lit(1)).alias("n"))


def lexicon(**lists: DataFrame) -> DataFrame:
    """(word, <one flag for each list>): the union of the given one-column lists with their memberships."""
    names = list(lists)
    rows = reduce(DataFrame.union, [d.toDF("word").select("word", *[F.lit(k == name).alias(k) for k in names]) for name, d in lists.items()])
    return rows.groupBy("word").agg(*[F.bool_or(k).alias(k) for k in names])


def corpus_hash(spark: SparkSession, folder: str) -> str:
    """SHA-256 over the names and bytes of a folder's files in order of names, file by file.

    Only one file's bytes are held at a time; word lists are small.
    """
    files = spark.read.format("binaryFile").load(folder)
    names = sorted(r["path"] for r in files.select("path").collect())
    total = hashlib.sha256()
    for path in names:
        data = files.where(F.col("path") == path).select("content").first()["content"]
        total.update(path.rsplit("/", 1)[-1].encode() + b"\0" + bytes(data))
    return total.hexdigest()


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """SHA-256 of the paths, lengths and modification times of the inputs; no content is read."""
    meta = spark.read.format("binaryFile").load(list(paths)).select("path", "length", "modificationTime")
    each = F.concat_ws("|", "path", F.col("length").cast("string"), F.col("modificationTime").cast("string"))
    return meta.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(each)), ","), 256).alias("h")).first()["h"]
