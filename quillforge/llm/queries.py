"""The registered query of each operator, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, neighbours, packing, private, quality, sharding, substrings, toxicity
from .common import table
from .labels import fold, sample


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest_neighbours(vectors.where("vec_id % 100 = 0"), vectors, 10)


OP1_SQL = """
WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
             AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


OP3_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM t),
c AS (SELECT conv_id, count(*) AS n, list((role IS NULL)::VARCHAR || coalesce(role, '') || chr(1) || (text IS NULL)::VARCHAR || coalesce(text, '') || chr(2) ORDER BY pos) AS l,
             string_agg('<|' || regexp_replace(coalesce(role, 'unknown'), '<(\\*)\|', '<\1\\|', 'g') || '|>' || chr(10) || regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\1\\|', 'g') || chr(10), '' ORDER BY pos) AS rendered FROM o GROUP BY conv_id),
p AS (SELECT DISTINCT k, sha256(array_to_string(l[1:k], '')) AS h FROM (SELECT l, unnest(range(1, n)) AS k FROM c)),
f AS (SELECT *, sha256(array_to_string(l, '')) AS h FROM c),
m AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k = f.n AND p.h = f.h)),
r AS (SELECT *, row_number() OVER (PARTITION BY n, h ORDER BY conv_id NULLS FIRST) AS rn FROM m)
SELECT conv_id, n AS n_turns, rendered FROM r WHERE rn = 1
"""


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    found, shard, slot = sharding.shuffle_into_shards(docs, 24)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col(shard).alias("shard"), F.col(slot).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(packing.pieces(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    picked = sample(table(spark, sf_dir, "labels"), "toxic", fold("doc_id", 5) != 0, toxicity.SAMPLE)
    found, name = toxicity.score_toxicity(docs, toxicity.fit(docs, picked), keep=["doc_id"], restored=False)
    score = F.col(name)["score"]
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op7_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private.find_private(table(spark, sf_dir, "documents"), keep=["doc_id"], masked=False)
    return found.select("doc_id", *[F.col(found.columns[-1])[f].alias(f) for f in private.FIELDS[:-1]])


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    picked = sample(table(spark, sf_dir, "labels"), "quality", fold("doc_id", 3) != 1, quality.SAMPLE)
    found, name = quality.classify(docs, quality.fit(docs, picked), keep=["doc_id"])
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= 0.5).cast("int").alias("predicted"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), clean=False, keep=["doc_id"])
    d = F.col(found.columns[-1])
    return found.select("doc_id", d["n_words"].alias("n_words"), d["n_hit"].alias("n_hit"), F.size(d["items"]).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", d["items"]), 256).alias("items_sha256"), (d["n_hit"] > 0).alias("contaminated"))


OP10_SQL = r"""
WITH low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, row_number() OVER () AS r FROM documents),
dw AS (SELECT doc_id, r, CASE WHEN t IS NULL THEN []::VARCHAR[] ELSE regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w FROM low),
bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
pos AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks)),
occ AS (SELECT DISTINCT r, i, p.k, item_id FROM pos p JOIN win USING (k, s)),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT r, i, k FROM occ)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM occ) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""

QUERIES = {
    "op1_neighbours": op1_neighbours,
    "op2_substrings": op2_substrings,
    "op3_chat": op3_chat,
    "op4_sharding": op4_sharding,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_private": op7_private,
    "op8_jaccard": op8_jaccard,
    "op9_quality": op9_quality,
    "op10_decontamination": op10_decontamination,
}
ORACLES = {
    "op1_neighbours": OP1_SQL,
    "op3_chat": OP3_SQL,
    "op10_decontamination": OP10_SQL,
}
