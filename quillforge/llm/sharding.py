"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix. Native: SQL functions only.

1. Rows are dealt round robin over source blocks and permuted locally (ordered by content, then sorted by a hash of seed
   and place, so that copies of a row are permuted like other rows).
2. One row of SQL draws the matrix of exact counts: block by block, each shard's share is a hypergeometric draw from
   what the shards have left (inversion for narrow supports, a ratio-of-uniforms rejection otherwise), so that the
   matrix has the law of a uniform permutation's.
3. Each block sends its rows, in permuted order, by its counts (a broadcast of at most `MAX_BLOCKS` rows).
4. Each shard permutes what it received: rows are cut into buckets by a second hash, ranked in their bucket, and
   shifted by the rows of earlier buckets, so no task holds a whole shard.

Shard sizes differ by at most one row. Slots run without gaps from 0 in each shard.

Edge cases: nulls anywhere are values like others; repeated rows are dealt one by one and part like other rows; a draw
whose attempts all fail (a probability under 2**-64) is the mode of its law; an empty table gives no rows; with fewer rows than shards, the first shards get one each; columns named like the
operator's own (`shard`, `slot`) are kept, and the operator's get underscores before their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, shuffle_parts

#: Most source blocks, and so rows of the matrix.
MAX_BLOCKS = 1024
#: Rows of a bucket within a shard, about.
BUCKET_ROWS = 32_768
#: Attempts of the rejection sampler; each succeeds with a probability over 1/2.
ATTEMPTS = 64
#: Widest support drawn by inversion.
NARROW = 64

_LN_FACT = [math.lgamma(n + 1) for n in range(16)]


def _ln_fact(n: str) -> str:
    table = ", ".join(f"{x!r}D" for x in _LN_FACT)
    return f"(CASE WHEN {n} < 16 THEN element_at(array({table}), CAST({n} AS INT) + 1) ELSE ({n} + 0.5D) * ln({n}) - {n} + {0.5 * math.log(2 * math.pi)!r}D + 1D / (12D * {n}) - 1D / (360D * {n} * {n} * {n}) END)"


def _let(name: str, value: str, body: str) -> str:
    """`body` with `name` bound to `value`, which is evaluated once."""
    return f"(transform(array({value}), {name} -> {body})[0])"


def _uniform(seed: str, k: str) -> str:
    return f"((shiftrightunsigned(xxhash64({seed}, {k}), 11) + 0.5D) / 9007199254740992D)"


def hypergeometric(good: str, bad: str, draws: str, seed: str) -> str:
    """SQL for one draw: how many of `draws` from good + bad are good."""
    terms = lambda k, g, b, m: f"({_ln_fact(k)} + {_ln_fact(f'({g} - {k})')} + {_ln_fact(f'({m} - {k})')} + {_ln_fact(f'({b} - {m} + {k})')})"
    mode = "CAST(floor((x.m + 1D) * (x.g + 1D) / (x.g + x.b + 2D)) AS BIGINT)"
    narrow = _let(
        "w",
        _let("top", terms(f"least(x.hi, greatest(x.lo, {mode}))", "x.g", "x.b", "x.m"), f"transform(sequence(x.lo, x.hi), k -> exp(top - {terms('k', 'x.g', 'x.b', 'x.m')}))"),
        f"aggregate(w, named_struct('left', {_uniform('x.s', '0')} * aggregate(w, 0D, (p, q) -> p + q), 'k', x.lo, 'found', CAST(NULL AS BIGINT)), "
        "(z, q) -> named_struct('left', z.left - q, 'k', z.k + 1, 'found', coalesce(z.found, CASE WHEN z.left - q <= 0 THEN z.k END)), z -> coalesce(z.found, x.hi))",
    )
    small = "named_struct('s', x.s, 'g', least(x.g, x.b), 'b', greatest(x.g, x.b), 'm', least(x.m, x.g + x.b - x.m))"
    shape = "named_struct('a', y.m * (y.g / (y.g + y.b)) + 0.5D, 'c', sqrt((y.g + y.b - y.m) * 1D * (y.g / (y.g + y.b)) * (y.b / (y.g + y.b)) / (y.g + y.b - 1D) * y.m + 0.5D), 'top', " + _let("md", "CAST(floor((y.m + 1D) * (y.g + 1D) / (y.g + y.b + 2D)) AS BIGINT)", terms("md", "y.g", "y.b", "y.m")) + ", 'md', CAST(floor((y.m + 1D) * (y.g + 1D) / (y.g + y.b + 2D)) AS BIGINT))"
    attempt = _let(
        "p",
        f"named_struct('u', {_uniform('y.s', '2 * t')}, 'v', {_uniform('y.s', '2 * t + 1')})",
        _let(
            "e",
            "r.a + (1.7155277699214135D * r.c + 0.8989161620588988D) * (p.v - 0.5D) / p.u",
            "CASE WHEN e < 0 OR e >= least(least(y.m, y.g) + 1D, floor(r.a + 16D * r.c)) THEN CAST(NULL AS BIGINT) ELSE "
            + _let(
                "k",
                "CAST(floor(e) AS BIGINT)",
                _let("d", f"r.top - {terms('k', 'y.g', 'y.b', 'y.m')}", "CASE WHEN p.u * (4D - p.u) - 3D <= d THEN k WHEN p.u * (p.u - d) >= 1D THEN NULL WHEN 2D * ln(p.u) <= d THEN k END"),
            )
            + " END",
        ),
    )
    wide = _let("y", small, _let("r", shape, f"coalesce(aggregate(sequence(1, {ATTEMPTS}), CAST(NULL AS BIGINT), (f, t) -> CASE WHEN f IS NOT NULL THEN f ELSE {attempt} END), r.md)"))
    turned = _let("k1", wide, _let("k2", "CASE WHEN x.g > x.b THEN least(x.m, x.g + x.b - x.m) - k1 ELSE k1 END", "CASE WHEN x.g + x.b - x.m < x.m THEN x.g - k2 ELSE k2 END"))
    given = f"named_struct('g', {good}, 'b', {bad}, 'm', {draws}, 's', {seed}, 'lo', greatest(0L, {draws} - ({bad})), 'hi', least({draws}, {good}))"
    return _let("x", given, f"CASE WHEN x.hi <= x.lo THEN x.lo WHEN x.hi - x.lo <= {NARROW} THEN {narrow} ELSE {turned} END")


def matrix(sizes: DataFrame, shards: int, seed: int) -> DataFrame:
    """(block, upto): for each source block, how many of its rows go to the first 1, 2, ... shards.

    `sizes` has (block, n), at most `MAX_BLOCKS` rows or as many as there are partitions.
    """
    one = sizes.agg(F.sort_array(F.collect_list(F.struct("block", "n"))).alias("sizes")).select(F.col("sizes.block").alias("blocks"), F.col("sizes.n").alias("ns"))
    one = one.withColumn("total", F.expr("aggregate(ns, 0L, (a, b) -> a + b)"))
    one = one.withColumn("caps", F.expr(f"transform(sequence(0, {shards - 1}), j -> total div {shards} + CASE WHEN j < total % {shards} THEN 1L ELSE 0L END)"))
    draw = hypergeometric("s.rem[j]", "(q.pool - s.rem[j])", "q.left", f"xxhash64({seed}, i, j)")
    row = f"aggregate(sequence(0, {shards - 1}), named_struct('left', ns[i], 'pool', aggregate(s.rem, 0L, (a, b) -> a + b), 'take', CAST(array() AS ARRAY<BIGINT>)), (q, j) -> {_let('h', draw, 'named_struct(' + chr(39) + 'left' + chr(39) + ', q.left - h, ' + chr(39) + 'pool' + chr(39) + ', q.pool - s.rem[j], ' + chr(39) + 'take' + chr(39) + ', concat(q.take, array(h)))')}, q -> q.take)"
    step = _let("w", row, "named_struct('rem', zip_with(s.rem, w, (a, b) -> a - b), 'out', concat(s.out, array(w)))")
    drawn = f"aggregate(sequence(0, size(ns) - 1), named_struct('rem', caps, 'out', CAST(array() AS ARRAY<ARRAY<BIGINT>>)), (s, i) -> {step}, s -> s.out)"
    rows = one.where(F.size("ns") > 0).select(F.posexplode(F.expr(drawn)).alias("i", "row"), "blocks")
    upto = "transform(sequence(1, size(row)), k -> aggregate(slice(row, 1, k), 0L, (a, x) -> a + x))"
    return rows.select(F.expr("blocks[i]").alias("block"), F.expr(upto).alias("upto"))


def shuffle_into_shards(df: DataFrame, shards: int = 24, seed: int = 2024, as_shard: str = "shard", as_slot: str = "slot") -> tuple[DataFrame, str, str]:
    """`df` with a shard and a slot column; their names (underscores before them if taken) are returned too."""
    shard, slot = fresh(df, as_shard), fresh(df, as_slot)
    own = [F.col(f"`{c}`") for c in df.columns]
    hashed = [F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(f"`{f.name}`") for f in df.schema.fields]
    body = df.select(F.struct(*own).alias("r"), F.xxhash64(F.lit(seed), *hashed).alias("k1"))
    blocks = min(MAX_BLOCKS, shuffle_parts(df.sparkSession))
    # the order by content is one that a lost block comes back in; the permutation is by places in it, so that copies part
    ordered = body.repartition(blocks).sortWithinPartitions("k1").select("r", F.monotonically_increasing_id().alias("at"))
    placed = cut(ordered.sortWithinPartitions(F.xxhash64(F.lit(seed), "at")).select("r", F.monotonically_increasing_id().alias("id")))
    block, rank = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    placed = placed.withColumns({"block": block, "rank": rank})
    sizes = placed.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    total = placed.count()
    moved = placed.join(F.broadcast(matrix(sizes, shards, seed)), "block").withColumn("s", F.expr("CAST(size(filter(upto, c -> c <= rank)) AS INT)"))
    buckets = max(1, math.ceil(total / shards / BUCKET_ROWS))
    moved = moved.select("r", "id", "s", F.xxhash64(F.lit(seed + 1), "id").alias("k2"))
    moved = moved.withColumn("bucket", F.least(F.lit(buckets - 1), F.floor(F.shiftrightunsigned("k2", 1) / F.lit(2.0**63) * buckets).cast("int")))
    counts = moved.groupBy("s", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("s", "bucket", (F.sum("n").over(Window.partitionBy("s").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = moved.withColumn("at", F.row_number().over(Window.partitionBy("s", "bucket").orderBy("k2", "id")))
    out = ranked.join(before, ["s", "bucket"])
    return out.select(*[F.col(f"r.`{c}`").alias(c) for c in df.columns], F.col("s").alias(shard), (F.col("before") + F.col("at") - 1).alias(slot)), shard, slot


def write_shards(df: DataFrame, path: str, shards: int = 24, seed: int = 2024) -> None:
    """Write the shuffled rows as one Parquet folder per shard, in order of slots within each file."""
    out, shard, slot = shuffle_into_shards(df, shards, seed)
    out.repartition(F.col(shard), F.floor(F.col(slot) / 1_000_000)).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
