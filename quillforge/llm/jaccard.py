"""N-gram Jaccard join with Bayesian candidate pruning.

Texts become sets of hashed word 5-grams (words as in the other operators: digits, letters and anything beyond
ASCII, lower-cased; a text of one to four words is one gram). Equal sets are one class member from the start.

1. One pass computes set digests and MinHash sketches (`HASHES` values of 16 bits); texts leave the plan.
2. Band keys are counted first; a Bloom filter of those that occur twice picks the (key, set) rows that go further.
3. Each bucket links its members to its least member only (no pairs); the components of these links hold every
   candidate pair. The pairs to look at are those within a component or, where that is less work (chains through
   shared passages), those within its buckets, each pair in the first band it shares.
4. Groups are dealt into cells of bounded size, block against block. In a cell, pairs are compared sketch value by
   sketch value, `STEP` at a time; a pair goes when the posterior probability (uniform prior) of reaching the threshold
   falls below `TOLERANCE`. Survivors are verified exactly on their gram sets, which are read again for members of
   groups alone. A cell returns per member its number of links and one link towards a root of the cell, never pairs.
5. Components of these verified links are the near-duplicate classes; links are summed per member.

At the threshold of 0.8 the bands miss a pair with a probability of 3e-6, the pruning with one below 1e-5.

Edge cases: null texts are linked to nothing and are classes of their own; texts without words (empty ones too) share
a class if they are equal; equal gram sets share a class and one sketch, and n_copies counts them; null ids stay null;
a class whose ids are all null has a null id; repeated rows are members like others; an empty table gives no rows;
other columns are ignored or pass through.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bloom, Words, bloom, cut, fresh, in_arrow, mix, sift, steps, utf8
from .graph import components

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 42, 6
HASHES = BANDS * ROWS
STEP = 42
TOLERANCE = 1e-6
#: Gram sets of one side of a cell: their grams together, and their number.
CELL_GRAMS = 600_000
CELL_SETS = 2_048

_draw = np.random.default_rng(20_240_229)
_XOR = _draw.integers(0, 1 << 32, HASHES, np.uint32)
_MUL = _draw.integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)
del _draw


def gram_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Sorted distinct gram hashes of each text; empty without words."""
    for a, b in steps(offsets):
        at = offsets[a : b + 1] - offsets[a]
        words = Words(data[offsets[a] : offsets[b]], at)
        n = np.diff(words.first)
        by_width = {w: words.windows(w)[0] for w in range(1, width) if (n == w).any()}
        full = words.windows(width)[0]
        for t in range(b - a):
            p, m = words.first[t], int(n[t])
            if m >= width:
                yield np.unique(full[p : p + m - width + 1])
            else:
                yield by_width[m][p : p + 1].copy() if m else np.zeros(0, np.uint64)


def sketch(grams: np.ndarray) -> np.ndarray:
    """MinHash values, 16 bits each."""
    low = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 4096):
        x = low[None, k : k + 4096] ^ _XOR[:, None]
        x *= _MUL[:, None]
        np.minimum(out, x.min(1), out=out)
    out ^= out >> np.uint32(16)
    return out.astype(np.uint16)


def digest(grams: np.ndarray, raw: bytes = b"") -> bytes:
    """Of the grams, or for a text without words of its bytes."""
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else hashlib.blake2b(raw, digest_size=16, person=b"no words").digest()


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands, one row for each sketch; the band is part of its key."""
    out = np.zeros((len(sketches), BANDS), np.uint64)
    parts = sketches.reshape(len(sketches), BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r] + np.uint64(1))
    return mix(out + np.arange(1, BANDS + 1, dtype=np.uint64)[None, :])


def least_matches(threshold: float, hashes: int, tolerance: float) -> int:
    """Fewest matches of `hashes` values at which a pair may still reach the threshold.

    With a uniform prior the posterior of at least `threshold` after m of n matches is P(Bin(n + 1, threshold) <= m).
    """
    n, total = hashes + 1, 0.0
    for m in range(n + 1):
        total += math.comb(n, m) * threshold**m * (1 - threshold) ** (n - m)
        if total >= tolerance:
            return m
    return n


def surviving(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of a, j of b) that sizes and sketches don't rule out; i < j if both are the `same` block."""
    small, large = np.minimum(na[:, None], nb[None, :]), np.maximum(na[:, None], nb[None, :])
    live = small >= threshold * large - 1e-9
    if same:
        live &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
    if live.size > 64:
        count = np.zeros(live.shape, np.uint8)
        for h in range(STEP):
            count += a[:, None, h] == b[None, :, h]
        live &= count >= least_matches(threshold, STEP, TOLERANCE)
        i, j = np.nonzero(live)
        count = count[i, j].astype(np.int32)
    else:
        i, j = np.nonzero(live)
        count = (a[i, :STEP] == b[j, :STEP]).sum(1)
        keep = count >= least_matches(threshold, STEP, TOLERANCE)
        i, j, count = i[keep], j[keep], count[keep]
    for h in range(STEP, HASHES, STEP):
        least, kept = least_matches(threshold, h + STEP, TOLERANCE), []
        for k in range(0, len(i), 1 << 17):
            s = slice(k, k + (1 << 17))
            count[s] += (a[i[s], h : h + STEP] == b[j[s], h : h + STEP]).sum(1)
            kept.append(count[s] >= least)
        if kept:
            keep = np.concatenate(kept)
            i, j, count = i[keep], j[keep], count[keep]
    return i, j


def shared_grams(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of a[i] and b[j]."""
    if len(i) < 64:
        return np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
    ua, xa = np.unique(i, return_inverse=True)
    ub, xb = np.unique(j, return_inverse=True)
    grams = np.concatenate([*(a[x] for x in ua), *(b[y] for y in ub)])
    owner = np.repeat(np.arange(len(ua) + len(ub)), [*(len(a[x]) for x in ua), *(len(b[y]) for y in ub)])
    _, column, times = np.unique(grams, return_inverse=True, return_counts=True)
    common = np.cumsum(times > 1) - 1  # grams of one set meet nothing
    use = times[column] > 1
    column, owner, width = common[column[use]], owner[use], int((times > 1).sum())
    if len(ua) * len(ub) * width / 2e10 > len(i) * 2e-5:
        return np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(ua), len(ub)), np.float32)
    for k in range(0, width, 1024):
        p, q = np.searchsorted(column, (k, k + 1024))
        block = np.zeros((len(ua) + len(ub), 1024), np.float32)
        block[owner[p:q], column[p:q] - k] = 1
        total += block[: len(ua)] @ block[len(ua) :].T
    return total[xa, xb].astype(np.int64)


def first_shared(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, band: int) -> np.ndarray:
    """Whether pairs (i of a, j of b) of sketches share no band before `band`."""
    out = np.ones(len(i), bool)
    for k in range(0, len(i), 1 << 14):
        p = slice(k, k + (1 << 14))
        same = a[i[p], : ROWS * band] == b[j[p], : ROWS * band]
        out[p] = ~same.reshape(-1, band, ROWS).all(2).any(1)
    return out


def cell_links(a: list, b: list | None, threshold: float, band: int = -1) -> list[tuple[bytes, int, bytes]]:
    """(digest, links in the cell, least digest of its component in the cell) of the linked members.

    `a` and `b` hold (digest, sketch, grams); without `b` the pairs are those of `a`. In a cell of one band's bucket,
    pairs that share an earlier band are left to that one.
    """
    same = b is None
    b = a if same else b
    sets = a if same else [*a, *b]
    base = 0 if same else len(a)
    sk = lambda x: np.stack([np.frombuffer(r[1], np.uint16) for r in x])
    ga, gb = ([np.frombuffer(r[2], np.uint64) for r in x] for x in (a, b))
    na, nb = np.array([len(g) for g in ga]), np.array([len(g) for g in gb])
    i, j = surviving(sk(a), sk(b), na, nb, same, threshold)
    if band > 0 and len(i):
        keep = first_shared(sk(a), sk(b), i, j, band)
        i, j = i[keep], j[keep]
    if not len(i):
        return []
    both = shared_grams(ga, gb, i, j)
    keep = both >= threshold * (na[i] + nb[j] - both) - 1e-9
    i, j = i[keep], j[keep] + base
    n = np.bincount(i, minlength=len(sets)) + np.bincount(j, minlength=len(sets))
    order = sorted(range(len(sets)), key=lambda x: sets[x][0])
    root = np.empty(len(sets), np.int64)
    root[order] = np.arange(len(sets))  # the least digest has the least number
    while True:
        old = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        if (old == root).all():
            break
    return [(sets[k][0], int(n[k]), sets[order[root[k]]][0]) for k in np.flatnonzero(n)]


# ---- plans -------------------------------------------------------------------------------------------


def _text_key(text):
    return F.xxhash64(text.isNull(), F.coalesce(text, F.lit("")))


def _id_key(c):
    return F.coalesce(c.cast("string"), F.lit(""))


def sketches(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(doc_id, text_key, digest, n, sketch): one pass over the texts. Null texts have a null digest."""
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), _text_key(F.col(f"`{text_col}`")).alias("text_key"), F.col(f"`{text_col}`").alias("t"))
    schema = texts.select("doc_id", "text_key").schema.add("digest", "binary").add("n", "integer").add("sketch", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ds, ns, ss = [], [], []
            data, offsets = utf8(batch.column(2))
            for t, (g, valid) in enumerate(zip(gram_sets(data, offsets), batch.column(2).is_valid().to_pylist(), strict=True)):
                ds.append(digest(g, b"" if len(g) else data[offsets[t] : offsets[t + 1]].tobytes()) if valid else None)
                ns.append(len(g))
                ss.append(sketch(g).tobytes() if len(g) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ds, pa.binary()), pa.array(ns, pa.int32()), pa.array(ss, pa.binary())], names=schema.names)

    return in_arrow(texts, run, schema)


def _band_rows(sets: DataFrame, among: Bloom | None) -> DataFrame:
    """(key) of all bands of `sets`, or (key, band, node) of the keys that the filter has."""
    shared = sets.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                made = [np.frombuffer(x.as_py(), np.uint16) for x in part.column(1)]
                keys = band_keys(np.stack(made)).view(np.int64)
                if shared.value is None:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel())], names=["key"])
                    continue
                who, band = np.nonzero(shared.value.has(keys.ravel()).reshape(keys.shape))
                yield pa.RecordBatch.from_arrays([pa.array(keys[who, band]), pa.array(band.astype(np.int32)), part.column(0).take(pa.array(who))], names=["key", "band", "node"])

    return in_arrow(sets.where("sketch IS NOT NULL").select("node", "sketch"), run, "key bigint" if among is None else "key bigint, band int, node bigint")


def groups(sets: DataFrame) -> DataFrame:
    """(node, cell, band, blocks): the groups in which the members of `sets` (node, n, sketch) are compared.

    The group is a component of the links by buckets (band -1), or a bucket of one too large for a cell if its buckets
    have fewer pairs than it has.
    """
    twice = cut(_band_rows(sets, None).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    keys = cut(_band_rows(sets, bloom(twice)))
    # cut, so that adaptive execution can split a large bucket in the join
    buckets = cut(keys.groupBy("key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1"))
    links = cut(keys.join(buckets, "key"))
    found = cut(components(links.where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))))
    blocks = lambda grams, count: F.greatest(F.lit(1), F.ceil(grams / CELL_GRAMS), F.ceil(count / CELL_SETS)).cast("bigint")
    count, grams = F.count(F.lit(1)), F.sum("n")
    whole = cut(found.join(sets.select("node", "n"), "node").groupBy("root").agg(count.alias("m"), blocks(grams, count).alias("blocks")))
    large = found.join(whole.where("blocks > 1"), "root").select("node", "root", "m")
    inner = cut(links.join(large, "node").select("key", "band", "node", "size", "root", "m"))
    split = cut(inner.groupBy("root").agg((F.sum(F.col("size").cast("double")) < F.max(F.col("m").cast("double") * F.col("m"))).alias("split")).where("split").select("root"))
    own = inner.join(split, "root", "left_semi")
    dealt = own.join(sets.select("node", "n"), "node").groupBy("key").agg(blocks(grams, count).alias("blocks"))
    by_bucket = own.join(dealt, "key").select("node", F.col("key").alias("cell"), "band", "blocks")
    by_root = found.join(whole.join(split, "root", "left_anti"), "root").select("node", F.col("root").alias("cell"), F.lit(-1).alias("band"), "blocks")
    return by_root.unionByName(by_bucket)


def _grams(docs: DataFrame, text_col: str, id_col: str, wanted: DataFrame) -> DataFrame:
    """(digest, grams) of the texts of `wanted` (doc_id, text_key), and of a few more: no text is shuffled."""
    key = lambda i, k: F.xxhash64(_id_key(i), k).alias("key")
    among = bloom(wanted.select(key(F.col("doc_id"), F.col("text_key"))))
    texts = docs.select(key(F.col(f"`{id_col}`"), _text_key(F.col(f"`{text_col}`"))), F.col(f"`{text_col}`").alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            first = np.zeros(len(keys), bool)
            first[np.unique(keys, return_index=True)[1]] = True  # repeated rows once
            picked = batch.column(1).filter(pa.array(shared.value.has(keys) & first))
            found = [(digest(g), g.tobytes()) for g in gram_sets(*utf8(picked)) if len(g)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())], names=["digest", "grams"])

    return in_arrow(texts, run, "digest binary, grams binary").groupBy("digest").agg(F.first("grams").alias("grams"))


def _cells(members: DataFrame, threshold: float) -> DataFrame:
    """(digest, links, root) of linked members of (digest, sketch, grams, cell, band, blocks)."""
    block = F.pmod(F.xxhash64("digest"), F.col("blocks"))
    dealt = members.withColumn("block", block).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    dealt = dealt.select("cell", "band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "digest", "sketch", "grams")
    order = ["cell", "band", "lo", "hi"]
    dealt = dealt.repartition(*order).sortWithinPartitions(*order, "block", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, int, bytes]] = []

        def close(place, rows):
            _, band, lo, hi = place
            a = list({r[1]: r[1:] for r in rows if r[0] == lo}.values())
            b = list({r[1]: r[1:] for r in rows if r[0] == hi}.values()) if lo != hi else None
            if len(a) > 1 - (lo != hi) and (b is None or b):
                out.extend(cell_links(a, b, threshold, band))

        place, rows = None, []
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for cell, band, lo, hi, own, d, s, g in zip(*cols, strict=True):
                if (cell, band, lo, hi) != place:
                    if place:
                        close(place, rows)
                    place, rows = (cell, band, lo, hi), []
                rows.append((own, d, s, g))
            if len(out) > 10_000:
                yield _links(out)
                out.clear()
        if place:
            close(place, rows)
        yield _links(out)

    return in_arrow(dealt, run, "digest binary, links bigint, root binary")


def _links(rows: list) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(3)], names=["digest", "links", "root"])


def classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, class_id, n_links, n_copies, first, alone), one row per document.

    class_id is the least id of the class; n_links is the number of other gram sets at or over the threshold, n_copies
    that of other documents with the same gram set. `first` marks the document that stands for its class.
    """
    rows = cut(sketches(docs, text_col, id_col))
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    sets = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min(own).alias("own"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), (F.count(F.lit(1)) - 1).alias("n_copies"))
    # 64-bit names are enough in the candidate graph: two sets of one name only make a group larger than need be
    sets = cut(sets.withColumn("node", F.xxhash64("digest")))
    wanted = cut(groups(sets.select("node", "n", "sketch")))
    members = wanted.join(sets.select("node", "digest", "sketch", "own"), "node")
    grams = _grams(docs, text_col, id_col, cut(members.select("own.doc_id", "own.text_key").distinct()))
    links = cut(_cells(members.select("digest", "cell", "band", "blocks", "sketch").join(grams, "digest"), threshold))
    roots = components(links.select(F.col("digest").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("digest"), F.col("root").alias("class"))
    total = links.groupBy("digest").agg(F.sum("links").alias("n_links"))
    named = sets.select("digest", "own", "n_copies").join(roots, "digest", "left").join(total, "digest", "left").withColumn("class", F.coalesce("class", "digest"))
    least = named.groupBy("class").agg(F.min("own").alias("keep"))
    named = cut(named.join(least, "class").select("digest", F.col("keep.doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies", "keep"))
    out = rows.select("doc_id", "text_key", "digest").join(named, "digest", "left")
    alone, none = F.col("digest").isNull(), F.lit(0).cast("bigint")
    return out.select(
        "doc_id", "text_key", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", none).alias("n_links"), F.coalesce("n_copies", none).alias("n_copies"),
        (alone | (F.col("keep.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("keep.text_key") == F.col("text_key")))).alias("first"), alone.alias("alone"),
    )


def drop_near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with one document of each class: the one with the least id (of rows equal in id and text, one).

    Texts stay where they are: one Bloom filter has the keys of rows that may have to go, a second one those of rows
    that the first takes in though they stay, and only rows in both are shuffled to be told apart exactly.
    """
    found = classes(docs, text_col, id_col, threshold)
    h, i, k, n, a = (fresh(docs, x) for x in ("row_key", "id_key", "text_key", "copies", "alone"))
    each = found.groupBy(_id_key(F.col("doc_id")).alias(i), F.col("text_key").alias(k)).agg(F.count(F.lit(1)).alias(n), F.bool_or("first").alias("stays"), F.bool_or("alone").alias(a))
    each = cut(each.withColumn(h, F.xxhash64(i, k)))
    doubtful = bloom(each.where(~F.col(a) & (~F.col("stays") | (F.col(n) > 1))).select(h))
    stays = cut(sift(each.where("stays").select(h, i, k, n, a), h, (doubtful, True)))
    taken_in = bloom(stays.select(h))
    keyed = docs.withColumns({i: _id_key(F.col(f"`{id_col}`")), k: _text_key(F.col(f"`{text_col}`"))}).withColumn(h, F.xxhash64(i, k))
    own = [F.col(f"`{c}`") for c in docs.columns]
    sure = sift(keyed.select(*own, h), h, (doubtful, False)).select(*own)
    maybe = sift(keyed, h, (doubtful, True), (taken_in, True)).drop(h).join(stays.drop(h), [i, k])
    single = maybe.where(F.col(a) | (F.col(n) == 1)).select(*own)
    # one of the rows that are equal in id and text; summed up on the way, so that a common one is no hot key
    several = maybe.where(~F.col(a) & (F.col(n) > 1)).groupBy(i, k).agg(F.first(F.struct(*own)).alias("r")).select(*[F.col(f"r.`{c}`").alias(c) for c in docs.columns])
    return sure.unionByName(single).unionByName(several)
