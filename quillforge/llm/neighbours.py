"""Nearest neighbours by a block matrix join.

Vectors are packed into tiles that hold int8 codes (a scale per vector), norms and the norm of each quantisation
error. Query tiles and candidate tiles meet in cells of bounded size. In a cell the product of the int8 tiles gives
every squared distance with an error bound (Cauchy-Schwarz on the quantisation errors); pairs whose lower bound
exceeds the k-th upper bound go, the others are computed in double precision on the original vectors. Each cell keeps
a sorted heap of k per query, and the heaps of a query are merged in bounded steps. The result is exact.

Edge cases: rows with a null id and vectors that are null, empty, zero or hold null or non-finite components take
no part; a query meets only vectors of its own dimension and never a row with its own id; rows repeated with id and
vector count once; ties go to the smaller id; distances whose squares leave the range of doubles are infinite, or zero,
and tie; a query without candidates has no rows; with an empty table there are none. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_arrow

#: Most vectors of a tile, and most bytes of its vectors in double precision.
TILE_ROWS = 2_048
TILE_BYTES = 8 << 20
#: Vectors of one side of a cell, about.
CELL_QUERIES = 2_048
CELL_CANDIDATES = 8_192
#: Heaps merged at a time.
FAN_IN = 64

TILE = "tile bigint, dim int, n int, ids binary, vecs binary, codes binary, scale binary, norm binary, error binary"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms and upper bounds of the error's norm, row by row.

    Rows are brought to a largest component between 1/2 and 1 by a power of two, so that no square leaves the range.
    """
    x = x.astype(np.float64, copy=False)
    power = np.frexp(np.abs(x).max(1))[1]
    y = np.ldexp(x, -power[:, None])
    scale = np.abs(y).max(1) / 127
    codes = np.rint(y / scale[:, None]).astype(np.int8)
    error = np.sqrt(((y - codes * scale[:, None]) ** 2).sum(1)) * (1 + 1e-9)
    back = lambda v: np.ldexp(v, power)
    return codes, back(scale), back(np.sqrt((y * y).sum(1))), back(error)


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the valid rows, one pair for each dimension."""
    keep = pc.and_(pc.is_valid(batch.column(0)), pc.is_valid(batch.column(1)))
    ids, lists = batch.column(0).filter(keep), batch.column(1).filter(keep)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        own = pa.array(sizes == dim)
        x = lists.filter(own).flatten().to_numpy(zero_copy_only=False)
        x = (x if x.dtype == np.float32 else x.astype(np.float64)).reshape(-1, dim)
        good = np.isfinite(x).all(1) & (x != 0).any(1)
        yield ids.filter(own).to_numpy(zero_copy_only=False).astype(np.int64)[good], x[good]


def tiles(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Tiles of the distinct (id, vector) rows; each task packs its rows, dimension by dimension."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vec_col}`").alias("v"))
    # before the tiles, as the k-th upper bound of `nearest` must be that of k different rows
    rows = rows.where("id IS NOT NULL AND v IS NOT NULL").distinct()

    def tile(ids: np.ndarray, x: np.ndarray) -> dict:
        codes, *rest = quantise(x)
        return {"dim": x.shape[1], "n": len(x), "ids": ids.tobytes(), "vecs": x.tobytes(), "codes": codes.tobytes(), **{k: v.tobytes() for k, v in zip(("scale", "norm", "error"), rest, strict=True)}}

    kinds = pa.schema([("dim", pa.int32()), ("n", pa.int32()), *((k, pa.binary()) for k in ("ids", "vecs", "codes", "scale", "norm", "error"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for ids, x in _vectors(batch):
                part = held.setdefault(x.shape[1], [[], [], 0])
                part[0].append(ids)
                part[1].append(x)
                part[2] += len(x)
                most = max(1, min(TILE_ROWS, TILE_BYTES // (8 * x.shape[1])))
                if part[2] >= most:
                    ids, x = np.concatenate(part[0]), np.concatenate(part[1])
                    cuts = len(x) // most * most
                    for k in range(0, cuts, most):
                        yield pa.RecordBatch.from_pylist([tile(ids[k : k + most], x[k : k + most])], kinds)
                    part[:] = [ids[cuts:]], [x[cuts:]], len(x) - cuts
        for ids, x, n in held.values():
            if n:
                yield pa.RecordBatch.from_pylist([tile(np.concatenate(ids), np.concatenate(x))], kinds)

    made = in_arrow(rows, run, TILE.split(", ", 1)[1])
    return made.select(F.monotonically_increasing_id().alias("tile"), "*")


class Tile:
    def __init__(self, row):
        self.dim, n = int(row.dim), int(row.n)
        self.ids = np.frombuffer(row.ids, np.int64)
        # single precision travels as it is and is widened here
        self.x = np.frombuffer(row.vecs, np.float32 if len(row.vecs) == 4 * n * self.dim else np.float64).reshape(n, self.dim).astype(np.float64, copy=False)
        self.codes = np.frombuffer(row.codes, np.int8).reshape(n, self.dim)
        self.scale, self.norm, self.error = (np.frombuffer(b, np.float64) for b in (row.scale, row.norm, row.error))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 tiles: single precision holds sums of 1,024 terms exactly."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], 1024):
        out += a[:, k : k + 1024].astype(np.float32) @ b[:, k : k + 1024].astype(np.float32).T
    return out


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, terms added in order."""
    with np.errstate(over="ignore", under="ignore"):  # beyond the range a distance is infinite
        d = (x - q).T
        return np.sqrt(np.cumsum(d * d, axis=0)[-1])  # a plain sum would add in an order that depends on the number of rows


def nearest(q: Tile, c: Tile, k: int, heaps: list[list[tuple[float, int]]]) -> None:
    """Merge the candidates of tile `c` into the sorted heaps of the queries of tile `q`."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        dot = products(q.codes, c.codes) * q.scale[:, None] * c.scale[None, :]
        slack = q.norm[:, None] * c.error[None, :] + q.error[:, None] * (c.norm + c.error)[None, :]
        square = (q.norm**2)[:, None] + (c.norm**2)[None, :]
        slack = 2 * slack + 1e-9 * square + 1e-300  # squares that underflow lose less than that
        mid = square - 2 * dot
        upper, lower = mid + slack, mid - slack
    wild = ~(np.isfinite(upper) & np.isfinite(lower))  # no bound: such pairs are recomputed
    own = q.ids[:, None] == c.ids[None, :]
    upper[own | wild] = np.inf
    lower[wild] = -np.inf
    bound = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] >= k else np.full(len(upper), np.inf)
    for i in range(len(q.ids)):
        heap = heaps[i]
        most = min(bound[i], heap[-1][0] * heap[-1][0] * (1 + 1e-12) + 1e-300 if len(heap) == k else np.inf)
        live = np.flatnonzero((lower[i] <= most) & ~own[i])
        if not len(live):
            continue
        d, ids = distances(c.x[live], q.x[i]), c.ids[live]
        best = np.lexsort((ids, d))[:k]
        heaps[i] = list(islice(heapq.merge(heap, zip(d[best].tolist(), ids[best].tolist(), strict=True)), k))


FOUND = "query_id bigint, query_key bigint, part bigint, found array<struct<score:double,vec_id:bigint>>"


def nearest_neighbours(queries: DataFrame, candidates: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for each row of `queries` its `k` nearest rows of `candidates`."""
    qt, ct = cut(tiles(queries, id_col, vec_col)), cut(tiles(candidates, id_col, vec_col))
    many = lambda t, per: max(1, math.ceil((t.agg(F.sum("n")).first()[0] or 0) / per))
    nq, nc = many(qt, CELL_QUERIES), many(ct, CELL_CANDIDATES)
    group = lambda n: F.pmod(F.xxhash64("tile"), F.lit(n))
    qs = qt.withColumn("qg", group(nq)).withColumn("cg", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nc - 1).cast("bigint"))))
    cs = ct.withColumn("cg", group(nc)).withColumn("qg", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nq - 1).cast("bigint"))))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        others = [Tile(r) for r in right.itertuples(index=False)]
        for row in left.itertuples(index=False):
            q = Tile(row)
            heaps: list[list[tuple[float, int]]] = [[] for _ in q.ids]
            for c in others:
                if c.dim == q.dim:
                    nearest(q, c, k, heaps)
            for i, heap in enumerate(heaps):
                if heap:
                    key = int.from_bytes(hashlib.blake2b(q.x[i].tobytes(), digest_size=8).digest(), "little", signed=True)
                    out.append((int(q.ids[i]), key, int(row.cg), [{"score": d, "vec_id": v} for d, v in heap]))
        return pd.DataFrame(out, columns=["query_id", "query_key", "part", "found"])

    found = qs.groupBy("qg", "cg").cogroup(cs.groupBy("qg", "cg")).applyInPandas(cell, FOUND)
    while True:
        nc = math.ceil(nc / FAN_IN)
        parts = found.groupBy("query_id", "query_key", F.floor(F.col("part") / FAN_IN).alias("part"))
        merged = F.array_sort(F.flatten(F.collect_list("found")))
        found = parts.agg(F.slice(merged, 1, k).alias("found"))
        if nc == 1:
            break
    return found.select("query_id", F.posexplode("found").alias("at", "f")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))
