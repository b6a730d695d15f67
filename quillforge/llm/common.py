"""What the operators share: checkpoints, table reads, Arrow text access and a byte-level tokeniser."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20

U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Only where it is unset and everything runs in one process (tests) a temporary one is taken; a cluster must name one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Run `df` once and keep its rows in the shared checkpoint folder, without lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Written:
    """Tables in the shared folder, for rounds of work: each is read with its true size, and all go at the end.

    A checkpoint keeps the estimates of the plan that it cuts. Over rounds of joins they multiply, until planning takes
    longer than the work; and a small table is never seen to be small.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.top = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}"
        self.names, self.made = [], 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.names.append(f"{self.top}/{self.made}")
        self.made += 1
        df.write.parquet(self.names[-1])
        return self.spark.read.schema(df.schema).parquet(self.names[-1])

    def drop(self, keep: int = 0) -> None:
        """Remove all tables but the last `keep`; only call it when nothing reads them any more."""
        for path in [self.names.pop(0) for _ in range(len(self.names) - keep)]:
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of an Arrow batch between Spark and Python, where the session names no other limit.
BATCH_BYTES = 8 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """`df.mapInArrow`, with batches bounded by bytes: bounded by rows alone they grow with the texts.

    Workers outlive their tasks, so each task gives back what it has freed.
    """
    conf = df.sparkSession.conf
    if conf.get(_LIMIT, None) is None:
        conf.set(_LIMIT, str(BATCH_BYTES))

    def tidy(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(tidy, schema)


def give_back() -> None:
    """Return memory that this process has freed, but holds, to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of one C library; others have no such call
    if trim:
        trim(0)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or with underscores before it as long as `df` has a column so called (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def sha_list(kind: str, column):
    return F.sha2(column.cast("binary"), 256).alias(kind)


# ---- texts of an Arrow column, as bytes ---------------------------------------------------------


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of an Arrow string column, without a copy; null is empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES):
    """Ranges (a, b) of texts with about `limit` bytes together, at least one text each."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


# ---- words ---------------------------------------------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words after lower-casing A-Z: digits, a-z, and all of any character beyond ASCII.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True


def process_cache() -> dict:
    """A dictionary of this process. Functions travel by value, so a global one would travel along."""
    return sys.__dict__.setdefault("_quillforge_cache", {})


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    cache = process_cache()
    if (known := cache.get("powers")) and len(known[0]) >= n:
        return known
    base = 0x5851F42D4C957F2D
    inverse = pow(base, -1, 1 << 64)
    out = []
    for x in (base, inverse):
        p = np.full(n, x, U64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U64))
    if n <= 4 * STEP_BYTES:
        cache["powers"] = (out[0], out[1])
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


# ---- Bloom filters ---------------------------------------------------------------------------------

#: Bits of a filter: 16 a key, but never more than this (16 MB); a fuller one lets more keys pass, and none is lost.
BLOOM_BITS = 1 << 27


class Bloom:
    """A set of 64-bit keys that may also say yes to others. Its words are few enough to broadcast."""

    def __init__(self, bits: int, words: np.ndarray | None = None):
        self.bits, self.words = bits, np.zeros(bits // 64, U64) if words is None else words

    def _places(self, keys: np.ndarray):
        h = mix(keys.astype(np.int64).view(U64) + U64(_ODD))
        for _ in range(3):
            yield h & U64(self.bits - 1)
            h = mix(h + U64(_ODD))

    def marks(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, bits) that the keys set, each word once."""
        at = np.sort(np.concatenate(list(self._places(keys))))
        word = (at >> U64(6)).astype(np.int64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        return word[first], np.bitwise_or.reduceat(U64(1) << (at & U64(63)), first) if len(at) else np.zeros(0, U64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self._places(keys):
            out &= (self.words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) != 0
        return out


def bloom(keys: DataFrame) -> Bloom:
    """A filter of the bigint keys in the one column of `keys`; built on the executors, at most `BLOOM_BITS` come back."""
    import pyarrow as pa

    n = keys.count()
    empty = Bloom(max(1 << 13, min(BLOOM_BITS, 1 << (16 * n).bit_length())))
    bits = empty.bits

    def run(batches):
        shape = Bloom.__new__(Bloom)
        shape.bits = bits
        for batch in batches:
            word, marks = shape.marks(batch.column(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(marks.view(np.int64))], names=["word", "marks"])

    found = in_arrow(keys, run, "word bigint, marks bigint").groupBy("word").agg(F.bit_or("marks").alias("marks")).toArrow()
    empty.words[found.column("word").to_numpy()] = found.column("marks").to_numpy().view(U64)
    return empty


def sift(df: DataFrame, key: str, *tests: tuple[Bloom, bool]) -> DataFrame:
    """The rows of `df` whose bigint `key` each filter has or, as it says, hasn't; all in one pass."""
    shared = df.sparkSession.sparkContext.broadcast(tests)
    at = df.columns.index(key)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys = batch.column(at).to_numpy(zero_copy_only=False)
            keep = np.ones(len(keys), bool)
            for wanted, inside in shared.value:
                keep &= wanted.has(keys) == inside
            yield batch.filter(pa.array(keep))

    return in_arrow(df, run, df.schema)


class Words:
    """Words of several texts: places in the joined bytes, 64-bit hashes, first word of each text.

    `table` tells the bytes of words; `like` is another split of the same texts, whose sums are used again.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD_BYTE, like: Words | None = None):
        self.low = low = LOWER[data] if like is None else like.low
        n = len(low)
        inside = table[low]
        opens, closes = inside.copy(), inside.copy()
        if n:
            opens[1:] &= ~inside[:-1]
            closes[:-1] &= ~inside[1:]
            # the end of a text ends a word
            firsts = offsets[:-1][offsets[:-1] < n]
            opens[firsts] = inside[firsts]
            lasts = offsets[1:][offsets[1:] > 0] - 1
            closes[lasts] = inside[lasts]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, offsets)  # n + 1 entries
        if like is None:
            size = 1 << max(12, int(n + 1).bit_length())
            powers, self.inverse = _powers(size)
            self.sums = np.zeros(n + 1, U64)
            terms = low.astype(U64)  # in place: these are the largest arrays of a step
            terms += U64(1)
            terms *= powers[:n]
            np.cumsum(terms, out=self.sums[1:])
        else:
            self.sums, self.inverse = like.sums, like.inverse
        self.hash = mix((self.sums[self.ends] - self.sums[self.starts]) * self.inverse[self.starts])

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the `width` words from each word on, and whether all of them are of one text."""
        m = len(self.hash)
        if m < width:
            return np.zeros(m, U64), np.zeros(m, bool)
        total = np.zeros(m, U64)
        factor = 1
        for k in range(width):
            total[: m - width + 1] += self.hash[k : m - width + 1 + k] * U64(factor)
            factor = factor * _ODD % (1 << 64)
        last = np.repeat(self.first[1:], np.diff(self.first))  # where each word's text ends
        return mix(total), np.arange(m) + width <= last

    def text(self, a: int, b: int) -> bytes:
        """Words a to b, lower-cased, joined by blanks."""
        return b" ".join(self.low[self.starts[k] : self.ends[k]].tobytes() for k in range(a, b))
