"""Counts of words, and of words in a row: each text is counted where it is read, and only counts leave it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.batches import in_arrow

_WORD = re.compile(r"\w+")
#: Words that are counted together before their counts are handed on (with all of the last text).
TOGETHER = 1 << 20


class _Numbers(dict):
    """Numbers of words, from 0, in the order in which they are met."""

    def __missing__(self, w: str) -> int:
        self[w] = n = len(self)
        return n


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(words, numbers, places): different words, and for each word of some texts its number and its place from 1.

    Behind each text is an empty word, so that the words of two texts never stand in a row.
    """
    known, parts, size = _Numbers(), [], 0
    for batch in batches:
        for text in batch.column(0):
            found = _WORD.findall(text.as_py() or "")
            found.append("")
            parts.append(np.fromiter(map(known.__getitem__, found), np.int64, len(found)))
            size += len(found)
            if size >= TOGETHER:
                yield list(known), np.concatenate(parts), np.concatenate([np.arange(1, len(p) + 1) for p in parts])
                known, parts, size = _Numbers(), [], 0
    if parts:
        yield list(known), np.concatenate(parts), np.concatenate([np.arange(1, len(p) + 1) for p in parts])


def _counted(docs: DataFrame, text_col: str, ddl: str, columns: Callable) -> DataFrame:
    """(<ddl>, n): `columns` makes those, and the counts, of texts counted together."""
    schema = T.StructType.fromDDL(f"{ddl}, n bigint")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in _numbered(batches):
            made = [pa.array(c, f.type) if isinstance(c, (list, np.ndarray)) else c for c, f in zip(columns(*given), arrow, strict=True)]
            whole = pa.RecordBatch.from_arrays(made, schema=arrow)
            yield from (whole.slice(at, 1 << 16) for at in range(0, whole.num_rows, 1 << 16))

    each = in_arrow(docs.select(F.col(text_col)), run, schema)
    return each.groupBy(*schema.names[:-1]).agg(F.sum("n").alias("n"))


def words_by_place(docs: DataFrame, every: int, text_col: str = "text") -> DataFrame:
    """(w, at, n): how often each word occurs at places that leave `at` when divided by `every`; places are from 1."""

    def columns(words, numbers, places):
        codes, n = np.unique(numbers * every + places % every, return_counts=True)
        there = np.array([w != "" for w in words])[codes // every]
        codes = codes[there]
        return pa.array(words, pa.string()).take(pa.array(codes // every)), (codes % every).astype(np.int32), n[there]

    return _counted(docs, text_col, "w string, at int", columns)


@cache
def _signs() -> np.ndarray:
    """For each code point: 1 for a-z, 2 for the other signs of words, 0 for what stands between words."""
    kinds = np.zeros(0x110000, np.uint8)
    for m in _WORD.finditer("".join(map(chr, range(0x110000)))):
        kinds[m.start() : m.end()] = 2
    kinds[ord("a") : ord("z") + 1] = 1
    return kinds


def _kinds(data: np.ndarray) -> np.ndarray:
    """The `_signs` of UTF-8 text, byte by byte: each byte of a longer sign has that sign's kind."""
    signs = _signs()
    kinds = signs[:256].copy()
    kinds[128:] = 0
    kinds = kinds[data]
    lead = np.flatnonzero(data >= 0xC0)
    first = data[lead].astype(np.int32)
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    code, last = first & (0x7F >> size), len(data) - 1
    for k in (1, 2, 3):
        there = size > k
        code[there] = code[there] << 6 | data[np.minimum(lead[there] + k, last)] & 0x3F
    kind = signs.take(code, mode="clip")
    for k in range(4):
        there = size > k
        kinds[np.minimum(lead[there] + k, last)] = kind[there]
    return kinds


def _lower_runs(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of a-z alone in some texts, one after the other, and for each whether it stands right behind the last one.

    Words are found in the bytes of all texts at once, and numbered by Arrow: nothing is done word by word.
    """
    texts = texts.cast(pa.string()).fill_null("")
    _, offsets, held = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(held, np.uint8)[bounds[0] : bounds[-1]] if held is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    if not len(data):
        return pa.array([], pa.string()).dictionary_encode(), np.zeros(0, bool)
    kinds = _kinds(data)
    # a text's first byte follows nothing, and its last one is followed by nothing
    begins, ends = kinds > 0, kinds > 0
    joined = begins[1:] & begins[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(data))] - 1
    joined[inner] = False
    begins[1:] &= ~joined
    ends[:-1] &= ~joined
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    others = np.zeros(len(data) + 1, np.int32)
    np.cumsum(kinds == 2, out=others[1:])
    fine = others[stops] == others[starts]
    after = np.zeros(len(starts), bool)
    after[1:] = fine[:-1]
    opens = np.searchsorted(starts, bounds[:-1])
    after[opens[opens < len(starts)]] = False
    starts, stops, after = starts[fine], stops[fine], after[fine]
    cuts = np.stack([starts, stops], axis=1).ravel().astype(np.int32)
    runs = pa.StringArray.from_buffers(max(0, len(cuts) - 1), pa.py_buffer(cuts if len(cuts) else np.zeros(1, np.int32)), pa.py_buffer(data))
    return runs.take(pa.array(np.arange(0, len(runs), 2))).dictionary_encode(), after


#: Bytes of the files read for each part in which counts are added up, and how many parts there are at most.
PART_BYTES, PARTS = 4 << 20, 1 << 13
_PARTS = "part int, words binary, lengths binary, counts binary"
_WEIGHTS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def _parts(docs: DataFrame) -> int:
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(PARTS, size // PART_BYTES + 8)


def _raw(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, bytes) of strings that begin with their buffers."""
    _, offsets, data = words.buffers()
    return np.frombuffer(offsets, np.int32)[: len(words) + 1] if offsets else np.zeros(1, np.int32), np.frombuffer(data or b"", np.uint8)


def _hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words with a letter at least."""
    bounds, data = _raw(words)
    if not len(words):
        return np.zeros(0, np.uint64)
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], np.diff(bounds))
    return np.add.reduceat(data[: bounds[-1]] * _WEIGHTS[place & 63], bounds[:-1])


def _dealt(words: pa.Array, counts: np.ndarray, hashes: np.ndarray, parts: int, schema: pa.Schema) -> pa.RecordBatch:
    """Words and their counts as a row for each part: what is shuffled is not a row for each word."""
    part = ((hashes ^ hashes >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)) % np.uint64(parts)
    order = np.argsort(part.astype(np.uint16), kind="stable")
    bounds, data = _raw(words.take(pa.array(order)))
    rows = np.concatenate([[0], np.cumsum(np.bincount(part.astype(np.int64), minlength=parts))])
    blobs = lambda values, at: pa.BinaryArray.from_buffers(pa.binary(), parts, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(values)])
    columns = [blobs(data, bounds[rows]), blobs(np.diff(bounds), rows * 4), blobs(counts[order].astype(np.int64), rows * 8)]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), *columns], schema=schema).filter(pa.array(np.diff(rows) > 0))


def _added(held: list[tuple]) -> tuple[pa.Array, pa.Array]:
    """The words of some rows of a part, each once, and the sums of their counts."""
    data, lengths, counts = (b"".join(x) for x in zip(*held, strict=True))
    bounds = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, np.int32))]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data))
    made = pa.table({"w": words, "n": np.frombuffer(counts, np.int64)}).group_by("w", use_threads=False).aggregate([("n", "sum")]).combine_chunks()
    return tuple(pa.concat_arrays(made.column(c).chunks) for c in ("w", "n_sum"))


def lower_counts(docs: DataFrame, text_col: str = "text", words: bool = True, pairs: bool = True, least: int = 1) -> DataFrame:
    """(w, n): how often each word of a-z alone occurs, and each two in a row, whatever is between them, with a blank there.

    Texts are read once for both. Two in a row are left out if they occur less than `least` times. Counts travel packed by
    parts, of which there are as many as the files' size asks for, and are added up part by part.
    """
    docs = docs.select(F.col(text_col))
    parts, packed, schema = _parts(docs), T.StructType.fromDDL(_PARTS), T.StructType.fromDDL("w string, n bigint")
    packed_arrow, arrow = to_arrow_schema(packed), to_arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, after = _lower_runs(batch.column(0))
            known, numbers = runs.dictionary, runs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            hashes = _hashes(known)
            if words and len(known):
                yield _dealt(known, np.bincount(numbers, minlength=len(known)), hashes, parts, packed_arrow)
            second = np.flatnonzero(after)
            if pairs and len(second):
                codes, n = np.unique(numbers[second - 1] * len(known) + numbers[second], return_counts=True)
                left, right = codes // len(known), codes % len(known)
                both = pc.binary_join_element_wise(known.take(pa.array(left)), known.take(pa.array(right)), " ")
                yield _dealt(both, n, hashes[left] * np.uint64(0x94D049BB133111EB) + hashes[right], parts, packed_arrow)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for _, held in groupby(rows, lambda r: r[0]):
            w, n = _added([r[1:] for r in held])
            if least > 1:
                kept = pc.or_(pc.greater_equal(n, least), pc.invert(pc.match_substring(w, " ")))
                w, n = w.filter(kept), n.filter(kept)
            whole = pa.RecordBatch.from_arrays([w, n], schema=arrow)
            yield from (whole.slice(at, 1 << 16) for at in range(0, whole.num_rows, 1 << 16))

    dealt = in_arrow(docs, count, packed).repartition("part").sortWithinPartitions("part")
    return in_arrow(dealt, add, schema)


def lower_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(w, n): how often each word of a-z alone occurs."""
    return lower_counts(docs, text_col, pairs=False)


def lower_pairs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(pair, n): how often two words of a-z alone stand in a row, whatever is between them; a blank is put there."""
    return lower_counts(docs, text_col, words=False).withColumnRenamed("w", "pair")
