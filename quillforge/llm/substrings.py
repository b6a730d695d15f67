"""Substring deduplication by content-defined chunking.

A gear rolling hash over the last 16 bytes cuts each text where it is the least of `WINDOW` places in a row. Cuts
depend on the bytes around them alone, so that insertions shift nothing, and an equal stretch of `SURE` bytes holds a
whole chunk in common wherever it stands. Variable chunks are deduplicated by a 64-bit digest over the whole corpus:
of equal ones the first by (id, place) stays. Around a chunk that repeats an earlier one the bytes are compared with
those of the first occurrence, and the stretches that are equal are joined. Those of at least `RUN_UNITS` units are
removed from the texts. A unit is a word between blanks; a word of more than 16 bytes counts as several, and in scripts
without blanks each letter is one.

Texts are chunked twice: once for the digests that occur again, once for the places of those alone. Only texts that
repeat something, or that others repeat, are shuffled.

Edge cases: null and empty texts have no chunks and come back as they are; a text of `RUN_UNITS` units or more that is
repeated whole comes back empty but for its first document, a shorter one stays; rows repeated with id and text are
treated as one document and all come back; null ids come first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _ODD, _powers, U64, bloom, cut, in_arrow, mix, sift, steps, utf8

#: Places of which one at least is a cut; a chunk has at most so many bytes, but for the first of a text.
WINDOW = 80
#: Bytes that the rolling hash looks back on.
SPAN = 16
#: Fewest bytes that a digest covers: of a shorter chunk, the bytes behind it too.
LEAST = 32
#: Equal stretches of so many bytes have a chunk in common.
SURE = SPAN - 1 + 2 * WINDOW
RUN_UNITS = 20
UNIT_BYTES = 16
#: Letters of scripts written without blanks.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")

_GEAR = np.random.default_rng(1_918_273).integers(0, 1 << 16, 256, np.uint16)
_NONE = np.uint16((1 << 16) - 1)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, of the last `SPAN` bytes."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        more = np.zeros_like(h)
        more[k:] = h[:-k] << np.uint16(k)
        h = h + more
    return h


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the joined texts are cut, apart from their ends: behind bytes with the least hash of `WINDOW` in a row."""
    n, sizes = len(data), np.diff(offsets)
    if not n:
        return np.zeros(0, np.int64)
    rank = np.minimum(gear(data), _NONE - np.uint16(1)) + np.uint16(1)  # 0 is no window
    # places of one text whose hash covers nothing of the text before
    fit = np.ones(n, bool)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, offsets[:-1], 1)
    np.add.at(edge, np.minimum(offsets[:-1] + SPAN - 1, offsets[1:]), -1)
    fit &= np.cumsum(edge[:-1]) == 0
    least = np.full(n + WINDOW, _NONE, np.uint16)
    least[:n] = np.where(fit, rank, _NONE)
    _spread(np.minimum, least, WINDOW)
    # no window begins before the first such place, or so late that it leaves the text
    edge[:] = 0
    np.add.at(edge, np.maximum(offsets[1:] - WINDOW + 1, offsets[:-1]), 1)
    np.add.at(edge, offsets[1:], -1)
    least[:n][(np.cumsum(edge[:-1]) > 0) | ~fit] = 0
    least[n:] = 0
    most = least[:n][::-1].copy()
    _spread(np.maximum, most, WINDOW)
    picked = (most[::-1] == rank) & fit
    for t in np.flatnonzero((sizes >= SPAN) & (sizes < SPAN - 1 + WINDOW)).tolist():  # one window
        a, b = offsets[t] + SPAN - 1, offsets[t + 1]
        picked[a:b] = rank[a:b] == rank[a:b].min()
    ends = offsets[1:][sizes > 0] - 1
    picked[ends] = False
    return np.flatnonzero(picked) + 1


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, digest) of the chunks of the joined texts, without the last ones of under `LEAST` bytes."""
    n = len(data)
    starts = np.sort(np.concatenate([cuts(data, offsets), offsets[:-1][np.diff(offsets) > 0]])).astype(np.int64)
    if not len(starts):
        return starts, starts, starts
    which = np.searchsorted(offsets, starts, side="right") - 1
    stop = np.minimum(np.concatenate([starts[1:], [n]]), offsets[1:][which])
    stop = np.maximum(stop, starts + LEAST)
    keep = stop <= offsets[1:][which]
    starts, which, stop = starts[keep], which[keep], stop[keep]
    powers, inverse = _powers(1 << max(12, int(n + 1).bit_length()))
    values = mix((np.arange(256).astype(U64) + U64(1)) * U64(_ODD))
    sums = np.zeros(n + 1, U64)
    np.cumsum(values[data] * powers[:n], out=sums[1:])
    digest = mix((sums[stop] - sums[starts]) * inverse[starts] + (stop - starts).astype(U64))
    return which, starts - offsets[:-1][which], digest.view(np.int64)


def _spread(of, x: np.ndarray, width: int) -> None:
    """In place: `of` of the `width` values from each on."""
    done = 1
    while done < width:
        step = min(done, width - done)
        of(x[:-step], x[step:], out=x[:-step]) if len(x) > step else None
        done += step


def thin(which: np.ndarray, at: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Chunks to keep: of equal ones in a row (periodic text) the farthest within `WINDOW` of the one before."""
    same = (np.diff(digest, prepend=0) == 0) & (np.diff(which, prepend=-1) == 0) & (np.diff(at, prepend=0) <= WINDOW)
    keep = np.ones(len(at), bool)
    if not len(at):
        return keep
    last = -1
    for k in np.flatnonzero(same[:-1] & same[1:]).tolist():  # with an equal one on both sides
        if k - 1 != last:
            kept = at[k - 1]
        if at[k + 1] - kept <= WINDOW:
            keep[k] = False
        else:
            kept = at[k]
        last = k
    return keep


def _row(doc_id, text):
    """Tells texts of one id apart: many rows may share an id, or have none, so 32 bits don't suffice."""
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")))


def digests(docs: DataFrame) -> DataFrame:
    """(digest): those of all chunks of the texts of (text), each at least once."""
    texts = docs.select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in steps(offsets):
                found = chunks(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([pa.array(found[2][thin(*found)])], names=["digest"])

    return in_arrow(texts, run, "digest bigint")


def chunk_table(docs: DataFrame, again) -> DataFrame:
    """(doc_id, row, place, digest): the chunks of the texts of (doc_id, text) that the filter `again` has; places count bytes."""
    texts = docs.select("doc_id", _row(F.col("doc_id"), F.col("text")).alias("row"), "text")
    schema = texts.select("doc_id", "row").schema.add("place", "integer").add("digest", "long")
    shared = docs.sparkSession.sparkContext.broadcast(again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for a, b in steps(offsets):
                found = chunks(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                keep = thin(*found) & shared.value.has(found[2])
                which, at, digest = (x[keep] for x in found)
                take = pa.array(which + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(at.astype(np.int32)), pa.array(digest)], names=schema.names)

    return in_arrow(texts, run, schema)


def wanted(matches: list[dict]) -> list[tuple]:
    """(first document, byte to start at, bytes, place here) of the stretches to compare with a document's own bytes.

    Chunks that are equally far from their first occurrences share a stretch; it reaches `SURE` bytes beyond them.
    """
    groups: dict[tuple, list[int]] = {}
    for m in matches:
        groups.setdefault((m["s_id"], m["s_row"], m["place"] - m["s_place"]), []).append(m["place"])
    out = []
    for (s_id, s_row, shift), places in groups.items():
        places.sort()
        first = last = places[0]
        for p in [*places[1:], None]:
            if p is None or p - last > 2 * SURE:
                start = max(0, first - SURE, shift)
                out.append((s_id, s_row, start - shift, last + WINDOW + SPAN + SURE - start, start))
                first = p
            last = p
    return out


def repeated(docs: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(i, r, parts), the stretches of first occurrences to compare each document with, and where; and (r), those documents."""
    twice = cut(digests(docs).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"))
    table = chunk_table(docs, bloom(twice))
    own = F.struct("doc_id", "row", "place")  # nulls come first in the order of structs
    # cut, so that the join has two plain exchanges and adaptive execution can split a common chunk
    first = cut(table.groupBy("digest").agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    again = table.join(first, "digest").where(own > F.col("first"))
    match = F.struct("place", F.col("first.doc_id").alias("s_id"), F.col("first.row").alias("s_row"), F.col("first.place").alias("s_place"))
    found = again.select("doc_id", "row", match.alias("match")).groupBy("doc_id", "row").agg(F.collect_set("match").alias("matches"))
    kind = docs.schema["doc_id"].dataType
    schema = found.select("doc_id", "row").schema.add("s_id", kind).add("s_row", "long").add("s_at", "integer").add("size", "integer").add("at", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                asked = wanted(batch.column(2)[k].as_py())
                own = pa.array(np.full(len(asked), k))
                columns = zip(*asked, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *[pa.array(c, t) for c, t in zip(columns, (batch.column(0).type, pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)]], names=schema.names)

    asked = cut(in_arrow(found, run, schema).withColumnsRenamed({"doc_id": "i", "row": "r"}))
    sources = sift(texts, "row", (bloom(asked.select("s_row").distinct()), True))
    # rows equal in id and text would answer each question again; cut, so that the join can split a hot source
    sources = cut(sources.groupBy("doc_id", "row").agg(F.first("text").alias("text")))
    there = sources.join(asked, sources["doc_id"].eqNullSafe(asked["s_id"]) & (sources["row"] == asked["s_row"]), "inner")
    part = F.struct("at", F.expr("substring(CAST(text AS binary), s_at + 1, size)").alias("bytes"))
    return there.select("i", "r", part.alias("part")).groupBy("i", "r").agg(F.collect_set("part").alias("parts")), asked.select("r").distinct()


def units(raw: bytes) -> int:
    """Words between blanks, longer ones once for every `UNIT_BYTES`; in scripts without blanks each letter is one."""
    return sum(1 + (len(w) - 1) // UNIT_BYTES for w in UNSPACED.sub(" x ", raw.decode("utf-8", "replace")).split())


def cut_runs(raw: bytes, parts: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
    """Byte spans that are equal to a part at its place, as far as they reach, and long enough to remove."""
    data = np.frombuffer(raw, np.uint8)
    edge = np.zeros(len(raw) + 1, np.int64)
    for at, other in parts:
        n = min(len(other), len(raw) - at)
        same = np.zeros(n + 2, np.int8)
        same[1:-1] = data[at : at + n] == np.frombuffer(other, np.uint8)[:n]
        turn = np.flatnonzero(np.diff(same))
        opens, closes = turn[::2], turn[1::2]
        long = closes - opens >= LEAST
        np.add.at(edge, at + opens[long], 1)
        np.add.at(edge, at + closes[long], -1)
    turn = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(edge) > 0, [0]]).astype(np.int8)))
    spans = []
    for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
        while a < b and 128 <= raw[a] < 192:  # whole characters only
            a += 1
        while b > a and b < len(raw) and 128 <= raw[b] < 192:
            b -= 1
        if units(raw[a:b]) >= RUN_UNITS:
            spans.append((a, b))
    return spans


def drop_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_removed, removed): the texts of (doc_id, text) without repeated runs.

    n_removed counts removed bytes; `removed` has their spans, as byte offsets of the original text.
    """
    texts = docs.select("doc_id", _row(F.col("doc_id"), F.col("text")).alias("row"), "text")
    again, touched = repeated(docs, texts)
    wanted = bloom(touched)
    spans_type = docs.sparkSession.range(0).select(F.expr("CAST(array() AS array<struct<start:bigint,stop:bigint>>)").alias("x")).schema["x"].dataType
    rest = sift(texts, "row", (wanted, False)).select("doc_id", "text", F.lit(0).cast("long").alias("n_removed"), F.array().cast(spans_type).alias("removed"))
    some = sift(texts, "row", (wanted, True))
    both = some.join(again, some["doc_id"].eqNullSafe(again["i"]) & (some["row"] == again["r"]), "left").select("doc_id", "text", "parts")
    schema = docs.select("doc_id", "text").schema.add("n_removed", "long").add("removed", spans_type)
    spans_kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone, spans = [], [], []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                found = cut_runs(raw, [(p["at"], p["bytes"]) for p in own or []])
                if found:
                    parts, last = [], 0
                    for a, b in found:
                        parts.append(raw[last:a])
                        last = b
                    text = b"".join([*parts, raw[last:]]).decode("utf-8", "replace")
                texts.append(text)
                gone.append(sum(b - a for a, b in found))
                spans.append([{"start": a, "stop": b} for a, b in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(gone, pa.int64()), pa.array(spans, spans_kind)], names=schema.names)

    return rest.unionByName(in_arrow(both, run, schema))
