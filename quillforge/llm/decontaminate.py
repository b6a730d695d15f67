"""Benchmark decontamination: a broadcast hash set of benchmark word windows, scanned over whole texts.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z. A window is `WIDTH` consecutive
words of an item; an item of fewer words, but not none, is one window. A document's word inside any occurrence
of a window is hit.

A benchmark of at most `SET_BYTES` of text becomes one hash set, whose size is so known before it is broadcast. Beyond,
the windows stay a table: a Bloom filter of bounded size picks the places of the texts that may be windows, these meet
the table by hash and words, and only texts with hits meet them again. Both give the same rows.

Edge cases: a null or empty text has no words and no hits; a null item has no windows; an item whose id is null
counts under the id "null", together with one that is so called; repeated items with one id count once; an empty
benchmark hits nothing; columns of the documents keep their names and the report's columns never meet them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, Words, bloom, cut, fresh, in_arrow, sift, steps, utf8

WIDTH = 10
#: Bytes of benchmark text up to which its windows are broadcast: a window begins at every second byte at most and takes
#: some 100 bytes, so that the set has 200 MB at most.
SET_BYTES = 4 << 20

REPORT = "struct<n_words:long,n_hit:long,items:array<string>,spans:array<struct<start:long,end:long>>,clean:string>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Windows:
    """Windows of some items by hash, with their words for an exact comparison."""

    def __init__(self, items: list[tuple[str, str]], width: int = WIDTH):
        self.items = sorted({i for i, _ in items})
        place = {x: k for k, x in enumerate(self.items)}
        by_width: dict[int, dict[int, dict[bytes, set[int]]]] = {}
        for item, text in items:
            raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            words = Words(raw, np.array([0, len(raw)]))
            n = len(words.hash)
            if not n:
                continue
            w = min(width, n)
            hashes, whole = words.windows(w)
            known = by_width.setdefault(w, {})
            for k in np.flatnonzero(whole):
                known.setdefault(int(hashes[k]), {}).setdefault(words.text(k, k + w), set()).add(place[item])
        self.by_width = {}
        for w, known in by_width.items():
            sieve = np.zeros(1 << 22, bool)
            keys = np.array(sorted(known), U64)
            sieve[(keys & U64((1 << 22) - 1)).astype(np.int64)] = True
            self.by_width[w] = (sieve, keys, known)

    def scan(self, words: Words):
        """Yield (first word, words, items) of each occurrence."""
        for w, (sieve, keys, known) in self.by_width.items():
            hashes, whole = words.windows(w)
            maybe = np.flatnonzero(sieve[(hashes & U64((1 << 22) - 1)).astype(np.int64)] & whole)
            at = np.searchsorted(keys, hashes[maybe])
            at[at == len(keys)] = 0
            for k in maybe[keys[at] == hashes[maybe]]:
                found = known[int(hashes[k])].get(words.text(k, k + w))
                if found:
                    yield int(k), w, found


def scan_batch(column, hits, clean: bool) -> list[dict]:
    """Per text what `REPORT` has. `hits(words, a, b)` yields (first word, words, items) for texts a to b."""
    data, offsets = utf8(column)
    out = []
    for a, b in steps(offsets):
        at = offsets[a : b + 1] - offsets[a]
        words = Words(data[offsets[a] : offsets[b]], at)
        cover = np.zeros(len(words.hash) + 1, np.int32)
        items: dict[int, set[str]] = {}
        for k, w, which in hits(words, a, b):
            cover[k] += 1
            cover[k + w] -= 1
            items.setdefault(int(np.searchsorted(words.first, k, side="right")) - 1, set()).update(which)
        hit = np.cumsum(cover[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(hit)])
        for t in range(b - a):
            p, q = words.first[t], words.first[t + 1]
            spans = []
            if t in items:
                edge = np.diff(np.concatenate([[0], hit[p:q].view(np.int8), [0]]))
                runs = zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)
                spans = [(int(words.starts[p + x] - at[t]), int(words.ends[p + y - 1] - at[t])) for x, y in runs]
            raw = data[offsets[a] + at[t] : offsets[a] + at[t + 1]].tobytes() if clean and spans else None
            out.append({"n_words": int(q - p), "n_hit": int(total[q] - total[p]), "items": sorted(items.get(t, ())), "spans": [{"start": x, "end": y} for x, y in spans], "clean": raw and without(raw, spans)})
    return out


def without(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without its hit spans; a blank stands where words would otherwise meet."""
    parts, last = [], 0
    for a, b in spans:
        parts.append(raw[last:a].rstrip(b" "))
        last = b
    parts.append(raw[last:])
    return b" ".join(x for x in parts if x).decode("utf-8", "replace")


def _items(bench: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"), F.col(text_col).alias("t")).where("t is not null").distinct()


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", clean: bool = True, keep: list[str] | None = None) -> DataFrame:
    """`docs` with a struct column of the name `decontamination` (underscores before it if taken).

    Its fields: n_words, n_hit, items (ids of the items with occurrences, sorted as strings), spans (hit runs as
    byte offsets of the UTF-8 text) and clean (the text without them; null where nothing was hit).
    `keep` names the columns of `docs` to return, all by default.
    """
    name, text = fresh(docs, "decontamination"), fresh(docs, "scanned")
    keep = list(docs.columns) if keep is None else keep
    whole = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(text))
    items = _items(bench, item_id, item_text)
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()["b"]
    if size > SET_BYTES:
        return _by_table(whole, items, text, clean, name)
    found = Windows([(r["i"], r["t"]) for r in items.collect()])  # `SET_BYTES` at most
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def hits(words, a, b):
        known = shared.value
        return ((k, w, [known.items[x] for x in which]) for k, w, which in known.scan(words))

    return _reported(whole, None, hits, clean, name)


def _reported(whole: DataFrame, places: str | None, hits, clean: bool, name: str) -> DataFrame:
    """`whole` (columns, the text last) with the report in place of the text.

    Without `places` `hits` finds the occurrences in the words; else a column of that name before the text has them.
    """
    n = len(whole.columns) - 1 - (places is not None)
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", _RUNS), ("clean", pa.string())])
    schema = T.StructType(whole.schema.fields[:n]).add(name, T.StructType.fromDDL(f"x {REPORT}")["x"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            find = hits
            if places is not None:
                stated = batch.column(n).to_pylist()

                def find(words, a, b, stated=stated):
                    return ((int(words.first[t - a]) + h["at"], h["w"], h["items"]) for t in range(a, b) for h in stated[t] or ())

            made = scan_batch(batch.column(batch.num_columns - 1), find, clean)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(made, kind)], names=schema.names)

    return in_arrow(whole, run, schema)


# ---- benchmarks too large for one set ----------------------------------------------------------------


def _windows(items: DataFrame) -> DataFrame:
    """(hash, words, w, item) of the windows of (i, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, texts, widths, owner = [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                words = Words(raw, np.array([0, len(raw)]))
                w = min(WIDTH, len(words.hash))
                if w:
                    found, whole = words.windows(w)
                    for x in np.flatnonzero(whole).tolist():
                        hashes.append(found[x])
                        texts.append(words.text(x, x + w))
                        widths.append(w)
                        owner.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(hashes, U64).view(np.int64)), pa.array(texts, pa.binary()), pa.array(widths, pa.int32()), batch.column(0).take(pa.array(owner, pa.int64()))], names=["hash", "words", "w", "item"])

    return in_arrow(items.select("i", "t"), run, "hash bigint, words binary, w int, item string").distinct()


def _by_table(whole: DataFrame, items: DataFrame, text: str, clean: bool, name: str) -> DataFrame:
    table = cut(_windows(items))
    own = [F.col(f"`{c}`") for c in whole.columns]
    among, widths = bloom(table.select("hash").distinct()), sorted(r["w"] for r in table.select("w").distinct().collect())
    shared = whole.sparkSession.sparkContext.broadcast(among)
    key, places, other = fresh(whole, "text_hash"), fresh(whole, "places"), fresh(whole, "text_mix")
    # what is hit depends on the text alone, so two hashes of it stand for all documents that have it
    two = (F.xxhash64(F.lit(1), F.coalesce(text, F.lit(""))), F.xxhash64(F.lit(2), F.coalesce(text, F.lit(""))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for a, b in steps(offsets):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for w in widths:
                    hashes, valid = words.windows(w)
                    at = np.flatnonzero(valid)
                    at = at[shared.value.has(hashes[at].view(np.int64))]
                    owner = np.searchsorted(words.first, at, side="right") - 1
                    take = pa.array(owner + a)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(hashes[at].view(np.int64)), pa.array([words.text(x, x + w) for x in at.tolist()], pa.binary()), pa.array(at - words.first[owner]), pa.array(np.full(len(at), w, np.int32))], names=["x", "y", "hash", "words", "at", "w"])

    seen = in_arrow(whole.select(two[0].alias("x"), two[1].alias("y"), F.col(f"`{text}`")), run, "x bigint, y bigint, hash bigint, words binary, at bigint, w int").distinct()
    # items of a window are summed up after the join, as a common window may have many
    met = seen.join(table.select("hash", "words", "item"), ["hash", "words"]).groupBy("x", "y", "at", "w").agg(F.collect_set("item").alias("items"))
    hits = cut(met.groupBy("x", "y").agg(F.collect_list(F.struct("at", "w", "items")).alias("hits")))
    keyed = whole.withColumns({key: two[0], other: two[1]})
    wanted = bloom(hits.select("x"))
    none = F.lit(None).cast(hits.schema["hits"].dataType)
    head, last = own[:-1], own[-1]
    untouched = sift(keyed, key, (wanted, False)).select(*head, none.alias(places), last)
    touched = sift(keyed, key, (wanted, True))
    touched = touched.join(hits, (touched[key] == hits["x"]) & (touched[other] == hits["y"]), "left").select(*head, F.col("hits").alias(places), last)
    return _reported(untouched.unionByName(touched), places, None, clean, name)
