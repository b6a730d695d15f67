"""Best-fit packing with bounds that certify it.

Documents are tokenised; longer ones are cut into pieces of `CAPACITY` tokens of which the first may be shorter.
Full pieces are sequences of their own. The others are dealt into partitions, each packed by best-fit decreasing;
dual feasible functions give a lower bound that certifies a partition's count of sequences. A partition that meets its
bound is settled and never touched again. Those with gaps keep their full sequences, put the documents of the others
together, and these are dealt into fewer partitions and packed again. A round that saves no sequence is undone and ends
the exchange, as does a round of one partition, or one without a gap.

Edge cases: a null text is an empty one, and an empty text is the end token alone; repeated rows and ids are packed
row by row; null ids are kept; an empty table gives no rows; columns other than the id are not returned.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, in_arrow, process_cache

CAPACITY = 1024
END_ID = 2
#: Pieces in a partition, about.
GROUP = 65_536

# ---- tokens ------------------------------------------------------------------------------------------

#: Characters up to U+024F, whose classes all libraries agree on.
_OTHER = re.compile("[^\x00-ɏ]")
_LONG_BLANK = re.compile(r"\s{4000}")
#: How byte-level BPE splits a text before it merges.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Encoder:
    """Token ids of texts as the tokenizer file at `path` has them.

    A byte-level BPE file whose ids follow its merges can be run as a table of ranks by a quicker library, with the
    same ids. Other files, and texts with special tokens, characters beyond U+024F or huge blanks, go to the
    tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.ranks = Tokenizer.from_file(path), None
        file = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in file["added_tokens"]]
        model, split = file["model"], file["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not file["normalizer"] and not model.get("ignore_merges")
        if model["type"] == "BPE" and plain:
            letters, vocab = byte_letters(), model["vocab"]
            merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
            single = [t for t in vocab if len(t) == 1 and t in letters]
            ids = [vocab.get(a + b) for a, b in merges]
            if len(single) == 256 and None not in ids and ids == sorted(ids) and max(vocab[t] for t in single) < ids[0]:
                table = {bytes(letters[c] for c in t): vocab[t] for t in [*single, *(a + b for a, b in merges)]}
                self.ranks = tiktoken.Encoding("own", pat_str=_SPLIT, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        odd = (not text.isascii() and _OTHER.search(text)) or any(t in text for t in self.special) or _LONG_BLANK.search(text)
        if self.ranks is None or odd:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _encoder(path: str) -> Encoder:
    cache = process_cache()
    if ("encoder", path) not in cache:
        cache["encoder", path] = Encoder(path)
    return cache["encoder", path]


def pieces(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document."""
    path = tokenizer or default_tokenizer()
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("t"))
    names = ["piece", "start", "length", "ids_crc32"]
    schema = T.StructType([texts.schema.fields[0], *(T.StructField(n, T.LongType()) for n in names)])
    if with_ids:
        schema.add("ids", T.ArrayType(T.LongType()))
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            owner, rows, ids = [], [], []
            for k, text in enumerate(batch.column(1)):
                raw = encode(text.as_py() or "").tobytes() + end
                n = len(raw) // 4
                at, size, piece = 0, n % CAPACITY or CAPACITY, 0
                while at < n:
                    part = raw[4 * at : 4 * (at + size)]
                    owner.append(k)
                    rows.append((piece, at, size, zlib.crc32(part)))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int64))
                    at, size, piece = at + size, CAPACITY, piece + 1
            cols = np.array(rows, np.int64).reshape(-1, 4).T
            arrays = [batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c) for c in cols)]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return in_arrow(texts, run, schema)


# ---- bins --------------------------------------------------------------------------------------------


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Sequences that pieces of the lengths in `counts` (index: length) need at least.

    The largest of the bounds by the dual feasible functions U(e) (drop lengths under e, round those over
    capacity - e up to it) alone and followed by u(k) (scale by k + 1, round down, divide by k), in exact integers.
    """
    s = np.flatnonzero(counts)
    if not len(s):
        return 0
    counts_s = counts[s].astype(np.int64)
    best = -(-int((s * counts_s).sum()) // capacity)
    for e in range(0, capacity // 2 + 1):
        x = np.where(s > capacity - e, capacity, np.where(s < e, 0, s)).astype(np.int64)
        best = max(best, -(-int((x * counts_s).sum()) // capacity))
        for k in (1, 2, 3, 4, 5, 7, 9):
            up = (k + 1) * x
            f = np.where(up % capacity == 0, x * k, up // capacity * capacity)  # k * capacity is a full sequence
            best = max(best, -(-int((f * counts_s).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and the bins' fill. Lengths are taken in descending order, ties in theirs."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have
    mask = 0
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        m = mask >> size
        if m:
            room = size + (m & -m).bit_length() - 1
            b = open_[room].pop()
            if not open_[room]:
                mask ^= 1 << room
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        room -= size
        if room:
            open_[room].append(b)
            mask |= 1 << room
    return bins, offsets, np.array(fill, np.int64)


_PACKED = "group bigint, bin bigint, offset bigint, full boolean, bins bigint, bound bigint"


def _pack_groups(items: DataFrame, groups: int) -> DataFrame:
    """Items with their partition, bin, offset, whether the bin is full, and the partition's count and bound."""
    schema = T.StructType([*items.schema.fields, *T.StructType.fromDDL(_PACKED).fields])
    own = [f.name for f in items.schema.fields]
    dealt = items.withColumn("group", F.pmod(F.xxhash64("uid"), F.lit(groups)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", kind="stable", ignore_index=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets, fill = best_fit_decreasing(lengths)
        out = pdf[own].copy()
        out["group"], out["bin"], out["offset"], out["full"] = pdf["group"], bins, offsets, fill[bins] == CAPACITY
        out["bins"], out["bound"] = len(fill), lower_bound(np.bincount(lengths, minlength=CAPACITY + 1))
        return out

    return dealt.groupBy("group").applyInPandas(run, schema)


def pack(items: DataFrame) -> DataFrame:
    """The pieces (any columns, with `length` from 1 to `CAPACITY`) with `sequence_id` and `offset`."""
    own = list(items.columns)
    # only a piece's number and length go through the rounds; the other columns meet the result once
    items = cut(items.withColumn(uid := fresh(items, "uid"), F.monotonically_increasing_id()))
    full = F.col("length") == CAPACITY
    rest = items.where(~full).select(F.col(uid).alias("uid"), F.col("length").cast("long").alias("length"))
    left, round_, settled, earlier = rest.count(), 0, [], None
    while left:
        groups = max(1, math.ceil(left / GROUP))
        packed = cut(_pack_groups(rest, groups).withColumn("round", F.lit(round_)))
        bins = packed.groupBy("group").agg(F.max("bins").alias("bins")).agg(F.sum("bins").alias("n")).first()["n"]
        if earlier is not None and bins >= earlier[1]:
            settled.append(earlier[0])  # nothing saved: the sequences that were given up stay
            break
        certified = F.col("bins") <= F.col("bound")
        gives = ~certified & ~F.col("full")
        given = packed.where(gives)
        left, count = given.count(), given.select("group", "bin").distinct().count()
        if groups == 1 or not left:
            settled.append(packed)
            break
        settled.append(packed.where(~gives))
        rest, earlier, round_ = given.select("uid", "length"), (given, count), round_ + 1
    sequence = (F.col("round") * F.lit(1 << 56) + F.col("group") * F.lit(1 << 20) + F.col("bin")).alias("sequence_id")
    out = items.where(full).select(*[F.col(f"`{c}`") for c in own], (-F.col(uid) - 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    if settled:
        places = reduce(DataFrame.union, [x.select(F.col("uid").alias("placed"), sequence, "offset") for x in settled])
        met = items.where(~full).join(places, items[uid] == places["placed"])
        out = out.union(met.select(*[F.col(f"`{c}`") for c in own], "sequence_id", "offset"))
    return out


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the real sequences, of pieces made with ids. A sequence has `CAPACITY` ids at most."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
