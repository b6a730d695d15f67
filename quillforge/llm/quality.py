"""Quality classifier by Bradley-Terry pairwise ranking.

A text is described by surface features (how it is written: lengths, repeats, symbols, lines) and by lexical ones: the
shares of its words in `WORD_BUCKETS` hashed buckets and of its runs of four bytes in `GRAM_BUCKETS`. Preference pairs
(a document labelled good, one labelled bad) teach one linear score by logistic loss on feature differences; the
threshold is the quantile of the training scores at the share of bad labels, and the score returned is a logistic of
the distance from it, so that 0.5 is the threshold.

The fit uses at most `SAMPLE` labelled rows, one a document id, and `PAIRS` rivals for each. Documents are scored from
their whole texts on the executors by sums over arrays, without a Python step for each word.

Edge cases: null and empty texts have all features zero and so a fixed score; without labelled rows every score is
0.5, and with labels of one kind only every document gets that label; repeated rows are scored alike; a document's other columns pass through under their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, fresh, in_arrow, steps, utf8
from .labels import labelled

#: Labelled rows used for the fit.
SAMPLE = 20_000
#: Rivals of the other label drawn for each labelled row.
PAIRS = 8
WORD_BUCKETS, GRAM_BUCKETS = 4_096, 512
#: Weight of the lexical shares beside the surface features, which have unit variance.
LEXICAL = 10.0
#: Bytes of text of one step; a step takes some 100 bytes of memory for each.
STEP = 1 << 19

SURFACE = ("words", "distinct", "repeats", "upper", "symbols", "bangs", "bars", "symbol_ends", "letters", "digits", "mean_length", "sentence_ends", "line_repeats", "short_lines", "top_word", "long_words")
_UPPER, _LOWER, _DIGIT, _SYMBOL, _BANG, _BAR, _LEAD, _LATER, _BLANK, _OTHER = range(10)
_KIND = np.full(256, _OTHER, np.int64)
for _kind, _bytes in ((_UPPER, range(65, 91)), (_LOWER, range(97, 123)), (_DIGIT, range(48, 58)), (_SYMBOL, b"*#%&$^~<>{}\\=_+"), (_BANG, b"!"), (_BAR, b"|"), (_LATER, range(128, 192)), (_LEAD, range(192, 256)), (_BLANK, b"\t\n\v\f\r\x1c\x1d\x1e\x1f ")):
    _KIND[list(_bytes)] = _kind
_IN_TOKEN = _KIND != _BLANK
_IN_LINE = np.arange(256) != 10
_SYMBOL_END, _SENTENCE_END = (np.isin(np.arange(256), list(x)) for x in (b"*#%&$!|", b".?!"))


def _distinct(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different words each text has, and how often its most frequent one occurs."""
    owner = np.repeat(np.arange(n), np.diff(words.first))
    shift = np.uint64(64 - max(1, int(n).bit_length()))
    keys, counts = np.unique((owner.astype(np.uint64) << shift) | (words.hash & ((np.uint64(1) << shift) - np.uint64(1))), return_counts=True)
    owner = (keys >> shift).astype(np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner, counts)
    return np.bincount(owner, minlength=n), most


def _share(part, of):
    return np.divide(part, of, out=np.zeros(len(of)), where=of > 0)


def surface(data: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
    """The surface features of each text, one row a text, each between 0 and about 1."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    owner = np.repeat(np.arange(n), sizes)
    place = owner * 10
    place += _KIND[data]
    kinds = np.bincount(place, minlength=10 * n).reshape(n, 10).astype(float)
    del place
    tokens = Words(data, offsets, _IN_TOKEN, words)
    lines = Words(data, offsets, _IN_LINE, words)
    count, rows = (np.diff(x.first).astype(float) for x in (tokens, lines))
    total = lambda of, mask: np.bincount(np.repeat(np.arange(n), np.diff(of.first))[mask], minlength=n)
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) if len(data) else []
    upper = kinds[:, _UPPER] + np.bincount(owner[capital], minlength=n)
    alpha = kinds[:, _UPPER] + kinds[:, _LOWER] + kinds[:, _LEAD]
    chars = sizes - kinds[:, _LATER]
    letters = chars - kinds[:, _BLANK]
    again = np.zeros(len(tokens.hash), bool)
    again[1:] = tokens.hash[1:] == tokens.hash[:-1]
    again[tokens.first[:-1][tokens.first[:-1] < len(again)]] = False
    last = data[tokens.ends - 1] if len(tokens.ends) else np.zeros(0, np.uint8)
    different, most = _distinct(tokens, n)
    out = np.stack([
        np.minimum(1.0, np.log1p(count) / 8),
        _share(different, count),
        _share(total(tokens, again), count),
        _share(upper, np.maximum(alpha, 1)),
        np.minimum(1.0, 5 * _share(kinds[:, _SYMBOL], letters)),
        np.minimum(1.0, _share(kinds[:, _BANG], count)),
        np.minimum(1.0, _share(kinds[:, _BAR], count)),
        _share(total(tokens, _SYMBOL_END[last]), count),
        _share(np.maximum(alpha, 1), chars),
        np.minimum(1.0, 5 * _share(kinds[:, _DIGIT], letters)),
        np.minimum(1.0, _share(letters, count) / 12),
        np.minimum(1.0, 10 * _share(total(tokens, _SENTENCE_END[last]), count)),
        np.where(rows > 0, 1 - _share(_distinct(lines, n)[0], rows), 0.0),
        _share(total(lines, lines.ends - lines.starts < 40), rows),
        np.where(count >= 20, _share(most, count), 0.0),
        _share(total(tokens, tokens.ends - tokens.starts > 25), count),
    ], axis=1)
    out[count == 0] = 0.0
    return out


def word_buckets(words: Words) -> np.ndarray:
    return (words.hash >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS


def gram_buckets(low: np.ndarray) -> np.ndarray:
    """Buckets of the four bytes from each on; the last three places have none."""
    if len(low) < 4:
        return np.zeros(0, np.int64)
    b = low.astype(np.uint32)
    x = (b[:-3] | (b[1:-2] << np.uint32(8)) | (b[2:-1] << np.uint32(16)) | (b[3:] << np.uint32(24))) * np.uint32(0x9E3779B1)
    return ((x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(16)).astype(np.int64) % GRAM_BUCKETS


def _spans(offsets: np.ndarray, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of four bytes of each text begin and end."""
    stop = np.maximum(np.minimum(offsets[1:] - 3, whole), 0)
    return np.minimum(offsets[:-1], stop), stop


class Model:
    """Weights of the three kinds of features, and the threshold; `scale` turns distances into scores."""

    def __init__(self, weights: np.ndarray, words: np.ndarray, grams: np.ndarray, threshold: float, scale: float):
        self.weights, self.words, self.grams, self.threshold, self.scale = weights, words, grams, threshold, scale

    def raw(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The linear score of each text."""
        out = np.zeros(len(offsets) - 1)
        for a, b in steps(offsets, STEP):
            at, part = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
            words = Words(part, at)
            total = surface(part, at, words) @ self.weights
            for weights, buckets, first, stop in ((self.words, word_buckets(words), words.first[:-1], words.first[1:]), (self.grams, found := gram_buckets(words.low), *_spans(at, len(found)))):
                sums = np.zeros(len(buckets) + 1)
                np.cumsum(weights[buckets], out=sums[1:])
                total += LEXICAL * _share(sums[stop] - sums[first], (stop - first).astype(float))
            out[a:b] = total
        return out

    def score(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip((self.threshold - raw) / self.scale, -700, 700)))


def neutral() -> Model:
    return Model(np.zeros(len(SURFACE)), np.zeros(WORD_BUCKETS), np.zeros(GRAM_BUCKETS), 0.0, 1.0)


class Rows:
    """Labelled rows as a matrix: surface features, shares of words (sparse) and of grams."""

    def __init__(self, table: pa.Table):
        n = len(table)
        wide = lambda name, kind, size: np.frombuffer(b"".join(x.as_py() for x in table.column(name)), kind).reshape(n, size)
        self.surface = wide("surface", np.float64, len(SURFACE))
        self.grams = wide("grams", np.float16, GRAM_BUCKETS).astype(np.float32)
        sizes = [len(x.as_py()) // 2 for x in table.column("buckets")]
        self.bucket = np.frombuffer(b"".join(x.as_py() for x in table.column("buckets")), np.uint16)
        self.share = np.frombuffer(b"".join(x.as_py() for x in table.column("shares")), np.float32)
        self.owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
        self.label = table.column("_label").to_numpy()
        self.spread = np.maximum(self.surface.std(0), 1e-6)
        self.scaled = (self.surface - self.surface.mean(0)) / self.spread

    def _parts(self):
        """The sparse part in pieces, so that what is made of them on the way stays small."""
        for k in range(0, len(self.share), 1 << 19):
            p = slice(k, k + (1 << 19))
            yield self.owner[p].astype(np.int64), self.bucket[p].astype(np.int64), self.share[p]

    def times(self, w: np.ndarray) -> np.ndarray:
        s, g = len(SURFACE), len(SURFACE) + WORD_BUCKETS
        words = np.zeros(len(self.label))
        for owner, bucket, share in self._parts():
            words += np.bincount(owner, share * w[s:g][bucket], len(words))
        return self.scaled @ w[:s] + LEXICAL * (words + self.grams @ w[g:].astype(np.float32))

    def back(self, r: np.ndarray) -> np.ndarray:
        words = np.zeros(WORD_BUCKETS)
        for owner, bucket, share in self._parts():
            words += np.bincount(bucket, share * r[owner], WORD_BUCKETS)
        return np.concatenate([self.scaled.T @ r, LEXICAL * words, LEXICAL * (r.astype(np.float32) @ self.grams)])

    @property
    def size(self) -> int:
        return len(SURFACE) + WORD_BUCKETS + GRAM_BUCKETS


def bradley_terry(rows, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 7, rounds: int = 80) -> np.ndarray:
    """Weights from pairs of a good and a bad row: Nesterov's method on the logistic loss of score differences.

    `rows` multiplies by weights (`times`) and its transpose by values of rows (`back`); differences are never made.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return np.zeros(rows.size)
    draw = np.random.default_rng(seed)
    a = np.concatenate([np.repeat(good, pairs), draw.choice(good, len(bad) * pairs)])
    b = np.concatenate([draw.choice(bad, len(good) * pairs), np.repeat(bad, pairs)])
    pull = lambda c: rows.back(np.bincount(a, c, len(y)) - np.bincount(b, c, len(y))) / len(a)
    top = draw.normal(size=rows.size)
    for _ in range(12):  # the step follows from the largest eigenvalue
        top /= np.linalg.norm(top)
        s = rows.times(top)
        top = pull(s[a] - s[b])
    step = 1 / (0.25 * 1.3 * float(np.linalg.norm(top)) + ridge)
    w = v = np.zeros(rows.size)
    for k in range(rounds):
        s = rows.times(v)
        new = v - step * (pull(-1 / (1 + np.exp(np.clip(s[a] - s[b], -30, 30)))) + ridge * v)
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


def _described(rows: DataFrame) -> DataFrame:
    """(_label, surface, buckets, shares, grams) of (_label, _text), packed as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            made: list[list[bytes]] = [[], [], [], []]
            for a, b in steps(offsets, STEP):
                at, part = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
                words = Words(part, at)
                buckets, grams, rows = word_buckets(words), gram_buckets(words.low), surface(part, at, words)
                first, stop = _spans(at, len(grams))
                for t in range(b - a):
                    own, times = np.unique(buckets[words.first[t] : words.first[t + 1]], return_counts=True)
                    four = np.bincount(grams[first[t] : stop[t]], minlength=GRAM_BUCKETS) / max(1, stop[t] - first[t])
                    for into, x in zip(made, (rows[t], own.astype(np.uint16), (times / max(1, times.sum())).astype(np.float32), four.astype(np.float16)), strict=True):
                        into.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.binary()) for x in made]], names=["_label", "surface", "buckets", "shares", "grams"])

    return in_arrow(rows.select("_label", "_text"), run, "_label int, surface binary, buckets binary, shares binary, grams binary")


def fit(docs: DataFrame, picked: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> Model:
    """Learn from the documents whose (_id, _label) are in `picked`, a sample of proven bound."""
    table = _described(labelled(docs, picked, text_col, id_col).orderBy("_id")).toArrow()
    if not len(table):
        return neutral()
    rows = Rows(table)
    del table
    w = bradley_terry(rows, rows.label)
    s, g = len(SURFACE), len(SURFACE) + WORD_BUCKETS
    scores = np.sort(rows.times(w) + float(rows.surface.mean(0) @ (w[:s] / rows.spread)))
    k = int((rows.label == 0).sum())
    if not 0 < k < len(scores):
        return Model(w[:s] / rows.spread, w[s:g], w[g:], float(scores[0] - 1 if k == 0 else scores[-1] + 1), 1.0)
    return Model(w[:s] / rows.spread, w[s:g], w[g:], float((scores[k - 1] + scores[k]) / 2), float(max(scores.std() / 4, 1e-6)))


def classify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, as_name: str = "quality_score") -> tuple[DataFrame, str]:
    """`docs` with a score column; its name (underscores before it if taken) is returned too."""
    score, text = fresh(docs, as_name), fresh(docs, "scanned")
    keep = list(docs.columns) if keep is None else keep
    whole = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(text))
    schema = T.StructType(whole.schema.fields[:-1]).add(score, T.DoubleType())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            n = batch.num_columns - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(model.score(model.raw(*utf8(batch.column(n)))))], names=schema.names)

    return in_arrow(whole, run, schema), score
