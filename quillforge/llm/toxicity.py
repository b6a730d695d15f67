"""Toxicity with noisy-channel deobfuscation.

A character 4-gram model is counted over all documents. Tokens that look disguised (digits or signs among
letters, letters repeated three times or more, single letters set apart by blanks, dots, hyphens or stars) become
lattices: each character may be itself, a letter it often stands for, or nothing, and a separator may end a word.
Viterbi decoding under the character model, over all states, picks the likeliest words, and a linear model scores the
set of restored words of a text and of their beginnings (the words that `restore_text` puts into the text).

The linear model learns from at most `SAMPLE` labelled rows, one a document id: word features are counted by label on
the executors, and those that tell something (likelihood ratio of `LEAST_RATIO`, `LEAST_DOCS` documents) are weighted by
logistic regression. There is no limit on their number but that of the sample's words.

Edge cases: long runs of letters and digits that look like digests or keys are taken as they are; null and empty texts have no words and get the score of the bias alone; without labels of both
kinds every score is the share of toxic labels (0 if none); repeated rows are scored alike; other columns pass
through under their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, fresh, in_arrow, steps, utf8
from .labels import labelled

SAMPLE = 20_000
#: Documents that must have a feature before it is considered.
LEAST_DOCS = 8
#: Log-likelihood ratio below which a feature tells nothing.
LEAST_RATIO = 15.0
#: Tokens whose features a worker remembers.
REMEMBERED = 400_000
#: Characters from which a token is decoded by arrays of states; the result is the same.
LONG = 64

# ---- the character model ---------------------------------------------------------------------------

#: Classes of bytes: 0 ends words, 1-26 are letters, 27 is any part of a character beyond ASCII.
SIZE = 28
_CLASS = np.zeros(256, np.int32)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[128:192] = -1  # a character's later bytes
_CLASS[192:] = 27
_CLASS = _CLASS[LOWER]


def count_grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of the class 4-grams of the texts; a text's end ends a word."""
    out = np.zeros(SIZE**4, np.int64)
    for a, b in steps(offsets):
        at = (offsets[a : b + 1] - offsets[a]).astype(np.int64)
        c = _CLASS[np.insert(data[offsets[a] : offsets[b]], at, 32)]
        c = c[c >= 0]
        c = c[(c > 0) | np.concatenate([[True], c[:-1] > 0])]  # one end between words
        p = np.concatenate([[0, 0], c, [0]])
        # the history starts anew in each word
        h3 = np.where(p[1:-2] > 0, p[:-3], 0)
        out += np.bincount(((h3 * SIZE + p[1:-2]) * SIZE + p[2:-1]) * SIZE + p[3:], minlength=SIZE**4) if len(p) > 3 else 0
    return out


class CharModel:
    """Log probabilities of a class after three others, interpolated with shorter histories."""

    def __init__(self, counts: np.ndarray):
        c4 = counts.reshape((SIZE,) * 4).astype(np.float64)
        c3, c2, c1 = c4.sum(0), c4.sum((0, 1)), c4.sum((0, 1, 2))
        p = (c1 + 1) / (c1.sum() + SIZE)
        for c in (c2, c3, c4):
            n = c.sum(-1, keepdims=True)
            kinds = (c > 0).sum(-1, keepdims=True) + 1.0
            p = (c + kinds * p) / (n + kinds)  # Witten-Bell
        self.log = np.log(p).astype(np.float32)


def char_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n) over all documents: one pass, and at most SIZE**4 sums from each task."""
    texts = docs.select(F.col(f"`{text_col}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**4, np.int64)
        for batch in batches:
            total += count_grams(*utf8(batch.column(0)))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["gram", "n"])

    return in_arrow(texts, run, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def char_model(docs: DataFrame, text_col: str = "text") -> CharModel:
    rows = char_counts(docs, text_col).toPandas()
    counts = np.zeros(SIZE**4, np.int64)
    counts[rows["gram"].to_numpy()] = rows["n"].to_numpy()
    return CharModel(counts)


# ---- the channel -------------------------------------------------------------------------------------

#: Letters that signs and digits stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l",
    "*": "aeiou", "#": "aeiou", "%": "aeiou",
}
COST_STANDS = 0.7
COST_ANY = 1.5
COST_DROP_SIGN = 1.0
COST_DROP_REPEAT = 0.2
COST_KEEP_REPEAT = 1.2
SIGNS = ".-_*'~ "
#: Signs that may also end a word.
ENDS = " .-_*"

_MIXED = re.compile(r"[^\W\d_][0-9@$!|+(<€£*#%._'~-]+[^\W\d_]|^[0-9@$!|+(<€£]+[^\W\d_]|[^\W\d_][0-9@$|+]+$")
_REPEATED = re.compile(r"([^\W\d_])\1\1")
_STRIP = ".,;:!?\"'()[]{}<>*#%&$|~=/\\-_+"
#: Single characters set apart; they and what is between them are disjoint, so no text makes the search branch.
SPACED = re.compile(r"(?<![^\s(\[{<\"'“‘„«])[^\s.\-_*](?:[ .\-_*]{1,2}[^\s.\-_*]){3,}(?![^\s.,!?;:)\]}>\"'”’“»])")


def code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27


def options(token: str) -> list[list[tuple[str, float]]]:
    """For each character the letters ("" for none, " " for a word's end) it may be, with their costs."""
    out = []
    for c, run in groupby(token):
        n = len(list(run))
        if c.isalpha():
            again = [(c, COST_KEEP_REPEAT), ("", COST_DROP_REPEAT)] if n > 2 else [(c, 0.0), ("", COST_STANDS)]
            out += [[(c, 0.0)], *[again] * (n - 1)]
            continue
        some = [(x, COST_STANDS if len(STANDS_FOR[c]) <= 2 else COST_ANY) for x in STANDS_FOR.get(c, "")]
        if c in SIGNS or not some:
            some.append(("", 0.0 if c == " " else COST_DROP_SIGN))
        if c in ENDS:
            some.append((" ", 1.0 if c == " " else COST_DROP_SIGN + 1.0))  # as much as nothing
        out += [some] * n
    return out


def decode(token: str, model: CharModel) -> str:
    """The likeliest words of a disguised token in lower case, with blanks between them."""
    return (decode_long if len(token) >= LONG else decode_short)(token, model)


def decode_short(token: str, model: CharModel) -> str:
    log = model.log
    states: dict[tuple, tuple] = {(0, 0, 0): (0.0, None)}  # at most SIZE**3; the letters as a chain
    for some in options(token):
        grown: dict[tuple, tuple] = {}
        for (a, b, c), (cost, chain) in states.items():
            for letter, extra in some:
                if letter == "":
                    state, total, out = (a, b, c), cost + (extra + 1.0), chain
                elif letter == " " and not c:
                    continue  # one end between words
                else:
                    d = 0 if letter == " " else code(letter)
                    # the history starts anew in each word, as it is counted
                    state, total, out = (b if c else 0, c, d), cost + extra - float(log[a, b, c, d]), (chain, letter)
                if state not in grown or total < grown[state][0]:
                    grown[state] = (total, out)
        states = grown
    ends = ((cost - (float(log[a, b, c, 0]) if c else 0.0), chain) for (a, b, c), (cost, chain) in states.items())
    chain, letters = min(ends, key=lambda x: x[0], default=(0, None))[1], []
    while chain:
        chain, letter = chain
        letters.append(letter)
    return "".join(reversed(letters)).strip()


def decode_long(token: str, model: CharModel) -> str:
    """`decode_short` with the states of a character in arrays, and what led to each kept for the way back."""
    flat = model.log.reshape(-1).astype(np.float64)
    state, cost = np.zeros(1, np.int64), np.zeros(1)  # a, b, c in base SIZE
    back = []
    for some in options(token):
        c, to, total, origin, which = state % SIZE, [], [], [], []
        for k, (letter, extra) in enumerate(some):
            if letter == "":
                use, new, sum_ = np.arange(len(state)), state, cost + (extra + 1.0)
            else:
                d = 0 if letter == " " else code(letter)
                use = np.flatnonzero(c) if letter == " " else np.arange(len(state))
                history = np.where(c[use] > 0, state[use] % SIZE**2, 0) * SIZE  # b and c, or nothing
                new, sum_ = history + d, cost[use] + extra - flat[state[use] * SIZE + d]
            to.append(new)
            total.append(sum_)
            origin.append(use)
            which.append(np.full(len(use), k, np.int8))
        to, total, origin, which = (np.concatenate(x) for x in (to, total, origin, which))
        order = np.lexsort((which, origin, total, to))
        first = order[np.flatnonzero(np.diff(to[order], prepend=-1))]
        state, cost = to[first], total[first]
        back.append((origin[first].astype(np.int16 if len(c) < 1 << 15 else np.int32), which[first], some))
    if not len(state):
        return ""
    at = int(np.argmin(cost - np.where(state % SIZE > 0, flat[state * SIZE], 0.0)))
    letters = []
    for origin, which, some in reversed(back):
        letters.append(some[which[at]][0])
        at = int(origin[at])
    return "".join(reversed(letters)).strip()


#: Hexadecimal digests, and long tokens of which most are digits.
_DIGEST = re.compile(r"\A(?=.{0,64}[0-9])[0-9a-f]{16,}\Z")


def disguised(token: str) -> bool:
    """Whether a token looks disguised: two letters at least, no digest, no number with a few letters."""
    if not (_MIXED.search(token) or _REPEATED.search(token)):
        return False
    letters = sum(map(str.isalpha, token))
    if letters < 2 or _DIGEST.match(token):
        return False
    return len(token) < 24 or sum(map(str.isdigit, token)) <= letters


def restore(token: str, model: CharModel) -> str:
    """A token without the signs around it, decoded if it looks disguised."""
    if disguised(token):
        core = token.strip(".,;:?\"'()[]{}<>~=/\\")
        return decode(core, model) if any(c.isalpha() for c in core) else core
    return token.strip(_STRIP)


def tokens_of(text: str) -> set[str]:
    """Distinct lower-case tokens; letters set apart count as one token as well."""
    low = text.lower()
    found = set(low.split())
    for m in SPACED.finditer(low):
        if sum(c.isalpha() for c in m[0]) >= 3:
            found.add(m[0])
    return found


def restore_text(text: str | None, model: CharModel) -> str | None:
    """The whole text in lower case with disguised tokens restored; null stays null."""
    if text is None:
        return None
    low = SPACED.sub(lambda m: decode(m[0], model) if sum(c.isalpha() for c in m[0]) >= 3 else m[0], text.lower())
    return re.sub(r"\S+", lambda m: restore(m[0], model) if disguised(m[0]) else m[0], low)


# ---- the linear model --------------------------------------------------------------------------------


def word_features(word: str) -> list[str]:
    """The word and its beginnings of three to six letters."""
    if len(word) < 2:
        return []
    return [word, *(f"{word[:k]}^" for k in (3, 4, 5, 6) if len(word) > k)]


class Reader:
    """Features of a text, with a bounded memory of tokens seen."""

    def __init__(self, model: CharModel, places: dict[str, int] | None = None):
        self.model, self.places, self.seen = model, places, {}

    def __call__(self, text: str | None) -> set:
        found: set = set()
        for t in tokens_of(text) if text else ():
            f = self.seen.get(t)
            if f is None:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                word = decode(t, self.model) if " " in t else restore(t, self.model)
                f = [x for w in word.split() for x in word_features(w)]
                if self.places is not None:
                    f = [self.places[x] for x in f if x in self.places]
                self.seen[t] = f
            if f:
                found.update(f)
        return found


class Model:
    def __init__(self, chars: CharModel, features: list[str], weights: np.ndarray, bias: float):
        self.chars, self.features, self.weights, self.bias = chars, features, weights, bias


def telling(rows: DataFrame, chars: CharModel) -> tuple[list[str], int, int]:
    """The telling features of (_label, _text), a bounded sample, and how many rows have either label."""
    shared = rows.sparkSession.sparkContext.broadcast(chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(shared.value)
        for batch in batches:
            seen: tuple[Counter, Counter] = Counter(), Counter()
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen[label][""] += 1
                seen[label].update(read(text.as_py()))
            for label, found in enumerate(seen):
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array([label * n for n in found.values()], pa.int64()), pa.array(found.values(), pa.int64())], names=["f", "n1", "n"])

    counts = in_arrow(rows.select((F.col("_label") != 0).cast("int"), "_text"), run, "f string, n1 bigint, n bigint").groupBy("f").agg(F.sum("n1").alias("n1"), F.sum("n").alias("n"))
    total = counts.where("f = ''").first()
    if total is None:
        return [], 0, 0
    n1, n0 = int(total["n1"]), int(total["n"] - total["n1"])
    if not n0 or not n1:
        return [], n0, n1
    a, n = F.col("n1").cast("double"), F.col("n").cast("double")
    share = n1 / (n0 + n1)
    part = lambda x, of: F.when(x > 0, x * F.log(x / of)).otherwise(0.0)
    ratio = 2 * (part(a, n * share) + part(n - a, n * (1 - share)) + part(n1 - a, (n0 + n1 - n) * share) + part(n0 - n + a, (n0 + n1 - n) * (1 - share)))
    best = counts.where((F.col("f") != "") & (F.col("n") >= LEAST_DOCS) & (F.col("n") < n0 + n1)).withColumn("r", ratio).where(F.col("r") >= LEAST_RATIO)
    return [r["f"] for r in best.orderBy("f").select("f").collect()], n0, n1


def logistic(rows: list[list[int]], y: np.ndarray, size: int, ridge: float = 0.2, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights and bias on sets of features, by Nesterov's method on the ridge-penalised loss."""
    who = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    what = np.array([x for r in rows for x in r], np.int64)
    top = np.ones(size)  # the step follows from the largest eigenvalue
    for _ in range(20):
        top = np.bincount(what, np.bincount(who, top[what], len(rows))[who], size)
        largest = float(np.linalg.norm(top))
        top /= max(largest, 1e-9)
    w, b = np.zeros(size), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    v, vb, step = w.copy(), b, 4.0 / (1.2 * largest + len(y) + ridge)
    for k in range(rounds):
        z = np.bincount(who, v[what], len(rows)) + vb
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        nw = v - step * (np.bincount(what, g[who], size) + ridge * v)
        nb = vb - step * g.sum()
        v, vb = nw + k / (k + 3) * (nw - w), nb + k / (k + 3) * (nb - b)
        w, b = nw, nb
    return w, b


def fit(docs: DataFrame, picked: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> Model:
    """Count the character model over all of `docs` and learn from those in `picked`, a sample of proven bound."""
    chars = char_model(docs, text_col)
    rows = labelled(docs, picked, text_col, id_col)
    names, n0, n1 = telling(rows, chars)
    if not names:
        share = n1 / (n0 + n1) if n0 + n1 else 0.0
        return Model(chars, [], np.zeros(0), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    shared = docs.sparkSession.sparkContext.broadcast((chars, {f: k for k, f in enumerate(names)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(read(x.as_py())) for x in batch.column(1)], pa.list_(pa.int32()))], names=["y", "f"])

    found = in_arrow(rows.select("_label", "_text"), run, "y int, f array<int>").toPandas()
    w, b = logistic([list(x) for x in found["f"]], found["y"].to_numpy().astype(float), len(names))
    return Model(chars, names, w, b)


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, restored: bool = True) -> tuple[DataFrame, str]:
    """`docs` with a struct column (score, restored text if wanted); its name is returned too."""
    name, text = fresh(docs, "toxicity"), fresh(docs, "scanned")
    keep = list(docs.columns) if keep is None else keep
    whole = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(text))
    schema = T.StructType(whole.schema.fields[:-1]).add(name, T.StructType.fromDDL("x struct<score:double,restored:string>")["x"].dataType)
    shared = docs.sparkSession.sparkContext.broadcast((model.chars, {f: k for k, f in enumerate(model.features)}, model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars, places, weights, bias = shared.value
        read = Reader(chars, places)
        for batch in batches:
            n = batch.num_columns - 1
            made = []
            for x in batch.column(n):
                x = x.as_py()
                f = sorted(read(x))
                z = bias + float(weights[f].sum())
                made.append({"score": float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), "restored": restore_text(x, chars) if restored else None})
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(made, pa.struct([("score", pa.float64()), ("restored", pa.string())]))], names=schema.names)

    return in_arrow(whole, run, schema), name
