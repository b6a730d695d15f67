import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from shared import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillforge.llm import decontaminate, packing, private, quality, queries, substrings, toxicity
from quillforge.llm.common import Words, steps, utf8

ODD = st.text(alphabet="aAbZz09 .\n-é日🙂ß_@+", max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(ODD, max_size=6))
def test_words_equal_the_pattern(texts):
    data, offsets = utf8(pa.array(texts, pa.string()))
    words = Words(data, offsets)
    for t, text in enumerate(texts):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        want = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        a, b = words.first[t], words.first[t + 1]
        assert [words.text(k, k + 1).decode() for k in range(a, b)] == want
    by_word = {}
    for k in range(len(words.hash)):
        assert by_word.setdefault(words.text(k, k + 1), words.hash[k]) == words.hash[k]
    assert len(set(by_word.values())) == len(by_word)


def test_steps_cover_all():
    offsets = np.array([0, 5, 5, 100, 101, 102])
    assert [x for a, b in steps(offsets, 10) for x in range(a, b)] == list(range(5))


# ---- decontamination ---------------------------------------------------------------------------------


def test_large_benchmarks_take_the_other_way(spark, monkeypatch):
    """Beyond the bound of the broadcast set windows are joined; the rows are the same, with null and repeated texts too."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").union(spark.createDataFrame([(-5, "one"), (-6, "Two words"), (None, "one"), (-7, None), (-8, "")], "item_id long, text string"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "just one"), (-3, "two WORDS, one"), (None, "two words")], "doc_id long, text string"))
    rows = lambda: sorted(map(str, decontaminate.decontaminate(docs, bench, keep=["doc_id"]).collect()))
    one = rows()
    monkeypatch.setattr(decontaminate, "SET_BYTES", 2000)
    assert one == rows() and "'null'" in str(one)


def test_hit_words_go(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs = spark.createDataFrame([(1, f"Before {item.upper()}, after."), (2, item), (3, "alpha beta gamma"), (4, "two words here")], "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (9, "Two words")], "item_id long, text string")
    got = {r["doc_id"]: r["decontamination"] for r in decontaminate.decontaminate(docs, bench).collect()}
    assert (got[1]["n_words"], got[1]["n_hit"], got[1]["items"], got[1]["clean"]) == (13, 11, ["10"], "Before , after.")
    assert (got[2]["n_hit"], got[2]["clean"]) == (11, "")
    assert (got[3]["n_hit"], got[3]["clean"], got[4]["items"]) == (0, None, ["9"])


# ---- personal data -----------------------------------------------------------------------------------

BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(d[::-1])) % 10 == 0


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            rule = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]  # noqa: B023
            if rule():
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def check_base(text):
    anchors = private.automaton()
    got = private.report(text, anchors, False)
    want = base_spans(text)
    assert got[4] == hashlib.sha256(want.encode()).hexdigest(), (text, got[5], want)
    assert set(want.split(",")) - {""} <= set(got[5].split(","))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="0123456789 .-+()@ab%_é", max_size=60))
def test_base_spans_equal_the_patterns(text):
    check_base(text)


@pytest.mark.parametrize("text", ["a@b.c@d.e", "@b.c x@y", "a@b..c", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256", "0001.002.03.4", "4111-1111 1111 1111 4111111111111111", "+49 (30) 123.45-67+1 234567890", "x@y.z+1@w.v", "1" * 50, "é@b.c", "a@b.c-"])
def test_base_spans_of_hard_cases(text):
    check_base(text)


def test_added_kinds_and_masks():
    anchors = private.automaton()
    text = "IBAN DE89 3704 0044 0532 0130 00 and https://joe:pw@host/x, account no. 12345678; accounting 123456789"
    kinds = [s.split(":")[0] for s in private.joined(private.spans_of(text, anchors)).split(",")]
    assert kinds == ["iban", "url", "account"]
    assert private.mask("call +49 30 1234567!", private.spans_of("call +49 30 1234567!", anchors)) == "call <PHONE>!"
    assert "iban" not in private.joined(private.spans_of("IBAN DE89 3704 0044 0532 0130 01", anchors))


def test_secrets_cues_and_runs_of_schemes():
    anchors = private.automaton()
    found = lambda text: private.joined(private.spans_of(text, anchors))
    text = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and Api_Key: abcd1234 but Tokens = 5, tokenizer: whitespace, a token is lost'
    assert found(text) == "secret:9:49,secret:64:72"
    assert found("AcCoUnT nO. 12345678 İ iban DE89 3704 0044 0532 0130 00").startswith("account:12:20,iban:28:")
    assert found("see MailTo:joe@x") == "url:4:16" and found("mailto:mailto:a@b") == "url:0:17" and found("mailto:@b mailto: a@b") == ""
    slow = r"mailto:[^\s@\"'<>]+@[^\s\"'<>]+"
    rng = np.random.default_rng(6)
    for _ in range(300):
        text = "".join(rng.choice(["mailto:", "a", "@", " ", "x.y", "<"], 12))
        want = [f"url:{m.start()}:{m.end()}" for m in re.finditer(slow, text)]
        assert [s for s in found(text).split(",") if s.startswith("url")] == want, text


def test_a_megabyte_of_anchors_takes_no_time():
    import time

    anchors = private.automaton()
    for unit in ("mailto:", "http://", "http://a", "a@", "+1", "iban ", "token=", "token=a/", "secret: ", "account no ", "1.", "DE89", "@@", "a.", "1 "):
        began = time.perf_counter()
        private.report(unit * (1_000_000 // len(unit)), anchors, True)
        assert time.perf_counter() - began < 6, unit


def test_whole_table_by_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op7_private(spark, SF).collect():
        assert r["base_sha256"] == hashlib.sha256(base_spans(docs[r["doc_id"]]).encode()).hexdigest()


# ---- classifiers -------------------------------------------------------------------------------------


@pytest.mark.parametrize(("name", "label", "least"), [("op6_toxicity", "toxic", 0.95), ("op9_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    folder = "/root/testdata/sf0.1"
    found = queries.QUERIES[name](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out")
    share = found.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
    assert share >= least


def test_disguised_words_are_restored(spark):
    texts = ["you are an idiot and a loser", "the moron said trash", "such a pathetic clown", "stupid disgusting scum", "a worthless thing"] * 20
    model = toxicity.CharModel(toxicity.count_grams(*utf8(pa.array(texts))))
    for word, want in {"1d10t": "idiot", "i d i o t": "idiot", "m-o-r-o-n": "moron", "stuuuupid": "stupid", "p4th3t1c": "pathetic", "cl*wn": "clown", "l0s3r": "loser"}.items():
        assert toxicity.decode(word, model) == want
    assert toxicity.restore_text("An 1D10T, plain words stay.", model) == "an idiot plain words stay."
    assert "idiot" in toxicity.restore_text("what an i d i o t!", model)
    assert toxicity.restore_text(None, model) is None


def test_spaced_words_are_told_from_their_neighbours():
    texts = ["you are a stupid idiot and a loser", "the moron said you are stupid", "i am such a pathetic clown", "stupid disgusting scum", "a worthless thing"] * 20
    model = toxicity.CharModel(toxicity.count_grams(*utf8(pa.array(texts))))
    read = toxicity.Reader(model)
    for text in ("a s t u p i d", "y o u a r e s t u p i d", "(s t u p i d)", 'he said "s t u p i d".', "y-o-u a-r-e s-t-u-p-i-d", "y o u a r e " * 12 + "s t u p i d"):
        assert "stupid" in read(text) and "stupid" in re.findall("[a-z]+", toxicity.restore_text(text, model)), text
    assert toxicity.decode("y o u a r e a s t u p i d", model) == "you are a stupid"
    for k in range(60):  # wherever a long token was cut
        assert "stupid" in toxicity.decode("a " * k + "s t u p i d", model).split()


def test_decoding_is_exact():
    """Both forms of the search against every reading of a token, and against each other on long tokens."""
    from itertools import product

    rng = np.random.default_rng(5)
    model = toxicity.CharModel(rng.integers(0, 40, toxicity.SIZE**4) ** 3)
    log = model.log

    def cost(letters):
        total, (a, b, c) = 0.0, (0, 0, 0)
        for letter, extra in letters:
            if letter == "":
                total += extra + 1.0
                continue
            if letter == " " and not c:
                return np.inf
            d = 0 if letter == " " else toxicity.code(letter)
            total += extra - float(log[a, b, c, d])
            a, b, c = (b if c else 0), c, d
        return total - (float(log[a, b, c, 0]) if c else 0.0)

    for _ in range(150):
        token = "".join(rng.choice(list("ab1@*%#.-o0$ é"), int(rng.integers(1, 5))))
        read = min(product(*toxicity.options(token)), key=cost)
        for decode in (toxicity.decode_short, toxicity.decode_long):
            assert decode(token, model) == "".join(x for x, _ in read).strip(), token
    for _ in range(40):
        token = "".join(rng.choice(list("abcd1@*%#.-o0$ é"), 90))
        assert toxicity.decode_short(token, model) == toxicity.decode_long(token, model)


def test_digests_are_no_disguise():
    for token in ("3f786850e387550fdab836ed7e6dc881de23001b", "a$$$", "1st"[:2], "0123456789012345678901234a5b"):
        assert not toxicity.disguised(token), token
    for token in ("1d10t", "l0s3r", "stuuuupid", "m-o-r-o-n", "cl*wn"):
        assert toxicity.disguised(token), token


def test_toxicity_scores_by_brute_force(spark):
    """The scores are those of a model written out again: features of the restored text, weights of the fit."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    picked = queries.sample(labels, "toxic", F.lit(True), 1000)
    model = toxicity.fit(docs, picked)
    out, name = toxicity.score_toxicity(docs, model)
    weight = dict(zip(model.features, model.weights, strict=True))
    for r in out.collect():
        words = re.findall(r"\S+", r[name]["restored"])
        found = {f for w in words for x in [w.strip(toxicity._STRIP) if not toxicity.disguised(w) else w] for f in toxicity.word_features(x)}
        z = model.bias + sum(weight.get(f, 0.0) for f in found)
        assert abs(r[name]["score"] - 1 / (1 + np.exp(-z))) < 1e-6, r["doc_id"]


def test_repeated_ids_do_not_swell_the_sample(spark):
    from quillforge.llm.labels import labelled

    docs = spark.range(3000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    picked = spark.createDataFrame([(0, 1), (1, 0)], "_id long, _label int")
    assert sorted(r["_id"] for r in labelled(docs, picked, "text").collect()) == [0, 1]


def test_char_counts_cover_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = docs.transform(lambda d: toxicity.char_counts(d)).agg(F.sum("n")).first()[0]
    letters = sum(sum(1 for c in r["text"] if c.isascii() and c.isalpha() or not c.isascii()) for r in docs.collect())
    assert got >= letters


class Dense:
    """A plain matrix with the products that the ranking needs."""

    def __init__(self, x):
        self.x, self.size = x, x.shape[1]

    def times(self, w):
        return self.x @ w

    def back(self, r):
        return self.x.T @ r


def test_pairwise_ranking_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] - 2 * x[:, 3] > 0).astype(int)
    s = x @ quality.bradley_terry(Dense(x), y)
    order = np.argsort(s)
    assert (y[order[: (y == 0).sum()]] == 0).mean() > 0.97
    assert not quality.bradley_terry(Dense(x), np.ones(400, int)).any()


def test_pairwise_ranking_is_the_least_of_its_loss():
    """Against Newton's method on differences that are written out."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    y = (x @ [1.0, -0.5, 0.2, 0.0] + rng.normal(size=300) > 0).astype(int)
    got = quality.bradley_terry(Dense(x), y, ridge=0.01, rounds=2000)
    draw, good, bad = np.random.default_rng(7), np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    a = np.concatenate([np.repeat(good, 8), draw.choice(good, len(bad) * 8)])
    b = np.concatenate([draw.choice(bad, len(good) * 8), np.repeat(bad, 8)])
    d, w = x[a] - x[b], np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-d @ w))
        w -= np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + 0.01 * np.eye(4), d.T @ (p - 1) / len(d) + 0.01 * w)
    assert np.abs(got - w).max() < 1e-3


BLANKS = "\t\n\v\f\r\x1c\x1d\x1e\x1f "


def plain_features(text):
    """The surface features of a text, one by one."""
    from collections import Counter

    words = [w for w in re.split(f"[{BLANKS}]+", (text or "").translate({k: k + 32 for k in range(65, 91)})) if w]
    n = len(words)
    if not n:
        return [0.0] * len(quality.SURFACE)
    chars, letters = len(text), sum(c not in BLANKS for c in text)
    lines = [x for x in text.translate({k: k + 32 for k in range(65, 91)}).split("\n") if x]
    alpha = max(1, len(re.findall(r"[A-Za-z]|[^\x00-\x7f]", text)))
    count = lambda pattern: len(re.findall(pattern, text))
    ends = [w[-1] for w in words]
    return [
        min(1.0, np.log1p(n) / 8), len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, count("[A-ZÀ-ÖØ-Þ]") / alpha,
        min(1.0, 5 * count(r"[*#%&$^~<>{}\\=_+]") / letters), min(1.0, text.count("!") / n), min(1.0, text.count("|") / n), sum(c in "*#%&$!|" for c in ends) / n, alpha / chars,
        min(1.0, 5 * count("[0-9]") / letters), min(1.0, letters / n / 12), min(1.0, 10 * sum(c in ".?!" for c in ends) / n), 1 - len(set(lines)) / len(lines),
        sum(len(x.encode()) < 40 for x in lines) / len(lines), max(Counter(words).values()) / n if n >= 20 else 0.0, sum(len(w.encode()) > 25 for w in words) / n,
    ]


def plain_score(model, text):
    """The linear score of a text, word by word and byte by byte."""
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    total = float(np.dot(plain_features(text), model.weights))
    words = re.findall(rb"[0-9a-z\x80-\xff]+", low)
    if words:
        total += quality.LEXICAL * np.mean([model.words[quality.word_buckets(Words(np.frombuffer(w, np.uint8), np.array([0, len(w)])))[0]] for w in words])
    if len(low) > 3:
        total += quality.LEXICAL * np.mean([model.grams[quality.gram_buckets(np.frombuffer(low[k : k + 4], np.uint8))[0]] for k in range(len(low) - 3)])
    return total


def test_quality_scores_by_brute_force(spark):
    rng = np.random.default_rng(2)
    model = quality.Model(rng.normal(size=len(quality.SURFACE)), rng.normal(size=quality.WORD_BUCKETS), rng.normal(size=quality.GRAM_BUCKETS), 0.0, 1.0)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(80).collect()] + [None, "", " \n ", "a", "abc", "abcd", "É x\n\nÉ x\n×", "日本語 日本語", "A|b! c_d " * 30]
    for group in (texts, texts[::-1], texts[:1]):
        data, offsets = utf8(pa.array(group, pa.string()))
        assert np.allclose(quality.surface(data, offsets, Words(data, offsets)), [plain_features(t) for t in group])
        assert np.allclose(model.raw(data, offsets), [plain_score(model, t) for t in group])


# ---- substrings --------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=1500), min_size=1, max_size=5), st.integers(1, 26))
def test_cuts_ignore_neighbours_and_come_often(texts, kinds):
    texts = [bytes(97 + c % kinds for c in t) for t in texts]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    found = substrings.cuts(data, offsets)
    for t, raw in enumerate(texts):
        own = found[(found > offsets[t]) & (found < offsets[t + 1])] - offsets[t]
        assert own.tolist() == substrings.cuts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).tolist()
        ranks = substrings.gear(np.frombuffer(raw, np.uint8))[substrings.SPAN - 1 :]
        w = min(substrings.WINDOW, len(ranks))
        want = {p + substrings.SPAN for k in range(len(ranks) - w + 1) for p in range(k, k + w) if ranks[p] == ranks[k : k + w].min()} if w else set()
        assert set(own.tolist()) == want - {len(raw)}


def test_equal_stretches_have_a_chunk_in_common():
    rng = np.random.default_rng(3)
    for kinds in (3, 26):
        for _ in range(300):
            shared = rng.integers(97, 97 + kinds, substrings.SURE)
            texts = [np.concatenate([rng.integers(97, 97 + kinds, rng.integers(0, 300)), shared, rng.integers(97, 97 + kinds, rng.integers(0, 300))]).astype(np.uint8) for _ in range(2)]
            found = [substrings.chunks(x, np.array([0, len(x)])) for x in texts]
            assert set(found[0][2].tolist()) & set(found[1][2].tolist())


def test_filters_lose_nothing(spark):
    from quillforge.llm.common import bloom, sift

    keys = spark.range(0, 30_000, 3).select((F.col("id") - 9000).alias("k"))
    found = bloom(keys)
    assert found.has(np.arange(-9000, 21_000, 3)).all()
    assert found.has(np.arange(1_000_000, 1_100_000)).mean() < 0.02
    assert not bloom(keys.limit(0)).has(np.arange(100)).any()
    inside, outside = (sift(spark.range(-20_000, 30_000).toDF("k"), "k", (found, x)).count() for x in (True, False))
    assert inside >= 10_000 and inside + outside == 50_000


def test_repeated_passages_go_once(spark):
    rng = np.random.default_rng(1)
    vocab = [f"word{k}" for k in range(5000)]
    make = lambda n: " ".join(rng.choice(vocab, n))
    passage = make(60)
    docs = [make(100) + f" {passage} " + make(50), make(37) + f" inserted {passage} " + make(90), make(200), passage]
    got = {r["doc_id"]: r for r in substrings.drop_repeats(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert got[0]["text"] == docs[0] and got[2]["text"] == docs[2]
    assert got[1]["n_removed"] > 0.5 * len(passage) and got[3]["n_removed"] > 0.5 * len(passage)
    odd = spark.createDataFrame([(5, docs[0]), (None, docs[3]), (5, docs[2] + docs[3]), (5, docs[0])], "doc_id long, text string")
    left = [(r["doc_id"], r["n_removed"] > 0) for r in substrings.drop_repeats(odd).collect()]
    assert sorted(left, key=str) == [(5, True), (5, True), (5, True), (None, False)]  # the null id comes first
    for k, text in enumerate(docs):  # exact round trip: what is left and what went make the text
        raw, last, parts = text.encode(), 0, []
        for s in got[k]["removed"]:
            parts.append(raw[last : s["start"]])
            last = s["stop"]
        assert b"".join([*parts, raw[last:]]).decode() == got[k]["text"]


def test_passages_of_51_short_words_go_whole(spark):
    """Passages of 51 words (some 200 bytes), and of 60 letters in a script without blanks, to their exact ends."""
    rng = np.random.default_rng(7)
    make = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(1, 6))) for _ in range(n))
    han = lambda n: "".join(map(chr, rng.integers(0x4E00, 0x9FA0, n)))
    docs, passages = [], []
    for k in range(120):
        some, passage = (make, make(51)) if k % 4 else (han, han(60))
        passages += [passage, passage]
        docs += [f"{some(int(rng.integers(0, 90)))}|{k} {passage} {k}|{some(40)}", f"{some(int(rng.integers(0, 90)))}:{k}a {passage} b{k}:{some(40)}"]
    docs += [docs[1].replace(passages[0], passages[0][:90] + "##" + passages[0][92:])]  # equal on both sides of a change
    for r in substrings.drop_repeats(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)).collect():
        k = r["doc_id"]
        if k == 240:
            assert "##" in r["text"] and r["n_removed"] > len(docs[k]) / 2
        elif k % 2:
            assert r["text"] in (docs[k].replace(f" {passages[k]} ", ""), docs[k].replace(passages[k], ""))
        else:
            assert r["text"] == docs[k]


def test_runs_without_blanks_and_copies_of_odd_rows(spark):
    """Han letters, base64 and addresses repeat without a blank; a short text that is repeated whole stays."""
    rng = np.random.default_rng(9)
    han = "".join(map(chr, rng.integers(0x4E00, 0x9FA0, 800)))
    code = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"), 900))
    short = "only a few words that are not enough to go"
    texts = [han, han, code, "x" + code, f"https://host/{code}", short, short, None, None, "", ""]
    got = {r["doc_id"]: r for r in substrings.drop_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k]["text"] for k in range(len(texts))] == [han, "", code, "x", "https://host/", short, short, None, None, "", ""]


def test_repeats_by_brute_force(spark):
    """What goes stands earlier (in order of ids and places); of stretches of `SURE` bytes that do, what goes is all but
    the bytes at an end that only another than the first occurrence has too."""
    rng = np.random.default_rng(12)
    vocab = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(3000)]
    passages = [" ".join(rng.choice(vocab, 60)) for _ in range(6)]
    docs = [" ".join(x for _ in range(3) for x in (" ".join(rng.choice(vocab, 40)), passages[int(rng.integers(6))])) for _ in range(60)]
    got = {r["doc_id"]: r for r in substrings.drop_repeats(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)).collect()}
    n, seen = substrings.SURE, set()
    for k, text in enumerate(docs):
        spans = [(s["start"], s["stop"]) for s in got[k]["removed"]]
        for p in range(len(text) - n + 1):
            if text[p : p + n] in seen:
                assert any(a <= p + 12 and p + n - 12 <= b for a, b in spans), (k, p)
            seen.add(text[p : p + n])
        for a, b in spans:
            assert substrings.units(text[a:b].encode()) >= substrings.RUN_UNITS
            whole = [text[a + x : a + x + 32] in docs[j] for x in range(0, b - a - 31) for j in range(k + 1)]
            assert any(whole)


def test_texts_of_one_id_are_told_apart(spark):
    """300,000 texts without an id: some ten pairs would share a key of 32 bits."""
    n = 300_000
    texts = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    assert texts.select(substrings._row(F.col("doc_id"), F.col("text")).alias("row")).distinct().count() == n


# ---- packing -----------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 1023), max_size=120))
def test_bins_and_bounds(lengths):
    x = np.array(lengths, np.int64)
    bins, offsets, fill = packing.best_fit_decreasing(x)
    assert (fill <= 1024).all() and fill.sum() == x.sum()
    for b in range(len(fill)):
        own = sorted((offsets[k], x[k]) for k in np.flatnonzero(bins == b))
        assert own[0][0] == 0 and all(o + n == p for (o, n), (p, _) in zip(own, own[1:], strict=False))
    bound = packing.lower_bound(np.bincount(x, minlength=1025))
    assert bound <= len(fill) <= max(bound, int(bound * 11 / 9 + 1))


def test_bounds_are_tight_where_halves_do_not_fit():
    counts = np.zeros(1025, np.int64)
    counts[600] = 10
    assert packing.lower_bound(counts) == 10
    counts[350] = 30
    assert packing.lower_bound(counts) == len(packing.best_fit_decreasing(np.repeat([600, 350], [10, 30]))[2])


def test_certified_partitions_never_move(spark, monkeypatch):
    """Partitions that meet their bound keep every sequence; those with gaps exchange, and no round makes it worse."""
    monkeypatch.setattr(packing, "GROUP", 60)
    rng = np.random.default_rng(4)
    lengths = np.concatenate([rng.integers(1, 1024, 1500), np.full(300, 600), np.full(300, 350), np.full(5, 1024)])
    items = spark.createDataFrame([(k, int(n), "x") for k, n in enumerate(lengths)], "doc_id long, length long, uid string").repartition(3)
    rounds = []
    real = packing._pack_groups
    monkeypatch.setattr(packing, "_pack_groups", lambda *a: rounds.append(real(*a)) or rounds[-1])
    got = packing.pack(items).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(lengths)))
    place = {}
    for r in got:
        place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in place.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(n for _, n in own) <= 1024
    first = rounds[0].collect()
    certified = {}
    for r in first:
        if r["bins"] <= r["bound"]:
            certified.setdefault((r["group"], r["bin"]), []).append((r["offset"], r["length"]))
    assert certified and len(rounds) > 1
    kept = {(s >> 20, s & ((1 << 20) - 1)): sorted(x) for s, x in place.items() if 0 <= s < 1 << 56}
    assert all(kept[k] == sorted(x) for k, x in certified.items())
    alone = sum({r["group"]: r["bins"] for r in first}.values()) + 5
    bound = packing.lower_bound(np.bincount(lengths, minlength=1025))
    assert bound <= len(place) < alone


def test_ids_equal_the_tokenizer():
    encode = packing.Encoder(packing.default_tokenizer())
    texts = ["", " ", "hello world", "it's  1,000\n\n\tx", "naïve Größe", "日本語 🙂", "<|endoftext|>", "a" * 3000, " " * 9000 + "x", "\x1c\x85 é²"]
    for t in texts:
        assert encode(t).tolist() == encode.tokenizer.encode(t, add_special_tokens=False).ids


def test_sequences_round_trip(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 40)
    docs = spark.read.parquet(f"{SF}/documents.parquet").union(spark.createDataFrame([(-1, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    packed = packing.pack(packing.pieces(docs, with_ids=True)).cache()
    encode = packing.Encoder(packing.default_tokenizer())
    rows = packed.collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["ids"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d in docs.collect():
        parts = sorted(by_doc[d["doc_id"]])
        assert [p[0] for p in parts] == list(range(len(parts))) and all(len(p[2]) == 1024 for p in parts[1:])
        ids = [x for p in parts for x in p[2]]
        assert ids == [*encode(d["text"] or "").tolist(), 2]
        assert [p[1] for p in parts] == np.cumsum([0, *(len(p[2]) for p in parts)])[:-1].tolist()
    for own in by_seq.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(n for _, n in own) <= 1024
    bound = packing.lower_bound(np.bincount([r["length"] for r in rows], minlength=1025))
    # a certified partition is at its own bound: all together lose less than one sequence each
    assert bound <= len(by_seq) <= bound + len(rows) // 40 + 2
    made = packing.sequences(packed)
    assert made.count() == len(by_seq) and made.agg(F.max(F.size("ids"))).first()[0] <= 1024
    packed.unpersist()


def test_long_rules_and_runs_take_no_time():
    for text in ("-" * 5000 + "aa", "*" * 5000 + "bold " * 3, "a-" * 50_000 + "zz", "a " * 50_000 + "word", "." * 9000, "1" * 50_000, "a@" * 20_000, "http://" * 9000, "iban " * 9000, "+1" * 9000):
        toxicity.tokens_of(text)
        private.report(text, private.automaton(), True)
        quality.neutral().raw(*utf8(pa.array([text])))
    model = toxicity.CharModel(np.zeros(toxicity.SIZE**4))
    assert toxicity.decode("a1" * 20_000, model)
