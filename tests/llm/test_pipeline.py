"""Each stage of the pipeline against brute force, on the rows that its predecessor kept."""

import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from shared import SF
from test_search import brute_classes
from test_texts import base_spans, plain_score

from quillforge.llm import packing, quality


@pytest.fixture(scope="module")
def passed(spark, tmp_path_factory):
    """Rows before and after each stage, by its name."""
    top, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{top}/{name}")
        after = spark.read.parquet(f"{top}/{name}")
        out[name] = (docs.collect(), after.collect())
        docs = after
    return out


def test_quality(spark, passed):
    """Documents that the fitted model, applied word by word, puts above its threshold, which splits the labels."""
    before, after = passed["quality"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    picked = corpus_pipeline.sample(spark.read.parquet(f"{SF}/labels.parquet"), "quality", corpus_pipeline.fold("doc_id", 3) != 1, quality.SAMPLE)
    model = quality.fit(docs, picked)
    raw = {r["doc_id"]: plain_score(model, r["text"]) for r in before}
    assert {r["doc_id"] for r in after} == {i for i, x in raw.items() if x >= model.threshold}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["quality"] is not None}
    seen = [i for i in raw if i in labels]
    assert abs(sum(raw[i] < model.threshold for i in seen) - sum(labels[i] == 0 for i in seen)) <= 1  # the quantile


def test_jaccard(passed):
    before, after = passed["jaccard"]
    before = sorted(before, key=lambda r: r["doc_id"])
    classes = brute_classes([r["text"] for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted({before[c]["doc_id"] for c, _ in classes})
    texts = {r["doc_id"]: r["text"] for r in before}
    assert all(texts[r["doc_id"]] == r["text"] for r in after)


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return [(m.start(), m.end(), m[0]) for m in re.finditer("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)]


def test_decontamination(spark, passed):
    before, after = passed["decontamination"]
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = [x[2] for x in words_of(r["text"])]
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9)) if w}
    lengths = {len(w) for w in windows}
    got, touched = {r["doc_id"]: r for r in after}, 0
    assert len(got) == len(before)
    for r in before:
        words = words_of(r["text"])
        hit = [False] * len(words)
        for n in lengths:
            for k in range(len(words) - n + 1):
                if tuple(x[2] for x in words[k : k + n]) in windows:
                    hit[k : k + n] = [True] * n
        left = [x[2] for x, h in zip(words, hit, strict=True) if not h]
        touched += any(hit)
        assert [x[2] for x in words_of(got[r["doc_id"]]["text"])] == left
        assert got[r["doc_id"]]["n_chars"] == len(got[r["doc_id"]]["text"])
        if not any(hit):
            assert got[r["doc_id"]]["text"] == r["text"]
    assert touched


def test_private(passed):
    before, after = passed["private"]
    got, touched = {r["doc_id"]: r for r in after}, 0
    assert len(got) == len(before)
    for r in before:
        spans, text = base_spans(r["text"]), got[r["doc_id"]]["text"]
        assert not base_spans(text)
        touched += bool(spans)
        if not spans and "<" not in text:
            assert text == r["text"]
        assert got[r["doc_id"]]["n_chars"] == len(text)
    assert touched


def test_packing(passed):
    before, after = passed["packing"]
    encode = packing.Encoder(packing.default_tokenizer())
    want = []
    for r in before:
        ids = np.array([*encode(r["text"] or "").tolist(), 2], "<u4")
        at, size, piece = 0, len(ids) % 1024 or 1024, 0
        while at < len(ids):
            want.append((r["doc_id"], piece, at, size, zlib.crc32(ids[at : at + size].tobytes())))
            at, size, piece = at + size, 1024, piece + 1
    assert sorted(want) == sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in after)
    fill = {}
    for r in after:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 1024


def test_run_is_the_stages(spark, passed):
    rows = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["ids_crc32"])
    assert sorted(map(key, rows)) == sorted(map(key, passed["packing"][1]))
