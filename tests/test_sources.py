import json
import os
import shutil

import pytest

from quillforge.operators import audit
from quillforge.operators.correct import correct_text
from quillforge.operators.expand import Evidence
from quillforge.sources import catalog, publish


def test_load_catalog(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"separate": ["seperate", "sepparate"], "each other": ["eachother"]}')
    assert {tuple(r) for r in catalog.load_catalog(spark, str(path)).collect()} == {("seperate", "separate"), ("sepparate", "separate"), ("eachother", "each other")}
    path.write_text('{"word": ["word"]}')
    with pytest.raises(catalog.InvalidCatalog):
        catalog.load_catalog(spark, str(path))


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("{}", None), ('{"look up":["lookup"],"river":["rivre","rievr"]}', None), ('{"r\\u0069ver":["rivre"]}', None), ('{"look\\u0020up":["lookup"]}', None),
        ('{"river":["rivre"],"r\\u0069ver":["rievr"]}', "duplicate key"), ('{"river":["rivre"],"liver":["rivre"]}', "typo has two corrections"), ('{"river":["river"]}', "typo equals correction"),
        ('{"river":[]}', "empty list"), ('{"river":null}', "value is no list of strings"), ('{"river":{"0":"rivre"}}', "root is no object"), ('{"river":[null]}', "typo is no string"), ("[1]", "root is no object"), ("7", "root is no object"),
        ('{"look  up":["lookup"]}', "invalid correction"), ('{"look\\u00a0up":["lookup"]}', "invalid correction"), ('{"look\\nup":["lookup"]}', "invalid correction"), ('{"don\'t":["dont"]}', "invalid correction"), ('{"river":["riv re"]}', "invalid typo"), ('{"river":["rivre"', "malformed"),
    ],
)
def test_rules_of_catalogues(spark, text, error):
    found = catalog.parsed(spark.createDataFrame([(text,)], "source string")).first()["error"]
    assert (found is None) == (error is None)
    if error in ("duplicate key", "typo has two corrections", "typo equals correction", "empty list", "invalid correction", "invalid typo"):
        assert found == error


@pytest.mark.parametrize(
    "text",
    [
        "[]", "null", "{", '{"Teh": {"reason": "r", "source": "https://a.b"}}', '{"teh": {"reason": "r"}}', '{"teh": {"reason": "", "source": "https://a.b"}}',
        '{"teh": {"reason": "r", "source": "ftp://a.b"}}', '{"teh": {"reason": "r", "source": "https:///x"}}', '{"teh": {"reason": "r", "source": "https://a b"}}',
        '{"teh": {"reason": "r", "source": "https://a.b", "more": 1}}', '{"teh": {"reason": "r", "reason": "s", "source": "https://a.b"}}', '{"teh": {"reason": 1, "source": "https://a.b"}}',
        '{"teh": {"reason": "r", "source": "https://a.b"}, "teh": {"reason": "r", "source": "https://a.b"}}',
    ],
)
def test_broken_evidence(spark, text):
    with pytest.raises(catalog.InvalidCatalog):
        catalog.protected_words(spark, text)


def reviews(spark, **pairs):
    return catalog.reviewed_corrections(spark, json.dumps({t: {"correction": c, "reason": "r", "source": "https://a.b"} for t, c in pairs.items()}))


def documented(spark, lines, **pairs):
    rows = spark.createDataFrame([(x, k) for k, x in enumerate(lines)], "value string, number int")
    return {tuple(r) for r in catalog.documented_lines(rows, reviews(spark, **pairs) if pairs else None).collect()}


def test_documentation_and_reviews(spark):
    assert documented(spark, ["hte->the", "thier->their, there", "none"], wiht="with") == {("hte", "the"), ("wiht", "with")}
    assert documented(spark, ["abotu->abbot", "abotu->about"]) == {("abotu", "about")}  # the last line counts
    assert documented(spark, ["abotu->about", "abotu->abbot"]) == {("abotu", "abbot")}
    assert documented(spark, ["hte->the"], hte="the") == {("hte", "the")}


@pytest.mark.parametrize(
    ("lines", "pairs"),
    [
        (["hte->the"], {"hte": "hate"}),
        (["thier->their, there,"], {"thier": "their"}),  # several suggestions contradict a review
        (["wiht->with", "wiht->white"], {"wiht": "with"}),
        (["wiht->with"], {"hte": "the"}),  # a short pair that no line confirms
    ],
)
def test_reviews_that_must_not_pass(spark, lines, pairs):
    with pytest.raises(catalog.InvalidCatalog):
        documented(spark, lines, **pairs)


def test_word_lists(spark, tmp_path):
    (tmp_path / "english-words.10").write_bytes("caf\xe9\nword\n".encode("latin1"))
    (tmp_path / "english-upper.95").write_text("Name\n")
    got = {(r["word"], r["level"]) for r in catalog.word_lists(spark, str(tmp_path)).collect()}
    assert got == {("café", 10), ("word", 10), ("Name", 95)}


def test_pronunciation_list(spark, tmp_path):
    (tmp_path / "list").write_text(";;; a remark\nABOUT  AH0 B AW1 T\nABOUT(2)  AH B AW T\n'BOUT  B AW1 T\nword W ER1 D\nalone\n")
    assert sorted(r["word"] for r in catalog.pronounced_words(spark, str(tmp_path / "list")).collect()) == ["about", "word"]


def test_published_filters(spark, tmp_path):
    from quillforge.operators import bloom

    path = str(tmp_path / "published")
    flat = spark.createDataFrame([(f"ty{'p' * k}o", "word") for k in range(40)], "typo string, correction string")
    publish.publish(flat, path)
    filters = publish.open_filters(spark, path)
    assert filters.count() == 256 and publish.open_catalog(spark, path, verify=True).count() == 40
    words = flat.select("typo").union(spark.createDataFrame([("else",), ("nothing",)], "typo string"))
    assert bloom.candidates(words, filters, publish.open_catalog(spark, path)).count() == 40


def test_publish_is_versioned(spark, tmp_path):
    path = str(tmp_path / "published")
    one = spark.createDataFrame([("hte", "the"), ("wiht", "with")], "typo string, correction string")
    first = publish.publish(one, path)
    assert publish.publish(one, path) == first and publish.publish(one, path, check=True) == first
    held = publish.open_catalog(spark, path)
    two = one.union(spark.createDataFrame([("abotu", "about")], "typo string, correction string"))
    with pytest.raises(RuntimeError):
        publish.publish(two, path, check=True)
    assert publish.publish(two, path) != first
    assert held.count() == 2 and publish.open_catalog(spark, path).count() == 3
    with pytest.raises(RuntimeError):
        publish.open_catalog(spark, str(tmp_path / "nothing"))


def test_readers_always_see_a_version(spark, tmp_path):
    """While versions are published one after the other, a reader in a loop never finds none."""
    import threading

    path, seen, stop, failed = str(tmp_path / "published"), set(), threading.Event(), []
    make = lambda n: spark.createDataFrame([("hte", "the")] + [(f"typo{'x' * k}", "word") for k in range(n)], "typo string, correction string")
    publish.publish(make(0), path)

    def read():
        while not stop.is_set():
            try:
                seen.add(publish.current_version(spark, path))
            except Exception as e:  # noqa: BLE001
                failed.append(e)
                return

    reader = threading.Thread(target=read)
    reader.start()
    wrote = {publish.publish(make(n), path) for n in range(4)}
    stop.set()
    reader.join()
    assert not failed and None not in seen and seen <= wrote and publish.current_version(spark, path) in wrote
    assert not [f for f in os.listdir(path) if "tmp" in f]
    assert publish.publish(make(1), path) in wrote and publish.open_catalog(spark, path, verify=True).count() == 2  # back to an earlier one


def test_broken_versions_are_not_opened(spark, tmp_path):
    path = str(tmp_path / "published")
    flat = spark.createDataFrame([(f"ty{'p' * k}o", "word") for k in range(40)], "typo string, correction string")
    version = publish.publish(flat, path)
    assert publish.open_catalog(spark, path, verify=True).count() == 40
    shutil.rmtree(next((tmp_path / "published" / version).glob("bucket=*")))
    with pytest.raises(RuntimeError):
        publish.open_catalog(spark, path, verify=True)
    os.remove(tmp_path / "published" / version / publish.MANIFEST)
    with pytest.raises(RuntimeError):
        publish.open_catalog(spark, path)


def test_inputs_that_change_stop_a_publication(spark, tmp_path):
    values = iter("ab")
    with pytest.raises(RuntimeError):
        publish.publish(spark.createDataFrame([("hte", "the")], "typo string, correction string"), str(tmp_path / "p"), inputs=lambda: next(values))
    assert publish.current_version(spark, str(tmp_path / "p")) is None


def test_content_hash_ignores_order_and_layout(spark):
    rows = [(f"ty{k}po", f"w{k}") for k in range(50)]
    make = lambda rows, n: spark.createDataFrame(rows, "typo string, correction string").repartition(n)
    one = publish.content_hash(make(rows, 1))
    assert one == publish.content_hash(make(rows[::-1], 7)) != publish.content_hash(make(rows[:-1], 2))
    assert one != publish.content_hash(make([*rows[:-1], ("ty49po", "w50")], 2))


def test_grouped_files(spark, tmp_path):
    flat = spark.createDataFrame([("seperate", "separate"), ("sepparate", "separate"), ("eachother", "each other")], "typo string, correction string")
    path = str(tmp_path / "c.json")
    assert publish.write_grouped(flat, path) == 3 and json.load(open(path)) == {"each other": ["eachother"], "separate": ["seperate", "sepparate"]}
    assert publish.write_grouped(flat, path, check=True) == 3
    assert {tuple(r) for r in catalog.load_catalog(spark, path).collect()} == {tuple(r) for r in flat.collect()}
    with pytest.raises(RuntimeError):
        publish.write_grouped(flat.limit(1), path, check=True)
    capital = str(tmp_path / "capital.json")
    assert audit.write_capitalised(flat, flat.where("typo <> 'sepparate'"), capital) == 1 and json.load(open(capital)) == {"separate": ["seperate"]}
    with pytest.raises(RuntimeError):
        audit.write_capitalised(flat, flat, capital, check=True)


def test_stream_takes_new_versions(spark, tmp_path):
    from quillforge.streaming.correction import correct_stream

    path, source = str(tmp_path / "cat"), str(tmp_path / "in")
    publish.publish(spark.createDataFrame([("hte", "the")], "typo string, correction string"), path)
    seen = []

    def sink(df, batch_id, version):
        seen.extend((r["doc_id"], r["corrected"]) for r in df.collect())

    def feed(n, text):
        spark.createDataFrame([(n, text)], "doc_id long, text string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id long, text string").parquet(source)
        q = correct_stream(spark, stream, path, sink, str(tmp_path / "cp"))
        assert q.awaitTermination(120)

    feed(1, "hte wiht")
    publish.publish(spark.createDataFrame([("hte", "the"), ("wiht", "with")], "typo string, correction string"), path)
    feed(2, "hte wiht")
    assert sorted(seen) == [(1, "the wiht"), (2, "the with")]
    assert correct_text(spark.createDataFrame([], "doc_id long, text string"), publish.open_catalog(spark, path)).count() == 0


def test_audit_report(spark, tmp_path):
    from pyspark.sql import functions as F

    pairs = lambda rows: spark.createDataFrame(rows, "typo string, correction string")
    known = ["about", "the", "separate", "which", "each", "other"]
    lexicon = spark.createDataFrame([(w, True, True, True, True) for w in known], "word string, is_protected boolean, is_real boolean, is_alternative boolean, is_destination boolean")
    freq = spark.createDataFrame([(w, 5_000) for w in known], "word string, n bigint")
    documented = pairs([("eachother", "each other")])
    e = Evidence(pairs([("abotu", "about"), ("seperate", "separate"), ("eachother", "each other"), ("the", "which"), ("zzz", "nowhere")]), lexicon, freq, F.lit(10_000_000), documented, pairs([]))
    r = audit.report(e, expected=5)
    assert not r["passed"] and r["entries"] == 5 and r["joined_word_corrections"] == 1
    assert r["failure_counts"]["protected_word_or_name"] == 1
    assert r["failure_examples"]["unverified_destination"] == [["zzz", "nowhere"]]
    good = Evidence(pairs([("abotu", "about"), ("seperate", "separate"), ("eachother", "each other")]), lexicon, freq, F.lit(10_000_000), documented, pairs([]))
    assert audit.report(good)["passed"]
    assert audit.report(good, expected=4)["failure_counts"] == {"entry_count": 2}
    assert r["rejected_typos"] == ["the", "zzz"] and r["reviewed_records"] == 0 and r["technical_destinations"] == ["nowhere"]
    assert r["mapping_sha256"] == audit.digest({"abotu": "about", "eachother": "each other", "seperate": "separate", "the": "which", "zzz": "nowhere"})
    assert r["protected_dictionary_tokens"] == r["alternative_dictionary_tokens"] == r["protected_frequency_tokens"] == 6
    protected = catalog.protected_words(spark, '{"teh": {"reason": "name", "source": "http://a.b"}}')
    text, status = audit.report_json(good, path=str(tmp_path / "audit.json"), protected=protected, lists_sha256="00")
    assert status == 0 and (tmp_path / "audit.json").read_text() == text and json.loads(text)["supplemental_protected_tokens"] == 1


def test_lost_competitions_name_their_rivals(spark):
    from pyspark.sql import functions as F

    lexicon = spark.createDataFrame([(w, True, True, True, True) for w in ("seat", "heat", "meat")], "word string, is_protected boolean, is_real boolean, is_alternative boolean, is_destination boolean")
    pairs = spark.createDataFrame([("xeat", "seat")], "typo string, correction string")
    e = Evidence(pairs, lexicon, spark.createDataFrame([("seat", 5), ("heat", 5), ("meat", 5)], "word string, n bigint"), F.lit(1000), pairs.limit(0), pairs.limit(0))
    assert [tuple(r) for r in audit.competing(audit.audited(e)).collect()] == [("xeat", "seat", ["heat", "meat"])]
    assert audit.report(e)["failure_examples"]["competing_correction"] == [["xeat", "seat", ["heat", "meat"]]]


def test_corpus_hash_and_fingerprint(spark, tmp_path):
    import hashlib

    for name in ("b.10", "a.20"):
        (tmp_path / name).write_bytes(name.encode() * 3)
    want = hashlib.sha256(b"".join(n.encode() + b"\0" + n.encode() * 3 for n in ("a.20", "b.10"))).hexdigest()
    assert catalog.corpus_hash(spark, str(tmp_path)) == want
    one = catalog.fingerprint(spark, str(tmp_path / "a.20"), str(tmp_path / "b.10"))
    assert one == catalog.fingerprint(spark, str(tmp_path / "b.10"), str(tmp_path / "a.20"))
    (tmp_path / "a.20").write_bytes(b"longer than before")
    assert one != catalog.fingerprint(spark, str(tmp_path / "a.20"), str(tmp_path / "b.10"))


def test_rebuilds_are_coalesced():
    import threading

    from quillforge.streaming.maintenance import Rebuilder

    gate, runs, version = threading.Event(), [], ["1"]

    def build():
        runs.append(version[0])
        gate.wait(10)

    r = Rebuilder(build, lambda: version[0])
    r.request()
    while not runs:
        pass
    version[0] = "2"
    for _ in range(5):
        r.request()
    gate.set()
    assert r.wait(10) and runs == ["1", "2"] and r.built == "2"
    r.request()
    assert r.wait(10) and runs == ["1", "2"]  # nothing has changed
    version[0] = "3"
    r.build = lambda: 1 / 0
    r.request()
    assert r.wait(10) and isinstance(r.error, ZeroDivisionError) and r.built == "2"
