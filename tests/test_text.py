from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillforge.functions import edits, text
from quillforge.operators import correct


def words(spark, *ws):
    return spark.createDataFrame([(w,) for w in ws], "w string")


def test_buckets_have_their_stated_numbers(spark):
    got = {r["w"]: r["b"] for r in words(spark, "woudl", "definately", "hte", "recieve", "").select("w", text.bucket("w").alias("b")).collect()}
    assert got == {"woudl": 12, "definately": 38, "hte": 194, "recieve": 100, "": 1}


def test_sizes_of_edit_sets(spark):
    got = {r["w"]: r["n"] for r in words(spark, "hte", "abotu", "definately", "").select("w", F.size(edits.one_edit("w")).alias("n")).collect()}
    assert got == {"hte": 181, "abotu": 285, "definately": 545, "": 0}


def test_sizes_of_keyboard_typos(spark):
    got = {r["w"]: r["n"] for r in words(spark, "the", "with", "which", "people", "The", "a1").select("w", F.size(edits.keyboard_typos("w")).alias("n")).collect()}
    assert got == {"the": 45, "with": 63, "which": 84, "people": 68, "The": 0, "a1": 0}


def test_neighbours_are_symmetric():
    pairs = set(edits.neighbour_pairs())
    assert len(pairs) == 110 and {(b, a) for a, b in pairs} == pairs


def test_swaps_and_repeats(spark):
    rows = [("hte", "the", True, False), ("abc", "abc", False, False), ("abcd", "badc", False, False), ("tthe", "the", False, True), ("a", "b", False, False)]
    df = spark.createDataFrame(rows, "a string, b string, swap boolean, again boolean")
    for r in df.select("*", edits.is_swap("a", "b").alias("s"), edits.is_repeat("a", "b").alias("r")).collect():
        assert (r["s"], r["r"]) == (r["swap"], r["again"])


def test_case_guard_rejects_line_feeds(spark):
    got = {r["w"]: (r["l"], r["t"]) for r in words(spark, "abc", "abc\n", "Abc", "ABC", "aBc", "").select("w", text.is_lower("w").alias("l"), text.is_title("w").alias("t")).collect()}
    assert got == {"abc": (True, False), "abc\n": (False, False), "Abc": (False, True), "ABC": (False, False), "aBc": (False, False), "": (False, False)}


def test_normalised_words(spark):
    got = [r["n"] for r in words(spark, "Café", "O'Neil-2", "Ångström", None).select(text.normalized("w").alias("n")).collect()]
    assert got == ["cafe", "oneil", "angstrom", None]


def test_correction_is_one_pass_of_whole_words(spark):
    catalog = spark.createDataFrame([("hte", "the", False), ("the", "teh", False), ("definately", "definitely", True)], "typo string, correction string, capitalized_ok boolean")
    docs = spark.createDataFrame([(1, "hte htex foo_hte éhte HTE Hte. Definately"), (2, None), (3, ""), (4, "nothing here"), (None, "a hte")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_fixed"], r["corrected"]) for r in correct.correct_text(docs, catalog).collect()}
    assert got == {1: (1, "the htex foo_hte éhte HTE Hte. Definately"), 2: (0, None), 3: (0, ""), 4: (0, "nothing here"), None: (1, "a the")}
    got = {r["doc_id"]: r["corrected"] for r in correct.correct_text(docs, catalog, correct_capitalized=True).collect()}
    assert got[1] == "the htex foo_hte éhte HTE Hte. Definitely"


def test_overrides_and_file_types(spark):
    catalog = spark.createDataFrame([("hte", "the"), ("wiht", "with")], "typo string, correction string")
    docs = spark.createDataFrame([(1, "markdown", "hte wiht"), (2, "python", "hte wiht")], "doc_id long, filetype string, text string")
    own = spark.createDataFrame([("hte", "HTE")], "typo string, correction string")
    assert [r["w"] for r in correct.corrections_in_context(docs, catalog, overrides=own).collect()] == ["wiht"]
    assert correct.corrections_in_context(docs, catalog, filetypes=()).count() == 0
    assert [r["w"] for r in correct.corrections_in_context(docs, catalog, bypass=own.select("typo")).collect()] == ["wiht"]


def test_comments_of_source_files(spark):
    catalog = spark.createDataFrame([("hte", "the")], "typo string, correction string")
    rows = [("python", "hte = 'hte # hte'  # hte `hte` http://hte\n# ```\n# hte\n# ```\n# hte"), ("c", "int hte; /* hte\n * hte */ hte // hte"), ("unknown", "# hte"), (None, "hte"), ("lua", None)]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, filetype string, text string")
    got = {r["doc_id"]: r["corrected"] for r in correct.correct_in_context(docs, catalog).collect()}
    assert got == {0: "hte = 'hte # hte'  # the `hte` http://hte\n# ```\n# hte\n# ```\n# the", 1: "int hte; /* the\n * the */ hte // the", 2: "# hte", 3: "hte", 4: None}


def test_large_catalogues_take_the_other_way(spark, monkeypatch):
    """Beyond the broadcast limit words leave the texts to meet the catalogue; the results are the same."""
    catalog = spark.createDataFrame([("hte", "the", False), ("definately", "definitely", True)], "typo string, correction string, capitalized_ok boolean")
    docs = spark.createDataFrame([(1, "text", "hte Hte Definately HTE"), (2, "markdown", "`hte` hte [x](hte)"), (3, "markdown", None), (None, "text", "a hte"), (4, "lua", "hte -- hte"), (5, "text", "")], "doc_id long, filetype string, text string")

    def found():
        out = [sorted(map(str, f.collect())) for cap in (False, True) for f in (correct.correct_text(docs, catalog, correct_capitalized=cap), correct.correct_in_context(docs, catalog, correct_capitalized=cap), correct.corrections_in_context(docs, catalog, correct_capitalized=cap))]
        return out

    small = found()
    monkeypatch.setattr(correct, "BROADCAST_BYTES", 0)
    assert found() == small and "the Hte Definitely" in str(small[3])


def test_column_rules_agree_with_the_scanner(spark):
    rows = [("see http://a.b/hte", True), ("www.hte.com", True), ("a@hte", True), ("C:\\hte", True), ("..\\hte", True), ("~\\hte", True), ("docs\\hte", True), ("hte", False), ("hte.", False)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    for r in df.withColumn("got", correct.technical(F.element_at(F.split("t", " "), -1))).collect():
        assert r["got"] == r["want"], r["t"]
        assert correct.prose(r["t"], [(r["t"].index("hte"), r["t"].index("hte") + 3)]) == [not r["want"]]


def slow_prose(line, start, stop):
    """The same by prefixes and suffixes, word by word."""
    import re

    left, right = re.search(r"[^\s()\[\]<>\"'`]*\Z", line[:start])[0], re.match(r"[^\s()\[\]<>\"'`]*", line[start:])[0]
    return not (correct._TECHNICAL.search(left + right) or line[stop : stop + 1] in ("@", "/", "\\") or re.search(r"\]\([^)]*\Z", line[:start]))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1 ()[]/@\\.:~<>`'\"w-", max_size=40))
def test_prose_in_one_walk(line):
    import re

    words = [m.span() for m in re.finditer(r"\w+", line)]
    assert correct.prose(line, words) == [slow_prose(line, a, b) for a, b in words]


def test_filters(spark):
    """Probe positions by plain arithmetic, no false negative, few false positives."""
    from quillforge.operators import bloom

    def signed(x):
        return (x + 2**31) % 2**32 - 2**31

    def place(w, start, factor):
        h = start
        for c in w.encode():
            h = (h * factor + c) % 2**32
        h = (h + (h << 3)) % 2**32
        h ^= h >> 11
        return signed(h + (h << 15))

    ws = [f"{a}{b}{c}" for a in "abcdefgh" for b in "qrstu" for c in "xyz"]
    bits = 624
    for r in bloom.probes(spark.createDataFrame([(w, bits) for w in ws], "typo string, bits long")).collect():
        first, step = place(r["typo"], 5381, 33) % bits, place(r["typo"], 0, 65599) % bits
        assert list(r["probes"]) == [(first + k * step) % bits for k in range(8)]
    entries = words(spark, *ws).withColumnRenamed("w", "typo")
    filters = bloom.build(entries).cache()
    assert filters.count() == 256
    for r in filters.collect():
        assert len(r["bytes"]) == max(1, -(-r["entries"] * 12 // 8)) and r["bits"] == 8 * len(r["bytes"])
    assert bloom.contains(entries, filters).where("NOT maybe").count() == 0
    damaged = filters.withColumn("bytes", F.when(F.col("bucket") % 2 == 0, F.unhex(F.repeat(F.lit("00"), F.length("bytes")))).otherwise(F.col("bytes")))
    assert bloom.contains(entries, damaged).where("NOT maybe").count() == 0  # a damaged filter hides no entry
    assert bloom.contains(entries, filters.where("bucket % 3 <> 0")).where("NOT maybe").count() == 0
    catalog = entries.withColumn("correction", F.upper("typo"))
    assert bloom.candidates(entries.union(words(spark, "nothing", "else")), damaged, catalog).count() == len(ws)
    others = spark.range(2000).select(F.concat(F.lit("zz"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("typo"))
    assert bloom.contains(others, filters).where("maybe").count() < 100
