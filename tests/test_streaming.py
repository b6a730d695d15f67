"""Edits of lines, one after the other, against a scan of the whole document after each."""

import random

from quillforge.operators.correct import Fixes, _places
from quillforge.streaming.edits import Buffer, corrections_of_edits

PAIRS = [("hte", "the"), ("wiht", "with")]


def test_each_edit_is_answered_as_by_the_whole_document():
    draw = random.Random(3)
    fixes = Fixes([{"typo": t, "correction": c, "capitalized_ok": False} for t, c in PAIRS], False)
    parts = ["hte", "wiht", "`", "```", "---", "<a b=", ">", "[x]:", "> ", " ", "fine", "~~~", "\\t", "a/hte"]
    for kind in ("markdown", "gitcommit", "text", "lua"):
        buffer, lines = Buffer([], []), []
        for _ in range(300):
            row = draw.randrange(len(lines) + 2)
            line = "".join(draw.choice(parts) for _ in range(draw.randrange(6)))
            lines += [""] * (row + 1 - len(lines))
            lines[row] = line
            buffer.edit(row, line)
            buffer = Buffer(*buffer.kept())  # as it comes back from the state
            if kind == "lua":
                continue
            assert buffer.corrections(row, kind, fixes) == [f for f in _places("\n".join(lines), kind, fixes) if f[0] == row]
        if len(lines) > 2:
            buffer.edit(1, None)
            assert len(buffer.lines) == len(lines) - 1 and len(buffer.states) <= 2


def test_stream_of_edits(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    catalog = spark.createDataFrame(PAIRS, "typo string, correction string")

    def feed(*rows):
        spark.createDataFrame(rows, "doc_id long, filetype string, seq long, row int, line string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id long, filetype string, seq long, row int, line string").parquet(source)
        found = corrections_of_edits(stream, catalog)
        q = found.writeStream.foreachBatch(lambda df, _: seen.append(sorted(tuple(r) for r in df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    feed((1, "markdown", 0, 0, "hte"), (1, "markdown", 1, 1, "`hte"), (1, "markdown", 2, 2, "hte` wiht"), (2, "markdown", 0, 0, "```"))
    feed((1, "markdown", 3, 1, "plain"), (1, "markdown", 4, 2, "hte wiht"), (2, "markdown", 1, 1, "hte"))
    assert [x for batch in seen[:1] for x in batch] == [(1, 0, 0, 3, "hte", "the"), (1, 2, 5, 9, "wiht", "with")]
    assert seen[-1] == [(1, 2, 0, 3, "hte", "the"), (1, 2, 4, 8, "wiht", "with")]
