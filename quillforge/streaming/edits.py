"""Correction of documents while they are edited: a stream of line edits, with the scanner's state kept by document.

For each document the lines and the states before them are kept, so that an edit scans its own line alone; the states
behind the first edited line are given up and made again when a later line is asked for. State is as large as the
documents being edited, and goes after `idle` without edits.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import astuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scanner import State, answers, step
from ..operators.correct import FILETYPES, Fixes, found_in, prose, small

KEPT = "lines array<string>, states array<string>"
FOUND = "row int, start int, stop int, w string, correction string"


class Buffer:
    """One document's lines, and the states before as many of them as are known."""

    def __init__(self, lines: list[str], states: list[str]):
        self.lines, self.states = lines, [State(*json.loads(s)) for s in states] or [State()]

    def edit(self, row: int, line: str | None) -> None:
        """Put in a line, or take one away (null); the states behind it are given up."""
        if line is None:
            del self.lines[row : row + 1]
        else:
            self.lines += [""] * (row + 1 - len(self.lines))
            self.lines[row] = line
        del self.states[row + 1 :]

    def before(self, row: int, markup: bool) -> State:
        for k in range(len(self.states) - 1, row):
            self.states.append(step(self.states[k], self.lines[k], k, markup)[0])
        return self.states[row]

    def corrections(self, row: int, filetype: str, fixes: Fixes) -> list[tuple]:
        """(row, start, stop, word, correction) of the words to correct in one line."""
        if row >= len(self.lines):
            return []
        line, markup = self.lines[row], filetype == "markdown"
        found = found_in(row, line, 0, len(line), fixes)
        if filetype == "text" or not found:
            return found
        if filetype not in FILETYPES or (markup and line.startswith(("    ", "\t"))):
            return []
        fine = prose(line, [f[1:3] for f in found])
        guarded = answers(self.before(row, markup), line, [f[2] for f in found], markup)
        return [f for f, ok, no in zip(found, fine, guarded, strict=True) if ok and not no]

    def kept(self) -> tuple:
        return self.lines, [json.dumps(astuple(s)) for s in self.states]


def corrections_of_edits(edits: DataFrame, catalog: DataFrame, correct_capitalized: bool = False, idle: str | None = None) -> DataFrame:
    """(doc_id, row, start, stop, w, correction) for a stream of (doc_id, filetype, seq, row, line).

    `seq` orders a document's edits within a micro-batch. Each edit is answered for its own line. The catalogue must be
    small enough for the workers; it is the one of the query's start.
    """
    fixes = small(catalog, correct_capitalized)
    if fixes is None:
        raise ValueError("the catalogue is too large for a stream of edits")
    kind = edits.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *T.StructType.fromDDL(FOUND).fields])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        buffer = Buffer(*(list(x) for x in state.get)) if state.exists else Buffer([], [])
        out = []
        for e in pd.concat(frames).sort_values("seq", kind="stable").itertuples(index=False):
            buffer.edit(int(e.row), e.line)
            if e.line is not None:
                out += buffer.corrections(int(e.row), e.filetype, fixes)
        state.update(buffer.kept())
        if idle is not None:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame([(key[0], *f) for f in out], columns=[f.name for f in schema.fields])

    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    rows = edits.select("doc_id", "filetype", "seq", "row", F.col("line"))
    return rows.groupBy("doc_id").applyInPandasWithState(run, schema, T.StructType.fromDDL(KEPT), "append", timeout)
