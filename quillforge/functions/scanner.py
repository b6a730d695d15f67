"""Line scanner for markup: which places of a document are code, tags, metadata or link destinations.

Each line is classified once (its markers, whether it may open a fence or name a link, its inline marks), and a table
says how a mark changes the mode. A document is a fold over its lines; the answer for a word depends on the earlier
lines and on its own line up to the word's end, and all words of a line are answered in one walk over it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, replace

_SHAPE = re.compile(r"(?P<lead>\s*(?:>\s*)*)(?P<item>(?:[-+*]\s+)?(?:[0-9]+[.)]\s+)?)(?P<run>`{3,}|~{3,})?", re.ASCII)
_MARKS = {True: re.compile(r"\\*(`+|[<>\"'])"), False: re.compile(r"\\*(`+)")}
_TAG = re.compile(r"</?[A-Za-z]")
_LABEL = re.compile(r"\[([^\]]+)\]:\s*")
_METADATA = re.compile("\ufeff?---\\s*\\Z"), re.compile(r"(?:---|\.\.\.)\s*\Z")
_LEADER = re.compile(r"\s*[/#!*\-]+\s?")
_QUOTED = re.compile(r"(?:\s*>\s?)+")

#: Mode and mark to the next mode; other marks change nothing. Modes: "" prose, "<" a tag, '<"' and "<'" a quoted
#: value in one, and a run of backticks a code span that ends with as many.
_TURNS = {("", "<"): "<", ("<", ">"): "", ("<", '"'): '<"', ("<", "'"): "<'", ('<"', '"'): "<", ("<'", "'"): "<"}


@dataclass(frozen=True)
class State:
    mode: str = ""
    fence: str = ""
    depth: int = 0
    metadata: bool = False
    expects_target: bool = False


class Line:
    """One line's classification; `end` cuts it behind a word."""

    def __init__(self, text: str, markup: bool):
        self.text, self.markup = text, markup
        m = _SHAPE.match(text)
        self.depth, self.body, self.run = m["lead"].count(">"), m.end("lead"), m["run"] or ""
        self.after_run = m.end()
        self._label = self._modes = None

    def second_tick(self) -> int:
        """Where a backtick follows the opening run: from there on it is no fence."""
        at = self.text.find("`", self.after_run) if self.run[:1] == "`" else -1
        return len(self.text) if at < 0 else at

    def label(self) -> tuple[bool, int]:
        """(footnote, where the target begins) of a link's definition; the place is -1 for other lines."""
        if self._label is None:
            m = _LABEL.match(self.text, self.body)
            self._label = (m[1][0] == "^", m.end()) if m else (False, -1)
        return self._label

    def target_end(self, start: int) -> int:
        """As far as what begins at `start` is one target: up to a blank, or in angle brackets up to their end."""
        blank = re.compile(r"\s").search(self.text, start)
        stop = blank.start() if blank else len(self.text)
        if self.text.startswith("<", start):
            close = self.text.find(">", start)
            stop = max(stop, len(self.text) if close < 0 else close)
        return stop

    def modes(self, mode: str) -> tuple[list[int], list[str]]:
        """Ends of the inline marks, and the mode behind each, beginning with `mode`."""
        if self._modes is None or self._modes[0] != mode:
            ends, found, now = [], [], mode
            for m in _MARKS[self.markup].finditer(self.text):
                mark, escaped = m[1], (m.start(1) - m.start()) % 2 == 1
                if mark[0] == "`":
                    if now == mark:
                        now = ""
                    elif not now and not escaped:
                        now = mark
                elif mark != "<" or now or (not escaped and _TAG.match(self.text, m.start(1))):
                    now = _TURNS.get((now, mark), now)
                ends.append(m.end())
                found.append(now)
            self._modes = (mode, ends, found)
        return self._modes[1], self._modes[2]

    def entered(self, state: State) -> State:
        """The state at the line's begin: a fence ends with its block quote."""
        return replace(state, fence="", mode="") if state.fence and self.depth < state.depth else state

    def opens_fence(self, state: State) -> bool:
        return bool(self.run) and not state.mode


def inline(mode: str, text: str, markup: bool) -> str:
    """The mode after the code spans, and for markup also the tags, of one line."""
    return [mode, *Line(text, markup).modes(mode)[1]][-1]


def block(state: State, text: str, markup: bool) -> tuple[State, bool, bool]:
    """(next state, protected, inside a fence) at the end of one line without document rules."""
    line = Line(text, markup)
    state = line.entered(state)
    if state.fence:
        closes = line.run[:1] == state.fence[0] and len(line.run) >= len(state.fence) and not text[line.after_run :].strip()
        return (State(), True, False) if closes else (state, True, True)
    if line.opens_fence(state) and line.second_tick() == len(text):
        return State(fence=line.run, depth=line.depth), True, False
    if state.mode[:1] != "<" and not text.strip():
        return State(), False, False
    mode = [state.mode, *line.modes(state.mode)[1]][-1]
    return State(mode=mode), bool(mode), False


def step(state: State, text: str, row: int, markup: bool) -> tuple[State, bool, bool]:
    """(next state, protected, inside a fence) at the end of a line of a document."""
    if markup and row == 0 and _METADATA[0].match(text):
        return State(metadata=True), True, False
    if state.metadata:
        return State(metadata=not _METADATA[1].match(text)), True, False
    after, protected, fenced = block(state, text, markup)
    if markup and not state.fence and not state.mode:
        line = Line(text, markup)
        footnote, start = line.label()
        if start >= 0 and not footnote:
            after = replace(after, expects_target=start == len(text))
        elif start < 0 and state.expects_target:
            start = line.body
        if start >= 0 and not footnote:
            protected = protected or line.target_end(start) == len(text)
    return after, protected, fenced


def answers(state: State, text: str, ends: list[int], markup: bool) -> list[bool]:
    """For words of one line that end at `ends`, whether the line up to there ends in a protected place."""
    if state.metadata:
        return [True] * len(ends)
    line = Line(text, markup)
    inner = line.entered(state)
    if inner.fence or (line.opens_fence(inner) and line.run[0] == "~"):
        return [True] * len(ends)
    until = line.second_tick() if line.opens_fence(inner) else 0  # so far a fence may have been opened
    start = stop = -1
    if markup and not state.fence and not state.mode:
        footnote, start = line.label()
        if footnote:
            start = stop = len(text)
        else:
            stop = line.target_end(start) if start >= 0 else -1
    first = line.target_end(line.body) if markup and state.expects_target and not state.fence and not state.mode else -1
    marks, modes = line.modes(inner.mode)
    out = []
    for end in ends:
        k = bisect_right(marks, end) - 1
        named = start >= 0 and end >= start
        target = (start < end <= stop) if named else (end <= first)
        out.append(end <= until or target or bool(modes[k] if k >= 0 else inner.mode))
    return out


def protected_words(lines: list[str], words: list[tuple[int, int]], markup: bool) -> list[bool]:
    """For words (row, end) in order of rows: whether the place at their end is protected."""
    out: list[bool] = []
    state, row, k = State(), 0, 0
    while k < len(words):
        at, last = words[k][0], k
        while last < len(words) and words[last][0] == at:
            last += 1
        while row < at:
            state, row = step(state, lines[row], row, markup)[0], row + 1
        out += answers(state, lines[at], [end for _, end in words[k:last]], markup)
        k = last
    return out


def bare(line: str) -> str:
    """A comment's line without quote markers and leaders, in front of which blanks keep the places."""
    quotes = _QUOTED.match(line)
    at = quotes.end() if quotes else 0
    leader = _LEADER.match(line, at)
    return line[leader.end() if leader else at :]


def comment_protected(lines: list[str]) -> bool:
    """Whether the end of a comment's lines, without their leaders, is in code."""
    state, protected = State(), False
    for line in lines:
        state, protected, _ = block(state, bare(line), False)
    return protected
