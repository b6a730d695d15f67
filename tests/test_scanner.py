import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillforge.functions.comments import comment_groups
from quillforge.functions.scanner import State, comment_protected, inline, protected_words, step


def test_code_spans_close_with_their_own_length():
    assert inline("", "a ``b ` c", True) == "``"
    assert inline("``", "d`` e", True) == ""
    assert inline("", "\\`a", True) == ""
    assert inline("", "\\\\`a", True) == "`"


def test_tags_only_in_markup():
    assert inline("", '<a href=">', True) == '<"'
    assert inline("", '<a href=">', False) == ""
    assert inline("", "a < b", True) == ""


def test_comment_leaders():
    assert comment_protected(["// ```", "// code"])
    assert not comment_protected(["// ```", "// code", "// ```", "// prose"])
    assert not comment_protected([" * plain"])


LINES = st.lists(st.text(alphabet="ab `<>\"'\\~[]:-.^#1\t", max_size=24), max_size=8)


def words_in(lines):
    return [(r, m + 1) for r, line in enumerate(lines) for m, c in enumerate(line) if c in "ab" and (m + 1 == len(line) or line[m + 1] not in "ab1")]


@settings(max_examples=400, deadline=None)
@given(LINES, st.booleans())
def test_quick_answers_equal_those_of_the_prefix(lines, markup):
    """The answer for a word is that of a fold whose last line ends with the word."""
    words, want, state, row = words_in(lines), [], State(), 0
    for r, end in words:
        while row < r:
            state, row = step(state, lines[row], row, markup)[0], row + 1
        want.append(step(state, lines[r][:end], r, markup)[1])
    assert protected_words(lines, words, markup) == want


def slowly(text, markup):
    """Whether the end of a text is protected: the rules once more, letter by letter, without lines kept or modes named."""
    fence = None  # (letter, length, block quotes)
    ticks, tag, quote, metadata, target = 0, False, "", False, False
    protected = False
    for row, line in enumerate(text.split("\n")):
        if metadata or (markup and row == 0 and re.fullmatch("\ufeff?---\\s*", line)):
            metadata, protected = not (metadata and re.fullmatch(r"(---|\.\.\.)\s*", line)), True
            ticks, tag, quote, fence, target = 0, False, "", None, False
            continue
        body, depth = line.lstrip(), 0
        while body.startswith(">"):
            body, depth = body[1:].lstrip(), depth + 1
        plain = fence is None and not ticks and not tag
        inner = re.sub(r"^[0-9]+[.)]\s+", "", re.sub(r"^[-+*]\s+", "", body))
        run = re.match(r"`{3,}|~{3,}", inner)
        if fence and depth < fence[2]:
            fence, ticks = None, 0
        waited, target = target, False
        if fence:
            protected = True
            if run and run[0][0] == fence[0] and len(run[0]) >= fence[1] and not inner[run.end() :].strip():
                fence = None
        elif run and not ticks and not tag and not (run[0][0] == "`" and "`" in inner[run.end() :]):
            fence, protected = (run[0][0], len(run[0]), depth), True
        elif not tag and not line.strip():
            ticks, quote, protected = 0, "", False
        else:
            k = 0
            while k < len(line):
                slashes = len(line[:k]) - len(line[:k].rstrip("\\"))
                c, n = line[k], 1
                if markup and tag:
                    if quote:
                        quote = "" if c == quote else quote
                    elif c in "\"'":
                        quote = c
                    elif c == ">":
                        tag = False
                elif c == "`":
                    n = len(line[k:]) - len(line[k:].lstrip("`"))
                    if ticks == n:
                        ticks = 0
                    elif not ticks and slashes % 2 == 0:
                        ticks = n
                elif markup and c == "<" and not ticks and slashes % 2 == 0 and re.match("</?[A-Za-z]", line[k:]):
                    tag = True
                k += n
            protected = bool(ticks or tag)
        if markup and plain:
            label = re.match(r"\[([^\]]+)\]:\s*", body)
            rest = None
            if label and label[1][0] != "^":
                rest = body[label.end() :]
                target = not rest
            elif waited and not label:
                rest = body
            if rest is not None and (not re.search(r"\s", rest) or (rest[0] == "<" and ">" not in rest)):
                protected = True
    return protected


@settings(max_examples=600, deadline=None)
@given(LINES, st.booleans())
def test_answers_equal_those_of_the_plain_rules(lines, markup):
    words = words_in(lines)
    assert protected_words(lines, words, markup) == [slowly("\n".join([*lines[:r], lines[r][:end]]), markup) for r, end in words]


@pytest.mark.parametrize("unit", ["[", "](", "definately,", "`a` ", "<a ", "[a]: ", "> ", "``` ", "a/b ", "(definately) ", "\\`", "~~~"])
def test_a_megabyte_in_one_line_takes_no_time(unit):
    from quillforge.operators.correct import _places

    line = "".join(f"{unit}definately " for _ in range(1_000_000 // (len(unit) + 11)))
    for text in (line, "[" + line, unit * (1_000_000 // len(unit)) + " definately"):
        for kind in ("markdown", "gitcommit", "lua"):
            began = time.perf_counter()
            list(_places(text, kind, {"definately": "definitely"}))
            assert time.perf_counter() - began < 8, (unit, kind)


def test_comments_of_languages():
    def found(text, kind):
        lines = text.split("\n")
        return [[lines[r][a:b] for r, a, b in g] for g in comment_groups(lines, kind)]

    assert found('x = "// no" // yes\n// more\ny /* a\nb */ z', "c") == [["// yes"], ["// more"], ["/* a", "b */"]]
    assert found("// a\n  // b\nx // c\n// d\n/* e\n f */\n// g", "c") == [["// a", "  // b"[2:]], ["// c"], ["// d", "/* e", " f */", "// g"]]
    assert found("s = '# no' # yes\nt = \"\"\"\n# no\n\"\"\"\n# other", "python") == [["# yes"], ["# other"]]
    assert found("-- one\nlocal s = [[ -- no ]] --[[ two\nthree ]] x", "lua") == [["-- one"], ["--[[ two", "three ]]"]]
    assert found("<p>a</p><!-- b\nc --> d", "html") == [["<!-- b", "c -->"]]
    assert found("SELECT '--no' -- yes", "sql") == [["-- yes"]]
    assert found("anything # here", "unknown kind") == []
    assert found("char c = '\"'; // yes\nchar *s = \"a\\\" // no\";", "c") == [["// yes"]]
