"""Comments of source files, by a small lexer for each family of languages.

A lexer knows how line comments and block comments begin, and what strings look like, so that a comment's mark in a
string is none. That is far less than a parser; what it can't tell is left out, and so never corrected.
"""

from __future__ import annotations

import re
from functools import cache

_C = (("//",), (("/*", "*/"),), ('"', "'"))
_HASH = (("#",), (), ('"', "'"))
#: For each family its line marks, block marks and quotes; a quote of more than one letter may run over lines.
FAMILIES = {
    "c": _C,
    "script": (("//",), (("/*", "*/"),), ("`", '"', "'")),
    "python": (("#",), (), ('"""', "'''", '"', "'")),
    "hash": _HASH,
    "lua": (("--",), (("--[[", "]]"),), ("[[", '"', "'")),
    "sql": (("--",), (("/*", "*/"),), ('"', "'")),
    "haskell": (("--",), (("{-", "-}"),), ('"',)),
    "lisp": ((";",), (("#|", "|#"),), ('"',)),
    "tex": (("%",), (), ()),
    "markup": ((), (("<!--", "-->"),), ()),
    "style": ((), (("/*", "*/"),), ('"', "'")),
}
#: File types of each family.
FILETYPES = {
    "c": ("c", "cpp", "objc", "java", "cs", "go", "rust", "swift", "kotlin", "scala", "php", "dart", "zig"),
    "script": ("javascript", "typescript", "javascriptreact", "typescriptreact"),
    "python": ("python",),
    "hash": ("sh", "bash", "zsh", "fish", "ruby", "perl", "yaml", "toml", "conf", "make", "cmake", "dockerfile", "r", "elixir", "nix", "gitconfig"),
    "lua": ("lua",),
    "sql": ("sql", "plsql"),
    "haskell": ("haskell", "elm"),
    "lisp": ("lisp", "scheme", "clojure", "racket"),
    "tex": ("tex", "plaintex", "matlab", "erlang"),
    "markup": ("html", "xml", "svg", "vue"),
    "style": ("css", "scss", "less"),
}
_FAMILY = {kind: family for family, kinds in FILETYPES.items() for kind in kinds}
_OVER_LINES = {'"""': '"""', "'''": "'''", "[[": "]]", "`": "`"}


def known(filetype: str | None) -> bool:
    return filetype in _FAMILY


@cache
def _lexer(family: str) -> re.Pattern:
    """One pattern whose named groups say what begins: a block comment, a line comment, or a string with its end."""
    lines, blocks, quotes = FAMILIES[family]
    longest = lambda words: "|".join(re.escape(w) for w in sorted(set(words), key=len, reverse=True))
    parts = []
    if blocks:
        parts.append(f"(?P<block>{longest(b for b, _ in blocks)})")
    if lines:
        parts.append(f"(?P<line>{longest(lines)})")
    if quotes:
        parts.append(f"(?P<quote>{longest(quotes)})")
    return re.compile("|".join(parts))


def comment_groups(lines: list[str], filetype: str) -> list[list[tuple[int, int, int]]]:
    """Comments as lists of (row, start, stop): those that begin consecutive rows are one."""
    family = _FAMILY.get(filetype)
    if family is None:
        return []
    lexer, ends, found = _lexer(family), dict(FAMILIES[family][1]), []
    waits, in_comment = "", False  # the mark that ends a block comment or a string over lines
    for row, line in enumerate(lines):
        at = 0
        while at <= len(line):
            if waits:
                stop = line.find(waits, at)
                after = len(line) if stop < 0 else stop + len(waits)
                if in_comment:
                    found.append((row, at, after, True))
                if stop < 0:
                    break
                at, waits, in_comment = after, "", False
                continue
            m = lexer.search(line, at)
            if not m:
                break
            if m.lastgroup == "line":
                found.append((row, m.start(), len(line), False))
                break
            if m.lastgroup == "block":
                waits, in_comment = ends[m[0]], True
                stop = line.find(waits, m.end())
                after = len(line) if stop < 0 else stop + len(waits)
                found.append((row, m.start(), after, False))
                if stop < 0:
                    break
                at, waits, in_comment = after, "", False
            elif m[0] in _OVER_LINES:
                at, waits = m.end(), _OVER_LINES[m[0]]
            else:  # a string of one line; left open, it ends with the line
                closed = _closing(m[0]).search(line, m.end())
                at = closed.end() if closed else len(line) + 1
    groups: list[list[tuple[int, int, int]]] = []
    opens_row = False  # whether the last group's last piece is the first thing in its row
    for row, start, stop, goes_on in found:
        opens = goes_on or not lines[row][:start].strip()
        if goes_on or (groups and opens and opens_row and row == groups[-1][-1][0] + 1):
            groups[-1].append((row, start, stop))
        else:
            groups.append([(row, start, stop)])
        opens_row = opens
    return groups


@cache
def _closing(quote: str) -> re.Pattern:
    return re.compile(rf"(?:[^\\{quote}]|\\.)*{quote}")
