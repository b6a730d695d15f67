"""Correction of texts against a catalogue (typo, correction[, capitalized_ok])."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.batches import gathered, in_arrow, rows_of
from ..functions.columns import once
from ..functions.comments import comment_groups, known
from ..functions.scanner import bare, protected_words
from ..functions.text import is_lower, is_title, recapitalised, tokens

FILETYPES = ("markdown", "gitcommit")
#: Bytes, with what a row costs in memory, up to which a catalogue is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 160
#: What makes a string between blanks, brackets or quotes technical. Fixed rules.
TECHNICAL = r"://|\Awww\.|@|/|\A[A-Za-z]:\\|\A\.?\.?\\|\A~\\|[A-Za-z0-9_.\-]\\[A-Za-z0-9_.\-]"


def measured(catalog: DataFrame) -> tuple[int, int, int]:
    """(bytes, least, most) of a catalogue from a pass over it: its size in memory, and the lengths of its typos."""
    size, long_ = F.octet_length("typo") + F.octet_length("correction") + ROW_BYTES, F.octet_length("typo")
    none = F.lit(0)
    return tuple(int(x) for x in catalog.agg(F.coalesce(F.sum(size), none), F.coalesce(F.min(long_), none), F.coalesce(F.max(long_), none)).first())


def catalog_bytes(catalog: DataFrame) -> int:
    return measured(catalog)[0]


class Fixes:
    """A small catalogue as it lies in each worker's memory."""

    def __init__(self, rows, correct_capitalized: bool):
        self.to = {r["typo"]: r["correction"] for r in rows if r["typo"].isascii() and r["typo"].isalpha() and r["typo"].islower()}
        self.capital = {r["typo"] for r in rows if r["capitalized_ok"]} if correct_capitalized else frozenset()

    def get(self, w: str) -> str | None:
        found = self.to.get(w)
        if found is None and self.capital and w[:1].isupper() and w.isascii() and w[1:].islower() and w.isalpha():
            low = w.lower()
            if low in self.capital:
                found = self.to[low]
                found = found[:1].upper() + found[1:]
        return found

    def __contains__(self, w: str) -> bool:
        return self.get(w) is not None

    def __getitem__(self, w: str) -> str:
        return self.get(w)  # type: ignore[return-value]

    def __bool__(self) -> bool:
        return bool(self.to)


def small(catalog: DataFrame, correct_capitalized: bool) -> Fixes | None:
    """The catalogue itself if a pass over it proves it small, else nothing."""
    if catalog_bytes(catalog) > BROADCAST_BYTES:
        return None
    flag = F.col("capitalized_ok") if "capitalized_ok" in catalog.columns else F.lit(False).alias("capitalized_ok")
    return Fixes(catalog.select("typo", "correction", flag).where("typo IS NOT NULL AND correction IS NOT NULL").collect(), correct_capitalized)


def lookup(words: DataFrame, catalog: DataFrame, w: str = "w", correct_capitalized: bool = False) -> DataFrame:
    """Rows of `words` whose word has a correction, with it in `correction`.

    Lower-case words match as they are; words with one capital first only on request, and only entries that allow
    it. Everything else (upper or mixed case, digits, underscores, other letters) never matches.
    """
    size, least, most = measured(catalog)
    fits = F.octet_length(w).between(least, most)  # before the patterns, and before anything is shuffled
    key = F.when(fits & is_lower(w), F.col(w))
    if correct_capitalized:
        key = key.when(fits & is_title(w), F.lower(w))
    known = catalog.select(F.col("typo").alias("__key"), F.col("correction").alias("__to"), (F.col("capitalized_ok") if "capitalized_ok" in catalog.columns else F.lit(False)).alias("__cap"))
    met = once(words, __key=key).where("__key IS NOT NULL").join(F.broadcast(known) if size <= BROADCAST_BYTES else known, "__key")
    if correct_capitalized:
        met = met.where(is_lower(w) | F.col("__cap"))
    return met.withColumn("correction", F.when(is_title(w), recapitalised(F.col("__to"))).otherwise(F.col("__to"))).drop("__key", "__to", "__cap")


def word_table(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, pos, w): every token with its place from 1."""
    return docs.select(F.col(id_col), F.posexplode(tokens(F.col(text_col))).alias("p", "w")).select(id_col, (F.col("p") + 1).alias("pos"), "w")


def _with_fixes(docs: DataFrame, catalog: DataFrame, text_col: str, keep: list[str], correct_capitalized: bool, how: str) -> DataFrame:
    """keep + (t, fixes): the texts and the pairs (word, correction) for their words that the catalogue knows.

    Only distinct words leave the texts to meet the catalogue; what was found comes back as a small list.
    """
    id_col = keep[0]
    words = _distinct_words(docs.select(F.col(id_col), F.col(text_col)))
    fixes = lookup(words, catalog, "w", correct_capitalized).select(id_col, "w", "correction").distinct()
    lists = fixes.groupBy(F.col(id_col).alias("__id")).agg(F.map_from_entries(F.collect_list(F.struct("w", "correction"))).alias("fixes"))
    return docs.select(*keep, F.col(text_col).alias("t")).join(lists, F.col(id_col).eqNullSafe(F.col("__id")), how).select(*keep, "t", "fixes")


def _distinct_words(docs: DataFrame) -> DataFrame:
    """(id, w): the different words of each text that a catalogue may know, a-z but for a first capital."""
    schema = T.StructType([docs.schema[0], T.StructField("w", T.StringType())])
    arrow = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for key, text in rows_of(batches):
            for w in set(_WORD.findall(text or "")):
                if w.isascii() and w.isalpha() and (w.islower() or w[1:].islower()):
                    yield key, w

    return in_arrow(docs, lambda batches: gathered(rows(batches), arrow), schema)


def _texts(docs: DataFrame, catalog: DataFrame, text_col: str, keep: list[str], correct_capitalized: bool, how: str = "left") -> tuple[DataFrame, object]:
    """keep + (t, fixes), and what gives a row's fixes from that column.

    With a small catalogue the texts are read once and nothing is shuffled: fixes are null and the broadcast catalogue
    holds for each row. Beyond, only words leave the texts, and each text gets the map for its words.
    """
    own = small(catalog, correct_capitalized)
    if own is None:
        return _with_fixes(docs, catalog, text_col, keep, correct_capitalized, how), lambda fixes: dict(fixes) if fixes else {}
    shared = docs.sparkSession.sparkContext.broadcast(own)
    return docs.select(*keep, F.col(text_col).alias("t"), F.lit(None).cast("map<string,string>").alias("fixes")), lambda _: shared.value


def correct_text(docs: DataFrame, catalog: DataFrame, text_col: str = "text", id_col: str = "doc_id", correct_capitalized: bool = False) -> DataFrame:
    """(doc_id, n_fixed, corrected): whole texts with their words corrected, one pass, never parts of words."""
    both, fixes_of = _texts(docs, catalog, text_col, [id_col], correct_capitalized)
    schema = T.StructType([both.schema[id_col], T.StructField("n_fixed", T.LongType()), T.StructField("corrected", T.StringType())])

    arrow = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        # a map column is searched from end to end for each word; a dictionary is not
        for key, text, fixes in rows_of(batches):
            n, own = 0, fixes_of(fixes)
            if own and text:
                parts = _PARTS.split(text)
                hits = [k for k in range(1, len(parts), 2) if parts[k] in own]
                for k in hits:
                    parts[k] = own[parts[k]]
                n, text = len(hits), "".join(parts) if hits else text
            yield key, n, text

    return in_arrow(both, lambda batches: gathered(rows(batches), arrow, lambda r: len(r[2] or "")), schema)


# ---- context -----------------------------------------------------------------------------------------


def lines_of(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, row from 0, line)."""
    return docs.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\n")).alias("row", "line"))


def technical(token: Column) -> Column:
    """Whether the string around a word is an address or a path."""
    return token.rlike(TECHNICAL)


def in_link_destination(prefix: Column) -> Column:
    return prefix.rlike(r"\]\([^)]*\z")


def indented_code(line: Column) -> Column:
    return line.rlike(r"\A(    |\t)")


_WORD = re.compile(r"\w+")
#: Splits a text in what is between its words and, at odd places, the words.
_PARTS = re.compile(r"(\w+)")
_STRING = re.compile(r"[^\s()\[\]<>\"'`]+")
_TECHNICAL = re.compile(TECHNICAL)
_LINK = re.compile(r"\]\(|\)")


def prose(line: str, words: list[tuple[int, int]]) -> list[bool]:
    """For words (start, stop) of a line, in order: neither part of an address or path, nor in a link's destination.

    One walk over the line's strings and link marks, however many words there are.
    """
    out, strings, links = [], _STRING.finditer(line), _LINK.finditer(line)
    string, mark, technical_, in_link = next(strings, None), next(links, None), None, False
    for start, stop in words:
        while string and string.end() <= start:
            string, technical_ = next(strings, None), None
        if technical_ is None and string:
            technical_ = bool(_TECHNICAL.search(string[0]))
        while mark and mark.end() <= start:
            in_link, mark = mark[0] == "](", next(links, None)
        out.append(not (technical_ or in_link or line[stop : stop + 1] == "\\"))
    return out


def found_in(row: int, line: str, offset: int, stop: int, fixes) -> list[tuple[int, int, int, str, str]]:
    parts = _PARTS.split(line[offset:stop])
    hits = [k for k in range(1, len(parts), 2) if parts[k] in fixes]
    if not hits:
        return []
    at = list(accumulate(map(len, parts), initial=offset))
    return [(row, at[k], at[k + 1], parts[k], fixes[parts[k]]) for k in hits]


def _places(text: str, kind: str, fixes) -> Iterator[tuple[int, int, int, str, str]]:
    """(row, start, stop, word, correction) of the words to correct in one text."""
    lines = text.split("\n")
    if kind == "text":
        for row, line in enumerate(lines):
            yield from found_in(row, line, 0, len(line), fixes)
        return
    if kind not in FILETYPES:
        for group in comment_groups(lines, kind):
            yield from _in_comment(lines, group, fixes)
        return
    found = []
    for row, line in enumerate(lines):
        if kind == "markdown" and line.startswith(("    ", "\t")):
            continue
        own = found_in(row, line, 0, len(line), fixes)
        if own:
            found += [f for f, fine in zip(own, prose(line, [f[1:3] for f in own]), strict=True) if fine]
    if found:
        guarded = protected_words(lines, [(f[0], f[2]) for f in found], kind == "markdown")
        yield from (f for f, g in zip(found, guarded, strict=True) if not g)


def _in_comment(lines: list[str], group: list[tuple[int, int, int]], fixes) -> Iterator[tuple[int, int, int, str, str]]:
    """The words to correct in one comment of a source file: not those in a fence or code span of its own."""
    found, inner, cut = [], [], []
    for k, (row, start, stop) in enumerate(group):
        content = lines[row][start:stop]
        inner.append(bare(content))
        cut.append(start + len(content) - len(inner[-1]))
        own = found_in(row, lines[row], start, stop, fixes)
        if own:
            found += [(k, f) for f, fine in zip(own, prose(lines[row], [f[1:3] for f in own]), strict=True) if fine]
    guarded = protected_words(inner, [(k, f[2] - cut[k]) for k, f in found], False)
    yield from (f for (_, f), g in zip(found, guarded, strict=True) if not g)


def _open(catalog: DataFrame, overrides: DataFrame | None, bypass: DataFrame | None) -> DataFrame:
    """The catalogue without the user's own typos and those passed over."""
    for other in (overrides, bypass):
        if other is not None:
            catalog = catalog.join(other.select("typo").distinct(), "typo", "left_anti")
    return catalog


def corrections_in_context(docs: DataFrame, catalog: DataFrame, text_col: str = "text", id_col: str = "doc_id", filetypes: tuple[str, ...] | None = None, correct_capitalized: bool = False, overrides: DataFrame | None = None, bypass: DataFrame | None = None) -> DataFrame:
    """(id, row, start, stop, w, correction) of the words to correct in (id, filetype, text).

    `overrides` (typo, correction) are the user's own and win over the catalogue; typos in `bypass` stay as they are.
    Words in fences, code spans, tags, metadata and link destinations stay. In files of the languages that
    `functions.comments` knows, comments alone are corrected; files of other types are left as they are. `filetypes`
    narrows the types down.
    """
    picked = docs if filetypes is None else docs.where(F.col("filetype").isin(*filetypes))
    both, fixes_of = _texts(picked, _open(catalog, overrides, bypass), text_col, [id_col, "filetype"], correct_capitalized, "inner")
    schema = T.StructType([both.schema[id_col], *T.StructType.fromDDL("row int, start int, stop int, w string, correction string").fields])

    arrow = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for key, kind, text, fixes in rows_of(batches):
            own = fixes_of(fixes)
            if own and text and _handled(kind):
                for place in _places(text, kind, own):
                    yield key, *place

    return in_arrow(both, lambda batches: gathered(rows(batches), arrow), schema)


def _handled(kind: str | None) -> bool:
    return kind == "text" or kind in FILETYPES or known(kind)


def correct_in_context(docs: DataFrame, catalog: DataFrame, text_col: str = "text", id_col: str = "doc_id", filetypes: tuple[str, ...] | None = None, correct_capitalized: bool = False, overrides: DataFrame | None = None, bypass: DataFrame | None = None) -> DataFrame:
    """(id, corrected): texts with what `corrections_in_context` finds put in, in the same single pass."""
    both, fixes_of = _texts(docs, _open(catalog, overrides, bypass), text_col, [id_col, "filetype"], correct_capitalized)
    schema = T.StructType([both.schema[id_col], T.StructField("corrected", T.StringType())])

    def fixed(kind: str, text: str, fixes) -> str:
        lines, at = text.split("\n"), {}
        for row, start, stop, _, correction in _places(text, kind, fixes):
            at.setdefault(row, []).append((start, stop, correction))
        for row, places in at.items():
            parts, last = [], 0
            for start, stop, correction in sorted(places):
                parts += (lines[row][last:start], correction)
                last = stop
            lines[row] = "".join([*parts, lines[row][last:]])
        return "\n".join(lines)

    arrow = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for key, kind, text, fixes in rows_of(batches):
            own = fixes_of(fixes)
            yield key, fixed(kind, text, own) if own and text and _handled(kind) and (filetypes is None or kind in filetypes) else text

    return in_arrow(both, lambda batches: gathered(rows(batches), arrow, lambda r: len(r[1] or "")), schema)
