"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in the whole text, in any case of ASCII letters: at-signs, plus signs, digits,
schemes and identifier cues ("iban", "ssn", "account no", "token" and the like). Each anchor is expanded by a
deterministic local parser that looks only at the run of characters around it and validates what it found; no run is
read again from each anchor in it, so that the time is proportional to the text:

* base kinds, exactly the leftmost non-overlapping matches of fixed patterns over the text: `email`, `ip` (parts at
  most 255), `card` (12 to 19 digits, Luhn), `phone` (9 to 15 digits); a match that fails validation is dropped
  without a retry;
* kinds that the anchors add: `url` (a scheme's address that carries user information, or a `mailto:`),
  `iban` (after its cue or not, checksum modulo 97), `account` (6 to 20 digits, letters or separators with at
  least 6 digits after a cue), `secret` (what is assigned to a cue such as "token" or "api_key": 8 characters or more,
  letters as well as digits, or 20 or more).

Spans are code-point offsets, end exclusive, ordered by start and then by kind in the order of `KINDS`.

Edge cases: null is an empty text and has no spans (masking leaves it null); spans of several kinds may overlap,
and masking replaces each overlapping group once, by the label of its first span; repeated rows are handled row by
row; other columns, whatever their names, pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, in_arrow

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "account", "secret")

LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMERIC_RUN = re.compile(r"[0-9][0-9.\x20-]*")

SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "mailto:")
CUES = ("iban", "ssn", "social security", "passport", "account", "acct", "konto", "cuenta", "compte")
SECRETS = ("token", "secret", "password", "passwd", "pwd", "api_key", "api-key", "apikey", "api key", "access key", "access_key", "private key", "private_key", "bearer")
URL_WITH_USER = re.compile(r"(?:https?|s?ftp|ssh)://[^\s/@\"'<>]+@[^\s\"'<>]+", re.IGNORECASE)
MAIL_RUN = re.compile(r"[^\s@\"'<>]*")
MAIL_REST = re.compile(r"@[^\s\"'<>]+")
ASSIGNED = re.compile(r"[\"']?\s{0,2}(?::=|=>|[:=])\s{0,2}[\"']?([A-Za-z0-9_./+-]+={0,2})")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b")
ACCOUNT = re.compile(r"(?:\x20?(?:no|nr|num|number|id|#))?\.?[\x20:#=]{0,3}([A-Z0-9](?:[\x20-]?[A-Z0-9]){5,19})(?![A-Za-z0-9])", re.IGNORECASE | re.ASCII)

DETAIL = "struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base_sha256:string,spans:string,n_spans:bigint,masked:string>"
FIELDS = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "masked")
_WORDISH = re.compile(r"[A-Za-z0-9_]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    x = text.replace(" ", "")
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def automaton():
    """Anchors of lower-cased texts: ("at" | "plus" | "digit" | "scheme" | "cue" | "secret", length)."""
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    for kind, words in (("scheme", SCHEMES), ("cue", CUES), ("secret", SECRETS)):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


_LOWER = {k: k + 32 for k in range(65, 91)}


def lowered(text: str) -> str:
    """`text` in lower case, letter by letter at its place."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_LOWER)


def spans_of(text: str, anchors) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of a text, ordered."""
    found: list[tuple[int, int, str]] = []
    email_end = phone_end = run_end = url_end = mail_end = 0
    for at, (what, size) in anchors.iter(lowered(text)):
        start = at - size + 1
        if what == "digit":
            if at < run_end:
                continue
            run = NUMERIC_RUN.match(text, at)
            run_end = run.end()
            if run_end - at >= 7:
                _numbers(text, at, run_end, found)
            if at > 1 and text[at - 1].isupper() and text[at - 2].isupper():
                _iban(text, at, found)
        elif what == "at":
            local = LOCAL_PART.search(text, _left(text, at, email_end), at)
            domain = local and DOMAIN.match(text, at + 1)
            if domain:
                found.append((local.start(), domain.end(), "email"))
                email_end = domain.end()
        elif what == "plus":
            m = PHONE.match(text, at) if at >= phone_end else None
            if m:
                phone_end = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((at, m.end(), "phone"))
        elif what == "scheme":
            if start < url_end:
                continue
            if size == 7:  # mailto: all such anchors in a run share its end
                if at >= mail_end:
                    mail_end = MAIL_RUN.match(text, at + 1).end()
                m = MAIL_REST.match(text, mail_end) if mail_end > at + 1 else None
            else:
                m = URL_WITH_USER.match(text, start)
            if m:
                url_end = m.end()
                found.append((start, url_end, "url"))
        elif what == "secret":
            _assigned(text, start, at + 1, found)
        else:
            _after_cue(text, start, at + 1, found)
    if len(found) > 1:
        ibans = [s for s in found if s[2] == "iban"]
        if ibans:  # more than an account
            found = [s for s in found if s[2] != "account" or not any(s[0] < b and a < s[1] for a, b, _ in ibans)]
        found = sorted(set(found), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return found


def _left(text: str, at: int, least: int) -> int:
    """Where the run of local-part characters before an at-sign begins, no earlier than `least`."""
    k = at
    while k > least and (c := text[k - 1]) < "\x80" and (c.isalnum() or c in "._%+-"):
        k -= 1
    return k


def _numbers(text: str, a: int, b: int, found: list) -> None:
    """Addresses and cards of one run of digits, dots, blanks and hyphens; no match leaves such a run."""
    if text.find(".", a, b) >= 0:
        for m in IP.finditer(text, a, b):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                found.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text, a, b):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))


def _iban(text: str, a: int, found: list) -> None:
    """An account whose check digits begin at `a`, after its two letters."""
    begin = a
    while begin > 0 and a - begin < 2 and text[begin - 1].isascii() and text[begin - 1].isupper():
        begin -= 1
    if a - begin == 2 and (m := IBAN.match(text, begin)):
        for end in range(m.end(), begin + 14, -1):  # a following word may look like more of it
            if end == m.end() or not text[end].isalnum():
                if iban_valid(text[begin:end]):
                    found.append((begin, end, "iban"))
                    break


def _after_cue(text: str, a: int, b: int, found: list) -> None:
    if (a and _WORDISH.match(text[a - 1])) or (b < len(text) and _WORDISH.match(text[b])):
        return
    m = ACCOUNT.match(text, b)
    if m and sum(c.isdigit() for c in m[1]) >= 6:
        found.append((m.start(1), m.end(1), "account"))


def _assigned(text: str, a: int, b: int, found: list) -> None:
    if a and text[a - 1].isalnum():
        return
    m = ASSIGNED.match(text, b)
    if m and len(m[1]) >= 8 and (len(m[1]) >= 20 or (any(c.isdigit() for c in m[1]) and any(c.isalpha() for c in m[1]))):
        found.append((m.start(1), m.end(1), "secret"))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def mask(text: str, spans) -> str:
    parts, last = [], 0
    for a, b, kind in spans:
        if a >= last:
            parts += (text[last:a], f"<{kind.upper()}>")
            last = b
        elif b > last:
            last = b
    parts.append(text[last:])
    return "".join(parts)


_NONE = hashlib.sha256(b"").hexdigest()


def report(text: str | None, anchors, masked: bool) -> tuple:
    spans = spans_of(text, anchors) if text else []
    if not spans:
        return 0, 0, 0, 0, _NONE, "", 0, None
    base = [s for s in spans if s[2] in BASE_KINDS]
    count = [sum(s[2] == k for s in base) for k in BASE_KINDS]
    return (*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans), mask(text, spans) if masked else None)


def find_private(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, masked: bool = True) -> DataFrame:
    """`docs` with a struct column `private` (underscores before it if taken): counts, digest, spans, masked text.

    `masked` is null where nothing was found. `keep` names the columns of `docs` to return, all by default.
    """
    name, text = fresh(docs, "private"), fresh(docs, "scanned")
    keep = list(docs.columns) if keep is None else keep
    whole = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(text))
    schema = T.StructType(whole.schema.fields[:-1]).add(name, T.StructType.fromDDL(f"x {DETAIL}")["x"].dataType)
    kinds = pa.struct([(f, pa.int64() if f.startswith("n_") else pa.string()) for f in FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            n = batch.num_columns - 1
            made = [dict(zip(FIELDS, report(x.as_py(), anchors, masked), strict=True)) for x in batch.column(n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(made, kinds)], names=schema.names)

    return in_arrow(whole, run, schema)
