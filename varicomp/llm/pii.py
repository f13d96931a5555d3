"""Personal data, also in disguise, with spans in the source text.

Base detectors run on the text as it is. Then transducers write a normal form: the first maps homoglyphs to ASCII and
drops invisible characters; the second, in steps that each see the last one's output, turns bracketed at/dot to the signs,
then plain ones, then spelled digits to digits, in runs of any length and mixed with digits. Each keeps, for every
character of its output, the span of input it stands for. The detectors run on the normal form as well, then on the forms
before it, and what they find is mapped back; a find that no base or earlier span of its kind covers is added.

Null texts are empty. Each row gives one row; repeated rows and null ids are kept. Other columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, small_batches

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A start within a run of digits can match only if the start of the run does, so runs are tried once.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LONG = re.compile(r"[0-9](?:[\x20-]?[0-9]){13}")
_DOTTED = re.compile(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")

# Characters that look like ASCII ones, by the Unicode standard's list of confusables.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "һ": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Ζ": "Z", "ı": "i", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ",
}
_INVISIBLE = "­​‌‍⁠﻿"
_DIGITS = {w: str(k) for k, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}


def _homoglyphs() -> dict[str, str]:
    """The look-alikes, invisible characters, full-width forms, and the mathematical and other decimal digits."""
    out = dict(_LOOKALIKES) | dict.fromkeys(_INVISIBLE, "")
    out |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
    for first in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):
        out |= {chr(first + d): str(d) for d in range(10)}
    return out


_GLYPHS = _homoglyphs()
_GLYPH = re.compile("[" + "".join(map(re.escape, _GLYPHS)) + "]")
_WORD = "(?:" + "|".join(_DIGITS) + ")"
_TOKEN = re.compile(rf"\b(?:(plus)|(?:(double|triple)[\x20-]+)?({_WORD}))\b|[0-9]+", re.I)
_SPELLED_CUE = re.compile(rf"\b(?:{_WORD}|plus)\b|[0-9][\x20-]+dot[\x20-]", re.I)
_GAP = re.compile(r"[\x20().-]+")
_GAP_DOT = re.compile(r"[\x20-]+dot[\x20-]+", re.I)
_BRACKETED = re.compile(r"(?:(?<!\s)\s++)?[\[({<]\s*+(?:(at)|(dot))\s*+[\])}>]\s*+", re.I)
#: Takes in a whole chain of names and dots, an address or not, so that no part of it is tried again.
_PLAIN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20++dot\x20++[A-Za-z0-9._%+-]++)*+(?:(\x20++at\x20++)|@)?+((?:(?<=@)|(?<=\x20))[A-Za-z0-9-]++(?:(?:\.|\x20++dot\x20++)[A-Za-z0-9-]++)++)?+", re.I)
_PLAIN_DOT = re.compile(r"\x20++dot\x20++", re.I)
_PLAIN_CUE = re.compile(r"@| at ", re.I)


def _luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(t - 9 * (t > 9) for t in twice)) % 10 == 0


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base detectors, code points."""
    found = []
    at, last = text.find("@"), 0
    while at >= 0:
        a = at
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((a, m.end(), "email"))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if _DOTTED.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:] or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), m.end(), "ip"))
    if _LONG.search(text):
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return found


Edits = list[tuple[int, int, str]]


class Rewritten:
    """A text after edits, and where each of its characters comes from."""

    def __init__(self, text: str, edits: Edits):
        parts, self.at, self.source, self.width, done, n = [], [], [], [], 0, 0
        for a, b, new in edits:
            for piece, start, width in ((text[done:a], done, 0), (new, a, b - a)):
                if piece:
                    self.at.append(n), self.source.append(start), self.width.append(width)
                    parts.append(piece)
                    n += len(piece)
            done = b
        self.at.append(n), self.source.append(done), self.width.append(0)
        self.text = "".join([*parts, text[done:]])

    def back(self, a: int, b: int) -> tuple[int, int]:
        """The span of the input that output characters a to b - 1 stand for."""
        k, j = bisect_right(self.at, a) - 1, bisect_right(self.at, b - 1) - 1
        start = self.source[k] + (0 if self.width[k] else a - self.at[k])
        end = self.source[j] + (self.width[j] or b - self.at[j])
        return start, end


def glyph_edits(text: str) -> Edits:
    return [] if text.isascii() else [(m.start(), m.end(), _GLYPHS[m[0]]) for m in _GLYPH.finditer(text)]


def bracket_edits(text: str) -> Edits:
    return [(m.start(), m.end(), "@" if m[1] else ".") for m in _BRACKETED.finditer(text)]


def sign_edits(text: str, before: Rewritten | None) -> Edits:
    """at and dot in e-mail addresses; before is the rewriting that made text. An at before a plain domain is a word."""
    edits: Edits = []
    if not _PLAIN_CUE.search(text) or not (before or _PLAIN_DOT.search(text)):
        return edits
    for m in _PLAIN.finditer(text):
        if not m[2]:
            continue
        dots = [(x.start(), x.end(), ".") for x in _PLAIN_DOT.finditer(text, m.start(), m.end())]
        if m[1] and not dots:
            a, b = before.back(m.start(), m.end()) if before else m.span()
            if b - a == m.end() - m.start():
                continue
        edits += sorted([*dots, (m.start(1), m.end(1), "@")] if m[1] else dots)
    return edits


def digit_edits(text: str) -> Edits:
    """Spelled digits that stand next to digits of any form, and dot between digits. Whether they are a number is left to the detectors."""
    edits: Edits = []
    if not _SPELLED_CUE.search(text):
        return edits
    last, pending = None, False  # pending: the last token is spelled and not yet written
    for m in _TOKEN.finditer(text):
        if last is not None:
            a, b = last.end(), m.start()
            dot = not last[1] and not m[1] and _GAP_DOT.fullmatch(text, a, b)
            if dot or _GAP.fullmatch(text, a, b):
                if pending:
                    edits.append((last.start(), a, _digits_of(last)))
                if dot:
                    edits.append((a, b, "."))
                elif not text[a:b].strip(" -") and (last[1] or last[3] or m[3]):
                    both = last[1] or (last[3] and m[3])
                    if both or b - a > 1:
                        edits.append((a, b, "" if both else " "))
                if m[1] or m[3]:
                    edits.append((m.start(), m.end(), _digits_of(m)))
                last, pending = m, False
                continue
        last, pending = m, bool(m[1] or m[3])
    return edits


def _digits_of(m: re.Match) -> str:
    return "+" if m[1] else _DIGITS[m[3].lower()] * {"double": 2, "triple": 3}.get((m[2] or "").lower(), 1)


def find(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans: the base ones and those that the normal form shows beyond what is found already.

    A span of the normal form may overlap a base one, of which a disguise hid a part.
    """
    base = detect(text)
    steps: list[Rewritten] = []
    plain, brackets = text, None
    for edits_of in (glyph_edits, bracket_edits, lambda t: sign_edits(t, brackets), digit_edits):
        if edits := edits_of(plain):
            steps.append(Rewritten(plain, edits))
            plain = steps[-1].text
        if edits_of is bracket_edits and edits:
            brackets = steps[-1]
    if not steps:
        return base, base
    taken = {k: sorted(x[:2] for x in base if x[2] == k) for k in KINDS}  # apart from each other, by kind; unions of what is found
    more = list(base)
    for last in range(len(steps), 0, -1):
        for a, b, kind in detect(steps[last - 1].text):
            for step in reversed(steps[:last]):
                a, b = step.back(a, b)
            spans = taken[kind]
            at = bisect_left(spans, (a + 1,)) - 1  # the last that does not begin after a
            if at >= 0 and spans[at][1] >= b:
                continue
            more.append((a, b, kind))
            lo = at if at >= 0 and spans[at][1] > a else at + 1
            hi = bisect_left(spans, (b,), lo)
            met = [(a, b), *spans[lo:hi]]
            spans[lo:hi] = [(min(x for x, _ in met), max(y for _, y in met))]
    return base, more


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            base, spans = find(text or "")
            n = [sum(s[2] == k for s in base) for k in KINDS]
            rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans) - len(base)))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 7
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[*batch.schema.names[:-1], *names])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id; n_email, n_ip, n_card, n_phone and base_sha256 of the base spans; spans (kind:start:end) of all; n_added."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(text: str) -> str:
    """The text with each span, or union of overlapping ones, replaced by <KIND> of its first."""
    out, done = [], 0
    for a, b, kind in sorted(find(text)[1], key=lambda s: (s[0], KINDS.index(s[2]))):
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]]) if out else text


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.num_columns - 1
        text = pa.array([t and masked(t) for t in batch.column(at).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], text], names=batch.schema.names)


def without_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data masked in the text; all columns in their order."""
    small_batches(docs.sparkSession)
    last = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.col(f"`{text_col}`").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in last.schema)
    return map_arrow(last, _mask, schema).select(*[F.col(f"`{c}`") for c in docs.columns])
