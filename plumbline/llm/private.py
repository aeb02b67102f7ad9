"""Personal data in texts, plain and disguised, with the places it has in the source.

A transducer rewrites disguises (look-alike characters, spelled digits, "[at]" and "dot") and notes for each character it writes which
source characters it stands for. The same patterns that find plain identifiers then run over the rewritten text, and a find is mapped back to
the source. Plain finds always stay; a find of the rewritten text is added where something in it was disguised and no plain one of its kind
overlaps it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slices, texts_of

KINDS = ("email", "ip", "card", "phone")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that fails as the first part fails from each of its digits, so only its first is tried.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Characters of other scripts that look like a Latin letter.
LOOKALIKES = dict(zip("аеорсухіјѕԁһӏԛԝАВЕКМНОРСТУХІЈЅαορνιΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhlqwABEKMHOPCTYXIJSaopviABEZHIKMNOPTYX", strict=True))
DIGIT_WORDS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
SIGN_WORDS = {"plus": "+", "dash": "-", "hyphen": "-", "underscore": "_"}
UNSEEN = "­​‌‍⁠﻿"


def _wide() -> dict[str, str]:
    """Characters whose compatibility form is one ASCII letter, digit or sign of an identifier: full-width, mathematical, circled."""
    ranges = [(0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x2460, 0x24EA), (0x2070, 0x209D), (0xFE50, 0xFE6C), (0x2024, 0x2025), (0x2010, 0x2012)]
    out = {}
    for a, b in ranges:
        for c in map(chr, range(a, b)):
            plain = unicodedata.normalize("NFKC", c).replace("‐", "-")
            if len(plain) == 1 and plain.isascii() and (plain.isalnum() or plain in "@.+-_%()"):
                out[c] = plain
    return out


CHARACTERS = _wide() | LOOKALIKES | dict.fromkeys(UNSEEN, "")
_open, _close = r"[\[({<]", r"[\])}>]"
_word = "|".join([*DIGIT_WORDS, *SIGN_WORDS])
# Blanks before a bracket are looked at from the first of them alone, else a run of blanks would take the square of its length.
_blanks = r"(?:(?<!\s)\s+)?"
_forms = (
    rf"(?P<at>{_blanks}{_open}\s*(?:at|@)\s*{_close}\s*|(?<=[A-Za-z0-9])\s+at\s+(?=[A-Za-z0-9-]+(?:\s+dot\s+[A-Za-z0-9-]+)+))"
    rf"|(?P<dot>{_blanks}{_open}\s*(?:dot|\.)\s*{_close}\s*|(?<=[A-Za-z0-9])\s+dot\s+(?=[A-Za-z0-9]))"
    rf"|(?P<word>\b(?:{_word})\b(?:[\s-]+(?=(?:{_word})\b))?)"
)
FORMS = re.compile(_forms, re.IGNORECASE)
DISGUISE = re.compile(rf"{_forms}|(?P<char>[{''.join(map(re.escape, CHARACTERS))}])", re.IGNORECASE)
# A text without one of these and without CHARACTERS holds nothing that FORMS matches, so rewriting leaves it as it is.
TRIGGERS = re.compile(rf"{_open}\s*(?:at|dot|@|\.)\s*{_close}|\sdot\s|\b(?:{_word})\b", re.IGNORECASE)
TRIGGER_CHARACTERS = frozenset(CHARACTERS)
# Letters that IGNORECASE takes for an ASCII one and lower() does not turn into it.
_FOLDED = str.maketrans("ſıİ", "sii")

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    doubled = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Goes from one @ to the next, so that long runs of letters cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def plain_spans(text: str) -> list[Span]:
    """Leftmost, not overlapping within a kind; a match that fails its check is dropped whole."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def _has_characters(text: str) -> bool:
    return not text.isascii() and not TRIGGER_CHARACTERS.isdisjoint(text)


def rewrite(text: str) -> tuple[str, list[int], list[int]]:
    """The text without disguises, and for each character of it where its source starts and ends."""
    out, starts, ends, done = [], [], [], 0

    def write(written: str, a: int, b: int) -> None:
        out.append(written)
        starts.extend([a] * len(written))
        ends.extend([b] * len(written))

    for m in (DISGUISE if _has_characters(text) else FORMS).finditer(text):
        a, b = m.span()
        out.append(text[done:a])
        starts.extend(range(done, a))
        ends.extend(range(done + 1, a + 1))
        kind = m.lastgroup
        if kind == "char":
            write(CHARACTERS.get(m[0], m[0]), a, b)
        elif kind == "word":
            word = re.split(r"[\s-]", m[0].translate(_FOLDED).lower(), maxsplit=1)[0]
            write((DIGIT_WORDS | SIGN_WORDS)[word], a, a + len(word))
        else:
            write("@" if kind == "at" else ".", a, b)
        done = b
    out.append(text[done:])
    starts.extend(range(done, len(text)))
    ends.extend(range(done + 1, len(text) + 1))
    return "".join(out), starts, ends


def disguised_spans(text: str, plain: list[Span]) -> list[Span]:
    if not TRIGGERS.search(text) and not _has_characters(text):
        return []
    seen, starts, ends = rewrite(text)
    added = []
    if seen == text:
        return added
    for kind, a, b in plain_spans(seen):
        start, end = starts[a], ends[b - 1]
        if seen[a:b] != text[start:end] and not any(k == kind and start < y and x < end for k, x, y in plain):
            added.append((kind, start, end))
    return added


def find_identifiers(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, spans for every row, repeated rows included: array of (kind, start, end, plain) in the order of KINDS, then start.

    start and end are code points of the source text, end exclusive; plain is false for spans that were disguised. Null and empty texts
    have no spans. Other columns are not read. An empty table gives no rows.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = []
            for raw in texts_of(part.column(1)):
                text_ = raw.decode("utf-8", "replace")
                plain = plain_spans(text_)
                both = [(*s, True) for s in plain] + [(*s, False) for s in disguised_spans(text_, plain)]
                both.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
                out.append([dict(zip(("kind", "start", "end", "plain"), s, strict=True)) for s in both])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, span)], ["doc_id", "spans"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(of, f"doc_id {kind}, spans array<struct<kind string, start long, end long, plain boolean>>")
