"""Personal data in texts, disguised or not, with spans in the source's characters.

Fixed patterns find plain identifiers.  For disguised ones a text runs through a chain of
transducers: characters that look like others become those (one for one, so no offset
moves), invisible characters go, and words and brackets that stand for ``@`` and ``.``, or
for digits and ``+``, are replaced.  Each transducer keeps where its pieces came from, so
a span found in the normal form is mapped back, step by step, to the source.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from hashlib import sha256
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame

from lakewarden.llm.text import id_and_text, in_slices

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# Fixed patterns.  Those of numbers are tried only where a run of digits starts: later starts in a run match no more.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
RUN = re.compile("[0-9]+")
ADDRESS = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Look-alikes that compatibility normalisation does not know, each string of characters with what they look like.
ALIKE = (
    ("аеорсхуіѕјԁһӏԛԝ", "aeopcxyisjdhlqw"), ("АВЕЅІЈКМНОРСТХУ", "ABESIJKMHOPCTXY"),
    ("αγικνορυχ", "ayiknopux"), ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"), ("ıɡɑ", "iga"),
    ("‐‑‒–—―−﹘", "--------"), ("。｡", ".."),
)
UNSEEN = "​‌‍⁠﻿­᠎"

BRACKETED = re.compile(r"[\[({<] ?(?i:(at|ät|arroba|arobase|@)|dot|punkt|point|punto|\.) ?[\])}>]")
# What follows a bare "at": a label and a dot, plain or disguised.
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z]|[ _](?i:dot)[ _]| ?[\[({<])")
WORD_AT, WORD_DOT = (" at ", "_at_"), (" dot ", "_dot_")
NUMBER_DOT = (" dot ", " point ", " punkt ", " punto ")
PLUS = ("plus ", "plus: ")
# A bare word counts for a sign only in front of one of these.
ENDINGS = frozenset("com org net edu gov mil info biz io dev app co uk de fr es eu ch ca nl pl ru cn jp br "
                    "au fi dk example test invalid".split())
SPELLED = {word: str(digit) for digit, words in enumerate((
    "zero oh null zéro cero", "one eins un uno", "two zwei zwo deux dos", "three drei trois tres",
    "four vier quatre cuatro", "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete",
    "eight acht huit ocho", "nine neun neuf nueve")) for word in words.split()}
TIMES = {"double": 2, "triple": 3}
NUMBER_WORD = re.compile(rf"\b(?:({'|'.join(TIMES)}) )?({'|'.join(SPELLED)})\b")
BETWEEN = re.compile(r"[ ,-]{1,2}")
# Words that may stand in a spelled number.
NUMERIC = frozenset([*SPELLED, *TIMES, "plus", *map(str.strip, NUMBER_DOT)])
MIXED_RUN = re.compile("[0-9OolI|]+")
AS_DIGIT = str.maketrans("OolI|", "00111")
ALIKE_DIGITS, MIXED_SIGNS = frozenset("OolI|"), frozenset("0123456789OolI|")
# A number without a plus of this many spelled digits is a telephone number.
SPELLED_LEAST = 7

SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
Span = tuple[int, int, int]  # start, kind, end
Edit = tuple[int, int, str]  # start, end, replacement


class Alike(dict):
    """What each character looks like, found out when it first occurs."""

    def __init__(self) -> None:
        super().__init__({ord(a): b for some, plain in ALIKE for a, b in zip(some, plain)})
        self.update({ord(c): UNSEEN[0] for c in UNSEEN})

    def __missing__(self, code: int) -> str:
        c = chr(code)
        plain = unicodedata.normalize("NFKC", c)
        if len(plain) != 1 or not plain.isascii():
            digit = unicodedata.decimal(c, None)
            plain = c if digit is None else str(digit)
        self[code] = plain
        return plain


class Rewritten:
    """A text with some pieces replaced, and the way back."""

    def __init__(self, source: str, edits: list[Edit]):
        out, self.at, self.piece, done, size = [], [], [], 0, 0
        for start, end, new in sorted(edits):
            if start < done:
                continue
            for low, high, text, edited in ((done, start, source[done:start], False), (start, end, new, True)):
                if text:
                    self.at.append(size)
                    self.piece.append((low, high, edited))
                    out.append(text)
                    size += len(text)
            done = end
        self.at.append(size)
        self.piece.append((done, len(source), False))
        out.append(source[done:])
        self.text = "".join(out)
        self.edits = [a for a, p in zip(self.at, self.piece) if p[2]]

    def _source(self, place: int) -> tuple[int, int]:
        k = bisect_right(self.at, place) - 1
        low, high, edited = self.piece[k]
        return (low, high) if edited else (low + place - self.at[k], low + place - self.at[k] + 1)

    def back(self, start: int, end: int) -> tuple[int, int]:
        return self._source(start)[0], self._source(end - 1)[1]

    def edited(self, start: int, end: int) -> int:
        """How many replaced pieces begin inside."""
        return bisect_right(self.edits, end - 1) - bisect_right(self.edits, start - 1)


def emails(text: str) -> list[tuple[int, int]]:
    """``[A-Za-z0-9._%+-]+@`` and a domain: from each ``@`` to both sides, so long runs are read once."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            floor = domain.end()
            found.append((start, floor))
        at = text.find("@", max(at + 1, floor))
    return found


def luhn(digits: str) -> bool:
    doubled = (int(d) * 2 for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def numbers(text: str) -> list[Span]:
    """Addresses, cards and telephone numbers, those that fail their test dropped."""
    found, after = [], [0] * len(KINDS)
    for run in RUN.finditer(text):
        at = run.start()
        if at >= after[IP] and (m := ADDRESS.match(text, at)):
            after[IP] = m.end()
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                found.append((at, IP, m.end()))
        if at >= after[CARD] and (m := DIGITS.match(text, at)):
            after[CARD] = m.end()
            if m.end() - at >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                found.append((at, CARD, m.end()))
    if "+" in text:
        found += [(m.start(), PHONE, m.end()) for m in DIALLED.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return found


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' spans, leftmost and without overlaps within a kind."""
    return sorted([(a, EMAIL, b) for a, b in emails(text)] + numbers(text))


def _widened(text: str, start: int, end: int) -> tuple[int, int]:
    """A piece with the blank before and behind it."""
    return start - (start > 0 and text[start - 1] == " "), end + (end < len(text) and text[end] == " ")


def lowered(text: str) -> str:
    """The text in lower case, with every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def places(low: str, words: tuple[str, ...]):
    """Starts and ends of all occurrences of some words."""
    for word in words:
        at = low.find(word)
        while at >= 0:
            yield at, at + len(word)
            at = low.find(word, at + 1)


def bracketed(text: str) -> list[Edit]:
    """Bracketed words and signs that stand for ``@`` and ``.``, with a blank to each side."""
    return [(*_widened(text, m.start(), m.end()), "@" if m[1] else ".") for m in BRACKETED.finditer(text)]


def sign_edits(text: str, low: str) -> tuple[list[Edit], set[int]]:
    """Pieces that stand for ``@`` and ``.``, and where those of bare words start."""
    edits, bare = bracketed(text), []
    for at, _ in places(text, (" @", "@ ")):
        start, end = _widened(text, *((at + 1, at + 2) if text[at] == " " else (at, at + 1)))
        if start > 0 and text[start - 1].isalnum() and end < len(text) and text[end].isalnum():
            edits.append((start, end, "@"))
    for start, end in places(low, WORD_AT):
        if start > 0 and text[start - 1].isalnum() and HOST.match(text, end):
            bare.append((start, end, "@"))
    if bare or any(new == "@" for *_, new in edits):
        bare += [(start, end, ".") for start, end in places(low, WORD_DOT)
                 if start > 0 and text[start - 1].isalnum() and end < len(text) and text[end].isalnum()]
    return edits + bare, {start for start, *_ in bare}


def _spells(text: str, low: str) -> bool:
    """Whether a number may be spelled: two words of numbers side by side, or one in a text with many digits."""
    apart = low.replace(",", " ").replace("-", " ").replace(".", " ").replace(":", " ")
    flags = bytes(map(NUMERIC.__contains__, apart.split()))
    return b"\1\1" in flags or 1 in flags and sum(len(m[0]) for m in RUN.finditer(text)) >= 3


def digit_edits(text: str, low: str) -> tuple[list[Edit], set[int]]:
    """Pieces that stand for digits, dots and plus signs, and where spelled digits start.

    Blanks, commas and hyphens between two spelled digits go, and letters that look like
    digits are digits in a word with two or more of these.
    """
    edits, spelled = [], set()
    hits = list(NUMBER_WORD.finditer(low)) if _spells(text, low) else []
    near = [BETWEEN.fullmatch(low, a.end(), b.start()) is not None for a, b in pairwise(hits)]
    for k, m in enumerate(hits):
        dotted = low.startswith(NUMBER_DOT, m.end()) or any(low.startswith(w, m.start() - len(w)) for w in NUMBER_DOT)
        if dotted or m[1] or k and near[k - 1] or k < len(near) and near[k]:  # one alone is a word
            edits.append((m.start(), m.end(), SPELLED[m[2]] * TIMES.get(m[1], 1)))
            spelled.add(m.start())
            if k and near[k - 1]:
                edits.append((hits[k - 1].end(), m.start(), ""))
    done = 0
    for run in RUN.finditer(text):
        start, end = run.span()
        if start >= done and (text[start - 1:start] in ALIKE_DIGITS or text[end:end + 1] in ALIKE_DIGITS):
            while start > done and text[start - 1] in MIXED_SIGNS:
                start -= 1
            end = MIXED_RUN.match(text, start).end()
            done, mixed = end, text[start:end]
            inside = start > 0 and text[start - 1].isalnum() or end < len(text) and text[end].isalnum()
            if not inside and not mixed.isdecimal() and len(digits_of(mixed)) >= 2:
                edits.append((start, end, mixed.translate(AS_DIGIT)))
    edits += [e for e in bracketed(text) if e[2] == "."]
    edits += [(start, end, ".") for start, end in places(low, NUMBER_DOT)]
    edits += [(start, end, "+") for start, end in places(low, PLUS) if not low[start - 1:start].isalnum()]
    return edits, spelled


def _disguised_emails(text: str, low: str, changed: bool) -> list[tuple[int, int]]:
    edits, bare = sign_edits(text, low)
    if not edits and not changed:
        return []
    view, found = Rewritten(text, edits), []
    for start, end in emails(view.text):
        local, _, domain = view.text[start:end].partition("@")
        a, b = view.back(start, end)
        ending = domain.rpartition(".")[2].lower()
        weak = [x for x in bare if a <= x < b]
        if not weak:
            good = ending.isalpha() and len(ending) >= 2 and any(c.isalnum() for c in local)
        else:
            # "At" between words needs a dot that is spelled, too, or a name that is no word.
            named = len(weak) > 1 or view.edited(start, end) > 1 or any(c in "._0123456789" for c in local)
            good = ending in ENDINGS and named
        if good:
            found.append((a, b))
    return found


def _disguised_numbers(text: str, low: str, changed: bool) -> list[Span]:
    edits, spelled = digit_edits(text, low)
    if not edits and not changed:
        return []
    view = Rewritten(text, edits)
    found = [(a, kind, b) for start, kind, end in numbers(view.text) for a, b in [view.back(start, end)]]
    if len(spelled) >= SPELLED_LEAST:
        for m in DIGITS.finditer(view.text):
            a, b = view.back(m.start(), m.end())
            digits = digits_of(m[0])
            if 10 <= len(digits) <= 15 and sum(a <= x < b for x in spelled) >= SPELLED_LEAST and not any(
                    s < b and a < e for s, _, e in found):
                found.append((a, PHONE, b))
    return found


def added_spans(text: str, base: list[Span], alike: dict[int, str]) -> list[Span]:
    """Spans of disguised identifiers that no plain one covers."""
    changed = not text.isascii() and any(alike[ord(c)] != c for c in set(text))
    folded = text.translate(alike) if changed else text
    changed |= UNSEEN[0] in folded
    seen = Rewritten(folded, [(k, k + 1, "") for k, c in enumerate(folded) if c == UNSEEN[0]]
                     if UNSEEN[0] in folded else [])
    low = lowered(seen.text)
    found = [(a, EMAIL, b) for a, b in _disguised_emails(seen.text, low, changed)]
    found += _disguised_numbers(seen.text, low, changed)
    out = set()
    for a, kind, b in found:
        start, end = seen.back(a, b)
        if not any(s <= start and end <= e for s, _, e in base):
            out.add((start, kind, end))
    return sorted(out)


def joined(spans: list[Span]) -> str:
    """``kind:start:end`` by start, then kind; code points, end exclusive."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


_ALIKE = Alike()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of every whole text.

    Returns one row per row: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 (of
    the fixed patterns' spans, ``kind:start:end``), spans (those and the disguised ones),
    n_added (how many of the latter).  Null counts as empty; texts without personal data
    have counts of 0 and empty spans; repeated rows give repeated results; other columns
    are not read.
    """
    def scanned(batches):
        for ids, texts in in_slices(batches):
            base = [base_spans(t) for t in texts]
            added = [added_spans(t, b, _ALIKE) for t, b in zip(texts, base)]
            counts = [[sum(k == kind for _, k, _ in spans) for spans in base] for kind in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in counts),
                 pa.array([sha256(joined(b).encode()).hexdigest() for b in base], pa.string()),
                 pa.array([joined(b + e) for b, e in zip(base, added)], pa.string()),
                 pa.array(list(map(len, added)), pa.int64())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return id_and_text(docs, id_col, text_col).mapInArrow(scanned, SCHEMA)
