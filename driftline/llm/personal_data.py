"""Offset-preserving detection of disguised personal data.

Transducers turn a text into a plain one, each keeping for every output character the span of source characters it stands for:
first look-alike letters, digits of other scripts, full-width forms and invisible characters; then bracketed or spelled dots and
at signs; then digits spelled in four languages. The patterns of the base kinds run over the source and over the plain text, and
spans found in the latter are mapped back to the source. They are added unless a base span of their kind covers them.

Texts without any mark of a disguise skip the transducers. Every pattern is driven so that its time grows with the text's length.

Defined cases: a null or empty text has no spans; repeated rows are judged alike; ids are never read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# The patterns of the base kinds. Runs of digits start where no digit precedes, which finds the same matches.
EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters that look like Latin ones.
LOOKALIKES = dict(zip("АВЕЅІЈКМНОРСТХУаеоруӏсхіјѕԁһԛԝ", "ABESIJKMHOPCTXYaeopylcxijsdhqw"))
LOOKALIKES |= dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαιουνρκ", "ABEZHIKMNOPTYXaiouvpk"))
LOOKALIKES |= dict(zip("‐‑‒–—―−﹣·․。｡﹒", "-------" + "-" + "....."))
LOOKALIKES |= dict.fromkeys("             　", " ")
LOOKALIKES |= dict.fromkeys("­᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿", "")

# Names of the digits in English, German, French and Spanish.
DIGITS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
NAME = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
DOT_NAME, AT_NAME, PLUS_NAME = "(?:dot|punkt|point|punto)", "(?:at|arroba|arobase)", "(?:plus|más)"
OPEN, CLOSE = r"[\[({<]\s{0,3}", r"\s{0,3}[\])}>]"

DOTS = re.compile(
    rf"\s{{0,3}}{OPEN}(?:{DOT_NAME}|\.){CLOSE}\s{{0,3}}|(?<=\w)\s{{1,3}}{DOT_NAME}\s{{1,3}}(?=\w)|(?<=\w)[_-]{DOT_NAME}[_-](?=\w)|&#46;|&#x2e;|&period;"
    r"|(?<=\w)\s\.\s?(?=[a-z0-9])", re.IGNORECASE,
)
ATS = re.compile(
    rf"\s{{0,3}}{OPEN}(?:{AT_NAME}|@){CLOSE}\s{{0,3}}|(?<=[\w])[_-]{AT_NAME}[_-](?=\w)|&#64;|&#x40;|&commat;|(?<=\w)\s{{0,2}}@\s{{0,2}}(?=\w)"
    rf"|(?<=\w)\s{{1,3}}{AT_NAME}\s{{1,3}}(?=[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z])", re.IGNORECASE,
)
SPELLED = re.compile(
    rf"(?<![^\W_])(?:{PLUS_NAME}[\s-]{{1,3}})?(?:{NAME}|[0-9])(?:[\s,-]{{1,3}}(?:{NAME}|[0-9]+)|\.{NAME})+(?![^\W_])", re.IGNORECASE
)
TOKEN = re.compile(rf"{PLUS_NAME}|{NAME}|[0-9.]", re.IGNORECASE)

#: Characters from U+0080 on that `plain_characters` may change; those of Latin-1 that it leaves are listed by trial.
LATIN_1 = "".join(c for c in map(chr, range(0x80, 0x100)) if c not in LOOKALIKES and unicodedata.decimal(c, None) is None and not unicodedata.normalize("NFKC", c).isascii())
CHANGED = re.compile(f"[^\\x00-\\x7f{re.escape(LATIN_1)}]")
#: Without one of these, neither DOTS nor ATS matches.
DOT_OR_AT = re.compile(rf"{DOT_NAME}|{AT_NAME}|[@&]|{OPEN}\.|\s\.", re.IGNORECASE)
NAMES = re.compile(NAME, re.IGNORECASE)


def marked(text: str) -> bool:
    """Whether the transducers may change the text: it has a character they change or a match of their own patterns."""
    if CHANGED.search(text) or DOT_OR_AT.search(text) and (DOTS.search(text) or any(m.group() != "@" for m in ATS.finditer(text))):
        return True
    return NAMES.search(text) is not None and any(len(NAMES.findall(m.group())) >= 3 for m in SPELLED.finditer(text))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every match has one at sign; its local part reaches back as far as it can without touching the match before."""
    last, at = 0, text.find("@")
    while at >= 0:
        tail = EMAIL_TAIL.match(text, at)
        if tail:
            start = at
            while start > last and text[start - 1] in EMAIL_LOCAL:
                start -= 1
            if start < at:
                yield start, tail.end()
                last = tail.end()
        at = text.find("@", max(at + 1, last))


def find(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of the base kinds."""
    out = [(a, b, "email") for a, b in emails(text)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = only_digits(m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(only_digits(m.group())) <= 15]
    return out


class Tape:
    """A text whose characters know the span of source characters they stand for."""

    def __init__(self, text: str, starts: list[int], ends: list[int]):
        self.text, self.starts, self.ends = text, starts, ends

    def replaced(self, changes: list[tuple[int, int, list[tuple[str, int, int]]]]) -> Tape:
        """changes: start, end and the new characters, each with the places of this tape it stands for."""
        text, starts, ends, last = [], [], [], 0
        for a, b, new in [*changes, (len(self.text), len(self.text), [])]:
            text.append(self.text[last:a])
            starts += self.starts[last:a]
            ends += self.ends[last:a]
            for c, p, q in new:
                text.append(c)
                starts.append(self.starts[p])
                ends.append(self.ends[q - 1])
            last = b
        return Tape("".join(text), starts, ends)


def plain_characters(text: str) -> Tape:
    out, starts, ends = [], [], []
    for i, c in enumerate(text):
        if c >= "\x80":
            new = LOOKALIKES.get(c)
            if new is None:
                new = unicodedata.normalize("NFKC", c)
                digit = unicodedata.decimal(c, None)
                new = str(digit) if digit is not None else new if new.isascii() else c
            for x in new:
                out.append(x)
                starts.append(i)
                ends.append(i + 1)
        else:
            out.append(c)
            starts.append(i)
            ends.append(i + 1)
    return Tape("".join(out), starts, ends)


def plain_marks(tape: Tape) -> Tape:
    """Dots first, so that a spelled at sign can ask for a domain behind it; a bare ` at ` needs a disguised dot there."""
    dotted = tape.replaced([(m.start(), m.end(), [(".", m.start(), m.end())]) for m in DOTS.finditer(tape.text)])
    changes = []
    for m in ATS.finditer(dotted.text):
        if m.group().strip(" \t\n").lower() in ("at", "arroba", "arobase"):
            host = re.compile(r"[A-Za-z0-9.-]+").match(dotted.text, m.end())
            if not any(dotted.text[k] == "." and dotted.ends[k] - dotted.starts[k] > 1 for k in range(host.start(), host.end())):
                continue
        changes.append((m.start(), m.end(), [("@", m.start(), m.end())]))
    return dotted.replaced(changes)


def plain_digits(tape: Tape) -> Tape:
    changes = []
    for m in SPELLED.finditer(tape.text):
        new, spelled = [], 0
        for t in TOKEN.finditer(m.group()):
            word = t.group().lower()
            spelled += word in DIGITS
            char = str(DIGITS[word]) if word in DIGITS else word if len(word) == 1 else "+"
            new.append((char, m.start() + t.start(), m.start() + t.end()))
        if spelled >= 3:
            changes.append((m.start(), m.end(), new))
    return tape.replaced(changes)


def disguised(text: str) -> list[tuple[int, int, str]]:
    """Spans in the source of what the plain text shows."""
    tape = plain_digits(plain_marks(plain_characters(text)))
    return [(tape.starts[a], tape.ends[b - 1], kind) for a, b, kind in find(tape.text)]


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts of the base kinds, digest of the base spans, all spans, n_disguised."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                text = text or ""
                base = find(text)
                more = []
                if marked(text):
                    covered = {k: [(a, b) for a, b, kind in base if kind == k] for k in KINDS}
                    more = [s for s in disguised(text) if not any(a <= s[0] and s[1] <= b for a, b in covered[s[2]])]
                counts = [sum(s[2] == k for s in base) for k in KINDS]
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed([*base, *more]), len(more)))
            yield pd.DataFrame(rows, columns=names)

    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised"]
    kinds = ", ".join(f"{n} string" if n in ("base_sha256", "spans") else f"{n} long" for n in names)
    found = F.pandas_udf(run, kinds)(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", found.alias("f")).select("doc_id", *[F.col(f"f.{n}").alias(n) for n in names])
