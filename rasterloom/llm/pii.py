"""Personal data by offset-preserving deobfuscation.

Base spans are found in the text as it is. Then small transducers rewrite disguises: homoglyphs to ASCII,
zero-width characters to nothing, spelled digits to digits, and "(at)", "[dot]" and the like to "@" and ".". Each
output character keeps the range of source characters it came from, so what is found in the rewritten text maps back
to the source. Such a span is added unless it lies within a base span of its kind.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import read

KINDS = ("email", "ip", "card", "phone")

# The look-behinds and possessive repeats only skip starts that can't match: a match begins at the first digit of a run.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Characters that look like ASCII ones.
_LOOKS = dict(zip("аеорсухіјѕԁһӏАВЕКМНОРСТХІЈЅαοιρυνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhlABEKMHOPCTXIJSaoipuvABEZHIKMNOPTYX", strict=True))
_LOOKS |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}  # full-width forms
_LOOKS |= {"。": ".", "․": ".", "﹒": ".", "·": ".", "﹫": "@", "‐": "-", "‑": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ", "　": " "}
_LOOKS |= {chr(base + i): str(i) for base in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for i in range(10)}
_NOTHING = "​‌‍⁠﻿­"
# Spelled digits in English, German, French and Spanish.
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORD = "|".join(sorted(_SPELLED, key=lambda w: (-len(w), w)))
_GAP = r"[ \t]*[ ,-][ \t]*"
#: At least four spelled digits in a row, with "plus" before and "dot" or "point" between allowed.
_DIGITS = re.compile(rf"(?<!\w)(?:plus{_GAP})?(?:{_WORD})(?:{_GAP}(?:(?:dot|point){_GAP})?(?:{_WORD}))" + r"{3,}(?!\w)", re.I)
_DIGIT = re.compile(rf"plus|dot|point|{_WORD}", re.I)
_AT = r"[ \t]*(?:[(\[{<][ \t]*(?:at|@)[ \t]*[)\]}>]|(?<=[ \t])at(?=[ \t]))[ \t]*"
_DOT = r"[ \t]*(?:[(\[{<][ \t]*(?:dot|punkt|point|punto|\.)[ \t]*[)\]}>]|(?<=[ \t])dot(?=[ \t]))[ \t]*"
#: A name, an at, and parts with at least one dot, of which any may be disguised.
_ADDRESS = re.compile(rf"(?:[A-Za-z0-9_%+-](?:[A-Za-z0-9._%+-]|{_DOT}(?=[A-Za-z0-9]))*+)(?P<at>{_AT}|[ \t]*@[ \t]*)[A-Za-z0-9-]+(?:(?:{_DOT}|\.)[A-Za-z0-9-]+)+", re.I)
_ANCHOR = re.compile(r"[(\[{<][ \t]*(?:at|@|dot|punkt|point|punto|\.)[ \t]*[)\]}>]|[ \t]at[ \t]+[A-Za-z0-9-]+[ \t]+dot[ \t]", re.I)
_ATS, _DOTS = re.compile(_AT, re.I), re.compile(_DOT, re.I)
_DISGUISED = re.compile("[" + re.escape("".join(_LOOKS)) + _NOTHING + "]")
# Last parts of an address that make a bare " at " and " dot " a disguise and not prose.
_TOP = frozenset("com org net edu gov info biz io co de fr es uk eu us ch at it nl example".split())
#: Characters before and after an anchor that may belong to its address.
_REACH = 320

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def find(text: str) -> list[Span]:
    """Base spans of a text."""
    out = list(emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


class Rewritten:
    """A text with, for each character, the range of source characters that it stands for."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, np.arange(len(text)), np.arange(1, len(text) + 1)

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Edits (start, end, new) in order, not overlapping; new characters stand for all of what they replace."""
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            start += [self.start[at:a], np.full(len(new), self.start[a])]
            end += [self.end[at:a], np.full(len(new), self.end[b - 1])]
            at = b
        if edits:
            self.text = "".join([*text, self.text[at:]])
            self.start, self.end = np.concatenate([*start, self.start[at:]]), np.concatenate([*end, self.end[at:]])


def look_alikes(r: Rewritten) -> None:
    r.replace([(m.start(), m.end(), _LOOKS.get(m[0], "")) for m in _DISGUISED.finditer(r.text)])


def spelled_digits(r: Rewritten) -> None:
    edits = []
    for m in _DIGITS.finditer(r.text):
        parts = list(_DIGIT.finditer(r.text, m.start(), m.end()))
        for i, p in enumerate(parts):
            word = p[0].lower()
            stop = parts[i + 1].start() if i + 1 < len(parts) else m.end()
            # A gap goes with the word before it, so that the digits join.
            edits.append((p.start(), p.end(), {"plus": "+", "dot": ".", "point": "."}.get(word) or _SPELLED[word]))
            if stop > p.end():
                edits.append((p.end(), stop, ""))
    r.replace(edits)


def at_and_dot(r: Rewritten) -> None:
    edits, done = [], 0
    for a in _ANCHOR.finditer(r.text):
        if a.start() < done:
            continue
        low, high = max(done, a.start() - _REACH), min(len(r.text), a.end() + _REACH)
        # Only a window around the anchor is read: an address is shorter.
        for m in _ADDRESS.finditer(r.text, low, high):
            if m.end() <= a.start():
                continue
            if m.start() > a.end():
                break
            at = m.span("at")
            if m["at"].strip().lower() == "at" and re.split(r"[ \t.]+", m[0])[-1].lower() not in _TOP:
                break
            edits += [(d.start(), d.end(), ".") for d in _DOTS.finditer(r.text, m.start(), at[0])]
            edits.append((*at, "@"))
            edits += [(d.start(), d.end(), ".") for d in _DOTS.finditer(r.text, at[1], m.end())]
            done = m.end()
            break
    r.replace(edits)


def find_all(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, each by start and then kind."""
    base = find(text)
    everything = list(base)
    odd = not text.isascii() and _DISGUISED.search(text)
    if odd or _DIGITS.search(text) or _ANCHOR.search(text):
        r = Rewritten(text)
        for step in (look_alikes, spelled_digits, at_and_dot):
            step(r)
        # Base spans of a kind don't overlap: only the last one that starts at or before a span can hold it.
        own = {k: [(x, y) for kind, x, y in base if kind == k] for k in KINDS}
        for kind, a, b in find(r.text):
            a, b = int(r.start[a]), int(r.end[b - 1])
            i = bisect.bisect_right(own[kind], (a, len(text))) - 1
            if i < 0 or own[kind][i][1] < b:
                everything.append((kind, a, b))
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return sorted(base, key=order), sorted(set(everything), key=order)


def personal_data(docs: DataFrame) -> DataFrame:
    """docs (all its columns, of which text is read) with base and spans: arrays of (kind, start, end) in code points.

    base holds the undisguised spans, spans these and the added ones. A null or empty text has none; very long
    texts are read whole, but a disguised address of more than _REACH characters to either side of its at or dot isn't
    found. Repeated rows have the same spans each. An empty table gives no rows. Columns of these names are replaced.
    """
    rest = [c for c in docs.columns if c not in ("base", "spans")]
    kind = "array<struct<kind:string,start:int,end:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [find_all(t.as_py() or "") for t in batch.column("__text")]
            cols = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in f[i]] for f in found], to) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *cols], names=[*rest, "base", "spans"])

    empty = docs.select(*rest, F.lit(None).cast(kind).alias("base"), F.lit(None).cast(kind).alias("spans"))
    return docs.select(*rest, F.col("text").alias("__text")).mapInArrow(run, empty.schema)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: counts of base spans, their digest, and all spans."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))

    def told(c: str):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    out = personal_data(d).drop("text")
    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *map(count, KINDS), F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"))
