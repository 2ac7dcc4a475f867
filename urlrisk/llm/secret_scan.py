"""Secrets: base patterns, and sliding-window Shannon entropy per character class.

Candidate strings are runs of 20 or more letters, digits and ``+/_=-``.  Inside a
candidate every class of characters has a window of its own that slides over the
runs of that class; counts of the characters in the window are updated by the one
that enters and the one that leaves, and with them the entropy.  Windows at or
above the threshold of the class are joined to spans.  Spans found before and what
the allow list matches are cut out of the candidate, and windows slide over the
parts between; a stand-in or alphabet that is glued to letters or digits takes its
whole word with it.  A span counts if it mixes letters and digits.

Defined cases: null and empty texts have no spans.  Offsets count code points of
the whole text, the end is exclusive.  Characters outside ASCII end every run.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ascii_view
from .spans import flags, places, runs

KINDS = ("assign", "access", "hex")
ADDED = "entropy"
# Words that a secret is assigned to, least lengths, classes (characters, window, bits), allow list.
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST = {"assign": 8, "access": 16, "hex": 32}
LEAST_CANDIDATE = 20
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (("hex", DIGITS + "abcdef", 20, 3.0), ("HEX", DIGITS + "ABCDEF", 20, 3.0), ("base32", DIGITS + UPPER, 20, 3.5),
           ("base36", DIGITS + LOWER, 20, 3.5), ("base64", DIGITS + LOWER + UPPER + "+/_=-", 24, 4.0),
           ("base64 short", DIGITS + LOWER + UPPER + "+/_=-", 20, 3.8))
STAND_INS = (
    r"(?i)example|sample|placeholder|changeme|dummy|your[_-]",
    r"(?i)0123456789|abcdefghij|qwertyuiop",  # alphabets
)
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # UUID
    *STAND_INS,
    r"(?i)x{6,}|0{8,}",  # masks
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}",  # dates
    r"(?<![a-z])(?:[a-z]+[-_/]){3,}",  # paths and slugs of words
)

ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX_FLAGS = flags(DIGITS + "abcdef")
CANDIDATE_FLAGS = flags(DIGITS + LOWER + UPPER + "+/_=-")


def base_spans(view: bytes) -> list[tuple[str, int, int]]:
    """The base spans of a text, by kind."""
    out, end = [], 0
    for start in places(view.lower(), WORDS):
        if start >= end and (m := ASSIGN.match(view, start)):
            end = m.end()
            if len(m[2]) >= LEAST["assign"]:
                out.append(("assign", start, end))
    start = view.find(b"AKIA")
    while start >= 0:
        end = start + 1
        if m := ACCESS.match(view, start):
            end = m.end()
            if end - start >= LEAST["access"]:
                out.append(("access", start, end))
        start = view.find(b"AKIA", end)
    return out + [("hex", a, b) for a, b in runs(view.translate(HEX_FLAGS), LEAST["hex"])]


def hot_windows(piece: bytes, window: int, bits: float) -> list[tuple[int, int]]:
    """Joined windows of a run of one class whose entropy reaches the threshold; counts are kept up incrementally."""
    cost = [0.0] + [n * math.log2(n) for n in range(1, window + 1)]
    counts, total, out = [0] * 256, 0.0, []
    limit = (math.log2(window) - bits) * window + 1e-9  # entropy = log2(window) - total / window
    for at, c in enumerate(piece):
        total += cost[counts[c] + 1] - cost[counts[c]] if at < window else 0.0
        if at < window:
            counts[c] += 1
        else:
            gone = piece[at - window]
            counts[gone] -= 1
            total += cost[counts[gone]] - cost[counts[gone] + 1]
            counts[c] += 1
            total += cost[counts[c]] - cost[counts[c] - 1]
        if at >= window - 1 and total <= limit:
            if out and out[-1][1] >= at + 1 - window:
                out[-1] = out[-1][0], at + 1
            else:
                out.append((at + 1 - window, at + 1))
    return out


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order of begin, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and out[-1][1] >= a:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def outside(end: int, cuts: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of 0..end that no cut covers."""
    start = 0
    for a, b in sorted(cuts):
        if a > start:
            yield start, a
        start = max(start, b)
    if start < end:
        yield start, end


class Scanner:
    def __init__(self, classes=CLASSES, allowed=ALLOWED):
        self.classes = [(flags(chars), window, bits) for _, chars, window, bits in classes]
        self.allowed = [(re.compile(a.encode()), a in STAND_INS) for a in allowed]

    def cuts(self, piece: bytes) -> list[tuple[int, int]]:
        """What the allow list takes out of a candidate."""
        found = []
        for pattern, whole in self.allowed:
            last = 0
            for m in pattern.finditer(piece):
                a, b = m.span()
                if whole and b > last:
                    while a > last and piece[a - 1:a].isalnum():
                        a -= 1
                    while b < len(piece) and piece[b - 1:b + 1].isalnum():
                        b += 1
                    last = b
                found.append((a, b))
        return found

    def hot(self, piece: bytes) -> list[tuple[int, int]]:
        return [(a + x, a + y) for table, window, bits in self.classes for a, b in runs(piece.translate(table), window) for x, y in hot_windows(piece[a:b], window, bits)]

    def entropy_spans(self, view: bytes, taken: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
        base, at = joined(sorted((a, b) for _, a, b in taken)), 0
        for start, end in runs(view.translate(CANDIDATE_FLAGS), LEAST_CANDIDATE):
            piece = view[start:end]
            while at < len(base) and base[at][1] <= start:
                at += 1
            over = [(a - start, b - start) for a, b in base[at:bisect_left(base, (end,))]]
            if piece.isalpha() or piece.isdigit():
                continue
            hot = self.hot(piece)
            if hot and (cuts := over + self.cuts(piece)):
                hot = [(since + x, since + y) for since, till in outside(len(piece), cuts) for x, y in self.hot(piece[since:till])]
            for a, b in joined(sorted(hot)):
                part = piece[a:b]
                if any(48 <= c < 58 for c in part) and any(c > 64 for c in part):
                    yield ADDED, start + a, start + b

    def scan(self, text: str | None) -> list[dict]:
        if not text:
            return []
        view = ascii_view(text)
        base = base_spans(view)
        order = {k: i for i, k in enumerate((*KINDS, ADDED))}
        found = [(*s, True) for s in base] + [(*s, False) for s in self.entropy_spans(view, base)]
        found.sort(key=lambda s: (s[1], order[s[0]]))
        return [dict(zip(("kind", "start", "end", "base"), s)) for s in found]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find(docs: DataFrame, classes=CLASSES, allowed=ALLOWED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end, base), in order, of every row; one narrow pass."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(classes, allowed)
        for batch in source:
            spans = pa.array([scanner.scan(t) for t in batch.column("text").to_pylist()], SPANS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), spans], names=["doc_id", "spans"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean>>")
