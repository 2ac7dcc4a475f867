"""Personal data by weak supervision.

* **Candidates.**  Base spans (e-mail, IP, card, phone) and looser shapes:
  national phone numbers, social security numbers, bank accounts, names after a
  cue.
* **Labelers.**  Four of them look at every candidate and say yes, no or nothing:
  the shape (checksums, ranges, grouping), a gazetteer (domains, address blocks,
  card issuers, country codes, given names), the context (cue words for and
  against in the 48 characters before) and the neighbours (what the span is
  glued to).
* **Reliabilities.**  Expectation-maximisation over the counts of all vote
  patterns of all documents estimates, per kind, how often candidates are real
  and how often each labeler is right.
* **Classifier.**  Logistic regression on kind, votes and length, fitted to the
  estimated probabilities, gives every candidate its score.  Looser candidates
  from one half on are added; base spans stay whatever their score.

Vote patterns are at most a few thousand, whatever the corpus, so only their
counts reach the driver.

Defined cases: null and empty texts have no spans.  Offsets count code points of
the whole text, the end is exclusive.  Added spans overlap no other span; the
earlier, then the longer one is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ascii_view, stored
from .spans import flags

KINDS = ("email", "ip", "card", "phone")
ADDED = ("tel", "ssn", "iban", "name")
ALL = KINDS + ADDED
LABELERS = ("shape", "gazetteer", "context", "neighbours")
AROUND = 48
# Gazetteers and cue words.
DOMAINS = frozenset("com org net edu gov mil int info biz io co us uk de fr es it nl be ch at pl pt se no dk fi ie eu ru ua cz gr tr br mx ar cl ca au nz jp cn kr in za".split())
ISSUERS = re.compile(rb"4|5[1-5]|2[2-7]|3[47]|3[068]|6(?:011|5|4[4-9])|35|62|50|5[6-9]")
COUNTRIES = re.compile(rb"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[12368]|35[0-9]|37[0-9]|38[0-9]|42[013]|85[2356]|88[06]|96[0-8]|97[1-7]|99[2-8]")
NAMES = frozenset("james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth barbara susan jessica sarah karen "
                  "daniel matthew anthony mark paul steven andrew peter anna maria laura julia emma sofia lucia carmen jose juan carlos luis ana pierre jean "
                  "marie claire hans klaus jurgen sabine petra wolfgang".split())
CUES = {"email": rb"mail|contact|write|reach", "ip": rb"\bip\b|address|host|server|login|from", "card": rb"card|visa|master|amex|credit|payment",
        "phone": rb"phone|call|tel|mobile|fax|cell|contact", "tel": rb"phone|call|tel|mobile|fax|cell|contact", "ssn": rb"ssn|social|security|tax",
        "iban": rb"iban|account|bank|transfer", "name": rb"name|signed|regards|patient|customer"}
AGAINST = re.compile(rb"(?i)version|release|build|isbn|issn|order|invoice|serial|part no|doi|sku|example|dummy")

CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
IP_GATE = re.compile(rb"\.[0-9]+\.[0-9]")
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT_FLAGS = flags("0123456789")
LOOSE = {"tel": re.compile(rb"(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
         "ssn": re.compile(rb"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
         "iban": re.compile(rb"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")}
NAME = re.compile(rb"(?:[Nn]ame is|[Nn]ame:|\bMr\.?|\bMrs\.?|\bMs\.?|\bDr\.?|[Rr]egards,)\s{1,3}([A-Z][a-z]{1,20}(?: [A-Z][a-z]{1,20})?)")
NAME_GATE = re.compile(rb"ame[ :]|Mrs?|Ms|Dr|egards,")


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = (c - 48) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _small(part: bytes) -> bool:
    part = part.lstrip(b"0")
    return len(part) < 3 or len(part) == 3 and part <= b"255"


def _digits(piece: bytes) -> bytes:
    return bytes(c for c in piece if 48 <= c < 58)


def base_spans(view: bytes) -> list[tuple[str, int, int]]:
    """The base spans of a text, by kind."""
    out, end, at = [], 0, view.find(b"@")
    while at >= 0:
        start = at
        while start > end and view[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(view, at + 1)):
            end = m.end()
            out.append(("email", start, end))
        at = view.find(b"@", max(at + 1, end))
    flagged = view.translate(DIGIT_FLAGS)
    if b"1" in flagged:
        if IP_GATE.search(view):
            out += [("ip", m.start(), m.end()) for m in IP.finditer(view) if all(map(_small, m[0].split(b".")))]
        for m in CARD.finditer(view):
            if m.end() - m.start() >= 12 and 12 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        at = view.find(b"+")
        while at >= 0:
            end = at + 1
            if m := PHONE.match(view, at):
                end = m.end()
                if 9 <= len(_digits(m[0])) <= 15:
                    out.append(("phone", at, end))
            at = view.find(b"+", end)
    return out


def loose_spans(view: bytes, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates of looser shape that overlap nothing found before."""
    found = []
    if b"111" in view.translate(DIGIT_FLAGS):
        for kind, pattern in LOOSE.items():
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(view)]
    if NAME_GATE.search(view):
        found += [("name", m.start(1), m.end(1)) for m in NAME.finditer(view)]
    if not found:
        return found
    busy, out = sorted((a, b) for _, a, b in taken), []
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2], s[0])):
        if not (out and out[-1][2] > a) and not any(x < b and a < y for x, y in busy):
            out.append((kind, a, b))
    return out


def _shape(kind: str, piece: bytes) -> int:
    digits = _digits(piece)
    if kind == "email":
        local, _, domain = piece.partition(b"@")
        return 1 if len(local) <= 64 and not local.startswith(b".") and b".." not in piece and domain.rpartition(b".")[2].isalpha() else -1
    if kind == "ip":
        return 1 if all(p == b"0" or not p.startswith(b"0") for p in piece.split(b".")) else -1
    if kind == "card":
        return 1 if 13 <= len(digits) <= 19 and len(set(digits)) > 2 else -1
    if kind in ("phone", "tel"):
        return 1 if 10 <= len(digits) <= 15 and len(set(digits)) > 2 and piece.count(b"(") == piece.count(b")") else -1
    if kind == "ssn":
        return -1 if digits[:3] in (b"000", b"666") or digits[:1] == b"9" or digits[3:5] == b"00" or digits[5:] == b"0000" else 1
    if kind == "iban":
        plain = piece.replace(b" ", b"")
        return 1 if int("".join(str(int(chr(c), 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else -1
    return 1 if b" " in piece else 0


def _listed(kind: str, piece: bytes) -> int:
    if kind == "email":
        return 1 if piece.rpartition(b".")[2].lower().decode() in DOMAINS else 0
    if kind == "ip":
        first, second = (int(p.lstrip(b"0") or b"0") for p in piece.split(b".")[:2])
        return -1 if first in (0, 127) or first >= 224 else 1 if first not in (10, 192, 172) or second not in (168, *range(16, 32)) else 0
    if kind == "card":
        return 1 if ISSUERS.match(_digits(piece)) else -1
    if kind == "phone":
        return 1 if COUNTRIES.match(_digits(piece)) else -1
    if kind == "tel":
        return -1 if _digits(piece)[:1] in (b"0", b"1") else 0
    if kind == "name":
        return 1 if piece.split(b" ")[0].lower().decode() in NAMES else 0
    return 0


def votes(view: bytes, kind: str, start: int, end: int) -> tuple[int, ...]:
    """What the labelers say of a candidate: 1, -1, or 0 for nothing."""
    piece, before = view[start:end], view[max(0, start - AROUND):start]
    cue, against = re.search(CUES[kind], before, re.IGNORECASE), AGAINST.search(before)
    after = view[end:end + 2]
    glued = before[-1:].isalnum() or before[-1:] in (b".", b"-", b"_") or after[:1].isalnum() or after[:1] in (b".", b"-", b"_") and after[1:].isalnum()
    return _shape(kind, piece), _listed(kind, piece), -1 if against else 1 if cue else 0, -1 if glued else 1


def scan(text: str | None) -> list[dict]:
    """All candidates of a text in order, with their votes."""
    if not text:
        return []
    view = ascii_view(text)
    base = base_spans(view)
    rows = [(*s, True) for s in base] + [(*s, False) for s in loose_spans(view, base)]
    rows.sort(key=lambda s: (s[1], ALL.index(s[0])))
    return [{"kind": k, "start": a, "end": b, "base": base_, "votes": list(votes(view, k, a, b)), "length": (b - a).bit_length()} for k, a, b, base_ in rows]


FIELDS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()),
                             ("votes", pa.list_(pa.int32())), ("length", pa.int32())]))
CANDIDATES = "array<struct<kind: string, start: long, end: long, base: boolean, votes: array<int>, length: int>>"


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``candidates`` of every row; one narrow pass over the texts."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found = pa.array([scan(t) for t in batch.column("text").to_pylist()], FIELDS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], names=["doc_id", "candidates"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, candidates {CANDIDATES}")


def patterns(found: DataFrame) -> list:
    """Counts of all (kind, votes, length) of the corpus; lengths count as powers of two, so there are a few thousand at most."""
    return (found.select(F.inline("candidates")).groupBy("kind", F.col("votes").cast("array<int>").alias("votes"), "length").agg(F.count("*").alias("n"))
            .orderBy("kind", "votes", "length").collect())


def reliabilities(v: np.ndarray, n: np.ndarray, turns: int = 60) -> tuple[np.ndarray, float, np.ndarray]:
    """Expectation-maximisation on vote patterns of one kind.

    Returns the probability that each pattern is real, the share of real ones, and
    for real and false ones how often each labeler says yes among yes and no.
    Two pseudo-votes for a labeler that is right four times of five keep rare kinds sane.
    """
    share, yes = 0.5, np.array([[0.8] * v.shape[1], [0.2] * v.shape[1]])
    for _ in range(turns):
        logs = np.log([share, 1 - share])[:, None] + np.array([(np.where(v > 0, np.log(y), np.where(v < 0, np.log(1 - y), 0.0))).sum(axis=1) for y in yes])
        real = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -50, 50)))
        share = float(np.clip(((real * n).sum() + 1) / (n.sum() + 2), 0.01, 0.99))
        for side, weight in enumerate((real * n, (1 - real) * n)):
            said = (weight[:, None] * (v != 0)).sum(axis=0)
            yes[side] = ((weight[:, None] * (v > 0)).sum(axis=0) + (1.6 if side == 0 else 0.4)) / (said + 2)
    return real, share, yes


def _features(kind: str, v: list[int], length: int) -> list[float]:
    return [1.0, *(float(kind == k) for k in ALL), *(float(x > 0) for x in v), *(float(x < 0) for x in v), min(length, 8) / 8]


def fit(rows: list, turns: int = 400) -> dict[tuple, float]:
    """Score of every pattern (kind, votes, length) by the classifier trained on the estimated probabilities."""
    if not rows:
        return {}
    goal = np.zeros(len(rows))
    kinds = np.array([r["kind"] for r in rows])
    v, n = np.array([r["votes"] for r in rows]), np.array([r["n"] for r in rows], float)
    for kind in np.unique(kinds):
        goal[kinds == kind] = reliabilities(v[kinds == kind], n[kinds == kind])[0]
    x = np.array([_features(r["kind"], r["votes"], r["length"]) for r in rows])
    weight, part = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(turns):  # Newton steps with a small ridge, the patterns weighted by their counts
        p = 1 / (1 + np.exp(-np.clip(x @ weight, -50, 50)))
        slope = x.T @ (part * (p - goal)) + 1e-4 * weight
        curve = (x * (part * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-4 * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        weight -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    p = 1 / (1 + np.exp(-np.clip(x @ weight, -50, 50)))
    return {(r["kind"], tuple(r["votes"]), r["length"]): float(q) for r, q in zip(rows, p)}


def find(docs: DataFrame, least: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end, base, score), in order, of every row."""
    found = stored(candidates(docs, doc_id, text), "candidates")
    scores = fit(patterns(found))
    fields = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out = []
            for spans in batch.column("candidates").to_pylist():
                scored = [(s, scores[s["kind"], tuple(s["votes"]), s["length"]]) for s in spans]
                out.append([{"kind": s["kind"], "start": s["start"], "end": s["end"], "base": s["base"], "score": p} for s, p in scored if s["base"] or p >= least])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, fields)], names=["doc_id", "spans"])

    return found.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean, score: double>>")
