"""Language identification with rank-order n-gram profiles.

Every language gets the list of its most frequent character n-grams, in order of
frequency.  A document gets the same list, and its out-of-place distance to a
language is the sum, over the document's n-grams, of how far each one's rank is
from its rank in the language's list (the list's length if it isn't there).  The
nearest language wins.

An n-gram has 1 to 3 code points of the lower-cased text.  Every run of
characters that aren't letters counts as one space; a text begins and ends with
one.  A space may stand first or last in an n-gram of two or more, never alone
and never inside.

Defined cases: a null text and a text without a letter are ``und`` with score 0;
so is every text if no labelled text was given.  A null language isn't learned.
Equal distances go to the language that sorts first.  Ranks of equally frequent
n-grams follow the code points.  Long texts are counted in pieces and as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Letters, code_points

PROFILE = 300  # n-grams in a list
PIECE = 1 << 19  # code points counted at a time
HELD = 1 << 20  # counts a task keeps before it hands them on
UNKNOWN = "und"


def _spaced(text: str, letters: Letters) -> np.ndarray:
    """Code points, each run of other characters as one space, a space at both ends."""
    codes = code_points(text.lower())
    letter = letters(codes)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first character of each run of others
    out = np.where(letter, codes, 32)[keep].astype(np.int64)
    if not len(out):
        return out
    parts = [out] if out[0] == 32 else [np.array([32], np.int64), out]
    return np.concatenate(parts if out[-1] == 32 else [*parts, np.array([32], np.int64)])


def _keys(c: np.ndarray) -> np.ndarray:
    """All n-grams of a piece as numbers that sort like the strings; a piece ends before its last two places."""
    one = c << 42
    two = one[:-1] | (c[1:] << 21)
    three = two[:-1] | c[2:]
    return np.concatenate([one[c != 32], two, three[c[1:-1] != 32]])


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def gram_counts(text: str | None, letters: Letters) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (sorted) of a whole text and how often each occurs."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    c = _spaced(text, letters) if text else none[0]
    if not (c != 32).any():
        return none
    if len(c) <= PIECE:
        return np.unique(_keys(c), return_counts=True)
    keys, counts = none
    for at in range(0, len(c), PIECE):
        piece = c[at:at + PIECE + 2]
        grams = _keys(piece)
        if at + PIECE < len(c):  # what begins in the two places of overlap belongs to the next piece
            extra = _keys(piece[PIECE:])
            grams = np.sort(grams)
            drop, n = np.unique(extra, return_counts=True)
            got, m = np.unique(grams, return_counts=True)
            m[np.searchsorted(got, drop)] -= n
        else:
            got, m = np.unique(grams, return_counts=True)
        keys, counts = _merge(np.r_[keys, got], np.r_[counts, m])
    return keys[counts > 0], counts[counts > 0]


def _learn(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size, letters = 0, Letters(str.isalpha)

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            keys, counts = _merge(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys)), "gram": keys, "n": counts})

    for batch in source:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            grams = gram_counts(text, letters)
            if len(grams[0]):
                held.setdefault(lang, []).append(grams)
                size += len(grams[0])
            if size > HELD:
                for name, parts in held.items():
                    held[name] = [_merge(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]
                size = sum(len(p[0][0]) for p in held.values())
                if size > HELD // 2:
                    yield from out()
                    held, size = {}, 0
    yield from out()


def profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """The lists of all languages: ``lang``, ``gram`` (packed code points), ``n``, ``rank`` from 0.

    Counts cover every labelled text; each task adds up its own, so that the
    shuffle carries distinct n-grams only.
    """
    counted = (labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
               .where("text IS NOT NULL AND lang IS NOT NULL")
               .mapInArrow(_learn, "lang string, gram long, n long")
               .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counted.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size)


class Profiles:
    """The lists of all languages in one matrix; a few hundred numbers per language."""

    def __init__(self, rows: list, size: int = PROFILE):
        self.size = size
        self.langs = sorted({r["lang"] for r in rows})
        at = {lang: i for i, lang in enumerate(self.langs)}
        self.grams = np.unique(np.array([r["gram"] for r in rows], np.int64))
        self.ranks = np.full((len(self.langs), len(self.grams)), -1, np.int64)
        for r in rows:
            self.ranks[at[r["lang"]], np.searchsorted(self.grams, r["gram"])] = r["rank"]

    def classify(self, text: str | None, letters: Letters) -> tuple[str, float]:
        """The nearest language and 1 minus its distance over the largest possible one."""
        keys, counts = gram_counts(text, letters)
        if not len(keys) or not self.langs:
            return UNKNOWN, 0.0
        top = keys[np.argsort(-counts, kind="stable")[:self.size]]
        at = np.searchsorted(self.grams, top)
        at[at == len(self.grams)] = 0
        known = self.grams[at] == top
        listed = self.ranks[:, at[known]]
        moved = np.where(listed < 0, self.size, np.abs(listed - np.flatnonzero(known)))
        distance = moved.sum(axis=1) + self.size * int((~known).sum())
        best = int(np.argmin(distance))
        return self.langs[best], 1.0 - int(distance[best]) / (self.size * len(top))


def identify(docs: DataFrame, rows: list, text: str = "text", pred: str = "lang_pred", score: str = "score",
             size: int = PROFILE) -> DataFrame:
    """All columns of ``docs`` with the predicted language and its score; ``rows`` are collected profiles.

    Narrow: no shuffle, one pass over the texts.
    """
    model = Profiles(rows, size)
    kept = [c for c in docs.columns if c not in (pred, score)]
    schema = docs.select(*kept).schema.add(pred, "string").add(score, "double")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters(str.isalpha)
        for batch in source:
            found = [model.classify(t, letters) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*kept, pred, score])

    return docs.select(*kept).mapInArrow(run, schema)


def learned(labelled: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> list:
    """The profiles on the driver: ``size`` rows per language."""
    return profiles(labelled, text, lang, size).collect()
