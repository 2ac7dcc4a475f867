"""Benchmark decontamination by greedy string tiling.

A document is compared with every benchmark item that shares a seed, a run of
five words, with it.  The tiling marks the longest run of words that both have
and that isn't marked yet, and again, until no run of five is left; the runs of a
length are found by Karp-Rabin hashes, from long lengths to short ones.  The part
of the item's words that is marked is its coverage: sentences in another order,
or with words between them, still cover the item.  From one half on the document
counts as contaminated by the item.

Words are runs of letters and digits of the lower-cased text.  Items travel to
the tasks in blocks of a bounded number of words, one narrow pass over the texts
per block; the result doesn't depend on the blocks.

Defined cases: null and empty texts match nothing, nor do items without a word.
An item of fewer than five words is one seed, so only the whole item counts.
Equal items count each by itself.  Of equally long runs the first in the item,
then the first in the document is marked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import Hasher, windows

SEED = 5  # words
COVERED = 0.5
LONG = 20  # words; length the search begins with
BLOCK = 1 << 20  # words of benchmark items in a task at a time


def _equal_runs(p: np.ndarray, t: np.ndarray, free_p: np.ndarray, free_t: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Maximal common runs (length, place in p, place in t) of ``size`` or more free words."""
    def starts(words, free):
        h = windows(words, size)
        run = np.cumsum(np.r_[0, ~free])
        at = np.flatnonzero(run[size:] == run[:len(h)])
        return at, h[at]

    at_p, hash_p = starts(p, free_p)
    at_t, hash_t = starts(t, free_t)
    if not len(at_p) or not len(at_t):
        return []
    order = np.argsort(hash_p, kind="stable")
    low, high = (np.searchsorted(hash_p[order], hash_t, side) for side in ("left", "right"))
    out = []
    for k in np.flatnonzero(high > low):
        j = int(at_t[k])
        for i in map(int, at_p[order[low[k]:high[k]]]):
            if i and j and free_p[i - 1] and free_t[j - 1] and p[i - 1] == t[j - 1]:
                continue  # part of a run that begins earlier
            n = 0
            while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and free_p[i + n] and free_t[j + n]:
                n += 1
            if n >= size:
                out.append((n, i, j))
    return out


def tiles(p: np.ndarray, t: np.ndarray, seed: int = SEED) -> list[tuple[int, int, int]]:
    """The tiling of item ``p`` with document ``t`` (hashes of words): (length, place in p, place in t)."""
    free_p, free_t = np.ones(len(p), bool), np.ones(len(t), bool)
    seed = max(1, min(seed, len(p)))
    size, out = max(LONG, seed), []
    while True:
        found = sorted(_equal_runs(p, t, free_p, free_t, size), key=lambda r: (-r[0], r[1], r[2]))
        if found and found[0][0] > 2 * size:  # much longer than looked for: long runs first
            size = found[0][0]
            continue
        marked = False
        for at, (n, i, j) in enumerate(found):
            if free_p[i:i + n].all() and free_t[j:j + n].all():
                free_p[i:i + n] = free_t[j:j + n] = False
                out.append((n, i, j))
                marked = True
            elif marked:  # what is left of a run that is partly marked has its turn by its new length
                break
        if marked:
            continue
        if size == seed:
            return out
        size = size // 2 if size > 2 * seed else seed


class Items:
    """A block of benchmark items, by the hashes of their seeds."""

    def __init__(self, rows: list[tuple[int | None, str]], seed: int = SEED):
        hasher = Hasher()
        self.seed = seed
        self.ids = [r[0] for r in rows]
        self.words = [hasher.words(r[1]) for r in rows]
        seeds = [windows(w, min(seed, len(w))) for w in self.words]
        owner = np.repeat(np.arange(len(rows)), [len(s) for s in seeds])
        size = np.repeat([min(seed, len(w)) for w in self.words], [len(s) for s in seeds])
        flat = np.concatenate([*seeds, np.empty(0, np.uint64)])
        self.by_size = {}
        for n in np.unique(size).astype(int) if len(size) else []:
            order = np.argsort(flat[size == n], kind="stable")
            self.by_size[int(n)] = flat[size == n][order], owner[size == n][order]

    def matches(self, words: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Number of an item that shares a seed with the document, and the tiling."""
        for n, (seeds, owner) in self.by_size.items():
            h = windows(words, n)
            low = np.searchsorted(seeds, h)
            low[low == len(seeds)] = 0
            hits = np.flatnonzero(seeds[low] == h) if len(h) else np.empty(0, np.int64)
            if not len(hits):
                continue
            high = np.searchsorted(seeds, h[hits], "right")
            places: dict[int, list[int]] = {}
            for j, a, b in zip(hits.tolist(), low[hits].tolist(), high.tolist()):
                for item in dict.fromkeys(owner[a:b].tolist()):
                    places.setdefault(item, []).append(j)
            for item, at in places.items():
                # Only what lies in common seeds can be part of a tile; runs of it are kept apart by a word of no text.
                inside = np.zeros(len(words) + 1, bool)
                for k in range(n):
                    inside[np.array(at) + k] = True
                kept = np.flatnonzero(inside)
                gaps = np.flatnonzero(np.diff(kept) > 1) + 1
                yield item, tiles(self.words[item], np.insert(words[kept], gaps, 0), n)

    def contaminating(self, words: np.ndarray, covered: float) -> list[tuple[int | None, int, int, int, float]]:
        out = []
        for item, found in self.matches(words):
            n, size = sum(t[0] for t in found), len(self.words[item])
            if n >= covered * size:
                out.append((self.ids[item], len(found), n, size, n / size))
        return out


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", seed: int = SEED, block: int = BLOCK) -> Iterator[Items]:
    """The benchmark in blocks of about ``block`` words."""
    items = benchmark.select(F.col(item).cast("long").alias("item"), F.col(text).alias("text")).where("text IS NOT NULL")
    letters = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(letters // (4 * block)) + 1
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("text", "item"), F.lit(n)) == i) if n > 1 else items
        rows = [(r["item"], r["text"]) for r in part.collect()]
        if rows:
            yield Items(rows, seed)


def contaminations(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``item_id``, ``n_tiles``, ``n_words`` (marked), ``item_words``, ``coverage`` of every contaminated pair."""
    schema = "doc_id long, item_id long, n_tiles long, n_words long, item_words long, coverage double"
    names = ["doc_id", "item_id", "n_tiles", "n_words", "item_words", "coverage"]
    types = [pa.int64()] * 5 + [pa.float64()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    out = docs.sparkSession.createDataFrame([], schema)
    for items in blocks(benchmark, seed=seed, block=block):
        def run(source: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            hasher = Hasher()
            for batch in source:
                found = [(i, *m) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                         for m in items.contaminating(hasher.words(t), covered)]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(types)], names=names)

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that no item contaminates; narrow, all columns kept."""
    for items in blocks(benchmark, seed=seed, block=block):
        def run(source: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            hasher = Hasher()
            for batch in source:
                keep = [t is None or not items.contaminating(hasher.words(t), covered) for t in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
