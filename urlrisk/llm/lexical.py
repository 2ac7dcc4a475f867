"""Ranked lexical search, half term at a time, half document at a time.

* **Index.**  A task cuts its documents into segments of a bounded size.  A row of the
  index is one term in one segment: the places of its documents in the segment and
  how often each holds it.  One more row a segment, without a term, has the ids and
  lengths of its documents.  Counts for the weights are sums over these rows.
* **Search.**  Index rows meet the items that ask for their term; the rows of one
  segment and one block of items are searched by one task.  For an item, lists shorter
  than ``1 / SHORT`` of the segment are added up term by term into accumulators.
  Accumulators are lower bounds of scores, so the ``k``-th of them is the first
  threshold; sorted by place they are one more list with a bound.  This list and the
  long ones are then read together in order of documents, ``WINDOW`` places at a time:
  a window whose bounds together stay below the threshold is skipped, and in all
  others only documents that lists with large bounds propose are looked up in the
  rest.  The best ``k`` of all segments are merged.

Scores are sums of ``weight * gain`` in 64-bit integers; see ``weight`` and ``gains``.
Nothing is approximate: bounds are maxima over the lists themselves.

If the items have at most ``VOCABULARY`` distinct terms, only those are indexed;
otherwise all terms are.  Both give the same rows.  Items go in blocks of about
``BLOCK`` terms.

Defined cases: texts that are null or have no term take no part and don't count.  Rows
that repeat a doc_id are documents of their own.  Equal scores go by the smaller
doc_id, null last.  Rows of the items that repeat both item_id and text are one item;
other rows with one item_id are items with a list each.  Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

SEGMENT_BYTES = 1 << 23
SEGMENT_DOCS = 1 << 16  # places fit into 16 bits
PIECE = 1 << 20  # bytes cut into terms at a time
VOCABULARY = 1 << 18  # terms that tasks may hold
BLOCK = 1 << 15  # terms of items searched together
SHORT = 16
WINDOW = 256
TOP = 20

_TERM = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
#: A-Z in lower case, characters of terms as they are, all others a space.
FOLDED = bytes(i + 32 if 65 <= i <= 90 else i if i in _TERM else 32 for i in range(256))
INDEX = "segment long, term binary, n_docs long, n_words long, places binary, counts binary, doc_ids array<long>"


def term_counts(text: bytes | None) -> Counter:
    """Terms of a text (UTF-8) and how often it holds each, a piece of bounded size at a time."""
    found: Counter = Counter()
    folded = (text or b"").translate(FOLDED)
    at = 0
    while at < len(folded):
        till = folded.find(b" ", at + PIECE)
        till = len(folded) if till < 0 else till
        found.update(folded[at:till].split())
        at = till
    return found


class _Segment:
    """Postings of one segment while a task fills it."""

    def __init__(self):
        self.places: dict[bytes, list[int]] = {}
        self.counts: dict[bytes, list[int]] = {}
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.bytes = 0

    def add(self, doc_id: int | None, size: int, found: Counter, terms: frozenset[bytes] | None) -> None:
        place, n = len(self.ids), sum(found.values())
        self.bytes += size
        if not n:
            return
        self.ids.append(doc_id)
        self.sizes.append(n)
        for term in found if terms is None else terms.intersection(found):
            self.places.setdefault(term, []).append(place)
            self.counts.setdefault(term, []).append(found[term])

    def rows(self, number: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        terms = list(self.places)
        n = len(terms) + 1
        yield pa.RecordBatch.from_arrays([
            pa.array([number] * n, pa.int64()), pa.array([*terms, None], pa.binary()),
            pa.array([*(len(self.places[t]) for t in terms), len(self.ids)], pa.int64()), pa.array([None] * (n - 1) + [sum(self.sizes)], pa.int64()),
            pa.array([*(np.array(self.places[t], "<u2").tobytes() for t in terms), None], pa.binary()),
            pa.array([*(np.array(self.counts[t], "<u4").tobytes() for t in terms), np.array(self.sizes, "<i8").tobytes()], pa.binary()),
            pa.array([None] * (n - 1) + [self.ids], pa.list_(pa.int64()))], schema=schema)


_ARROW = pa.schema([("segment", pa.int64()), ("term", pa.binary()), ("n_docs", pa.int64()), ("n_words", pa.int64()),
                    ("places", pa.binary()), ("counts", pa.binary()), ("doc_ids", pa.list_(pa.int64()))])


def index(docs: DataFrame, terms: frozenset[bytes] | None = None, doc_id: str = "doc_id", text: str = "text",
          segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The index of all documents, of some terms or (``None``) of all; one narrow pass, written to the shared folder."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, segment = TaskContext.get().partitionId() << 32, _Segment()
        for batch in source:
            for key, value in zip(batch.column("doc_id"), batch.column("text")):
                raw = value.as_py()
                segment.add(key.as_py(), len(raw or b""), term_counts(raw), terms)
                if segment.bytes >= segment_bytes or len(segment.ids) >= SEGMENT_DOCS:
                    yield from segment.rows(number, _ARROW)
                    number, segment = number + 1, _Segment()
        if segment.ids:
            yield from segment.rows(number, _ARROW)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).where("text IS NOT NULL")
    return stored(rows.mapInArrow(run, INDEX), "lexical-index")


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """``key`` (of an item), ``item_id``, ``term``, ``times``."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = [(k, i, t, n) for k, i, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "item_id", "text"))) for t, n in term_counts(raw).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.string(), pa.int64(), pa.binary(), pa.int64()))],
                                             names=["key", "item_id", "term", "times"])

    rows = items.select(F.col(item).cast("long").alias("item_id"), F.col(text).alias("text")).where("text IS NOT NULL").distinct()
    keyed = rows.select(F.md5(F.concat_ws(":", F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text")).alias("key"), "item_id", F.col("text").cast("binary").alias("text"))
    return keyed.mapInArrow(run, "key string, item_id long, term binary, times long")


def vocabulary(terms: DataFrame, most: int = VOCABULARY) -> frozenset[bytes] | None:
    """The distinct terms on the driver, or ``None`` if there are more than ``most``."""
    rows = terms.select("term").distinct().limit(most + 1).collect()
    return None if len(rows) > most else frozenset(bytes(r["term"]) for r in rows)


def weight(n_docs: int, df: Column) -> Column:
    """Weight of a term that ``df`` of ``n_docs`` documents hold."""
    return F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * df + 1).cast("double"))).cast("long")


def norms(sizes: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """Length norms of documents; in integers of any size, as ``25 * n * N`` may pass 64 bits."""
    return (sizes.astype(object) * (25 * n_docs) // n_words + 75).astype(np.int64)


def gains(counts: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What an occurrence count adds, for a weight of 1."""
    return 1_000_000_000 * counts // (1000 * counts + 12 * norm)


class _List:
    """A list in order of places, its values, and their maximum in every window."""

    def __init__(self, places: np.ndarray, values: np.ndarray, windows: int, window: int):
        self.places, self.values = places, values
        self.edges = np.searchsorted(places, np.arange(windows + 1) * window)
        self.most = np.zeros(windows, np.int64)
        full = np.flatnonzero(self.edges[1:] > self.edges[:-1])
        if len(full):
            self.most[full] = np.maximum.reduceat(values, self.edges[full])


class Best:
    """The best ``k`` documents so far and the score that a document must reach."""

    def __init__(self, k: int, order: np.ndarray):
        self.k, self.order = k, order
        self.places, self.scores = np.empty(0, np.int64), np.empty(0, np.int64)
        self.least = 1

    def offer(self, places: np.ndarray, scores: np.ndarray) -> None:
        places, scores = np.concatenate([self.places, places]), np.concatenate([self.scores, scores])
        top = np.lexsort((self.order[places], -scores))[:self.k]
        self.places, self.scores = places[top], scores[top]
        if len(top) == self.k:
            self.least = max(self.least, int(self.scores[-1]))


class Segment:
    """The postings of one segment, ready for a search."""

    def __init__(self, ids: list[int | None], sizes: np.ndarray, n_docs: int, n_words: int, window: int = WINDOW, short: int = SHORT):
        self.ids, self.norm, self.window, self.short = ids, norms(sizes, n_docs, n_words), window, short
        self.windows = -(-len(ids) // window)
        # Rank of every place among equal scores: by doc_id, null last.
        self.order = np.empty(len(ids), np.int64)
        self.order[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))] = np.arange(len(ids))
        self.lists: dict[bytes, _List | tuple[np.ndarray, np.ndarray]] = {}

    def add(self, term: bytes, places: np.ndarray, counts: np.ndarray) -> None:
        values = gains(counts.astype(np.int64), self.norm[places])
        short = len(places) * self.short < len(self.ids)
        self.lists[term] = (places, values) if short else _List(places, values, self.windows, self.window)

    def accumulated(self, wanted: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Sums over the short lists, term at a time: places in order and their accumulators."""
        sums: np.ndarray = np.zeros(len(self.ids), np.int64)
        for term, w in wanted:
            found = self.lists[term]
            if isinstance(found, tuple):
                sums[found[0]] += w * found[1]
        places = np.flatnonzero(sums)
        return places, sums[places]

    def search(self, wanted: list[tuple[bytes, int]], k: int = TOP) -> tuple[list[int | None], list[int]]:
        """Ids and scores of the best ``k`` documents of the segment; ``wanted`` has terms and weights above 0."""
        wanted = [(t, w) for t, w in wanted if t in self.lists]
        best = Best(k, self.order)
        places, sums = self.accumulated(wanted)
        lists = [(w, x) for t, w in wanted if isinstance(x := self.lists[t], _List)]
        if len(places):
            if len(sums) >= k:
                best.least = max(1, int(np.partition(sums, -k)[-k]))
            lists.append((1, _List(places, sums, self.windows, self.window)))
        if not lists:
            return [], []
        bounds = np.stack([w * x.most for w, x in lists])
        reach = bounds.sum(axis=0)
        for at in np.flatnonzero(reach >= best.least).tolist():
            if reach[at] >= best.least:
                self._window(at, lists, bounds[:, at], best)
        return [self.ids[i] for i in best.places.tolist()], best.scores.tolist()

    def _window(self, at: int, lists: list[tuple[int, _List]], bounds: np.ndarray, best: Best) -> None:
        """Offer the documents of one window that can reach the threshold."""
        order = np.argsort(-bounds)
        rest = bounds.sum() - np.cumsum(bounds[order])  # what the lists after each one can add
        first = at * self.window
        sums = np.zeros(min(self.window, len(self.ids) - first), np.int64)
        live = None  # all proposed so far
        for j, after in zip(order.tolist(), rest.tolist()):
            w, x = lists[j]
            a, b = x.edges[at], x.edges[at + 1]
            if a == b:
                continue
            if live is None:
                sums[x.places[a:b] - first] += w * x.values[a:b]
                if after < best.least:  # no document that only the other lists hold can be among the best
                    live = np.flatnonzero(sums + after >= best.least)
            else:
                found = a + np.searchsorted(x.places[a:b], live + first)
                hit = found < b
                hit[hit] = x.places[found[hit]] == live[hit] + first
                sums[live[hit]] += w * x.values[found[hit]]
                live = live[sums[live] + after >= best.least]
            if live is not None and not len(live):
                return
        live = np.flatnonzero(sums >= best.least) if live is None else live[sums[live] >= best.least]
        best.offer(live + first, sums[live])


def search(indexed: DataFrame, terms: DataFrame, k: int = TOP, block: int = BLOCK, window: int = WINDOW, short: int = SHORT) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the best ``k`` documents with a score above 0 of every item."""
    spark = indexed.sparkSession
    total = indexed.where("term IS NULL").agg(F.sum("n_docs").alias("docs"), F.sum("n_words").alias("words")).first()
    n_docs, n_words = int(total["docs"] or 0), int(total["words"] or 0)
    if not n_docs:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    blocks = int(terms.count() // block) + 1
    df = indexed.where("term IS NOT NULL").groupBy("term").agg(F.sum("n_docs").alias("df"))
    weighed = (terms.join(df, "term").withColumn("weight", F.col("times") * weight(n_docs, F.col("df"))).where("weight > 0")
               .groupBy("term", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"))
               .agg(F.collect_list(F.struct("key", "item_id", "weight")).alias("asked")))
    lists = indexed.where("term IS NOT NULL").join(weighed, "term").select("segment", "block", "term", "places", "counts", "doc_ids", "asked")
    heads = (indexed.where("term IS NULL").select("segment", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "term", "places", "counts", "doc_ids")
             .withColumn("asked", F.lit(None).cast(weighed.schema["asked"].dataType)))

    def run(rows: pa.Table) -> pa.Table:
        of = {c: rows.column(c) for c in ("term", "places", "counts", "doc_ids", "asked")}
        names = of["term"].to_pylist()
        head = names.index(None)
        segment = Segment(of["doc_ids"][head].as_py(), np.frombuffer(of["counts"][head].as_py(), "<i8"), n_docs, n_words, window, short)
        wanted: dict[tuple[str, int | None], list[tuple[bytes, int]]] = {}
        for i, term in enumerate(names):
            if term is not None:
                segment.add(term, np.frombuffer(of["places"][i].as_py(), "<u2").astype(np.int64), np.frombuffer(of["counts"][i].as_py(), "<u4"))
                for ask in of["asked"][i].as_py():
                    wanted.setdefault((ask["key"], ask["item_id"]), []).append((term, ask["weight"]))
        out: list[tuple] = []
        for (key, item), lists_ in wanted.items():
            out.extend((key, item, d, s) for d, s in zip(*segment.search(lists_, k)))
        return pa.table({name: pa.array([r[j] for r in out], kind) for j, (name, kind) in
                         enumerate((("key", pa.string()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())))})

    found = lists.unionByName(heads).groupBy("segment", "block").applyInArrow(run, "key string, item_id long, doc_id long, score long")
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """The best ``k`` documents of every item, over an index made for these items."""
    terms = stored(item_terms(items), "lexical-items")
    return search(index(docs, vocabulary(terms)), terms, k)
