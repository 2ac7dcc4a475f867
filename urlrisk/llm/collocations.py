"""Phrases whose words go together, by sampling, a negative border and exact passes.

* **Sample.**  A fraction of the documents proposes words and pairs of words: those it
  holds ``SAMPLE_LEAST`` times or more.  What is proposed decides only in which pass a
  phrase is counted, never whether.
* **Full pass.**  Over all documents the proposed phrases are counted exactly, and with
  them their negative border: all other words, and every longer phrase that was not
  proposed although both phrases that it holds without its last or first word were.
* **Expansion.**  Phrases of the border that turn out frequent are failures: phrases
  that hold them have not been counted.  Another pass counts those that hold frequent
  phrases only and were in no pass before, and so on until no failure is left.  Phrases
  of up to three words take three full passes at most.

A task hashes words to 64 bits and counts phrases as tuples of hashes; packed counts
meet in buckets whose number grows with the texts.  A second hash of every word shows when two words of the corpus
share the first, and then all is done again with another seed.  Whether a phrase is
proposed or frequent is looked up in bit maps of ``BITS`` bits, which do not grow with
the corpus; two phrases that share a bit only make the border larger.  Texts of words
are fetched at the end, for the phrases of the result.

Counts of words and pairs meet the candidates in a shuffle; those that make up more
than ``1 / HOT`` of all words, at most ``HOT`` of each, are broadcast instead.

Defined cases: a null text is empty; a null ``lang`` is ``und``.  Repeated rows count
each.  Other columns are ignored.  Words are bytes between separators, so a text is cut
alike whatever characters it holds; long texts are hashed in pieces that end at a
separator.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import mix64, stored

SUPPORT = 10
FRACTION = 1 / 16
SAMPLE_LEAST = 2
LIMIT = 2000
OVERLAP = 50  # percent of a phrase's places that a longer one must hold to replace it
BITS = 1 << 25
HOT = 4096
WORDS = 1 << 19  # counted at a time; its third power must fit into 63 bits
PIECE = 1 << 18  # bytes hashed at a time
BUCKET_BYTES = 3 << 22  # bytes of texts for which there is one bucket of counts
NO_LANG = "und"

#: A-Z in lower case.
FOLD = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
#: 1 between words, 2 between pieces.
KIND = np.zeros(256, np.uint8)
KIND[list(b" \t")] = 1
KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
GAP = np.uint64(0x9E3779B97F4A7C15)
FOUND = "lang string, size int, a long, b long, c long, n long, shared boolean"


class Hasher:
    """Two hashes of every word of a piece of text."""

    def __init__(self, seed: int):
        self.seed = np.uint64(mix64(np.array([seed + 1], np.uint64))[0])
        self.bases = [0x100000001B3 + 2 * int(self.seed % np.uint64(1 << 20)), 0x5851F42D4C957F2D]
        self.powers: list[tuple[np.ndarray, np.ndarray]] = []

    def _grow(self, n: int) -> None:
        if not self.powers or len(self.powers[0][0]) < n:
            self.powers = []
            for base in self.bases:
                pair = []
                for step in (base, pow(base, -1, 1 << 64)):
                    steps = np.full(n, step, np.uint64)
                    steps[0] = 1
                    pair.append(np.cumprod(steps, dtype=np.uint64))
                self.powers.append((pair[0], pair[1]))

    def __call__(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and second hash, start and end of every word, and how many piece ends lie before it."""
        codes = np.frombuffer(raw, np.uint8)
        kind = KIND[codes]
        inside = np.zeros(len(codes) + 2, bool)
        inside[1:-1] = kind == 0
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        self._grow(max(len(codes), 1))
        found = []
        for up, down in self.powers:
            sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:len(codes)], out=sums[1:])
            found.append(mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * GAP + self.seed))
        ends = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(kind == 2, out=ends[1:])
        return found[0].view(np.int64), found[1].view(np.int64), start, end, ends[np.r_[start, len(codes)]]


def pieces(raw: bytes) -> Iterator[bytes]:
    """A text in pieces of about ``PIECE`` bytes that end at a separator."""
    at = 0
    while at < len(raw):
        till = at + PIECE
        while till < len(raw):
            after = np.flatnonzero(KIND[np.frombuffer(raw, np.uint8, min(PIECE, len(raw) - till), till)])
            if len(after):
                till += int(after[0])
                break
            till += PIECE
        yield raw[at:till]
        at = till


class Words(NamedTuple):
    """Words in the order of the texts."""

    first: np.ndarray
    second: np.ndarray
    start: np.ndarray
    end: np.ndarray
    fresh: np.ndarray  # begins a piece
    old: np.ndarray  # counted before, here for the phrases that go on from it
    raw: bytes


class Buffer:
    """Words of one language that a task has read and not yet counted."""

    def __init__(self):
        self.waiting: list[bytes] = []
        self.fresh = True
        self._clear([])

    def _clear(self, carried: list[np.ndarray]) -> None:
        self.parts, self.raw, self.size, self.n = [carried] if carried else [], [], 0, 0

    def hashed(self, hasher: Hasher) -> Iterator[int]:
        """Hash the waiting texts; yields after each piece how many words it has."""
        raw, self.waiting = b"\n".join([*self.waiting, b""]), []
        for piece in pieces(raw):
            first, second, start, end, ends = hasher(piece)
            n = len(first)
            if n:
                fresh = np.r_[self.fresh or ends[0] > 0, ends[1:-1] != ends[:-2]]
                self.parts.append([first, second, start + self.size, end + self.size, fresh, np.zeros(n, bool)])
                self.fresh = bool(ends[-1] > ends[-2])
            else:
                self.fresh = self.fresh or bool(ends[-1])
            self.raw.append(piece)
            self.size += len(piece)
            self.n += n
            yield n

    def take(self) -> Words | None:
        """All words so far; the last two stay as old ones, as a text may go on."""
        if not self.n:
            return None
        arrays, raw = [np.concatenate(x) for x in zip(*self.parts)], b"".join(self.raw)
        carried = [x[-2:].copy() for x in arrays]
        carried[4][0], carried[5][:] = True, True
        self._clear(carried)
        return Words(*arrays, raw)


def read(source: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[str, Words]]:
    """Words by language, a bounded number at a time."""
    hasher, held, waiting, words = Hasher(seed), {}, 0, 0

    def hashed(lang: str, buffer: Buffer) -> Iterator[tuple[str, Words]]:
        for _ in buffer.hashed(hasher):
            if buffer.n >= WORDS:
                yield lang, buffer.take()

    for batch in source:
        for lang, value in zip(batch.column("lang").to_pylist(), batch.column("text")):
            text = (value.as_py() or b"").translate(FOLD)
            buffer = held.setdefault(lang, Buffer())
            buffer.waiting.append(text)
            waiting += len(text)
            if waiting >= PIECE:
                for name, other in list(held.items()):
                    yield from hashed(name, other)
                waiting, words = 0, sum(b.n for b in held.values())
                if words >= WORDS:
                    yield from ((name, found) for name, b in held.items() if (found := b.take()))
                    held = {}
    for lang, buffer in held.items():
        yield from hashed(lang, buffer)
        if found := buffer.take():
            yield lang, found


class Maps(NamedTuple):
    """Bit maps of the words and pairs that a pass builds on."""

    words: np.ndarray
    pairs: np.ndarray


def _slots(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    mixed = mix64(a.view(np.uint64))
    if b is not None:
        mixed = mix64(mixed + GAP + b.view(np.uint64))
    return mixed & np.uint64(BITS - 1)


def _holds(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> np.uint64(6)] >> (slots & np.uint64(63)) & np.uint64(1)).astype(bool)


def _tuples(keys: np.ndarray, words: np.ndarray, size: int) -> dict:
    """Phrases and their counts, from phrases given as numbers to the base of the number of words."""
    rest, n = np.unique(keys, return_counts=True)
    out = {"n": n, "size": size}
    for name in "cba"[3 - size:]:
        rest, at = np.divmod(rest, len(words))
        out[name] = words[at]
    return out


def counted(words: Words, passes: list[Maps] | None) -> Iterator[dict]:
    """Phrases of one size with their counts: ``size`` and arrays ``a``, ``b``, ``c``, ``n`` and, for words, ``check``.

    Without ``passes`` all words and pairs are counted, for a sample.  Else: words, if
    this is the first pass; pairs of words that the last of ``passes`` has; triples of
    pairs that it has; each only if no earlier one let it in.
    """
    u, at, inverse, n = np.unique(words.first, return_index=True, return_inverse=True, return_counts=True)
    if passes is None or len(passes) == 1:
        new = ~words.old
        n = np.bincount(inverse[new], minlength=len(u))
        other = np.flatnonzero(words.second != words.second[at][inverse])  # words that share the first hash
        for places, amount in ((at[n > 0], n[n > 0]), (other, np.zeros(len(other), np.int64))):
            yield {"size": 1, "a": words.first[places], "n": amount, "check": words.second[places]}
    if len(inverse) < 2:
        return
    joined = ~words.fresh[1:]
    new = joined & ~(words.old[:-1] & words.old[1:])
    base = len(u)
    pair = inverse[:-1] * base + inverse[1:]
    if passes is None:
        yield _tuples(pair[new], u, 2)
        return
    slots = np.zeros(len(joined), np.uint64)
    slots[joined] = _slots(words.first[:-1][joined], words.first[1:][joined])
    before = [np.zeros(len(joined), bool), np.zeros(len(joined) - 1, bool)]
    for maps in passes:
        known = _holds(maps.words, _slots(u))[inverse]
        pairs = known[:-1] & known[1:]
        linked = joined & _holds(maps.pairs, slots)
        triples = linked[:-1] & linked[1:]
        now = [new & pairs & ~before[0], triples & ~before[1]]
        before = [before[0] | pairs, before[1] | triples]
    yield _tuples(pair[now[0]], u, 2)
    yield _tuples(pair[:-1][now[1]] * base + inverse[2:][now[1]], u, 3)


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text).cast("binary").alias("text")).where("text IS NOT NULL")


def _bucket(row: dict, buckets: int) -> np.ndarray:
    """Which bucket counts a phrase: a hash of its words, so that buckets are even."""
    mixed = mix64(row["a"].view(np.uint64))
    for c in "bc":
        if c in row:
            mixed = mix64(mixed + GAP + row[c].view(np.uint64))
    return (mixed % np.uint64(buckets)).astype(np.int64)


#: Columns of a packed row beside its count, by the number of words; 0 is for the number of all words.
PACKED = {0: ("a",), 1: ("a", "check"), 2: ("a", "b"), 3: ("a", "b", "c")}


def packed(lang: str, row: dict, buckets: int) -> pa.RecordBatch:
    """Counts of a task as one binary value for each bucket: its columns one after the other, then the counts."""
    bucket = _bucket(row, buckets)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0, True])
    columns = [*(row[c][order].astype("<i8") for c in PACKED[row["size"]]), row["n"][order].astype("<u4")]
    values = [b"".join(c[i:j].tobytes() for c in columns) for i, j in zip(edges, edges[1:])]
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array([row["size"]] * len(values), pa.int32()),
                                       pa.array(bucket[order][edges[:-1]]), pa.array(values, pa.binary())], names=["lang", "size", "bucket", "counts"])


def summed(size: int, values: list[bytes | pa.Buffer], least: int) -> dict[str, np.ndarray]:
    """Phrases of one bucket with their exact counts, those with ``least`` or more; ``shared`` where two words have the first hash."""
    names = PACKED[size]
    width = 8 * len(names) + 4
    n = np.concatenate([np.frombuffer(v, "<u4", offset=8 * len(names) * (len(v) // width)) for v in values]).astype(np.int64)
    keys = [np.concatenate([np.frombuffer(v, "<i8", len(v) // width, 8 * i * (len(v) // width)) for v in values]) for i in range(len(names))]
    order = np.lexsort(keys[::-1])
    n = n[order]
    for i in range(len(keys)):  # one at a time, so that each unsorted one goes before the next is copied
        keys[i] = keys[i][order]
    del order
    own = keys[:1] if size == 1 else keys
    edges = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in own], axis=0), True])
    first, last = edges[:-1], edges[1:] - 1
    total = np.add.reduceat(n, first)
    shared = keys[1][first] != keys[1][last] if size == 1 else np.zeros(len(first), bool)
    kept = (total >= least) | shared | (size == 0)
    zeros = np.zeros(int(kept.sum()), np.int64)
    out = {c: k[first][kept] for c, k in zip(names, keys) if c != "check"}
    return {**{c: out.get(c, zeros) for c in "abc"}, "n": total[kept], "shared": shared[kept]}


def phrase_counts(texts: DataFrame, passes: list[Maps] | None, seed: int, buckets: int, least: int) -> DataFrame:
    """Exact counts of the phrases of a pass that occur ``least`` times or more (``FOUND``).

    A task adds up its own; phrases then meet in ``buckets`` by their hash, a bounded
    number in each.  Passes that count words have a row of size 0 for each language with
    the number of all its words.
    """
    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in read(source, seed):
            if passes is None or len(passes) == 1:
                yield packed(lang, {"size": 0, "a": np.zeros(1, np.int64), "n": np.array([np.sum(~words.old)])}, buckets)
            for row in counted(words, passes):
                if len(row["n"]):
                    yield packed(lang, row, buckets)

    def add(rows: pa.Table) -> pa.Table:
        size = rows.column("size")[0].as_py()
        out = summed(size, [v.as_buffer() for v in rows.column("counts")], least)
        n = len(out["n"])
        return pa.table({"lang": pa.array([rows.column("lang")[0].as_py()] * n, pa.string()), "size": pa.array(np.full(n, size, np.int32)), **out})

    return texts.mapInArrow(count, "lang string, size int, bucket long, counts binary").groupBy("lang", "size", "bucket").applyInArrow(add, FOUND)


def bit_maps(found: DataFrame) -> Maps:
    """Bit maps of the words and pairs of a table of counts; as large for any table."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            size, a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("size", "a", "b"))
            slots = np.where(size == 1, _slots(a), _slots(a, b))
            key = size.astype(np.int64) * (BITS // 64) + (slots >> np.uint64(6)).astype(np.int64)
            order = np.argsort(key)
            at = np.flatnonzero(np.r_[True, np.diff(key[order]) > 0]) if len(key) else np.empty(0, np.int64)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (slots[order] & np.uint64(63)), at) if len(key) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(key[order][at]), pa.array(bits.view(np.int64))], names=["at", "bits"])

    rows = (found.where("size IN (1, 2)").select("size", "a", "b").mapInArrow(run, "at long, bits long")
            .groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow())
    maps = Maps(np.zeros(BITS // 64, np.uint64), np.zeros(BITS // 64, np.uint64))
    at, bits = rows.column("at").to_numpy(), rows.column("bits").to_numpy().view(np.uint64)
    for size, target in enumerate(maps, 1):
        own = at // (BITS // 64) == size
        target[at[own] % (BITS // 64)] = bits[own]
    return maps


class SharedHash(Exception):
    """Two words of the corpus have one hash."""


def frequent(texts: DataFrame, support: int = SUPPORT, fraction: float = FRACTION, sample_least: int = SAMPLE_LEAST, seed: int = 0) -> tuple[DataFrame, int]:
    """Exact counts of all phrases of one to three words with ``support`` or more, and the totals (size 0); and how many full passes it took."""
    buckets = 1 + (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES
    # Stored first: a stage that counts and maps at once has two Python workers for each task, and they stay.
    maps = bit_maps(stored(phrase_counts(texts.where(F.rand(seed) < fraction), None, seed, 1 + int(buckets * fraction), sample_least), "sample-phrases"))
    passes, found = [], None
    while True:
        passes.append(maps)
        counts = stored(phrase_counts(texts, list(passes), seed, buckets, support), "phrases")
        if counts.where("shared").limit(1).count():
            raise SharedHash
        counts = counts.drop("shared")
        found = counts if found is None else found.unionByName(counts)
        maps = bit_maps(found)
        if all(any(not (maps[i] & ~p[i]).any() for p in passes) for i in range(2)):  # all that is frequent was built upon
            return found, len(passes)


def _joined(rows: DataFrame, keys: list[str], counts: DataFrame, totals: int, name: str) -> DataFrame:
    """``rows`` with the count ``name`` of the phrase that ``keys`` say.

    Phrases that make up ``1 / HOT`` of all words are broadcast; rows that found theirs
    there go through the shuffle under a hash of the row, where they meet nothing.
    """
    own = counts.where(F.col("size") == len(keys)).select("lang", *(F.col(c).alias(k) for c, k in zip("abc", keys)), F.col("n").alias(name))
    hot = F.col(name) > totals // HOT
    first = rows.join(F.broadcast(own.where(hot).withColumnRenamed(name, "_hot")), ["lang", *keys], "left")
    first = first.withColumns({"_cold": F.col("_hot").isNull(), "_key": F.when(F.col("_hot").isNull(), F.col(keys[0])).otherwise(F.xxhash64(*rows.columns))})
    cold = own.where(~hot).select(F.col("lang").alias("_lang"), *(F.col(k).alias(f"_{k}") for k in keys), F.col(name).alias("_n"), F.lit(True).alias("_is"))
    same = (F.col("lang") == F.col("_lang")) & (F.col("_key") == F.col(f"_{keys[0]}")) & (F.col("_cold") == F.col("_is"))
    for k in keys[1:]:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return first.join(cold, same, "left").withColumn(name, F.coalesce("_hot", "_n")).select(*rows.columns, name)


def _score(a: str, l: str, r: str) -> Column:
    """``floor(1000000 * a * a / (l * r))`` in integers beyond 64 bits."""
    return F.expr(f"(1000000BD * cast({a} AS decimal(15, 0)) * cast({a} AS decimal(15, 0))) div (cast({l} AS decimal(15, 0)) * cast({r} AS decimal(15, 0)))")


def candidates(found: DataFrame) -> DataFrame:
    """Frequent phrases of two and three words that no longer one replaces, with ``l``, ``r`` and ``score`` of their lowest cut."""
    totals = int(found.where("size = 0").agg(F.sum("n")).first()[0] or 0)
    pairs, triples = (found.where(F.col("size") == n).drop("size").withColumnRenamed("n", "count") for n in (2, 3))
    within = [triples.select("lang", *(F.col(c).alias(k) for c, k in zip(held, "ab")), "count") for held in ("ab", "bc")]
    covered = within[0].unionByName(within[1]).groupBy("lang", "a", "b").agg(F.max("count").alias("most"))
    two = pairs.join(covered, ["lang", "a", "b"], "left").where(F.col("most").isNull() | (100 * F.col("most") < OVERLAP * F.col("count"))).drop("most", "c")
    two = _joined(_joined(two, ["a"], found, totals, "l"), ["b"], found, totals, "r").withColumn("score", _score("count", "l", "r"))
    three = triples
    for keys, name in ((["a"], "l1"), (["b", "c"], "r1"), (["a", "b"], "l2"), (["c"], "r2")):
        three = _joined(three, keys, found, totals, name)
    three = three.withColumn("s1", _score("count", "l1", "r1")).withColumn("s2", _score("count", "l2", "r2"))
    second = F.col("s2") < F.col("s1")
    three = three.select("lang", "a", "b", "c", "count", *(F.when(second, F.col(y)).otherwise(F.col(x)).alias(k) for x, y, k in (("l1", "l2", "l"), ("r1", "r2", "r"), ("s1", "s2", "score"))))
    return two.withColumn("c", F.lit(None).cast("long")).unionByName(three).withColumnRenamed("count", "f")


def first_of(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of each language up to the ``limit``-th by score and count, with all that equal the last of them.

    Equal rows are counted first, so that what is sorted per language is at most ``limit`` different values of each task.
    """
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"))
    values = rows.groupBy("lang", "score", "f").agg(F.count("*").alias("rows")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    before = F.coalesce(F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = values.withColumn("before", before).where(F.col("before") < limit).groupBy("lang").agg(F.max_by(F.struct("score", "f"), "place").alias("last"))
    return rows.join(last, "lang").where(F.struct("score", "f") >= F.col("last")).drop("last")


def word_texts(texts: DataFrame, wanted: np.ndarray, seed: int) -> DataFrame:
    """``lang, word`` (hash), ``text`` of the words whose bit is set in ``wanted``."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in read(source, seed):
            new = np.flatnonzero(~words.old)
            first, at = np.unique(words.first[new], return_index=True)
            at = new[at[_holds(wanted, _slots(first))]]
            spelled = [words.raw[a:b] for a, b in zip(words.start[at].tolist(), words.end[at].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(words.first[at]), pa.array(spelled, pa.binary())], names=["lang", "word", "text"])

    return texts.mapInArrow(run, "lang string, word long, text binary").distinct()


def collocations(docs: DataFrame, support: int = SUPPORT, limit: int = LIMIT, fraction: float = FRACTION, sample_least: int = SAMPLE_LEAST,
                 text: str = "text", lang: str = "lang", seed: int = 0) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``limit`` phrases of every language.

    ``a`` is the count of the phrase, ``l`` and ``r`` those of the parts of its lowest
    cut, ``n`` the number of all words of the language.
    """
    texts = _texts(docs, text, lang)
    try:
        found, _ = frequent(texts, support, fraction, sample_least, seed)
    except SharedHash:
        return collocations(docs, support, limit, fraction, sample_least, text, lang, seed + 1)
    best = stored(first_of(stored(candidates(found), "candidates"), limit), "first-phrases")
    words = [best.select("lang", F.col(c).alias("a")).where("a IS NOT NULL") for c in "abc"]
    needed = words[0].unionByName(words[1]).unionByName(words[2]).distinct()
    spelled = stored(word_texts(texts, bit_maps(needed.select(F.lit(1).alias("size"), "a", F.col("a").alias("b"))).words, seed), "word-texts")
    out = best
    for c in "abc":
        out = out.join(spelled.select("lang", F.col("word").alias(c), F.col("text").cast("string").alias(f"word_{c}")), ["lang", c], "left")
    out = out.withColumn("phrase", F.concat_ws(" ", "word_a", "word_b", "word_c"))
    n = found.where("size = 0").select("lang", "n")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), "phrase")
    ranked = out.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
