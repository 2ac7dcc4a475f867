"""Nearest neighbours by inner product with randomly rotated one-bit codes.

* **Code.**  A vector is divided by its norm and rotated by a random orthogonal
  matrix; the signs of its coordinates are its code, packed into 64-bit words.  Two
  numbers correct the estimate: the norm, and the inner product of the rotated
  vector with its own code.
* **Estimate.**  A query is rotated likewise and rounded to 6 bits per coordinate.
  Its inner product with a code is a sum of bit counts, one AND per bit plane.
  Divided by the correction it is an unbiased estimate of the inner product; its
  error is below ``BOUND`` standard deviations all but surely.
* **Reranking.**  Estimate plus error bound is compared with the worst of the
  best neighbours found so far.  Only vectors that may be better are read in full;
  their score is the exact inner product of the original vectors.

Every row of the index is visited for every query.  Queries come in blocks of a
bounded size; each block makes one pass over the index, each task keeps its best
neighbours of each query, and these lists are merged.

Defined cases: vectors that are null, zero, hold null or non-finite components, or
have another length than most, take no part, nor do rows without a vec_id.  Rows
that repeat a vec_id count once, with the smallest of their vectors.  Equal scores
go by the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

BOUND = 3.0  # standard deviations
PLANES = 6  # bits per coordinate of a query
QUERIES = 4096  # in a block
ROWS = 1024  # of the index at a time
PAIRS = 1 << 16  # reranked at a time
SEED = 17


def rotation(size: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix; its lines are the rotated axes."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _padded(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % 64)))


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs (rows x words), norms and corrections of vectors."""
    norm = np.linalg.norm(x, axis=1)
    rotated = _padded(x / norm[:, None]) @ turn.T
    bits = np.packbits(rotated > 0, axis=1, bitorder="little").view(np.uint64)
    return bits, norm, np.abs(rotated).sum(axis=1) / np.sqrt(rotated.shape[1])


class Block:
    """A block of queries, ready to be compared with codes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, turn: np.ndarray, bound: float = BOUND):
        self.ids, self.x, self.bound = ids, x, bound
        self.norm = np.linalg.norm(x, axis=1)
        q = _padded(x / self.norm[:, None]) @ turn.T
        self.size = q.shape[1]
        low, high = q.min(axis=1), q.max(axis=1)
        self.step = np.maximum(high - low, 1e-12) / (2 ** PLANES - 1)
        level = np.rint((q - low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.low, self.total = low, low * self.size + self.step * level.sum(axis=1)
        self.planes = [np.packbits(level >> b & 1, axis=1, bitorder="little").view(np.uint64) for b in range(PLANES)]

    def upper(self, code: np.ndarray, norm: np.ndarray, correction: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products, rows x queries."""
        weighted = np.zeros((len(code), len(self.ids)), np.float32)
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.float32)
        for b, plane in enumerate(self.planes):
            for w in range(code.shape[1]):
                weighted += np.bitwise_count(code[:, w, None] & plane[None, :, w]) * np.float32(2 ** b)
        inner = 2 * (weighted * self.step.astype(np.float32) + ones[:, None] * self.low.astype(np.float32)) - self.total.astype(np.float32)
        inner /= (np.sqrt(self.size) * correction).astype(np.float32)[:, None]
        spread = np.sqrt(np.maximum(1 - correction ** 2, 0) / (self.size - 1)) / correction
        error = spread[:, None] + (self.step / np.sqrt(12))[None, :] / correction[:, None]
        inner += np.float32(self.bound) * error.astype(np.float32)
        return inner * norm.astype(np.float32)[:, None] * self.norm.astype(np.float32)


class Best:
    """The best neighbours of each query of a block."""

    def __init__(self, block: Block, k: int):
        self.block, self.k = block, k
        self.query, self.vec, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.worst = np.full(len(block.ids), -np.inf)

    def add(self, ids: np.ndarray, x: np.ndarray, upper: np.ndarray) -> None:
        row, query = np.nonzero(upper >= (self.worst - 1e-5 * np.abs(self.worst))[None, :])
        other = ids[row] != self.block.ids[query]
        row, query = row[other], query[other]
        for at in range(0, len(row), PAIRS):
            r, q = row[at:at + PAIRS], query[at:at + PAIRS]
            score = np.einsum("ij,ij->i", x[r], self.block.x[q])
            good = score >= self.worst[q]
            self._merge(q[good], ids[r[good]], score[good])

    def _merge(self, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        query, vec, score = np.r_[self.query, query], np.r_[self.vec, vec], np.r_[self.score, score]
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        self.query, self.vec, self.score = query[keep], vec[keep], score[keep]
        full = rank[keep] == self.k - 1
        self.worst[self.query[full]] = self.score[full]


def usable(vector: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def index(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """Codes of all usable rows: ``vec_id``, ``v``, ``code``, ``norm``, ``correction``; and the length of the vectors."""
    rows = (vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
            .where(F.col("vec_id").isNotNull() & usable("v")).groupBy("vec_id").agg(F.min("v").alias("v")))
    rows = stored(rows, "vectors")
    most = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = most["size"] if most else 1
    turn = rotation(size + -size % 64)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if batch.num_rows:
                x = np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, size)
                code, norm, correction = encode(x, turn)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(list(code.view(np.int64)), pa.list_(pa.int64())),
                                                  pa.array(norm), pa.array(correction)], names=["vec_id", "v", "code", "norm", "correction"])

    coded = rows.where(F.size("v") == size).mapInArrow(run, "vec_id long, v array<double>, code array<long>, norm double, correction double")
    return stored(coded, "codes"), size


def search(coded: DataFrame, size: int, queries: Column, k: int = 20, bound: float = BOUND, block: int = QUERIES) -> DataFrame:
    """The ``k`` nearest of every row for which ``queries`` holds: ``query_id``, ``rank``, ``vec_id``, ``score``."""
    turn = rotation(size + -size % 64)
    asked = stored(coded.where(queries).select("vec_id", "v"), "queries")
    blocks = -(-asked.count() // block)
    number = F.pmod(F.xxhash64("vec_id"), F.lit(max(blocks, 1)))
    lists = []
    for i in range(blocks):
        rows = asked.where(number == i).orderBy("vec_id").collect()
        if not rows:
            continue
        made = Block(np.array([r["vec_id"] for r in rows]), np.array([r["v"] for r in rows]), turn, bound)

        def run(source: Iterator[pa.RecordBatch], made: Block = made) -> Iterator[pa.RecordBatch]:
            best, step = Best(made, k), 32
            for batch in source:
                ids, code = np.asarray(batch.column("vec_id")), np.asarray(batch.column("code").flatten()).view(np.uint64).reshape(batch.num_rows, -1)
                x = np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, size)
                norm, correction = np.asarray(batch.column("norm")), np.asarray(batch.column("correction"))
                at = 0
                while at < len(ids):  # small steps at first, until the lists are full
                    part = slice(at, at + step)
                    best.add(ids[part], x[part], made.upper(code[part], norm[part], correction[part]))
                    at, step = at + step, min(2 * step, ROWS)
            yield pa.RecordBatch.from_pydict({"query_id": made.ids[best.query], "vec_id": best.vec, "score": best.score})

        lists.append(coded.mapInArrow(run, "query_id long, vec_id long, score double"))
    found = coded.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    for part in lists:
        found = found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
