"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import new_folder


def stored(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back.

    Cuts the lineage with files that every executor can read, so that a lost
    executor costs its running tasks only.
    """
    path = new_folder(df.sparkSession, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batches(columns: list[str], schema: pa.Schema,
            per_batch: Callable[..., dict[str, object]], rows: int = 2000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that hands lists of at most ``rows`` values per column to ``per_batch``."""
    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                out = per_batch(*(part.column(c).to_pylist() for c in columns))
                yield pa.RecordBatch.from_pydict(out, schema=schema)
    return run


def code_points(text: str) -> np.ndarray:
    """The code points of a text; lone surrogates stay as they are."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Letters:
    """Which code points a predicate of one character holds for; the first 65,536 in a table."""

    def __init__(self, holds: Callable[[str], bool]):
        self.holds = holds
        self.plane = np.fromiter((holds(chr(i)) for i in range(0x10000)), bool, 0x10000)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        if not len(codes) or codes.max() <= 0xFFFF:
            return self.plane[codes]
        found = self.plane[np.minimum(codes, 0xFFFF)]
        for code in np.unique(codes[codes > 0xFFFF]):
            found[codes == code] = self.holds(chr(code))
        return found


def ascii_view(text: str) -> bytes:
    """One byte per code point: ASCII as it is, ``?`` for all else, so that offsets are code points."""
    return text.encode("ascii", "replace")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64: spreads 64-bit values over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
