"""Shared parts of the operators that find spans: flags of character classes, and digests of spans."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, functions as F


def flags(characters: str) -> bytes:
    """A table for ``bytes.translate``: ``1`` for the characters, ``0`` for all others."""
    wanted = set(characters.encode())
    return bytes(49 if i in wanted else 48 for i in range(256))


def runs(flagged: bytes, least: int) -> Iterator[tuple[int, int]]:
    """Start and end of every longest run of flagged characters that has ``least`` or more."""
    needle, at = b"1" * least, 0
    while (start := flagged.find(needle, at)) >= 0:
        at = flagged.find(b"0", start)
        if at < 0:
            at = len(flagged)
        yield start, at


def places(view: bytes, words: tuple[bytes, ...]) -> list[int]:
    """Where any of the words begins, in order."""
    found = set()
    for word in words:
        at = view.find(word)
        while at >= 0:
            found.add(at)
            at = view.find(word, at + 1)
    return sorted(found)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest_columns(kinds: tuple[str, ...]) -> list[Column]:
    """Counts of the base kinds, digest of the base spans, and all spans, from a column ``spans`` that is in order."""
    def of(kind: str) -> Column:
        return F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))

    base = F.filter("spans", lambda s: s["base"])
    return [*(F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in kinds),
            F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")]
