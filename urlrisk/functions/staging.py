"""Keep expensive columns from being computed more than once per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def computed_once(df: DataFrame, *names: str) -> DataFrame:
    """Fence for the named columns: same rows, same columns.

    The optimizer pushes a filter on a derived column down to the scan and copies
    the whole derivation into it.  For columns made of many regular expressions
    that doubles the work, and for chains of such columns it grows with every
    link.  A filter cannot be pushed through the output of a generator, so the
    columns pass through a one-element ``inline``; filters on all other columns
    still reach the scan.
    """
    wanted = set(names)
    rest = [c for c in df.columns if c not in wanted]
    return df.select(*rest, F.inline(F.array(F.struct(*names))))


def explode_rows(df: DataFrame, array: str, alias: str, *keys: str) -> DataFrame:
    """One row per array element, without the size filter that ``explode`` adds.

    That filter repeats the expression which makes the array; testing the element
    after the explode costs nothing.
    """
    return df.select(*keys, F.explode_outer(array).alias(alias)).where(F.col(alias).isNotNull())
