"""String helpers as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# Every character a whitespace strip removes (Unicode whitespace).
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
              "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(col: Column) -> Column:
    """Trim all Unicode whitespace from both ends."""
    return F.btrim(col, F.lit(WHITESPACE))


def strip_long(col: Column) -> Column:
    """The same for long texts.

    Trimming the end by a set of characters lists all characters of a text first.  An
    end that is a visible ASCII character has nothing to trim, and its byte is at hand.
    """
    last = F.substring(col.cast("binary"), -1, 1)
    visible = last.between(F.lit(bytearray(b"!")), F.lit(bytearray(b"~")))
    return F.when(visible, F.ltrim(col, F.lit(WHITESPACE))).otherwise(strip(col))


def strip_chars(col: Column, chars: str) -> Column:
    return F.btrim(col, F.lit(chars))


def quote_all(words: Iterable[str]) -> str:
    """Regex alternation that matches any of the literal words."""
    return "|".join(re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", w) for w in words)


def contains_any(col: Column, words: Iterable[str]) -> Column:
    """True where the text holds one of the literal words (one regex pass)."""
    return col.rlike(quote_all(words))


def contains_any_plain(col: Column, words: Iterable[str]) -> Column:
    """The same for case-exact words by byte search, several times faster on long text.

    A word that holds another one of the list adds nothing and is left out.
    """
    words = list(words)
    short = [w for w in words if not any(o != w and o in w for o in words)]
    out = col.contains(short[0])
    for word in short[1:]:
        out = out | col.contains(word)
    return out


def without(col: Column, chars: str) -> Column:
    """The text without the given characters, which few texts hold."""
    out = col
    for char in chars:
        out = F.replace(out, F.lit(char), F.lit(""))
    return F.when(contains_any_plain(col, chars), out).otherwise(col)


def percent_decode(col: Column, plus_is_space: bool = False) -> Column:
    """Percent-decode; malformed escapes stay as they are."""
    fixed = F.regexp_replace(col, r"%(?![0-9a-fA-F]{2})", "%25")
    if not plus_is_space:
        fixed = F.regexp_replace(fixed, r"\+", "%2B")
        touched = col.contains("%")
    else:
        touched = col.rlike(r"[%+]")
    return F.when(touched, F.try_url_decode(fixed)).otherwise(col)


def round_half_up(col: Column, places: int) -> Column:
    """Round with plain double arithmetic, so that every engine agrees."""
    scale = float(10 ** places)
    return F.floor(col * scale + F.lit(0.5)) / F.lit(scale)


def present(items: Iterable[Column]) -> Column:
    """Array of the items that are not null, in order."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def first_items(items: Column, most: int | None) -> Column:
    """The first ``most`` items of an array; all for ``None``."""
    return items if most is None else F.slice(items, 1, most)
