"""Text analysers that can take the place of the built-in one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from .. import rules
from ..operators.urls import step_level

#: Columns that an analyser adds, and their types.
OUTPUT = {
    "indicatorCount": "bigint", "highSeverityCount": "bigint", "tactics": "array<string>", "textConfidence": "double",
    "textIsPhishing": "boolean", "textLevel": "string", "textReasons": "array<string>", "hasBrokenLink": "boolean",
}
_WHOLE = frozenset(("tinyint", "smallint", "int", "bigint"))

Analyser = Callable[[DataFrame, str, str], DataFrame]


def checked(analyser: Analyser) -> Analyser:
    """The analyser, with an error that names what it leaves out or gives with another type.

    It must keep the columns it gets and add all of ``OUTPUT``; the schema is known
    before any row is read.
    """
    def run(df: DataFrame, text: str, kind: str) -> DataFrame:
        out = analyser(df, text, kind)
        types = dict(out.dtypes)
        faults = [f"{c} is missing" for c in df.columns if c not in types]
        for name, wanted in OUTPUT.items():
            got = types.get(name)
            if got is None:
                faults.append(f"{name} is missing")
            elif got != wanted and not (wanted == "bigint" and got in _WHOLE):
                faults.append(f"{name} is {got}, not {wanted}")
        if faults:
            raise ValueError(f"analyser {getattr(analyser, '__name__', analyser)}: " + ", ".join(faults))
        return out
    return run


def word_analyser(words: dict[str, float], tactic: str = "urgency_pressure", per_word: float = 0.25) -> Analyser:
    """A plain analyser: each listed word that a message holds is an indicator of the given severity."""
    def run(df: DataFrame, text: str, kind: str) -> DataFrame:
        low, message = F.lower(F.coalesce(F.col(text), F.lit(""))), F.col(kind).isin("email", "text")
        found = {w: (message & low.contains(w.lower())).cast("bigint") for w in words}
        out = df.withColumns({f"_w{i}": c for i, c in enumerate(found.values())})
        seen = [F.col(f"_w{i}") for i in range(len(words))]
        out = out.withColumns({
            "indicatorCount": sum(seen[1:], seen[0]),
            "highSeverityCount": sum((c for c, s in zip(seen, words.values()) if s > 0.7), F.lit(0).cast("bigint")),
        })
        some = F.col("indicatorCount") > 0
        none = F.array().cast("array<string>")
        out = out.withColumns({
            "tactics": F.when(some, F.array(F.lit(tactic))).otherwise(none),
            "textConfidence": F.least(F.col("indicatorCount") * F.lit(per_word), F.lit(1.0)),
            "textReasons": F.when(some, F.array(F.concat(F.lit("Holds "), F.col("indicatorCount").cast("string"), F.lit(" listed words")))).otherwise(none),
            "hasBrokenLink": F.lit(False),
        })
        return out.withColumns({
            "textIsPhishing": F.col("textConfidence") >= rules.PHISHING_THRESHOLD,
            "textLevel": step_level(F.col("textConfidence"), rules.LEVELS, rules.LEVEL_BOUNDS),
        }).drop(*[f"_w{i}" for i in range(len(words))])
    return run
