"""Search for training parameters: a tree-structured Parzen sampler, all fits of a round at once.

The sampler looks at the trials so far.  After ``STARTUP`` random ones it models, for
each parameter, where the best tenth of the trials lie and where the others do, and
takes of some draws the one that the first model favours most over the second.  Trials
come in rounds; the fits of a round, one per trial and fold, are tasks of one job.

Labelled rows are bounded by ``LABELLED``: the rows with the smallest hash of their key.
The bound holds for the search alone; training uses all rows.
"""

from __future__ import annotations

import hashlib
import json
import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_folder
from . import boosting, versions
from .boosting import held_out_auc

# The learner travels to the executors inside the job, so that these need no copy of the repository.
for _module in (boosting, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)

#: Parameter, low, high, and kind: whole steps, log or real.
SPACE = (
    ("maxDepth", 3, 10, 1), ("stepSize", 0.01, 0.3, "log"), ("maxIter", 100, 1000, 50), ("subsamplingRate", 0.5, 1.0, "real"),
    ("featureShare", 0.5, 1.0, "real"), ("minChildWeight", 1, 10, 1), ("gamma", 0.0, 5.0, "real"), ("alpha", 1e-8, 10.0, "log"), ("lambda", 1e-8, 10.0, "log"),
)
TRIALS, FOLDS, LABELLED, STARTUP, ROUND, DRAWS = 50, 5, 10_000, 10, 10, 24
HISTORY = "trial int, meanAuc double, stdAuc double, rounds array<int>, params map<string,double>"


def _value(x: float, low: float, high: float, kind) -> float:
    """A place between 0 and 1 as a value of the parameter."""
    if kind == "log":
        return math.exp(math.log(low) + x * (math.log(high) - math.log(low)))
    if kind == "real":
        return low + x * (high - low)
    return low + kind * min(int(x * ((high - low) // kind + 1)), (high - low) // kind)


def _place(value: float, low: float, high: float, kind) -> float:
    if kind == "log":
        return (math.log(value) - math.log(low)) / (math.log(high) - math.log(low))
    if kind == "real":
        return (value - low) / (high - low)
    return ((value - low) / kind + 0.5) / ((high - low) // kind + 1)


class Parzen:
    """Density on 0..1: a wide prior and a bump at every place, as wide as the gap to its neighbours."""

    def __init__(self, places: Sequence[float]):
        self.mean = np.sort(np.r_[0.5, places])
        gaps = np.diff(np.r_[0.0, self.mean, 1.0])
        self.width = np.clip(np.maximum(gaps[:-1], gaps[1:]), 1 / min(100, len(self.mean) + 1), 1.0)
        self.width[np.searchsorted(self.mean, 0.5)] = 1.0

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        out = np.empty(0)
        while len(out) < n:
            i = rng.integers(len(self.mean), size=n)
            x = rng.normal(self.mean[i], self.width[i])
            out = np.r_[out, x[(x >= 0) & (x <= 1)]]
        return out[:n]

    def log_density(self, x: np.ndarray) -> np.ndarray:
        scale = math.sqrt(2)
        inside = np.array([(math.erf((1 - m) / (w * scale)) - math.erf((0 - m) / (w * scale))) / 2 for m, w in zip(self.mean, self.width)])
        z = (x[:, None] - self.mean) / self.width
        return np.log(np.mean(np.exp(-z * z / 2) / (self.width * math.sqrt(2 * math.pi) * inside), axis=1) + 1e-300)


def suggest(rng: np.random.Generator, trials: list[tuple[dict, float]], space=SPACE, startup: int = STARTUP, draws: int = DRAWS) -> dict:
    """The parameters of the next trial, from the parameters and scores of those before."""
    if len(trials) < startup:
        return {name: _value(rng.random(), low, high, kind) for name, low, high, kind in space}
    ordered = sorted(trials, key=lambda t: -t[1])
    top = min(math.ceil(len(ordered) / 10), 25)
    out = {}
    for name, low, high, kind in space:
        places = [_place(params[name], low, high, kind) for params, _ in ordered]
        good, rest = Parzen(places[:top]), Parzen(places[top:])
        x = good.draw(rng, draws)
        out[name] = _value(float(x[np.argmax(good.log_density(x) - rest.log_density(x))]), low, high, kind)
    return out


def sample(rows: DataFrame, names: Sequence[str], key: str, labelled: int = LABELLED, seed: int = 42) -> pd.DataFrame:
    """At most ``labelled`` rows, those with the smallest hash of their key; every task keeps no more than these."""
    at = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-search-{seed}")))
    kept = rows.where(F.col("label").isNotNull()).select(at.alias("_at"), F.col("label").cast("int").alias("label"), *(F.col(n).cast("double").alias(n) for n in names))
    return kept.orderBy("_at", "label", *names).limit(labelled).toPandas()


def folds(label: np.ndarray, k: int) -> np.ndarray:
    """Fold of every row: equal shares of each class, in the order of the rows."""
    out = np.zeros(len(label), np.int64)
    for value in np.unique(label):
        rows = np.flatnonzero(label == value)
        out[rows] = np.arange(len(rows)) * k // len(rows)
    return out


def search(rows: DataFrame, names: Sequence[str], key: str, trials: int = TRIALS, k: int = FOLDS, seed: int = 42, space=SPACE,
           labelled: int = LABELLED, at_once: int = ROUND) -> DataFrame:
    """The table of trials: mean and deviation of the area under the ROC curve over stratified folds, rounds and parameters.

    It is stored below the shared folder under a digest of the sample and the settings,
    so that a second call over the same rows reads it.
    """
    spark, given = rows.sparkSession, sample(rows, names, key, labelled, seed)
    settings = json.dumps([list(names), trials, k, seed, space, at_once])
    root = f"{shared_folder(spark)}/search-{hashlib.sha256(settings.encode() + pd.util.hash_pandas_object(given).to_numpy().tobytes()).hexdigest()}"
    versions.create(spark, root)
    if not versions.committed(spark, root, "trials"):
        found = run(spark, given[list(names)].to_numpy(float), given["label"].to_numpy(), trials, k, seed, space, at_once)
        versions.add(spark.createDataFrame(found, HISTORY).withColumn("day", F.lit(versions.NO_DAY)), root, "trials")
    return versions.read(spark, root, HISTORY).drop("day")


def run(spark: SparkSession, x: np.ndarray, y: np.ndarray, trials: int, k: int, seed: int, space=SPACE, at_once: int = ROUND) -> list[tuple]:
    """All trials, a round of them at a time: one task for each trial and fold."""
    codes, fold = boosting.binned(x, boosting.edges(x)).astype(np.uint8), folds(y, k)
    rng = np.random.default_rng(seed)
    done: list[tuple[dict, float]] = []
    out = []

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for trial, part, params in zip(batch["trial"], batch["fold"], batch["params"]):
                area, rounds = held_out_auc(codes.astype(np.int64), y, fold == part, json.loads(params), seed + int(part))
                rows.append((trial, part, area, rounds))
            yield pd.DataFrame(rows, columns=["trial", "fold", "auc", "rounds"])

    while len(done) < trials:
        asked = [suggest(rng, done, space) for _ in range(min(at_once, trials - len(done)))]
        tasks = [(len(done) + i, part, json.dumps(params)) for i, params in enumerate(asked) for part in range(k)]
        jobs = spark.createDataFrame(tasks, "trial int, fold int, params string").repartition(len(tasks))
        fits = sorted(tuple(r) for r in jobs.mapInPandas(fit, "trial int, fold int, auc double, rounds int").collect())
        for i, params in enumerate(asked):
            own = [f for f in fits if f[0] == len(done)]
            areas = [f[2] for f in own]
            out.append((len(done), float(np.mean(areas)), float(np.std(areas)), [int(f[3]) for f in own], {n: float(v) for n, v in params.items()}))
            done.append((params, float(np.mean(areas))))
    return out


def best_trial(history: DataFrame) -> DataFrame:
    return history.agg(F.max_by(F.struct(*history.columns), F.struct("meanAuc", -F.col("trial"))).alias("b")).select("b.*")
