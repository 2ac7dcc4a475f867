"""The registered model jobs ask for the whole search, all folds and all rounds; the search, its sampler and its learner on small tables."""

import inspect

import numpy as np
import pytest

from urlrisk.catalog import load, model_queries as Q
from urlrisk.operators import boosting as B, model as M, search as P
from urlrisk.session import new_folder

QUERIES = load()


class Asked(Exception):
    """Ends a job at its first fit, with the arguments of the call."""


@pytest.fixture
def asked(monkeypatch):
    monkeypatch.setattr(Q, "_parts", lambda spark, folder: ("train", "val", "test", ["a"]))

    def of(name, operator, module=Q.M):
        signature = inspect.signature(getattr(module, operator))

        def call(*args, **kwargs):
            bound = signature.bind(*args, **kwargs)
            bound.apply_defaults()
            raise Asked(bound.arguments)

        monkeypatch.setattr(module, operator, call)
        with pytest.raises(Asked) as found:
            QUERIES[name].run(None, None)
        return found.value.args[0]
    return of


@pytest.mark.parametrize("name", ("ml_02_search", "ml_03_best_trial"))
def test_whole_search(asked, name):
    call = asked(name, "search", Q.P)
    assert (call["trials"], call["k"], call["space"], call["labelled"]) == (50, 5, Q.P.SPACE, 10_000)


@pytest.mark.parametrize("name", ("ml_01_train", "ml_04_predict", "eva_07_importances", "exp_01_contributions", "snk_07_model"))
def test_whole_training(asked, name):
    call = asked(name, "train")
    assert call["params"] == {"maxIter": 1000, "maxDepth": 10} and call["val_rows"] == "val"


def test_whole_ablation(asked):
    call = asked("eva_08_ablation", "ablation")
    assert call["k"] == 5 and call["params"] == {"maxIter": 1000, "maxDepth": 10}


PARAMS = {"maxDepth": 4, "stepSize": 0.2, "maxIter": 200, "subsamplingRate": 0.8, "featureShare": 1.0, "minChildWeight": 1, "gamma": 0.0, "alpha": 1e-8, "lambda": 1.0}


def made(n=1500, seed=1):
    """Rows whose class depends on two of four columns, with gaps."""
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, 4))
    y = ((x[:, 0] * x[:, 1] + 0.3 * draw.normal(size=n)) > 0).astype(int)
    x[draw.random(x.shape) < 0.05] = np.nan
    return x, y


def test_learner_learns_and_stops_early():
    x, y = made()
    codes, held = B.binned(x, B.edges(x)), np.arange(len(y)) % 5 == 0
    area, rounds = B.held_out_auc(codes, y, held, PARAMS, 1)
    assert area > 0.9 and 10 < rounds < 200
    assert B.held_out_auc(codes, y, held, PARAMS, 1) == (area, rounds)
    noise = np.random.default_rng(2).permutation(y)
    assert B.held_out_auc(codes, noise, held, PARAMS, 1)[1] < 60
    assert B.held_out_auc(codes, y, held, PARAMS | {"gamma": 1e9}, 1)[0] == 0.5  # no split is worth it


def test_first_tree_is_the_best_split():
    """One level against all splits tried one by one."""
    x, y = made(300)
    codes = B.binned(x, B.edges(x))
    g, h = 0.5 - y, np.full(len(y), 0.25)
    tree = B.Tree(codes, g, h, np.arange(4), PARAMS | {"maxDepth": 1})
    def value(f, b):
        sides = [codes[:, f] <= b, codes[:, f] > b]
        return sum(g[s].sum() ** 2 / (h[s].sum() + 1.0) for s in sides) if all(h[s].sum() >= 1 for s in sides) else -1
    best = max(((f, b) for f in range(4) for b in range(B.BINS + 1)), key=lambda s: value(*s))
    assert value(tree.feature[0], tree.bin[0]) == pytest.approx(value(*best), rel=1e-6)
    left = codes[:, tree.feature[0]] <= tree.bin[0]
    assert tree.predict(codes)[left][0] == pytest.approx(-g[left].sum() / (h[left].sum() + 1.0), rel=1e-6)


def test_area():
    draw = np.random.default_rng(3)
    y, s = draw.integers(0, 2, 200), draw.integers(0, 9, 200) / 9
    pairs = [(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]]
    assert B.auc(y, s) == pytest.approx(np.mean(pairs))
    assert B.auc(np.ones(3, int), s[:3]) == 0.5


def test_sampler_closes_in():
    """On a known function the sampler does better than chance and stays within the ranges."""
    def score(p):
        return -abs(np.log10(p["stepSize"]) + 1.2) - abs(p["maxDepth"] - 6) / 7
    rng, done = np.random.default_rng(4), []
    for _ in range(60):
        params = P.suggest(rng, done)
        for name, low, high, kind in P.SPACE:
            assert low <= params[name] <= high * (1 + 1e-9)
            assert isinstance(kind, str) or (params[name] - low) % kind == 0
        done.append((params, score(params)))
    early, late = ([s for _, s in part] for part in (done[:10], done[-20:]))
    assert np.mean(late) > np.mean(early) + 0.2


def test_search_runs_once_and_is_read_again(spark, monkeypatch):
    x, y = made(400)
    rows = spark.createDataFrame([(i, *(None if np.isnan(v) else float(v) for v in r), int(c)) for i, (r, c) in enumerate(zip(x, y))], "row_key int, a double, b double, c double, d double, label int")
    small = (("maxIter", 20, 60, 20), *(s for s in P.SPACE if s[0] != "maxIter"))
    ask = lambda n=None: P.search(rows, ["a", "b", "c", "d"], "row_key", trials=12, k=3, space=small, at_once=6, labelled=n or 1000).collect()
    first = sorted(ask())
    assert [r["trial"] for r in first] == list(range(12)) and all(len(r["rounds"]) == 3 and 0 <= r["meanAuc"] <= 1 for r in first)
    assert max(r["meanAuc"] for r in first) > 0.8
    monkeypatch.setattr(P, "run", lambda *a: pytest.fail("the search ran again"))
    assert sorted(ask()) == first
    monkeypatch.undo()
    assert len(P.sample(rows, ["a"], "row_key", labelled=50)) == 50
    best = P.best_trial(spark.createDataFrame(first, P.HISTORY)).first()
    assert best["meanAuc"] == max(r["meanAuc"] for r in first)
    assert set(M.spark_params(best["params"])) <= {p.name for p in M.GBTClassifier().params}


def test_folds_hold_equal_shares():
    y = np.array([0] * 11 + [1] * 7)
    got = P.folds(y, 4)
    assert all(abs(np.sum((got == f) & (y == c)) - np.sum(y == c) / 4) < 1 for f in range(4) for c in (0, 1))


def test_set_is_there_as_a_whole_or_not(spark):
    root = new_folder(spark, "set")
    rows = spark.createDataFrame([(float(i % 7), i % 7 > 3) for i in range(60)], "a double, yes boolean").selectExpr("a", "cast(yes AS int) AS label")
    model, other = (M.pipeline(["a"], maxIter=n, maxDepth=2).fit(M._columns(rows, ["a"])) for n in (1, 3))
    with pytest.raises(ValueError):
        M.load_set(spark, root)
    meta = spark.createDataFrame([("a", 1.0)], "feature string, importance double")
    assert M.save_set(model, root, metadata=meta, trials=meta) == 1
    with pytest.raises(Exception):  # the second set fails on its last table
        M.save_set(other, root, metadata=meta, trials=meta.selectExpr("raise_error('lost') AS x"))
    loaded, tables = M.load_set(spark, root, ["metadata", "trials"])
    scores = lambda m: [r["score"] for r in M.add_probability(rows, m).orderBy("a", "label").collect()]
    assert scores(loaded) == scores(model) and tables["trials"].count() == 1
    assert M.save_set(other, root, metadata=meta, trials=meta) == 2
    assert scores(M.load_set(spark, root)[0]) == scores(other)
    assert scores(M.load_set(spark, root, number=1)[0]) == scores(model)
