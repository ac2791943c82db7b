import math
import random
import time

import numpy as np
import pytest

from riskframe.operators import model, search
from riskframe.session import together
from riskframe.sources import runlog

SPACE = {"x": ("real", -4.0, 4.0), "rate": ("log", 1e-3, 10.0), "leaves": ("int", 2, 120)}


def surface(p):
    """One peak at x = 1.3, rate = 0.05, leaves = 40."""
    return -((p["x"] - 1.3) ** 2) - (math.log10(p["rate"] / 0.05)) ** 2 - ((p["leaves"] - 40) / 30) ** 2


def best_of(n, seed, pick):
    trials = []
    for number in range(n):
        p = pick(trials, seed, number)
        trials.append((p, surface(p)))
    return max(v for _, v in trials)


def test_search_beats_random_draws():
    ours = [best_of(60, s, lambda t, seed, n: search.suggest(SPACE, t, seed, n)) for s in range(15)]
    blind = [best_of(60, s, lambda t, seed, n: search.suggest(SPACE, [], seed, n)) for s in range(15)]
    assert np.mean(ours) > np.mean(blind) and sum(a > b for a, b in zip(ours, blind)) >= 11


def test_draws_stay_in_the_space_and_are_repeatable():
    trials = []
    for number in range(40):
        p = search.suggest(model.SEARCH_SPACE, trials, 7, number)
        assert p == search.suggest(model.SEARCH_SPACE, trials, 7, number)
        for name, (kind, low, high) in model.SEARCH_SPACE.items():
            assert low <= p[name] <= high and isinstance(p[name], int if kind == "int" else float)
        trials.append((p, random.Random(number).random()))
    assert set(model.SEARCH_SPACE) == set(trials[0][0]) and len(model.SEARCH_SPACE) == 9


def test_densities_add_up_to_one():
    for values in ([], [0.2], [0.1, 0.1, 0.9, 0.5]):
        bells = search.Parzen(values, 0.0, 1.0)
        at = (np.arange(4_000) + 0.5) / 4_000
        assert abs(np.mean([math.exp(bells.log_density(x)) for x in at]) - 1) < 1e-3


def test_search_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    log, run = str(tmp_path / "runs"), []

    def fitted(params, *_):
        run.append(params)
        return params

    class Scores:
        def __init__(self, params):
            self.params = params

        def agg(self, *_):
            return self

        def first(self):
            return [surface({**self.params})]

    monkeypatch.setattr(model, "folded_table", lambda *a: None)
    monkeypatch.setattr(model, "boosted_learner", fitted)
    monkeypatch.setattr(model, "grouped_cv_scores", lambda _, params: Scores(params))
    table = spark.range(1)
    whole = model.tune(table, None, "y", "g", n_trials=14, space=SPACE)
    run.clear()
    model.tune(table, None, "y", "g", n_trials=12, space=SPACE, log=log)
    runlog.log_run(spark, log, "tuning/trial", {"number": 13}, {})  # a trial that broke off
    again = model.tune(table, None, "y", "g", n_trials=14, space=SPACE, log=log)
    assert len(run) == 14 and again.trials == whole.trials and again.best_value == whole.best_value


def test_tasks_run_side_by_side(spark):
    def job(i):
        def slow(part):
            time.sleep(1.0)
            return [i]

        return spark.sparkContext.parallelize([0], 1).mapPartitions(slow).collect()[0]

    job(0)
    start = time.perf_counter()
    assert together(spark, [lambda i=i: job(i) for i in range(5)]) == [0, 1, 2, 3, 4]
    assert time.perf_counter() - start < 2.5
    with pytest.raises(ZeroDivisionError):
        together(spark, [lambda: 1, lambda: 1 / 0])
