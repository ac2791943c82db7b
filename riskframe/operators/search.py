"""Tree-structured Parzen search over a space of named parameters.

Past trials are split into the best tenth and the others. Each dimension gets two
mixtures of bells, one around the values of either part; candidates are drawn
from the first, and the one whose ratio of the two densities is largest is tried
next. A dimension is whole numbers, real numbers, or real numbers on a log scale.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import SparkSession, functions as F

from riskframe.sources import runlog

#: Trials drawn at random before densities are estimated; candidates per dimension.
STARTUP, CANDIDATES = 10, 24

Trial = tuple[dict, float]


def _scaled(kind: str, low: float, high: float) -> tuple[float, float]:
    if kind == "log":
        return math.log(low), math.log(high)
    # Whole numbers own the half unit on either side.
    return (low - 0.5, high + 0.5) if kind == "int" else (float(low), float(high))


def _value(kind: str, low: float, high: float, x: float):
    if kind == "int":
        return int(min(max(round(x), low), high))
    return float(min(max(math.exp(x) if kind == "log" else x, low), high))


class Parzen:
    """Bells around observed values, one of them wide around the middle, cut off at the bounds."""

    def __init__(self, values: Sequence[float], low: float, high: float):
        self.low, self.high = low, high
        order = np.argsort([*values, (low + high) / 2], kind="stable")
        self.centres = np.array([*values, (low + high) / 2])[order]
        # A bell reaches to its farther neighbour; the bounds are neighbours too.
        edges = np.concatenate([[low], self.centres, [high]])
        reach = np.maximum(edges[1:-1] - edges[:-2], edges[2:] - edges[1:-1])
        least = (high - low) / min(100.0, len(self.centres) + 1.0)
        self.widths = np.clip(reach, least, high - low)
        self.widths[order == len(values)] = high - low
        self.inside = np.array([_normal((high - m) / s) - _normal((low - m) / s) for m, s in zip(self.centres, self.widths)])

    def draw(self, rng: random.Random) -> float:
        i = rng.randrange(len(self.centres))
        while True:
            x = rng.gauss(self.centres[i], self.widths[i])
            if self.low <= x <= self.high:
                return x

    def log_density(self, x: float) -> float:
        z = (x - self.centres) / self.widths
        bells = np.exp(-0.5 * z * z) / (self.widths * self.inside * math.sqrt(2 * math.pi))
        return math.log(max(float(bells.mean()), 1e-300))


def _normal(z: float) -> float:
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def suggest(space: Mapping[str, tuple], trials: Sequence[Trial], seed: int, number: int) -> dict:
    """The parameters of trial ``number``, decided by the trials before it."""
    rng = random.Random(f"{seed}-{number}")
    if len(trials) < STARTUP:
        return {name: _value(*d, rng.uniform(*_scaled(*d))) for name, d in space.items()}
    ranked = sorted(trials, key=lambda t: -t[1])
    cut = min(math.ceil(0.1 * len(ranked)), 25)
    out = {}
    for name, dimension in space.items():
        bounds = _scaled(*dimension)

        def places(part, name=name, dimension=dimension):
            return [math.log(p[name]) if dimension[0] == "log" else float(p[name]) for p, _ in part]

        good, rest = Parzen(places(ranked[:cut]), *bounds), Parzen(places(ranked[cut:]), *bounds)
        drawn = [good.draw(rng) for _ in range(CANDIDATES)]
        best = max(drawn, key=lambda x: good.log_density(x) - rest.log_density(x))
        out[name] = _value(*dimension, best)
    return out


def log_trial(spark: SparkSession, log: str, study: str, number: int, params: Mapping, value: float) -> None:
    exact = {name: repr(v) for name, v in params.items()}
    runlog.log_run(spark, log, f"{study}/trial", {"number": number, **exact}, {"value": repr(float(value))})


def known_trials(spark: SparkSession, log: str, study: str, space: Mapping[str, tuple]) -> list[Trial]:
    """Finished trials of a study in their order, one per number; a gap ends them."""
    if not runlog.exists(spark, log):
        return []
    rows = runlog.read_runs(spark, log).where(F.col("run_name") == f"{study}/trial")
    runs = rows.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("entries"), F.min("ts").alias("ts"))
    found: dict[int, Trial] = {}
    for row in runs.orderBy("ts").collect():  # one row per trial
        entries = row["entries"]
        if "value" not in entries or not set(space) <= set(entries):
            continue  # a trial whose log broke off
        params = {n: int(entries[n]) if d[0] == "int" else float(entries[n]) for n, d in space.items()}
        found.setdefault(int(entries["number"]), (params, float(entries["value"])))
    out = []
    while len(out) in found:
        out.append(found[len(out)])
    return out
