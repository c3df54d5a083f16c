"""Confidence models: logistic regression fitted per group, its policy and its gate."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import sigmoid
from .metrics import mean_of, meet
from .settle import settle


@dataclass
class Calibrator:
    """A fitted model: standardise, weigh, add the intercept, squash."""

    features: list[str]
    l2: float = 1.0
    mean: list[float] = field(default_factory=list)
    std: list[float] = field(default_factory=list)
    coef: list[float] = field(default_factory=list)
    intercept: float = 0.0

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, features: list[str], l2: float = 1.0, rounds: int = 100, tolerance: float = 1e-8) -> Calibrator:
        """Newton steps on the penalised log-likelihood; the intercept is barely penalised."""
        x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
        if len(np.unique(y)) < 2:
            raise ValueError("labels must hold both classes")
        mean, std = x.mean(axis=0), x.std(axis=0)
        std = np.where(std < 1e-12, 1.0, std)
        z = np.column_stack(((x - mean) / std, np.ones(len(x))))
        penalty = np.diag([l2] * x.shape[1] + [1e-9])
        w = np.zeros(z.shape[1])
        for _ in range(rounds):
            p = 0.5 * (1 + np.tanh(0.5 * (z @ w)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ w)
            w = w - step
            if np.abs(step).max() < tolerance:
                break
        return Calibrator(list(features), l2, mean.tolist(), std.tolist(), w[:-1].tolist(), float(w[-1]))

    def probability(self) -> Column:
        """The model as a column over its features."""
        if not self.coef:
            raise RuntimeError("the model isn't fitted")
        out = F.lit(self.intercept)
        for name, m, s, c in zip(self.features, self.mean, self.std, self.coef, strict=True):
            out = out + c * ((F.col(name) - m) / s)
        return sigmoid(out)

    def signals(self, n: int = 3) -> Column:
        """The n features that move the logit most, as an array of structs (name, value, effect); ties in feature order."""
        each = [F.struct(F.lit(name).alias("name"), F.col(name).cast("double").alias("value"), (c * ((F.col(name) - m) / s)).alias("effect"), F.lit(i).alias("i")) for i, (name, m, s, c) in enumerate(zip(self.features, self.mean, self.std, self.coef, strict=True))]
        order = lambda a, b: F.when(F.abs(a["effect"]) > F.abs(b["effect"]), -1).when(F.abs(a["effect"]) < F.abs(b["effect"]), 1).otherwise(a["i"] - b["i"])
        return F.slice(F.array_sort(F.array(*each), order), 1, n)


def scales(rows: DataFrame, by: list[str], features: list[str]) -> DataFrame:
    """by, feature, mean, std: population deviations; a constant feature has deviation 1."""
    each = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("x"))
    return each.groupBy(*by, "x.feature").agg(F.avg("x.v").alias("mean"), F.when(F.stddev_pop("x.v") < 1e-12, 1.0).otherwise(F.stddev_pop("x.v")).alias("std"))


PLATT_L2 = 1e-6


def _sums(d: int):
    """Sums of a group that a Newton step takes: curvature by pairs of columns, then slopes; the last column is the constant."""
    z = [F.get("z", F.lit(i)) for i in range(d)] + [F.lit(1.0)]
    logit = F.get("w", F.lit(d))
    for i in range(d):
        logit = logit + F.get("w", F.lit(i)) * z[i]
    p = F.col("p")
    n = F.col("n")
    bends = [F.sum(n * p * (1 - p) * z[i] * z[j]) for i in range(d + 1) for j in range(i, d + 1)]
    return sigmoid(logit), F.array(*bends), F.array(*[F.sum(n * (p - F.col("y")) * z[i]) for i in range(d + 1)])


def _solver(models: dict[str, tuple[list[str], float]], names: list[str]):
    """A function from sums and weights to the next weights and the largest change; weights of features that a model lacks stay 0."""
    d = len(names)
    upper = np.triu_indices(d + 1)
    used = {m: np.array([n in own for n in names] + [True]) for m, (own, _) in models.items()}

    @F.pandas_udf("struct<w:array<double>,step:double>")
    def solve(model: pd.Series, bends: pd.Series, slopes: pd.Series, weights: pd.Series) -> pd.DataFrame:
        out = []
        for m, b, g, w in zip(model, bends, slopes, weights, strict=True):
            h = np.zeros((d + 1, d + 1))
            h[upper] = b
            h = h + np.triu(h, 1).T
            w, keep = np.array(w), used[m]
            pull = np.array([models[m][1]] * d + [1e-9])
            step = np.zeros(d + 1)
            step[keep] = np.linalg.solve((h + np.diag(pull))[np.ix_(keep, keep)], (np.array(g) + pull * w)[keep])
            out.append((w - step, float(np.abs(step).max())))
        return pd.DataFrame(out, columns=["w", "step"])

    return solve


def fit_models(rows: DataFrame, by: list[str], models: dict[str, tuple[list[str], float]], y: str = "y", rounds: int = 100, tolerance: float = 1e-8, weight: str | None = None) -> DataFrame:
    """Logistic models, all of them for all groups at once: model, by, mean, std, coef, intercept.

    models: name -> its features and their penalty. Every round is one
    aggregation, the sums of a Newton step by group and model, and one small
    solve per row of its result; groups whose step falls below the tolerance
    leave, and so does everything after rounds. coef follows the features of all
    models in order of first mention, 0 where a model lacks one. Groups of one
    class give no rows. weight: a column that says how many rows a row stands for.
    """
    names = list(dict.fromkeys(f for own, _ in models.values() for f in own))
    d = len(names)
    data = rows.select(*by, *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(names)], F.col(y).cast("double").alias("y"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("n"))
    known = F.sum(F.when(F.col("y").isNotNull(), F.col("n")))
    array = lambda f: F.array(*[f(i, F.col(f"x{i}")) for i in range(d)])
    sizes = [known.alias("n"), F.sum(F.col("y") * F.col("n")).alias("pos")]
    if weight is None:
        stats = data.groupBy(*by).agg(*sizes, array(lambda i, x: F.avg(x)).alias("mean"), array(lambda i, x: F.stddev_pop(x)).alias("dev"))
    else:
        means = settle(data.groupBy(*by).agg(*sizes, array(lambda i, x: mean_of(x, "n")).alias("mean")).withColumnsRenamed({"n": "__n"}))
        off = meet(data, means, by)
        stats = off.groupBy(*by).agg(F.first("__n").alias("n"), F.first("pos").alias("pos"), F.first("mean").alias("mean"), array(lambda i, x: F.sqrt(mean_of((x - F.get("mean", F.lit(i))) * (x - F.get("mean", F.lit(i))), "n"))).alias("dev"))
    stats = stats.where("pos > 0 AND pos < n")
    stats = settle(stats.select(*by, "mean", F.transform("dev", lambda s: F.when(s < 1e-12, 1.0).otherwise(s)).alias("std")))
    met = meet(data, stats, by)
    z = F.array(*[(F.col(f"x{i}") - F.get("mean", F.lit(i))) / F.get("std", F.lit(i)) for i in range(d)])
    table = settle(met.select(*by, "y", "n", z.alias("z")))
    state = stats.select(*by, F.explode(F.array(*map(F.lit, models))).alias("model"), F.array_repeat(F.lit(0.0), d + 1).alias("w"))
    p, bends, slopes = _sums(d)
    solve, done = _solver(models, names), None
    for _ in range(rounds):
        joined = meet(table, state, by).withColumn("p", p)
        sums = joined.groupBy(*by, "model").agg(bends.alias("bends"), slopes.alias("slopes"), F.first("w").alias("w"))
        moved = settle(sums.select(*by, "model", solve("model", "bends", "slopes", "w").alias("s")).select(*by, "model", "s.w", "s.step"))
        still = moved.where(F.col("step") >= tolerance)
        ready = moved.where(F.col("step") < tolerance).drop("step")
        state = still.drop("step")
        done = ready if done is None else done.unionByName(ready)
        if still.isEmpty():
            break
    else:
        done = state if done is None else done.unionByName(state)
    fitted = meet(done, stats, by)
    return settle(fitted.select("model", *by, "mean", "std", F.slice("w", 1, d).alias("coef"), F.get("w", F.lit(d)).alias("intercept")))


def fit_groups(rows: DataFrame, by: list[str], features: list[str], y: str = "y", l2: float = 1.0, weight: str | None = None) -> DataFrame:
    """One model per group: by, mean, std, coef (arrays), intercept. Groups of one class give no row."""
    return fit_models(rows, by, {"": (list(features), l2)}, y, weight=weight).drop("model")


def score_groups(rows: DataFrame, models: DataFrame, by: list[str], features: list[str], into: str = "score") -> DataFrame:
    """rows of groups that have a model, with their probability; a feature of coefficient 0 may be null."""
    z = F.col("intercept")
    for i, f in enumerate(features):
        part = F.get("coef", F.lit(i)) * ((F.col(f) - F.get("mean", F.lit(i))) / F.get("std", F.lit(i)))
        z = z + F.when(F.get("coef", F.lit(i)) == 0, 0.0).otherwise(part)
    return meet(rows, models, by).withColumn(into, sigmoid(z)).drop("mean", "std", "coef", "intercept")


@dataclass
class Policy:
    """When to answer: a calibrator, its threshold, and where they come from."""

    calibrator: Calibrator
    tau: float
    meta: dict = field(default_factory=dict)

    def confidence(self) -> Column:
        return self.calibrator.probability()

    def decide(self, rows: DataFrame) -> DataFrame:
        """rows with confidence, tau and answer; a threshold of infinity never answers."""
        return rows.withColumn("confidence", self.confidence()).withColumn("tau", F.lit(self.tau)).withColumn("answer", F.col("confidence") >= F.col("tau"))

    def to_json(self) -> str:
        return json.dumps(_strict({"calibrator": asdict(self.calibrator), "tau": self.tau, "meta": self.meta}), sort_keys=True, indent=2, ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> Policy:
        d = json.loads(text)
        return Policy(Calibrator(**d["calibrator"]), float(d["tau"]), d["meta"])

    def summary(self) -> dict:
        """What a service tells about its gate; a guarantee only where it was certified."""
        ltt = self.meta.get("method") == "ltt"
        return {"method": self.meta.get("method"), "alpha": self.meta.get("alpha"), "delta": self.meta.get("delta") if ltt else None, "tau": _strict(self.tau), "guarantee": self.meta.get("guarantee") if ltt else None}


def _strict(value):
    """Values that strict JSON can hold: infinities as text, NaN as null."""
    if isinstance(value, dict):
        return {k: _strict(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [_strict(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None if math.isnan(value) else ("inf" if value > 0 else "-inf")
    return value
