"""Bootstrap resamples as weighted sums: who is drawn how often follows from keys, not from a generator.

A resample of a group draws as many rows as it has, with replacement. Rows fall
into blocks of bounded size. How many draws a block gets is a multinomial split
down a tree: each node divides its draws over its halves by a binomial whose
generator is keyed by the node, so every block finds its share alone. Within the
block each draw is a 64-bit hash of seed, block, resample and draw, modulo the
block's rows. No group is held by one task, and in a group of one block plain SQL
gives the same draws.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import metrics
from .settle import settle

#: Rows of a block at the mean.
BLOCK = 1024

# fixed values: multipliers of the splitmix64 finaliser
MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a permutation of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, np.uint64)
        for shift, by in ((30, MULTIPLIERS[0]), (27, MULTIPLIERS[1])):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        return x ^ (x >> np.uint64(31))


def block_key(seed: int, block: int) -> int:
    return int(mix(np.array([(seed << 32 | block) & (1 << 64) - 1], np.uint64))[0])


def draws(seed: int, block: int, times: int, per: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Resample and row number of every draw of a block; per: how many draws each resample makes there."""
    which = np.repeat(np.arange(times, dtype=np.uint64), per)
    nth = np.arange(len(which), dtype=np.uint64) - np.repeat((np.cumsum(per) - per).astype(np.uint64), per)
    return which.astype(np.int64), (mix(np.uint64(block_key(seed, block)) ^ (which << np.uint64(32) | nth)) % np.uint64(rows)).astype(np.int64)


def _share(seed: int, times: int, total: int, path: list[dict]) -> np.ndarray:
    """Draws that each resample makes in a block, from the sizes of the nodes above it, the root first."""
    per = np.full(times, total, np.int64)
    for node in path:
        rng = np.random.Generator(np.random.Philox(key=[seed & (1 << 64) - 1, int(node["level"]) << 48 | int(node["node"])]))
        left = rng.binomial(per, node["left"] / node["size"])
        per = per - left if node["right"] else left
    return per


def _blocks(rows: DataFrame, by: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """rows with their block, stored, and per block its group's rows and the nodes above it."""
    total = rows.groupBy(*by).agg(F.count("*").alias("n_total"))
    levels = F.when(F.col("n_total") <= BLOCK, 0).otherwise(F.ceil(F.log2(F.col("n_total") / BLOCK)).cast("int") + 1)
    sized = total.withColumn("levels", levels)
    placed = metrics.meet(rows, sized, by)
    placed = settle(placed.withColumn("block", F.expr(f"pmod(xxhash64(`{order}`), shiftleft(1L, levels))")).drop("n_total"))
    blocks = placed.groupBy(*by, "block", "levels").agg(F.count("*").alias("rows"))
    blocks = settle(metrics.meet(blocks, total, by))
    node = lambda level: F.expr(f"shiftright(block, levels - {level})")
    every = blocks.withColumn("level", F.explode(F.sequence(F.lit(0), "levels"))).withColumn("node", node("level"))
    sizes = every.groupBy(*by, "level", "node").agg(F.sum("rows").alias("size"))
    steps = every.where("level < levels").select(*by, "block", "level", "node", F.expr("shiftright(block, levels - level - 1) % 2 = 1").alias("right"))
    left = sizes.select(*by, (F.col("level") - 1).alias("level"), F.expr("shiftright(node, 1)").alias("node"), F.col("size").alias("left"), (F.col("node") % 2).alias("odd")).where("odd = 0").drop("odd")
    known = metrics.meet(metrics.meet(steps, sizes, [*by, "level", "node"]), left, [*by, "level", "node"], "left").withColumn("left", F.coalesce("left", F.lit(0)))
    paths = known.groupBy(*by, "block").agg(F.array_sort(F.collect_list(F.struct("level", "node", "right", "size", "left"))).alias("path"))
    return placed, metrics.meet(blocks, paths, [*by, "block"], "left")


def _resampled(rows: DataFrame, by: list[str], order: str, times: int, seed: int, make, schema: str) -> DataFrame:
    """make(frame of a block in order, its number, resample and row of every draw), for every block."""
    placed, blocks = _blocks(rows, by, order)

    def run(key, own: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(info):
            return pd.DataFrame()
        own = own.sort_values(order, kind="stable").reset_index(drop=True)
        path = info["path"].iloc[0]
        per = _share(seed, times, int(info["n_total"].iloc[0]), [dict(p) for p in path] if path is not None else [])
        out = make(own, *draws(seed, int(own["block"].iloc[0]), times, per, len(own)))
        for c in by:
            out[c] = own[c].iloc[0]
        return out

    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in by)
    keys = [*by, "block"]
    return placed.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(run, kinds + schema)


def resample_counts(rows: DataFrame, by: list[str], order: str = "item", times: int = 1000, seed: int = 0) -> DataFrame:
    """by, order, resample, n: how often each row is drawn; rows that aren't drawn are absent. order tells the rows of a group apart."""

    def count(own: pd.DataFrame, which: np.ndarray, row: np.ndarray) -> pd.DataFrame:
        cell, n = np.unique(which * len(own) + row, return_counts=True)
        return pd.DataFrame({order: own[order].to_numpy()[cell % len(own)], "resample": cell // len(own), "n": n})

    return _resampled(rows.select(*by, order), by, order, times, seed, count, f"`{order}` {rows.schema[order].dataType.simpleString()}, resample int, n long")


def _interval(per: DataFrame, by: list[str], value: str, level: float) -> list:
    half = (1 - level) / 2
    return [F.percentile(value, F.lit(half)).alias("lo"), F.percentile(value, F.lit(1 - half)).alias("hi")]


def bootstrap_mean(values: DataFrame, by: list[str], value: str = "value", order: str = "item", times: int = 1000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """by, mean, lo, hi: percentile interval of the mean, without nulls; a group of nulls alone has nulls.

    order tells the rows of a group apart and decides which of them a draw is.
    """
    kept = values.where(F.col(value).isNotNull()).select(*by, F.col(order), F.col(value).cast("double").alias("__v"))

    def add(own: pd.DataFrame, which: np.ndarray, row: np.ndarray) -> pd.DataFrame:
        sums = np.bincount(which, own["__v"].to_numpy()[row], times)
        return pd.DataFrame({"resample": np.arange(times), "s": sums, "c": np.bincount(which, minlength=times)})

    per = _resampled(kept, by, order, times, seed, add, "resample int, s double, c long").groupBy(*by, "resample").agg((F.sum("s") / F.sum("c")).alias("m"))
    ends = per.groupBy(*by).agg(*_interval(per, by, "m", level))
    means = values.groupBy(*by).agg(F.avg(value).alias("mean"))
    return metrics.meet(means, ends, by, "left").select(*by, "mean", "lo", "hi")


def paired_bootstrap(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b", order: str = "item", times: int = 1000, seed: int = 0) -> DataFrame:
    """As bootstrap_mean for b - a of the same items, with whether the interval excludes 0."""
    out = bootstrap_mean(pairs.withColumn("value", F.col(b) - F.col(a)), by, "value", order, times, seed)
    return out.withColumn("significant", F.coalesce((F.col("lo") > 0) | (F.col("hi") < 0), F.lit(False)))


def bootstrap_auroc(rows: DataFrame, by: list[str], scores: list[str], y: str = "y", order: str = "item", times: int = 1000, seed: int = 0) -> DataFrame:
    """by, name, auroc, lo, hi per score, by resampling within each class; with two scores also their difference on shared resamples.

    An area is a sum over the distinct scores of a resample. A group with an
    empty class has nulls.
    """
    own = rows.select(*by, F.col(order), F.col(y).cast("int").alias("__y"), *[F.col(s).cast("double").alias(s) for s in scores])

    def count(frame: pd.DataFrame, which: np.ndarray, row: np.ndarray) -> pd.DataFrame:
        cell, n = np.unique(which * len(frame) + row, return_counts=True)
        picked = frame.iloc[cell % len(frame)]
        return pd.DataFrame({"resample": cell // len(frame), "n": n, "__y": picked["__y"].to_numpy(), **{s: picked[s].to_numpy() for s in scores}})

    # the classes are groups of their own, with draws of their own
    drawn = settle(_resampled(own, [*by, "__y"], order, times, seed, count, "resample int, n long, " + ", ".join(f"`{s}` double" for s in scores)))
    names = F.explode(F.array(*[F.struct(F.lit(s).alias("name"), F.col(s).alias("score")) for s in scores])).alias("x")
    each = drawn.select(*by, "resample", "n", "__y", names).select(*by, "resample", "n", "__y", "x.*")
    keys = [*by, "name", "resample"]
    at = each.groupBy(*keys, "score").agg(F.sum(F.when(F.col("__y") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("__y") == 0, F.col("n")).otherwise(0)).alias("q"))
    below = F.sum("q").over(Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, 0)) - F.col("q") / 2
    areas = at.withColumn("below", below).groupBy(*keys).agg(F.try_divide(F.sum(F.col("p") * F.col("below")), (F.sum("p") * F.sum("q")).cast("double")).alias("area"))
    points = None
    for s in scores:
        part = metrics.auroc(own.withColumn("score", F.col(s)), by, y="__y").withColumn("name", F.lit(s))
        points = part if points is None else points.unionByName(part)
    if len(scores) == 2:
        gap = lambda table, value, keys: table.groupBy(*keys).agg((F.max(F.when(F.col("name") == scores[1], F.col(value))) - F.max(F.when(F.col("name") == scores[0], F.col(value)))).alias(value)).withColumn("name", F.lit("delta"))
        areas = areas.unionByName(gap(areas, "area", [*by, "resample"]))
        points = points.unionByName(gap(points, "auroc", by))
    ends = areas.groupBy(*by, "name").agg(*_interval(areas, by, "area", 0.95))
    return metrics.meet(points, ends, [*by, "name"], "left").select(*by, "name", "auroc", *[F.when(F.col("auroc").isNotNull(), F.col(c)).alias(c) for c in ("lo", "hi")])
