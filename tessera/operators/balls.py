"""Exact search of unit vectors with balls: what lies too far away is never compared.

Vectors are dealt to the nearest of a few centres, in two levels, so that a ball
of the lower one holds a bounded share of its parent. A ball keeps the largest
angle between its centre and a vector of it. By the triangle inequality of angles
no vector in a ball is closer to a query than the angle to the centre less that
radius. A query's nearest balls are searched first; what their k-th vector
scores, other balls have to promise, and those that don't are left alone. The
result is that of comparing every vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric
from .retrieval import top_k
from .settle import settle

#: Angles are compared with this to spare, since cosines and their inverses are rounded.
SLACK = 1e-6
#: Rows of a ball that are compared at a time.
STEP = 8192


@dataclass
class BallIndex:
    """rows: ball, pos, w (a unit vector). heads: ball, centre, radius (an angle), n."""

    rows: DataFrame
    heads: DataFrame


def _unit(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, numeric.l2_normalize(F.col("vec")).alias("w"))


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist() if not len(column) else None
    return np.zeros((0, 0)) if rows is not None else column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _angles(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ centres.T, -1, 1))


def ball_index(vectors: DataFrame, upper: int = 32, lower: int = 32, seed: int = 7) -> BallIndex:
    """Deal vectors (pos, vec) into at most upper * lower balls and write them.

    Centres are vectors of the table: those with the smallest seeded hashes, a
    bounded number, so they are read on the driver. A vector goes to the nearest
    upper centre, then to the nearest of that one's own lower centres. A zero
    vector has an angle of 90 degrees to all. Vectors must be of one length.
    """
    unit = settle(_unit(vectors, "pos"))
    pick = unit.orderBy(F.xxhash64(F.lit(seed), "pos"), "pos").limit(upper * (lower + 1)).toArrow()
    if not pick.num_rows:
        heads = unit.sparkSession.createDataFrame([], "ball int, centre array<double>, radius double, n long")
        return BallIndex(unit.select(F.lit(0).alias("ball"), "*"), heads)
    column = pick.column("w").combine_chunks()
    if len(set(column.value_lengths().to_pylist())) > 1:
        raise ValueError("vectors of one search must be of one length")
    every = _matrix(column)
    tops, rest = every[:upper], every[upper:]
    own = [rest[i :: len(tops)] if len(rest) else rest for i in range(len(tops))]
    centres = [np.concatenate((tops[i : i + 1], own[i])) if len(own[i]) else tops[i : i + 1] for i in range(len(tops))]
    width = max(len(c) for c in centres)
    schema = f"ball int, {unit.schema['pos'].name} {unit.schema['pos'].dataType.simpleString()}, w array<double>, angle double"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            w = _matrix(batch.column("w"))
            if w.shape[1] != tops.shape[1]:
                raise ValueError("vectors of one search must be of one length")
            parent = (w @ tops.T).argmax(axis=1)
            ball, angle = np.zeros(len(w), np.int32), np.zeros(len(w))
            for p in np.unique(parent):
                at = np.flatnonzero(parent == p)
                angles = _angles(w[at], centres[p])
                near = angles.argmin(axis=1)
                ball[at], angle[at] = p * width + near, angles[np.arange(len(at)), near]
            yield pa.RecordBatch.from_arrays([pa.array(ball), batch.column("pos"), batch.column("w"), pa.array(angle)], ["ball", "pos", "w", "angle"])

    dealt = settle(unit.mapInArrow(deal, schema))
    table = unit.sparkSession.createDataFrame([(int(p * width + i), c.tolist()) for p, cs in enumerate(centres) for i, c in enumerate(cs)], "ball int, centre array<double>")
    heads = settle(dealt.groupBy("ball").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).join(table, "ball").select("ball", "centre", "radius", "n"))
    return BallIndex(dealt.drop("angle"), heads)


@dataclass
class Search:
    """hits: query_id, pos, score, rank. heads has query_id, ball and reach (no vector there scores more); first and rest are those that were searched."""

    hits: DataFrame
    heads: DataFrame
    first: DataFrame
    rest: DataFrame


def _best(index: BallIndex, asked: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The k best vectors of every wanted ball (query_id, ball) for its query: query_id, pos, score.

    A ball's vectors are dealt into pieces that a task holds, and the queries
    that want it meet each piece.
    """
    pieces = index.heads.select("ball", F.ceil(F.col("n") / STEP).cast("int").alias("pieces"))
    needed = wanted.select("ball").distinct().join(pieces, "ball")
    vectors = index.rows.join(needed, "ball").select("ball", F.pmod(F.xxhash64("pos"), F.col("pieces")).cast("int").alias("piece"), "pos", "w")
    q = wanted.join(pieces, "ball").join(asked, "query_id").select("ball", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "query_id", "w")
    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, pos {index.rows.schema['pos'].dataType.simpleString()}, score double"

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": right.column("query_id").slice(0, 0), "pos": left.column("pos").slice(0, 0), "score": pa.array([], pa.float64())})
        left = left.sort_by("pos")
        scores = _matrix(right.column("w").combine_chunks()) @ _matrix(left.column("w").combine_chunks()).T
        n = min(k, scores.shape[1])
        rounded = np.round(scores, 9)
        order = np.argsort(-rounded, axis=1, kind="stable")[:, :n]
        rows = np.repeat(np.arange(len(scores)), n)
        return pa.table({"query_id": right.column("query_id").take(pa.array(rows)), "pos": left.column("pos").take(pa.array(order.ravel())), "score": pa.array(scores[rows, order.ravel()])})

    return vectors.groupBy("ball", "piece").cogroup(q.groupBy("ball", "piece")).applyInArrow(meet, kinds)


def search(index: BallIndex, queries: DataFrame, k: int) -> Search:
    """The k best vectors of each query (query_id, vec) by inner product of unit vectors, as retrieval.vector_search gives them."""
    if k <= 0:
        raise ValueError("k must be positive")
    asked = settle(_unit(queries, "query_id"))
    # the balls are a bounded table: every query is held against every centre
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), numeric.dot(F.col("w"), F.col("centre")))))
    reach = F.cos(F.greatest(F.lit(0.0), angle - F.col("radius") - SLACK))
    size = F.sqrt(numeric.dot(F.col("w"), F.col("w")))
    heads = settle(asked.crossJoin(F.broadcast(index.heads)).select("query_id", "ball", "n", F.when(size > 0, reach).otherwise(1.0).alias("reach")))
    before = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("reach"), "ball").rowsBetween(Window.unboundedPreceding, -1))
    first = settle(heads.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < k).select("query_id", "ball"))
    found = settle(_best(index, asked, first, k))
    least = top_k(found, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    open_ = heads.join(first, ["query_id", "ball"], "left_anti").join(least, "query_id", "left")
    rest = settle(open_.where(F.col("least").isNull() | (F.col("reach") >= F.col("least") - SLACK)).select("query_id", "ball"))
    hits = found.unionByName(_best(index, asked, rest, k))
    return Search(top_k(hits, k), heads, first, rest)
