"""Mixing sources to target weights by iterative proportional fitting.

Token counts per cell (source, language, topic) are raked until the marginals
equal their targets. A document's probability is its cell's fitted weight over
its actual one, scaled so that none exceeds 1; sampling with it gives a corpus
whose expected token marginals are the targets.

Targets name a closed list of values per dimension. Values that aren't named
fall together as "other" and keep the share of tokens they have. So the cells
number at most the product of the lists' lengths plus one each, whatever the
size of the corpus; that is what reaches the driver, with the bounded counts
that topics are made from.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, documents, stored, unused

OTHER = "\x00other"


@dataclass
class Fit:
    """names: values per dimension; weights: fitted over actual tokens per cell; error: largest gap of a marginal share."""

    names: list[list[str]]
    actual: np.ndarray
    fitted: np.ndarray
    error: float
    rounds: int

    @property
    def weights(self) -> np.ndarray:
        return np.divide(self.fitted, self.actual, out=np.zeros_like(self.fitted), where=self.actual > 0)


def rake(actual: np.ndarray, targets: list[np.ndarray], rounds: int = 1000, tolerance: float = 1e-10) -> tuple[np.ndarray, float, int]:
    """Scale a table of counts until its marginal shares equal the targets.

    Targets are shares per value of each axis. A value without counts can't be
    raised: its share goes to the others of its axis.
    """
    total = actual.sum()
    fitted = actual.astype(np.float64) / total if total else actual.astype(np.float64)
    axes = range(actual.ndim)
    goals = []
    for d in axes:
        present = actual.sum(axis=tuple(a for a in axes if a != d)) > 0
        goal = np.where(present, targets[d], 0.0)
        goals.append(goal / goal.sum() if goal.sum() else goal)
    error, n = np.inf if total else 0.0, 0
    while error > tolerance and n < rounds:
        for d in axes:
            have = fitted.sum(axis=tuple(a for a in axes if a != d))
            ratio = np.divide(goals[d], have, out=np.zeros_like(have), where=have > 0)
            fitted = fitted * ratio.reshape([-1 if a == d else 1 for a in axes])
        error = max(np.abs(fitted.sum(axis=tuple(a for a in axes if a != d)) - goals[d]).max() for d in axes)
        n += 1
    return fitted * total, float(error), n


def _named(column: Column, values: list[str]) -> Column:
    text = column.cast("string")
    return F.when(text.isin(values), text).otherwise(F.lit(OTHER))


def fit(rows: DataFrame, dimensions: dict[str, Column], targets: dict[str, dict[str, float]], tokens: Column, tolerance: float = 1e-3) -> Fit:
    """Rake the tokens of rows to targets (weights per value, in any scale).

    Cells without tokens can make targets unreachable; where some marginal share
    stays further off than tolerance, a warning says so and Fit.error how far.
    """
    names = [[*targets[d], OTHER] for d in dimensions]
    cells = (
        rows.select(*[_named(c, list(targets[d])).alias(f"d{i}") for i, (d, c) in enumerate(dimensions.items())], tokens.cast("double").alias("t"))
        .groupBy(*[f"d{i}" for i in range(len(names))])
        .agg(F.sum("t").alias("t"))
        .collect()
    )
    actual = np.zeros([len(n) for n in names])
    for r in cells:
        actual[tuple(names[i].index(r[f"d{i}"]) for i in range(len(names)))] = r["t"] or 0
    shares = []
    for i, d in enumerate(dimensions):
        have = actual.sum(axis=tuple(a for a in range(len(names)) if a != i))
        rest = have[-1] / have.sum() if have.sum() else 0.0
        given = np.array(list(targets[d].values()), np.float64)
        shares.append(np.append(given / given.sum() * (1 - rest), rest))
    fitted, error, rounds = rake(actual, shares)
    if error > tolerance:
        warnings.warn(f"targets can't all be met: a marginal share stays {error:.3g} off after {rounds} rounds", stacklevel=2)
    return Fit(names, actual, fitted, error, rounds)


def with_probability(rows: DataFrame, found: Fit, dimensions: dict[str, Column], into: str = "probability") -> DataFrame:
    """rows with each row's calibrated probability: its cell's weight over the largest weight."""
    weights = found.weights
    top = weights.max() if weights.size and weights.max() > 0 else 1.0
    table = {"\x01".join(found.names[i][x] for i, x in enumerate(at)): float(w / top) for at, w in np.ndenumerate(weights) if w > 0}
    key = F.concat_ws("\x01", *[_named(c, n[:-1]) for c, n in zip(dimensions.values(), found.names, strict=True)])
    if not table:
        return rows.withColumn(into, F.lit(0.0))
    own, cell, p = unused([*rows.columns, into], "__key", "__cell", "__p")
    lookup = rows.sparkSession.createDataFrame(list(table.items()), f"`{cell}` string, `{p}` double")
    return rows.withColumn(own, key).join(F.broadcast(lookup), F.col(own) == F.col(cell), "left").withColumn(into, F.coalesce(p, F.lit(0.0))).drop(own, cell, p)


def uniform(seed: int, *columns: str) -> Column:
    """A number in [0, 1) that follows from the columns and the seed."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in columns]), F.lit(1 << 53)).cast("double") / float(1 << 53)


#: Places of a word profile: words fall into them by hash.
PLACES = 1 << 14


def _read(text: Column) -> Column:
    """n_tokens, the words of a whole text, and places, those of its distinct words in lower case; none for null."""
    filled = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), f"[{SPACE}]+"), lambda w: w != "")
    places = lambda w: F.array_distinct(F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(PLACES)).cast("int")))
    return F.element_at(F.transform(F.array(filled), lambda w: F.struct(F.size(w).cast("long").alias("n_tokens"), places(w).alias("places"))), 1)


def _centres(topics: int, seed: int) -> np.ndarray:
    """One seeded vector of +1 and -1 over all places for each topic."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return (rng.integers(0, 2, (topics, PLACES)) * 2 - 1).astype(np.float64)


def with_topic(docs: DataFrame, text_col: str, lang: Column, langs: list[str], topics: int = 6, seed: int = 17) -> DataFrame:
    """docs with n_tokens, the words of each text, and its topic: the nearest of a few seeded centres to its word profile.

    The profile has every distinct word of the whole text, weighted by how rare
    it is among all documents of its language, so words that all texts have
    weigh next to nothing. The language's mean profile, scaled to the text's
    weight, is taken off first: topics cut across languages. Texts that share
    most of their rarer words share a topic, whatever their beginnings; the
    classes have no names. Languages outside langs count as one; a text without
    words, or the only one of its language, is t0. Texts are taken apart once,
    into a scratch table. Document counts, one per language and place, are what
    reaches the driver.
    """
    kinds = [*langs, OTHER]
    of_lang, of_places, parts = unused(docs.columns, "__lang", "__places", "__read")
    read = docs.withColumns({of_lang: _named(lang, langs), parts: _read(F.col(text_col))})
    rows = stored(read.select(*docs.columns, F.col(f"{parts}.n_tokens").alias("n_tokens"), of_lang, F.col(f"{parts}.places").alias(of_places)), "profiles")
    # place -1 counts the documents themselves
    counted = rows.where(F.size(of_places) > 0).select(F.col(of_lang).alias("__lang"), F.explode(F.concat(F.array(F.lit(-1)), of_places)).alias("place")).groupBy("__lang", "place").agg(F.count("*").alias("n")).toArrow()
    n_docs, df = np.zeros(len(kinds)), np.zeros((len(kinds), PLACES))
    of, place, n = np.array([kinds.index(x) for x in counted.column("__lang").to_pylist()], np.int64), counted.column("place").to_numpy(), counted.column("n").to_numpy()
    n_docs[of[place < 0]] = n[place < 0]
    df[of[place >= 0], place[place >= 0]] = n[place >= 0]
    rarity = np.where(df > 0, np.log((n_docs[:, None] + 1) / np.maximum(df, 1)), 0.0)
    mass = df * rarity
    mean = mass @ _centres(topics, seed).T / np.maximum(mass.sum(axis=1, keepdims=True), 1e-300)
    schema = rows.drop(of_lang, of_places).schema.add("topic", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        pull = rarity[:, :, None] * (_centres(topics, seed).T[None] - mean[:, None, :])
        for batch in batches:
            places = batch.column(batch.num_columns - 1)
            lengths, at = np.diff(places.offsets.to_numpy()), places.flatten().to_numpy(zero_copy_only=False)
            kind = np.repeat([kinds.index(x) for x in batch.column(batch.num_columns - 2).to_pylist()], lengths)
            score = np.zeros((batch.num_rows, topics))
            some = np.flatnonzero(lengths)
            if len(some):
                score[some] = np.add.reduceat(pull[kind, at], (np.cumsum(lengths) - lengths)[some])
            topic = pa.array([f"t{x}" for x in score.round(9).argmax(axis=1)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], topic], [*batch.schema.names[:-2], "topic"])

    return rows.mapInArrow(run, schema)


#: Production targets of the queries below: weights per value.
TARGETS = {
    "source": {f"src{i}": 2.0 if i == 0 else 1.0 for i in range(20)},
    "lang": {"en": 0.6, "de": 0.14, "fr": 0.14, "es": 0.12},
    "topic": {f"t{i}": 1.0 for i in range(6)},
}


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, seed: int = 23, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """All columns of docs with topic, n_tokens, probability, sampled and raking_error.

    raking_error is the largest gap left between a marginal share of tokens and
    its target, the same in every row.

    Null sources and languages count as other values. A text without words has
    no weight and takes its cell's probability. Equal rows share their fate.
    Topics are those of with_topic. Columns of docs with the names of results
    are replaced.
    """
    targets = targets or TARGETS
    docs = docs.drop(*[c for c in ("topic", "n_tokens", "probability", "sampled", "raking_error") if c not in (source_col, lang_col, text_col, id_col)])
    rows = with_topic(docs, text_col, F.col(lang_col), list(targets["lang"]), len(targets["topic"]))
    dimensions = {"source": F.col(source_col), "lang": F.col(lang_col), "topic": F.col("topic")}
    found = fit(rows, dimensions, targets, F.col("n_tokens"))
    return with_probability(rows, found, dimensions).withColumn("sampled", uniform(seed, id_col, text_col) < F.col("probability")).withColumn("raking_error", F.lit(found.error))


def op7_raked_mixture(spark, sf_dir: str) -> DataFrame:
    """Calibrated probability of every document, and whether the sample takes it."""
    out = mix(documents(spark, sf_dir).select("doc_id", "text", "source", "lang"))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "sampled", "raking_error")
