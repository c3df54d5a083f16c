"""Words that are spelt alike: a similarity join by trigrams, and question coverage with near matches.

Every distinct word has the set of its trigrams, between marks at its ends. For a
Jaccard similarity of `least` two sets must share one of the first few trigrams
of each, rarest first (a prefix filter); words meet on those alone and the pairs
are then verified. A question and its one sentence meet in their own row: their
words are few, and the words of the whole table that are like a term are many.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as tx
from .settle import settle

#: Similarity from which a word counts for another.
NEAR = 0.5


def grams(word: Column) -> Column:
    """Distinct trigrams of #word#; none of an empty word."""
    marked = F.concat(F.lit("#"), word, F.lit("#"))
    return F.when(F.length(word) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: F.substring(marked, i, F.lit(3)))))


def _prefixes(words: DataFrame, frequency: DataFrame, least: float) -> DataFrame:
    """word, gram, place, n, g: the trigrams that two similar words can't both lack, with all n of the word, the rarest first."""
    each = words.select("word", F.explode("g").alias("gram")).join(frequency, "gram")
    ordered = each.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("f", "gram"))).alias("e")).select("word", F.size("e").alias("n"), F.col("e.gram").alias("g"))
    # in whole numbers of a millionth, so that a limit such as 0.7 cuts where it says
    needed = F.ceil(F.col("n") * F.lit(round(least * 1_000_000)) / 1_000_000 - 1e-9).cast("int")
    return ordered.select("word", "n", "g", F.posexplode(F.slice("g", F.lit(1), F.col("n") - needed + 1)).alias("place", "gram"))


def trigram_join(terms: DataFrame, words: DataFrame, least: float = NEAR) -> DataFrame:
    """term, word, similarity of every pair with a trigram Jaccard of least (over 0) or more.

    terms has a column term, words a column word; repeats and nulls don't count.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    left = settle(terms.where("term IS NOT NULL").select(F.col("term").alias("word")).distinct().withColumn("g", grams(F.col("word"))))
    right = settle(words.where("word IS NOT NULL").select("word").distinct().withColumn("g", grams(F.col("word"))))
    frequency = left.unionByName(right).select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count("*").alias("f"))
    frequency = settle(frequency)
    a = _prefixes(left, frequency, least).select(F.col("word").alias("term"), "gram", F.col("n").alias("m"), F.col("place").alias("i"), F.col("g").alias("g1"))
    b = _prefixes(right, frequency, least).select("word", "gram", "n", F.col("place").alias("j"), F.col("g").alias("g2"))
    alike = (F.col("m") >= least * F.col("n") - 1e-9) & (F.col("n") >= least * F.col("m") - 1e-9)
    # where two words meet first, what they share is that trigram and others behind it in both
    behind = (F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j")) * (1 + least) >= least * (F.col("m") + F.col("n")) - 1e-9)
    # verified where they meet: what is not similar isn't shuffled again
    common = F.size(F.array_intersect("g1", "g2"))
    met = a.join(b, "gram").where(alike & behind).select("term", "word", (common / (F.col("m") + F.col("n") - common)).alias("similarity"))
    return met.where(F.col("similarity") >= least).distinct()


def soft_coverage(pairs: DataFrame, idf: DataFrame, key: str = "query_id") -> DataFrame:
    """key, coverage: the share of a question's idf that its sentence covers.

    pairs: key, question, sentence, one row per key. idf: key, term, idf; terms
    without one, and words that only ask, don't count. A term counts in full if
    it is in the sentence, else by the most similar word there from NEAR on. A
    question without terms that count has coverage 0.
    """
    asked = pairs.select(key, F.explode(F.array_distinct(tx.tokenize(F.col("question")))).alias("term")).where(~F.col("term").isin(tx.QUESTION_ONLY))
    weights = asked.join(idf.select(key, "term", "idf"), [key, "term"]).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("term", "idf"))).alias("t"))
    share = _covered(F.col("t.term"), F.col("t.idf"), F.array_distinct(tx.tokenize(F.col("sentence"))))
    return pairs.select(key, "sentence").join(weights, key, "left").select(key, F.when(F.col("t").isNull(), 0.0).otherwise(share).alias("coverage"))


def _grams(word: str) -> set[str]:
    marked = f"#{word}#"
    return {marked[i : i + 3] for i in range(len(word))}


def closest(terms: Iterable[str], words: Iterable[str], least: float = NEAR) -> list[float]:
    """For every term the trigram Jaccard of the word most like it, 1 for itself, 0 where none reaches least."""
    words = list(words)
    have, sizes = set(words), [len(_grams(w)) for w in words]
    holding: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        for g in _grams(w):
            holding.setdefault(g, []).append(i)
    out = []
    for term in terms:
        best, common = 0.0, {}
        if term in have:
            out.append(1.0)
            continue
        own = _grams(term)
        for g in own:
            for i in holding.get(g, ()):
                common[i] = common.get(i, 0) + 1
        for i, c in common.items():
            best = max(best, c / (len(own) + sizes[i] - c))
        out.append(best if best >= least else 0.0)
    return out


@F.pandas_udf(DoubleType())
def _covered(terms: pd.Series, idf: pd.Series, words: pd.Series) -> pd.Series:
    """The share of the terms' idf that the words cover; 0 where the idf adds up to nothing."""

    def one(t, i, w) -> float:
        if t is None or not len(t):
            return 0.0
        whole = float(np.sum(i))
        return float(np.dot(i, closest(t, w))) / whole if whole > 0 else 0.0

    return pd.Series([one(t, i, w) for t, i, w in zip(terms, idf, words, strict=True)], dtype="float64")
