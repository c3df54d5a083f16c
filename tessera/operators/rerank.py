"""Lexical interaction scores of (query, passage) pairs, and two-stage retrieval."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric, text
from .retrieval import Index, asked_once, for_all, hybrid_search, marked, rank_by
from .settle import settle

# fixed values: weights of the features and the bias of the logit
WEIGHTS = {"coverage": 6.0, "proximity": 3.0, "bigram": 2.0, "fuzzy": 1.0}
BIAS = -5.0


def _min_span(at: np.ndarray, terms: np.ndarray) -> int:
    """Length of the shortest window of tokens that holds all terms that occur, from their places in order."""
    last: dict[int, int] = {}
    n, best = len(np.unique(terms)), int(at[-1] - at[0]) + 1
    for i, t in zip(at.tolist(), terms.tolist(), strict=True):
        last.pop(t, None)
        last[t] = i  # the first key is the term seen longest ago
        if len(last) == n:
            best = min(best, i - last[next(iter(last))] + 1)
    return best


def _gram_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of #word# for all words: the word each belongs to, in order, and the trigram as a number."""
    n = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(f"#{w}#" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(words)), n)
    at = np.arange(len(owner)) + 2 * owner
    code = letters[at] << 42 | letters[at + 1] << 21 | letters[at + 2]
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    fresh = np.concatenate(([True], (np.diff(owner) != 0) | (np.diff(code) != 0)))[: len(owner)]
    return owner[fresh], code[fresh]


def _similarity(terms: list[str], others: list[str]) -> np.ndarray:
    """Trigram Jaccard of every other word (row) with every term, through the trigrams of the terms."""
    term, own = _gram_codes(terms)
    known, which = np.unique(own, return_inverse=True)
    has = np.zeros((len(known), len(terms)))
    has[which, term] = 1
    other, code = _gram_codes(others)
    common = np.zeros((len(others), len(terms)))
    if len(known) and len(other):
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        met = known[at] == code
        rows, at = other[met], at[met]
        if len(rows):
            start = np.flatnonzero(np.concatenate(([True], np.diff(rows) != 0)))
            common[rows[start]] = np.add.reduceat(has[at], start, axis=0)
    a, b = np.bincount(term, minlength=len(terms)), np.bincount(other, minlength=len(others))
    return common / np.maximum(a[None, :] + b[:, None] - common, 1)


def _score(table: pa.Table) -> pa.Table:
    """Features of all candidates of one question. Words are numbers from the start: their dictionary is Arrow's."""
    q = table.column("q")[0].as_py()
    lists = table.column("d").combine_chunks()
    size = np.array(lists.value_lengths().fill_null(0), np.int64)
    coded = lists.flatten().dictionary_encode()
    words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    terms = sorted(set(q))
    out = np.zeros((len(size), 4))
    if terms and len(code):
        number = {t: i for i, t in enumerate(terms)}
        term_of = np.array([number.get(w, -1) for w in words], np.int64)
        doc = np.repeat(np.arange(len(size)), size)
        term = term_of[code]
        at = np.flatnonzero(term >= 0)
        hit = np.zeros((len(size), len(terms)), bool)
        hit[doc[at], term[at]] = True
        df = hit.sum(axis=0)
        idf = np.log1p((len(size) - df + 0.5) / (df + 0.5))
        out[:, 0] = hit @ idf / idf.sum()
        starts = np.searchsorted(doc[at], np.arange(len(size) + 1))
        m = hit.sum(axis=1)
        for k in np.flatnonzero(m >= 2):
            own = slice(starts[k], starts[k + 1])
            out[k, 1] = m[k] / len(terms) * m[k] / _min_span(at[own], term[at[own]])
        pairs = np.unique([number[a] * len(terms) + number[b] for a, b in zip(q, q[1:], strict=False)]) if len(q) > 1 else np.zeros(0, np.int64)
        if len(pairs):
            both = np.flatnonzero((term[:-1] >= 0) & (term[1:] >= 0) & (doc[:-1] == doc[1:]))
            seen = np.stack((doc[both], term[both] * len(terms) + term[both + 1]), axis=1)
            seen = np.unique(seen[np.isin(seen[:, 1], pairs)], axis=0)
            out[:, 2] = np.bincount(seen[:, 0], minlength=len(size)) / len(pairs)
        near = _similarity(terms, words)
        near[term_of >= 0, term_of[term_of >= 0]] = 1.0
        once = np.unique(doc * len(words) + code)
        start = np.flatnonzero(np.concatenate(([True], np.diff(once // len(words)) != 0)))
        out[once[start] // len(words), 3] = np.maximum.reduceat(near[once % len(words)], start, axis=0).mean(axis=1)
    return pa.Table.from_arrays([table.column("query_id"), table.column("pos"), *[pa.array(out[:, i]) for i in range(4)]], ["query_id", "pos", "coverage", "proximity", "bigram", "fuzzy"])


def lexical_features(pairs: DataFrame) -> DataFrame:
    """coverage, proximity, bigram, fuzzy and logit of pairs (query_id, pos, query, passage, or its tokens as d).

    The idf is over the candidates of each query. Without query terms or
    passage tokens all features are 0. The candidates of one question, as many
    as the first stage's pool, go through one Arrow batch: comparing their
    vocabulary with the question's terms by trigrams took 35 s as joins at
    1,000 documents and takes 2 s so.
    """
    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("query_id", "pos"))
    d = F.col("d") if "d" in pairs.columns else text.tokenize(F.col("passage")).alias("d")
    p = pairs.select("query_id", "pos", text.tokenize(F.col("query")).alias("q"), d)
    scored = p.groupBy("query_id").applyInArrow(_score, f"{kinds}, coverage double, proximity double, bigram double, fuzzy double")
    return scored.withColumn("logit", logit())


def candidate_idf_of(pairs: DataFrame) -> DataFrame:
    """query_id, term, idf of each question's terms over its passages (query_id, query, passage)."""
    p = pairs.select("query_id", text.tokenize(F.col("query")).alias("q"), text.tokenize(F.col("passage")).alias("d"))
    terms = p.groupBy("query_id").agg(F.count("*").alias("n"), F.first("q").alias("q")).select("query_id", "n", F.explode(F.array_distinct("q")).alias("term"))
    have = p.select("query_id", F.explode(F.array_intersect("q", "d")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("df"))
    df = F.coalesce("df", F.lit(0))
    return terms.join(have, ["query_id", "term"], "left").select("query_id", "term", F.log1p((F.col("n") - df + 0.5) / (df + 0.5)).alias("idf"))


def logit() -> Column:
    out = F.lit(BIAS)
    for name, w in WEIGHTS.items():
        out = out + w * F.col(name)
    return out


def rerank(pairs: DataFrame, keep: int | None = None) -> DataFrame:
    """Pairs by logit, ties in order of pos: query_id, pos, logit, probability, rank."""
    scored = lexical_features(pairs).select("query_id", "pos", "logit", numeric.sigmoid(F.col("logit")).alias("probability"))
    ranked = scored.withColumn("rank", rank_by(F.round("logit", 9).desc(), F.col("pos")))
    return ranked if keep is None else ranked.where(F.col("rank") <= keep)


def two_stage(
    corpus: DataFrame, queries: DataFrame, top: int = 10, retrieve: int = 50, mode: str = "hybrid", index: Index | None = None, score: Callable[[DataFrame], DataFrame] | None = None, dense: Callable | None = None
) -> tuple[DataFrame, DataFrame]:
    """(candidates, results): first-stage rows, and the top of them by logit.

    Results keep first_stage_rank and first_stage_score; ties of logits go to
    the better first-stage rank. score: another scorer of pairs (query_id, pos,
    query, passage) giving query_id, pos and logit, such as models.Reranker.score.
    dense: another dense retriever, as in hybrid_search.
    """
    if top <= 0 or retrieve <= 0:
        raise ValueError("top and retrieve must be positive")
    # every text is asked once, however many questions have it
    queries, of = asked_once(queries)
    # a pool per question, used several times over: kept, so that later plans start from it
    candidates = settle(hybrid_search(corpus, queries, max(retrieve, top), mode, index=index, dense=dense))
    passages = index.tokens if index is not None and score is None else corpus.select("pos", F.col("text").alias("passage"))
    pairs = candidates.select("query_id", "pos").join(queries.select("query_id", F.col("text").alias("query")), "query_id").join(marked(passages, candidates, "pos"), "pos")
    scored = (score or lexical_features)(pairs).select("query_id", "pos", "logit")
    rows = candidates.withColumnsRenamed({"rank": "first_stage_rank", "score": "first_stage_score"}).join(scored, ["query_id", "pos"])
    ranked = rows.withColumn("rank", rank_by(F.round("logit", 9).desc(), F.col("first_stage_rank"))).where(F.col("rank") <= top)
    results = settle(ranked.withColumns({"score": F.col("logit"), "probability": numeric.sigmoid(F.col("logit"))}))
    return for_all(candidates, of), for_all(results, of)
