"""Abstention features: the outcome of retrieval as numbers, one row per question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rerank import two_stage
from .retrieval import Index, hybrid_search
from .settle import settle

RETRIEVAL_FEATURES = ["rrf_top1", "rrf_margin", "bm25_top1", "dense_top1", "rank_agreement", "overlap_at_5"]
FEATURES = ["ce_top1", "ce_margin", "ce_entropy", *RETRIEVAL_FEATURES]


def _at(rank: str, n: int, value: str):
    return F.max(F.when(F.col(rank) == n, F.col(value)))


def first_stage_features(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """The six features of first-stage rows; rank_agreement is of the final first row."""
    five = lambda c: F.coalesce(F.col(f"{c}_rank") <= 5, F.lit(False))
    c = candidates.groupBy("query_id").agg(
        _at("rank", 1, "score").alias("f1"),
        _at("rank", 2, "score").alias("f2"),
        _at("bm25_rank", 1, "bm25_score").alias("bs"),
        _at("dense_rank", 1, "dense_score").alias("ds"),
        F.count_if(five("bm25") & five("dense")).alias("both5"),
        F.count_if(five("bm25") | five("dense")).alias("any5"),
    )
    t = results.groupBy("query_id").agg(_at("rank", 1, "bm25_rank").alias("b1"), _at("rank", 1, "dense_rank").alias("d1"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return c.join(t, "query_id", "left").select(
        "query_id",
        zero(F.col("f1")).alias("rrf_top1"),
        zero(F.col("f1") - F.col("f2")).alias("rrf_margin"),
        F.log1p(F.greatest(F.lit(0.0), zero(F.col("bs")))).alias("bm25_top1"),
        zero(F.col("ds")).alias("dense_top1"),
        zero(1.0 / (1 + F.abs(F.col("b1") - F.col("d1")))).alias("rank_agreement"),
        zero(F.try_divide(F.col("both5").cast("double"), F.col("any5"))).alias("overlap_at_5"),
    )


def rerank_features(results: DataFrame) -> DataFrame:
    """First logit, margin to the second, and normalised entropy of the softmax of all logits kept."""
    top = results.groupBy("query_id").agg(
        F.count("*").alias("n"), F.max("logit").alias("z"), _at("rank", 1, "logit").alias("l1"), _at("rank", 2, "logit").alias("l2"), F.collect_list("logit").alias("all")
    )
    weight = F.transform("all", lambda x: F.exp(x - F.col("z")))
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    entropy = -F.aggregate("w", F.lit(0.0), lambda a, x: a + F.when(x > 0, x / F.col("t") * F.log(x / F.col("t"))).otherwise(0.0))
    return (
        top.withColumn("w", weight)
        .withColumn("t", total)
        .select(
            "query_id",
            F.col("l1").alias("ce_top1"),
            F.coalesce(F.col("l1") - F.col("l2"), F.lit(0.0)).alias("ce_margin"),
            F.when(F.col("n") >= 2, entropy / F.log(F.col("n").cast("double"))).otherwise(0.0).alias("ce_entropy"),
        )
    )


def evidence(corpus: DataFrame, queries: DataFrame, k_ctx: int = 3, top: int = 10, reranking: bool = True, pool: int = 50, index: Index | None = None, score=None, dense=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features per question, candidates, results). A question without candidates has zeros throughout.

    index, score and dense stand in for what is built or used otherwise: see rerank.two_stage.
    """
    if k_ctx <= 0 or top < k_ctx:
        raise ValueError("need 0 < k_ctx <= top")
    if reranking:
        candidates, results = two_stage(corpus, queries, top, pool, index=index, score=score, dense=dense)
        found = first_stage_features(candidates, results).join(rerank_features(results), "query_id", "left")
    else:
        candidates = settle(hybrid_search(corpus, queries, max(top, pool), index=index, dense=dense))
        results = candidates.where(F.col("rank") <= top)
        found = first_stage_features(candidates, results)
    names = FEATURES if reranking else RETRIEVAL_FEATURES
    rows = queries.select("query_id").join(found, "query_id", "left").select("query_id", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])
    return rows, candidates, results


def safe_labels(queries: DataFrame, results: DataFrame, gold: DataFrame, k_ctx: int = 3) -> DataFrame:
    """query_id, safe: 1 if one of the first k_ctx rows is gold."""
    hit = results.where(F.col("rank") <= k_ctx).join(gold, ["query_id", "pos"], "left_semi").select("query_id").distinct().withColumn("hit", F.lit(1))
    return queries.select("query_id").join(hit, "query_id", "left").select("query_id", F.coalesce("hit", F.lit(0)).alias("safe"))
