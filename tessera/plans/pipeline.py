"""Questions to answers: retrieve, rerank, extract features, gate, read, validate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import features, reader
from ..operators.calibrate import Policy
from ..operators.retrieval import marked
from ..operators.settle import settle


def context_of(results: DataFrame, chunks: DataFrame, k_ctx: int) -> DataFrame:
    """query_id, rank, chunk_id, title, text of the first k_ctx rows; texts join only now."""
    first = results.where(F.col("rank") <= k_ctx).select("query_id", "pos", "rank")
    return first.join(marked(chunks.select("pos", "chunk_id", "title", "text"), first, "pos"), "pos").drop("pos")


def answer(
    chunks: DataFrame,
    questions: DataFrame,
    policy: Policy | None = None,
    k_ctx: int = 3,
    top: int = 10,
    forced: bool = False,
    reranking: bool = True,
    read=reader.extractive,
    index=None,
    score=None,
    dense=None,
) -> DataFrame:
    """One row per question: answer, abstained, stage (policy, generator or null), confidence, citations, quotes, features.

    chunks: pos, chunk_id, title, text. Questions that the gate holds back, or
    that found nothing, are rows of their own branch, so the reader never sees
    them; without a policy every question with results is read. read, index,
    score and dense: see models.reading, retrieval.build_index, models.Reranker
    and models.Embedded.
    """
    top = max(top, k_ctx)
    corpus = chunks.select("pos", "text")
    found, _, results = features.evidence(corpus, questions, k_ctx, top, reranking, index=index, score=score, dense=dense)
    names = features.FEATURES if reranking else features.RETRIEVAL_FEATURES
    n = results.groupBy("query_id").agg(F.count("*").alias("n_results"))
    rows = found.join(n, "query_id", "left").withColumn("n_results", F.coalesce("n_results", F.lit(0)))
    rows = settle(policy.decide(rows).drop("answer", "tau") if policy else rows.withColumn("confidence", F.lit(None).cast("double")))
    open_gate = F.col("n_results") > 0
    if policy:
        open_gate = open_gate & (F.col("confidence") >= F.lit(policy.tau))
    none = F.array().cast("array<string>")
    held = rows.where(~open_gate).select(
        "query_id",
        F.lit(tx.ABSTENTION).alias("answer"),
        F.lit(True).alias("abstained"),
        F.lit("policy").alias("stage"),
        "confidence",
        none.alias("citations"),
        none.alias("evidence_quotes"),
        F.lit(True).alias("grounded"),
        F.lit(None).cast("string").alias("reason"),
        *names,
    )
    going = rows.where(open_gate)
    asked = questions.join(going.select("query_id"), "query_id", "left_semi")
    context = settle(context_of(results.join(going.select("query_id"), "query_id", "left_semi"), chunks, k_ctx))
    said = read(context, asked, forced=forced)
    answered = going.join(said, "query_id").select(
        "query_id",
        "answer",
        F.col("abstain").alias("abstained"),
        F.when(F.col("abstain"), "generator").alias("stage"),
        "confidence",
        "citations",
        "evidence_quotes",
        "grounded",
        "reason",
        *names,
    )
    return held.unionByName(answered)


def read_both(chunks: DataFrame, questions: DataFrame, k_ctx: int = 3, top: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features, free and forced answers by reader, context), without a gate."""
    found, _, results = features.evidence(chunks.select("pos", "text"), questions, k_ctx, max(top, k_ctx))
    context = settle(context_of(results, chunks, k_ctx))
    free = reader.extractive(context, questions).withColumn("reader", F.lit("free"))
    forced = reader.extractive(context, questions, forced=True).withColumn("reader", F.lit("forced"))
    return found, free.unionByName(forced), context


def score_items(chunks: DataFrame, items: DataFrame, k_ctx: int = 3, top: int = 10, progress: Callable[[int, int], None] | None = None, parts: int = 10) -> DataFrame:
    """One row per (item, reader): answered, correctness and answer metrics against the reference, with features.

    items: query_id, text, reference, answerable, category, gold (array of chunk
    ids). With progress, which is told (items done, items), they are scored in
    so many parts, one after the other.
    """
    if progress is not None:
        rows, done, total = None, 0, items.count()
        for i in range(parts):
            own = items.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)
            part = settle(score_items(chunks, own, k_ctx, top))
            rows, done = part if rows is None else rows.unionByName(part), done + own.count()
            progress(done, total)
        return rows
    found, answers, _ = read_both(chunks, items.select("query_id", "text"), k_ctx, top)
    rows = answers.join(items.drop("text"), "query_id")
    ok = F.col("answerable") & ~F.col("abstain")
    measured = lambda c: F.when(F.col("answerable"), c).otherwise(0.0)
    return rows.select(
        F.col("query_id").alias("item"),
        "reader",
        "category",
        "answerable",
        "answer",
        (~F.col("abstain")).alias("answered"),
        "grounded",
        F.coalesce(ok & tx.is_correct(F.col("answer"), F.col("reference")), F.lit(False)).alias("correct"),
        measured(tx.exact_match(F.col("answer"), F.col("reference"))).alias("em"),
        measured(tx.token_f1(F.col("answer"), F.col("reference"))).alias("f1"),
        measured(tx.key_fact_match(F.col("answer"), F.col("reference"))).alias("key_fact"),
        F.coalesce(F.try_divide(F.size(F.array_intersect("citations", "gold")).cast("double"), F.size("citations").cast("double")), F.lit(0.0)).alias("citation_precision"),
    ).join(found.withColumnRenamed("query_id", "item"), "item")
