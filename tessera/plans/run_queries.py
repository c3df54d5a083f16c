"""Registered queries that plain SQL can't express: chunking, reading, fitted models, resampling.

They run over whole tables; those without SQL are checked by the tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import benchmark, chunks, evalset, features, metrics, reader, rerank, retrieval
from ..operators.settle import settle
from . import pipeline, sql
from .calibration_queries import S, TRACKS, scored
from .registry import register
from .retrieval_queries import corpus, gold, held, held_among, index, questions


def chunk_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("source").alias("title"), "text")
    return chunks.with_pos(chunks.chunk_texts(docs))


@register("answers_over_documents")
def answers_over_documents(spark, sf_dir):
    """Every benchmark item asked of all chunks, read without a gate."""
    c = settle(chunk_table(spark, sf_dir))
    out = pipeline.answer(c, questions(spark, sf_dir), index=retrieval.build_index(c.select("pos", "text")))
    return out.select("query_id", "answer", "abstained", "stage", "citations", "grounded", "reason")


@register("reader_free_and_forced")
def reader_free_and_forced(spark, sf_dir):
    """Both modes of the reader over the first three documents of each question."""
    c, q = corpus(spark, sf_dir), questions(spark, sf_dir)
    hits = settle(retrieval.hybrid_search(c, q, 3, index=index(spark, sf_dir)).select("query_id", "pos", "rank"))
    context = settle(hits.join(c, "pos").select("query_id", F.col("pos").cast("string").alias("chunk_id"), "rank", "text"))
    both = reader.extractive(context, q, forced=None)
    grouped = context.groupBy("query_id").agg(F.collect_list(F.struct("chunk_id", "text")).alias("context"))
    return both.join(grouped, "query_id").withColumn("error", reader.grounding_error()).drop("context")


def items(spark, sf_dir):
    """Benchmark items with features, the safe-to-answer label and a category."""
    c, q = corpus(spark, sf_dir), questions(spark, sf_dir)
    found, _, results = features.evidence(c, q, index=index(spark, sf_dir))
    g = held_among(results.where(F.col("rank") <= 3), c, q)
    answerable = held(c, q).distinct().withColumn("a", F.lit("answerable"))
    rows = found.join(features.safe_labels(q, results, g), "query_id").join(answerable, "query_id", "left")
    return settle(rows.select(F.col("query_id").alias("item"), F.coalesce("a", F.lit("other")).alias("category"), F.col("safe").alias("y"), *features.FEATURES))


_KINDS = "SELECT item_id AS item, CASE WHEN length(text) < 200 THEN 'short' ELSE 'long' END AS category FROM benchmark"


def dealt_sql(kinds: str, n_splits: int = 200) -> str:
    """CTEs that end in `dealt` (split_id, item, category, fold), for items and categories that a query gives."""
    return f"""k AS ({kinds}), n AS (SELECT category, count(*) AS n FROM k GROUP BY ALL),
f0 AS (SELECT category, n, i, floor(n * fr + 1e-9) AS fl, n * fr - floor(n * fr + 1e-9) AS rest FROM n, (SELECT unnest([0, 1, 2]) AS i, unnest([0.4::DOUBLE, 0.3, 0.3]) AS fr)),
f1 AS (SELECT category, i, fl + CASE WHEN row_number() OVER (PARTITION BY category ORDER BY round(rest, 9) DESC, i) <= n - sum(fl) OVER (PARTITION BY category) THEN 1 ELSE 0 END AS c FROM f0),
f2 AS (SELECT category, i, sum(c) OVER (PARTITION BY category ORDER BY i) AS upto FROM f1),
place AS (SELECT split_id, item, k.category, row_number() OVER (PARTITION BY split_id, k.category ORDER BY md5('0/' || split_id || '/' || item), item) AS place FROM k, (SELECT unnest(range({n_splits})) AS split_id)),
dealt AS (SELECT split_id::INT AS split_id, item, category, ['train', 'cal', 'test'][1 + (SELECT count(*) FROM f2 WHERE f2.category = place.category AND f2.upto < place.place)::INT] AS fold FROM place)"""


@register("stratified_splits", f"WITH {dealt_sql(_KINDS)} SELECT split_id, item, fold FROM dealt")
def stratified_splits(spark, sf_dir):
    """200 splits of the questions, short and long ones dealt out alike."""
    rows = questions(spark, sf_dir).select(F.col("query_id").alias("item"), F.when(F.length("text") < 200, "short").otherwise("long").alias("category"))
    return benchmark.stratified_splits(rows)


@register("benchmark_metrics")
def benchmark_metrics(spark, sf_dir):
    """Ranking and calibration of every model over resampled splits of the benchmark items."""
    rows = items(spark, sf_dir)
    return benchmark.abstention_benchmark(rows, benchmark.dealing(), features.FEATURES, tables=("metrics",))["metrics"]


@register("benchmark_thresholds")
def benchmark_thresholds(spark, sf_dir):
    rows = items(spark, sf_dir)
    return benchmark.abstention_benchmark(rows, benchmark.dealing(), features.FEATURES, tables=("thresholds",))["thresholds"]


_PLACES = "row_number() OVER (PARTITION BY {by} ORDER BY {order}) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS m"
_PER = f"SELECT u.m AS metric, query_id, u.v AS value, {_PLACES.format(by='u.m', order='query_id')} FROM m WHERE track = 'hybrid'"


@register(
    "bootstrap_intervals",
    f"""WITH {TRACKS[5:]}, {sql.drawn(_PER, "metric")},
means AS (SELECT metric, r, avg(value) AS v FROM picked JOIN numbered USING (metric, i) GROUP BY ALL)
SELECT metric, round(any_value(mean) + 1e-12, 6) AS mean, round(quantile_cont(v, 0.025) + 1e-12, 6) AS lo, round(quantile_cont(v, 0.975) + 1e-12, 6) AS hi FROM means JOIN (SELECT metric, avg(value) AS mean FROM numbered GROUP BY ALL) USING (metric) GROUP BY metric""",
)
def bootstrap_intervals(spark, sf_dir):
    """95 % intervals of the ranking metrics of hybrid retrieval, from 1,000 resamples."""
    per = metrics.ranking_scores(retrieval.hybrid_search(corpus(spark, sf_dir), questions(spark, sf_dir), 10, index=index(spark, sf_dir)), gold(spark, sf_dir), [1, 3, 5, 10])
    return benchmark.bootstrap_mean(per, ["metric"], order="query_id").select("metric", *[F.round(F.col(c) + 1e-12, 6).alias(c) for c in ("mean", "lo", "hi")])


_OTHER = "('0x' || substr(md5(item::VARCHAR), 1, 4))::INT % 100 / 100.0::DOUBLE"


@register(
    "bootstrap_auroc",
    f"""WITH {S}, o AS (SELECT *, {_OTHER} AS other FROM s), {sql.drawn(f"SELECT lang, y, item, score, other, {_PLACES.format(by='lang, y', order='item')} FROM o", "lang, y")},
each AS (SELECT lang, r, y, unnest(['score', 'other']) AS name, unnest([score, other]) AS v FROM picked JOIN numbered USING (lang, y, i) UNION ALL SELECT lang, -1, y, unnest(['score', 'other']), unnest([score, other]) FROM o),
tied AS (SELECT lang, r, name, v, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM each GROUP BY ALL),
below AS (SELECT *, sum(q) OVER (PARTITION BY lang, r, name ORDER BY v) - q / 2.0::DOUBLE AS b FROM tied),
area AS (SELECT lang, r, name, sum(p * b) / nullif(sum(p) * sum(q), 0) AS a FROM below GROUP BY ALL),
every AS (FROM area UNION ALL BY NAME SELECT lang, r, 'delta' AS name, max(a) FILTER (name = 'other') - max(a) FILTER (name = 'score') AS a FROM area GROUP BY ALL)
SELECT lang, name, round(max(a) FILTER (r = -1) + 1e-12, 6) AS auroc, round(quantile_cont(a, 0.025) FILTER (r >= 0) + 1e-12, 6) AS lo, round(quantile_cont(a, 0.975) FILTER (r >= 0) + 1e-12, 6) AS hi FROM every GROUP BY ALL""",
)
def bootstrap_auroc(spark, sf_dir):
    """AUROC of two scores and their difference, from 1,000 resamples within each class."""
    other = F.conv(F.substring(F.md5(F.col("item").cast("string")), 1, 4), 16, 10).cast("int") % 100 / 100.0
    rows = scored(spark, sf_dir).withColumn("other", other)
    return benchmark.bootstrap_auroc(rows, ["lang"], ["score", "other"]).select("lang", "name", *[F.round(F.col(c) + 1e-12, 6).alias(c) for c in ("auroc", "lo", "hi")])


@register("extractive_items")
def extractive_items(spark, sf_dir):
    """An evaluation set made from the chunks: clozes, comparisons, conflicts, invented names, other domains."""
    c = settle(chunk_table(spark, sf_dir))
    quotas = {"in_domain_factoid": 50, "in_domain_reasoning": 20, "out_of_domain": 8, "unsupported_fact": 10, "subtle_conflict": 10}
    return evalset.extractive_items(c, quotas).select("category", "question", "gold", "answer", "template", "difficulty")


@register(
    "reranked_probabilities",
    f"{sql.BASE}, fused AS ({sql.topk(sql.SPARSE, 20)}), {sql.FEATURES} SELECT query_id, pos, final_rank::INT AS rank, round(1 / (1 + exp(-logit)), 6) AS probability, rank::INT AS first_stage_rank FROM reranked WHERE final_rank <= 5",
)
def reranked_probabilities(spark, sf_dir):
    """Two-stage retrieval with the sparse retriever first."""
    _, results = rerank.two_stage(corpus(spark, sf_dir), questions(spark, sf_dir), 5, 20, "sparse", index(spark, sf_dir))
    return results.select("query_id", "pos", "rank", F.round("probability", 6).alias("probability"), "first_stage_rank")
