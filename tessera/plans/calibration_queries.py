"""Registered queries on scored labels: calibration, thresholds, ranking quality.

Scores come from the labelled documents: score = n / (n + 1000), n the
characters, to two digits, so that ties abound; y is the label `quality`; the
group is the document's language.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import binom_cdf, min_certifiable_n
from ..operators import metrics, rerank, retrieval, thresholds
from ..operators.settle import settle
from . import sql
from .registry import register
from .retrieval_queries import corpus, GOLD, gold, index, questions, rrf_lists

S = "s AS (SELECT d.doc_id AS item, lang, round(n_chars / (n_chars + 1000.0::DOUBLE), 2) AS score, quality AS y, toxic FROM labels JOIN documents d USING (doc_id))"
PROFILE = """prof AS (SELECT lang, score AS threshold, sum(n) OVER w AS n_answered, sum(e) OVER w AS n_errors, sum(n) OVER (PARTITION BY lang) AS n_total
  FROM (SELECT lang, score, count(*) AS n, sum(1 - y) AS e FROM s GROUP BY ALL) WINDOW w AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


def scored(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = F.round(F.col("n_chars") / (F.col("n_chars") + 1000.0), 2)
    # both tables grow with the corpus: neither passes through the driver
    return labels.hint("merge").join(docs, "doc_id").select(F.col("doc_id").alias("item"), "lang", score.alias("score"), F.col("quality").alias("y"), "toxic")


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


@register("risk_profile", f"WITH {S}, {PROFILE} SELECT lang, threshold, n_answered::BIGINT AS n_answered, n_errors::BIGINT AS n_errors, n_total::BIGINT AS n_total, round(n_answered / n_total, 6) AS coverage, round(n_errors / n_answered, 6) AS risk FROM prof")
def risk_profile(spark, sf_dir):
    return metrics.risk_profile(scored(spark, sf_dir), ["lang"]).select("lang", "threshold", "n_answered", "n_errors", "n_total", *r6("coverage", "risk"))


@register("risk_coverage_curve", f"WITH {S}, {PROFILE} SELECT lang, round(n_answered / n_total, 6) AS coverage, round(n_errors / n_answered, 6) AS risk FROM prof")
def risk_coverage(spark, sf_dir):
    return metrics.risk_coverage(scored(spark, sf_dir), ["lang"]).select("lang", *r6("coverage", "risk"))


@register(
    "aurc",
    f"""WITH {S}, {PROFILE}, a AS (SELECT lang, sum(step / n_total * n_errors / n_answered) AS aurc FROM (SELECT *, n_answered - coalesce(lag(n_answered) OVER (PARTITION BY lang ORDER BY threshold DESC), 0) AS step FROM prof) GROUP BY lang),
o AS (SELECT lang, avg(greatest(0, k - pos)::DOUBLE / k) AS oracle FROM (SELECT lang, pos, unnest(generate_series(1, n)) AS k FROM (SELECT lang, count(*) AS n, sum(y) AS pos FROM s GROUP BY lang)) GROUP BY lang)
SELECT lang, round(aurc, 6) AS aurc, round(oracle, 6) AS oracle_aurc, round(aurc - oracle, 6) AS eaurc FROM a JOIN o USING (lang)""",
)
def aurc(spark, sf_dir):
    return metrics.eaurc(scored(spark, sf_dir), ["lang"]).select("lang", *r6("aurc", "oracle_aurc", "eaurc"))


@register("brier", f"WITH {S} SELECT lang, round(avg((score - y) * (score - y)), 6) AS brier FROM s GROUP BY lang")
def brier(spark, sf_dir):
    return metrics.brier(scored(spark, sf_dir), ["lang"]).select("lang", *r6("brier"))


_BINS = f"WITH {S}, b AS (SELECT l.lang, g.bin FROM (SELECT DISTINCT lang FROM s) l, (SELECT unnest(generate_series(0, 9)) AS bin) g), h AS (SELECT lang, least(floor(score * 10)::INT, 9) AS bin, count(*) AS n, avg(score) AS confidence, avg(y) AS accuracy FROM s GROUP BY ALL), bins AS (SELECT b.lang, b.bin, coalesce(n, 0) AS n, confidence, accuracy FROM b LEFT JOIN h USING (lang, bin))"


@register("reliability_bins", f"{_BINS} SELECT lang, bin::INT AS bin, n::BIGINT AS n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM bins")
def reliability_bins(spark, sf_dir):
    return metrics.reliability_bins(scored(spark, sf_dir), ["lang"]).select("lang", "bin", "n", *r6("confidence", "accuracy"))


@register("ece", f"{_BINS} SELECT lang, round(sum(coalesce(n * abs(accuracy - confidence), 0)) / sum(n), 6) AS ece FROM bins GROUP BY lang")
def ece(spark, sf_dir):
    return metrics.ece(scored(spark, sf_dir), ["lang"]).select("lang", *r6("ece"))


@register("auroc", f"WITH {S}, p AS (SELECT a.lang, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS auroc FROM s a JOIN s b ON a.lang = b.lang AND a.y = 1 AND b.y = 0 GROUP BY a.lang) SELECT lang, round(auroc, 6) AS auroc FROM (SELECT DISTINCT lang FROM s) LEFT JOIN p USING (lang)")
def auroc(spark, sf_dir):
    return metrics.auroc(scored(spark, sf_dir), ["lang"]).select("lang", *r6("auroc"))


@register(
    "selective_accuracy",
    f"WITH {S}, r AS (SELECT lang, y, row_number() OVER (PARTITION BY lang ORDER BY score DESC, item) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM s) SELECT lang, c AS coverage, round(avg(y), 6) AS accuracy FROM r, (SELECT unnest([0.5::DOUBLE, 0.8, 0.9, 1.0]) AS c) WHERE rn <= greatest(1, ceil(c * n - 1e-9)) GROUP BY ALL",
)
def selective_accuracy(spark, sf_dir):
    return metrics.selective_accuracy(scored(spark, sf_dir), [0.5, 0.8, 0.9, 1.0], ["lang"]).select("lang", "coverage", *r6("accuracy"))


@register(
    "erm_threshold",
    f"""WITH {S}, {PROFILE}, ok AS (SELECT * FROM prof WHERE n_errors / n_answered <= 0.15 + 1e-12 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_answered DESC) = 1)
SELECT lang, coalesce(threshold, 'Infinity'::DOUBLE) AS tau, round(coalesce(ok.n_answered / ok.n_total, 0), 6) AS cal_coverage, round(n_errors / n_answered, 6) AS cal_risk, coalesce(n_answered, 0)::BIGINT AS n_answered FROM (SELECT DISTINCT lang FROM s) LEFT JOIN ok USING (lang)""",
)
def erm(spark, sf_dir):
    return thresholds.erm_threshold(scored(spark, sf_dir), 0.15, ["lang"]).select("lang", "tau", *r6("cal_coverage", "cal_risk"), "n_answered")


_N_MIN = min_certifiable_n(0.2, 0.1)
_CDF = "CASE WHEN {k} >= {n} THEN 1.0 ELSE list_sum(list_transform(generate_series(0, ({k})::BIGINT), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln(0.2) + ({n} - i) * ln(0.8)))) END"


@register(
    "ltt_threshold",
    f"""WITH {S}, {PROFILE}, t AS (SELECT *, {_CDF.format(k='n_errors', n='n_answered')} AS p FROM prof WHERE n_answered >= {_N_MIN}),
w AS (SELECT *, min(CASE WHEN p <= 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY lang ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS ok FROM t),
best AS (SELECT * FROM w WHERE ok = 1 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY threshold) = 1)
SELECT g.lang, coalesce(threshold, 'Infinity'::DOUBLE) AS tau, round(coalesce(n_answered / n_total, 0), 6) AS cal_coverage, round(n_errors / n_answered, 6) AS cal_risk, coalesce(n_answered, 0)::BIGINT AS n_answered,
  CASE WHEN threshold IS NOT NULL THEN NULL WHEN n < {_N_MIN} THEN n || ' items are fewer than the {_N_MIN} that a guarantee takes' ELSE 'the strictest threshold that can be tested errs too often' END AS reason
FROM (SELECT lang, count(*) AS n FROM s GROUP BY lang) g LEFT JOIN best USING (lang)""",
)
def ltt(spark, sf_dir):
    return thresholds.ltt_threshold(scored(spark, sf_dir), 0.2, 0.1, by=["lang"]).select("lang", "tau", *r6("cal_coverage", "cal_risk"), "n_answered", "reason")


@register("binom_cdf", f"WITH {S}, {PROFILE} SELECT lang, threshold, round({_CDF.format(k='n_errors', n='n_answered')}, 6) AS cdf FROM prof")
def binom(spark, sf_dir):
    p = metrics.risk_profile(scored(spark, sf_dir), ["lang"])
    return p.select("lang", "threshold", F.round(binom_cdf(F.col("n_errors"), F.col("n_answered"), 0.2), 6).alias("cdf"))


def _grid(spark, sf_dir):
    rows = scored(spark, sf_dir)
    train, cal = rows.where(F.col("item") % 2 == 0), rows.where(F.col("item") % 2 == 1)
    sizes = cal.groupBy("lang").agg(F.count("*").alias("n_cal"))
    return cal, thresholds.coverage_grid(train, sizes, 0.2, 0.1, ["lang"])


_GRID = f"""{S}, cal AS (SELECT * FROM s WHERE item % 2 = 1), n AS (SELECT lang, count(*) AS n_cal FROM cal GROUP BY lang),
tr AS (SELECT lang, list(score ORDER BY score) AS v FROM s WHERE item % 2 = 0 GROUP BY lang),
pts AS (SELECT lang, v, (1 - ({_N_MIN}::DOUBLE / n_cal + (1 - {_N_MIN}::DOUBLE / n_cal) * i / 49)) * (len(v) - 1) AS a FROM tr JOIN n USING (lang), (SELECT unnest(generate_series(0, 49)) AS i) WHERE n_cal >= {_N_MIN}),
grid AS (SELECT DISTINCT lang, v[greatest(floor(a), 0)::INT + 1] + (v[least(greatest(floor(a), 0)::INT + 2, len(v))] - v[greatest(floor(a), 0)::INT + 1]) * (a - greatest(floor(a), 0)) AS threshold FROM pts)"""


@register("coverage_grid", f"WITH {_GRID} SELECT DISTINCT lang, round(threshold, 6) AS threshold FROM grid")
def coverage_grid(spark, sf_dir):
    return _grid(spark, sf_dir)[1].select("lang", *r6("threshold")).distinct()


@register(
    "ltt_on_grid",
    f"""WITH {_GRID}, c AS (SELECT g.lang, threshold, count(*) FILTER (score >= threshold) AS n_answered, coalesce(sum(1 - y) FILTER (score >= threshold), 0) AS n_errors FROM grid g JOIN cal USING (lang) GROUP BY ALL),
t AS (SELECT *, {_CDF.format(k='n_errors', n='n_answered')} AS p FROM c WHERE n_answered >= {_N_MIN}),
w AS (SELECT *, min(CASE WHEN p <= 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY lang ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS ok FROM t),
best AS (SELECT * FROM w WHERE ok = 1 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY threshold) = 1)
SELECT n.lang, round(coalesce(threshold, 'Infinity'::DOUBLE), 6) AS tau, coalesce(n_answered, 0)::BIGINT AS n_answered, round(n_errors / n_answered, 6) AS cal_risk FROM n LEFT JOIN best USING (lang)""",
)
def ltt_on_grid(spark, sf_dir):
    cal, grid = _grid(spark, sf_dir)
    return thresholds.ltt_threshold(cal, 0.2, 0.1, grid, ["lang"]).select("lang", *r6("tau"), "n_answered", *r6("cal_risk"))


@register(
    "threshold_outcome",
    f"""WITH {S}, {PROFILE}, ok AS (SELECT * FROM prof WHERE n_errors / n_answered <= 0.15 + 1e-12 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_answered DESC) = 1),
t AS (SELECT lang, coalesce(threshold, 'Infinity'::DOUBLE) AS tau FROM (SELECT DISTINCT lang FROM s) LEFT JOIN ok USING (lang))
SELECT lang, round(avg(CASE WHEN score >= tau THEN 1.0 ELSE 0 END), 6) AS test_coverage, round(avg(CASE WHEN score >= tau THEN 1 - toxic END), 6) AS test_risk, any_value(tau) = 'Infinity'::DOUBLE AS abstain_all FROM s JOIN t USING (lang) GROUP BY lang""",
)
def threshold_outcome(spark, sf_dir):
    rows = scored(spark, sf_dir)
    tau = thresholds.erm_threshold(rows, 0.15, ["lang"]).select("lang", "tau")
    return thresholds.outcome(rows.withColumn("y", F.col("toxic")), tau, ["lang"]).select("lang", *r6("test_coverage", "test_risk"), "abstain_all")


@register(
    "score_summary",
    f"WITH {S} SELECT lang, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.05), 6) AS p05, round(quantile_cont(score, 0.95), 6) AS p95, count(*) AS n FROM s GROUP BY lang",
)
def score_summary(spark, sf_dir):
    return metrics.summary(scored(spark, sf_dir), ["lang"], "score").select("lang", *r6("mean", "p05", "p95"), "n")


@register("label_statistics", f"WITH {S} SELECT count(*) AS n, count(*) FILTER (y = 1) AS safe, count(*) FILTER (y = 0) AS unsafe, count(*) FILTER (y = 0 AND toxic = 1) AS unsafe_toxic, coalesce(sum(('0x' || substr(md5(item::VARCHAR), 1, 12))::BIGINT) FILTER (y = 0), 0)::BIGINT AS misses FROM s")
def label_statistics(spark, sf_dir):
    """Counts, and the missed items as a sum of hashes of their ids."""
    r = scored(spark, sf_dir)
    hashed = F.conv(F.substring(F.md5(F.col("item").cast("string")), 1, 12), 16, 10).cast("long")
    return r.agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("safe"), F.count_if(F.col("y") == 0).alias("unsafe"), F.count_if((F.col("y") == 0) & (F.col("toxic") == 1)).alias("unsafe_toxic"), F.coalesce(F.sum(F.when(F.col("y") == 0, hashed)), F.lit(0).cast("long")).alias("misses"))


def _tracks(spark, sf_dir):
    """The ten best of both retrievers and of their fusion, from one search of each."""
    sparse, dense = (settle(hits) for hits in rrf_lists(spark, sf_dir))
    keep = lambda df, n: df.where(F.col("rank") <= 10).select(F.lit(n).alias("track"), "query_id", "pos", "rank", "score")
    return settle(keep(sparse, "sparse").union(keep(dense, "dense")).union(keep(retrieval.fuse([sparse, dense]), "hybrid")))


TRACKS = f"""{sql.HYBRID}, {GOLD}, tracks AS (SELECT 'sparse' AS track, query_id, pos, rank, score FROM sparse WHERE rank <= 10 UNION ALL SELECT 'dense', query_id, pos, rank, score FROM dense WHERE rank <= 10 UNION ALL SELECT 'hybrid', query_id, pos, rank, score FROM fused WHERE rank <= 10),
per AS (SELECT t.track, g.query_id, count(*) AS g, min(x.rank) AS best, count(*) FILTER (x.rank <= 1) AS in1, count(*) FILTER (x.rank <= 3) AS in3, count(*) FILTER (x.rank <= 5) AS in5, count(*) FILTER (x.rank <= 10) AS in10
  FROM gold g CROSS JOIN (SELECT DISTINCT track FROM tracks) t LEFT JOIN tracks x ON x.track = t.track AND x.query_id = g.query_id AND x.pos = g.pos GROUP BY ALL),
m AS (SELECT track, query_id, unnest([{{'m': 'hit@1', 'v': (in1 > 0)::INT::DOUBLE}}, {{'m': 'hit@3', 'v': (in3 > 0)::INT::DOUBLE}}, {{'m': 'hit@5', 'v': (in5 > 0)::INT::DOUBLE}}, {{'m': 'hit@10', 'v': (in10 > 0)::INT::DOUBLE}}, {{'m': 'mrr@10', 'v': coalesce(1.0::DOUBLE / best, 0)}},
  {{'m': 'recall@1', 'v': in1::DOUBLE / g}}, {{'m': 'recall@3', 'v': in3::DOUBLE / g}}, {{'m': 'recall@5', 'v': in5::DOUBLE / g}}, {{'m': 'recall@10', 'v': in10::DOUBLE / g}}]) AS u FROM per)"""


def _scores(spark, sf_dir):
    g, t = gold(spark, sf_dir), _tracks(spark, sf_dir)
    out = None
    for name in ("sparse", "dense", "hybrid"):
        part = metrics.ranking_scores(t.where(F.col("track") == name), g, [1, 3, 5, 10]).withColumn("track", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@register("ranking_metrics", f"WITH {TRACKS[5:]} SELECT track, u.m AS metric, round(avg(u.v), 6) AS value, count(*) AS n FROM m GROUP BY ALL")
def ranking_metrics(spark, sf_dir):
    return _scores(spark, sf_dir).groupBy("track", "metric").agg(F.round(F.avg("value"), 6).alias("value"), F.count("*").alias("n"))


@register(
    "ranking_metrics_by_category",
    f"WITH {TRACKS[5:]}, c AS (SELECT item_id AS query_id, CASE WHEN length(text) < 200 THEN 'short' ELSE 'long' END AS category FROM benchmark) SELECT track, u.m AS metric, category, round(avg(u.v), 6) AS value, count(*) AS n FROM m JOIN c USING (query_id) GROUP BY GROUPING SETS ((track, u.m), (track, u.m, category))",
)
def ranking_by_category(spark, sf_dir):
    kind = questions(spark, sf_dir).select("query_id", F.when(F.length("text") < 200, "short").otherwise("long").alias("category"))
    joined = _scores(spark, sf_dir).join(kind, "query_id")
    return joined.groupingSets([["track", "metric"], ["track", "metric", "category"]], "track", "metric", "category").agg(F.round(F.avg("value"), 6).alias("value"), F.count("*").alias("n"))


@register(
    "track_deltas",
    f"WITH {TRACKS[5:]}, a AS (SELECT query_id, u.m AS metric, u.v AS v FROM m WHERE track = 'sparse'), b AS (SELECT query_id, u.m AS metric, u.v AS v FROM m WHERE track = 'hybrid') SELECT metric, round(avg(b.v - a.v), 6) AS delta, count(*) AS n FROM a JOIN b USING (query_id, metric) GROUP BY metric",
)
def track_deltas(spark, sf_dir):
    s = _scores(spark, sf_dir)
    a = s.where("track = 'sparse'").select("query_id", "metric", F.col("value").alias("a"))
    b = s.where("track = 'hybrid'").select("query_id", "metric", F.col("value").alias("b"))
    return a.join(b, ["query_id", "metric"]).groupBy("metric").agg(F.round(F.avg(F.col("b") - F.col("a")), 6).alias("delta"), F.count("*").alias("n"))


@register(
    "top1_by_answerability",
    f"""WITH {TRACKS[5:]}, t1 AS (SELECT t.track, q.query_id, x.score, q.query_id IN (SELECT query_id FROM gold) AS answerable FROM queries q CROSS JOIN (SELECT DISTINCT track FROM tracks) t LEFT JOIN tracks x ON x.track = t.track AND x.query_id = q.query_id AND x.rank = 1),
p AS (SELECT a.track, avg(CASE WHEN round(coalesce(a.score, '-Infinity'::DOUBLE), 9) > round(coalesce(b.score, '-Infinity'::DOUBLE), 9) THEN 1.0 WHEN round(coalesce(a.score, '-Infinity'::DOUBLE), 9) = round(coalesce(b.score, '-Infinity'::DOUBLE), 9) THEN 0.5 ELSE 0 END) AS auroc FROM t1 a JOIN t1 b ON a.track = b.track AND a.answerable AND NOT b.answerable GROUP BY a.track)
SELECT track, round(avg(score) FILTER (answerable), 6) AS mean_answerable, round(avg(score) FILTER (NOT answerable), 6) AS mean_unanswerable, round(any_value(auroc), 6) AS auroc FROM t1 LEFT JOIN p USING (track) GROUP BY track""",
)
def top1_by_answerability(spark, sf_dir):
    """First scores of answerable and other questions; a question without results counts as minus infinity in the ranking only."""
    q = questions(spark, sf_dir).select("query_id")
    answerable = gold(spark, sf_dir).select("query_id").distinct().withColumn("g", F.lit(1))
    tracks = _tracks(spark, sf_dir).where("rank = 1").select("track", "query_id", "score")
    names = spark.createDataFrame([("sparse",), ("dense",), ("hybrid",)], "track string")
    rows = q.crossJoin(F.broadcast(names)).join(tracks, ["track", "query_id"], "left").join(answerable, "query_id", "left").withColumn("y", F.coalesce("g", F.lit(0)))
    area = metrics.auroc(rows.withColumn("s", F.round(F.coalesce("score", F.lit(float("-inf"))), 9)), ["track"], "s")
    means = rows.groupBy("track").agg(F.avg(F.when(F.col("y") == 1, F.col("score"))).alias("mean_answerable"), F.avg(F.when(F.col("y") == 0, F.col("score"))).alias("mean_unanswerable"))
    return means.join(area, "track").select("track", *r6("mean_answerable", "mean_unanswerable", "auroc"))


@register("candidate_recall", f"WITH {TRACKS[5:]} SELECT round(avg(r), 6) AS candidate_recall FROM (SELECT g.query_id, count(f.pos)::DOUBLE / count(*) AS r FROM gold g LEFT JOIN (SELECT query_id, pos FROM fused WHERE rank <= 50) f USING (query_id, pos) GROUP BY g.query_id)")
def candidate_recall(spark, sf_dir):
    hits = retrieval.hybrid_search(corpus(spark, sf_dir), questions(spark, sf_dir), 50, index=index(spark, sf_dir))
    return metrics.candidate_recall(hits, gold(spark, sf_dir)).select(*r6("candidate_recall"))


@register(
    "vector_label_hits",
    f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings),
n AS (SELECT q.label AS ql, d.label AS dl, q.vec_id AS q, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.u, d.u), 9) DESC, d.vec_id) AS rank FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0)
SELECT ql AS label, round(avg(hit), 6) AS hit_at_5, round(avg(rr), 6) AS mrr_at_5 FROM (SELECT q, ql, max(CASE WHEN ql = dl THEN 1.0::DOUBLE ELSE 0 END) AS hit, max(CASE WHEN ql = dl THEN 1.0::DOUBLE / rank ELSE 0 END) AS rr FROM n WHERE rank <= 5 GROUP BY ALL) GROUP BY ql""",
)
def vector_label_hits(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = v.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    near = retrieval.vector_search(v.select(F.col("vec_id").alias("pos"), F.col("embedding").alias("vec")), asked, 6).where(F.col("query_id") != F.col("pos"))
    near = retrieval.top_k(near.select("query_id", "pos", "score"), 5)
    labels = v.select(F.col("vec_id").alias("pos"), F.col("label").alias("dl"))
    own = v.select(F.col("vec_id").alias("query_id"), F.col("label"))
    same = F.col("label") == F.col("dl")
    per = near.join(labels, "pos").join(own, "query_id").groupBy("query_id", "label").agg(F.max(F.when(same, 1.0).otherwise(0.0)).alias("hit"), F.max(F.when(same, 1.0 / F.col("rank")).otherwise(0.0)).alias("rr"))
    return per.groupBy("label").agg(F.round(F.avg("hit"), 6).alias("hit_at_5"), F.round(F.avg("rr"), 6).alias("mrr_at_5"))


@register("rerank_margins", f"{sql.RERANKED} SELECT query_id, round(max(CASE WHEN final_rank = 1 THEN logit END), 6) AS top, round(coalesce(max(CASE WHEN final_rank = 1 THEN logit END) - max(CASE WHEN final_rank = 2 THEN logit END), 0), 6) AS margin FROM reranked GROUP BY query_id")
def rerank_margins(spark, sf_dir):
    _, results = rerank.two_stage(corpus(spark, sf_dir), questions(spark, sf_dir), 10, index=index(spark, sf_dir))
    at = lambda n: F.max(F.when(F.col("rank") == n, F.col("logit")))
    return results.groupBy("query_id").agg(F.round(at(1), 6).alias("top"), F.round(F.coalesce(at(1) - at(2), F.lit(0.0)), 6).alias("margin"))
