"""Calibration and ranking metrics as aggregations.

Rows hold a score, a 0/1 label y and any grouping columns `by` (a split, a
model). Every metric gives one row per group. Windows run over one row per
distinct score, not over rows, and without groups over ranges of scores in
parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .settle import settle


def meet(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """On the grouping columns, null groups among them, or the one-row table beside every row where there are none."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    named = right.withColumnsRenamed({c: f"__{c}" for c in by})
    on = [left[c].eqNullSafe(named[f"__{c}"]) for c in by]
    return left.join(named, on, how).drop(*[f"__{c}" for c in by])


def running(rows: DataFrame, by: list[str], key: str, values: dict[str, str], down: bool = False) -> DataFrame:
    """rows with sums of columns up to and including their own key, in order of key: values maps new names to columns.

    Keys are unique within a group. With groups this is a window. Without, keys
    are dealt out by range, summed per range, and the sums of the ranges before
    are added: one row per range, and there are as many as shuffle partitions.
    """
    order = F.col(key).desc() if down else F.col(key)
    if by:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({n: F.sum(c).over(w) for n, c in values.items()})
    dealt = settle(rows.repartitionByRange(order).withColumn("__range", F.spark_partition_id()))
    within = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    whole = dealt.groupBy("__range").agg(*[F.sum(c).alias(f"__{n}") for n, c in values.items()])
    offsets = whole.select("__range", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in values])
    out = dealt.join(F.broadcast(offsets), "__range").withColumns({n: F.sum(c).over(within) + F.col(f"__{n}") for n, c in values.items()})
    return out.drop("__range", *[f"__{n}" for n in values])


def count_of(weight: str | None) -> Column:
    """Number of rows; weight: a column that says how many rows a row stands for."""
    return F.count("*") if weight is None else F.sum(weight)


def mean_of(value: Column, weight: str | None) -> Column:
    """Mean of the values that aren't null, with rows counted as in count_of."""
    if weight is None:
        return F.avg(value)
    return F.try_divide(F.sum(value * F.col(weight)), F.sum(F.when(value.isNotNull(), F.col(weight))))


def _profile(rows: DataFrame, by: list[str], score: str, y: str, weight: str | None = None) -> DataFrame:
    """by, threshold, n and e there, n_answered, n_errors, n_total."""
    wrong = 1 - F.col(y) if weight is None else (1 - F.col(y)) * F.col(weight)
    each = rows.groupBy(*by, F.col(score).alias("threshold")).agg(count_of(weight).alias("n"), F.sum(wrong).cast("long").alias("e"))
    total = rows.groupBy(*by).agg(count_of(weight).alias("n_total"))
    return meet(running(each, by, "threshold", {"n_answered": "n", "n_errors": "e"}, down=True), total, by)


def risk_profile(rows: DataFrame, by: list[str] | None = None, score: str = "score", y: str = "y", weight: str | None = None) -> DataFrame:
    """Answered and wrong rows at or above every distinct score: by, threshold, n_answered, n_errors, n_total, coverage, risk."""
    by = by or []
    out = _profile(rows, by, score, y, weight).select(*by, "threshold", "n_answered", "n_errors", "n_total")
    return out.withColumn("coverage", F.col("n_answered") / F.col("n_total")).withColumn("risk", F.col("n_errors") / F.col("n_answered"))


def risk_coverage(rows: DataFrame, by: list[str] | None = None, score: str = "score", y: str = "y") -> DataFrame:
    return risk_profile(rows, by, score, y).select(*(by or []), "coverage", "risk")


def aurc(rows: DataFrame, by: list[str] | None = None, score: str = "score", y: str = "y") -> DataFrame:
    """Area under the risk-coverage steps; tied scores are one step."""
    by = by or []
    steps = _profile(rows, by, score, y)
    return steps.groupBy(*by).agg(F.sum(F.col("n") / F.col("n_total") * F.col("n_errors") / F.col("n_answered")).alias("aurc"))


def oracle_aurc(rows: DataFrame, by: list[str] | None = None, y: str = "y") -> DataFrame:
    """The least area any score could reach: all right rows first."""
    by = by or []
    n = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(y).alias("pos"))
    each = n.select(*by, "pos", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k"))
    return each.groupBy(*by).agg(F.avg(F.greatest(F.lit(0), F.col("k") - F.col("pos")) / F.col("k")).alias("oracle_aurc"))


def eaurc(rows: DataFrame, by: list[str] | None = None, score: str = "score", y: str = "y") -> DataFrame:
    by = by or []
    return meet(aurc(rows, by, score, y), oracle_aurc(rows, by, y), by).withColumn("eaurc", F.col("aurc") - F.col("oracle_aurc"))


def brier(rows: DataFrame, by: list[str] | None = None, score: str = "score", y: str = "y") -> DataFrame:
    return rows.groupBy(*(by or [])).agg(F.avg(F.pow(F.col(score) - F.col(y), 2)).alias("brier"))


def reliability_bins(rows: DataFrame, by: list[str] | None = None, bins: int = 10, score: str = "score", y: str = "y") -> DataFrame:
    """Equal-width bins of probability, 1 in the last; empty bins have count 0 and null means."""
    by = by or []
    bin_ = F.least(F.floor(F.col(score) * bins).cast("int"), F.lit(bins - 1))
    have = rows.groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("confidence"), F.avg(y).alias("accuracy"))
    every = rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()
    every = every.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(have, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def ece(rows: DataFrame, by: list[str] | None = None, bins: int = 10, score: str = "score", y: str = "y") -> DataFrame:
    """Mean gap of accuracy and confidence over the bins, weighted by their rows."""
    by = by or []
    b = reliability_bins(rows, by, bins, score, y)
    gap = F.coalesce(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence")), F.lit(0.0))
    return b.groupBy(*by).agg(F.try_divide(F.sum(gap), F.sum("n")).alias("ece"))


def selective_accuracy(rows: DataFrame, coverages: list[float], by: list[str] | None = None, score: str = "score", y: str = "y", order: str = "item") -> DataFrame:
    """Mean label of the best ceil(c * n) rows, at least one; ties in order of `order`.

    Rows above the score where a coverage ends are counted by score; only rows
    at that score are put in order.
    """
    by = by or []
    each = _profile(rows, by, score, y).withColumn("c", F.explode(F.array(*[F.lit(c) for c in coverages])))
    each = each.withColumn("m", F.greatest(F.lit(1), F.ceil(F.col("c") * F.col("n_total") - 1e-9)))
    before, good = F.col("n_answered") - F.col("n"), F.col("n_answered") - F.col("n") - (F.col("n_errors") - F.col("e"))
    ends = each.where((before < F.col("m")) & (F.col("m") <= F.col("n_answered"))).select(*by, "threshold", "c", "m", (F.col("m") - before).alias("take"), good.alias("good"))
    at = rows.select(*by, F.col(score).alias("threshold"), F.col(y).alias("__y"), F.col(order).alias("__o")).join(ends, [*by, "threshold"])
    w = Window.partitionBy(*by, "c").orderBy("__o")
    last = at.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= F.col("take"))
    return last.groupBy(*by, F.col("c").alias("coverage")).agg(((F.first("good") + F.sum("__y")) / F.first("m")).alias("accuracy"))


def auroc(rows: DataFrame, by: list[str] | None = None, score: str = "score", y: str = "y") -> DataFrame:
    """P(positive above negative) with ties as a half, from rank sums; null where a class is empty."""
    by = by or []
    each = rows.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(y).cast("long").alias("p"))
    mid = running(each, by, score, {"upto": "n"}).withColumn("mid", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2)
    total = mid.groupBy(*by).agg(F.sum(F.col("p") * F.col("mid")).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    area = F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, (F.col("p") * (F.col("n") - F.col("p"))).cast("double"))
    return total.select(*by, area.alias("auroc"))


def summary(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """mean, p05, p95, n of the finite values of each group; nulls where there are none."""
    finite = F.when(~F.isnan(value) & (F.abs(F.col(value)) != float("inf")), F.col(value))
    kept = values.withColumn("__v", finite)
    return kept.groupBy(*by).agg(F.avg("__v").alias("mean"), F.percentile("__v", F.lit(0.05)).alias("p05"), F.percentile("__v", F.lit(0.95)).alias("p95"), F.count("__v").alias("n"))


def metric_names(ks: list[int]) -> list[str]:
    return [f"hit@{k}" for k in ks] + [f"mrr@{max(ks)}"] + [f"recall@{k}" for k in ks]


def ranking_scores(ranked: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """Per question with gold: query_id, metric, value of hit@k, mrr@max(k) and recall@k. ranked: query_id, pos, rank."""
    if not ks or min(ks) <= 0:
        raise ValueError("ks must be positive")
    found = gold.distinct().join(ranked.select("query_id", "pos", "rank").where(F.col("rank") <= max(ks)), ["query_id", "pos"], "left")
    per = found.groupBy("query_id").agg(
        F.count("*").alias("g"), F.min("rank").alias("best"), *[F.count_if(F.coalesce(F.col("rank") <= k, F.lit(False))).alias(f"in{k}") for k in ks]
    )
    values = [(f"hit@{k}", (F.col(f"in{k}") > 0).cast("double")) for k in ks]
    values += [(f"mrr@{max(ks)}", F.coalesce(1.0 / F.col("best"), F.lit(0.0)))]
    values += [(f"recall@{k}", F.col(f"in{k}") / F.col("g")) for k in ks]
    return per.select("query_id", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in values])).alias("m")).select("query_id", "m.*")


def candidate_recall(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of gold found anywhere in the candidates, averaged over questions with gold."""
    found = gold.distinct().join(candidates.select("query_id", "pos", F.lit(1).alias("in")), ["query_id", "pos"], "left")
    return found.groupBy("query_id").agg((F.count("in") / F.count("*")).alias("r")).agg(F.avg("r").alias("candidate_recall"))


def system_metrics(rows: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """Metrics of a system per group from rows (answered, answerable, correct, em, f1, key_fact, citation_precision); null where undefined."""
    a, ok, good = F.col("answered"), F.col("answerable"), F.col("correct")
    mean = lambda value, where: mean_of(F.when(where, value.cast("double")), weight)
    should_abstain = ~(ok & good)
    return rows.groupBy(*by).agg(
        mean_of(a.cast("double"), weight).alias("coverage"),
        (1 - mean(good, a)).alias("selective_risk"),
        mean(a, ~ok).alias("hallucination_rate"),
        mean(a & ~good, ok).alias("wrong_answer_rate"),
        mean_of(F.when(ok, a & good).otherwise(~a).cast("double"), weight).alias("accuracy"),
        mean(should_abstain, ~a).alias("abstention_precision"),
        mean(~a, should_abstain).alias("abstention_recall"),
        *[mean(F.col(m), a & ok).alias(m) for m in ("em", "f1", "key_fact", "citation_precision") if m in rows.columns],
    )
