"""Answer thresholds: empirical risk, and the sequence of tests that certifies it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import binom_cdf, min_certifiable_n
from .metrics import count_of, mean_of, meet, risk_profile, running
from .settle import settle

NEVER = float("inf")


def _groups(rows: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """One row per group with n_total; one row in all where there are no groups."""
    return rows.groupBy(*by).agg(count_of(weight).alias("n_total"))


def _attach(groups: DataFrame, best: DataFrame, by: list[str]) -> DataFrame:
    if by:
        return groups.join(best, by, "left")
    return groups.join(best, F.lit(True), "left")


def erm_threshold(rows: DataFrame, alpha: float, by: list[str] | None = None, score: str = "score", y: str = "y", weight: str | None = None) -> DataFrame:
    """The threshold of largest coverage whose empirical risk is at most alpha; infinity where none is. weight: see metrics.count_of, here and below."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    by = by or []
    fine = risk_profile(rows, by, score, y, weight).where(F.col("risk") <= alpha + 1e-12)
    best = fine.groupBy(*by).agg(F.max_by(F.struct("threshold", "n_answered", "coverage", "risk"), F.col("n_answered")).alias("b"))
    return _attach(_groups(rows, by, weight), best, by).select(
        *by,
        F.lit(alpha).alias("alpha"),
        F.coalesce("b.threshold", F.lit(NEVER)).alias("tau"),
        F.coalesce("b.coverage", F.lit(0.0)).alias("cal_coverage"),
        F.col("b.risk").alias("cal_risk"),
        F.coalesce("b.n_answered", F.lit(0)).alias("n_answered"),
        F.when(F.col("b.threshold").isNull(), "no threshold meets the risk").alias("reason"),
    )


def coverage_grid(train: DataFrame, cal_sizes: DataFrame, alpha: float, delta: float, by: list[str] | None = None, score: str = "score", points: int = 50, weight: str | None = None) -> DataFrame:
    """by, threshold: quantiles of training scores at evenly spaced coverages from the least certifiable one to 1.

    cal_sizes holds by and n_cal. Groups too small to certify anything have no points.
    """
    by = by or []
    least = min_certifiable_n(alpha, delta)
    sizes = cal_sizes.where(F.col("n_cal") >= least).withColumn("low", F.lit(float(least)) / F.col("n_cal"))
    total = train.groupBy(*by).agg(count_of(weight).alias("__n"))
    both = total.join(sizes, by) if by else total.crossJoin(F.broadcast(sizes))
    share = F.col("low") + (1 - F.col("low")) * F.col("i") / F.lit(float(max(points - 1, 1)))
    marks = both.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn("at", (1 - share) * (F.col("__n") - 1))
    low = F.greatest(F.floor("at"), F.lit(0))
    marks = marks.select(*by, "i", (F.col("at") - low).alias("part"), low.alias("lo"), F.least(low + 1, F.col("__n") - 1).alias("hi"))
    # scores begin at their first place in order; a mark's score is the last that begins at its place or before
    each = train.groupBy(*by, F.col(score).alias("__v")).agg(count_of(weight).alias("__c"))
    begins = running(each, by, "__v", {"__upto": "__c"}).select(*by, (F.col("__upto") - F.col("__c")).alias("place"), "__v")
    if by:
        kind = each.schema["__v"].dataType
        asked = marks.select(*by, "i", "part", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("lo").alias("place")), F.struct(F.lit(1).alias("end"), F.col("hi").alias("place")))).alias("x")).select(*by, "i", "part", "x.end", "x.place")
        null = lambda t: F.lit(None).cast(t)
        line = begins.select(*by, null("int").alias("i"), null("double").alias("part"), null("int").alias("end"), "place", "__v").unionByName(asked.withColumn("__v", null(kind)))
        w = Window.partitionBy(*by).orderBy("place", F.col("i").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
        found = line.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("i IS NOT NULL")
    else:  # a few dozen marks, held against the scores where they lie
        asked = marks.select("i", "part", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("lo").alias("at")), F.struct(F.lit(1).alias("end"), F.col("hi").alias("at")))).alias("x")).select("i", "part", "x.end", "x.at")
        found = begins.join(F.broadcast(asked), F.col("place") <= F.col("at")).groupBy("i", "part", "end").agg(F.max_by("__v", "place").alias("__v"))
    ends = found.groupBy(*by, "i", "part").agg(F.max(F.when(F.col("end") == 0, F.col("__v"))).alias("a"), F.max(F.when(F.col("end") == 1, F.col("__v"))).alias("b"))
    return ends.select(*by, (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("threshold")).distinct()


def ltt_threshold(rows: DataFrame, alpha: float, delta: float, grid: DataFrame | None = None, by: list[str] | None = None, score: str = "score", y: str = "y", weight: str | None = None) -> DataFrame:
    """Learn-then-test by a fixed sequence of exact binomial tests, from strict to permissive thresholds.

    grid: by, threshold (default: the distinct calibration scores that answer
    enough rows). Leading points that answer too few rows to be rejected are
    passed over; the sequence ends at the first test that doesn't reject.
    """
    by = by or []
    least = min_certifiable_n(alpha, delta)
    if grid is None:
        points = risk_profile(rows, by, score, y, weight).where(F.col("n_answered") >= least).select(*by, "threshold", "n_answered", "n_errors")
    else:
        # running counts over scores and grid points together; a point counts equal scores
        n = F.lit(1).cast("long") if weight is None else F.col(weight)
        cal = rows.select(*by, F.col(score).alias("threshold"), n.alias("n"), ((1 - F.col(y)) * n).cast("long").alias("e"), F.lit(0).alias("point"))
        marks = grid.select(*by, "threshold", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("e"), F.lit(1).alias("point"))
        each = cal.unionByName(marks).groupBy(*by, "threshold").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.max("point").alias("point"))
        points = running(each, by, "threshold", {"n_answered": "n", "n_errors": "e"}, down=True).where("point = 1").select(*by, "threshold", "n_answered", "n_errors")
    total = points.groupBy(*by).agg(F.count("*").alias("n_points"))
    tested = settle(points.where(F.col("n_answered") >= least).withColumn("p", binom_cdf(F.col("n_errors"), F.col("n_answered"), alpha)))
    # the sequence ends at the strictest threshold whose test doesn't reject: of those above it the most permissive is best
    ends = tested.groupBy(*by).agg(F.count("*").alias("n_tested"), F.max(F.when(F.col("p") > delta, F.col("threshold"))).alias("end"))
    passed = meet(tested, ends, by).withColumn("passed", F.col("end").isNull() | (F.col("threshold") > F.col("end")))
    best = passed.groupBy(*by).agg(F.max("n_tested").alias("n_tested"), F.min_by(F.struct("threshold", "n_answered", "n_errors"), F.when(F.col("passed"), F.col("threshold"))).alias("b"))
    groups = _attach(_attach(_groups(rows, by, weight), total, by), best, by)
    none = F.col("b.threshold").isNull()
    reason = (
        F.when(~none, F.lit(None).cast("string"))
        .when(F.coalesce("n_points", F.lit(0)) == 0, F.format_string(f"%d items are fewer than the {least} that a guarantee takes", F.col("n_total")))
        .when(F.coalesce("n_tested", F.lit(0)) == 0, F.lit(f"no point of the grid answers {least} items"))
        .otherwise(F.lit("the strictest threshold that can be tested errs too often"))
    )
    return groups.select(
        *by,
        F.lit(alpha).alias("alpha"),
        F.coalesce("b.threshold", F.lit(NEVER)).alias("tau"),
        F.coalesce(F.col("b.n_answered") / F.col("n_total"), F.lit(0.0)).alias("cal_coverage"),
        (F.col("b.n_errors") / F.col("b.n_answered")).alias("cal_risk"),
        F.coalesce("b.n_answered", F.lit(0)).alias("n_answered"),
        reason.alias("reason"),
    )


def outcome(test: DataFrame, thresholds: DataFrame, by: list[str], score: str = "score", y: str = "y", weight: str | None = None) -> DataFrame:
    """Coverage and risk of thresholds on test rows: by, extra columns of thresholds, test_coverage, test_risk, abstain_all."""
    extra = [c for c in thresholds.columns if c not in by]
    held = [] if weight is None else [weight]
    joined = test.select(*by, *held, F.col(score).alias("__s"), F.col(y).alias("__y")).join(thresholds, by)
    yes = F.col("__s") >= F.col("tau")
    return joined.groupBy(*by, *extra).agg(mean_of(yes.cast("double"), weight).alias("test_coverage"), mean_of(F.when(yes, 1.0 - F.col("__y")), weight).alias("test_risk")).withColumn("abstain_all", F.col("tau") == NEVER)
