import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import numeric
from tessera.operators import benchmark, calibrate, metrics, resample, thresholds


def rows(spark, scores, labels):
    return spark.createDataFrame([(i, float(s), int(y)) for i, (s, y) in enumerate(zip(scores, labels, strict=True))], "item long, score double, y int")


SCORES, LABELS = [0.9, 0.8, 0.8, 0.7, 0.6, 0.5], [1, 1, 0, 1, 0, 0]


def test_profile(spark):
    p = metrics.risk_profile(rows(spark, SCORES, LABELS)).orderBy(F.desc("threshold")).collect()
    assert [r["threshold"] for r in p] == [0.9, 0.8, 0.7, 0.6, 0.5]
    assert [r["n_answered"] for r in p] == [1, 3, 4, 5, 6] and [r["n_errors"] for r in p] == [0, 1, 1, 2, 3]


def test_erm(spark):
    r = thresholds.erm_threshold(rows(spark, SCORES, LABELS), 0.34).first()
    assert (r["tau"], r["n_answered"], r["cal_risk"]) == (0.7, 4, 0.25) and r["cal_coverage"] == pytest.approx(4 / 6)
    assert thresholds.erm_threshold(rows(spark, SCORES, LABELS), 0.5).first()["tau"] == 0.5
    assert thresholds.erm_threshold(rows(spark, [0.5], [0]), 0.1).first()["tau"] == float("inf")


def test_ltt(spark):
    ltt = lambda s, y, **k: thresholds.ltt_threshold(rows(spark, s, y), 0.1, 0.1, **k).first()
    assert ltt([0.9] * 25, [1] * 25)["tau"] == 0.9
    few = ltt([0.9] * 10, [1] * 10)
    assert few["tau"] == float("inf") and few["reason"] == "10 items are fewer than the 22 that a guarantee takes"
    assert ltt([0.9] * 25 + [0.5] * 10, [1] * 25 + [0] * 10)["tau"] == 0.9
    bad = ltt([0.9] * 25, [0] * 25)
    assert bad["reason"].startswith("the strictest threshold")
    grid = spark.createDataFrame([(2.0,)], "threshold double")
    assert ltt([0.9] * 25, [1] * 25, grid=grid)["reason"] == "no point of the grid answers 22 items"


def test_ltt_is_never_more_permissive(spark):
    rng = np.random.default_rng(0)
    data = pd.DataFrame({"g": np.repeat(np.arange(30), 60), "score": rng.random(1800).round(2)})
    data["y"] = (rng.random(1800) < 0.5 + 0.5 * data["score"]).astype(int)
    df = spark.createDataFrame(data)
    a = thresholds.erm_threshold(df, 0.2, ["g"]).select("g", F.col("tau").alias("e"))
    b = thresholds.ltt_threshold(df, 0.2, 0.1, by=["g"]).select("g", F.col("tau").alias("l"))
    assert a.join(b, "g").where("l < e").count() == 0


def test_coverage_grid(spark):
    train = spark.createDataFrame([(x / 100,) for x in range(101)], "score double")
    points = thresholds.coverage_grid(train, spark.createDataFrame([(100,)], "n_cal long"), 0.1, 0.1).orderBy(F.desc("threshold")).collect()
    assert points[0]["threshold"] == pytest.approx(0.78) and points[-1]["threshold"] == 0
    assert thresholds.coverage_grid(train, spark.createDataFrame([(10,)], "n_cal long"), 0.1, 0.1).count() == 0


def test_metrics_by_hand(spark):
    one = lambda df, c: df.first()[c]
    curve = metrics.risk_coverage(rows(spark, [0.9, 0.8, 0.3, 0.1], [1, 0, 1, 0])).orderBy("coverage").collect()
    assert [r["coverage"] for r in curve] == [0.25, 0.5, 0.75, 1] and [r["risk"] for r in curve] == pytest.approx([0, 0.5, 1 / 3, 0.5])
    assert one(metrics.oracle_aurc(rows(spark, [0] * 4, [1, 0, 1, 0])), "oracle_aurc") == pytest.approx((0 + 0 + 1 / 3 + 1 / 2) / 4)
    assert one(metrics.aurc(rows(spark, [0.5] * 4, [1, 0, 1, 0])), "aurc") == 0.5
    assert one(metrics.brier(rows(spark, [0.5, 0.5], [1, 0])), "brier") == 0.25
    assert one(metrics.ece(rows(spark, [0.75, 0.75], [1, 0])), "ece") == 0.25
    bins = {r["bin"]: r for r in metrics.reliability_bins(rows(spark, [0.05, 0.95, 1.0], [0, 1, 1])).collect()}
    assert bins[0]["n"] == 1 and bins[9]["n"] == 2 and bins[5]["n"] == 0 and bins[5]["confidence"] is None
    assert one(metrics.auroc(rows(spark, [0.9, 0.8, 0.1], [1, 1, 0])), "auroc") == 1
    assert one(metrics.auroc(rows(spark, [0.9, 0.2, 0.5], [1, 1, 0])), "auroc") == 0.5
    assert one(metrics.auroc(rows(spark, [0.9, 0.2], [1, 1])), "auroc") is None


def test_ranking(spark):
    ranked = spark.createDataFrame([(0, p, i) for i, p in enumerate([10, 1, 11, 2], 1)], "query_id long, pos long, rank int")
    gold = spark.createDataFrame([(0, 1), (0, 2)], "query_id long, pos long")
    v = {r["metric"]: r["value"] for r in metrics.ranking_scores(ranked, gold, [1, 2, 3, 5]).collect()}
    assert (v["hit@1"], v["hit@2"], v["mrr@5"], v["recall@3"], v["recall@5"]) == (0, 1, 0.5, 0.5, 1)


def test_calibrator_and_policy(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=200) > 0).astype(int)
    both = np.column_stack((x, np.ones(200)))
    m = calibrate.Calibrator.fit(both, y, ["a", "b", "c"])
    assert m.coef[0] > 0 > m.coef[1] and abs(m.coef[2]) < 1e-6
    policy = calibrate.Policy(m, float("inf"), {"method": "ltt", "alpha": 0.1, "delta": 0.1, "guarantee": "g"})
    back = calibrate.Policy.from_json(policy.to_json())
    assert back.tau == float("inf") and back.calibrator == m and back.summary()["tau"] == "inf"
    df = spark.createDataFrame(pd.DataFrame(both, columns=["a", "b", "c"]))
    assert back.decide(df).where("answer").count() == 0
    p = df.select(m.probability().alias("p")).toPandas()["p"].to_numpy()
    assert ((p > 0.5) == (y == 1)).mean() > 0.9
    assert len(df.select(m.signals(2).alias("s")).first()["s"]) == 2
    with pytest.raises(ValueError):
        calibrate.Calibrator.fit(both, np.ones(200), ["a", "b", "c"])


def dealt(spark, cats, n_splits, seed=0):
    return benchmark.stratified_splits(spark.createDataFrame(list(enumerate(cats)), "item long, category string"), n_splits, seed)


def test_splits(spark):
    cats = ["a"] * 50 + ["b"] * 20 + ["c"] * 29 + [None]
    first = dealt(spark, cats, 3, 7).toPandas()
    assert len(first) == 300 and not first.duplicated(["split_id", "item"]).any()
    for c, n in (("a", 50), ("b", 20), ("c", 29), (None, 1)):
        own = first[[cats[i] == c for i in first["item"]]]
        for _, part in own.groupby("split_id"):
            sizes = part["fold"].value_counts()
            assert [sizes.get(f, 0) for f in ("train", "cal", "test")] == numeric.allocate(n, [0.4, 0.3, 0.3])
    again = dealt(spark, cats, 3, 7).toPandas()
    key = ["split_id", "item"]
    assert (first.sort_values(key)["fold"].to_numpy() == again.sort_values(key)["fold"].to_numpy()).all()
    other = dealt(spark, cats, 3, 8).toPandas()
    assert (first.sort_values(key)["fold"].to_numpy() != other.sort_values(key)["fold"].to_numpy()).mean() > 0.3
    # every item is in the training fold of about its share of many splits
    many = dealt(spark, cats[:99], 400).where("fold = 'train'").groupBy("item").count().toPandas()["count"]
    assert abs(many.mean() / 400 - 0.4) < 0.01 and many.min() > 110 and many.max() < 210
    assert benchmark.stratified_splits(spark.createDataFrame([], "item long, category string"), 2).count() == 0


def test_models_of_many_groups_equal_newton_on_one_machine(spark):
    rng = np.random.default_rng(9)
    rows = pd.DataFrame({"g": rng.integers(0, 5, 600), "a": rng.normal(size=600), "b": rng.normal(2, 3, 600), "c": 1.0})
    rows["y"] = (rows["a"] - 0.2 * rows["b"] + rng.normal(size=600) > 0).astype(int)
    rows.loc[rows["g"] == 4, "y"] = 1  # one class: no model
    models = {"all": (["a", "b", "c"], 1.0), "b": (["b"], 1e-6), "none": (["c"], 1.0)}
    got = {(r["model"], r["g"]): r for r in calibrate.fit_models(spark.createDataFrame(rows), ["g"], models).collect()}
    assert set(got) == {(m, g) for m in models for g in range(4)}
    for (m, g), r in got.items():
        own = rows[rows["g"] == g]
        names, l2 = models[m]
        want = calibrate.Calibrator.fit(own[names].to_numpy(), own["y"].to_numpy(), names, l2)
        coef = dict(zip("abc", r["coef"], strict=True))
        assert [coef[n] for n in names] == pytest.approx(want.coef, abs=1e-7) and r["intercept"] == pytest.approx(want.intercept, abs=1e-7)
        assert all(coef[n] == 0 for n in "abc" if n not in names)
    alone = calibrate.fit_groups(spark.createDataFrame(rows[rows["g"] == 0]), [], ["a", "b"]).first()
    assert alone["coef"] == pytest.approx(got["all", 0]["coef"][:2], abs=1e-6)
    assert calibrate.fit_groups(spark.createDataFrame(rows[rows["g"] == 4]), ["g"], ["a"]).count() == 0
    # separable labels: the penalty keeps the weights finite
    apart = spark.createDataFrame([(1, float(i), int(i >= 20)) for i in range(40)], "g int, a double, y int")
    assert 1 < calibrate.fit_models(apart, ["g"], {"m": (["a"], 1e-6)}).first()["coef"][0] < 1e4


def test_benchmarks(spark):
    cats = ["a"] * 50 + ["b"] * 20 + ["c"] * 30
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 100)
    items = pd.DataFrame({"item": range(100), "category": cats, "y": y, "dense_top1": y + rng.normal(0, 0.7, 100), "rrf_top1": rng.normal(0, 1, 100)})
    tables = benchmark.abstention_benchmark(spark.createDataFrame(items), dealt(spark, cats, 5), ["dense_top1", "rrf_top1"])
    m = {(r["model"], r["metric"]): r["mean"] for r in tables["metrics"].collect()}
    assert m["combined", "auroc"] > 0.7 > m["platt_rrf_top1", "auroc"] and m["combined", "eaurc"] >= 0
    t = tables["thresholds"].collect()
    assert len(t) == 3 * 3 * 2 and all(0 <= r["violation_rate"] <= 1 for r in t)
    policy = benchmark.fit_policy(spark.createDataFrame(items), ["dense_top1", "rrf_top1"], "ltt", 0.4, 0.1)
    assert policy.meta["guarantee"] == "P(risk <= 0.4) >= 0.9"


def test_end_to_end_tables(spark):
    rng = np.random.default_rng(4)
    cats = ["a"] * 60 + ["b"] * 40
    out = []
    for reader in ("free", "forced"):
        for i in range(100):
            ok = cats[i] == "a"
            good = bool(ok and rng.random() < 0.8)
            out.append((i, reader, cats[i], ok, reader == "forced" or bool(rng.random() < 0.7), good, float(good), float(good) + rng.normal(0, 0.3)))
    items = spark.createDataFrame(out, "item long, reader string, category string, answerable boolean, answered boolean, correct boolean, f1 double, dense_top1 double")
    t = benchmark.e2e_benchmark(items, dealt(spark, cats, 4), ["dense_top1"], (0.2, 0.3))
    s = {(r["system"], r["metric"]): r["mean"] for r in t["systems"].collect()}
    assert s["standard", "coverage"] == 1 and s["selective[erm,alpha=0.3]", "selective_risk"] < s["standard", "selective_risk"]
    assert t["by_category"].count() == 4 and t["catches"].where("catch_rate between 0 and 1").count() > 0
    assert t["rates"].where("violation_rate IS NULL AND system LIKE 'selective%'").count() == 0 and t["deltas"].count() > 0


def test_bootstrap(spark):
    v = spark.createDataFrame([("m", i, float(i % 2)) for i in range(200)], "metric string, item long, value double")
    r = benchmark.bootstrap_mean(v, ["metric"]).first()
    assert r["mean"] == 0.5 and 0.4 < r["lo"] < 0.5 < r["hi"] < 0.6
    p = spark.createDataFrame([("m", i, 0.0, 1.0) for i in range(20)], "metric string, item long, a double, b double")
    assert benchmark.paired_bootstrap(p, ["metric"]).first()["significant"]
    a = spark.createDataFrame([("m", i, i % 2, float(i % 2) + 0.1 * (i % 5), 0.0) for i in range(60)], "metric string, item long, y int, s double, t double")
    out = {r["name"]: r["auroc"] for r in benchmark.bootstrap_auroc(a, ["metric"], ["s", "t"], times=50).collect()}
    assert out["s"] == 1 and out["t"] == 0.5 and out["delta"] == -0.5


def test_resamples_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK", 40)
    rows = spark.range(3000).select((F.col("id") % 2).alias("g"), F.col("id").alias("item"), (F.col("id") % 10).cast("double").alias("value"))
    placed, blocks = resample._blocks(rows, ["g"], "item")
    assert blocks.count() > 60 and blocks.agg(F.max("rows")).first()[0] < 100
    n = resample.resample_counts(rows, ["g"], times=60, seed=5).toPandas()
    assert (n.groupby(["g", "resample"])["n"].sum() == 1500).all() and n["n"].min() == 1
    per = n.groupby("item")["n"].sum()
    assert len(per) == 3000 and abs(per.mean() - 60) < 1e-9 and 50 < per.var() < 70  # a count is binomial with mean 1
    share = n.groupby("resample").size() / 3000
    assert abs(share.mean() - (1 - np.exp(-1))) < 0.01
    again = resample.resample_counts(rows.repartition(7), ["g"], times=60, seed=5).toPandas()
    key = ["g", "item", "resample"]
    assert n.sort_values(key)["n"].tolist() == again.sort_values(key)["n"].tolist()
    got = resample.bootstrap_mean(rows, ["g"]).collect()
    for r in got:
        width = 1.96 * np.sqrt(8.0 / 1500)  # even or odd digits: variance 8
        assert abs(r["hi"] - r["mean"] - width) < 0.2 * width and abs(r["mean"] - r["lo"] - width) < 0.2 * width
    one = resample.bootstrap_mean(rows.drop("g"), [], times=200).first()
    assert one["mean"] == 4.5 and one["lo"] < 4.5 < one["hi"]


def test_resamples_with_nulls_and_empty_groups(spark):
    v = spark.createDataFrame([("a", 1, None), ("b", 1, 2.0), ("b", 2, None), (None, 1, 3.0)], "g string, item long, value double")
    got = {r["g"]: (r["mean"], r["lo"], r["hi"]) for r in resample.bootstrap_mean(v, ["g"], times=20).collect()}
    assert got["a"] == (None, None, None) and got["b"] == (2.0, 2.0, 2.0) and got[None] == (3.0, 3.0, 3.0)
    a = spark.createDataFrame([("x", 1, 1, 0.5), ("x", 2, 1, 0.7)], "g string, item long, y int, s double")
    r = resample.bootstrap_auroc(a, ["g"], ["s"], times=20).first()
    assert (r["auroc"], r["lo"], r["hi"]) == (None, None, None)
    assert resample.bootstrap_mean(v.limit(0), ["g"]).count() == 0


def test_running_sums_without_groups(spark):
    """Dealt by range over many partitions, equal to one sum from the top."""
    rows = spark.range(500).select((F.pmod(F.xxhash64("id"), F.lit(1000003)) / 7).alias("k"), (F.col("id") % 5).alias("n"))
    for down in (True, False):
        got = {r["k"]: r["total"] for r in metrics.running(rows, [], "k", {"total": "n"}, down).collect()}
        total, want = 0, {}
        for r in sorted(rows.collect(), key=lambda r: -r["k"] if down else r["k"]):
            total += r["n"]
            want[r["k"]] = total
        assert got == want
    assert metrics.running(rows.limit(0), [], "k", {"total": "n"}).count() == 0


def test_grid_quantiles_with_and_without_groups(spark):
    import numpy as np

    values = [((i * 37) % 101) / 10 for i in range(60)] + [3.0] * 20
    train = spark.createDataFrame([("a", v) for v in values] + [("b", v * 2) for v in values[:30]], "g string, score double")
    sizes = spark.createDataFrame([("a", 80), ("b", 30)], "g string, n_cal long")
    got = {}
    for r in thresholds.coverage_grid(train, sizes, 0.1, 0.1, ["g"]).collect():
        got.setdefault(r["g"], []).append(r["threshold"])
    for g, n in (("a", 80), ("b", 30)):
        scores = np.array([r["score"] for r in train.where(f"g = '{g}'").collect()])
        want = sorted({round(float(x), 9) for x in np.quantile(scores, 1 - np.linspace(22 / n, 1, 50))})
        assert sorted({round(x, 9) for x in got[g]}) == pytest.approx(want)
    alone = thresholds.coverage_grid(train.where("g = 'a'").drop("g"), spark.createDataFrame([(80,)], "n_cal long"), 0.1, 0.1)
    assert sorted(r["threshold"] for r in alone.collect()) == pytest.approx(sorted(got["a"]))


def test_labels_meet_documents_without_the_driver(spark):
    from conftest import SMALL
    from tessera.plans.calibration_queries import scored

    assert "Broadcast" not in scored(spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_like_items_are_counted_once_through_all_splits(spark):
    """Folds equal those of a sort of every split, and cells of like items hold all rows of them."""
    items = spark.range(900).select(F.col("id").alias("item"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("category"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 4 / 4.0).alias("rrf_top1"))
    got = benchmark.cells(items, benchmark.dealing(3, 5), ["y", "rrf_top1"])
    place = F.row_number().over(Window.partitionBy("split_id", "category").orderBy(F.md5(F.concat_ws("/", F.lit("5"), F.col("split_id").cast("string"), F.col("item").cast("string"))), "item"))
    n = F.when(F.col("category") == "a", 300).otherwise(600)
    fold = F.when(F.col("place") <= 0.4 * n, "train").when(F.col("place") <= 0.7 * n, "cal").otherwise("test")
    want = items.crossJoin(spark.range(3).select(F.col("id").cast("int").alias("split_id"))).withColumn("place", place).withColumn("fold", fold)
    rows = lambda df: sorted(map(tuple, df.select("split_id", "fold", "y", "rrf_top1", "n").collect()))
    assert rows(got) == rows(want.groupBy("split_id", "fold", "y", "rrf_top1").agg(F.count("*").alias("n")))


def test_split_rates_count_like_rows_once(spark, monkeypatch):
    from conftest import SMALL
    from tessera.plans import more_queries, registry

    seen = []
    whole = more_queries.settle
    monkeypatch.setattr(more_queries, "settle", lambda df: seen.append(whole(df)) or seen[-1])
    assert registry.queries()["split_rates"](spark, SMALL).count() == 2
    (counted,) = seen
    labels = more_queries.scored(spark, SMALL).count()
    assert counted.count() == counted.drop("n").distinct().count() and counted.agg(F.sum("n")).first()[0] == 200 * labels
