"""Every registered query of the engine against its SQL."""

import pytest

from conftest import SMALL, same_as_sql
from tessera.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    same_as_sql(spark, name, registry.queries(), registry.oracle_sql())


def test_every_query_has_sql_or_says_why():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    rows = registry.queries()[name](spark, SMALL).toPandas()
    assert len(rows) > 0
    if name == "chunk_documents":
        assert rows["exact"].all()
    if name == "reader_free_and_forced":
        assert rows.loc[~rows["forced"], "error"].isna().all()


def test_resampled_queries_run_all_splits_and_resamples(spark, monkeypatch):
    from tessera.operators import benchmark
    from tessera.plans import run_queries

    assert registry.queries()["stratified_splits"](spark, SMALL).select("split_id").distinct().count() == 200
    seen = {}
    whole = benchmark.bootstrap_auroc
    monkeypatch.setattr(run_queries.benchmark, "bootstrap_auroc", lambda *a, **k: seen.update(k) or whole(*a, **k))
    assert registry.queries()["bootstrap_auroc"](spark, SMALL).count() > 0
    assert seen.get("times", 1000) == 1000


def test_whether_results_hold_an_item_takes_no_table_of_all_that_do(spark, monkeypatch):
    from tessera.plans import retrieval_queries as rq

    docs = spark.createDataFrame([(1, "say a red fox ran"), (2, "say a red fox ran"), (3, "no such thing"), (4, None)], "pos long, text string")
    items = spark.createDataFrame([(10, "a red fox"), (11, "a red fox"), (12, "a blue fox"), (13, None), (14, "fox")], "query_id long, text string")
    results = spark.createDataFrame([(10, 2), (10, 3), (11, 1), (12, 1), (13, 1), (14, 4)], "query_id long, pos long")
    assert sorted(map(tuple, rq.held_among(results, docs, items).collect())) == [(10, 2), (11, 1)]
    asked, holding = [], rq.holding
    monkeypatch.setattr(rq, "holding", lambda d, i: asked.append(i.count()) or holding(d, i))
    assert sorted(r[0] for r in rq.held(docs, items).collect()) == [10, 11, 14] and asked == [4]
    monkeypatch.setattr(rq, "gold", lambda *a: pytest.fail("all pairs that hold were made"))
    assert registry.queries()["safe_to_answer"](spark, SMALL).count() > 0
