"""Fixed examples of facts, answers, replies and refusals, and small files there and back."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from tessera.functions import text as tx
from tessera.functions.text import ABSTENTION
from tessera.operators import asked, calibrate, chunks, evalset, metrics, reader, retrieval, thresholds
from tessera.plans.calibration_queries import scored
from tessera.plans.retrieval_queries import corpus, questions
from tessera.sources import store

FACTS_OF = [
    ("LakeNet (7.25 of 9, by 1.5 pts@3) at NASA", ["7.25", "9", "1.5", "LakeNet", "pts@3", "NASA"]),
    ("no facts in here", []),
    ("a slope of 3e-4 and 12%, twice 12%", ["3e-4", "12%"]),
    ("x86 and v2.1 stay words; 2.1 doesn't", ["2.1"]),
    ("", []),
]
ANSWERS = [("12.5 km", "12.5 km", True), ("12.6 km", "12.5 km", False), ("the wall of 12.5 km", "12.5 km wall", True), ("it spans 12.5 km from the mill to the far lake", "12.5 km wall", False), ("", "", True), ("wall", "", False)]
CONTEXT = [
    ("p::0000", "We take Zephyr as the name of the older turbine. It has 14 wooden blades."),
    ("p::0001", "We drain the basin for 6 weeks with a slope of 3e-4. Early frost is likely."),
    ("p::0002", "The new pump lifts 52.7 tonnes in Marlhaven. The old pump lifts 31.9 tonnes."),
]
READ = [
    ("For how many weeks is the basin drained?", "the basin for 6 weeks with", False, ["p::0001"], None),
    ("Which name has the older turbine?", "Zephyr", False, ["p::0000"], None),
    ("How many tonnes does the new pump lift in Marlhaven?", "new pump lifts 52.7 tonnes in", False, ["p::0002"], None),
    ("Who painted the ceiling of a chapel?", ABSTENTION, True, [], "low_support(coverage=0.00)"),
    ("  ", ABSTENTION, True, [], "no_context"),
]
REPLIES = [('Sure: {"answer": "a", "n": 1} and {"answer": "b"}', "a"), ('[1, 2] {"broken": {"answer": "c"}}', None), ('{"x": } {"answer": "d"}', "d")]
SCHEMAS = [
    ("judgement", '{"answerable": true, "chunk_id": null}', True),
    ("judgement", '{"answerable": "yes"}', False),
    ("factoid", '{"question": "q", "answer": "a", "evidence_quote": "e"}', True),
    ("factoid", '{"question": "q"}', False),
    ("reasoning", '{"question": "q", "answer": "a", "evidence_quotes": ["x", "y"]}', True),
    ("reasoning", '{"question": "q", "answer": "a", "evidence_quotes": "x"}', False),
    ("question", "no object", False),
]


def test_key_facts_and_correctness(spark):
    rows = spark.createDataFrame([(t,) for t, _ in FACTS_OF], "t string").select(tx.key_facts(F.col("t")).alias("f")).collect()
    assert [r["f"] for r in rows] == [f for _, f in FACTS_OF]
    rows = spark.createDataFrame([a[:2] for a in ANSWERS], "p string, r string").select(tx.is_correct(F.col("p"), F.col("r")).alias("ok")).collect()
    assert [r["ok"] for r in rows] == [a[2] for a in ANSWERS]


def test_reader_on_a_fixed_context(spark):
    q = spark.createDataFrame([(i, r[0]) for i, r in enumerate(READ)], "query_id long, text string")
    context = spark.createDataFrame([(i, c, n, t) for i in range(len(READ)) for n, (c, t) in enumerate(CONTEXT, 1)], "query_id long, chunk_id string, rank int, text string")
    got = {r["query_id"]: (r["answer"], r["abstain"], r["citations"], r["reason"]) for r in reader.extractive(context, q).collect()}
    assert got == {i: r[1:] for i, r in enumerate(READ)}
    forced = {r["query_id"]: (r["abstain"], r["grounded"]) for r in reader.extractive(context, q, forced=True).collect()}
    assert forced == {i: (False, i < 4) for i in range(len(READ))}


def test_replies_and_schemas():
    assert [reader.first_json(t).get("answer") for t, _ in REPLIES] == [a for _, a in REPLIES]
    with pytest.raises(ValueError):
        reader.first_json("none at all")
    for kind, reply, sound in SCHEMAS:
        if sound:
            assert asked.parsed(reply, kind)
        else:
            with pytest.raises(ValueError):
                asked.parsed(reply, kind)


def test_files_there_and_back(spark, tmp_path):
    base = f"file://{tmp_path}"
    model = calibrate.Calibrator(["a"], 1.0, [0.5], [2.0], [-1.25], 0.125)
    policy = calibrate.Policy(model, float("inf"), {"method": "ltt", "alpha": 0.2, "delta": 0.1, "guarantee": "g", "cal_risk": float("nan")})
    store.save_policy(spark, policy, f"{base}/policy.json")
    back = store.load_policy(spark, f"{base}/policy.json")
    assert back.to_json() == policy.to_json() and back.tau == float("inf") and back.calibrator == model
    assert back.summary() == {"method": "ltt", "alpha": 0.2, "delta": 0.1, "tau": "inf", "guarantee": "g"}
    assert calibrate.Policy(model, 0.5, {"method": "erm", "guarantee": "g"}).summary()["guarantee"] is None
    items = evalset.EvalSet([{"id": "eval_001", "question": "qé", "is_answerable": False}], "g", 1, {"path": "p"}, {"out_of_domain": 1})
    store.write_text(spark, items.to_json(), f"{base}/set.json")
    text = store.read_text(spark, f"{base}/set.json")
    assert evalset.EvalSet.from_json(text) == items and text.strip() == items.to_json().strip()
    store.write_report(spark, {"t": [{"x": float("-inf"), "y": float("nan"), "z": "a|b"}]}, f"{base}/report", "R")
    assert json.loads(store.read_text(spark, f"{base}/report.json")) == {"t": [{"x": "-inf", "y": None, "z": "a|b"}]} and "a\\|b" in store.read_text(spark, f"{base}/report.md")


def test_vectors_are_held_against_what_was_written(spark, tmp_path):
    vectors = spark.createDataFrame([(1, [0.5, -2.0]), (2, []), (3, [1.0, 2.0])], "pos long, vec array<float>")
    path = f"file://{tmp_path}/vectors"
    store.write_vectors(vectors, path)
    assert sorted(map(tuple, store.read_vectors(spark, path, dims=2, count=3).collect())) == sorted(map(tuple, vectors.collect()))
    for expected in ({"dims": 3}, {"count": 2}):
        with pytest.raises(ValueError):
            store.read_vectors(spark, path, **expected)
    vectors.where("pos < 3").write.mode("overwrite").parquet(path)  # rows lost behind the index's back
    with pytest.raises(ValueError, match="2 vectors, not 3"):
        store.read_vectors(spark, path)
    with pytest.raises(ValueError, match="dimensions"):
        store.write_vectors(spark.createDataFrame([(1, [0.5]), (2, [1.0, 2.0])], "pos long, vec array<float>"), path)
    store.write_vectors(vectors.limit(0), path)
    assert store.read_vectors(spark, path).count() == 0


def test_arguments_that_are_refused(spark):
    c, q = corpus(spark, SMALL), questions(spark, SMALL)
    ranked = spark.createDataFrame([], "query_id long, pos long, rank int, score double")
    for call in (
        lambda: thresholds.ltt_threshold(scored(spark, SMALL), 1.0, 0.1, by=["lang"]),
        lambda: retrieval.bm25_search(None, q, 0),
        lambda: retrieval.fuse([ranked], weights=[-1.0]),
        lambda: metrics.ranking_scores(ranked, ranked, []),
        lambda: chunks.check(10, 10),
        lambda: retrieval.hybrid_search(c, q, 0),
        lambda: retrieval.hybrid_search(c, q, 5, "other"),
        lambda: retrieval.fuse([ranked, ranked], weights=[1.0]),
    ):
        with pytest.raises(ValueError):
            call()
