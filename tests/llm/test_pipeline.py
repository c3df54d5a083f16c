import hashlib
import sys
from pathlib import Path

import public_tokenizers as P
import pytest
import tiktoken

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from conftest import SMALL  # noqa: E402
from tessera.llm import bpe  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before the first stage and after each."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").cache()
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL).cache()
        out.append(docs.collect())
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "source_mixture", "encode"]


def test_language_stage(stages):
    before, after = {r["doc_id"]: r for r in stages[0]}, {r["doc_id"]: r for r in stages[1]}
    assert set(after) <= set(before) and len(after) > 0.97 * len(before)
    assert sum(after[d]["lang"] == before[d]["lang"] for d in after) > 0.97 * len(after)
    assert all(after[d]["text"] == before[d]["text"] for d in after)


def test_near_duplicate_stage(stages):
    found = brute.components([(r["doc_id"], r["text"]) for r in stages[1]], 8, 10, 5)
    assert sorted(r["doc_id"] for r in stages[2]) == sorted({c for _, c in found.values()})


def test_passage_stage(stages):
    want = brute.repeats([(r["doc_id"], r["text"]) for r in stages[2]])
    kept = {r["doc_id"]: hashlib.sha256(b" ".join(brute.words(r["text"]))).hexdigest() for r in stages[3]}
    assert kept == {d: h for d, (n, gone, h) in want.items() if n > gone}


def test_mixture_stage(stages):
    before = {r["doc_id"]: r for r in stages[3]}
    assert 0 < len(stages[4]) < len(before) and all(before[r["doc_id"]] == r for r in stages[4])


def test_encode_stage(stages):
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r["doc_id"]: r["text"] for r in stages[4]}
    assert len(stages[5]) == len(text)
    for r in stages[5]:
        assert r["ids"] == library.encode_ordinary(text[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_odd_rows_pass_through(spark):
    rows = [(1, "", "en", "s", 0), (2, None, None, None, None), (3, "The the the and of. " * 40, "en", "s", 1), (3, "The the the and of. " * 40, "en", "s", 1), (None, "Der die das und ist. " * 40, "de", "s", 1)]
    rows.append((4, " ".join(f"mot{i % 4999} de la" for i in range(100_000)), "fr", "s", 1))
    schema = "doc_id long, text string, lang string, source string, n_chars long, topic string, row int, cluster string, `__lang` string"
    docs = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL).cache()
        assert docs.count() > 0 and (name == "encode" or docs.columns == corpus_pipeline.COLUMNS)
        if name != "encode":  # columns that clash with a stage's own come back before the next
            docs = docs.selectExpr("*", "'x' AS topic", "1 AS row", "'y' AS cluster", "'z' AS `__lang`")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), SMALL).count() == 0


def test_language_stage_rejects_what_was_not_learned(spark):
    import random

    rng = random.Random(1)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*corpus_pipeline.COLUMNS)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(120))
    planted = [(-1, noise), (-2, "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw."), (-3, "Все люди рождаются свободными и равными в своем достоинстве"), (-4, "A."), (-5, "1234 --")]
    rows = spark.createDataFrame([(d, t, None, "p", len(t)) for d, t in planted], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.unionByName(rows), SMALL).select("doc_id").collect()}
    assert kept & {-1, -2, -3, -4, -5} == {-4}
    clean = {r["doc_id"] for r in docs.where(r"text rlike '\\p{L}'").collect()}
    assert len(clean & kept) >= 0.995 * len(clean)


def test_language_stage_without_labels(spark):
    from tessera.llm import langid

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    unlabelled = spark.createDataFrame([(1, "The the the and of.", None, "s", 1), (2, "der die das", None, "s", 1), (3, "12 -- 34", None, "s", 1), (4, None, None, "s", 1), (5, "", None, "s", 1), (None, "мир", None, "s", 1)], schema)
    kept = corpus_pipeline.language_id(spark, unlabelled, SMALL).collect()
    assert sorted((r["doc_id"] or 0, r["lang"]) for r in kept) == [(0, None), (1, None), (2, None)]
    own = spark.range(100).where(langid.fold("id") == 1).selectExpr("id AS doc_id", "'some words' AS text", "'en' AS lang", "'s' AS source", "10L AS n_chars")
    assert corpus_pipeline.language_id(spark, own, SMALL).where("lang = 'en'").count() == own.count() > 0
