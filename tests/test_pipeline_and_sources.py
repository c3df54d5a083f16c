import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from tessera import cli, server
from tessera.functions.text import ABSTENTION
from tessera.operators import chunks, evalset
from tessera.operators.calibrate import Calibrator, Policy
from tessera.operators.features import FEATURES
from tessera.plans import pipeline
from tessera.sources import documents, store
from tessera.streaming import jobs

DOCS = [
    (1, "Filling", "We took Granitex as the core filling. It weighs 125 million kilograms in total here."),
    (2, "Camp", "The crew was camped for 10 weeks with a water ration of 0.5 in all of our trips."),
    (3, "Results", "The final barrier holds 52.7 flood points at Marlhaven after the longest winter storm. The earlier barrier holds 31.9 flood points at Marlhaven after the same winter storm."),
    (4, "Other", "Weather reports mention rain and wind along the coast for several days."),
]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, title string, text string")
    return chunks.with_pos(chunks.chunk_texts(docs)).persist()


def questions(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def policy(tau):
    n = len(FEATURES)
    return Policy(Calibrator(list(FEATURES), 1.0, [0.0] * n, [1.0] * n, [1.0] + [0.0] * (n - 1), 0.0), tau, {"method": "erm", "alpha": 0.2})


def test_answers(spark, corpus):
    q = questions(spark, "For how many weeks was the crew camped?", " ")
    rows = {r["query_id"]: r for r in pipeline.answer(corpus, q).collect()}
    assert "10 weeks" in rows[0]["answer"] and rows[0]["stage"] is None and rows[0]["citations"] == ["2::0000"]
    assert rows[1]["stage"] == "policy" and rows[1]["answer"] == ABSTENTION
    held = {r["query_id"]: r for r in pipeline.answer(corpus, q, policy(float("inf"))).collect()}
    assert all(r["stage"] == "policy" for r in held.values())
    assert pipeline.answer(corpus, q, policy(-1.0)).where("NOT abstained").count() == 1


def test_gate_stands_below_the_reader(spark, corpus):
    def read(context, asked, forced=False):
        raise_on = F.raise_error(F.lit("the reader was called"))
        return asked.select("query_id", raise_on.cast("string").alias("answer"), F.lit(False).alias("abstain"), F.array().cast("array<string>").alias("citations"), F.array().cast("array<string>").alias("evidence_quotes"), F.lit(True).alias("grounded"), F.lit(None).cast("string").alias("reason"))

    assert pipeline.answer(corpus, questions(spark, "weeks"), policy(float("inf")), read=read).count() == 1
    with pytest.raises(Exception, match="the reader was called"):
        pipeline.answer(corpus, questions(spark, "weeks"), policy(-1.0), read=read).collect()


def test_score_items(spark, corpus):
    items = spark.createDataFrame([(0, "For how many weeks was the crew camped?", "10 weeks", True, "in_domain_factoid", ["2::0000"]), (1, "Who rules Atlantis?", ABSTENTION, False, "out_of_domain", [])], "query_id long, text string, reference string, answerable boolean, category string, gold array<string>")
    rows = {(r["item"], r["reader"]): r for r in pipeline.score_items(corpus, items).collect()}
    assert rows[0, "free"]["answered"] and rows[0, "free"]["citation_precision"] == 1 and not rows[1, "free"]["answered"]
    assert rows[1, "forced"]["answered"] and not rows[1, "forced"]["correct"]


def test_manifest(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    assert store.read_manifest(spark, path).count() == 0
    (tmp_path / "one.jsonl").write_text('{"arxiv_id": "a/1", "title": "Old"}\n\n{"arxiv_id": "b", "title": "Bé"}\n{"arxiv_id": "a/1", "title": "New"}\n')
    old = store.read_manifest(spark, f"file://{tmp_path}/one.jsonl")
    assert {r["arxiv_id"]: r["title"] for r in old.collect()} == {"a/1": "New", "b": "Bé"}
    new = spark.createDataFrame([("b", "Newer"), ("c", "C")], "arxiv_id string, title string")
    store.merge_manifest(old, new, path)
    assert {r["arxiv_id"]: r["title"] for r in store.read_manifest(spark, path).collect()} == {"a/1": "New", "b": "Newer", "c": "C"}
    assert [r[0] for r in store.pending(new, old).select("arxiv_id").collect()] == ["c"]


def test_chunks_round_trip(spark, corpus, tmp_path):
    store.write_chunks(corpus, f"file://{tmp_path}/c")
    back = store.read_chunks(spark, f"file://{tmp_path}/c")
    assert sorted(r["text"] for r in back.collect()) == sorted(r["text"] for r in corpus.collect())


def test_retriever_store_tokenises_once(spark, corpus, tmp_path, monkeypatch):
    """vectors, postings and lengths come from one tokenised table, and are those of the plain ways."""
    from tessera.operators import retrieval

    plain = retrieval.bm25_index(corpus.select("pos", "text"), 1.2, 0.5)
    rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    want = [rows(df) for df in (plain.postings, plain.vocabulary, plain.lengths, retrieval.hashed_bags(corpus, "pos"))]
    monkeypatch.setattr(retrieval, "term_frequencies", None)
    monkeypatch.setattr(retrieval, "hashed_bags", None)
    path = f"file://{tmp_path}/once"
    store.save_retriever(corpus, path, store.RetrieverConfig(k1=1.2, b=0.5))
    _, index, _ = store.load_retriever(spark, path)
    assert [rows(df) for df in (index.postings, index.vocabulary, index.lengths, spark.read.parquet(f"{path}/vectors"))] == want


def test_retriever_store(spark, corpus, tmp_path):
    path = f"file://{tmp_path}/r"
    store.save_retriever(corpus, path)
    rows, index, config = store.load_retriever(spark, path)
    assert config.num_chunks == rows.count() and index.postings.count() > 0
    with pytest.warns(UserWarning):
        store.load_retriever(spark, path, "other")
    rows.limit(1).write.mode("overwrite").parquet(f"file://{tmp_path}/short")
    with pytest.raises(ValueError, match="duplicate"):
        store.save_retriever(corpus.union(corpus), path + "2")


def test_scan_files(spark, tmp_path):
    (tmp_path / "a_1.pdf").write_bytes("Page one\fPage two".encode())
    (tmp_path / "b.pdf").write_bytes(b"\xff\xfe")
    (tmp_path / "c.pdf").write_bytes(b" \f ")
    manifest = spark.createDataFrame([("a/1", "Known")], "arxiv_id string, title string")
    rows = {r["file"]: r for r in documents.scan_files(spark, f"file://{tmp_path}", manifest).collect()}
    assert rows["a_1.pdf"]["doc_id"] == "a/1" and rows["a_1.pdf"]["pages"] == ["Page one", "Page two"]
    assert rows["b.pdf"]["problem"].startswith("cannot read") and rows["c.pdf"]["problem"] == "no extractable text"


def test_fetch(spark, tmp_path):
    (tmp_path / "have.pdf").write_bytes(b"%PDF-old")
    wanted = spark.createDataFrame([("have", "u"), ("good", "ok"), ("bad", "html")], "arxiv_id string, url string")
    get = lambda url: b"%PDF-1" if url == "ok" else b"<html>"
    rows = {r["arxiv_id"]: r for r in documents.fetch(wanted, str(tmp_path), get, delay=0).collect()}
    assert rows["good"]["pdf_path"] and rows["bad"]["problem"].startswith("ValueError") and rows["have"]["problem"] is None
    assert (tmp_path / "have.pdf").read_bytes() == b"%PDF-old" and not list(tmp_path.glob("*.part"))


def test_catalogue(spark):
    documents.register(spark)
    with pytest.raises(Exception, match="client"):
        spark.read.format("paper_catalogue").option("query", "x").load().collect()
    with pytest.raises(Exception, match="sort_by"):
        spark.read.format("paper_catalogue").option("sort_by", "other").load().collect()


def test_report(spark, tmp_path):
    store.write_report(spark, {"rows": [{"a": float("nan"), "b": float("inf"), "c": "x|y"}]}, f"file://{tmp_path}/rep", "R")
    assert json.loads(store.read_text(spark, f"file://{tmp_path}/rep.json")) == {"rows": [{"a": None, "b": "inf", "c": "x|y"}]}
    assert "x\\|y" in store.read_text(spark, f"file://{tmp_path}/rep.md")


def test_eval_set(spark, corpus):
    drafts = evalset.extractive_items(corpus, {"in_domain_factoid": 3, "in_domain_reasoning": 1, "out_of_domain": 2, "unsupported_fact": 2, "subtle_conflict": 2}, 1)
    made = evalset.assemble(drafts, {"path": "p", "num_chunks": 4, "sha256": "0"}, "extractive", 1)
    made.check(spark)
    assert made.counts["in_domain_factoid"] == 3 and made.counts["out_of_domain"] == 2 and made.counts["in_domain_reasoning"] == 1
    again = evalset.assemble(evalset.extractive_items(corpus, {c: made.counts[c] for c in evalset.CATEGORIES}, 1), made.corpus, "extractive", 1)
    assert evalset.EvalSet.from_json(made.to_json()) == made == again
    assert evalset.missing_chunks(made.frame(spark), corpus).count() == 0
    made.items[0]["question"] = " "
    with pytest.raises(ValueError, match="blank"):
        made.check(spark)


def test_streams(spark, corpus, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"doc_id": 1, "text": "x"}\n{"doc_id": 1, "text": "y"}\n{"doc_id": 2, "text": "z"}\n')
    jobs.drain(jobs.new_documents(spark, f"file://{tmp_path}/in", "doc_id long, text string"), "append", f"file://{tmp_path}/ck", f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 2
    (tmp_path / "q").mkdir()
    (tmp_path / "q/a.json").write_text('{"query_id": 1, "text": "how many weeks"}\n')
    stream = spark.readStream.schema("query_id long, text string").json(f"file://{tmp_path}/q")
    query = jobs.answer_stream(stream, corpus, lambda: None, f"file://{tmp_path}/ans", f"file://{tmp_path}/ck2")
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(f"file://{tmp_path}/ans").count() == 1


def call(port, path, body=None, token=None):
    request = urllib.request.Request(f"http://127.0.0.1:{port}{path}", None if body is None else json.dumps(body).encode(), {"Authorization": f"Bearer {token}"} if token else {})
    try:
        with urllib.request.urlopen(request, timeout=120) as r:
            return r.status, json.loads(r.read())
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def test_service(spark, corpus):
    service = server.Service(corpus, policy(-1.0), lambda **kw: policy(float("inf")), server.Settings(token="t"))
    http = server.serve(service, port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    port = http.server_address[1]
    try:
        assert call(port, "/health") == (200, {"status": "ok"})
        status, out = call(port, "/v1/query", {"query": "how many weeks was the crew camped", "include_scores": True})
        assert status == 200 and not out["abstained"] and set(FEATURES) <= set(out["features"])
        for body in ({"query": " "}, {"query": "x" * 2001}, {"query": "x", "k_ctx": 0}, {"query": "x", "k_ctx": 11}, {"query": "x", "top_k": 51}, {"query": "x", "other": 1}, {}):
            assert call(port, "/v1/query", body)[0] == 422
        assert call(port, "/v1/calibrate", {})[0] == 401 and call(port, "/nope")[0] == 404
        assert call(port, "/v1/calibrate", {"method": "ltt"}, "t")[1]["tau"] == "inf"
        assert call(port, "/v1/query", {"query": "how many weeks"})[1]["stage"] == "policy"
        service._busy.acquire()
        assert call(port, "/v1/calibrate", {}, "t")[0] == 409
    finally:
        http.shutdown()


def test_command_line(spark, corpus, tmp_path, capsys):
    corpus.write.parquet(f"{tmp_path}/chunks")
    args = cli.parser().parse_args(["ask", f"{tmp_path}/chunks", "For how many weeks was the crew camped?", "--no-gate", "--json"])
    args.run(args, spark)
    assert "10 weeks" in json.loads(capsys.readouterr().out)["answer"]
    args = cli.parser().parse_args(["chat", f"{tmp_path}/chunks", "--no-gate"])
    cli.chat(args, spark, [":k 2", ":scores", ":help", "For how many weeks was the crew camped?", ":quit", "never"])
    out = capsys.readouterr().out
    assert "10 weeks" in out and "ce_top1" in out
    args = cli.parser().parse_args(["index", f"{tmp_path}/chunks", f"{tmp_path}/index"])
    args.run(args, spark)
    args = cli.parser().parse_args(["generate", f"{tmp_path}/chunks", f"{tmp_path}/set", "--in-domain-factoid", "3", "--in-domain-reasoning", "1", "--out-of-domain", "2", "--unsupported-fact", "2", "--subtle-conflict", "2"])
    args.run(args, spark)
    args = cli.parser().parse_args(["evaluate", "retrieval", f"{tmp_path}/chunks", f"{tmp_path}/set", f"{tmp_path}/report"])
    args.run(args, spark)
    assert "hit@1" in store.read_text(spark, f"{tmp_path}/report.md")
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["ask", "c", "q", "--policy", "p", "--no-gate"])


def test_entry_without_the_llm_package():
    """The driver deletes that package: everything else must still import."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys, importlib.abc\nclass Gone(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path=None, target=None):\n        if name.startswith('tessera.llm') or name == 'corpus_pipeline':\n            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\nsys.meta_path.insert(0, Gone())\nimport __spark_entry__ as e\nassert len(e.queries()) > 50 and not any(q.startswith('op') and q[2:3].isdigit() for q in e.queries())\n"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])


def test_command_line_of_made_up_reports(spark, tmp_path, capsys):
    """Reports and their questions, a gate that is kept, cached answers, few quotes, forced and offline reading."""
    run = lambda *words: (a := cli.parser().parse_args([str(w) for w in words])).run(a, spark)
    place = lambda name: f"{tmp_path}/{name}"
    counts = ["--in-domain-factoid", 30, "--in-domain-reasoning", 4, "--out-of-domain", 4, "--unsupported-fact", 4, "--subtle-conflict", 4]
    run("generate", place("chunks"), place("set"), "--engine", "facts", "--reports", 5, *counts)
    found, items = cli.load_items(spark, place("set"))
    assert found.generator == "facts" and items.count() == 46 and {"in_domain_reasoning", "subtle_conflict"} <= set(found.counts)
    capsys.readouterr()
    question = items.where("category = 'in_domain_factoid'").first()["text"]
    run("ask", place("chunks"), question, "--calibrate", "erm", "--alpha", 0.9, "--eval-set", place("set"), "--save-policy", place("gate"), "--json", "--offline")
    first = json.loads(capsys.readouterr().out)
    assert store.load_policy(spark, place("gate")).summary()["alpha"] == 0.9
    for _ in range(2):  # the second answer is the cached one
        run("ask", place("chunks"), question, "--policy", place("gate"), "--cache", place("cache"), "--json")
        assert json.loads(capsys.readouterr().out)["answer"] == first["answer"]
    assert spark.read.parquet(place("cache/answers/*")).count() == 1
    run("ask", place("chunks"), "Who sang in the choir?", "--no-gate", "--forced-reader", "--show", 0)
    assert "  none" in capsys.readouterr().out
    with pytest.raises(SystemExit, match="fallback"):
        run("ask", place("chunks"), question, "--no-gate", "--reranker", "some/model")
    with pytest.raises(SystemExit, match="reader-url"):
        run("generate", place("chunks"), place("other"), "--engine", "written")
