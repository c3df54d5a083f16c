import json
import threading
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.text import ABSTENTION
from tessera.operators import asked, chunks, evalset, factbase, features, models, reader, rerank, retrieval
from tessera.sources import figures

DOCS = [(1, "The heron waits by the weir at dawn"), (2, "Trams cross the old bridge at noon"), (3, "A weir keeps the mill pond full"), (4, None)]
ASKED = [(10, "heron weir"), (11, "bridge trams"), (12, " ")]


class Letters:
    """Counts of letters as a vector: an encoder with nothing to load."""

    name = "letters"

    def encode(self, texts, asking=False):
        return np.array([[t.lower().count(c) + 0.01 for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts])


class Shared:
    name = "shared-words"

    def score(self, pairs):
        return np.array([len(set(q.split()) & set(p.lower().split())) for q, p in pairs], float)


class Broken:
    name = "broken"

    def score(self, pairs):
        raise OSError("no weights")


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(DOCS, "pos long, text string"), spark.createDataFrame(ASKED, "query_id long, text string")


def test_an_encoder_takes_the_dense_place(spark, tables):
    corpus, queries = tables
    got = models.Embedded(Letters()).search(corpus, queries, 2).collect()
    unit = lambda t: (v := Letters().encode([t])[0]) / np.linalg.norm(v)
    for q, text in ASKED[:2]:
        scores = sorted(((-round(float(unit(text) @ unit(t or "")), 9), p) for p, t in DOCS))[:2]
        assert [(r["pos"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [(p, i) for i, (_, p) in enumerate(scores, 1)]
    assert {r["query_id"] for r in got} == {10, 11}
    fused = retrieval.hybrid_search(corpus, queries, 3, dense=models.Embedded(Letters()).search).where("query_id = 10 AND rank = 1").first()
    assert fused["pos"] in (1, 3) and fused["dense_rank"] is not None
    assert models.search_with(corpus, "dense", encoder=Letters())(queries, 1).count() == 2
    with pytest.raises(RuntimeError, match="sentence-transformers"):
        models.SentenceEncoder("some/model").encode(["x"])


def test_an_index_gives_what_a_fresh_search_gives(spark, tables):
    corpus, queries = tables
    index = retrieval.build_index(corpus)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    for mode in retrieval.MODES:
        assert rows(retrieval.hybrid_search(corpus, queries, 3, mode)) == rows(retrieval.hybrid_search(corpus, queries, 3, mode, index=index))
    assert retrieval.hashed_search(corpus, queries, 4).where("query_id = 10").count() == 4  # the null text scores 0 and ranks by pos
    nothing = corpus.limit(0)
    assert retrieval.hashed_search(nothing, queries, 3).count() == 0 == retrieval.vector_search(spark.createDataFrame([], "pos long, vec array<double>"), spark.createDataFrame([(1, [1.0])], "query_id long, vec array<double>"), 2).count()


def test_reranker_and_its_fallback(spark, tables):
    corpus, queries = tables
    own = models.Reranker(Shared())
    _, results = rerank.two_stage(corpus, queries, 3, score=own.score)
    best = {r["query_id"]: (r["pos"], r["logit"]) for r in results.where("rank = 1").collect()}
    assert best == {10: (1, 2.0), 11: (2, 2.0)} and own.backend == "shared-words" and own.fallback_reason is None
    with pytest.raises(RuntimeError, match="broken"):
        models.Reranker(Broken())
    with pytest.warns(UserWarning, match="lexically"):
        spare = models.Reranker(Broken(), allow_fallback=True)
    assert spare.backend == "lexical" and "no weights" in spare.fallback_reason
    lexical = rerank.two_stage(corpus, queries, 3)[1]
    rows = lambda df: sorted((r["query_id"], r["pos"], r["rank"]) for r in df.collect())
    assert rows(rerank.two_stage(corpus, queries, 3, score=spare.score)[1]) == rows(lexical)
    found, _, _ = features.evidence(corpus, queries, 2, 3, score=own.score)
    assert found.where("query_id = 10").first()["ce_top1"] == 2.0


class _Server(BaseHTTPRequestHandler):
    calls: list = []
    busy = 0

    def do_POST(self):  # noqa: N802
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        type(self).calls.append((self.path, dict(self.headers), body))
        if type(self).busy:
            type(self).busy -= 1
            return self.send_error(503)
        if self.path == "/denied":
            return self.send_error(401)
        text = json.dumps({"n": len(type(self).calls)})
        answer = {"/chat": {"choices": [{"message": {"content": text}}]}, "/blocks": {"content": [{"type": "text", "text": text}]}, "/declined": {"content": [], "stop_reason": "refusal"}}[self.path]
        data = json.dumps(answer).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


def test_clients():
    server = HTTPServer(("127.0.0.1", 0), _Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    say = lambda c: c.complete("be brief", "hello", temperature=0.0, max_tokens=5)
    try:
        _Server.busy = 1
        assert say(models.ChatClient("m", f"{url}/chat", "secret", wait=0.01)) == '{"n": 2}'
        assert _Server.calls[-1][1]["Authorization"] == "Bearer secret" and _Server.calls[-1][2]["messages"][0]["content"] == "be brief"
        assert say(models.BlocksClient("m", f"{url}/blocks", "secret")) == '{"n": 3}' and _Server.calls[-1][2]["system"] == "be brief"
        with pytest.raises(reader.Refusal):
            say(models.BlocksClient("m", f"{url}/declined"))
        before = len(_Server.calls)
        with pytest.raises(RuntimeError, match="401"):
            say(models.ChatClient("m", f"{url}/denied"))
        assert len(_Server.calls) == before + 1  # not asked again
    finally:
        server.shutdown()
    gone = models.ChatClient("m", f"{url}/chat", tries=1)
    with pytest.raises(RuntimeError, match="can't be used"):
        models.reading(gone)
    with pytest.warns(UserWarning, match="extractively"):
        read, backend, why = models.reading(gone, allow_fallback=True)
    assert read is reader.extractive and backend == "lexical-reader" and why


# ---- made-up reports and their questions ------------------------------------


@pytest.fixture(scope="module")
def reports(spark):
    table = factbase.fact_table(spark, 6).cache()
    docs = factbase.reports(table).cache()
    cut = chunks.chunk_texts(docs)
    return table, docs, cut, factbase.linked(table, docs, cut).cache()


def test_facts_are_where_they_are_said_to_be(reports):
    table, docs, cut, linked = reports
    said = {(r["doc_id"], r["fact"]): r["sentence"] for r in table.collect()}
    for r in docs.collect():
        assert len(r["spans"]) == 3 + 3 * factbase.N_BASINS
        for s in r["spans"]:
            assert r["text"][s["a"] : s["z"]] == said[r["doc_id"], s["fact"]]
        assert all(x["a"] >= y["z"] for x, y in zip(r["spans"][1:], r["spans"], strict=False))
    text = {r["chunk_id"]: r["text"] for r in cut.collect()}
    for r in linked.collect():
        assert all(r["sentence"] in text[c] for c in r["chunks"])
    assert linked.where(F.size("chunks") > 0).count() > 60
    assert table.groupBy("doc_id").agg(F.countDistinct("basin").alias("n")).where(f"n <> {factbase.N_BASINS}").count() == 0


def test_template_questions(spark, reports):
    table, _, cut, linked = reports
    value = {(r["name"], r["basin"], r["kind"]): r["value"] for r in table.collect()}
    drafts = factbase.template_items(linked, cut, {c: 12 for c in evalset.CATEGORIES})
    rows = drafts.collect()
    assert {r["category"] for r in rows} == set(evalset.CATEGORIES) and len({r["question"] for r in rows}) == len(rows)
    again = factbase.template_items(linked, cut, {c: 12 for c in evalset.CATEGORIES})
    assert sorted(r["question"] for r in again.collect()) == sorted(r["question"] for r in rows)
    for r in rows:
        assert (r["answer"] == ABSTENTION) == (not r["gold"])
        if r["template"] == "gap":
            name = r["question"].split("does ")[1].split(" beat")[0]
            basin = r["question"].rsplit(" at ", 1)[1].rstrip("?")
            assert r["answer"].split()[0] == f"{(value[name, basin, 'result'] - value[name, basin, 'baseline']) / 10:.1f}"
        if r["template"] == "compare":
            name = r["question"].split("full ")[1].split(" score")[0]
            x, y = r["question"].split(" at ")[1].removesuffix(" or"), r["question"].rsplit(" at ", 1)[1].rstrip("?")
            assert r["answer"] == max((x, y), key=lambda b: value[name, b, "result"])
        if r["template"] == "absent_basin":
            assert not any(r["question"].split("full ")[1].split(" score")[0] == n and r["question"].rsplit(" at ", 1)[1].rstrip("?") == b for n, b, _ in value)
    made = evalset.assemble(drafts, {"path": "x", "num_chunks": 1, "sha256": "y"}, "facts", 0)
    made.check(spark)


# ---- written questions ------------------------------------------------------


class Writer:
    """A stand-in whose reply follows from the prompt: now broken, now with a wrong quote, else good."""

    def __init__(self, judged=False):
        self.judged = judged

    def complete(self, system, prompt, *, temperature, max_tokens):
        n = zlib.crc32(prompt.encode())
        quote = prompt.split("\n")[-1][:30]
        if "Do these passages" in prompt:
            assert temperature == 0 and "[x1] y" in prompt and prompt.index("[x1] y") < prompt.index("[x0] z")
            return json.dumps({"answerable": self.judged or n % 5 == 0, "chunk_id": None})
        if n % 7 == 0:
            raise reader.Refusal("no")
        if "takes both passages" in prompt:
            first = prompt.split("First passage:\n")[1].split("\n")[0][:30]
            return json.dumps({"question": f"Both {n}?", "answer": "two", "evidence_quotes": [first, quote]})
        if n % 3 == 0:
            return "no object here"
        if n % 3 == 1 and "evidence_quote" in prompt:
            return json.dumps({"question": "Q", "answer": "a", "evidence_quote": "not in there"})
        return "Well: " + json.dumps({"question": f" What {n % 40}? ", "answer": "one", "evidence_quote": quote.upper()})


def _search(questions, k):
    assert k == 5
    return questions.select("query_id", F.explode(F.array(F.struct(F.lit(2).alias("rank"), F.lit("x0").alias("chunk_id"), F.lit("z").alias("text")), F.struct(F.lit(1).alias("rank"), F.lit("x1").alias("chunk_id"), F.lit("y").alias("text")))).alias("x")).select("query_id", "x.*")


@pytest.fixture(scope="module")
def passages(spark):
    rows = [(f"d{d}::{i}", f"d{d}", f"T{d} {{a}}", f"passage {d} {i} {{b}} " + "word " * (50 if d else 1)) for d in range(12) for i in range(3)]
    return spark.createDataFrame(rows, "chunk_id string, doc_id string, title string, text string")


def test_written_questions(spark, passages):
    told = []
    out = asked.write_questions(passages, Writer(), {c: 3 for c in evalset.CATEGORIES}, search=_search, attempts=8, progress=lambda a, b: told.append((a, b)))
    rows = out.drafts.collect()
    assert sorted(r["category"] for r in rows) == sorted(c for c in evalset.CATEGORIES for _ in range(3)) and told[-1] == (15, 15)
    assert all(len(r["gold"]) == {"written_factoid": 1, "written_reasoning": 2}.get(r["template"], 0) for r in rows)
    assert all(len({g.split("::")[0] for g in r["gold"]}) == 1 for r in rows if r["gold"])
    assert not any(g.startswith("d0:") for r in rows for g in r["gold"])  # short chunks aren't asked about
    asks = [r["question"].strip().lower() for r in rows]
    assert len(set(asks)) == len(asks)
    tallies = out.tallies()
    assert tallies["quote_not_in_passage"] and tallies["ValueError"] and tallies["Refusal"]
    # of a category's attempts that held, the first count; as many attempts were made as rounds asked for
    tried = out.attempts.toPandas()
    assert (tried.groupby("category").size() % 3 == 0).all() and not tried.duplicated(["category", "attempt"]).any()
    again = asked.write_questions(passages.repartition(5), Writer(), {c: 3 for c in evalset.CATEGORIES}, search=_search, attempts=8)
    assert sorted(map(str, again.drafts.collect())) == sorted(map(str, rows))
    made = evalset.assemble(out.drafts, {"path": "x", "num_chunks": 1, "sha256": "y"}, "written", 0)
    made.check(spark)


def test_unfilled_quotas_name_their_reasons(spark, passages):
    with pytest.raises(RuntimeError, match="judged_answerable"):
        asked.write_questions(passages, Writer(judged=True), {"out_of_domain": 1}, search=_search)
    lone = passages.where("chunk_id LIKE '%::0'")
    with pytest.raises(RuntimeError, match="in_domain_reasoning': '0 of 1'"):
        asked.write_questions(lone, Writer(), {"in_domain_reasoning": 1})
    only_short = passages.where("doc_id = 'd0'")
    assert asked.bases(only_short, "in_domain_factoid", 5, 0).count() == 5  # from the front again where chunks run out
    prompt = asked._prompts(asked.bases(only_short, "in_domain_factoid", 1, 0)).first()["prompt"]
    assert "{b}" in prompt and "T0 {a}" in prompt


def test_quotes_must_stand_in_their_own_passages(spark):
    rows = [(["One  two\nthree"], ["one two THREE"], True), (["one"], [" "], False), (["one"], [], False), (["a b", "c d"], ["c d", "a b"], False), (["a b", "c d"], ["a", "c d"], True), (["one"], [None], False)]
    frame = spark.createDataFrame([([{"text": t} for t in p], q, w) for p, q, w in rows], "passages array<struct<text:string>>, quotes array<string>, want boolean")
    assert all(r["ok"] == r["want"] for r in frame.select("want", asked._holds().alias("ok")).collect())


def test_replies():
    assert asked.parsed('x {"answerable": false, "rationale": null} y', "judgement") == {"answerable": False}
    for bad in ('{"answerable": "no"}', "{}", "nothing"):
        with pytest.raises(ValueError):
            asked.parsed(bad, "judgement")
    with pytest.raises(ValueError, match="evidence_quotes"):
        asked.parsed('{"question": "q", "answer": "a", "evidence_quotes": [1, 2]}', "reasoning")


def test_figures(spark, tmp_path):
    pooled = spark.createDataFrame([("a&b", i / 1000, i / 2000) for i in range(1, 1001)], "model string, coverage double, risk double")
    bins = spark.createDataFrame([("a&b", 0, 3, 0.05, 0.1), ("a&b", 9, 4, 0.95, 1.0), ("a&b", 5, 0, None, None)], "model string, bin int, n long, confidence double, accuracy double")
    names = figures.write_figures(spark, f"file://{tmp_path}/f", pooled, bins, most_points=50)
    for n in names:
        text = (tmp_path / "f" / n).read_text()
        assert text.startswith("<svg") and "a&amp;b" in text and text.count("polyline") <= 2
    assert (tmp_path / "f" / "risk_coverage.svg").read_text().count(",") < 200
