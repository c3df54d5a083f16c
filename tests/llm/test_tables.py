import base64
import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import same_as_sql
from tessera.llm import components, queries, scann, warc

PAGES = [(1, "http://a.example/x?y=1#z", "<html>é</html>"), (2, "http://a.example/2", ""), (3, None, None), (4, "http://b.example", "<html>é</html>"), (5, "u\r\nv", "WARC/1.1\r\n\r\nno record\r\n\r\n"), (6, "http://c.example/", "x" * 300_000), (7, "http://c.example/", "x" * 300_000)]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('warc')}/w"
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, type string")
    warc.write_captures(pages, path)
    return path


def test_round_trip(spark, archive):
    captures = {r["metadata"][0]["fields"]["key"]: r for r in warc.assemble(warc.scan(spark, archive)).collect()}
    assert sorted(captures) == [str(p[0]) for p in PAGES]
    for page_id, _, html in PAGES:
        r = captures[str(page_id)]
        body = (html or "").encode()
        assert r["answer"]["payload_bytes"] == len(body)
        assert r["answer"]["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r["request"]["type"] == "request" and len(r["metadata"]) == 1 and r["others"] == []
    assert captures["1"]["answer"]["type"] == "revisit" and captures["4"]["answer"]["payload"].decode() == PAGES[0][2]
    assert captures["1"]["answer"]["refers_to"] == captures["4"]["answer"]["record_id"]
    assert captures["2"]["answer"]["refers_to"] == captures["3"]["answer"]["record_id"]
    assert captures["1"]["request"]["payload"].startswith(b"GET /x?y=1 HTTP/1.1")


def test_small_payloads_need_not_be_revisits(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_captures(pages, f"file://{tmp_path}/w", least_bytes=1000)
    kinds = {r["metadata"][0]["fields"]["key"]: r["answer"]["type"] for r in warc.assemble(warc.scan(spark, f"file://{tmp_path}/w")).collect()}
    assert kinds["6"] == "revisit" and kinds["1"] == kinds["2"] == "response"


def test_every_row_is_a_capture(spark, tmp_path):
    html = [(None, "a"), (None, "a"), (None, "lone"), (None, "pair"), (None, "pair"), (1, "a"), (2, "a"), (2, "a"), (2, "a"), (2, "b"), (3, "b"), (3, "c"), (4, None), (4, None), (None, None), (5, "d")]
    rows = [(k, f"http://h.example/{i % 3}", h) for i, (k, h) in enumerate(html)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.queries()["op1_warc_transactions"](spark, str(tmp_path)).count() == len(rows)
    same_as_sql(spark, "op1_warc_transactions", queries.queries(), queries.oracle_sql(), str(tmp_path))
    types = {}
    for r in queries.queries()["op1_warc_transactions"](spark, str(tmp_path)).collect():
        types.setdefault(r["payload_digest"], []).append((r["record_type"], r["page_id"], r["refers_to"]))
    assert all([t for t, _, _ in own].count("response") == 1 for own in types.values())
    of = lambda text: sorted(types[base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()], key=str)
    assert of("lone") == [("response", None, None)] and of("pair") == [("response", None, None), ("revisit", None, None)]
    assert of("a") == [("response", 2, None), ("revisit", 1, 2), ("revisit", 2, 2), ("revisit", 2, 2), ("revisit", None, 2), ("revisit", None, 2)]
    path = f"file://{tmp_path}/w"
    warc.write_captures(spark.read.parquet(f"{tmp_path}/pages.parquet"), path)
    got = warc.assemble(warc.scan(spark, path)).collect()
    assert len(got) == len(rows) and all(r["answer"] and r["request"] and len(r["metadata"]) == 1 and not r["others"] for r in got)
    bodies = {r["answer"]["record_id"]: r["answer"]["payload"].decode() for r in got if r["answer"]["type"] == "response"}
    read = [(r["metadata"][0]["fields"]["key"], bodies[r["answer"]["refers_to"] or r["answer"]["record_id"]]) for r in got]
    assert sorted(read) == sorted((str(k or ""), h or "") for k, h in html)


def record(kind, id_, block=b"", **headers):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {id_}", *[f"{k.replace('_', '-')}: {x}" for k, v in headers.items() for x in ([v] if isinstance(v, str) else v)], f"Content-Length: {len(block)}"]
    return b"WARC/1.0\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_links_of_every_kind(spark, tmp_path):
    http = b"HTTP/1.1 404 Not Found\r\nX: y\r\n\r\n\x00\xff"
    rows = [
        record("warcinfo", "<i>", b"software: x\r\n", Content_Type="application/warc-fields"),
        record("response", "<r1>", http, WARC_Concurrent_To=["<q1>", "<m1>"]),  # the response names the others
        record("request", "<q1>"),
        record("metadata", "<m1>", b"a: b\r\n", Content_Type="application/warc-fields"),
        record("request", "<q2>", WARC_Concurrent_To="<r2>"),
        record("metadata", "<m2>", WARC_Concurrent_To="<q2>"),  # only through the request
        record("response", "<r2>", http),
        record("request", "<lone>"),
        record("response", "<r2>", b"again"),  # the same record once more
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in rows))  # one member each
    (tmp_path / "b.warc").write_bytes(record("resource", "<s>", b"data") + b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\nshort")
    scanned = warc.scan(spark, f"file://{tmp_path}")
    assert scanned.count() == 11 and scanned.where("problem = 'cut short'").count() == 1
    got = {r["capture_id"]: r for r in warc.assemble(scanned).collect()}
    assert set(got) == {"<r1>", "<r2>", "<lone>", "<s>"}
    assert got["<r1>"]["request"]["record_id"] == "<q1>" and got["<r1>"]["metadata"][0]["fields"] == {"a": "b"}
    assert got["<r2>"]["metadata"][0]["record_id"] == "<m2>" and got["<r2>"]["answer"]["http_status"] == 404
    assert got["<r1>"]["answer"]["payload"] == b"\x00\xff" and got["<lone>"]["answer"] is None
    assert len(got["<r2>"]["others"]) == 0


def test_empty_table(spark, tmp_path):
    warc.write_captures(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    assert warc.assemble(warc.scan(spark, f"file://{tmp_path}/w")).count() == 0


def test_digest(spark):
    for data in (b"", b"abc", bytes(range(256))):
        got = spark.createDataFrame([(data,)], "b binary").select(warc.base32_sha1(F.col("b")).alias("d")).first()["d"]
        assert got == base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---- nearest neighbours ------------------------------------------------------


def exact(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    out = {}
    for q in np.flatnonzero(ids % 50 == 0):
        s = np.round(unit @ unit[q], 12)
        s[q] = -9
        out[ids[q]] = [ids[i] for i in np.lexsort((ids, -s))[: min(k, len(ids) - 1)]]
    return out


def search(df, **options):
    out: dict = {}
    for r in scann.nearest(df, F.col("vec_id") % 50 == 0, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    truth = exact([(r["vec_id"], r["embedding"]) for r in df.collect()], 5)
    got = search(df)
    assert np.mean([len(set(truth[q]) & set(got[q])) / 5 for q in truth]) >= 0.95
    few = search(df, rerank=24, chunk_rows=512)
    assert np.mean([len(set(truth[q]) & set(few[q])) / 5 for q in truth]) >= 0.85


def test_ties_nulls_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    common = rng.normal(size=8).tolist()
    rows = [(i, common) for i in range(300)] + [(i, rng.normal(size=8).tolist()) for i in range(300, 400)]
    bad = [(401, None), (402, [0.0] * 8), (403, [float("nan")] + [1.0] * 7), (404, [None] + [1.0] * 7), (405, [1.0] * 3), (None, [1.0] * 8), (450, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v, 0, 0.5) for i, v in rows + bad], "vec_id long, embedding array<double>, rank int, score double")
    got = search(df.unionByName(df.where("vec_id = 7")))
    assert got == exact(rows, 5) and got[50] == [0, 1, 2, 3, 4] and got[0] == [1, 2, 3, 4, 5]
    assert search(df.where("vec_id < 3")) == {0: [1, 2]}
    assert search(df.limit(0)) == {} and search(df.where("vec_id = 402")) == {}
    scores = scann.nearest(df, F.col("vec_id") == 0).collect()
    assert all(abs(r["score"] - 1) < 1e-12 for r in scores)


@pytest.mark.parametrize("spread", [0.02, 0.3])
def test_nearest_of_vectors_that_share_their_codes(spark, spread):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(3, 24))
    rows = [(i, (centres[i % 3] + spread * rng.normal(size=24)).tolist()) for i in range(1500)]
    assert search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), chunk_rows=600) == exact(rows, 5)


def test_parallel_error_costs_more():
    rng = np.random.default_rng(1)
    x = scann._unit(rng.normal(size=(500, 16)))
    q = scann.Quantiser.fit(x, threshold=0.6)
    plain = scann.Quantiser(q.centres, 1.0)

    def parallel(codes):
        back = np.stack([q.centres[m][codes[:, m]] for m in range(codes.shape[1])], axis=1).reshape(len(x), -1)
        return np.abs(((x - back) * x).sum(axis=1)).mean()

    assert parallel(q.encode(x)) < parallel(plain.encode(x))


# ---- components --------------------------------------------------------------


def test_components(spark):
    import random

    rng = random.Random(0)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(1000, 1000 + i) for i in range(500)] + [(2000 + i, 2001 + i) for i in range(40)] + [(5, 5)]
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*edges, (None, 3)], "u long, v long")
    got = {r["node"]: r["component"] for r in components.connected(df).collect()}
    assert got == {v: root(v) for v in list(parent)}
    assert components.connected(df.limit(0)).count() == 0
