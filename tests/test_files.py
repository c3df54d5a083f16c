import base64
import json
import threading
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from conftest import same_as_sql
from tessera.plans import registry
from tessera.sources import catalogue, documents, pdf


def make_pdf(pages, packed=True, extra=b""):
    """A small file: one content stream per page."""
    kids = b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(len(pages)))
    parts = [b"1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n", b"2 0 obj\n<< /Type /Pages /Kids [%s] /Count %d >>\nendobj\n" % (kids, len(pages))]
    for i, content in enumerate(pages):
        data = zlib.compress(content) if packed else content
        parts.append(b"%d 0 obj\n<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>\nendobj\n" % (3 + 2 * i, 4 + 2 * i))
        parts.append(b"%d 0 obj\n<< /Length %d %s >>\nstream\n%s\nendstream\nendobj\n" % (4 + 2 * i, len(data), b"/Filter /FlateDecode" if packed else b"", data))
    return b"%PDF-1.4\n" + b"".join(parts) + extra + b"trailer << /Root 1 0 R >>\n%%EOF\n"


PAGE = rb"BT /F1 12 Tf 72 700 Td (Water \(cold\) rose 4\2055) Tj 0 -14 Td [(by t) 20 (wo) -300 <6D65747265>] TJ T* (caf\351.) Tj ET"


@pytest.mark.parametrize("packed", [True, False])
def test_pdf_pages(packed):
    assert pdf.pages(make_pdf([PAGE, b"", b"BT (second) ' ET"], packed)) == ["Water (cold) rose 4\u20265\nby two metre\ncafé.", "", "second"]


def test_pdf_that_is_not_plain():
    for bad in (b"hello", b"%PDF-1.4 nothing", make_pdf([PAGE], extra=b"9 0 obj\n<< /Encrypt 8 0 R >>\nendobj\n")):
        with pytest.raises(ValueError):
            pdf.pages(bad)


def body(objects, trailer=b""):
    """A file of numbered objects, dictionaries or (dictionary, data) of streams, without a cross-reference table."""
    out = b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"
    for n, x in objects.items():
        held, data = x if isinstance(x, tuple) else (x, None)
        out += b"%d 0 obj\n%s\n" % (n, held) + (b"stream\n%s\nendstream\n" % data if data is not None else b"") + b"endobj\n"
    return out + trailer + b"startxref\n99999\n%%EOF\n"


def test_pdf_objects_in_streams():
    inner = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 5 0 R] /Count 2 /Resources << /XObject << /F 7 0 R >> >> >>", 3: b"<< /Type /Page /Contents [4 0 R 6 0 R] >>", 5: b"<< /Type /Page /Contents 8 0 R >>"}
    head, data = [], b""
    for n, x in inner.items():
        head += [n, len(data)]
        data += x + b"\n"
    head = " ".join(map(str, head)).encode() + b" "
    packed = zlib.compress(head + data)
    rows = b"".join(bytes([2]) + bytes((b - a) % 256 for a, b in zip(above, row, strict=True)) for above, row in [(bytes(4), b"BT ("), (b"BT (", b"up) "), (b"up) ", b"Tj  ")])
    objects = {
        4: (b"<< /Filter [/ASCIIHexDecode] >>", b"BT (a ) Tj ".hex().encode() + b">"),
        6: (b"<< /Filter /ASCII85Decode /Length 99 >>", base64.a85encode(b"(b\\\nc) ' /F Do ET") + b"~>"),
        7: (b"<< /Type /XObject /Subtype /Form /Length 26 >>", b"BT 0 5 Td (in a form) Tj ET"),
        8: (b"<< /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 4 >> >>", zlib.compress(rows)),
        9: (b"<< /Type /ObjStm /N 4 /First %d /Filter /FlateDecode /Length %d >>" % (len(head), len(packed)), packed),
        10: (b"<< /Type /XRef /Root 1 0 R /Size 11 /W [1 2 1] >>", b"\x00" * 8),
    }
    assert pdf.pages(body(objects)) == ["a \nbc\nin a form", "up"]
    # a later object of a number, as an update appends it, counts
    update = body({4: (b"<< >>", b"BT (new) Tj ")}, b"trailer << /Root 1 0 R >>\n")
    assert pdf.pages(body(objects) + update[8:])[0].startswith("new")


@pytest.mark.parametrize("revision", [2, 3])
def test_pdf_with_an_empty_password(revision):
    import hashlib

    version, size, ident, rights = (1, 5, b"0123456789abcdef", -4) if revision == 2 else (2, 16, b"0123456789abcdef", -1340)
    owner = bytes(range(32))
    key = hashlib.md5(pdf._PADDING + owner + (rights & 0xFFFFFFFF).to_bytes(4, "little") + ident).digest()
    for _ in range(50 if revision == 3 else 0):
        key = hashlib.md5(key[:size]).digest()
    key = key[:size]
    user = pdf._rc4(key, pdf._PADDING if revision == 2 else hashlib.md5(pdf._PADDING + ident).digest())
    for i in range(1, 20 if revision == 3 else 0):
        user = pdf._rc4(bytes(b ^ i for b in key), user)
    own = hashlib.md5(key + (4).to_bytes(3, "little") + b"\0\0").digest()[: min(size + 5, 16)]
    objects = lambda u: {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [3 0 R] >>", 3: b"<< /Type /Page /Contents 4 0 R >>", 4: (b"<< >>", pdf._rc4(own, b"BT (behind a lock) Tj ET")), 5: b"<< /Filter /Standard /V %d /R %d /Length %d /P %d /O <%s> /U <%s> >>" % (version, revision, size * 8, rights, owner.hex().encode(), u.hex().encode())}
    trailer = b"trailer << /Root 1 0 R /Encrypt 5 0 R /ID [<%s> <00>] >>\n" % ident.hex().encode()
    assert pdf.pages(body(objects(user), trailer)) == ["behind a lock"]
    with pytest.raises(ValueError, match="password"):
        pdf.pages(body(objects(bytes(32)), trailer))


def test_aes_of_published_vectors():
    key, vector = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c"), bytes(range(16))
    sealed = bytes.fromhex("7649abac8119b246cee98e9b12e9197d5086cb9b507219ee95db113a917678b273bed6b8e3c1743b7116e69e222295163ff1caa1681fac09120eca307586e1a7")
    plain = bytes.fromhex("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e5130c81c46a35ce411e5fbc1191a0a52eff69f2445df4f9b17ad2b417be66c3710")
    assert pdf._aes(key, vector + sealed) == plain[:-16]  # the last byte, 16, reads as padding


def test_pdf_fonts_with_their_own_codes():
    table = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0003> <0020> <0010> <D83DDC4D> endbfchar 2 beginbfrange <0041> <0043> <0061> <0050> <0051> [<0078> <00660069>] endbfrange"
    page = b"BT /A 9 Tf <004100420043 0003 00100050> Tj [<0051> -500 <0041>] TJ T* /B 9 Tf (\\001\\002x) Tj /C 9 Tf (plain \xe9) Tj /D 9 Tf <00410042> Tj ET"
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Kids [3 0 R] /Resources << /Font << /A 5 0 R /B 6 0 R /C << /Type /Font >> /D << /Subtype /Type0 >> >> >> >>",
        3: b"<< /Type /Page /Contents 4 0 R >>",
        4: (b"<< >>", page),
        5: b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 7 0 R >>",
        6: b"<< /Type /Font /Subtype /Type1 /Encoding << /Differences [1 /fi /uni00DF] >> >>",
        7: (b"<< /Filter /FlateDecode >>", zlib.compress(table)),
    }
    assert pdf.pages(body(objects, b"trailer << /Root 1 0 R >>\n")) == ["abc \U0001F44Dxfi a\nfi\u00dfxplain \u00e9"]


def test_scan_of_pdf_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(make_pdf([PAGE, b"BT (more) Tj ET"]))
    (tmp_path / "b.pdf").write_bytes(b"broken")
    (tmp_path / "c.pdf").write_bytes(make_pdf([b"", b""]))
    rows = {r["file"]: r for r in documents.scan_files(spark, f"file://{tmp_path}", extract=documents.pdf_text).collect()}
    assert rows["a.pdf"]["pages"][1] == "more" and rows["a.pdf"]["problem"] is None and rows["a.pdf"]["pages"][0].startswith("Water (cold)")
    assert rows["b.pdf"]["problem"].startswith("cannot read") and rows["c.pdf"]["problem"] == "no extractable text"


FEED = """<feed xmlns="http://www.w3.org/2005/Atom">{}</feed>"""
ENTRY = """<entry><id>http://x/abs/{0}</id><title>On  {0}
 things</title><summary> s </summary><published>2024-01-02</published><author><name>A B</name></author><author><name>C</name></author>
<category term="q.x"/><link rel="alternate" href="http://x/abs/{0}"/><link title="pdf" href="http://x/pdf/{0}"/></entry>"""


class _Feed(BaseHTTPRequestHandler):
    asked: list = []
    failing = 0

    def do_GET(self):  # noqa: N802
        from urllib.parse import parse_qs, urlparse

        path = urlparse(self.path)
        if path.path.startswith("/file"):
            data = b"%PDF-" + b"x" * 100_000 if path.path == "/file/good" else b"<html>"
        else:
            q = {k: v[0] for k, v in parse_qs(path.query).items()}
            type(self).asked.append(q)
            if type(self).failing:
                type(self).failing -= 1
                return self.send_error(503)
            a, n = int(q["start"]), int(q["max_results"])
            data = FEED.format("".join(ENTRY.format(f"p{i}") for i in range(a, min(a + n, 7)))).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def server():
    http = HTTPServer(("127.0.0.1", 0), _Feed)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}"
    http.shutdown()


def test_catalogue(spark, server):
    _Feed.failing = 2
    client = catalogue.AtomClient(f"{server}/api", page=3, delay=0.01)
    rows = list(client.records("all:rivers", 1, 5, "updated"))
    assert [r["arxiv_id"] for r in rows] == ["p1", "p2", "p3", "p4", "p5"] and rows[0]["title"] == "On p1 things"
    assert rows[0]["authors"] == ["A B", "C"] and rows[0]["url"] == "http://x/pdf/p1" and rows[0]["categories"] == ["q.x"]
    assert _Feed.asked[-1]["sortBy"] == "lastUpdatedDate" and len(_Feed.asked) == 4
    assert len(list(client.records("q", 5, 50, "relevance"))) == 2  # the feed ends
    _Feed.failing = 9
    with pytest.raises(RuntimeError, match="failed 2 times"):
        list(catalogue.AtomClient(f"{server}/api", delay=0.01, retries=1).records("q", 0, 1, "relevance"))
    _Feed.failing = 0
    documents.register(spark)
    read = spark.read.format("paper_catalogue").option("query", "q").option("max_results", 4).option("url", f"{server}/api").option("delay", "0.01").load()
    assert sorted(r["arxiv_id"] for r in read.collect()) == ["p0", "p1", "p2", "p3"]


def feed(query, start, count, sort):
    """A catalogue in a file that the query names: records, newest first."""
    assert sort == "submitted"
    with open(query) as f:
        return json.load(f)[start : start + count]


def test_catalogue_as_a_stream(spark, tmp_path):
    records = [{"arxiv_id": f"p{i}", "title": f"T{i}", "published": f"2024-01-{1 + i:02d}"} for i in range(10)]
    place = tmp_path / "feed.json"

    def publish():
        place.write_text(json.dumps(sorted(records, key=lambda r: r["published"], reverse=True)))

    def run(fail=False):
        stream = spark.readStream.format("paper_catalogue").option("query", str(place)).option("client", "test_files:feed").option("max_results", 8).load()

        def keep(batch, number):
            batch.select("arxiv_id").write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")
            if fail:
                raise RuntimeError("killed")

        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/checkpoint").start()
        try:
            query.processAllAvailable()
        except Exception:
            assert fail
        finally:
            query.stop()

    documents.register(spark)
    publish()
    run()  # the newest eight
    got = lambda: sorted(r["arxiv_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect())
    first = got()
    assert len(first) == 8
    known = set(first)
    records[:] = [r for r in records if r["arxiv_id"] in known]
    records += [{"arxiv_id": f"q{i}", "title": None, "published": f"2024-02-{1 + i // 100:02d}"} for i in range(250)]  # more than a look's page
    publish()
    run(fail=True)  # killed after its batch was written, before it was committed
    records += [{"arxiv_id": "late", "title": "x", "published": "2024-02-03"}, {"arxiv_id": "later", "title": "x", "published": "2024-03-01"}]
    publish()
    run()  # the same batch once more, then what came since
    run()
    assert got() == sorted([*known, *(f"q{i}" for i in range(250)), "late", "later"])


def test_fetch_in_blocks(spark, server, tmp_path):
    wanted = spark.createDataFrame([("a/1", f"{server}/file/good"), ("b", f"{server}/file/bad")], "arxiv_id string, url string")
    rows = {r["arxiv_id"]: r for r in documents.fetch(wanted, str(tmp_path), delay=0).collect()}
    assert rows["a/1"]["problem"] is None and (tmp_path / "a_1.pdf").stat().st_size == 100_005
    assert "expected kind" in rows["b"]["problem"] and sorted(p.name for p in tmp_path.iterdir()) == ["a_1.pdf"]


def test_fingerprint_in_levels(spark):
    import hashlib

    from tessera.sources import store

    rows = spark.range(40).selectExpr("id", "concat('t', id) AS t")
    got = store.fingerprint(rows, "id", ["id", "t"], blocks=3).first()
    level = [hashlib.sha256(f"{i}\x1ft{i}".encode()).hexdigest() for i in range(40)]
    join = lambda x: [hashlib.sha256("".join(x[i : i + 3]).encode()).hexdigest() for i in range(0, len(x), 3)]
    level, count = join(level), 40 // 3
    while count > 3:
        level, count = join(level), count // 3
    assert (got["digest"], got["n"]) == (hashlib.sha256("".join(level).encode()).hexdigest(), 40)


def test_stored_vectors_round_halves_as_the_sql_does(spark, tmp_path):
    rows = [(i, [i / 128, -i / 128, 1e-8 * i, -1e-8, 1e6 + i / 64]) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    same_as_sql(spark, "stored_vectors", registry.queries(), registry.oracle_sql(), str(tmp_path))
