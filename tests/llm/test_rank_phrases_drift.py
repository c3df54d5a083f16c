"""Operators 11 to 13 against the library, plain versions and files read back."""

import glob
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SMALL
from tessera.llm import phrases, rankbpe, schemadrift
from tessera.llm.queries import queries

WORD_BPE = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORD_BPE)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def codec():
    with open(WORD_BPE, "rb") as f:
        return rankbpe.RankCodec(f.read())


def wanted(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_rank_array_equals_the_library_on_odd_texts(library, codec):
    draw = random.Random(3)
    pool = "aAbBzZéÉß İıΣσς'’sStT09½Ⅷ ٣\t\n\x0b\x1c\x1f\x7f\x85\xa0  　.,!?#<|>endoftextstart日本語한국어👍🏽́ẹ́ﬁ‍ᲉꟋ՘\x00﻿ẞ"
    texts = ["".join(draw.choice(pool) for _ in range(draw.randrange(40))) for _ in range(4000)]
    texts += ["", "<|endoftext|>", "a<|endoftext|>b é<|startoftext|>́x <|ENDOFTEXT|>", "ab" * 3000, "a" * 20000, "I'll we've DON'T it's O'Dea'd"]
    for text in texts:
        packed = codec.encode(text)
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert codec.decode(packed).decode() == library.decode(ids, skip_special_tokens=False)


def test_heap_and_array_merge_alike(codec, monkeypatch):
    draw = random.Random(4)
    pieces = ["".join(draw.choice("theandingsouĠé"[:13]) for _ in range(draw.randrange(1, 60))) for _ in range(500)]
    short = [codec.merge(p) for p in pieces]
    monkeypatch.setattr(rankbpe, "LONG", 0)
    assert [codec.merge(p) for p in pieces] == short


def test_definitions_of_other_kinds_are_refused():
    with open(P.path("byte_bpe_50k.json"), "rb") as f, pytest.raises(ValueError):
        rankbpe.RankCodec(f.read())


def test_rank_array_rows(spark, library):
    long = "wird the " * 30000
    rows = [(1, "Hello world", "x"), (None, "Hello world", "y"), (2, None, None), (2, "", "x"), (3, long, "x"), (3, long, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").withColumn("id", F.lit(7))
    got = rankbpe.encode_documents(docs, WORD_BPE).collect()
    assert got[0].asDict().keys() == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"}
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted((i or 0, *wanted(library, t or "")) for i, t, _ in rows)
    assert all(len(r.ids) == r.n_tokens for r in got)
    assert rankbpe.encode_documents(docs.limit(0), WORD_BPE).count() == 0


def test_op11_digests(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries()["op11_rank_array_bpe"](spark, SMALL).collect()}
    assert got == {d: wanted(library, t or "") for d, t in zip(docs["doc_id"], docs["text"], strict=True)}


# -- phrases


def plain_collocations(rows, longest, least, covered=100):
    """(lang, phrase) -> (a, l, r, n, score), with counters and whole numbers."""
    f, n = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang, text = lang or "und", (text or "").translate(lower).replace("\t", " ")
        for end in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(end, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.split(" ") if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = {}
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        for p, a in found.items():
            if 100 * inside[p] >= covered * a:
                continue
            score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            out[lang, " ".join(p)] = (a, count[p[:k]], count[p[k:]], n[lang], score)
    return out


def fixture_rows():
    draw = random.Random(5)
    words = ["New", "york", "city", "a", "of", "the", "é", "NEW", "x" * 40, "\x1cq", "nb\xa0sp"]
    rows = []
    for i in range(300):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", "\t ", ". ", "\n", ",", "\x0b"]) for _ in range(draw.randrange(60)))
        rows.append((draw.choice(["en", "en", "de", None, "und"]), text))
    return rows + [("en", None), (None, None), ("fr", ""), ("fr", " .\n"), ("en", "of the " * 5000), ("en", "of the " * 5000), ("es", "solo")]


@pytest.mark.parametrize("block_bytes", [2000, 1 << 24])
def test_phrases_equal_plain_counts(spark, block_bytes):
    rows = fixture_rows()
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", F.lit(1)).withColumn("w", F.lit("z"))
    for longest, least, covered in ((5, 6, 100), (4, 3, 80), (2, 2, 100)):
        got = phrases.collocations(docs, longest=longest, least=least, covered=covered, block_bytes=block_bytes).collect()
        want = plain_collocations(rows, longest, least, covered)
        assert len(got) == len(want) > 20
        assert {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in got} == want
        assert all(r.words == len(r.phrase.split(" ")) for r in got)


def test_phrases_with_saturated_bitmaps(spark, monkeypatch):
    monkeypatch.setattr(phrases, "LEAST_BITS", 3)
    monkeypatch.setattr(phrases, "MOST_BITS", 3)
    rows = fixture_rows()
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), least=6).collect()
    assert {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in got} == plain_collocations(rows, 5, 6)


def test_distinct_stretches_beyond_64_bits():
    draw = np.random.default_rng(1)
    seq = draw.integers(1, 1 << 20, 4000)
    seq[2000:2050] = seq[:50]
    at = np.arange(3990)
    rows, count = phrases._distinct(seq, at, 5)
    want = Counter(tuple(seq[i : i + 5].tolist()) for i in at)
    assert dict(zip(map(tuple, rows.tolist()), count.tolist(), strict=True)) == want and max(count) == 2


def test_scores_beyond_64_bits(spark):
    big = 4_000_000_000_000_000
    row = spark.createDataFrame([(big, big, big + 7, big)], "a long, n long, l1 long, r1 long")
    score = row.select(F.expr("(CAST(a * 1000 AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0))) DIV (CAST(l1 AS DECIMAL(19,0)) * CAST(r1 AS DECIMAL(19,0)))")).first()[0]
    assert score == 1000 * big * big // ((big + 7) * big)


def test_best_ranks_ties_by_bytes(spark):
    rows = [("en", p, a, s) for p, a, s in [("b c", 5, 9), ("é a", 5, 9), ("z a", 5, 9), ("a b", 4, 9), ("q q", 9, 1)]] + [("de", "x y", 1, 1)]
    found = spark.createDataFrame(rows, "lang string, phrase string, a long, score long")
    got = {(r.lang, r["rank"]): r.phrase for r in phrases.best(found, 4).collect()}
    assert got == {("en", 1): "b c", ("en", 2): "z a", ("en", 3): "é a", ("en", 4): "a b", ("de", 1): "x y"}
    assert phrases.best(found.limit(0)).count() == 0


def test_no_texts_no_phrases(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None)], "lang string, text string"), least=1).count() == 0


# -- drifted schemas

IDS = {c: i for i, c in enumerate(schemadrift.CLIENTS, 1)}


def plain_files(rows):
    """file_no -> the values that the contract asks for, from rows as dictionaries."""
    rows = sorted(rows, key=lambda r: (zlib.crc32(str(r["client_id"]).encode()), r["client_id"]))
    each = 1 + len(rows) // 500
    out = {}
    for no in range(-(-len(rows) // each)):
        own = [dict(r) for r in rows[no * each : (no + 1) * each]]
        v = zlib.crc32(f"42:{no}".encode()) % 24
        v = 0 if v > 15 else v
        names = list(schemadrift.CLIENTS)
        if v & 4:
            names = [n for n in names if n not in ("nation_id", "source")]
            own = [r | {"nation_id": -1, "source": "none"} for r in own]
        if v & 2:
            names = [names[0], *reversed(names[1:])]
        if v & 8:
            own = [r | {"balance": None if r["balance"] is None else float(np.float32(r["balance"]))} for r in own]
        if v & 1:
            names = [{"name": "email", "email": "name"}.get(n, n) for n in names]

        def text(name, x):
            if x is None:
                return "?"
            return str(math.floor(1048576 * x)) if name == "balance" else str(x)

        lines = ["|".join(text(n, r[n]) for n in schemadrift.CLIENTS) for r in own]
        out[no] = {
            "version": v,
            "n_rows": len(own),
            "n_nulls": sum(x is None for r in own for x in r.values()),
            "ids_sha256": hashlib.sha256(",".join(str(r["client_id"]) for r in own).encode()).hexdigest(),
            "rows_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
            "start_columns": ",".join(names),
            "columns": ",".join(schemadrift.CLIENTS),
            "rewritten": v != 0,
        }
    return out


def client_rows(folder):
    table = pq.read_table(f"{folder}/clients.parquet").select(schemadrift.CLIENTS)
    return table.set_column(3, "updated_at", table["updated_at"].cast(pa.int64())).to_pylist()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op13_files(spark, sf):
    folder = f"/root/testdata/{sf}"
    result = queries()["op13_schema_rewrite"](spark, folder)
    want = plain_files(client_rows(folder))
    schema = schemadrift.evolved_clients(spark.read.parquet(f"{folder}/clients.parquet"))
    for _ in range(2):  # tasks that run again give the same
        got = {r.file_no: r for r in result.collect()}
        assert {no: {k: r[k] for k in want[no]} for no, r in got.items()} == want
    paths = [r.path.removeprefix("file://") for r in got.values()]
    parent = paths[0].rsplit("/", 1)[0]
    assert sorted(glob.glob(f"{parent}/*")) == sorted(paths)
    for p in paths:
        there = pq.read_schema(p)
        assert [(f.name, f.type, f.nullable, schemadrift.field_id(f)) for f in there] == [(f.name, f.type, f.nullable, IDS[f.name]) for f in schema]
    assert not glob.glob(f"{parent}/../staging/*")


def test_untouched_files_keep_their_bytes_and_odd_files_are_matched(spark, tmp_path):
    schema = schemadrift.with_field_ids(pa.schema([("k", pa.int64()), ("s", pa.string()), ("v", pa.float64())]))
    field = lambda name, kind, i: pa.field(name, kind, True, {schemadrift.FIELD_ID: str(i).encode()})
    same = pa.table({"k": [1, None], "s": ["a", None], "v": [1.5, None]}, schema=schema)
    odd = pa.table([pa.array([None, 2.5], pa.float32()), pa.array(["x", "y"]), pa.array([5, 6], pa.int32())], schema=pa.schema([field("s", pa.float32(), 3), field("k", pa.string(), 9), field("v", pa.int32(), 1)]))
    none = same.slice(0, 0)
    unnumbered = pa.table({"k": [1]})
    for i, t in enumerate((same, odd, none, unnumbered)):
        pq.write_table(t, tmp_path / f"{i}.parquet")
    before = (tmp_path / "0.parquet").read_bytes()
    files = spark.createDataFrame([(i, f"file://{tmp_path}/{i}.parquet") for i in range(4)], "file_no long, path string")
    got = {r.file_no: r for r in schemadrift.rewrite_files(files, schema, {2: "gone"}, f"file://{tmp_path}/staging", 4).collect()}
    assert (tmp_path / "0.parquet").read_bytes() == before
    assert [got[i].rewritten for i in range(4)] == [False, True, False, True]
    assert pq.read_table(tmp_path / "1.parquet").to_pylist() == [{"k": 5, "s": "gone", "v": None}, {"k": 6, "s": "gone", "v": 2.5}]
    assert pq.read_table(tmp_path / "3.parquet").to_pylist() == [{"k": None, "s": "gone", "v": None}]
    assert (got[2].n_rows, got[0].n_nulls, got[1].start_columns) == (0, 3, "s,k,v")
    assert got[0].rows_sha256 == hashlib.sha256(b"1|a|1572864\n?|?|?").hexdigest()
    assert schemadrift.rewrite_files(files.limit(0), schema, {}, f"file://{tmp_path}/staging", 0).count() == 0


def test_a_replacement_that_was_not_moved_is_found(spark, tmp_path):
    schema = schemadrift.with_field_ids(pa.schema([("k", pa.int64())]))
    (tmp_path / "staging").mkdir()
    pq.write_table(pa.table({"k": [1]}, schema=schema), tmp_path / "staging/0.parquet")
    schemadrift._restore(f"file://{tmp_path}/0.parquet", f"file://{tmp_path}/staging")
    assert pq.read_table(tmp_path / "0.parquet").to_pylist() == [{"k": 1}]


def test_ranks_of_hot_keys_nulls_and_clashing_names(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 11).alias("key"), F.lit(1).alias("row"), F.lit(2).alias("at"), F.col("id").alias("tie"))
    got = schemadrift.ranked(rows, [F.col("key")], parts=16).toPandas().sort_values("rank")
    assert got["rank"].tolist() == list(range(3000))
    keys = [-1 if x != x else x for x in got["key"]]
    assert keys == sorted(keys) and sorted(got["tie"]) == list(range(3000)) and set(got["row"]) == {1} and set(got["at"]) == {2}
    assert schemadrift.ranked(rows.limit(0), [F.col("key")]).count() == 0
    # the hot key's rows lie in several sorted partitions
    assert rows.where("key = 7").count() > 1000 and got[got["key"] == 7]["tie"].nunique() > 1000
