import sys
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from conftest import SMALL  # noqa: E402
from tessera.llm import bpe, langid, linefreq, mixing, paritysketch, recompress, sharding, tokencount  # noqa: E402

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
ODD = [(1, ""), (2, None), (3, " \n\t "), (4, "one"), (5, "one two"), (6, LONG), (7, LONG), (8, "é ß 的  日本\x0b\x0c x"), (9, "Nd, " * 60), (None, "null id " * 30)]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, copies, and columns whose names clash with results."""
    rows = [(d, t, "en", "src0", 1, 0, "k") for d, t in ODD] + [(4, "one", "en", "src0", 1, 0, "k")]
    return spark.createDataFrame(rows, f"{SCHEMA}, lang string, source string, n_words int, shard int, key string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], f"{SCHEMA}, lang string, source string")


# ---- byte-level BPE ---------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_bpe_equals_the_library(codec, reference):
    import random

    import numpy as np

    rng = random.Random(2)
    parts = ["a", "b", "e", "t", "h", "ing", " ", "  ", "\n", "é", "的", "'s", "1", "22", "!!", "мир", "\t", "\r\n", " \n", "😀", "\x1c", "\x85", " ", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(4000)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 90))) for _ in range(1500)]
    texts += ["".join(chr(rng.randint(1, 0x2FFF)) for _ in range(40)) for _ in range(500)]
    texts += [c * k for c in ("a", " ", "ab", "=", "\n", "的", "0") for k in (1, 2, 3, 100, 5001)]
    for t in texts:
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t), t[:60]
        assert codec.decode(ids) == t.encode()


def test_bpe_rows(spark, odd, empty, reference):
    rows = bpe.encode_documents(odd, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    assert len(rows) == len(ODD) + 1
    by = {r["doc_id"]: r for r in rows}
    for d, t in ODD:
        assert by[d]["ids"] == reference.encode_ordinary(t or "") and by[d]["n_tokens"] == len(by[d]["ids"])
    assert bpe.encode_documents(empty, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


# ---- token counts -----------------------------------------------------------


def test_token_counts(spark, odd, empty):
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in tokencount.count_tokens(odd, path, block_bytes=4096).collect()), key=str)
    texts = [*ODD, (4, "one")]
    want = sorted(((d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in texts), key=str)
    assert got == want
    assert tokencount.count_tokens(empty, path).count() == 0
    tricky = ["a<|endoftext|>b <|startoftext|>", "don't WE'LL é  x y \x1cz", "½ ① x²"]
    rows = spark.createDataFrame(list(enumerate(tricky)), SCHEMA)
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.count_tokens(rows, path).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(tricky)}


def test_token_counts_of_the_query(spark):
    from tessera.llm.queries import queries

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries()["op5_token_counts"](spark, SMALL).collect():
        assert r["n_tokens"] == len(library.encode(docs[r["doc_id"]], add_special_tokens=False).ids)
        assert r["over_limit"] == (r["n_tokens"] > 2048)


# ---- sharding ---------------------------------------------------------------


def test_shards(spark, odd, empty):
    rows = sharding.with_slots(sharding.shuffle_into_shards(odd, "doc_id", n_shards=3, bucket_bytes=64)).collect()
    assert len(rows) == len(ODD) + 1
    for s in range(3):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert all(r["grown_shard"] in (3, r["shard"]) for r in rows)
    assert sharding.with_slots(sharding.shuffle_into_shards(empty, "doc_id")).count() == 0


def test_shards_are_even_stable_and_shuffled(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    a = sharding.with_slots(sharding.shuffle_into_shards(rows, "doc_id", n_shards=8)).select("record.doc_id", "shard", "slot", "grown_shard").toPandas().sort_values("doc_id")
    n = a.groupby("shard").size()
    assert n.min() > 2300 and n.max() < 2700
    assert 1800 < (a["grown_shard"] == 8).sum() < 2700
    b = sharding.with_slots(sharding.shuffle_into_shards(rows.repartition(3), "doc_id", n_shards=8)).select("record.doc_id", "shard").toPandas().sort_values("doc_id")
    assert (a["shard"].to_numpy() == b["shard"].to_numpy()).all()
    first = a[a["shard"] == 0].sort_values("slot")["doc_id"].to_numpy()
    assert abs((first[1:] > first[:-1]).mean() - 0.5) < 0.05


def test_one_hot_key_is_spread(spark):
    rows = spark.range(3000).selectExpr("7L AS doc_id", "id AS x")
    out = sharding.shuffle_into_shards(rows, "doc_id", size=F.lit(100), n_shards=2, bucket_bytes=10_000)
    assert out.select("shard").distinct().count() == 1 and out.groupBy("bucket").count().count() > 5


@pytest.mark.parametrize("hot", ["7L", "CAST(NULL AS LONG)"])
def test_no_bucket_passes_its_bytes(spark, hot):
    rows = spark.range(4000).selectExpr(f"IF(id % 2 = 0, {hot}, id) AS doc_id", "repeat('x', CAST(1000 + id % 7 * 900 AS INT)) AS text", "1 AS bucket", "2 AS _order")
    out = sharding.shuffle_into_shards(rows, "doc_id", size=F.octet_length("text"), bucket_bytes=1 << 19)
    held = out.groupBy("shard", "bucket").agg(F.sum(F.octet_length("record.text")).alias("b")).toPandas()
    assert held["b"].max() <= (1 << 19) + 6400 and held["b"].sum() == rows.agg(F.sum(F.octet_length("text"))).first()[0]


# ---- language identification ------------------------------------------------


def test_language(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learned = langid.learn(docs.where(langid.fold("doc_id") != 1))
    held = langid.predict(docs.where(langid.fold("doc_id") == 1), learned).select("lang", "lang_pred", "score").toPandas()
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97 and held["score"].between(0, 1).all()
    out = {r["doc_id"]: r for r in langid.predict(odd, learned).collect()}
    assert all(out[d]["lang_pred"] == "und" and out[d]["score"] == 0 for d in (1, 2, 3))
    assert out[6]["lang_pred"] == out[7]["lang_pred"] and out[4]["n_words"] == 1
    assert langid.predict(empty, learned).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.learn(empty)).collect()} == {"und"}


def test_language_names_are_no_input(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    learned = langid.learn(docs)
    a = langid.predict(docs, learned).select("doc_id", "lang_pred").orderBy("doc_id").collect()
    b = langid.predict(docs.withColumn("lang", F.lit("xx")), learned).select("doc_id", "lang_pred").orderBy("doc_id").collect()
    assert a == b


# ---- line frequency ---------------------------------------------------------


def test_line_rules(spark, odd, empty):
    rows = {r["doc_id"]: r for r in linefreq.judge(odd).collect()}
    for d, t in ODD:
        w = brute.words(t)
        assert rows[d]["n_words"] == len(w) and rows[d]["n_repeat_words"] == brute.repeated_words(w)
        assert rows[d]["word_chars"] == sum(len(x.decode()) for x in w)
    assert not rows[2]["kept"] and rows[9]["base_failed"] and linefreq.judge(odd).count() == len(ODD) + 1
    assert linefreq.judge(empty).count() == 0


def test_frequent_lines(spark):
    body = lambda i: " ".join(f"t{i}w{k}" for k in range(60))
    rows = [(i, f"{body(i)}\nSubscribe   now", "a") for i in range(5)] + [(10, "subscribe now\n" * 30 + "x y", "a"), (11, f"{body(11)}\nSubscribe now", "b"), (12, "q " * 10, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in linefreq.judge(docs, most_docs=4).collect()}
    assert got[0]["removed_words"] == 2 and got[0]["kept"] and got[10]["removed_words"] == 60 and not got[10]["kept"] and got[11]["removed_words"] == 0
    text = {r["doc_id"]: r["text"] for r in linefreq.without_frequent_lines(docs, most_docs=4).collect()}
    assert text[0] == body(0) and text[10] == "x y"
    assert text[11].endswith("Subscribe now") and text[12] == "q " * 10
    copies = spark.createDataFrame([(i, f"same line here\n{body(0)}", s) for s in ("a", None) for i in range(9)] + [(20, f"same line here\n{body(1)}", "b")], "doc_id long, text string, source string")
    got = [(r["source"], r["removed_words"], r["kept"]) for r in linefreq.judge(copies, most_docs=8).collect()]
    assert sorted(got, key=str) == sorted([(s, 63, False) for s in ("a", None) for _ in range(9)] + [("b", 0, True)], key=str)
    assert {r["removed_words"] for r in linefreq.judge(copies, most_docs=9).collect()} == {0}


def test_line_rules_equal_sql_on_odd_lines(spark, tmp_path):
    """Carriage returns, other white space, null hosts, and thirty copies of a page, against the SQL."""
    from conftest import duck, canonical

    page = "\n".join([" ".join(f"c{k}" for k in range(55)), "ALL  rights\treserved", "x\x0by"])
    rows = [(i, page, "h") for i in range(30)] + [(40, "a b\n\r\n\r\nc d", "h"), (41, page.upper(), "h"), (42, page, "i"), (43, None, "h"), (44, "", None)] + [(50 + i, f"All rights reserved\r\n{i}", None) for i in range(25)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got, want = linefreq.op2_line_frequency(spark, str(tmp_path)).toPandas(), duck(str(tmp_path)).sql(linefreq.OP2_SQL).df()
    columns = sorted(got.columns)
    assert canonical(got, columns) == canonical(want, columns)
    by = got.set_index("doc_id")
    assert by.loc[40, "n_dup_lines"] == 0 and not by.loc[0, "kept"] and not by.loc[41, "kept"] and by.loc[42, "kept"]


def test_line_rules_run_no_python(spark, odd):
    plan = linefreq.judge(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- recompression ----------------------------------------------------------


def found(docs, width=50):
    rows, contents = recompress.find_repeats(docs, width=width)
    out = recompress._verdict(rows, contents, width)
    digest = F.lower(F.hex(F.coalesce("kept", "content")))
    return {r["id"]: (r["n_words"], r["n_removed"], r["d"]) for r in out.select("id", "n_words", "n_removed", digest.alias("d")).collect()}


def test_repeats(spark, odd, empty):
    got = found(odd)
    want = brute.repeats([r for r in ODD if r[0] is not None])
    assert {k: v for k, v in got.items() if k is not None} == want and want[7][1] == 30_000 and got[None][1] == 0
    assert found(empty) == {}
    assert recompress.remove_repeats(odd).count() == len(ODD) + 1 and recompress.remove_repeats(odd).columns == odd.columns


@pytest.mark.parametrize("seed", range(3))
def test_repeats_with_few_words(spark, seed):
    import random

    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcd") for _ in range(300)) for _ in range(5)]
    rows = []
    for i in range(120):
        at = rng.randint(0, 250)
        cut = base[rng.randint(0, 4)].split()[at : at + rng.randint(20, 120)]
        head = [rng.choice("aab") for _ in range(rng.randint(0, 60))]
        rows.append((i, " ".join(head + cut + ["a"] * rng.choice([0, 0, 70, 120, 3]) + [rng.choice("ab") for _ in range(30)] + rng.choice([cut, [], ["z"]]))))
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute.repeats(rows)
    assert found(spark.createDataFrame(rows, SCHEMA), 20) == brute.repeats(rows, 20)


def test_symbols_agree_inside_equal_substrings():
    import numpy as np

    rng = np.random.default_rng(0)
    middle = rng.integers(0, 50, 60).astype(np.uint64)
    seen = []
    for _ in range(2):
        row = np.concatenate((rng.integers(0, 50, 40).astype(np.uint64), middle, rng.integers(0, 50, 40).astype(np.uint64)))
        x = recompress.provisional(recompress.mix64(row), np.array([0, len(row)]), recompress.caps_for(50))
        assert (np.diff(x.lo) >= 0).all() and (np.diff(x.hi) >= 0).all() and x.lo[0] == -1 and x.hi[-1] == len(row) + 1
        inside = (x.lo >= 40) & (x.hi <= 100)
        seen.append({(int(n), int(a - 40), int(b - 40)) for n, a, b in zip(x.name[inside], x.lo[inside], x.hi[inside], strict=True)})
    assert seen[0] == seen[1] and len(seen[0]) > 5


def test_blocks_are_packed_small():
    rng = np.random.default_rng(3)
    n = 50_000
    name = (rng.zipf(1.3, n) % 5000 * 64 << 33) - 1
    span = rng.integers(1, 4, n).astype("<i4")
    end = np.cumsum(span)
    state = {"doc": [0], "at": [0], "n": [end[-1]], "word": name, "name": name, "which": np.full(n, -1), "span": span, "lo": end - span - rng.integers(0, 2, n), "hi": end + 1, "top_name": name[:3], "top_a": [], "top_span": [60]}
    packed = recompress._packed(state)
    got = recompress._unpacked(packed)
    assert all(np.array_equal(got[c], np.asarray(v)) for c, v in state.items()) and set(got) == set(state)
    assert 4 * len(packed) < sum(v.nbytes for v in got.values())
    assert all(len(v) == 0 for v in recompress._unpacked(recompress._packed({})).values())


# words of one length that a polynomial of the bytes modulo 2**64 can't tell apart
THUE = ["a"]
for _ in range(10):
    THUE.append(THUE[-1] + THUE[-1].translate(str.maketrans("ab", "ba")))
OTHER_THUE = [t.translate(str.maketrans("ab", "ba")) for t in THUE]


@pytest.mark.parametrize("k", [5, 9, 10])
def test_words_of_like_patterns_differ(spark, k):
    body = [f"v{i}" for i in range(49)]
    rows = [(1, " ".join([*body, THUE[k]])), (2, " ".join([*body, OTHER_THUE[k]])), (3, " ".join([*body, THUE[k]]))]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute.repeats(rows)
    lone = spark.createDataFrame([(1, THUE[k]), (2, OTHER_THUE[k]), (3, THUE[k])], SCHEMA)
    assert joined(lone, 9, 10, 3) == {1: (1, 1), 2: (1, 2), 3: (1, 1)}


def test_patterns_of_words_differ(spark):
    rows = [(i, " ".join(t)) for i, t in enumerate((THUE[10], OTHER_THUE[10], "z " + OTHER_THUE[10] * 2, THUE[6] + OTHER_THUE[7]))]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute.repeats(rows)


def test_every_round_names_runs_and_pairs_once(spark):
    import random

    import numpy as np

    rng = random.Random(4)
    passage = [f"p{rng.randint(0, 300)}" for _ in range(400)] + ["same"] * 70
    rows = [(i, " ".join([f"x{i}y{k}" for k in range(rng.randint(0, 60))] + passage[i * 5 : 470 - i] + [f"z{i}w{k}" for k in range(90)])) for i in range(12)]
    texts = spark.createDataFrame(rows, SCHEMA).select(F.col("doc_id").alias("id"), "text", F.unhex(F.md5("text")).alias("row"))
    keys = texts.repartition(4).mapInArrow(lambda it: recompress._sketch(it, 50), "id long, row binary, n_words long, content binary, keys array<long>")
    seen = []
    blocks, tops = recompress.recompress(texts.join(keys.select("row", F.col("keys").alias("wanted")), "row").repartition(5), 50, seen)
    tables = [t.collect() for t in seen]
    assert len(tables) > 6 and {r["key"] for r in tables[0]} <= {w.encode() for w in passage}
    expansion = {r["name"]: [bytes(r["key"])] for r in tables[0]}
    for turn, table in enumerate(tables[1:]):
        for r in table:
            parts = np.frombuffer(r["key"], "<i8").tolist()
            names, times = parts[::2], parts[1::2]
            assert r["name"] not in expansion and sum(times) > 1 and (len(names) <= 2 or turn > 2)
            expansion[r["name"]] = [w for n, k in zip(names, times, strict=True) for w in expansion[n] * k]
    assert len({tuple(x) for x in expansion.values()}) == len(expansion)
    text = dict(rows)
    high = tops.collect()
    assert high and max(r["n"] for r in high) > 100
    for r in high:  # what a high symbol stands for is what the text has there
        assert text[r["id"]].encode().split()[r["at"] : r["at"] + r["n"] + 49] == expansion[r["name"]]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute.repeats(rows)


def test_what_stays_keeps_its_white_space(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"a\n{passage}\nb"), (2, f"one\ttwo\n\n{passage}\n three \nfour\n"), (3, f" {passage} ")]
    left = {r["doc_id"]: r["text"] for r in recompress.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert left == {1: rows[0][1], 2: "one\ttwo\n\nthree \nfour\n", 3: " "}


# ---- parity sketches --------------------------------------------------------


def joined(docs, num, den, n):
    return {r["id"]: (r["n_shingles"], r["component_id"]) for r in paritysketch.jaccard_components(docs, num, den, n).collect()}


def test_jaccard_edges(spark, odd, empty):
    got = joined(odd, 9, 10, 3)
    want = brute.components([r for r in ODD if r[0] is not None], 9, 10, 3)
    assert {k: v for k, v in got.items() if k is not None} == want
    assert joined(empty, 9, 10, 3) == {}
    assert paritysketch.one_of_each(odd).count() == len(ODD) - 1


def test_one_of_each_with_null_and_shared_ids(spark):
    body = lambda i: " ".join(f"t{i}w{k}" for k in range(40))
    near = body(0) + " more"
    rows = [(None, body(0)), (None, near), (None, body(1)), (None, body(2)), (7, body(3)), (7, body(4)), (7, body(4)), (7, body(5)), (8, body(5)), (None, None), (None, None), (None, " "), (9, ""), (9, "")]
    left = paritysketch.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
    texts = [r["text"] for r in left if (r["text"] or "").strip()]
    assert len(texts) == 6 and set(texts) - {near} | {body(0)} == {body(i) for i in range(6)}
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left if not (r["text"] or "").strip()) == [(0, ""), (0, ""), (0, " "), (9, ""), (9, "")]


@pytest.mark.parametrize(("num", "n"), [(9, 3), (8, 5), (5, 2)])
def test_jaccard_near_copies(spark, num, n):
    import random

    rng = random.Random(num)
    rows = []
    for b in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([4, 12, 30, 80, 200]))]
        for _ in range(rng.choice([1, 3, 40])):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 15)):
                w[rng.randrange(len(w))] = f"n{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(w)))
        del b
    rows += [(len(rows) + i, "a shared passage that many documents quote word for word " + " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(60))) for i in range(60)]
    assert joined(spark.createDataFrame(rows, SCHEMA), num, 10, n) == brute.components(rows, num, 10, n)


def test_large_clusters_lose_no_link(spark, monkeypatch):
    """Chains of near copies: the ends link with no pivot, and two families meet in one cluster."""
    import random

    monkeypatch.setattr(paritysketch, "BLOCK_SETS", 7)
    rng = random.Random(6)
    rows = []
    for f in range(2):
        w = [f"f{f}w{k}" for k in range(60)]
        for step in range(40):
            rows.append((1000 - len(rows), " ".join(w)))
            if step % 3 == 0:
                w[rng.randrange(60)] = f"n{rng.randint(0, 10**6)}"
            else:
                rows.append((1000 - len(rows), " ".join([*w, f"tail{len(rows)}"])))
    docs = spark.createDataFrame(rows, SCHEMA)
    assert joined(docs, 8, 10, 3) == brute.components(rows, 8, 10, 3)


def test_keys_are_shuffled_in_turns(spark, monkeypatch):
    rows = [(i, " ".join([f"f{i % 9}w{k}" for k in range(40)] + [f"tail{i % 4}"])) for i in range(150)]
    docs = spark.createDataFrame(rows, SCHEMA)
    made = []
    whole = paritysketch.stored
    monkeypatch.setattr(paritysketch, "stored", lambda df, name: made.append(name) or whole(df, name))
    monkeypatch.setattr(paritysketch, "TURN_SHINGLES", 1)
    assert joined(docs, 8, 10, 3) == brute.components(rows, 8, 10, 3) and made.count("met") == 4


def test_stored_tables_leave_no_shuffle_files(spark):
    import time

    from tessera.llm import common

    def files():
        return sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))

    name, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", files()
    assert common.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3, "k"), "counts").collect()
    for _ in range(50):
        if (left := files()) <= before:
            break
        time.sleep(0.1)
    assert left <= before and spark.conf.get(name, None) is None


def test_tasks_get_small_batches(spark):
    from tessera.llm import common

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    common.documents(spark, SMALL)
    rows = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    found = [r["n"] for r in rows.mapInArrow(sizes, "n long").collect()]
    assert len(found) > 1 and max(found) <= common.BATCH + (2 << 20)


def test_sketches_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(1)
    bands = paritysketch.Bands(8, 10)
    for size in (5, 40, 300):
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        b = a.copy()
        change = max(1, size // 12)
        b[:change] = rng.integers(0, 2**63, change).astype(np.uint64)
        b = np.unique(b)
        differ = len(np.setxor1d(a, b))
        if differ * 10 <= 2 * (len(a) + len(b)) * 10 // 18:
            keys = [{k for _, _, part in paritysketch.sketch_keys(x, bands) for k in part.tolist()} for x in (a, b)]
            assert keys[0] & keys[1]


# ---- mixing -----------------------------------------------------------------


def test_raking():
    import numpy as np

    rng = np.random.default_rng(0)
    cells = rng.integers(1, 100, (3, 4, 2)).astype(float)
    goals = [np.array([0.5, 0.3, 0.2]), np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.7, 0.3])]
    fitted, error, _ = mixing.rake(cells, goals)
    assert error < 1e-9
    for axis, goal in enumerate(goals):
        assert np.allclose(fitted.sum(axis=tuple(a for a in range(3) if a != axis)) / fitted.sum(), goal)
    plain = cells / cells.sum()
    for _ in range(500):
        for axis, goal in enumerate(goals):
            shape = [-1 if a == axis else 1 for a in range(3)]
            plain = plain * (goal / plain.sum(axis=tuple(a for a in range(3) if a != axis))).reshape(shape)
    assert np.allclose(plain * cells.sum(), fitted)


def test_mixture(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.mix(docs).toPandas()
    weight = out["n_tokens"] * out["probability"]
    share = weight.groupby(out["lang"]).sum() / weight.sum()
    assert share["en"] == pytest.approx(0.6) and share["es"] == pytest.approx(0.12)
    assert (weight.groupby(out["topic"]).sum() / weight.sum()).round(6).eq(round(1 / 6, 6)).all()
    assert out["probability"].between(0, 1).all() and out["probability"].max() == pytest.approx(1)
    assert abs(out["sampled"].mean() - out["probability"].mean()) < 0.05
    assert mixing.mix(odd).count() == len(ODD) + 1 and mixing.mix(empty).count() == 0


def test_topics_come_from_whole_texts(spark):
    import random

    rng = random.Random(3)
    themes = [[f"theme{t}word{k}" for k in range(80)] for t in range(8)]
    shared = "the same opening of every text, long enough to fill sixty-four characters and more. "
    rows = [(i, shared + " ".join(rng.sample(themes[i % 8], 60)) + f" own{i}", ("en", "de")[i % 2], "src0") for i in range(160)]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, lang string, source string")
    topic = {r["doc_id"]: r["topic"] for r in mixing.mix(docs).collect()}
    assert len(set(topic.values())) > 1
    agree = lambda pairs: sum(topic[i] == topic[j] for i, j in pairs) / len(pairs)
    pairs = [(i, j) for i in range(160) for j in range(i)]
    alike, unlike = agree([(i, j) for i, j in pairs if i % 8 == j % 8]), agree([(i, j) for i, j in pairs if i % 8 != j % 8])
    assert alike > 2 * unlike, (alike, unlike)
    other = docs.withColumn("text", F.concat(F.lit("Another beginning! "), F.expr("substring(text, 65)")))
    moved = {r["doc_id"]: r["topic"] for r in mixing.mix(other).collect()}
    assert sum(moved[i] == topic[i] for i in topic) >= 150
    assert mixing.mix(docs.repartition(7)).select("doc_id", "topic").exceptAll(mixing.mix(docs).select("doc_id", "topic")).count() == 0


def test_shared_keys_over_batches():
    """Keys whose documents lie in several batches, a frequent one, and one known before."""
    import numpy as np
    import pyarrow as pa

    key = np.array([1, 1, 2, 3, 3, 3, 4, 5, 6, 6], np.int64)
    doc = np.array([7, 8, 7, 1, 2, 3, 4, 4, 9, 9], np.int64)
    kind = np.zeros(10, np.int8)
    kind[5] = recompress.KNOWN
    rows = pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key), pa.array(doc)], ["kind", "key", "doc"])
    for step in (1, 2, 3, 10):
        out = [b.to_pydict() for b in recompress._shared(iter([rows.slice(a, step) for a in range(0, 10, step)]))]
        assert sorted((k, d) for b in out for k, d in zip(b["key"], b["doc"], strict=True)) == [(1, 7), (1, 8), (3, 1), (3, 2), (3, 3)]
    lists = pa.ListArray.from_arrays(pa.array([0, 3, 5, 6, 7], pa.int32()), pa.array([1, 2, 3, 2, 3, 2, 9], pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array([10, 11, 12, 13], pa.int64()), lists], ["doc", "keys"])
    out = next(iter(recompress._local(iter([batch])))).to_pydict()
    assert list(zip(out["key"], out["doc"], out["kind"], strict=True)) == [(1, 10, 0), (2, 10, 0), (3, 10, 0), (2, 11, 0), (3, 11, 0), (2, 12, 1), (9, 13, 0)]


# ---- names of the caller's own ------------------------------------------------


OWN_NAMES = ["_base", "__host", "__text", "__out", "__row", "__left", "__lang", "__places", "__read", "__key", "__cell", "__p", "__there", "__hot", "__on0", "__at1", "__cold", "__h", "__t", "host", "line", "row", "id"]


def test_columns_with_the_operators_own_names_stay(spark):
    own = [F.concat(F.lit(n), F.lit("/"), F.col("doc_id").cast("string")).alias(n) for n in OWN_NAMES]
    body = " ".join(f"w{k}" for k in range(60))
    rows = [(i, f"{body}\nof document {i} alone" if i % 2 else body, "en", "src0") for i in range(30)] + [(40, None, None, None), (41, "", "en", "src0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").select("*", *own)
    learned = langid.learn(docs)
    results = [linefreq.judge(docs, most_docs=3), linefreq.without_frequent_lines(docs, most_docs=3), langid.predict(docs, learned), mixing.mix(docs), recompress.remove_repeats(docs), paritysketch.one_of_each(docs)]
    for out in results:
        assert set(docs.columns) <= set(out.columns)
        got = out.select("doc_id", *OWN_NAMES).collect()
        assert got and all(r[n] == f"{n}/{r['doc_id']}" for r in got for n in OWN_NAMES)
    assert [r.count() for r in results] == [32, 32, 32, 32, 32, results[-1].count()]


def test_copies_of_a_text_are_looked_up_alone(spark, monkeypatch):
    from tessera.llm import common

    plain = {}
    rows = [(i, "menu home about\n" + (f"only here {i}" if i > 60 else "the same page again"), "a" if i % 5 else None) for i in range(100)] + [(200, None, "a"), (201, "  ", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for heavy in (1000, 1, 50):  # all keys by broadcast, none, some
        monkeypatch.setattr(linefreq, "HEAVY", heavy)
        judged = {r["doc_id"]: (r["removed_words"], r["kept"]) for r in linefreq.judge(docs, most_docs=20).collect()}
        texts = {r["doc_id"]: r["text"] for r in linefreq.without_frequent_lines(docs, most_docs=20).collect()}
        plain = plain or (judged, texts)
        assert (judged, texts) == plain and len(judged) == 102
    # 49 copies on host a, 12 pages beside them have the menu; the host without a name has 12 copies and 8 others
    assert judged[1] == (7, False) and judged[99] == (3, False) and judged[95] == (0, False) and texts[99] == "only here 99" and texts[200] is None
    assert common.HEAVY == 1000


def test_language_profiles_learn_from_every_row(spark):
    rows = [(f"word{'abcdefghij'[i % 10]} house number {'klmnopqrst'[i // 10 % 10]} stands alone here", "en") for i in range(30_000)]
    rare = ("zzq zzq zzq zzq zzq zzq zzq zzq", "en")
    base = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    many = [("ooo xxo ooo xxo oxo xoxo ooxx xooxo oxox", "zz")] * 40
    docs = base.unionByName(spark.createDataFrame([*many, rare], base.schema))
    (_, en), (_, zz) = langid.learn(docs)
    whole = langid.profiles().bundles([t for t, _ in rows[:100]]).astype(float).sum(axis=0) * 300 + langid.profiles().bundles([rare[0]])[0]
    assert np.allclose(en, whole / np.linalg.norm(whole), atol=1e-6)
    # one of 30,001 lies within the share that may score less, one of ten doesn't
    low = langid.least_scores(docs, [("en", en), ("zz", zz)], margin=1.0)
    few = langid.least_scores(spark.createDataFrame([*rows[:9], rare], base.schema), [("en", en), ("zz", zz)], margin=1.0)
    assert few["en"] < low["en"] and low["zz"] > 0.9
