import random
import threading
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions.text import ABSTENTION
from tessera.operators import chunks, intervals, reader, similar


def prose(seed=3, paragraphs=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(6, 18))).capitalize() + "."
    return "\n\n".join(" ".join(sentence() for _ in range(rng.randint(2, 6))) for _ in range(paragraphs))


def test_hard_cut_and_short():
    assert chunks.spans("x" * 2000)[:3] == [(0, 512), (448, 960), (896, 1408)] and chunks.spans("x" * 2000)[-1][1] == 2000
    assert [("  short text  ")[a:b] for a, b in chunks.spans("  short text  ")] == ["short text"]
    assert chunks.spans("  \n ") == [] == chunks.spans("")
    with pytest.raises(ValueError):
        chunks.spans("x", 10, 10)
    assert chunks.spans("ab " * 50, 10, 2, length=lambda s: len(s) * 2)[0][1] <= 5


@pytest.mark.parametrize("seed", range(5))
def test_invariants(seed):
    t = prose(seed)
    found = chunks.spans(t)
    covered = set()
    for (a, b), nxt in zip(found, [*found[1:], (None, None)], strict=True):
        assert 0 < b - a <= 512 and not t[a].isspace() and not t[b - 1].isspace()
        assert a == 0 or t[a - 1].isspace()
        covered.update(range(a, b))
        if nxt[0] is not None:
            assert b - nxt[0] <= 64 and nxt[0] > a
    assert all(t[i].isspace() for i in range(len(t)) if i not in covered)


def test_provenance(spark):
    pages = [prose(1, 2), "", prose(2, 3)]
    docs = spark.createDataFrame([("2005.11401v4", "T", pages), ("e", "E", [""])], "doc_id string, title string, pages array<string>")
    rows = chunks.chunk_pages(docs).orderBy("chunk_index").collect()
    whole = "\n\n".join(pages)
    assert rows[0]["chunk_id"] == "2005.11401v4::0000" and rows[3]["chunk_id"] == "2005.11401v4::0003"
    third = len(pages[0]) + 4
    for r in rows:
        assert whole[r["char_start"] : r["char_end"]] == r["text"]
        assert r["page_start"] == (3 if r["char_start"] >= third else 2 if r["char_start"] >= len(pages[0]) + 2 else 1)
    assert {r["doc_id"] for r in rows} == {"2005.11401v4"}


CONTEXT = [
    ("p::0000", "We take Zephyr as the name of the older turbine. It has 14 wooden blades."),
    ("p::0001", "We drain the basin for 6 weeks with a slope of 3e-4. Early frost is likely."),
    ("p::0002", "The new pump lifts 52.7 tonnes in Marlhaven. The old pump lifts 31.9 tonnes."),
]


def context(spark, n=1):
    return spark.createDataFrame([(q, c, i, t) for q in range(n) for i, (c, t) in enumerate(CONTEXT, 1)], "query_id long, chunk_id string, rank int, text string")


def test_extractive_reader(spark):
    asked = ["For how many weeks is the basin drained?", "Which name has the older turbine?", "How many tonnes does the new pump lift in Marlhaven?", "Who painted the ceiling of a chapel?"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    rows = {r["query_id"]: r for r in reader.extractive(context(spark, 4), q).collect()}
    assert "6 weeks" in rows[0]["answer"] and rows[0]["citations"] == ["p::0001"]
    assert "Zephyr" in rows[1]["answer"]
    assert "52.7" in rows[2]["answer"] and rows[2]["citations"] == ["p::0002"]
    assert rows[3]["abstain"] and rows[3]["answer"] == ABSTENTION and rows[3]["reason"].startswith("low_support")
    forced = {r["query_id"]: r for r in reader.extractive(context(spark, 4), q, forced=True).collect()}
    assert not any(r["abstain"] for r in forced.values())
    nothing = context(spark).limit(0)
    assert reader.extractive(nothing, q).where("reason = 'no_context' AND abstain").count() == 4
    empty = reader.extractive(nothing, q, forced=True).first()
    assert (empty["answer"], empty["grounded"], empty["abstain"]) == ("", False, False)


def plain_grams(w):
    return {f"#{w}#"[i : i + 3] for i in range(len(w))}


def test_trigram_candidates_are_verified_where_they_meet(spark):
    """pairs that aren't similar are not shuffled again to fetch their trigrams."""
    words = spark.createDataFrame([(w,) for w in ("granite", "granites", "marble", "marbled", "zz")], "word string")
    found = similar.trigram_join(words.withColumnRenamed("word", "term"), words)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 3
    assert {(r["term"], r["word"]) for r in found.where("term < word").collect()} == {("granite", "granites"), ("marble", "marbled")}


def test_trigram_join(spark):
    draw = random.Random(2)
    words = ["".join(draw.choice("abcé") for _ in range(draw.randrange(1, 9))) for _ in range(300)] + ["aaaa", "aaaaa", ""]
    terms = words[::3] + ["abcabc", "zz"]
    frame = lambda values, name: spark.createDataFrame([(v,) for v in [*values, None, values[0]]], f"{name} string")
    for least in (0.5, 0.7, 1.0):
        got = {(r["term"], r["word"]): r["similarity"] for r in similar.trigram_join(frame(terms, "term"), frame(words, "word"), least).collect()}
        want = {}
        for t in set(terms):
            for w in set(words):
                a, b = plain_grams(t), plain_grams(w)
                if a and b and len(a & b) / len(a | b) >= least:
                    want[t, w] = len(a & b) / len(a | b)
        assert got == pytest.approx(want) and len(want) >= 90
    with pytest.raises(ValueError):
        similar.trigram_join(frame(terms, "term"), frame(words, "word"), 0)


def test_one_reading_serves_both_modes(spark):
    q = spark.createDataFrame([(1, "what gates answers"), (2, "bananas of jupiter"), (3, "")], "query_id long, text string")
    text = "Tessera gates answers by risk. It quotes 3 sentences of each chunk."
    c = spark.createDataFrame([(i, f"c{i}", 1, text) for i in (1, 2)], "query_id long, chunk_id string, rank int, text string")
    both = reader.extractive(c, q, forced=None)
    apart = reader.extractive(c, q).unionByName(reader.extractive(c, q, forced=True))
    assert both.count() == 6 and both.exceptAll(apart).count() == 0


def test_soft_coverage_stays_in_its_row(spark, monkeypatch):
    monkeypatch.setattr(similar, "trigram_join", None)  # words of other rows are of no concern
    pairs = spark.createDataFrame([(i, "gate gates threshold", f"gating thresholds word{i}") for i in range(20)] + [(99, "gate", "")], "query_id long, question string, sentence string")
    idf = spark.createDataFrame([(i, t, w) for i in range(20) for t, w in (("gate", 1.0), ("gates", 2.0), ("threshold", 1.0))] + [(99, "gate", 1.0)], "query_id long, term string, idf double")
    got = {r["query_id"]: r["coverage"] for r in similar.soft_coverage(pairs, idf).collect()}
    # #ga, gat shared of four and six trigrams: 2/8; #ga, gat of five and six: 2/9; threshold is 8 of 11
    assert got[99] == 0 and all(abs(got[i] - (8 / 11) / 4) < 1e-12 for i in range(20))


def test_soft_coverage(spark):
    rows = [(1, "drained weeks", "They drain it for 6 weeks"), (2, "how many", "many weeks"), (3, "weeks", ""), (4, None, "weeks"), (5, "weeks", None)]
    pairs = spark.createDataFrame(rows, "query_id int, question string, sentence string")
    idf = spark.createDataFrame([(1, "drained", 1.0), (1, "weeks", 3.0), (2, "many", 1.0), (3, "weeks", 1.0), (5, "weeks", 1.0)], "query_id int, term string, idf double")
    got = {r["query_id"]: r["coverage"] for r in similar.soft_coverage(pairs, idf).collect()}
    # "drained" and "drain" share four of eight trigrams
    assert got == {1: pytest.approx((0.5 + 3) / 4), 2: 0, 3: 0, 4: 0, 5: 0}


def test_interval_join(spark):
    draw = random.Random(6)
    spans = [(draw.choice("ab"), i, a := draw.randrange(-50, 3000), a + draw.choice([0, 1, 5, 40, 300])) for i in range(400)]
    windows = [(draw.choice("ab"), i, a := draw.randrange(-100, 3000), a + draw.choice([0, 1, 2, 3, 4, 64, 65, 512, 2048, 4000])) for i in range(300)]
    bad = [("a", 900, 10, 5), (None, 901, 0, 100), ("a", 902, None, 5)]
    s = spark.createDataFrame([*spans, (None, 800, 1, 2), ("a", 801, None, None)], "k string, s int, a long, z long")
    w = spark.createDataFrame([*windows, *bad], "k string, w int, start long, end long")
    got = sorted((r["s"], r["w"]) for r in intervals.contained(s, w, ["k"]).collect())
    assert got == sorted((i, j) for k, i, a, z in spans for q, j, x, y in windows if k == q and x <= a and z <= y) and len(got) > 5000
    assert intervals.contained(s, w.limit(0), ["k"]).count() == 0


def test_spans():
    # the number whose surroundings share most with the question; ties: numbers before names, then the earlier
    assert reader.span("How many tonnes does it lift?", "In 1904 the pump, they say, could barely lift 52.7 tonnes, or so.") == "could barely lift 52.7 tonnes, or"
    assert reader.span("Where is it?", "It stands in (Marlhaven), near 9 oaks.") == "in (Marlhaven), near 9 oaks"
    assert reader.span("Where is Marlhaven?", "Marlhaven lies near Oxbow and NASA.") == "Oxbow"
    assert reader.span("Where?", "It is nowhere!") == "It is nowhere" and reader.span("Where?", "") == ""


def test_overlap_is_measured_as_chunks_are():
    text = "".join(f"{i:03d} " for i in range(200))
    double = lambda s: 2 * len(s)
    found = chunks.spans(text, 80, 20, length=double)
    assert all(double(text[a:b]) <= 80 for a, b in found) and found[-1][1] == len(text) - 1
    assert all(0 < double(text[c:b]) <= 20 for (_, b), (c, _) in zip(found, found[1:], strict=False))
    assert all(chunks.spans(text, 40, 10)[k] == x for k, x in enumerate(found))


def test_grounding(spark):
    ctx = [("a", "Alpha  beta gamma"), ("b", "Delta epsilon")]
    rows = [
        ("ok", "x", False, ["a"], ["alpha BETA"], None),
        ("none", ABSTENTION, True, [], [], None),
        ("dirty", ABSTENTION, True, ["a"], [], "abstains"),
        ("blank", " ", False, ["a"], ["alpha"], "claims"),
        ("nocite", "x", False, [], ["alpha"], "names no source"),
        ("unknown", "x", False, ["z"], ["alpha"], "names a source"),
        ("noquote", "x", False, ["a"], [], "quotes nothing"),
        ("other", "x", False, ["a"], ["delta"], "quotes what"),
    ]
    df = spark.createDataFrame([(*r[:5], ctx) for r in rows], "id string, answer string, abstain boolean, citations array<string>, evidence_quotes array<string>, context array<struct<chunk_id:string,text:string>>")
    got = {r["id"]: r["e"] for r in df.select("id", reader.grounding_error().alias("e")).collect()}
    for id_, *_, want in rows:
        assert (got[id_] is None) if want is None else got[id_].startswith(want)


class Scripted:
    def __init__(self, replies):
        self.replies = replies

    def complete(self, system, prompt, *, temperature, max_tokens):
        kind = next(k for k in self.replies if k in prompt)
        reply = self.replies[kind]
        if reply == "refuse":
            raise reader.Refusal
        if reply == "crash":
            raise OSError("down")
        if isinstance(reply, tuple):
            return reply[1] if "rejected" in prompt else reply[0]
        return reply


def test_client_reader(spark):
    good = 'Sure: {"answer": "6 weeks", "citations": ["p::0001"], "evidence_quotes": ["drain the basin for 6 weeks"], "abstain": false} done {"x": 1}'
    replies = {"Qgood": good, "Qretry": ("no json", good), "Qbad": "no json", "Qrefuse": "refuse", "Qcrash": "crash"}
    q = spark.createDataFrame([(i, k) for i, k in enumerate(replies)], "query_id long, text string")
    rows = {r["query_id"]: r for r in reader.with_client(context(spark, 5), q, Scripted(replies)).collect()}
    assert rows[0]["answer"] == rows[1]["answer"] == "6 weeks"
    assert [rows[i]["reason"] for i in (2, 3, 4)] == ["invalid_output", "refusal", "error:OSError"]
    assert reader.first_json('{"a": {"b": 1}} trailing {"c": 2}') == {"a": {"b": 1}}
    with pytest.raises(ValueError):
        reader.first_json("nothing")


def test_cache(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def read(keyed):
        def run(batches):
            for pdf in batches:
                calls.add(len(pdf))
                yield pd.DataFrame({"key": pdf["key"], "answer": pdf["key"] + "!"})

        return keyed.select("key").mapInPandas(run, "key string, answer string")

    cache = reader.AnswerCache(spark, f"file://{tmp_path}/cache")
    keyed = spark.createDataFrame([("a",), ("b",)], "key string")
    assert sorted(r["answer"] for r in cache.answers(keyed, read).collect()) == ["a!", "b!"]
    more = spark.createDataFrame([("a",), ("c",)], "key string")
    assert sorted(r["answer"] for r in cache.answers(more, read).collect()) == ["a!", "c!"]
    assert calls.value == 3


def test_two_writers_read_each_key_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    start = threading.Barrier(2)

    def read(keyed):
        def run(batches):
            for pdf in batches:
                time.sleep(0.3)
                calls.add(len(pdf))
                yield pd.DataFrame({"key": pdf["key"], "answer": pdf["key"] + "!"})

        return keyed.select("key").mapInPandas(run, "key string, answer string")

    got: dict = {}

    def session(name, keys):
        cache = reader.AnswerCache(spark.newSession(), f"file://{tmp_path}/cache")
        keyed = cache.spark.createDataFrame([(k,) for k in keys], "key string")
        start.wait()
        got[name] = sorted((r["key"], r["answer"]) for r in cache.answers(keyed, read).collect())

    both = [threading.Thread(target=session, args=("x", ["a", "b", "c", "c"])), threading.Thread(target=session, args=("y", ["b", "c", "d"]))]
    for t in both:
        t.start()
    for t in both:
        t.join(120)
    assert got == {"x": [(k, f"{k}!") for k in "abcc"], "y": [(k, f"{k}!") for k in "bcd"]}
    assert calls.value == 4


def test_cache_gives_up_dead_owners_and_compacts(spark, tmp_path):
    read = lambda keyed: keyed.select("key", F.concat("key", F.lit("?")).alias("answer"))
    path = f"file://{tmp_path}/cache"
    dead = reader.AnswerCache(spark, path)
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    number, _ = dead._claim(keys("a", "b"))  # claimed, and never answered
    cache = reader.AnswerCache(spark, path, patience=0.5, poll=0.1)
    assert sorted(r["answer"] for r in cache.answers(keys("a", "c"), read).collect()) == ["a?", "c?"]
    assert not dead._publish(dead._staged(keys("a").withColumn("answer", F.lit("late"))), "answers", number)

    def broken(keyed):
        raise_it = F.raise_error(F.lit("no"))
        return keyed.select("key", raise_it.cast("string").alias("answer"))

    with pytest.raises(Exception, match="no"):
        cache.answers(keys("z"), broken)
    assert [r["answer"] for r in cache.answers(keys("z"), read).collect()] == ["z?"]
    held = lambda: sorted(map(tuple, cache.rows(read(keys("q"))).collect()))
    before = held()
    assert cache.compact() > 1 and held() == before and cache.compact() == 0
    cache.answers(keys("m"), read).collect()
    assert cache.compact() == 1 and ("m", "m?") in held() and len(held()) == len(before) + 1
    cache.answers(keys("n"), read).collect()
    assert ("n", "n?") in held() and ("a", "a?") in held()


def test_prompt(spark):
    rows = spark.createDataFrame([(0, 2, "b", "T", "two"), (0, 1, "a", "T", "one")], "query_id long, rank int, chunk_id string, title string, text string")
    assert reader.prompt_context(rows).first()["context"] == '[a] (from "T")\none\n\n[b] (from "T")\ntwo'
