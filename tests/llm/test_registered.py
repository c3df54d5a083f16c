"""The registered queries without SQL, against plain versions on the smallest tables."""

import hashlib
import math
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from conftest import SMALL
from tessera.llm import bpe, mixing
from tessera.llm.queries import queries


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()


def test_op3_finds_the_nearest(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").toPandas()
    rows = rows[[v is not None and np.isfinite(np.array(v, float)).all() and np.any(v) for v in rows["embedding"]]]
    ids, v = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = queries()["op3_anisotropic_search"](spark, SMALL).toPandas()
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        cosine = unit @ unit[q]
        best = sorted((i for i in range(len(ids)) if ids[i] != ids[q]), key=lambda i: (-cosine[i], ids[i]))[:5]
        own = got[got["query_id"] == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, len(best) + 1))
        assert (own["score"].diff().dropna() <= 1e-12).all()
        where = {int(x): i for i, x in enumerate(ids)}
        assert np.allclose(own["score"], [cosine[where[x]] for x in own["vec_id"]], atol=1e-12)
        hits, total = hits + len({int(ids[i]) for i in best} & set(own["vec_id"])), total + len(best)
    assert total and hits / total >= 0.9


def jump(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_op6_sizes_checksums_and_shards(spark, docs):
    text = dict(zip(docs["doc_id"], docs["text"], strict=True))
    got = queries()["op6_external_shuffle"](spark, SMALL).toPandas()
    assert sorted(got["doc_id"]) == sorted(docs["doc_id"]) and set(got["law"]) == {"key"}
    seed = xxhash.xxh64_intdigest(struct.pack("<i", 17), 42)
    for r in got.itertuples():
        data = (text[r.doc_id] or "").encode()
        key = xxhash.xxh64_intdigest(struct.pack("<q", r.doc_id), seed)
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
        assert (r.shard, r.grown_shard) == (jump(key, 24), jump(key, 25))
        assert r.grown_shard in (r.shard, 24)
    for _, shard in got.groupby("shard"):
        assert sorted(shard["slot"]) == list(range(len(shard)))


def plain_topics(spark, docs):
    """Topic per document, computed with dictionaries; only the places of words are Spark's."""
    words = [set((t or "").lower().replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")) - {""} for t in docs["text"]]
    every = sorted(set().union(*words))
    frame = spark.createDataFrame([(w,) for w in every], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(mixing.PLACES)).alias("p"))
    place = {r["w"]: r["p"] for r in frame.collect()}
    langs = [x if x in mixing.TARGETS["lang"] else "other" for x in docs["lang"]]
    places = [{place[w] for w in ws} for ws in words]
    centres = mixing._centres(6, 17)
    out = []
    for lang, own in zip(langs, places, strict=True):
        group = [p for x, p in zip(langs, places, strict=True) if x == lang and p]
        df = Counter(x for p in group for x in p)
        rarity = {x: math.log((len(group) + 1) / n) for x, n in df.items()}
        mass = sum(df[x] * rarity[x] for x in df)
        mean = sum((df[x] * rarity[x] * centres[:, x] for x in df), np.zeros(6)) / max(mass, 1e-300)
        score = sum((rarity[x] * (centres[:, x] - mean) for x in own), np.zeros(6))
        out.append(f"t{int(np.argmax(score.round(9)))}")
    return out


def test_op7_probabilities(spark, docs):
    got = queries()["op7_raked_mixture"](spark, SMALL).toPandas().set_index("doc_id").loc[docs["doc_id"]].reset_index()
    assert got["topic"].tolist() == plain_topics(spark, docs.reset_index(drop=True))
    assert got["n_tokens"].tolist() == [len((t or "").encode().split()) for t in docs["text"]]
    dims = ("source", "lang", "topic")
    value = lambda r, d: getattr(r, d) if getattr(r, d) in mixing.TARGETS[d] else None
    weight = Counter()
    for r in got.itertuples():
        weight[tuple(value(r, d) for d in dims)] += r.n_tokens
    total, fitted = sum(weight.values()), {c: float(n) for c, n in weight.items()}
    share = []
    for i, d in enumerate(dims):
        rest = sum(n for c, n in weight.items() if c[i] is None) / total
        there = {v: w for v, w in mixing.TARGETS[d].items()}
        given = sum(there.values())
        goal = {v: w / given * (1 - rest) for v, w in there.items()} | {None: rest}
        goal = {v: w for v, w in goal.items() if any(c[i] == v and n for c, n in weight.items())}
        share.append({v: w / sum(goal.values()) for v, w in goal.items()})
    for _ in range(1000):
        for i in range(3):
            have = Counter()
            for c, n in fitted.items():
                have[c[i]] += n
            fitted = {c: n * share[i].get(c[i], 0) * total / have[c[i]] if have[c[i]] else 0.0 for c, n in fitted.items()}
    ratio = {c: fitted[c] / n if n else 0.0 for c, n in weight.items()}
    top = max(ratio.values())
    want = [ratio[tuple(value(r, d) for d in dims)] / top for r in got.itertuples()]
    assert np.allclose(got["probability"], want, atol=1e-6)
    assert got["raking_error"].nunique() == 1
    seed = xxhash.xxh64_intdigest(struct.pack("<i", 23), 42)
    drawn = []
    for d, t in zip(docs["doc_id"], docs["text"], strict=True):
        h = xxhash.xxh64_intdigest(struct.pack("<q", d), seed)
        h = h if t is None else xxhash.xxh64_intdigest(t.encode(), h)
        drawn.append((h - 2**64 if h >= 2**63 else h) % 2**53 / 2**53)
    assert got["sampled"].tolist() == [u < p for u, p in zip(drawn, got["probability"], strict=True)]


def test_op9_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = queries()["op9_language_profiles"](spark, folder).toPandas()
    docs = spark.read.parquet(f"{folder}/documents.parquet").toPandas()
    assert sorted(got["doc_id"]) == sorted(docs["doc_id"])
    assert got["held_out"].tolist() == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got["doc_id"]]
    both = got.merge(docs, on="doc_id")
    held = both[both["held_out"] & both["lang"].notna()]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()
    blank = both[[not any(c.isalpha() for c in t or "") for t in both["text"]]]
    assert set(blank["lang_pred"]) <= {"und"}


def plain_bundle(text, vectors):
    """A text's bundle with dictionaries: letters in classes, trigrams bound letter by letter, counted and added up."""

    def letter(c):
        if "a" <= c <= "z":
            return ord(c) - 96
        return 27 + ((ord(c) * 0x9E3779B1 % 2**64) >> 7) % 37 if c.isalpha() else 0

    classes = [0]
    for c in (text or "").lower():
        if letter(c) or classes[-1]:
            classes.append(letter(c))
    classes += [0] if classes[-1] else []
    classes += [0] * (3 - len(classes))
    grams = Counter(zip(classes, classes[1:], classes[2:]))
    out = np.zeros(len(vectors[0]))
    for (a, b, c), n in grams.items():
        if a or b or c:
            out += n * np.roll(vectors[a], 2) * np.roll(vectors[b], 1) * vectors[c]
    length = np.linalg.norm(out)
    return out / length if length else out


def test_op9_row_by_row(spark, docs):
    rng = np.random.Generator(np.random.PCG64(11))
    vectors = (rng.integers(0, 2, (64, 1024)) * 2 - 1).astype(float)
    bundles = {d: plain_bundle(t, vectors) for d, t in zip(docs["doc_id"], docs["text"], strict=True)}
    own = {}
    for d, lang in zip(docs["doc_id"], docs["lang"], strict=True):
        if lang is not None and zlib.crc32(str(d).encode()) % 3 != 1:
            own.setdefault(lang, []).append(bundles[d])
    prototypes = {lang: np.sum(v, axis=0) / np.linalg.norm(np.sum(v, axis=0)) for lang, v in sorted(own.items())}
    got = {r["doc_id"]: r for r in queries()["op9_language_profiles"](spark, SMALL).collect()}
    assert len(got) == len(docs)
    for d in docs["doc_id"]:
        cosine = {lang: float(bundles[d] @ p) for lang, p in prototypes.items()}
        if not bundles[d].any():
            assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0)
            continue
        assert cosine[got[d]["lang_pred"]] >= max(cosine.values()) - 1e-5
        assert abs(got[d]["score"] - max(0.0, max(cosine.values()))) < 1e-4


def test_op10_digests(spark, docs):
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in queries()["op10_byte_bpe"](spark, SMALL).collect()}
    assert len(got) == len(docs)
    for d, t in zip(docs["doc_id"], docs["text"], strict=True):
        ids = library.encode_ordinary(t or "")
        assert got[d]["n_tokens"] == len(ids)
        assert got[d]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
