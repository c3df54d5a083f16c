"""Phrase collocations by hashed bucket counts and Apriori pruning.

Texts become blocks once: per language the distinct words of some megabytes of
text, and the text as their numbers, zero between pieces. Pass k counts the
phrases of k words exactly, those alone that may be frequent: both phrases of
k - 1 words inside it are (their bitmap, Apriori), and the bucket that its hash
falls into was, in the pass before, hit often enough by phrases of that length
(the bucket bitmap, PCY; only phrases whose two shorter ones were counted are
hashed, as DHP trims). Both bitmaps are broadcast; their sizes follow the number
of words up to MOST_BITS. They only ever let too much pass, so what they let pass
is counted by the phrase itself, and counts are exact at every size.

A block counts its phrases and buckets before anything is shuffled, so a phrase
that every text holds costs one row per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import combined, documents, row_blocks, stored, text_bytes, weighted_join, word_names, word_spans

#: Fixed values of the contract: capitals to lower case, what ends a piece, what parts words.
CAPITALS, ENDS, GAPS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:!?\n\x0b\x0c\r", b" \t"

#: A byte that no UTF-8 text holds: it marks the end of a piece.
_END = b"\xff"
_TABLE = bytes.maketrans(CAPITALS + ENDS + GAPS, CAPITALS.lower() + _END * len(ENDS) + b" " * len(GAPS))

#: Bits of the bitmaps: one for so many words of the corpus, between 2**LEAST_BITS and 2**MOST_BITS (16 MB).
WORDS_A_BUCKET, LEAST_BITS, MOST_BITS = 8, 16, 27

#: Buckets whose counts a task adds up together.
RANGE_BITS = 16

_ZSTD = pa.Codec("zstd")
_PASS = "lang string, phrase string, n long, range int, buckets binary, counts binary"


def _pack(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _unpack(data: bytes) -> bytes:
    return _ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _numbers(values: np.ndarray) -> bytes:
    """32-bit integers, packed by the place of their bytes."""
    return _pack(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unnumbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unpack(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _blocks(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """One row per block and language: its number of words, its distinct words, and the texts as their numbers from 1."""
    held: dict[str, list[bytes]] = {}
    size = 0

    def flush():
        for lang, texts in held.items():
            place: dict[bytes, int] = {_END: 0}
            put = place.setdefault
            words = (_END + b" ").join(texts).translate(_TABLE).replace(_END, b" \xff ").split()
            seq = np.fromiter((put(w, len(place)) for w in words), np.uint32, len(words))
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang]), "n": pa.array([int(np.count_nonzero(seq))], pa.int64()), "words": pa.array([_pack(b" ".join(list(place)[1:]))], pa.binary()), "seq": pa.array([_numbers(seq)], pa.binary())})

    for batch in batches:
        for part in row_blocks(batch, "text", most_bytes):
            more = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if size and size + more > most_bytes:
                yield from flush()
                held, size = {}, 0
            for lang, text in zip(part.column("lang").to_pylist(), text_bytes(part.column("text")), strict=True):
                held.setdefault(lang, []).append(text)
            size += more
    yield from flush()


def _seed(lang: str) -> np.ndarray:
    data = np.frombuffer(lang.encode() + b"\x00", np.uint8)
    return word_names(data, np.array([0]), np.array([len(data)]))[0]


def _names(data: bytes) -> np.ndarray:
    array = np.frombuffer(data, np.uint8)
    return word_names(array, *word_spans(array))[0]


def _in(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bits of hashes are set; a bitmap's length is a power of two."""
    at = hashes >> np.uint64(64 - (len(bitmap) * 8).bit_length() + 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0


def _both(at: np.ndarray, n: int) -> np.ndarray:
    """Those of some places, in order, whose next place is among them too."""
    there = np.zeros(n + 1, bool)
    there[at] = True
    return at[there[at + 1]]


def _distinct(seq: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct stretches of k numbers at some places, one per row, and how often each occurs; compared by the numbers themselves."""
    used, first = np.unique(seq[at[:, None] + np.arange(k)], return_inverse=True)
    columns = first.reshape(len(at), k).astype(np.uint64)
    key, parts, radix = columns[:, 0], [], np.uint64(max(len(used), 1))
    limit = len(used)
    for j in range(1, k):
        if limit * len(used) >= 1 << 63:
            values, key = np.unique(key, return_inverse=True)
            parts.append((j, values))
            key, limit = key.astype(np.uint64), len(values)
        key, limit = key * radix + columns[:, j], limit * len(used)
    key, count = np.unique(key, return_counts=True)
    out = np.empty((len(key), k), np.int64)
    for j in range(k - 1, 0, -1):
        out[:, j], key = key % radix, key // radix
        if parts and parts[-1][0] == j:
            key = parts.pop()[1][key.astype(np.int64)]
    out[:, 0] = key
    return used[out], count


def _tally(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Bucket counts of hashes by range of buckets."""
    bucket, count = np.unique((hashes >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
    ranges = bucket >> RANGE_BITS
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(ranges)) + 1, [len(bucket)])) if len(bucket) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = bucket[a:b] & ((1 << RANGE_BITS) - 1)
        yield int(ranges[a]), _numbers(np.diff(own, prepend=0)), _numbers(count[a:b])


def _one_pass(batches: Iterator[pa.RecordBatch], k: int, longest: int, bits: int, frequent: list, buckets) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of k words that may be frequent, and bucket counts of those of k + 1; frequent and buckets are broadcast bitmaps."""
    for batch in batches:
        for i in range(batch.num_rows):
            lang = batch.column("lang")[i].as_py()
            data, seq = _unpack(batch.column("words")[i].as_py()), _unnumbers(batch.column("seq")[i].as_py()).astype(np.int64)
            words, own = data.split(), np.concatenate((np.zeros(1, np.uint64), combined(_seed(lang), _names(data))))
            alone = np.concatenate((np.zeros(1, np.uint64), _names(data)))
            at, h = np.flatnonzero(seq), np.zeros(len(seq) + 1, np.uint64)
            h[at] = own[seq[at]]
            for length in range(1, k + 1):
                if length > 1:
                    at = _both(at, len(seq))
                    h[at] = combined(h[at], alone[seq[at + length - 1]])
                if length < k:
                    at = at[_in(frequent[length - 1].value, h[at])]
                elif buckets is not None:
                    at = at[_in(buckets.value, h[at])]
            if k == 1:
                count = np.bincount(seq, minlength=len(words) + 1)[1:]
                phrases = words
            else:
                rows, count = _distinct(seq, at, k)
                phrases = [b" ".join([words[j] for j in row]) for row in (rows - 1).tolist()]
            n = len(phrases)
            if n:
                none = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(count, pa.int64()), pa.nulls(n, pa.int32()), none, none], ["lang", "phrase", "n", "range", "buckets", "counts"])
            if k < longest:
                at = _both(at, len(seq))
                tally = list(_tally(combined(h[at], alone[seq[at + k]]), bits))
                m = len(tally)
                if m:
                    yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.string()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), pa.array([t[0] for t in tally], pa.int32()), pa.array([t[1] for t in tally], pa.binary()), pa.array([t[2] for t in tally], pa.binary())], ["lang", "phrase", "n", "range", "buckets", "counts"])


def _phrase_bits(batches: Iterator[pa.RecordBatch], k: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Bucket counts of given phrases of k words, for a bitmap that holds them."""
    for batch in batches:
        langs, data = batch.column("lang").dictionary_encode(), b" ".join(text_bytes(batch.column("phrase")))
        if not batch.num_rows:
            continue
        seeds = np.concatenate([_seed(x) for x in langs.dictionary.to_pylist()])
        names = _names(data).reshape(-1, k)
        h = combined(seeds[langs.indices.to_numpy()], names[:, 0])
        for j in range(1, k):
            h = combined(h, names[:, j])
        tally = list(_tally(h, bits))
        yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in tally], pa.int32()), pa.array([t[1] for t in tally], pa.binary()), pa.array([t[2] for t in tally], pa.binary())], ["range", "buckets", "counts"])


def _ranges(batches: Iterator[pa.RecordBatch], least: int, width: int) -> Iterator[pa.RecordBatch]:
    """Bits of each range of buckets of a partition sorted by range: set where the counts add up to least."""
    now, total = None, np.zeros(width, np.int64)

    def bits():
        return pa.RecordBatch.from_pydict({"range": pa.array([now], pa.int32()), "bits": pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())})

    for batch in batches:
        for r, buckets, counts in zip(*(batch.column(c).to_pylist() for c in ("range", "buckets", "counts")), strict=True):
            if r != now:
                if now is not None:
                    yield bits()
                now, total = r, np.zeros(width, np.int64)
            total[np.cumsum(_unnumbers(buckets), dtype=np.int64)] += _unnumbers(counts)
    if now is not None:
        yield bits()


def _bitmap(tallies: DataFrame, bits: int, least: int):
    """A broadcast bitmap of the buckets with counts of least or more: 2**bits bits, whatever the number of rows."""
    spark, n = tallies.sparkSession, 1 << max(bits - RANGE_BITS, 0)
    width = 1 << min(bits, RANGE_BITS)
    ranges = tallies.select("range", "buckets", "counts").repartition(min(n, 256), "range").sortWithinPartitions("range")
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in ranges.mapInArrow(lambda it: _ranges(it, least, width), "range int, bits binary").collect():
        out[row["range"] * width // 8 :][: width // 8] = np.frombuffer(row["bits"], np.uint8)
    return spark.sparkContext.broadcast(out)


def count_phrases(docs: DataFrame, longest: int = 5, least: int = 100, lang_col: str = "lang", text_col: str = "text", block_bytes: int = 16 << 20) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to longest words with their counts of least or more, and the words of each language.

    The first table has lang, words (long: how many), phrase (words joined by a
    space) and f, the occurrences within pieces, overlaps included; the second
    has lang and n. A null language is `und`, a null text has no words, and a
    language whose texts have none is in neither table. Rows are counted as
    often as they occur; other columns are left behind.
    """
    frame = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = stored(frame.mapInArrow(lambda it: _blocks(it, block_bytes), "lang string, n long, words binary, seq binary").where("n > 0"), "blocks")
    totals = stored(blocks.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    words = totals.agg(F.sum("n")).first()[0] or 0
    bits = min(max((words // WORDS_A_BUCKET).bit_length(), LEAST_BITS), MOST_BITS)
    tables, frequent, buckets = [], [], None
    for k in range(1, longest + 1):
        own = stored(blocks.mapInArrow(lambda it, k=k, f=tuple(frequent), b=buckets: _one_pass(it, k, longest, bits, f, b), _PASS), f"pass-{k}")
        counted = own.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        tables.append(stored(counted.select("lang", F.lit(k).cast("long").alias("words"), "phrase", "f"), f"frequent-{k}"))
        if k < longest:
            buckets = _bitmap(own.where("range IS NOT NULL"), bits, least)
            frequent.append(_bitmap(tables[-1].mapInArrow(lambda it, k=k: _phrase_bits(it, k, bits), "range int, buckets binary, counts binary"), bits, 1))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out, totals


def _stretch(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, times: int = 1000, covered: int = 100, **how) -> DataFrame:
    """Phrases of 2 to longest words that occur least times or more: lang, words, phrase, a, l, r, n, score.

    a, l, r count the phrase and the two parts of the cut whose score floor(times
    * a * n / (l * r)) is lowest, of equal ones the earliest; n counts the
    language's words. Arithmetic is in decimals of 38 places. A phrase whose
    words lie contiguously inside a longer one is dropped if that one occurs at
    least covered hundredths as often, whether or not it is itself dropped.
    Nulls, repeats and names as in count_phrases; no texts give no rows.
    """
    counts, totals = count_phrases(docs, longest, least, **how)
    many = stored(counts.where("words > 1").withColumnRenamed("f", "a"), "candidates")
    size = many.count()
    spread = many.withColumn("w", F.split("phrase", " "))
    cuts = spread.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    sides = F.array(F.struct(F.lit("l").alias("side"), _stretch(F.col("w"), F.lit(1), F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), _stretch(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k")).alias("part")))
    parts = stored(cuts.select("lang", "phrase", "a", "k", F.inline(sides)), "parts")
    wanted = parts.groupBy("lang", "part").agg(F.count("*").alias("weight"))
    known = counts.select("lang", F.col("phrase").alias("part"), "f").join(wanted, ["lang", "part"])
    met = weighted_join(parts, known, ["lang", "part"], "weight", size * 2 * (longest - 1))
    # every part of a frequent phrase is frequent, so each has its count; one row per phrase, with the counts of each cut
    at = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{side}{k}")
    wide = met.groupBy("lang", "phrase").agg(F.max("a").alias("a"), *[at(k, s) for k in range(1, longest) for s in "lr"])
    per_lang = many.groupBy("lang").agg(F.count("*").alias("weight")).join(totals, "lang")
    floors = []
    for k in range(1, longest):
        left, right = F.col(f"l{k}"), F.col(f"r{k}")
        of = F.expr(f"(CAST(a * {times} AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0))) DIV (CAST(l{k} AS DECIMAL(19,0)) * CAST(r{k} AS DECIMAL(19,0)))")
        floors.append(F.when(left.isNotNull(), F.struct(of.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))))
    lowest = floors[0] if len(floors) == 1 else F.least(*floors)
    scored = weighted_join(wide, per_lang, ["lang"], "weight", size).withColumn("low", lowest)
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: _stretch(F.col("w"), i, m)))))
    within = spread.where("words > 2").select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    return kept.select("lang", F.size(F.split("phrase", " ")).cast("long").alias("words"), "phrase", "a", "low.l", "low.r", "n", "low.score")


def best(found: DataFrame, most: int = 2000) -> DataFrame:
    """Each language's first phrases by score, then a, both descending, then the phrase's bytes; with their rank.

    Two steps, so that a task ranks a bounded number of rows of a large language:
    first by language and a hash of the phrase, then what is left.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", "salt").orderBy(*order)
    few = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= most).drop("salt", "rank")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= most)


def op12_phrases(spark, sf_dir: str) -> DataFrame:
    """Each language's 2000 phrases of 2 to 5 words, of 100 occurrences or more, that stand out most."""
    return best(collocations(documents(spark, sf_dir))).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_GRAMS = " UNION ALL ".join(f"SELECT lang, {k} AS words, unnest([array_to_string(w[i : i + {k - 1}], ' ') FOR i IN range(1, len(w) - {k - 2})]) AS phrase FROM pieces WHERE len(w) >= {k}" for k in range(1, 6))

OP12_SQL = rf"""
WITH pieces AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
),
f AS (SELECT lang, words, phrase, count(*)::BIGINT AS f FROM ({_GRAMS}) GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
candidates AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1),
cuts AS (SELECT *, unnest(range(1, words)) AS k FROM candidates),
scores AS (
    SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n, (1000 * c.a::HUGEINT * t.n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
    FROM cuts c JOIN totals t USING (lang)
    JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.k], ' ')
    JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1 :], ' ')
),
low AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
within AS (
    SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer
    FROM (SELECT *, unnest(range(1, words - m + 2)) AS i FROM (SELECT *, unnest(range(2, words)) AS m FROM candidates WHERE words > 2))
    GROUP BY ALL
),
ranked AS (
    SELECT low.*, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, encode(low.phrase)) AS rank
    FROM low LEFT JOIN within USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
