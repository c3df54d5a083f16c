"""Token counts from pre-token frequencies, without materialising ids.

Documents are cut into pre-tokens at ASCII white space. White space never
reaches a token of the vocabulary and stops its normaliser and its own splitter
from looking across, so each such run is a closed unit for the library. Pieces
are counted once for every distinct pre-token of the corpus and joined to the
frequencies in each document.

So that the join is not one row per word of each document, documents form
blocks of bounded size: a block lists its distinct pre-tokens once and keeps,
for each document, positions in that list with frequencies. A block is what one
task reads in a row, so its size doesn't grow with the input, and a frequent
word has one row per block, not one per document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, row_blocks, stored, text_bytes

#: Rows of counts that a task holds before it packs them by block.
PACK = 500_000

#: Bits of a block's number that count within a partition (16,000 blocks of 16 MB are 260 GB); 21 are left for partitions, 28 for words of a block.
BLOCK_BITS = 14

_ZSTD = pa.Codec("zstd")


def squeeze(values: np.ndarray) -> bytes:
    """32-bit integers as bytes: the four bytes of all values one after the other, compressed; length first."""
    raw = np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def unsqueeze(data: bytes) -> np.ndarray:
    raw = _ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").ravel()


_TOKENIZERS: dict[str, object] = {}


def piece_counter(path: str, definition):
    """A function from pre-tokens to piece counts, as the library of the file has them, one per worker."""
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_buffer(definition.value)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _TOKENIZERS[path] = lambda words: [len(x) for x in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
    return _TOKENIZERS[path]


def _blocks(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """One row per block: the ids and sizes of its documents, their vectors end to end, its distinct pre-tokens."""
    number = TaskContext.get().partitionId() << BLOCK_BITS
    held, size = [], 0

    def flush():
        nonlocal number
        table = pa.Table.from_batches(held).combine_chunks()
        place: dict[bytes, int] = {}
        which, freq, n, sizes = [], [], [], []
        for text in text_bytes(table.column("text")):
            count = Counter((text or b"").split())
            at = np.fromiter((place.setdefault(w, len(place)) for w in count), np.int32, len(count))
            order = np.argsort(at)
            which.append(np.diff(at[order], prepend=np.int32(0)))
            freq.append(np.fromiter(count.values(), np.int32, len(count))[order])
            n.append(len(count))
            sizes.append(len(text or b""))
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
        whole = lambda arrays: np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
        words = pa.array(list(place), pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_pydict(
            {
                "block": pa.array([number], pa.int64()),
                "ids": pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column("id").chunk(0) if table.num_rows else pa.array([], table.schema.field("id").type)),
                "sizes": one(sizes, pa.int64()),
                "n": one(n, pa.int32()),
                "which": pa.array([squeeze(whole(which))], pa.binary()),
                "freq": pa.array([squeeze(whole(freq))], pa.binary()),
                "words": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
            }
        )
        number += 1
        if number & ((1 << BLOCK_BITS) - 1) == 0:
            raise ValueError("too many blocks in a partition; raise block_bytes or read smaller partitions")

    for batch in batches:
        for part in row_blocks(batch, "text", most_bytes):
            more = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if held and size + more > most_bytes:
                yield from flush()
                held, size = [], 0
            held.append(part)
            size += more
    if held:
        yield from flush()


def _count(batches: Iterator[pa.RecordBatch], path: str, definition) -> Iterator[pa.RecordBatch]:
    """Pieces of each distinct pre-token of a partition sorted by pre-token: each is counted once."""
    count = piece_counter(path, definition)
    last, pieces = None, 0
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        coded = batch.column("word").dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if not distinct:
            continue
        counts = [pieces] if distinct[0] == last else []
        for a in range(len(counts), len(distinct), 2000):
            counts += count(distinct[a : a + 2000])
        last, pieces = distinct[-1], counts[-1]
        held.append((batch.column("at").to_numpy(), np.array(counts, np.int32)[coded.indices.to_numpy()]))
        if sum(len(x) for x, _ in held) >= PACK:
            yield _packed(held)
            held = []
    if held:
        yield _packed(held)


def _packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """One row per block: places in order (as differences) and their counts."""
    at, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(at)
    at, n = at[order], n[order]
    block = at >> 28
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(at)]))
    rows = [(int(block[a]), squeeze(np.diff((at[a:b] & 0xFFFFFFF).astype(np.int32), prepend=np.int32(0))), squeeze(n[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["block", "places", "pieces"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c).slice(i, 1).flatten() for c in ("ids", "sizes", "n")}
            which, freq = (unsqueeze(batch.column(c)[i].as_py()) for c in ("which", "freq"))
            counted = [(np.cumsum(unsqueeze(x["places"])), unsqueeze(x["pieces"])) for x in batch.column("counted")[i].as_py()]
            pieces = np.zeros(sum(len(x) for x, _ in counted), np.int64)
            for places, n in counted:
                pieces[places] = n
            n = row["n"].to_numpy()
            ends = np.cumsum(n, dtype=np.int64)
            # places were kept as differences within each document
            steps = np.cumsum(which, dtype=np.int64)
            before = np.concatenate(([0], steps))[ends - n]
            each = pieces[steps - np.repeat(before, n)] * freq
            total = np.concatenate(([0], np.cumsum(each)))
            sums = total[ends] - total[np.concatenate(([0], ends[:-1]))]
            yield pa.RecordBatch.from_arrays([row["ids"], row["sizes"], pa.array(sums, pa.int64())], ["id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """Per row: id, n_bytes (UTF-8) and n_tokens of the whole text by the library of the file.

    A null text counts as empty: 0 bytes, 0 tokens. Rows with equal ids stay
    rows of their own; other columns are left behind. The vocabulary file has a
    fixed size and is broadcast. For a sentencepiece model white space matters,
    so this cut at white space holds for tokenizers that drop it; such a model
    is refused.
    """
    if path.endswith(".model"):
        raise ValueError("this cut at white space needs a tokenizer that drops white space")
    spark = docs.sparkSession
    with open(path, "rb") as f:
        definition = spark.sparkContext.broadcast(f.read())
    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = frame.schema["id"].dataType.simpleString()
    blocks = stored(
        frame.mapInArrow(
            lambda it: _blocks(it, block_bytes),
            f"block long, ids array<{kind}>, sizes array<long>, n array<int>, which binary, freq binary, words array<string>",
        ),
        "blocks",
    )
    words = blocks.select("block", F.posexplode("words").alias("place", "word")).select((F.shiftleft("block", 28) + F.col("place")).alias("at"), "word")
    counted = (
        words.repartition("word")
        .sortWithinPartitions("word")
        .mapInArrow(lambda it: _count(it, path, definition), "block long, places binary, pieces binary")
        .groupBy("block")
        .agg(F.collect_list(F.struct("places", "pieces")).alias("counted"))
    )
    none = F.array().cast("array<struct<places:binary,pieces:binary>>")
    return (
        blocks.drop("words")
        .join(counted, "block", "left")
        .withColumn("counted", F.coalesce("counted", none))
        .mapInArrow(_sums, f"id {kind}, n_bytes long, n_tokens long")
        .withColumnRenamed("id", id_col)
    )


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every whole document, and whether they exceed 2048."""
    import public_tokenizers as P

    out = count_tokens(documents(spark, sf_dir), P.path("word_bpe_49k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)
