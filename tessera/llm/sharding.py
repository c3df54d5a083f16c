"""Two-pass external shuffle of a corpus into shards.

Pass one scatters every record, by seeded hashes, over buckets small enough for
one task's memory; each bucket belongs to one shard. Pass two permutes each
bucket with a seeded Fisher-Yates shuffle and writes it. A record's shard
follows from its id and the number of shards alone (a jump consistent hash), so
one more shard takes rows only into itself. Within its shard a record's bucket
also depends on its place in the input, so that even one id repeated a million
times is spread over the shard's buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import documents, new_path


def jump_shard(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Jump consistent hash of 64-bit keys, for all keys at once."""
    key = keys.astype(np.uint64)
    shard = np.zeros(len(key), np.int64)
    jump = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            shard[live] = jump[live]
            key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
            jump[live] = ((shard[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
            live = live[jump[live] < n_shards]
    return shard


def _shard_of(n_shards: int):
    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_shard(keys.to_numpy().view(np.uint64), n_shards).astype(np.int32))

    return shard


def shuffle_into_shards(
    rows: DataFrame,
    key: str,
    size: F.Column | None = None,
    n_shards: int = 24,
    bucket_bytes: int = 32 << 20,
    seed: int = 17,
    grown: bool = True,
) -> DataFrame:
    """Shuffle rows into shards; returns what was written: record, shard, grown_shard, bucket, place.

    record holds the input row as a struct, so its names cannot clash. place
    counts from 0 within a bucket, in shuffled order; with_slots() turns bucket
    and place into a slot of the shard. bucket_bytes bounds what one task holds
    in memory: each shard's bytes are added up first, and it gets as many
    buckets as make each half full at the mean, so that only records of some
    tenth of a bucket or more can pass the bound, by a few of them. A shard that
    one key fills has as many buckets as its bytes need. Null keys are a key of
    their own. Empty input gives an empty table; equal rows each keep a place of
    their own. Which of the places of rows with equal keys a row gets depends on
    the order they arrive in, and so on the layout of the input; the shard
    doesn't.
    """
    spark = rows.sparkSession
    size = size if size is not None else F.lit(64)
    h = F.xxhash64(F.lit(seed), F.col(key))
    sizes = {r["shard"]: r["bytes"] or 0 for r in rows.select(_shard_of(n_shards)(h).alias("shard"), size.alias("s")).groupBy("shard").agg(F.sum("s").alias("bytes")).collect()}
    parts = [max(1, -(-2 * int(sizes.get(i, 0)) // bucket_bytes)) for i in range(n_shards)]
    first = [sum(parts[:i]) for i in range(n_shards)]
    of_shard = lambda values: F.get(F.array(*map(F.lit, values)), F.col("shard"))
    placed = rows.select(
        F.struct("*").alias("record"),
        _shard_of(n_shards)(h).alias("shard"),
        (_shard_of(n_shards + 1)(h) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.xxhash64(F.lit(seed + 1), F.col(key), F.monotonically_increasing_id()).alias("scatter"),
        h.alias("_order"),
    ).select("record", "shard", "grown_shard", F.pmod(F.col("scatter"), of_shard(parts)).cast("int").alias("bucket"), "_order")
    scattered = placed.repartitionById(sum(parts), of_shard(first) + F.col("bucket")).sortWithinPartitions("shard", "bucket", "_order")
    schema = StructType([f for f in scattered.schema.fields if f.name != "_order"] + [StructField("place", LongType())])
    path = new_path(spark, "shards")
    scattered.mapInArrow(lambda it: _fisher_yates(it, seed), schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def with_slots(written: DataFrame) -> DataFrame:
    """Columns of written rows, slot in place of bucket and place: a shard's buckets follow one another.

    Drop wide columns first, since rows meet the sizes of their buckets in a join.
    """
    by_shard = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = written.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(by_shard), F.lit(0)).alias("before"))
    return written.join(before, ["shard", "bucket"]).withColumn("slot", F.col("before") + F.col("place")).drop("before", "bucket", "place")


def _fisher_yates(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """Permute each bucket of a partition that is sorted by bucket; holds one bucket at a time."""
    held: list[pa.RecordBatch] = []
    name: tuple[int, int] | None = None

    def flush():
        table = pa.Table.from_batches(held).drop_columns(["_order"])
        order = np.arange(table.num_rows)
        np.random.Generator(np.random.PCG64([seed, *name])).shuffle(order)  # Fisher-Yates
        for i in range(0, len(order), 4096):
            part = table.take(pa.array(order[i : i + 4096]))
            part = part.append_column("place", pa.array(np.arange(i, i + part.num_rows), pa.int64()))
            yield from part.combine_chunks().to_batches()

    for batch in batches:
        shard, bucket = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "bucket"))
        cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(bucket) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if a == b:
                continue
            now = (int(shard[a]), int(bucket[a]))
            if held and now != name:
                yield from flush()
                held = []
            name = now
            held.append(batch.slice(a, b - a))
    if held:
        yield from flush()


def op6_external_shuffle(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 by the law `key`, read back from the written shards.

    Size is the UTF-8 bytes of the text plus 8; a null text counts as no bytes,
    with checksum 0.
    """
    docs = documents(spark, sf_dir).select("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    written = shuffle_into_shards(docs, "doc_id", size=size)
    text = F.col("record.text")
    return with_slots(
        written.select(
            F.col("record.doc_id").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
            F.lit("key").alias("law"),
            "shard",
            "grown_shard",
            "bucket",
            "place",
        )
    )
