"""Helpers that the operators share: scratch tables in the shared folder, Arrow batches."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word of the contracts: a run of characters other than ASCII white space.
SPACE = "\\x20\\x09-\\x0D"


#: Bytes of an Arrow batch, unless the session says otherwise: Spark's own 64 MB lie several times in a task's memory, in the JVM and in Python.
BATCH = 16 << 20


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode with none set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        base = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}/{name}"


#: Lists that take the paths of scratch tables, innermost last; see scratch().
_SCOPES: list[list[str]] = []


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Lists the scratch tables of the calls inside, for release() once their results are written."""
    held: list[str] = []
    _SCOPES.append(held)
    try:
        yield held
    finally:
        _SCOPES.remove(held)


def release(spark: SparkSession, held: list[str]) -> None:
    """Delete the scratch tables of a list, and only those."""
    for path in held:
        _delete(spark, path)
    held.clear()


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of what runs inside as soon as it has run; else they lie there until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it: cuts lineage, survives lost executors, and leaves no shuffle files."""
    path = new_path(df.sparkSession, name)
    for held in _SCOPES:
        held.append(path)
    small_batches(df.sparkSession)
    with shuffles_end(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


#: A key with more than one of so many rows of a join's left side is joined by broadcast: there are at most as many.
HEAVY = 1000


def weighted_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """left joined to right, which has one row per key and, in weight, how many rows of left have the key.

    Keys with more than total / HEAVY rows of left, total being at least the
    rows of left, number fewer than HEAVY: these rows of right are broadcast, so
    no key's rows meet in one task. The others are joined as usual. how is inner
    or left; keys must not be null for an inner join to find them.
    """
    many = F.col(weight) * HEAVY > total
    heavy, light = right.where(many).drop(weight), right.where(~many).drop(weight)
    keys = F.broadcast(heavy.select(*on))
    return left.join(F.broadcast(heavy), on).unionByName(left.join(keys, on, "left_anti").join(light, on, how))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(table: DataFrame) -> None:
    """Delete a stored table once everything made from it is stored itself."""
    _delete(table.sparkSession, table._scratch)


def narrowed(table: DataFrame, name: str, *columns: str) -> DataFrame:
    """Some columns of a stored table as a stored table of their own; the wide one goes."""
    out = stored(table.select(*columns), name)
    discard(table)
    return out


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """UTF-8 of each text of an Arrow column, without decoding it first."""
    return column.cast(pa.large_binary()).to_pylist()


def row_blocks(batch: pa.RecordBatch, column: str, most_bytes: int):
    """Cut a batch into runs of rows whose texts hold at most so many bytes (a longer text stands alone)."""
    sizes = np.array([0 if x is None else x for x in _lengths(batch.column(column))], dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _lengths(column):
    import pyarrow.compute as pc

    return pc.binary_length(column).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of unsigned 64-bit integers (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


#: Keys that a task looks at together before a shuffle.
CHUNK = 1 << 20


def grouped(rows: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Rows (key, node, ...) sorted by key and node, once each; first row and length of each key."""
    order = np.lexsort((rows[1], rows[0]))
    rows = [x[order] for x in rows]
    fresh = np.concatenate(([True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])))[: len(order)]
    rows = [x[fresh] for x in rows]
    start = np.flatnonzero(np.concatenate(([True], rows[0][1:] != rows[0][:-1]))[: len(rows[0])])
    return rows, start, np.diff(np.concatenate((start, [len(rows[0])])))


def places(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row (key, node), as they stand: whether it is the first of its kind, and how many other nodes of the key come before."""
    order = np.lexsort((node, key))
    k, n = key[order], node[order]
    new_key = np.concatenate(([True], k[1:] != k[:-1]))[: len(k)]
    fresh = new_key | np.concatenate(([True], n[1:] != n[:-1]))[: len(k)]
    count = np.cumsum(fresh)
    start = np.flatnonzero(new_key)
    place = count - np.repeat(count[start], np.diff(np.concatenate((start, [len(k)]))))
    out = np.empty(len(k), bool), np.empty(len(k), np.int64)
    out[0][order], out[1][order] = fresh, place
    return out


def combined(x: np.ndarray, y: np.ndarray, salt: int = 0) -> np.ndarray:
    """One value from two, in this order; not linear in either, so patterns in the input don't cancel out."""
    with np.errstate(over="ignore"):
        return mix64(x * np.uint64(0x9E3779B97F4A7C15) + mix64(y + np.uint64((salt * 0xD6E8FEB86659FD93 + 0x632BE59BD9B4E019) % 2**64)))


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit names of byte ranges of a buffer, as two arrays of 64 bits.

    Words of up to 16 bytes go through a permutation of 128 bits that depends on
    their length, so two of a length never share a name; longer ones get the
    128-bit BLAKE2b of their bytes. The same on every machine.
    """
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    padded = np.concatenate((data, np.zeros(24, np.uint8)))
    eights = np.ndarray(len(padded) - 7, "<u8", padded.data, strides=(1,))
    n = ends - starts
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    x = eights[starts] & masks[np.minimum(n, 8)]
    y = eights[np.minimum(starts + 8, len(eights) - 1)] & masks[np.clip(n - 8, 0, 8)]
    with np.errstate(over="ignore"):
        x ^= mix64(y + n.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        y ^= mix64(x + np.uint64(0xE7037ED1A0B428DB))
        x ^= mix64(y + np.uint64(0x8EBC6AF09C88C6E3))
        y ^= mix64(x + np.uint64(0x589965CC75374CC3))
    for i in np.flatnonzero(n > 16):
        digest = hashlib.blake2b(data[starts[i] : ends[i]], digest_size=16).digest()
        x[i], y[i] = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little")
    return x, y


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of bytes other than ASCII white space."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def unused(columns: list[str], *names: str) -> list[str]:
    """Names for columns of an operator's own: those given, with underscores added until no column of the caller's has them."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def spread_join(left: DataFrame, right: DataFrame, on: list[str], value: str, hot: DataFrame) -> DataFrame:
    """left with the value column that right has for its key, null where it has none; left is gone through once.

    hot: the keys, fewer than HEAVY of them, that many rows of left have, with
    their value, null where right lacks them. These are looked up in a
    broadcast; in the join with the rest of right such rows have a key of their
    own each, as do those with a null key, so that no key's rows meet in one task.
    """
    names = unused([*left.columns, *right.columns], "__there", "__hot", "__key", *[f"__on{i}" for i in range(len(on))], *[f"__at{i}" for i in range(len(on))], "__cold")
    there, found, key, cold = names[0], names[1], names[2], names[-1]
    ons, ats = names[3 : 3 + len(on)], names[3 + len(on) : -1]
    known = hot.select(*[F.col(c).alias(n) for c, n in zip(on, ons, strict=True)], F.col(value).alias(found), F.lit(True).alias(there))
    same = [F.col(c) == F.col(n) for c, n in zip(on, ons, strict=True)]
    looked = left.join(F.broadcast(known), same, "left").drop(*ons)
    # the last column of the key is binary: what stands in for it is too short to be one
    alone = F.col(there).isNotNull() | F.col(on[-1]).isNull()
    looked = looked.withColumn(key, F.when(alone, F.encode(F.monotonically_increasing_id().cast("string"), "UTF-8")).otherwise(F.col(on[-1])))
    rest = right.select(*[F.col(c).alias(n) for c, n in zip(on, ats, strict=True)], F.col(value).alias(cold))
    met = looked.join(rest, [F.col(c) == F.col(n) for c, n in zip([*on[:-1], key], ats, strict=True)], "left").drop(*ats)
    return met.withColumn(value, F.coalesce(F.col(found), F.col(cold))).drop(there, found, key, cold)


def row_name(id_col: str, text_col: str):
    """A 128-bit name of a row's id and text, to tell apart rows that share an id; nulls have names of their own."""
    text = lambda c: F.concat(F.when(F.col(c).isNull(), "0").otherwise("1"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return F.unhex(F.md5(F.concat(text(id_col), F.lit("\x00"), text(text_col))))
