"""Rewriting data files whose schemas have drifted, matched by field id.

Rows get their ranks from a range-partitioned sort: each partition is sorted and
counted, the counts are added up, and a row's rank is what stands before its
partition plus its place within. Ranks deal rows into files, each written by one
task as its rows arrive. For the rewrite, too, a task owns one file: columns are
taken by field id, renamed, cast, put in order, made up where they are missing,
and the replacement takes the file's place once it is complete. Files that have
the schema already are left alone.

A task that runs again finds either the file as it was or its replacement, whole;
both give the same replacement. What a file was before is read and stored first.
"""

from __future__ import annotations

import hashlib
import math
import posixpath
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import new_path, stored

FIELD_ID = b"PARQUET:field_id"

#: Rows that a task holds of a file at once.
BATCH = 1 << 16


def ranked(rows: DataFrame, keys: list[Column], parts: int | None = None, name: str = "rank") -> DataFrame:
    """Rows with their rank from 0 in the order of keys, in a column of the given name; stored.

    Rows of equal keys are ordered by a hash of all their columns, so that a key
    with many rows is spread over partitions; those that are equal throughout
    have ranks next to each other. Nulls come first. parts, the session's number
    of shuffle partitions if not given, is the number of sorted partitions and
    thus of the counts that are added up, whatever the number of rows. The
    caller's columns travel in a struct, so their names cannot clash.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = rows.select(F.struct("*").alias("row"), *[k.alias(f"k{i}") for i, k in enumerate(keys)], F.xxhash64("*").alias("tie"))
    order = [F.asc_nulls_first(f"k{i}") for i in range(len(keys))] + [F.asc("tie")]
    # the id that Spark gives a row is its partition's number and, in 33 bits, its place there
    at = F.monotonically_increasing_id()
    placed = stored(held.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("row", at.alias("at")), "sorted")
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # one row per sorted partition
    met = placed.withColumn("part", part).join(F.broadcast(before), "part")
    return met.select("row.*", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias(name))


def with_field_ids(schema: pa.Schema) -> pa.Schema:
    """Nullable fields of the same names and types with field ids from 1."""
    return pa.schema([pa.field(f.name, f.type, True, {FIELD_ID: str(i).encode()}) for i, f in enumerate(schema, 1)])


def field_id(field: pa.Field) -> int | None:
    at = (field.metadata or {}).get(FIELD_ID)
    return None if at is None else int(at)


def _same(a: pa.Schema, b: pa.Schema) -> bool:
    return [(f.name, f.type, f.nullable, field_id(f)) for f in a] == [(f.name, f.type, f.nullable, field_id(f)) for f in b]


def _store(path: str):
    """The file system of a path and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def _publish(path: str, staging: str, write: Callable) -> None:
    """Write a file in the staging folder and then put it in its place, over what is there."""
    store, at = _store(path)
    _, folder = _store(staging)
    name = posixpath.basename(at)
    draft, whole = f"{folder}/{name}.{uuid.uuid4().hex}", f"{folder}/{name}"
    store.create_dir(folder, recursive=True)
    store.create_dir(posixpath.dirname(at), recursive=True)
    write(store, draft)
    _move(store, draft, whole)
    _move(store, whole, at)


def _move(store, a: str, b: str) -> None:
    try:
        store.move(a, b)
    except OSError:  # stores that don't move onto a file
        store.delete_file(b)
        store.move(a, b)


def _restore(path: str, staging: str) -> None:
    """Where a file went missing between deletion and move, its complete replacement takes its place."""
    from pyarrow import fs

    store, at = _store(path)
    whole = f"{_store(staging)[1]}/{posixpath.basename(at)}"
    if store.get_file_info(at).type == fs.FileType.NotFound and store.get_file_info(whole).type == fs.FileType.File:
        store.move(whole, at)


def write_files(rows: DataFrame, file_no: str, order: str, n_files: int, path_of: Callable[[int], str], staging: str, shape: Callable[[int], tuple[pa.Schema, Callable[[pa.RecordBatch], pa.RecordBatch]]]) -> DataFrame:
    """One Parquet file per number in file_no, rows in the order given; returns file_no and path, stored.

    n_files is larger than every number. shape gives, for a number, the file's
    schema and a function that turns batches of rows (without file_no and order)
    into batches of it. A task owns a file and writes batches as they come; the
    file appears under its path when it is complete. No rows give no files.
    """
    dealt = rows.repartitionById(max(n_files, 1), F.col(file_no).cast("int")).sortWithinPartitions(file_no, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        number = first.column(file_no)[0].as_py()
        path, (schema, change) = path_of(number), shape(number)

        def write(store, at):
            with store.open_output_stream(at) as f, pq.ParquetWriter(f, schema, compression="zstd") as out:
                for b in chain((first,), batches):
                    out.write_batch(change(b.drop_columns([file_no, order])))

        _publish(path, staging, write)
        yield pa.RecordBatch.from_pydict({"file_no": pa.array([number], pa.int64()), "path": pa.array([path])})

    return stored(dealt.mapInArrow(run, "file_no long, path string"), "files")


def rebuilt(batch: pa.RecordBatch, schema: pa.Schema, missing: dict[int, object]) -> pa.RecordBatch:
    """A batch in another schema, matched by field id; ids that it lacks get the value in missing, else null. Nulls stay, casts may lose digits."""
    by_id = {i: n for n, f in enumerate(batch.schema) if (i := field_id(f)) is not None}
    columns = []
    for f in schema:
        i = field_id(f)
        if i in by_id:
            columns.append(batch.column(by_id[i]).cast(f.type, safe=False))
        else:
            columns.append(pa.repeat(pa.scalar(missing.get(i), f.type), batch.num_rows))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def survey(files: DataFrame, schema: pa.Schema) -> DataFrame:
    """Files (a column path and others) with start_columns, the names in order, and drifted, whether the schema is another; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                store, at = _store(path)
                with store.open_input_file(at) as f:
                    found.append(pq.read_schema(f))
            more = [pa.array([",".join(s.names) for s in found], pa.string()), pa.array([not _same(s, schema) for s in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "start_columns", "drifted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return stored(files.mapInArrow(run, f"{kinds}, start_columns string, drifted boolean"), "survey")


def rewrite_files(files: DataFrame, schema: pa.Schema, missing: dict[int, object], staging: str, n_files: int) -> DataFrame:
    """Bring every file of a table (columns file_no and path) to a schema with field ids, in place.

    Columns are matched by field id alone; those a file lacks get the value that
    missing has for their id, and other columns of the file go. Rows keep their
    order, nulls stay. A file that has the schema is not written. Returns, per
    file, file_no, path, start_columns, rewritten, columns, n_rows, n_nulls,
    ids_sha256 (the first column's values, comma-joined) and rows_sha256 (see
    digest), both of the file as it is afterwards. A task owns one file and
    streams it. file_no is below n_files and names a file once. No files give
    no rows.
    """
    known = survey(files.select("file_no", "path"), schema)
    dealt = known.repartitionById(max(n_files, 1), F.col("file_no").cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["drifted"]:
                    _restore(row["path"], staging)
                    store, at = _store(row["path"])

                    def write(store, draft, at=at):
                        with store.open_input_file(at) as f, store.open_output_stream(draft) as g, pq.ParquetWriter(g, schema, compression="zstd") as out:
                            for b in pq.ParquetFile(f).iter_batches(BATCH):
                                out.write_batch(rebuilt(b, schema, missing))

                    _publish(row["path"], staging, write)
                yield pa.RecordBatch.from_pylist([{k: row[k] for k in ("file_no", "path", "start_columns")} | {"rewritten": row["drifted"]} | digest(row["path"])])

    return dealt.mapInArrow(run, "file_no long, path string, start_columns string, rewritten boolean, columns string, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string")


#: Doubles are written as the integers below so many times their value.
SCALE = 1048576


def _text(column: pa.Array) -> pa.Array:
    """Values as text: null as ?, times as microseconds, floating numbers as floor(SCALE * value); those that aren't finite keep their names."""
    if pa.types.is_timestamp(column.type):
        column = column.cast(pa.timestamp("us", column.type.tz), safe=False).cast(pa.int64())
    elif pa.types.is_floating(column.type):
        column = pa.array([None if x is None else str(math.floor(x * SCALE)) if math.isfinite(x) else str(x) for x in column.cast(pa.float64()).to_pylist()], pa.string())
    return pc.fill_null(column.cast(pa.string()), "?")


def digest(path: str) -> dict[str, object]:
    """Column names, rows, nulls and two digests of a file, read in batches: of the first column's values, comma-joined, and of the rows, joined by newlines, their fields by |."""
    store, at = _store(path)
    ids, lines, rows, nulls = hashlib.sha256(), hashlib.sha256(), 0, 0
    with store.open_input_file(at) as f:
        file = pq.ParquetFile(f)
        names = file.schema_arrow.names
        for batch in file.iter_batches(BATCH):
            if not batch.num_rows:
                continue
            texts = [_text(c) for c in batch.columns]
            ids.update(("," * bool(rows) + ",".join(texts[0].to_pylist())).encode())
            lines.update(("\n" * bool(rows) + "\n".join(pc.binary_join_element_wise(*texts, "|").to_pylist())).encode())
            rows += batch.num_rows
            nulls += sum(c.null_count for c in batch.columns)
    return {"columns": ",".join(names), "n_rows": rows, "n_nulls": nulls, "ids_sha256": ids.hexdigest(), "rows_sha256": lines.hexdigest()}


# -- the drift of op13

#: Fixed values of the contract: the clients' columns in order, how files are dealt and versioned, what missing columns become.
CLIENTS = ["client_id", "master_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance"]
FILES, VERSIONS, LAST_VERSION = 500, 24, 15
MISSING = {"nation_id": -1, "source": "none"}
SWAPPED, REVERSED, LACKING, NARROW = 1, 2, 4, 8


def version_of(file_no: int) -> int:
    v = zlib.crc32(f"42:{file_no}".encode()) % VERSIONS
    return v if v <= LAST_VERSION else 0


def drifted(schema: pa.Schema, version: int) -> pa.Schema:
    """The schema of a file of a version; field ids stay with their columns."""
    fields = [f for f in schema if not (version & LACKING and f.name in MISSING)]
    if version & REVERSED:
        fields = [fields[0], *fields[:0:-1]]
    if version & NARROW:
        narrow = {"balance": pa.float32(), "nation_id": pa.int32()}
        fields = [f.with_type(narrow.get(f.name, f.type)) for f in fields]
    if version & SWAPPED:
        other = {"name": "email", "email": "name"}
        fields = [f.with_name(other.get(f.name, f.name)) for f in fields]
    return pa.schema(fields)


def evolved_clients(clients: DataFrame) -> pa.Schema:
    schema = with_field_ids(to_arrow_schema(clients.select(*CLIENTS).schema))
    at = schema.get_field_index("nation_id")
    return schema.set(at, schema.field(at).with_type(pa.int64()))


def op13_schema_rewrite(spark, sf_dir: str) -> DataFrame:
    """The clients, sorted by a checksum, as some 500 files of drifted schemas, and these rewritten to the evolved one."""
    clients = spark.read.parquet(f"{sf_dir}/clients.parquet").select(*CLIENTS)
    total = clients.count()
    each = 1 + total // FILES
    n_files = -(-total // each)
    rows = ranked(clients, [F.crc32(F.col("client_id").cast("string")), F.col("client_id")])
    rows = rows.withColumn("file_no", F.expr(f"rank DIV {each}"))
    schema = evolved_clients(clients)
    folder = new_path(spark, "clients")
    staging = f"{posixpath.dirname(folder)}/staging"

    def shape(number: int):
        own = drifted(schema, version_of(number))
        return own, lambda batch: rebuilt(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema, strict=True)], schema=schema), own, {})

    files = write_files(rows, "file_no", "rank", n_files, lambda n: f"{folder}/part-{n:05d}.parquet", staging, shape)
    done = rewrite_files(files, schema, {field_id(schema.field(n)): v for n, v in MISSING.items()}, staging, n_files)
    version = F.pmod(F.crc32(F.concat(F.lit("42:"), F.col("file_no").cast("string"))), F.lit(VERSIONS))
    return done.select("file_no", F.when(version <= LAST_VERSION, version).otherwise(F.lit(0)).cast("long").alias("version"), "n_rows", "n_nulls", "ids_sha256", "rows_sha256", "start_columns", "columns", "path", "rewritten")
