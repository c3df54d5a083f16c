"""Tables and small files of the engine, read and written by Spark so that they can lie in any store."""

from __future__ import annotations

import json
import warnings
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import retrieval
from ..operators.calibrate import Policy, _strict

# fixed values: the fields of a manifest record and of a chunk
MANIFEST = "arxiv_id string, title string, pdf_path string, authors array<string>, published string, categories array<string>, summary string"
CHUNK = "chunk_id string, doc_id string, title string, chunk_index int, text string, char_start int, char_end int, page_start int"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One plain file, wherever the session's file systems reach."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(f"{text}\n".encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect()).rstrip("\n")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON-lines manifest; of lines with one id the last counts. No file, no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], MANIFEST)
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0).withColumn("line", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    rows = lines.select("line", F.from_json("value", MANIFEST, {"mode": "FAILFAST"}).alias("r")).select("line", "r.*")
    w = Window.partitionBy("arxiv_id").orderBy(F.col("line").desc())
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "line")


def merge_manifest(old: DataFrame, new: DataFrame, path: str) -> None:
    """Write the union of two manifests, new records in place of old ones, in order of id."""
    w = Window.partitionBy("arxiv_id").orderBy(F.desc("fresh"))
    both = old.withColumn("fresh", F.lit(0)).unionByName(new.withColumn("fresh", F.lit(1)), allowMissingColumns=True)
    rows = both.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "fresh")
    rows.orderBy("arxiv_id").coalesce(1).write.mode("overwrite").json(path)


def pending(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """What hasn't been fetched yet."""
    return wanted.join(manifest.select("arxiv_id"), "arxiv_id", "left_anti")


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.select(*[c.split()[0] for c in CHUNK.split(", ")]).write.mode("overwrite").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK).option("mode", "FAILFAST").json(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors (pos, vec), and beside them how many there are and of what dimension; ValueError if dimensions differ.

    A vector without entries has any dimension.
    """
    rows = vectors.select("pos", "vec")
    rows.write.mode("overwrite").parquet(path)
    n, least, most = _shape(rows.sparkSession.read.parquet(path))
    if least != most:
        raise ValueError(f"vectors of {least} and of {most} dimensions")
    write_text(rows.sparkSession, json.dumps({"vectors": n, "dims": most}), f"{path}.json")


def _shape(rows: DataFrame) -> tuple[int, int | None, int | None]:
    size = F.when(F.size("vec") > 0, F.size("vec"))
    return tuple(rows.agg(F.count("*"), F.min(size), F.max(size)).first())


def read_vectors(spark: SparkSession, path: str, dims: int | None = None, count: int | None = None) -> DataFrame:
    """Vectors as they were written; ValueError if their number or dimension isn't what was written, or what the caller expects."""
    rows = spark.read.schema("pos long, vec array<float>").parquet(path)
    n, least, most = _shape(rows)
    told = json.loads(read_text(spark, f"{path}.json"))
    for what, here, there in (("vectors", n, told["vectors"]), ("dimensions", most, told["dims"]), ("dimensions", least, told["dims"]), ("vectors", n, count), ("dimensions", most, dims)):
        if there is not None and here is not None and here != there:
            raise ValueError(f"the index holds {here} {what}, not {there}")
    return rows


def duplicate_ids(rows: DataFrame, id_col: str = "chunk_id", shown: int = 5) -> DataFrame:
    """The first ids that occur more than once, with how often."""
    return rows.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").orderBy(id_col).limit(shown)


@dataclass
class RetrieverConfig:
    embedder: str = "hashing-256"
    dims: int = 256
    rrf_k: int = 60
    pool: int = 50
    weights: tuple[float, float] = (1.0, 1.0)
    k1: float = 1.5
    b: float = 0.75
    num_chunks: int = 0


def save_retriever(chunks: DataFrame, path: str, config: RetrieverConfig | None = None) -> RetrieverConfig:
    """Chunks (with pos), hashed vectors, BM25 tables and the configuration, as a folder of tables."""
    spark = chunks.sparkSession
    twice = [r[0] for r in duplicate_ids(chunks).collect()]
    if twice:
        raise ValueError(f"duplicate chunk ids: {twice}")
    config = config or RetrieverConfig()
    config.num_chunks = chunks.count()
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    # the texts are tokenised once, and all tables come from that
    index = retrieval.build_index(chunks.select("pos", "text"), config.dims)
    index.bags.select("pos", F.explode(F.arrays_zip("at", "w")).alias("x")).select("pos", F.col("x.at").alias("bucket"), F.col("x.w").alias("weight")).write.mode("overwrite").parquet(f"{path}/vectors")
    # postings lie where the join with their token's idf leaves them
    index.postings(config.k1, config.b).sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/postings")
    index.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
    index.rows.select("pos", F.size("d").cast("long").alias("dl")).write.mode("overwrite").parquet(f"{path}/lengths")
    write_text(spark, json.dumps(asdict(config), sort_keys=True), f"{path}/config")
    return config


def load_retriever(spark: SparkSession, path: str, embedder: str = "hashing-256") -> tuple[DataFrame, retrieval.Bm25Index, RetrieverConfig]:
    """(chunks, BM25 index, configuration). Another embedder gives a warning, missing chunks an error."""
    config = RetrieverConfig(**json.loads(read_text(spark, f"{path}/config")))
    config.weights = tuple(config.weights)
    if config.embedder != embedder:
        warnings.warn(f"the index was built with {config.embedder}, not {embedder}", stacklevel=2)
    chunks = spark.read.parquet(f"{path}/chunks")
    if chunks.count() != config.num_chunks:
        raise ValueError("the number of stored chunks doesn't match the configuration")
    index = retrieval.Bm25Index(*[spark.read.parquet(f"{path}/{t}") for t in ("postings", "vocabulary", "lengths")])
    return chunks, index, config


def save_policy(spark: SparkSession, policy: Policy, path: str) -> None:
    write_text(spark, policy.to_json(), path)


def load_policy(spark: SparkSession, path: str) -> Policy:
    return Policy.from_json(read_text(spark, path))


def write_report(spark: SparkSession, report: dict, path: str, title: str) -> None:
    """A report as strict JSON and as Markdown beside it."""
    strict = _strict(report)
    write_text(spark, json.dumps(strict, indent=2, sort_keys=True, ensure_ascii=False), f"{path}.json")
    write_text(spark, markdown(strict, title), f"{path}.md")


def cell(value, digits: int = 3) -> str:
    if value is None:
        return "n/a"
    if isinstance(value, float):
        return f"{value:.{digits}f}"
    return markdown_safe(str(value))


def markdown_safe(text: str, limit: int = 120) -> str:
    flat = " ".join(text.split()).replace("|", "\\|")
    return flat if len(flat) <= limit else f"{flat[: limit - 1]}…"


def markdown(report: dict, title: str) -> str:
    """Tables of a report: lists of records become tables, the rest a list."""
    out = [f"# {title}", ""]
    for name, value in report.items():
        out += [f"## {name}", ""]
        if isinstance(value, list) and value and isinstance(value[0], dict):
            head = list(value[0])
            out += ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
            out += ["| " + " | ".join(cell(r.get(h)) for h in head) + " |" for r in value]
        else:
            out.append(cell(value) if not isinstance(value, dict) else "\n".join(f"- {k}: {cell(v)}" for k, v in value.items()))
        out.append("")
    return "\n".join(out)


def row_digest(*columns: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in columns]), 256)


def fingerprint(rows: DataFrame, order: str, columns: list[str], blocks: int = 4096) -> DataFrame:
    """One row: digest and n. Row digests in order form blocks, block digests form the digest.

    A block holds consecutive orders (by value // blocks), so no task gathers
    the whole table.
    """
    each = rows.select((F.col(order).cast("long") / blocks).cast("long").alias("block"), F.struct(F.col(order).alias("o"), row_digest(*columns).alias("d")).alias("x"))
    joined = each.groupBy("block").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["d"]), "").alias("t"), F.count("*").alias("n"))
    parts = joined.select("block", "n", F.sha2("t", 256).alias("d"))
    # blocks of blocks, while there are more than a task should gather
    count = rows.count() // blocks
    while count > blocks:
        parts = parts.groupBy((F.col("block") / blocks).cast("long").alias("block")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "d"))), lambda x: x["d"]), ""), 256).alias("d"))
        count //= blocks
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "d"))), lambda x: x["d"]), ""), 256).alias("digest"), F.sum("n").alias("n"))
