"""Nearest neighbours by score-aware (anisotropic) quantisation, checked exactly.

Unit vectors are product-quantised with 16 centres per subspace, four bits
each. Codes and centres minimise |r|^2 + (eta - 1) <r, x>^2 for the residual r
of x: error parallel to the vector, which is what changes large inner products,
costs eta times as much as error across it. A scan adds up table entries for
pairs of four-bit codes; the best rows by that estimate are reranked by their
exact cosine in double precision.

The estimate tells vectors that lie close together apart no better than their
codes do, so an exact check follows: with each code stand the parallel part p of
its residual and the length a of the part across. A vector of cosine s with a
query has an estimate of at least s (1 - p) - a sqrt(1 - s^2), which grows with
s, so one whose estimate lies below that for the k-th cosine found so far is no
nearer; all others get their exact cosine. Nothing that is nearer is lost,
whatever the rows look like; how many are looked at depends on how far the codes
tell them apart.

Rows that share a vector are one entry, with as many of their smallest ids as
could ever be returned. Entries are dealt into chunks that a task holds; queries
go to every chunk, and k rows per query leave it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

CENTRES = 16
#: Rows of codes whose estimates are added up at once.
STEP = 8192
#: Queries that meet a chunk at once.
BLOCK = 64
#: Components of the vectors of a chunk at most; smaller tables are cut into up to SPREAD chunks of LEAST rows or more.
HELD, SPREAD, LEAST = 1 << 22, 24, 2048
#: Estimates are sums of single-precision numbers: how far they may be off for every table summed.
SLACK = 1e-6


class Quantiser:
    """Centres of shape (subspaces, 16, width) and the weight eta of parallel error."""

    def __init__(self, centres: np.ndarray, eta: float):
        self.centres, self.eta = centres, eta

    @staticmethod
    def fit(x: np.ndarray, width: int = 2, threshold: float = 0.2, rounds: int = 12, seed: int = 3) -> Quantiser:
        """Alternate between codes (coordinate descent) and centres (least squares) on unit vectors."""
        dims = x.shape[1]
        subspaces = -(-dims // width)
        eta = max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))
        cut = _cut(x, subspaces, width)
        rng = np.random.Generator(np.random.PCG64(seed))
        pick = rng.integers(0, len(x), (subspaces, CENTRES))
        centres = np.stack([cut[pick[m], m] for m in range(subspaces)]) + rng.normal(0, 1e-4, (subspaces, CENTRES, width))
        q = Quantiser(centres, eta)
        for _ in range(rounds):
            codes = q.encode(x)
            parallel = np.stack([((cut[:, m] - q.centres[m][codes[:, m]]) * cut[:, m]).sum(axis=1) for m in range(subspaces)], axis=1)
            for m in range(subspaces):
                v = cut[:, m]
                target = parallel.sum(axis=1) - parallel[:, m] + (v * v).sum(axis=1)
                for k in range(CENTRES):
                    own = codes[:, m] == k
                    if own.any():
                        a = own.sum() * np.eye(width) + (eta - 1) * v[own].T @ v[own]
                        b = (v[own] * (1 + (eta - 1) * target[own])[:, None]).sum(axis=0)
                        q.centres[m, k] = np.linalg.solve(a + 1e-9 * np.eye(width), b)
                    else:
                        q.centres[m, k] = v[rng.integers(0, len(v))]
                parallel[:, m] = ((v - q.centres[m][codes[:, m]]) * v).sum(axis=1)
        return q

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows, subspaces) by coordinate descent on the anisotropic loss."""
        subspaces, _, width = self.centres.shape
        cut = _cut(x, subspaces, width)
        cost, along = [], []
        for m in range(subspaces):
            r = cut[:, m, None, :] - self.centres[m][None]
            cost.append((r * r).sum(axis=2))
            along.append((r * cut[:, m, None, :]).sum(axis=2))
        codes = np.stack([c.argmin(axis=1) for c in cost], axis=1).astype(np.uint8)
        rows = np.arange(len(x))
        parallel = sum(along[m][rows, codes[:, m]] for m in range(subspaces)) if len(x) else np.zeros(0)
        for _ in range(sweeps):
            for m in range(subspaces):
                others = parallel - along[m][rows, codes[:, m]]
                codes[:, m] = (cost[m] + (self.eta - 1) * (others[:, None] + along[m]) ** 2).argmin(axis=1)
                parallel = others + along[m][rows, codes[:, m]]
        return codes

    def decode(self, codes: np.ndarray, dims: int) -> np.ndarray:
        """The vectors that codes stand for."""
        return np.concatenate([self.centres[m][codes[:, m]] for m in range(codes.shape[1])], axis=1)[:, :dims]

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        """For each pair of subspaces, the inner products of all queries with all 256 pairs of centres."""
        subspaces, _, width = self.centres.shape
        cut = _cut(queries, subspaces, width)
        each = [cut[:, m] @ self.centres[m].T for m in range(subspaces)]
        if subspaces % 2:
            each.append(np.zeros((len(queries), CENTRES)))
        return [(each[m][:, :, None] + each[m + 1][:, None, :]).reshape(len(queries), -1).astype(np.float32) for m in range(0, len(each), 2)]


def _cut(x: np.ndarray, subspaces: int, width: int) -> np.ndarray:
    if x.shape[1] < subspaces * width:
        x = np.concatenate((x, np.zeros((len(x), subspaces * width - x.shape[1]))), axis=1)
    return x.reshape(len(x), subspaces, width)


def pack(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes to a byte."""
    if codes.shape[1] % 2:
        codes = np.concatenate((codes, np.zeros((len(codes), 1), np.uint8)), axis=1)
    return codes[:, 0::2] << 4 | codes[:, 1::2]


def sound(vectors: DataFrame, id_col: str, vector_col: str, dims: int | None) -> tuple[DataFrame, int]:
    """Rows id, v (array of double) that take part, and their number of dimensions.

    Null ids, null or zero vectors and such with null or non-finite components
    are left out, and so are vectors of another length than dims (by default
    the commonest length, ties to the smaller).
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    if dims is None:
        top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dims = top["d"] if top else 0
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where((F.size("v") == dims) & finite & F.exists("v", lambda x: x != 0)), dims


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """entry, v, ids: every distinct vector of rows (id, v) once, with its k + 1 smallest ids in order.

    Ids are cut to k + 1 before the shuffle as well as after it, so a vector
    that many rows share is no large group.
    """
    plain = rows.select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).distinct()  # no negative zeros
    w = Window.partitionBy("v").orderBy("id")
    few = plain.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    ids = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return stored(ids.select(F.monotonically_increasing_id().alias("entry"), "v", "ids"), "vectors")


def build_index(vectors: DataFrame, dims: int, sample_rows: int = 20_000, seed: int = 3) -> tuple[DataFrame, Quantiser | None]:
    """Quantise every distinct vector: entry, v, ids, codes (binary), along and across (its residual's parts). Centres are fitted on at most about sample_rows of them."""
    total = vectors.count()
    if not total:
        return vectors, None
    share = min(1.0, sample_rows / total)
    drawn = vectors.where(F.pmod(F.xxhash64(F.lit(seed), "v"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    sample = np.array([r["v"] for r in drawn.select("v").orderBy("v").collect()], np.float64).reshape(-1, dims)
    if not len(sample):
        sample = np.array([vectors.orderBy("v").first()["v"]])
    quantiser = Quantiser.fit(_unit(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                unit = _unit(_matrix(part.column("v"), dims))
                codes = quantiser.encode(unit)
                rest = unit - quantiser.decode(codes, dims)
                along = (rest * unit).sum(axis=1)
                across = np.sqrt(((rest - along[:, None] * unit) ** 2).sum(axis=1))
                own = [pa.array([x.tobytes() for x in pack(codes)], pa.binary()), pa.array(along), pa.array(across)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("entry", "v", "ids")], *own], ["entry", "v", "ids", "codes", "along", "across"])

    kinds = "entry long, v array<double>, ids array<long>, codes binary, along double, across double"
    return stored(vectors.select("entry", "v", "ids").mapInArrow(run, kinds), "index"), quantiser


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of queries (q, d) with rows (q, c, d) in double precision; equal vectors get equal values."""
    dot = (queries[:, None, :] * rows).sum(axis=2)
    length = np.sqrt((queries * queries).sum(axis=1))[:, None] * np.sqrt((rows * rows).sum(axis=2))
    with np.errstate(all="ignore"):
        out = dot / length
    odd = ~np.isfinite(out) | (length < 1e-140)
    if odd.any():  # components so large or small that their squares leave the range
        q, c = np.nonzero(odd)
        out[q, c] = (_unit(queries[q]) * _unit(rows[q, c])).sum(axis=1)
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by score, then smaller id; an id that stands twice counts once."""
    order = np.lexsort((ids, -scores), axis=1)
    scores, ids = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
    again = np.zeros(ids.shape, bool)
    again[:, 1:] = (ids[:, 1:] == ids[:, :-1]) & (scores[:, 1:] == scores[:, :-1])
    order = np.argsort(again, axis=1, kind="stable")[:, :k]
    scores = np.where(again, -np.inf, scores)
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


class _Chunk:
    """Entries that a task holds, with their codes and the parts of their residuals."""

    def __init__(self, rows: pa.Table, quantiser: Quantiser, dims: int):
        column = lambda name: rows.column(name).combine_chunks()
        self.quantiser = quantiser
        self.v = _matrix(column("v"), dims) + 0.0
        self.unit = _unit(self.v)
        self.codes = np.ascontiguousarray(np.frombuffer(b"".join(column("codes").to_pylist()), np.uint8).reshape(len(self.v), -1).T)
        self.along, self.across = column("along").to_numpy(), column("across").to_numpy()
        ids = column("ids")
        self.count = np.array(ids.value_lengths(), np.int64)
        self.ids, self.start = ids.flatten().to_numpy(), np.cumsum(self.count) - self.count

    def estimates(self, unit: np.ndarray) -> np.ndarray:
        out = np.zeros((len(unit), len(self.v)), np.float32)
        tables = self.quantiser.tables(unit)
        for a in range(0, len(self.v), STEP):
            part = out[:, a : a + STEP]
            for table, c in zip(tables, self.codes[:, a : a + STEP], strict=True):
                part += table[:, c]
        return out

    def kth(self, name: int, at: np.ndarray, cosine: np.ndarray, k: int) -> float:
        """The k-th best cosine of entries at places that hold another row than the query's own; -1 where there are fewer."""
        cosine = cosine[(self.count[at] > 1) | (self.ids[self.start[at]] != name)]
        return float(np.partition(cosine, len(cosine) - k)[len(cosine) - k]) if len(cosine) >= k else -np.inf

    def open(self, estimate: np.ndarray, t: float) -> np.ndarray:
        """Places of the entries whose cosine may be t or more."""
        if t == -np.inf:
            return np.arange(len(estimate))
        if t >= 0:
            least = np.where(self.along < 1, t * (1 - self.along) - np.sqrt(max(0.0, 1 - t * t)) * self.across, -np.inf)
        else:
            least = t - np.sqrt(self.along**2 + self.across**2)
        return np.flatnonzero(estimate >= least - SLACK * len(self.codes))

    def search(self, name: int, query: np.ndarray, unit: np.ndarray, estimate: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k nearest rows here: the n best by the estimate first, then all that may be as near."""
        first = np.argpartition(-estimate, n - 1)[:n] if len(estimate) > n else np.arange(len(estimate))
        at = self.open(estimate, self.kth(name, first, self.unit[first] @ unit, k) - 1e-9)
        cosine = (self.unit @ unit)[at] if 8 * len(at) > len(estimate) else self.unit[at] @ unit
        at = at[cosine >= self.kth(name, at, cosine, k) - 1e-9]
        score = np.repeat(cosines(query[None], self.v[at][None])[0], self.count[at])
        ids = np.concatenate([self.ids[a : a + c] for a, c in zip(self.start[at].tolist(), self.count[at].tolist(), strict=True)]) if len(at) else np.zeros(0, np.int64)
        other = (ids != name) & np.isfinite(score)
        if not other.any():
            return np.zeros(0), np.zeros(0, np.int64)
        score, ids = (x[0] for x in _best(score[other][None], ids[other][None], k))
        return score[np.isfinite(score)], ids[np.isfinite(score)]


def _scan(batches: Iterator[pa.RecordBatch], quantiser: Quantiser, dims: int, k: int, n: int) -> Iterable[pa.RecordBatch]:
    """Searches for a partition sorted by (chunk, query): a chunk's entries come first, then its queries, taken BLOCK at a time."""
    name, held, chunk = None, [], None

    def ask(rows: pa.Table) -> Iterable[pa.RecordBatch]:
        if chunk is None:
            return
        ids, v = rows.column("id").to_pylist(), _matrix(rows.column("v").combine_chunks(), dims) + 0.0
        unit = _unit(v)
        estimates = chunk.estimates(unit)
        found = [chunk.search(i, v[j], unit[j], estimates[j], k, n) for j, i in enumerate(ids)]
        size = [len(x) for x, _ in found]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), size)), pa.array(np.concatenate([x for _, x in found])), pa.array(np.concatenate([x for x, _ in found]))], ["query_id", "vec_id", "score"])

    for batch in batches:
        part, query = batch.column("chunk").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
        cuts = np.concatenate(([0], np.flatnonzero((np.diff(part) != 0) | (query[1:] != query[:-1])) + 1, [len(part)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            rows = batch.slice(a, b - a)
            if part[a] != name:
                name, held, chunk = part[a], [], None
            if not query[a]:
                held.append(rows)
                continue
            if held:
                chunk, held = _Chunk(pa.Table.from_batches(held), quantiser, dims), []
            for i in range(0, b - a, BLOCK):
                yield from ask(pa.Table.from_batches([rows.slice(i, BLOCK)]))


def nearest(
    vectors: DataFrame,
    is_query: F.Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    rerank: int = 96,
    chunk_rows: int = 1 << 16,
    sample_rows: int = 20_000,
    dims: int | None = None,
) -> DataFrame:
    """The k nearest other rows by cosine of every row where is_query holds: query_id, rank, vec_id, score.

    Rows that take no part (see sound) neither ask nor answer. Rows that share
    the query's id are its own; repeated rows are found once; an id that asks
    twice asks with its least vector. Nearest first, ties to the smaller id; all
    candidates where there are fewer than k; no rows give none. Other columns,
    whatever their names, are left behind. The `rerank` best by the estimate are
    reranked first in every chunk, k + 1 at least, and then whatever the codes
    don't rule out. A task holds chunk_rows vectors at most, fewer of many
    dimensions. Neither queries nor rows reach the driver, but for the sample
    that centres are fitted on.
    """
    spark = vectors.sparkSession
    rows, dims = sound(vectors, id_col, vector_col, dims)
    entries = distinct_vectors(rows, k)
    index, quantiser = build_index(entries, dims, sample_rows)
    if quantiser is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asking = stored(sound(vectors.where(is_query), id_col, vector_col, dims)[0].groupBy("id").agg(F.min("v").alias("v")), "asking")
    total = index.count()
    chunks = max(-(-total // max(1, min(chunk_rows, HELD // dims))), min(SPREAD, -(-total // LEAST)))
    none = lambda c: F.lit(None).cast(index.schema[c].dataType).alias(c)
    held = index.select(F.pmod(F.xxhash64(F.lit(1), "entry"), F.lit(chunks)).alias("chunk"), F.lit(False).alias("query"), F.lit(None).cast("long").alias("id"), "v", "ids", "codes", "along", "across")
    sent = asking.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), F.lit(True).alias("query"), "id", "v", none("ids"), none("codes"), none("along"), none("across"))
    size = max(rerank, k + 1)
    dealt = held.union(sent).repartitionById(int(chunks), F.col("chunk").cast("int")).sortWithinPartitions("chunk", "query")
    near = dealt.mapInArrow(lambda it: _scan(it, quantiser, dims, k, size), "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = near.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    out = stored(out, "nearest")
    for table in (index, asking, entries):
        discard(table)
    return out


def op3_anisotropic_search(spark, sf_dir: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 50."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
