"""BM25 from postings in blocks: blocks that can't reach the k best are never opened.

Documents fall into areas, runs of neighbours in order of pos. The postings of a
token in an area are one block with its largest weight. A query adds up these
weights per area: no document there scores more. The areas that promise most are
scored first; what their k-th best document scores, others have to reach, and
the blocks of areas that can't are left alone. Results are those of a search of
all postings. A token that every document has is as many blocks as there are
areas, so no task holds all its postings.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import Bm25Index, Index, _share, not_blank, query_tokens, top_k
from .settle import settle

#: Scores are compared with what an area can reach less this, since sums differ in their last digits.
SLACK = 1e-8


@dataclass
class BlockIndex:
    """blocks: token, area, top (the largest weight, 0 at least), n (documents), entries (pos and weight of each).

    With an index the weights are still to be multiplied by the token's idf there, and entries have pos, tf and dl.
    """

    blocks: DataFrame
    index: Index | None = None


def _area(docs_per_area: int) -> Column:
    """Of a partition's rows in order: runs of so many."""
    # Spark's own row ids number the rows of a sorted partition: areas are runs of them, and never cross partitions
    at = F.monotonically_increasing_id()
    return (F.shiftleft(F.shiftright(at, 33), 31) + F.floor(at.bitwiseAND((1 << 33) - 1) / docs_per_area)).cast("long")


def blocks_of(index: Index, docs_per_area: int = 1024) -> BlockIndex:
    """block_index from the rows of documents: they are dealt out in order of pos once, and areas are cut where they then lie, without a table of postings."""
    if docs_per_area <= 0:
        raise ValueError("docs_per_area must be positive")
    rows = index.rows.select("pos", "terms", "tf", F.size("d").cast("long").alias("dl")).repartitionByRange("pos").sortWithinPartitions("pos")
    placed = rows.withColumn("area", _area(docs_per_area)).crossJoin(F.broadcast(index.lengths))
    kind = index.rows.schema["pos"].dataType.simpleString()
    return BlockIndex(settle(placed.mapInArrow(_cut, f"token string, area long, top double, n long, entries array<struct<pos:{kind},tf:long,dl:long>>")), index)


#: Areas that a task cuts at once.
STEP = 16


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """The blocks of a partition's areas, which follow each other. An area that may go on waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        area = batch.column("area").to_numpy()
        last = int(np.searchsorted(area, area[-1]))
        if last or (held and held[0].column("area")[0].as_py() != area[0]):
            yield from _blocks([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield from _blocks(held)


def _blocks(parts: list[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    whole = pa.Table.from_batches(parts)
    area = whole.column("area").to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], np.diff(area) != 0)))
    for a, b in zip(starts[::STEP].tolist(), [*starts[STEP::STEP].tolist(), len(area)], strict=True):
        rows = whole.slice(a, b - a)
        terms, tfs = (rows.column(c).combine_chunks() for c in ("terms", "tf"))
        doc = np.repeat(np.arange(b - a), np.array(terms.value_lengths().fill_null(0), np.int64))
        if not len(doc):
            continue
        coded = terms.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        own, dl, avgdl = area[a:b], rows.column("dl").to_numpy(), rows.column("avgdl").to_numpy()
        order = np.lexsort((code, own[doc]))
        doc, code, tf = doc[order], code[order], tfs.flatten().to_numpy(zero_copy_only=False)[order]
        first = np.flatnonzero(np.concatenate(([True], (np.diff(code) != 0) | (np.diff(own[doc]) != 0))))
        cuts = pa.array(np.concatenate((first, [len(doc)])), pa.int32())
        entries = pa.StructArray.from_arrays([rows.column("pos").combine_chunks().take(pa.array(doc)), pa.array(tf, pa.int64()), pa.array(dl[doc], pa.int64())], ["pos", "tf", "dl"])
        columns = [coded.dictionary.take(pa.array(code[first])), pa.array(own[doc[first]]), pa.array(np.maximum.reduceat(_share(tf, dl[doc], avgdl[doc]), first)), pa.array(np.diff(np.concatenate((first, [len(doc)])))), pa.ListArray.from_arrays(cuts, entries)]
        yield pa.RecordBatch.from_arrays(columns, ["token", "area", "top", "n", "entries"])


def block_index(index: Bm25Index, docs_per_area: int = 1024) -> BlockIndex:
    """Cut the postings of an index into blocks of at most docs_per_area documents, and write them."""
    if docs_per_area <= 0:
        raise ValueError("docs_per_area must be positive")
    areas = settle(index.lengths.select("pos").repartitionByRange("pos").sortWithinPartitions("pos").select("pos", _area(docs_per_area).alias("area")))
    placed = index.postings.join(areas, "pos")
    blocks = placed.groupBy("token", "area").agg(F.greatest(F.max("weight"), F.lit(0.0)).alias("top"), F.count("*").alias("n"), F.collect_list(F.struct("pos", "weight")).alias("entries"))
    return BlockIndex(settle(blocks.repartition("token", "area").sortWithinPartitions("token")))


@dataclass
class Search:
    """What a search opened: heads has query_id, area, reach (no document there scores more); first and rest are those opened."""

    hits: DataFrame
    heads: DataFrame
    first: DataFrame
    rest: DataFrame


#: Wanted blocks are marked by so many places of a hash, and others are left where they lie; the marks bound what is broadcast.
MARKS = 1 << 17


def _scores(index: BlockIndex, tokens: DataFrame, areas: DataFrame) -> DataFrame:
    """query_id, pos, score of all documents in some areas of each query that share a token with it."""
    wanted = tokens.join(areas.select("query_id", "area"), "query_id")
    mark = F.pmod(F.xxhash64("token", "area"), F.lit(MARKS)).cast("int")
    near = index.blocks.select("token", "area", "entries").withColumn("mark", mark).join(F.broadcast(wanted.select(mark.alias("mark")).distinct()), "mark", "left_semi").drop("mark")
    each = wanted.join(near, ["token", "area"]).select("query_id", "times", F.explode("entries").alias("e"))
    weight = F.col("e.weight")
    if index.index is not None:
        each, weight = each.crossJoin(F.broadcast(index.index.lengths)), _share(F.col("e.tf"), F.col("e.dl"), F.col("avgdl"))
    return each.groupBy("query_id", F.col("e.pos").alias("pos")).agg(F.sum(F.col("times") * weight).alias("score"))


def search(index: BlockIndex, queries: DataFrame, k: int) -> Search:
    """The k best documents of each query, as retrieval.bm25_search gives them, in hits."""
    if k <= 0:
        raise ValueError("k must be positive")
    tokens = query_tokens(not_blank(queries))
    if index.index is not None:
        tokens = tokens.join(index.index.vocabulary, "token").select("query_id", "token", (F.col("times") * F.col("idf")).alias("times"))
    tokens = settle(tokens)
    met = tokens.join(index.blocks.select("token", "area", "top", "n"), "token")
    heads = settle(met.groupBy("query_id", "area").agg(F.sum(F.greatest(F.col("times"), F.lit(0.0)) * F.col("top")).alias("reach"), F.max("n").alias("n")))
    # an area has n documents at least that share a token: the best areas, until they have k
    before = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("reach"), "area").rowsBetween(Window.unboundedPreceding, -1))
    first = settle(heads.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < k).select("query_id", "area"))
    scored = settle(_scores(index, tokens, first))
    least = top_k(scored, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    open_ = heads.join(first, ["query_id", "area"], "left_anti").join(least, "query_id", "left")
    rest = settle(open_.where(F.col("least").isNull() | (F.col("reach") >= F.col("least") - SLACK)).select("query_id", "area"))
    hits = scored.unionByName(_scores(index, tokens, rest))
    return Search(top_k(hits, k), heads, first, rest)
