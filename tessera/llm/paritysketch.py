"""Exact Jaccard join of word n-grams by parity sketches.

A document is the set of its word n-grams (shingles). Its sketch is a very wide
string of bits, cut into parts; every shingle flips one bit of one part, so
equal bits cancel and two sketches differ in no more parts than their sets
differ in shingles. A Jaccard similarity of t or more means that two sets of a
and b shingles differ in at most (1 - t) / (1 + t) * (a + b). Sizes fall into
bands with a fixed number of parts each, larger by a margin than the most such
sets can differ in, so some part of theirs must be equal (the pigeonhole), and
the margin makes sure that one of them isn't empty. Parts are kept as the XOR of
the 64-bit names of the bits that are set.

Sketches meet on (band, part, value). A set that emits K parts shares at least
K - D of them with each partner, D the most the two may differ in. Values that
more than RARE sets have say little (a passage that half of all documents quote,
alone in its part) and are set aside: if a set has f of those, it still shares
K - D - f rare ones with each partner. Pairs that meet in fewer can't link; pairs
of rare values are few, RARE being fixed. Only sets with f >= K - D, such as
members of a large group of near copies, go on to meet in frequent values, among
themselves: each is tied to the value's least one, never paired off. A value that
is frequent within a task is known to be so before the shuffle, which then gets
RARE + 1 of its sets from there, enough to show it.

Ties form clusters, and exact sets decide within clusters. In a large one, all
sets meet a few pivots first; only those that link with none are compared with
the whole cluster, block against block. Only links that connect something new
leave a task. Components of those links are those of all links.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK, SPACE, combined, discard, documents, grouped, mix64, narrowed, places, row_blocks, row_name, stored, text_bytes, unused, weighted_join
from .components import connected
from .recompress import BLOCK, Words, window_hashes

#: Ratio of the largest to the least size of a band.
BAND = 1.5
#: A value of a part is frequent if more sets than this have it.
RARE = 8
#: Share of parts beyond the most that may differ.
MARGIN = 0.15
#: Keys are shuffled in turns, if there are more shingles than so many, so that the files of all keys never lie on disk at once.
TURNS, TURN_SHINGLES = 4, 20_000_000
#: Shingles that a block of a cluster holds, about; blocks are compared in pairs.
BLOCK_SHINGLES = 150_000
#: Sets that a block holds, about: bounds the table of pairs where sets are small.
BLOCK_SETS = 1_000
#: Sets of a cluster of several blocks that all its others meet first.
PIVOTS = 8


def lowered(texts: list[bytes | None]) -> list[bytes]:
    """A to Z in lower case, every other byte as it is."""
    return [(t or b"").lower() for t in texts]


def shingle_sets(texts: list[bytes | None], n: int) -> tuple[list[np.ndarray], list[tuple[int, int] | None]]:
    """Sorted distinct 64-bit shingles of each text (with fewer words than n, all of them as one), and a 128-bit name of each set.

    The two halves of a name come from the two halves of the words' names, so
    they are independent. An empty set has no name.
    """
    words = Words(lowered(texts))
    grams = [window_hashes(h, n, 0) for h in (words.names, words.more)]
    sets, names = [], []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= n:
            own, at = np.unique(grams[0][a : b - n + 1], return_index=True)
            more = grams[1][a : b - n + 1][at]
        else:
            own, more = (window_hashes(h[a:b], int(b - a), int(b - a)) if b > a else np.zeros(0, np.uint64) for h in (words.names, words.more))
        sets.append(own)
        names.append((set_name(own), set_name(more)) if len(own) else None)
    return sets, names


class Bands:
    """Size bands for a threshold of num / den, and the number of parts of each."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def of(self, size: int) -> int:
        return int(math.floor(math.log(size) / math.log(BAND) + 1e-9))

    def top(self, band: int) -> int:
        """The largest size in a band."""
        return math.ceil(BAND ** (band + 1)) + 1

    def most(self, band: int) -> int:
        """The most shingles in which two linked sets of up to the band's size differ."""
        return (self.den - self.num) * 2 * self.top(band) // (self.den + self.num)

    def parts(self, band: int) -> int:
        """More than may differ, by a margin for parts that are empty or hold something frequent."""
        most = self.most(band)
        empty = (most + 1) * math.exp(-(BAND**band) / (most + 1))
        return most + 1 + math.ceil(MARGIN * most + empty + 3 * math.sqrt(empty))

    def bands(self, size: int) -> list[int]:
        """Bands in which a set looks for partners at least as large: its own, and the one where the largest lie."""
        own, last = self.of(size), self.of(max(size, size * self.den // self.num))
        return list(range(own, last + 1))


def sketch_keys(shingles: np.ndarray, bands: Bands) -> list[tuple[int, int, np.ndarray]]:
    """For each band of a set: the band, K - D, and the keys (band, part, value) as 64-bit numbers.

    Empty parts give a key only where K <= D, so that two such sets meet in
    those as well.
    """
    out = []
    with np.errstate(over="ignore"):
        for band in bands.bands(len(shingles)):
            parts, most = bands.parts(band), bands.most(band)
            part = (mix64(shingles + np.uint64(band + 1)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            start = np.flatnonzero(np.concatenate(([True], np.diff(part[order]) != 0)))
            value = np.bitwise_xor.reduceat(mix64(shingles[order] ^ np.uint64(0x5851F42D4C957F2D)), start)
            which = part[order][start]
            filled = value != 0
            which, value = which[filled], value[filled]
            left = len(which) - most
            if left <= 0:
                lone = np.setdiff1d(np.arange(parts), which)
                which, value = np.concatenate((which, lone)), np.concatenate((value, np.zeros(len(lone), np.uint64)))
            key = mix64(mix64(value) + np.uint64(0x9E3779B97F4A7C15) * (which.astype(np.uint64) + np.uint64(band * 1_000_003 + 1)))
            out.append((band, left, key))
    return out


def set_name(values: np.ndarray) -> int:
    """64 bits from a set of hashes, whatever their order."""
    with np.errstate(over="ignore"):
        a = np.bitwise_xor.reduce(mix64(values + np.uint64(11)))
        b = np.add.reduce(mix64(values ^ np.uint64(0xABCDEF)))
        return int(combined(np.array([a]), np.array([b + np.uint64(len(values))])).view(np.int64)[0])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from row_blocks(batch, "text", BLOCK)


def _sketch(batches: Iterator[pa.RecordBatch], n: int, bands: Bands) -> Iterable[pa.RecordBatch]:
    for part in _parts(batches):
        sets, names = shingle_sets(text_bytes(part.column("text")), n)
        keys = [sketch_keys(s, bands) if len(s) and any(map(bands.most, bands.bands(len(s)))) else [] for s in sets]
        of_row = pa.array(np.concatenate(([0], np.cumsum([len(k) for k in keys]))), pa.int32())
        flat = [x for k in keys for x in k]
        of_band = pa.array(np.concatenate(([0], np.cumsum([len(x[2]) for x in flat]))).astype(np.int32), pa.int32())
        values = pa.array(np.concatenate([x[2] for x in flat]).view(np.int64) if flat else np.zeros(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                part.column("id"),
                part.column("row"),
                pa.array([len(s) for s in sets], pa.int64()),
                *[pa.array([x and x[i] for x in names], pa.int64()) for i in (0, 1)],
                *[pa.ListArray.from_arrays(of_row, pa.array([x[i] for x in flat], pa.int32())) for i in (0, 1)],
                pa.ListArray.from_arrays(of_row, pa.ListArray.from_arrays(of_band, values)),
            ],
            ["id", "row", "n_shingles", "name1", "name2", "bands", "spare", "keys"],
        )


PAIR, FREQUENT, SENT = 0, 1, 2
_COLUMNS = ("key", "node", "band", "spare")


def _local(batches: Iterator[pa.RecordBatch], turn: int = 0, turns: int = 1) -> Iterable[pa.RecordBatch]:
    """Keys of a task's sets whose turn it is, one row each. Of a key that more than RARE of them have, only RARE + 1 are SENT; the others are FREQUENT already."""
    held: list[list[np.ndarray]] = []

    def flush() -> Iterable[pa.RecordBatch]:
        rows = [np.concatenate(x) for x in zip(*held, strict=True)]
        keep, place = places(rows[0], rows[1])
        kind = np.where(place > RARE, FREQUENT, SENT).astype(np.int8)
        rows = [x[keep] for x in (kind, *rows)]  # in the order of the sets, which shuffles smaller
        for a in range(0, len(rows[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in rows], ["kind", *_COLUMNS])

    for batch in batches:
        keys = batch.column("keys")
        n_bands, n_keys = np.diff(keys.offsets.to_numpy()), np.diff(keys.flatten().offsets.to_numpy())
        flat = keys.flatten().flatten().to_numpy()
        node = np.repeat(np.repeat(batch.column("node").to_numpy(), n_bands), n_keys)
        band, spare = (np.repeat(batch.column(c).flatten().to_numpy(), n_keys) for c in ("bands", "spare"))
        own = slice(None) if turns == 1 else flat.view(np.uint64) % np.uint64(turns) == turn
        held.append([x[own] for x in (flat, node, band, spare)])
        if sum(len(x[0]) for x in held) >= CHUNK:
            yield from flush()
            held = []
    if held:
        yield from flush()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """What meets on keys, for a partition sorted by key and node.

    PAIR rows (a, b, band, their spares) for keys of 2 to RARE sets, FREQUENT
    rows (a the key, b the set) for keys of more, and those that were so before.
    At most RARE + 1 rows wait for the next batch, however many a key has.
    """
    rest = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)]
    going = None  # a frequent key that the last batch ended in

    def made(columns: list[np.ndarray]) -> Iterable[pa.RecordBatch]:
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "a", "b", "band", "x", "y"])

    def often(key: np.ndarray, node: np.ndarray, band: np.ndarray, spare: np.ndarray) -> tuple[np.ndarray, ...]:
        return np.full(len(key), FREQUENT, np.int8), key, node, band, spare, spare

    def work(rows: list[np.ndarray], last: bool) -> Iterable[pa.RecordBatch]:
        nonlocal rest, going
        if not len(rows[0]):
            return
        rows, start, size = grouped(rows)
        key = rows[0]
        many = size > RARE
        many[0] |= going is not None and key[0] == going
        if not last:
            going = key[-1] if many[-1] else None
            if many[-1]:
                rest = [x[:0] for x in rows]
            else:
                rest = [x[start[-1] :].copy() for x in rows]
                rows = [x[: start[-1]] for x in rows]
                size, many = size[:-1], many[:-1]
        key, node, band, spare = rows
        common = np.repeat(many, size)
        out = []
        for step in range(1, RARE):
            if len(key) > step:
                at = np.flatnonzero((key[:-step] == key[step:]) & ~common[:-step])
                out.append((np.full(len(at), PAIR, np.int8), node[at], node[at + step], band[at], spare[at], spare[at + step]))
        out.append(often(*(x[common] for x in rows)))
        yield from made([np.concatenate(x) for x in zip(*out, strict=True)])

    for batch in batches:
        now = [batch.column(c).to_numpy() for c in _COLUMNS]
        known = batch.column("kind").to_numpy() == FREQUENT
        if known.any():
            yield from made(list(often(*(x[known] for x in now))))
            now = [x[~known] for x in now]
        yield from work([np.concatenate(x) for x in zip(rest, now, strict=True)], False)
    yield from work(rest, True)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Of a task's rows (key, node): ties (a node, the least of its key here), and heads (a key, its least node here)."""
    held: list[list[np.ndarray]] = []

    def flush() -> Iterable[pa.RecordBatch]:
        (key, node), start, size = grouped([np.concatenate(x) for x in zip(*held, strict=True)])
        least = np.repeat(node[start], size)
        tie = least != node
        pairs = np.unique(np.stack((node[tie], least[tie]), axis=1), axis=0)
        for kind, a, b in ((0, pairs[:, 0], pairs[:, 1]), (1, key[start], node[start])):
            yield pa.RecordBatch.from_pydict({"kind": np.full(len(a), kind, np.int8), "a": a, "b": b})

    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in ("key", "node")])
        if sum(len(x[0]) for x in held) >= CHUNK:
            yield from flush()
            held = []
    if sum(len(x[0]) for x in held):
        yield from flush()


def _members(batches: Iterator[pa.RecordBatch], n: int) -> Iterable[pa.RecordBatch]:
    for part in _parts(batches):
        sets, _ = shingle_sets(text_bytes(part.column("text")), n)
        cuts = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in _MEMBER), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, pa.int64()))], [*_MEMBER, "shingles"])


_MEMBER = ("cluster", "node", "blocks", "block")


def linked(left: list[np.ndarray], right: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of sets whose Jaccard similarity is num / den or more, exactly.

    Counts common shingles by products of 0/1 matrices, some thousand shingles
    at a time; shingles of one side only never enter.
    """
    a_of = np.repeat(np.arange(len(left)), [len(x) for x in left])
    b_of = np.repeat(np.arange(len(right)), [len(x) for x in right])
    a_all, b_all = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a_all, b_all)
    a_at, b_at = np.searchsorted(both, a_all), np.searchsorted(both, b_all)
    a_in = (a_at < len(both)) & (both[np.minimum(a_at, max(len(both) - 1, 0))] == a_all) if len(both) else np.zeros(len(a_all), bool)
    b_in = (b_at < len(both)) & (both[np.minimum(b_at, max(len(both) - 1, 0))] == b_all) if len(both) else np.zeros(len(b_all), bool)
    a_at, a_of, b_at, b_of = a_at[a_in], a_of[a_in], b_at[b_in], b_of[b_in]
    a_order, b_order = np.argsort(a_at, kind="stable"), np.argsort(b_at, kind="stable")
    a_at, a_of, b_at, b_of = a_at[a_order], a_of[a_order], b_at[b_order], b_of[b_order]
    common = np.zeros((len(left), len(right)), np.float32)
    step = 2048
    for lo in range(0, len(both), step):
        x, y = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        s, t = np.searchsorted(a_at, [lo, lo + step])
        x[a_of[s:t], a_at[s:t] - lo] = 1
        s, t = np.searchsorted(b_at, [lo, lo + step])
        y[b_of[s:t], b_at[s:t] - lo] = 1
        common += x @ y.T
    common = common.astype(np.int64)
    union = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :] - common
    return np.nonzero(den * common >= num * union)


def _forest(u: np.ndarray, v: np.ndarray) -> Iterator[tuple[int, int]]:
    """Those links that connect something new."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        if (x := root(a)) != (y := root(b)):
            parent[x] = y
            yield a, b


def _compare(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterable[pa.RecordBatch]:
    """Links between side 0 and side 1 of every group (cluster, i, j), or within side 0 if it is alone, for a partition sorted by group."""
    held: list[tuple[int, int, np.ndarray]] = []
    name = None

    def flush() -> Iterable[pa.RecordBatch]:
        left = [x for x in held if x[0] == 0]
        right = [x for x in held if x[0] == 1] or left
        if not left or len(held) < 2:
            return
        a, b = linked([x[2] for x in left], [x[2] for x in right], num, den)
        u, v = np.array([x[1] for x in left])[a], np.array([x[1] for x in right])[b]
        out = list(_forest(u, v))
        if out:
            yield pa.RecordBatch.from_pydict({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([x for _, x in out], pa.int64())})

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("cluster", "i", "j", "side", "node")]
        for k, (cluster, i, j, side, node) in enumerate(zip(*columns, strict=True)):
            if (cluster, i, j) != name:
                if held:
                    yield from flush()
                held, name = [], (cluster, i, j)
            held.append((side, node, batch.column("shingles")[k].values.to_numpy().copy()))
    if held:
        yield from flush()


def _links(groups: DataFrame, num: int, den: int) -> DataFrame:
    return groups.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(lambda it: _compare(it, num, den), "u long, v long")


def _large(members: DataFrame, num: int, den: int) -> DataFrame:
    """Links within clusters of several blocks: enough to connect what is connected.

    Every set meets the cluster's pivots, which gives a first part of the links.
    The sets that these connect with most others are done: links among them add
    nothing, and their links with the rest are found from the rest, all of which
    meets all sets of the cluster.
    """
    w = Window.partitionBy("cluster").orderBy(F.xxhash64(F.lit(5), "node"), "node")
    pivots = members.select("cluster", "node").withColumn("r", F.row_number().over(w)).where(F.col("r") <= PIVOTS).select("node")
    pivots = stored(members.join(pivots, "node", "left_semi"), "pivots")
    group = ("cluster", "i", "j", "side", "node", "shingles")
    spread = pivots.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"j": F.lit(-1), "side": F.lit(0)})
    each = members.withColumns({"i": F.col("block"), "j": F.lit(-1), "side": F.lit(1)})
    found = stored(_links(spread.select(*group).union(each.select(*group)), num, den), "links")
    groups = stored(connected(found).join(members.select("node", "cluster"), "node"), "groups")
    top = groups.groupBy("cluster", "component").agg(F.count("*").alias("c")).groupBy("cluster").agg(F.max(F.struct("c", "component")).alias("x")).select("x.component", "x.c")
    done = weighted_join(groups, top, ["component"], "c", groups.count()).select("node")
    rest = stored(members.join(done, "node", "left_anti"), "rest")
    discard(groups)
    sizes = rest.groupBy("cluster").agg(F.greatest(F.ceil(F.sum(F.size("shingles")) / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_SETS)).cast("int").alias("some"), F.count("*").alias("c"))
    sizes = stored(sizes, "sizes")
    if not sizes.isEmpty():
        total = sizes.agg(F.sum("c")).first()[0]
        own = weighted_join(rest, sizes, ["cluster"], "c", total).withColumn("i", F.pmod(F.xxhash64(F.lit(13), "node"), F.col("some")).cast("int"))
        own = own.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(0))
        every = members.groupBy("cluster").agg(F.count("*").alias("c")).join(sizes.select("cluster", "some"), "cluster")
        all_ = weighted_join(members, every, ["cluster"], "c", members.count()).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("some") - 1))).withColumns({"j": F.col("block"), "side": F.lit(1)})
        found = found.union(stored(_links(own.select(*group).union(all_.select(*group)), num, den), "links"))
    discard(pivots)
    discard(rest)
    return found


def jaccard_components(docs: DataFrame, num: int = 9, den: int = 10, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, row (a name of id and text), n_shingles, component_id, component.

    Two documents link when den * |intersection| >= num * |union| of their sets
    of word n-grams; component_id is the smallest id reachable by links. Equal
    sets are one node, so copies cost nothing. Null or empty texts have an empty
    set and link with nothing; their component is their own id. Rows that share
    an id keep rows of their own. Rows with a null id take part; a component of
    only such rows has a null id. So ids may not tell components apart: component
    does, the number of one of its sets, null for an empty set. Other columns of
    docs, whatever their names, are left behind; no rows give no rows.
    """
    bands = Bands(num, den)
    frame = docs.select(F.col(id_col).alias("id"), row_name(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    kind = frame.schema["id"].dataType.simpleString()
    schema = f"id {kind}, row binary, n_shingles long, name1 long, name2 long, bands array<int>, spare array<int>, keys array<array<long>>"
    sketched = stored(frame.mapInArrow(lambda it: _sketch(it, n, bands), schema), "sketched")
    # candidates are sought by half a name, so that nothing is joined before; two sets that share it are told apart below
    some = sketched.where(F.size("keys") > 0).select(F.col("name1").alias("node"), "bands", "spare", "keys")
    # all keys at once would take several times the disk of what they make; no key is in two turns
    turns = min(TURNS, 1 + (sketched.agg(F.sum("n_shingles")).first()[0] or 0) // TURN_SHINGLES)
    mets = []
    for turn in range(turns):
        keys = some.mapInArrow(lambda it, turn=turn: _local(it, turn, turns), "kind byte, key long, node long, band int, spare int")
        dealt = keys.repartition(F.when(F.col("kind") == SENT, F.xxhash64("key")).otherwise(F.xxhash64("key", "node")))
        mets.append(stored(dealt.sortWithinPartitions("key", "node").mapInArrow(_meet, "kind byte, a long, b long, band int, x int, y int"), "met"))
    met = reduce(DataFrame.union, mets)
    sketched = narrowed(sketched, "rows", "id", "row", "n_shingles", "name1", "name2")
    nodes = (
        sketched.where("n_shingles > 0")
        .groupBy("name1", "name2")
        .agg(F.min("row").alias("row"), F.min("id").alias("least"), F.min("n_shingles").alias("n_shingles"), F.count("*").alias("copies"))
        .select(F.monotonically_increasing_id().alias("node"), "*")
    )
    nodes = stored(nodes, "nodes")
    often = met.where(F.col("kind") == FREQUENT).select(F.col("a").alias("key"), F.col("b").alias("node"), "band", F.col("x").alias("spare"))
    lost = often.groupBy("node", "band").agg(F.count("*").alias("f"))
    pairs = met.where(F.col("kind") == PAIR).groupBy("a", "b", "band").agg(F.count("*").alias("c"), F.first("x").alias("x"), F.first("y").alias("y"))
    lost_of = lambda side: lost.select(F.col("node").alias(side), "band", F.col("f").alias(f"f{side}"))
    need = F.greatest(F.col("x") - F.coalesce("fa", F.lit(0)), F.col("y") - F.coalesce("fb", F.lit(0)))
    close = pairs.join(lost_of("a"), ["a", "band"], "left").join(lost_of("b"), ["b", "band"], "left").where(F.col("c") >= need).select(F.col("a").alias("u"), F.col("b").alias("v"))
    weak = often.join(lost, ["node", "band"]).where(F.col("spare") <= F.col("f")).select("key", "node")
    # stars within tasks, and the heads of a key's stars tied to the least of them
    stars = stored(weak.mapInArrow(_stars, "kind byte, a long, b long"), "stars")
    heads = stars.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("u"))
    least = heads.groupBy("key").agg(F.min("u").alias("v"), F.count("*").alias("c")).where("c > 1").select("key", "v")
    joint = heads.join(least, "key").where("u <> v").select("u", "v")
    ties = stored(close.union(stars.where("kind = 0").select("a", "b")).union(joint).distinct(), "ties")
    for table in (*mets, stars):
        discard(table)
    clusters = stored(connected(ties), "clusters")

    # one text for each node of a cluster, its set, and blocks of about BLOCK_SHINGLES
    one = nodes.join(clusters.toDF("name1", "cluster"), "name1").select("node", "row", "n_shingles", "cluster")
    sizes = one.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_SETS)).cast("int").alias("blocks"), F.count("*").alias("c"))
    block = F.pmod(F.xxhash64(F.lit(9), "node"), F.col("blocks")).cast("int")
    total = nodes.count()
    placed = stored(weighted_join(one, sizes, ["cluster"], "c", total).select("row", "cluster", "node", "blocks", block.alias("block")), "placed")

    # the texts of clusters' sets, fetched once
    texts = stored(frame.join(placed.hint("merge"), "row").dropDuplicates(["node"]).select(*_MEMBER, "text"), "members")
    sets = lambda which: texts.where(which).mapInArrow(lambda it: _members(it, n), "cluster long, node long, blocks int, block int, shingles array<long>")
    whole = sets("blocks = 1").select("cluster", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "node", "shingles")
    links = stored(_links(whole, num, den), "links")
    if not placed.where("blocks > 1").isEmpty():
        big = stored(sets("blocks > 1"), "sets")
        links = links.union(_large(big, num, den))
        discard(big)
    discard(texts)
    found = connected(links)
    named = stored(nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("c"))
    named = weighted_join(named, least, ["component"], "c", total).select("name1", "name2", "component_id", "component", "copies")
    out = weighted_join(sketched, named, ["name1", "name2"], "copies", sketched.count(), "left")
    return out.select("id", "row", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), "component")


def one_of_each(docs: DataFrame, num: int = 8, den: int = 10, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row left of each group of near duplicates: that of the smallest id, then row name.

    Groups are told apart by their own names, as ids may be null or repeated.
    Texts without words are in no group and stay, all of them.
    """
    found = jaccard_components(docs, num, den, n, id_col, text_col).where("n_shingles > 0")
    (row,) = unused(docs.columns, "__row")
    least = found.groupBy("component").agg(F.min(F.struct("id", "row")).alias("x")).select(F.col("x.row").alias(row))
    rows = docs.withColumn(row, row_name(id_col, text_col))
    some = F.coalesce(F.col(text_col).rlike(f"[^{SPACE}]"), F.lit(False))
    kept = rows.where(some).join(least, row, "left_semi").dropDuplicates([row])
    return kept.select(*docs.columns).union(rows.where(~some).select(*docs.columns))


def op8_parity_sketch_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents by 3-word shingles at a similarity of 0.9 or more."""
    out = jaccard_components(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
OP8_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT r, w[i:i + 2] AS g FROM (SELECT r, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
e AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT r, r AS t FROM d UNION SELECT reach.r, l.b FROM reach JOIN l ON l.a = reach.t)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) JOIN reach ON reach.r = d.r JOIN d o ON o.r = reach.t GROUP BY d.r, d.doc_id, n.n
"""
