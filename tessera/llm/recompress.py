"""Exact removal of repeated passages by recompression.

A text is a string of words. Rounds of recompression shorten it: runs of one
symbol, and pairs of a left and a right symbol (sides follow from a hash of the
symbol and the round), become one symbol. What merges depends on a symbol's
neighbours alone, so deep inside equal substrings all symbols agree. For every
symbol the words that its existence depends on are tracked exactly.

Names are global. Every round is a few DataFrame steps: blocks of texts propose
the distinct runs and pairs they form; the proposals of all blocks are grouped
into the round's names table, which gives each distinct one that two texts or
more have a number of its own; the table is joined back to the blocks. The first
round names the words themselves. So equal names mean equal words, with no hash
in between (a proposal has what it consists of, by the names of the round
before). A symbol that only one text has is dead: it merges no further, and
no window that holds it can repeat. Rounds go on until nothing merged is shared.

High symbols of `width` words or more prove repeats by themselves: all windows
inside one repeat if a text with a smaller id has it. The other windows are
represented by one symbol each whose dependencies lie inside the window;
neighbouring windows of one representative are a run. Runs, and windows where
runs differ, are compared by the symbols that make them up (the largest inside,
and the words at either end), which equal strings share.

Texts that share nothing shall not pay for that: a text's own parse, with hashes
as provisional names, first finds the stretches whose representatives occur in
another text. Only those enter the rounds. Names may collide there; that only
lets a stretch in that the rounds then find to be unique.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, combined, discard, documents, grouped, mix64, narrowed, places, row_blocks, row_name, stored, text_bytes, unused, weighted_join, word_names, word_spans

#: Bytes of text that a task works on at once; longer texts stand alone.
BLOCK = 2 << 20


class Words:
    """Words of a block of texts, end to end: bytes, spans, 128-bit names (two halves), and each text's first word."""

    def __init__(self, texts: list[bytes | None]):
        self.data = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)
        sizes = np.array([len(t or b"") + 1 for t in texts], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(sizes)))
        self.starts, self.ends = word_spans(self.data)
        self.first = np.searchsorted(self.starts, self.begin)
        self.names, self.more = word_names(self.data, self.starts, self.ends)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def joined(self, lo: int, hi: int, keep: np.ndarray | None = None) -> bytes:
        """Words lo to hi (those kept) joined by one space."""
        at = np.arange(lo, hi) if keep is None else lo + np.flatnonzero(keep)
        if not len(at):
            return b""
        n = self.ends[at] - self.starts[at] + 1
        to = np.concatenate(([0], np.cumsum(n)[:-1]))
        flat = np.repeat(self.starts[at] - to, n) + np.arange(int(n.sum()))
        out = self.data[flat]
        out[to + n - 1] = 32
        return out[:-1].tobytes()

    def distinct(self, at: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The different words among some, and for each of those which one it is. Words count as equal by all their bytes."""
        _, first, which = np.unique(self.names[at], return_index=True, return_inverse=True)
        if (self.more[at] != self.more[at[first]][which]).any():  # half a name for two words: go by the words
            place: dict[bytes, int] = {}
            which = np.fromiter((place.setdefault(self.data[self.starts[i] : self.ends[i]].tobytes(), len(place)) for i in at), np.int64, len(at))
            return list(place), which
        return [self.data[a:b].tobytes() for a, b in zip(self.starts[at[first]], self.ends[at[first]], strict=True)], which

    def without(self, i: int, gone: np.ndarray) -> bytes:
        """Text i without the words marked, and without the white space behind each stretch of them."""
        lo, hi = self.first[i], self.first[i + 1]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
        out, at = [], self.begin[i]
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            out.append(self.data[at : self.starts[lo + a]])
            at = self.starts[lo + b] if lo + b < hi else self.begin[i + 1] - 1
        out.append(self.data[at : self.begin[i + 1] - 1])
        return np.concatenate(out).tobytes()


# ---- one round --------------------------------------------------------------


@dataclass
class Strand:
    """Symbols of several texts, end to end.

    name, text, first word a and number of words span of each symbol; lo and hi,
    the words [lo, hi) that its existence depends on; dead, whether only one text
    has it. Where a text's end was looked at, lo or hi is one word beyond it: the
    text may be a cut of a longer one. first has the first word of every text,
    and the end.
    """

    name: np.ndarray
    text: np.ndarray
    a: np.ndarray
    span: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    dead: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(names: np.ndarray, first: np.ndarray) -> Strand:
        at = np.arange(len(names))
        return Strand(names, np.repeat(np.arange(len(first) - 1), np.diff(first)), at, np.ones(len(at), np.int64), at, at + 1, np.zeros(len(at), bool), first)


def merge(x: Strand, cap: int, turn: int) -> Strand:
    """Merge runs, then pairs, nothing longer than cap words and nothing dead. Hashes name what is merged."""
    if not len(x.name):
        return x
    below, above = x.first[:-1] - 1, x.first[1:] + 1
    name, text, size = x.name.view(np.uint64), x.text, len(x.name)
    # runs
    start = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (text[1:] != text[:-1]) | x.dead[1:])))
    end = np.concatenate((start[1:], [size]))
    count, own = end - start, text[start]
    left = np.where((start > 0) & (text[start - 1] == own), x.lo[start - 1], below[own])
    after = np.minimum(end, size - 1)
    right = np.where((end < size) & (text[after] == own), x.hi[after], above[own])
    together = (count > 1) & (count * x.span[start] <= cap)
    some = np.where(together, 1, count)
    which = np.repeat(np.arange(len(start)), some)
    at = start[which] + np.arange(len(which)) - np.repeat(np.cumsum(some) - some, some)
    times = np.where(together, count, 1)[which]
    name, text, a, span, dead = name[at], text[at], x.a[at], x.span[at] * times, x.dead[at]
    with np.errstate(over="ignore"):
        name = np.where(times > 1, mix64(name + times.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), name)
        right_side = (mix64(name + np.uint64(turn + 1) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(63)).astype(bool)
    # what a dead symbol depends on is settled
    lo, hi = np.where(dead, x.lo[at], np.minimum(x.lo[start], left)[which]), np.where(dead, x.hi[at], np.maximum(x.hi[end - 1], right)[which])
    # pairs
    same = text[1:] == text[:-1]
    pair = np.zeros(len(name), bool)
    pair[:-1] = same & ~right_side[:-1] & right_side[1:] & (span[:-1] + span[1:] <= cap) & ~dead[:-1] & ~dead[1:]
    before = np.where(np.concatenate(([False], same)), np.concatenate(([0], lo[:-1])), below[text])
    behind = np.where(np.concatenate((same, [False])), np.concatenate((hi[1:], [0])), above[text])
    lo, hi = np.where(right_side & ~dead, before, lo), np.where(right_side | dead, hi, behind)
    following = lambda v: np.concatenate((v[1:], np.zeros(1, v.dtype)))
    name, span = np.where(pair, combined(name, following(name)), name), np.where(pair, span + following(span), span)
    keep = np.concatenate(([True], ~pair[:-1]))
    return Strand(*(v[keep] for v in (name, text, a, span, lo, hi, dead)), x.first)


def caps_for(width: int) -> tuple[int, ...]:
    """Longest symbols by round: doubling, as long as a window still holds several with their surroundings."""
    out, cap = [], 2
    while cap * 6 <= width:
        out.append(cap)
        cap *= 2
    return tuple(out)


def provisional(names: np.ndarray, first: np.ndarray, caps: tuple[int, ...]) -> Strand:
    """Rounds within a block, with hashes for names."""
    x = Strand.of(names, first)
    for turn, cap in enumerate(caps):
        x = merge(x, cap, turn)
    return x


# ---- windows ----------------------------------------------------------------


def window_hashes(h: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of every window of so many values, put together from halves."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        have = mix64(h + np.uint64(seed + 1))
    out, done, length, left = None, 0, 1, width
    while left:
        if left & 1:
            piece = have[done : done + n]
            out = piece if out is None else combined(out, piece, 1)
            done += length
        left >>= 1
        if left:
            have = combined(have[: len(have) - length], have[length:], 2)
            length *= 2
    return mix64(out)


class Ranges:
    """Hash of any range of an array, from overlapping ranges whose lengths are powers of two."""

    def __init__(self, values: np.ndarray, most: int, seed: int):
        with np.errstate(over="ignore"):
            self.tables = [mix64(values.view(np.uint64) + np.uint64(seed + 1))]
        length = 1
        while 2 * length <= min(most, len(values)):
            t = self.tables[-1]
            self.tables.append(combined(t[: len(t) - length], t[length:], 3))
            length *= 2

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        n = hi - lo
        out = np.zeros(len(lo), np.uint64)
        level = np.zeros(len(lo), np.int64)
        level[n > 0] = np.floor(np.log2(n[n > 0])).astype(np.int64)
        for k, table in enumerate(self.tables):
            at = (n > 0) & (level == k)
            out[at] = combined(table[lo[at]], table[hi[at] - (1 << k)], 4)
        return combined(out, n.astype(np.uint64), 5)


def identities(x: Strand, words: np.ndarray, lo: np.ndarray, hi: np.ndarray, seed: int) -> np.ndarray:
    """What the words [lo, hi) are made of: all symbols that depend on nothing outside, and the words before and behind them."""
    most = int((hi - lo).max()) if len(lo) else 0
    i, j = np.searchsorted(x.lo, lo, "left"), np.searchsorted(x.hi, hi, "right")
    some = i < j
    last = np.maximum(j - 1, 0)
    if not len(x.a):
        return np.zeros(len(lo), np.uint64)
    i = np.where(some, i, 0)
    left = np.where(some, x.a[np.minimum(i, len(x.a) - 1)], hi)
    right = np.where(some, x.a[last] + x.span[last], hi)
    plain, high = Ranges(words, most, seed), Ranges(x.name, most, seed)
    out = combined(plain.of(lo, left), high.of(i, np.where(some, j, 0)), 6)
    return combined(out, plain.of(right, hi), 7)


def representatives(x: Strand, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (by first word) that lie in one text, the key of each, and whether the key differs from the window before."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    text = np.repeat(np.arange(len(x.first) - 1), np.diff(x.first))
    inside = text[:n] == text[width - 1 :]
    first, last = np.maximum(x.hi - width, 0), np.minimum(x.lo, n - 1)  # windows that hold all the symbol depends on
    able = (first <= last) & (x.hi - x.lo <= width) & (x.lo >= 0)
    name, lo, hi, first, last = (v[able] for v in (x.name.view(np.uint64), x.lo, x.hi, first, last))
    order = np.argsort(mix64(name), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    # least rank over all symbols whose range [first, last] has the window: ranges as two halves of a power of two
    none = np.int64(len(order))
    level = np.floor(np.log2(np.maximum(last - first + 1, 1))).astype(np.int64) if len(order) else np.zeros(0, np.int64)
    layer = np.full(n, none)
    for k in range(int(level.max()) if len(level) else 0, -1, -1):
        own = level == k
        np.minimum.at(layer, first[own], rank[own])
        np.minimum.at(layer, last[own] - (1 << k) + 1, rank[own])
        if k:
            half, lower = 1 << (k - 1), layer.copy()
            lower[half:] = np.minimum(lower[half:], layer[:-half])
            layer = lower
    at = np.flatnonzero(inside)
    chosen = layer[at]
    found = chosen < none
    key = np.zeros(len(at), np.uint64)
    if len(order):
        with np.errstate(over="ignore"):
            powers, inverse = _powers(len(words)), _powers(len(words), inverse=True)
            prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words.view(np.uint64) * powers, dtype=np.uint64)))
            s = order[np.where(found, chosen, 0)]
            key = mix64(mix64(name[s]) + (prefix[hi[s]] - prefix[lo[s]]) * inverse[lo[s]])
    if not found.all():
        key = np.where(found, key, window_hashes(words.view(np.uint64), width, 7)[at])
    fresh = np.ones(len(at), bool)
    fresh[1:] = (np.diff(at) != 1) | (chosen[1:] != chosen[:-1]) | ~found[1:]
    return at, key, fresh


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    odd = 0xD1342543DE82EF95
    with np.errstate(over="ignore"):
        p = np.full(n, np.uint64(pow(odd, -1, 2**64) if inverse else odd), np.uint64)
        if n:
            p[0] = 1
        return np.cumprod(p, dtype=np.uint64)


# ---- what runs on Arrow batches ---------------------------------------------


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from row_blocks(batch, "text", BLOCK)


def _lists(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def _sketch(batches: Iterator[pa.RecordBatch], width: int) -> Iterable[pa.RecordBatch]:
    """Per text: words, digest of its words, and the distinct keys of its windows."""
    for part in _parts(batches):
        words = Words(text_bytes(part.column("text")))
        at, key, fresh = representatives(provisional(words.names, words.first, caps_for(width)), words.names, width)
        key, doc = key[fresh].view(np.int64), words.text[at[fresh]]
        order = np.lexsort((key, doc))
        key, doc = key[order], doc[order]
        once = np.concatenate(([True], (np.diff(key) != 0) | (np.diff(doc) != 0)))[: len(key)]
        key, doc = key[once], doc[once]
        cuts = np.searchsorted(doc, np.arange(part.num_rows + 1))
        sha = [hashlib.sha256(words.joined(a, b)).digest() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [part.column("id"), part.column("row"), pa.array(np.diff(words.first), pa.int64()), pa.array(sha, pa.binary()), _lists(key, cuts, pa.int64())],
            ["id", "row", "n_words", "content", "keys"],
        )


_LONG, _INT = pa.int64(), pa.int32()
#: What a block's state holds, in this order. n words of document doc from its word `at` on: the stretches of a block;
#: word: names of their words; the others: symbols, and those of a window's width or more that were shared (top).
_STATE = {"doc": "<i4", "at": "<i4", "n": "<i4", "word": "<i8", "name": "<i8", "which": "<i4", "span": "<i4", "lo": "<i4", "hi": "<i4", "top_name": "<i8", "top_a": "<i4", "top_span": "<i4"}


def _packed(state: dict) -> bytes:
    """Arrays as one value: rows of a block pass Spark as a few bytes columns, not element by element.

    It is compressed, since tasks hold several blocks at once: lo and hi, which
    lie close to a symbol's own words, as distances from these.
    """
    arrays = {c: np.ascontiguousarray(state.get(c, ()), kind) for c, kind in _STATE.items()}
    if len(arrays["lo"]):
        end = np.cumsum(arrays["span"], dtype="<i4")
        arrays |= {"lo": arrays["lo"] - end, "hi": arrays["hi"] - end}
    sizes = np.array([len(x) for x in arrays.values()], "<i8").tobytes()
    return sizes + pa.compress(b"".join(x.tobytes() for x in arrays.values()), "zstd", asbytes=True)


def _unpacked(data: bytes) -> dict:
    at = 8 * len(_STATE)
    sizes = dict(zip(_STATE, np.frombuffer(data, "<i8", len(_STATE)).tolist(), strict=True))
    total = sum(n * np.dtype(_STATE[c]).itemsize for c, n in sizes.items())
    whole = pa.decompress(memoryview(data)[at:], total, "zstd") if total else b""
    out, at = {}, 0
    for c, n in sizes.items():
        out[c] = np.frombuffer(whole, _STATE[c], n, at)
        at += out[c].nbytes
    if len(out["lo"]):
        end = np.cumsum(out["span"], dtype="<i4")
        out |= {"lo": out["lo"] + end, "hi": out["hi"] + end}
    return out


ALONE, KNOWN = 0, 1


def _local(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Keys of a task's documents, one row each. Of a key that several of them have two go on, the others are KNOWN to be shared."""
    held: list[list[np.ndarray]] = []

    def flush() -> Iterable[pa.RecordBatch]:
        key, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        keep, place = places(key, doc)
        rows = [x[keep] for x in ((place >= 2).astype(np.int8), key, doc)]  # in the order of the documents, which shuffles smaller
        for a in range(0, len(rows[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in rows], ["kind", "key", "doc"])

    for batch in batches:
        keys = batch.column("keys")
        held.append([keys.flatten().to_numpy(), np.repeat(batch.column("doc").to_numpy(), np.diff(keys.offsets.to_numpy()))])
        if sum(len(x[0]) for x in held) >= CHUNK:
            yield from flush()
            held = []
    if held:
        yield from flush()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """doc, key of keys that two documents or more have, for a partition sorted by key and doc. One row waits for the next batch."""
    rest = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    going = None  # the last key, if it is known to be shared

    for batch in batches:
        key, doc = batch.column("key").to_numpy(), batch.column("doc").to_numpy()
        known = batch.column("kind").to_numpy() == KNOWN
        done = [(key[known], doc[known])]
        (key, doc), start, size = grouped([np.concatenate((a, b[~known])) for a, b in zip(rest, (key, doc), strict=True)])
        if len(key):
            many = size > 1
            many[0] |= going is not None and key[0] == going
            going = key[-1] if many[-1] else None
            rest = (key[-1:], doc[-1:]) if not many[-1] else (key[:0], doc[:0])
            common = np.repeat(many, size)
            done.append((key[common], doc[common]))
        key, doc = (np.concatenate(x) for x in zip(*done, strict=True))
        if len(key):
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key)], ["doc", "key"])


def _list_of_one(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], _INT), values)


def _block(ids: pa.Array, rows: pa.Array, state: dict, block: pa.Array | None = None, keys: list[bytes] | None = None, many: np.ndarray | None = None) -> pa.RecordBatch:
    """A batch of one block, with what waits for names, if anything."""
    columns = {} if block is None else {"block": block}
    columns |= {"ids": _list_of_one(ids), "rows": _list_of_one(rows), "state": pa.array([_packed(state)], pa.binary())}
    if keys is not None:
        columns |= {"keys": _list_of_one(pa.array(keys, pa.binary())), "many": _list_of_one(pa.array(many, pa.bool_()))}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


_NAMED = "state binary"
_WAITING = "state binary, keys array<binary>, many array<boolean>"


def _many(which: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Which of n proposals two documents of the block or more have."""
    least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    np.minimum.at(least, which, doc)
    np.maximum.at(most, which, doc)
    return least < most


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterable[pa.RecordBatch]:
    """Blocks of the stretches that wanted keys cover, with their distinct words."""
    for part in _parts(batches):
        words = Words(text_bytes(part.column("text")))
        at, key, fresh = representatives(provisional(words.names, words.first, caps_for(width)), words.names, width)
        start = np.flatnonzero(fresh)
        count = np.diff(np.concatenate((start, [len(at)])))
        at, key = at[start], key[start].view(np.int64)
        doc = words.text[at]
        keep = np.zeros(len(at), bool)
        wanted = part.column("wanted")
        for i in range(part.num_rows):
            a, b = np.searchsorted(doc, [i, i + 1])
            keep[a:b] = np.isin(key[a:b], wanted[i].values.to_numpy())
        edge = np.zeros(len(words.names) + 1, np.int32)
        np.add.at(edge, at[keep], 1)
        np.add.at(edge, at[keep] + count[keep] + width - 1, -1)
        covered = np.cumsum(edge)[:-1] > 0
        cut = np.flatnonzero(covered & np.concatenate(([True], ~covered[:-1] | (words.text[1:] != words.text[:-1])))[: len(covered)])
        if not len(cut):
            continue
        held = np.flatnonzero(covered)
        n = np.diff(np.concatenate((np.searchsorted(held, cut), [len(held)])))
        place, which = words.distinct(held)
        of = words.text[cut]
        state = {"doc": of, "at": cut - words.first[of], "n": n, "which": which}
        yield _block(part.column("id"), part.column("row"), state, keys=place, many=_many(which, words.text[held], len(place)))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, dict]]:
    """Each block's number, and its columns as arrays."""
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            row = _unpacked(one.column("state")[0].as_py()) | {c: one.column(c).flatten() for c in ("ids", "rows")}
            for c in ("places", "found", "settled", "runs"):
                if c in batch.schema.names and one.column(c).null_count == 0:
                    row[c] = one.column(c).flatten()
            yield one.column("block"), row


def _answer(row: dict) -> np.ndarray:
    """Names of a block's proposals by place; -1 for those that no other text makes."""
    table = np.full(int(row["which"].max(initial=-1)) + 1, -1, np.int64)
    if "found" in row:
        table[row["places"].to_numpy()] = row["found"].to_numpy()
    return table


def _strand(row: dict) -> Strand:
    first = np.concatenate(([0], np.cumsum(row["n"], dtype=np.int64)))
    span = row["span"].astype(np.int64)
    a = np.cumsum(span) - span
    return Strand(row["name"], np.searchsorted(first, a, "right") - 1, a, span, *(row[c].astype(np.int64) for c in ("lo", "hi")), row["name"] < 0, first)


def _lettered(blocks: Iterable[tuple[pa.Array, dict]]) -> Iterator[tuple[pa.Array, dict]]:
    """Blocks with their words named: the strands that the rounds begin with."""
    for block, row in blocks:
        word = _answer(row)[row["which"]]
        at = np.arange(len(word))
        yield block, row | {"word": word, "name": word, "which": np.full(len(word), -1), "span": np.ones(len(word), np.int32), "lo": at, "hi": at + 1}


def _named(blocks: Iterable[tuple[pa.Array, dict]], width: int) -> Iterator[tuple[pa.Array, dict]]:
    """Blocks with the names of a round filled in; shared symbols of a window's width or more are noted."""
    for block, row in blocks:
        which = row["which"]
        merged = which >= 0
        name = row["name"].copy()
        name[merged] = _answer(row)[which[merged]]
        top = merged & (name >= 0) & (row["span"] >= width)
        a = np.cumsum(row["span"], dtype=np.int64) - row["span"]
        more = {f"top_{c}": np.concatenate((row[f"top_{c}"], v[top])) for c, v in (("name", name), ("a", a), ("span", row["span"]))}
        yield block, row | {"name": name, "which": np.full(len(name), -1)} | more


def _kept(blocks: Iterable[tuple[pa.Array, dict]]) -> Iterable[pa.RecordBatch]:
    for block, row in blocks:
        yield _block(row["ids"], row["rows"], row, block)


def _proposed(blocks: Iterable[tuple[pa.Array, dict]], caps: tuple[int, ...], turn: int, words: bool) -> Iterable[pa.RecordBatch]:
    """Blocks after the merges of a round. What a merged symbol consists of, runs as a name and a number, waits for a name."""
    for block, row in blocks:
        x = y = _strand(row)
        for step, cap in enumerate(caps):
            y = merge(y, cap, turn + step)
        begin = np.searchsorted(x.a, y.a)
        count = np.diff(np.concatenate((begin, [len(x.a)])))
        head = np.zeros(len(x.a), bool)
        head[begin] = True
        head[1:] |= x.name[1:] != x.name[:-1]
        part = np.flatnonzero(head)
        times = np.diff(np.concatenate((part, [len(x.a)])))
        flat = np.stack((x.name[part], times), axis=1).astype("<i8").tobytes()
        changed = np.flatnonzero(count > 1)
        cuts = 16 * np.searchsorted(part, np.concatenate((begin, [len(x.a)])))
        place: dict[bytes, int] = {}
        proposal = np.fromiter((place.setdefault(flat[a:b], len(place)) for a, b in zip(cuts[changed].tolist(), cuts[changed + 1].tolist(), strict=True)), np.int64, len(changed))
        which = np.full(len(y.a), -1)
        which[changed] = proposal
        state = {c: row[c] for c in ("doc", "at", "n", "top_name", "top_a", "top_span")}
        state |= {"name": np.where(which < 0, x.name[begin], 0), "which": which, "span": y.span, "lo": y.lo, "hi": y.hi}
        if words:
            state["word"] = row["word"]
        yield _block(row["ids"], row["rows"], state, block, list(place), _many(proposal, row["doc"][y.text[changed]], len(place)))


def _places(row: dict, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document (by its place in the block) and word in it of words of a block."""
    first = np.concatenate(([0], np.cumsum(row["n"], dtype=np.int64)))
    s = np.searchsorted(first, w, "right") - 1
    return row["doc"][s], row["at"][s] + w - first[s]


def _tops(blocks: Iterable[tuple[pa.Array, dict]], width: int) -> Iterable[pa.RecordBatch]:
    """The high symbols of all blocks, one row for each."""
    for block, row in blocks:
        a = row["top_a"].astype(np.int64)
        doc, at = _places(row, a)
        doc = pa.array(doc)
        columns = [pa.array(np.full(len(a), block[0].as_py())), row["ids"].take(doc), row["rows"].take(doc), pa.array(row["top_name"])]
        columns += [pa.array(v, _INT) for v in (a, at, row["top_span"] - width + 1)]
        yield pa.RecordBatch.from_arrays(columns, ["block", "id", "row", "name", "w", "at", "n"])


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterable[pa.RecordBatch]:
    """Runs of windows that high symbols haven't settled: first window, number of windows, what their words are made of."""
    for block, row in _rows(batches):
        x, word = _strand(row), row["word"]
        at, key, fresh = representatives(x, word, width)
        edge = np.zeros(len(word) + 2, np.int32)
        dead = x.name < 0  # a window that holds all a dead symbol depends on stands in one text
        lo, hi = np.maximum(x.hi[dead] - width, 0), np.minimum(x.lo[dead], len(word))
        lo, hi = lo[lo <= hi], hi[lo <= hi]
        np.add.at(edge, lo, 1)
        np.add.at(edge, hi + 1, -1)
        if "settled" in row:
            w, n = (row["settled"].field(c).to_numpy() for c in ("w", "n"))
            np.add.at(edge, w, 1)
            np.add.at(edge, w + n, -1)
        open_ = (np.cumsum(edge)[: len(word)] == 0)[at]
        fresh[1:] |= ~open_[:-1]
        at, key, fresh = at[open_], key[open_], fresh[open_]
        start = np.flatnonzero(fresh)
        count = np.diff(np.concatenate((start, [len(at)])))
        w, key = at[start], key[start]
        doc, place = _places(row, w)
        doc = pa.array(doc)
        one, two = (identities(x, word, w, w + count + width - 1, s).view(np.int64) for s in (1, 2))
        columns = [pa.array(np.full(len(w), block[0].as_py())), row["ids"].take(doc), row["rows"].take(doc), pa.array(key.view(np.int64))]
        columns += [pa.array(v, _INT) for v in (w, place, count)] + [pa.array(one), pa.array(two)]
        yield pa.RecordBatch.from_arrays(columns, ["block", "id", "row", "key", "w", "at", "n", "one", "two"])


def _windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterable[pa.RecordBatch]:
    """Windows of the runs that are named (by what the run is made of and the place in it), with what each is made of."""
    for _, row in _rows(batches):
        x = _strand(row)
        first, count, *run = (row["runs"].field(c).to_numpy().astype(np.int64) for c in ("w", "n", "one", "two"))
        off = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        w = np.repeat(first, count) + off
        one, two = (identities(x, row["word"], w, w + width, s).view(np.int64) for s in (3, 4))
        ids = row["ids"].take(pa.array(_places(row, w)[0]))
        yield pa.RecordBatch.from_arrays([ids, *[pa.array(np.repeat(r, count)) for r in run], pa.array(off, _INT), pa.array(one), pa.array(two)], ["id", "run1", "run2", "off", "one", "two"])


def _remove(batches: Iterator[pa.RecordBatch], width: int) -> Iterable[pa.RecordBatch]:
    """Per text: words that go, the text without them, and the digest of the words that stay."""
    for part in _parts(batches):
        words = Words(text_bytes(part.column("text")))
        removed, left, sha = [], [], []
        for i, found in enumerate(part.column("repeated").to_pylist()):
            a, b = words.first[i], words.first[i + 1]
            edge = np.zeros(b - a + 1, np.int32)
            at, n = (np.asarray([r[c] for r in found], np.int64) for c in ("at", "n"))
            np.add.at(edge, at, 1)
            np.add.at(edge, at + n + width - 1, -1)
            gone = np.cumsum(edge)[:-1] > 0
            removed.append(int(gone.sum()))
            left.append(words.without(i, gone))
            sha.append(hashlib.sha256(words.joined(a, b, ~gone)).digest())
        yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(removed, _LONG), pa.array(left, pa.binary()).cast(pa.string()), pa.array(sha, pa.binary())], ["row", "n_removed", "left", "kept"])


# ---- the rounds -------------------------------------------------------------


#: Merges of the first round above the symbols that fit a window; later ones do more each, half as many as were done before,
#: since a round is a few Spark jobs and ever fewer symbols are left.
MERGES = 3


def _round(blocks: DataFrame, turn: int, seen: list[DataFrame] | None) -> tuple[DataFrame, DataFrame]:
    """Blocks with the answers to their proposals (places, and the names found for them), and the round's names table.

    The table has one row (the proposal, its name) for each distinct proposal
    that two texts or more make; the row's number is its name. A proposal is a
    word's bytes in the first round, later names and numbers of repeats.
    """
    proposed = blocks.select("block", F.posexplode(F.arrays_zip("keys", "many")).alias("place", "p")).select("block", "place", F.col("p.keys").alias("key"), "p.many")
    shared = proposed.groupBy("key").agg(F.sum(F.when(F.col("many"), 2).otherwise(1)).alias("texts")).where("texts > 1")
    names = stored(shared.select("key", (F.monotonically_increasing_id() * 64 + turn).alias("name")), f"names-{turn}")
    if seen is not None:
        seen.append(names)
    found = proposed.select("block", "place", "key").join(names, "key").groupBy("block").agg(F.collect_list("place").alias("places"), F.collect_list("name").alias("found"))
    return blocks.drop("keys", "many").join(found, "block", "left"), names


def recompress(texts: DataFrame, width: int, seen: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rounds over texts (id, row, text, wanted): (blocks, tops).

    blocks: the strands whose symbols fit a window with their surroundings.
    tops: one row per shared symbol of width words or more. Round 0 names words,
    the next ones a run or pair each, those above strings that several merges of
    runs and pairs make; they end when no text shares what it merged. Names
    tables of the rounds are appended to seen, if given, and deleted otherwise.
    """
    kind = texts.schema["id"].dataType.simpleString()
    fixed = f"ids array<{kind}>, rows array<binary>, "

    def kept(df: DataFrame, *old: DataFrame) -> DataFrame:
        out = stored(df, "strands")
        for table in old:
            discard(table)
        return out

    used = lambda names: [] if seen is not None else [names]
    cut = texts.mapInArrow(lambda it: _blocks(it, width), fixed + _WAITING)
    blocks = stored(cut.select(F.monotonically_increasing_id().alias("block"), "*"), "blocks")
    fixed = "block long, " + fixed
    answered, names = _round(blocks, 0, seen)
    fill = _lettered
    for turn, cap in enumerate(caps_for(width)):
        blocks = kept(answered.mapInArrow(lambda it, fill=fill, cap=cap, turn=turn: _proposed(fill(_rows(it)), (cap,), turn, True), fixed + _WAITING), blocks, *used(names))
        answered, names = _round(blocks, turn + 1, seen)
        fill = lambda rows: _named(rows, width)
    base = kept(answered.mapInArrow(lambda it: _kept(fill(_rows(it))), fixed + _NAMED), blocks, *used(names))
    turn = rounds = len(caps_for(width))
    blocks, old = base, []
    while not old or not names.isEmpty():
        merges = max(MERGES, turn // 2)
        caps = tuple(2 << min(turn + k, 60) for k in range(merges))
        blocks = kept(blocks.mapInArrow(lambda it, caps=caps, turn=turn: _proposed(_named(_rows(it), width), caps, turn, False), fixed + _WAITING), *old)
        turn, rounds, old = turn + merges, rounds + 1, [blocks]
        blocks, names = _round(blocks, rounds, seen)
        old += used(names)
    tops = stored(blocks.mapInArrow(lambda it: _tops(_named(_rows(it), width), width), f"block long, id {kind}, row binary, name long, w int, at int, n int"), "tops")
    for table in old:
        discard(table)
    return base, tops


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> tuple[DataFrame, DataFrame]:
    """What repeats: (rows, contents).

    rows: per row id, row (a name of id and text), n_words and content (SHA-256
    of its words joined by spaces). contents: per content first_id, the smallest
    id that has it, and, if that document loses words, n_removed, left (the text
    without them) and kept (SHA-256 of the words that stay, joined by spaces).

    A word goes if a window of `width` words that covers it also starts in a
    document with a smaller id; windows are judged on the input. Equal contents
    are compared once. Rows that share an id don't repeat each other. Rows with
    a null id neither lose words nor cause others to; a null text has no words.
    No rows give no rows. Other columns of docs, whatever their names, are left
    behind.
    """
    frame = docs.select(F.col(id_col).alias("id"), row_name(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    kind = frame.schema["id"].dataType.simpleString()
    sketched = stored(frame.mapInArrow(lambda it: _sketch(it, width), f"id {kind}, row binary, n_words long, content binary, keys array<long>"), "sketches")
    firsts = sketched.where("id IS NOT NULL").groupBy("content").agg(F.min(F.struct("id", "row")).alias("m"))
    firsts = stored(firsts.select(F.monotonically_increasing_id().alias("doc"), "content", F.col("m.id").alias("first_id"), F.col("m.row").alias("row")), "firsts")
    # rows of one name are alike and so one doc
    keys = sketched.where(F.size("keys") > 0).select("row", "keys").join(firsts.select("row", "doc").hint("merge"), "row").select("doc", "keys").mapInArrow(_local, "kind byte, key long, doc long")
    dealt = keys.repartition(F.when(F.col("kind") == KNOWN, F.xxhash64("key", "doc")).otherwise(F.xxhash64("key")))
    wanted = dealt.sortWithinPartitions("key", "doc").mapInArrow(_shared, "doc long, key long").groupBy("doc").agg(F.collect_list("key").alias("wanted"))
    named = wanted.join(firsts.select("doc", "row"), "doc").drop("doc")
    texts = stored(frame.join(named.hint("merge"), "row").dropDuplicates(["row"]), "texts")
    sketched = narrowed(sketched, "contents-of-rows", "id", "row", "n_words", "content")

    blocks, tops = recompress(texts, width)
    # a passage that very many documents hold is one name: its rows are joined by broadcast
    least = tops.groupBy("name").agg(F.min("id").alias("least"), F.count("*").alias("c"))
    settled = stored(weighted_join(tops, least, ["name"], "c", tops.count()).where("least < id").select("block", "row", "w", "at", "n"), "settled")
    discard(tops)
    by_block = settled.groupBy("block").agg(F.collect_list(F.struct("w", "n")).alias("settled"))
    runs = blocks.join(by_block, "block", "left").mapInArrow(lambda it: _runs(it, width), f"block long, id {kind}, row binary, key long, w int, at int, n int, one long, two long")
    runs = stored(runs, "runs")
    first = F.min(F.struct("id", "row", "at", "n", "key", "block", "w")).alias("m")
    kinds = runs.groupBy("one", "two").agg(first, F.count("*").alias("c")).select("one", "two", F.col("m.id").alias("least"), "m.key", "m.block", "m.w", "m.n", "c")
    kinds = stored(kinds, "kinds")
    known = weighted_join(runs.select("id", "row", "at", "n", "one", "two"), kinds.select("one", "two", "least", "c"), ["one", "two"], "c", runs.count())
    whole = known.where("least < id").select("row", "at", "n")
    # a kind of run that nothing before it has: its windows, once, and what comes of them wherever the first document has the run
    alike = kinds.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    open_ = weighted_join(kinds.drop("c"), alike, ["key"], "c", kinds.count()).groupBy("block").agg(F.collect_list(F.struct("w", "n", "one", "two")).alias("runs"))
    each = stored(blocks.join(open_, "block").mapInArrow(lambda it: _windows(it, width), f"id {kind}, run1 long, run2 long, off int, one long, two long"), "windows")
    least = each.groupBy("one", "two").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("one", "two", "least")
    single = each.join(least, ["one", "two"]).where("least < id").select(F.col("run1").alias("one"), F.col("run2").alias("two"), "off")
    single = known.where("least = id").select("row", "at", "one", "two").join(single, ["one", "two"]).select("row", (F.col("at") + F.col("off")).alias("at"), F.lit(1).alias("n"))
    repeated = settled.select("row", "at", "n").union(whole).union(single).groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("repeated"))
    changed = texts.select("row", "text").join(repeated, "row").mapInArrow(lambda it: _remove(it, width), "row binary, n_removed long, left string, kept binary")
    contents = stored(firsts.join(changed, "row", "left").drop("row", "doc"), "contents")
    for table in (texts, blocks, settled, runs, kinds, each, firsts):
        discard(table)
    return sketched, contents


def _verdict(rows: DataFrame, contents: DataFrame, width: int) -> DataFrame:
    """rows with n_removed, left and kept (both null where nothing goes)."""
    copy = F.coalesce((F.col("id") > F.col("first_id")) & (F.col("n_words") >= width), F.lit(False))
    first = F.coalesce(F.col("id") == F.col("first_id"), F.lit(False)) & F.col("n_removed").isNotNull()
    found = rows.join(contents, "content", "left")
    return found.select(
        *rows.columns,
        F.when(copy, F.col("n_words")).when(first, F.col("n_removed")).otherwise(F.lit(0).cast("long")).alias("n_removed"),
        F.when(copy, F.lit("")).when(first, F.col("left")).alias("left"),
        F.when(copy, F.unhex(F.sha2(F.lit(""), 256))).when(first, F.col("kept")).alias("kept"),
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """docs with repeated passages taken out of the texts; white space between the words that stay is kept.

    Texts that lose nothing stay as they are, and so do all other columns.
    """
    rows, contents = find_repeats(docs, id_col, text_col, width)
    row, left = unused(docs.columns, "__row", "__left")
    found = _verdict(rows, contents, width).where("n_removed > 0").select(F.col("row").alias(row), F.col("left").alias(left)).dropDuplicates([row])
    keyed = docs.withColumn(row, row_name(id_col, text_col))
    return keyed.join(found, row, "left").withColumn(text_col, F.coalesce(left, text_col)).select(*docs.columns)


def op4_recompression(spark, sf_dir: str, width: int = 50) -> DataFrame:
    """Words of every document, words removed, and the digest of those kept."""
    rows, contents = find_repeats(documents(spark, sf_dir).select("doc_id", "text"), width=width)
    out = _verdict(rows, contents, width)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.lower(F.hex(F.coalesce("kept", "content"))).alias("kept_sha256"))


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT r, doc_id, i, w[i:i + 49] AS g FROM (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d)),
rep AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY g) AS least FROM (SELECT r, doc_id, i, md5(array_to_string(g, ' ')) AS g FROM win)) WHERE least < doc_id),
gone AS (SELECT r, list(DISTINCT i + k) AS spots FROM rep, (SELECT unnest(generate_series(0, 49)) AS k) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(spots), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN spots IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, generate_series(1, len(w))), lambda x: NOT list_contains(spots, x[2])), lambda x: x[1]) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""
