"""Byte-level BPE by backtracking from longest matches, in linear time.

Bytes map to Latin-1 characters so that an Aho-Corasick automaton over the
vocabulary finds, in one pass over a piece, the longest token that starts at
each byte. The encoder takes longest matches, falls back to shorter prefixes
where two adjacent tokens would not stand next to each other after the merges,
and steps back where no prefix fits; positions found to be dead are never
entered again, which keeps the work linear. Adjacent-token compatibility is
decided from how the tokens were merged and is memoised.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents

#: Verdicts on adjacent tokens that a worker remembers.
MEMO_PAIRS = 1 << 20

#: Entries that a worker's cache of encoded pieces holds before it starts afresh.
CACHE_PIECES = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line a token in base 64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}


class Codec:
    """Encoder and decoder for one rank table. Ranks order the merges; every byte must be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if not regex.fullmatch(pattern, " x") or regex.fullmatch(pattern, "x "):
            raise ValueError("the pattern must let a space begin a match, not end one")
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.tokens = dict(map(reversed, ranks.items()))
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int] = {}
        self.memo: dict[int, bool] = {}
        reachable = []
        for rank, token in sorted(self.tokens.items()):
            if self._learn(rank, token):
                reachable.append(rank)
        self.sizes = [0] * (max(self.tokens, default=-1) + 1)
        for rank, token in self.tokens.items():
            self.sizes[rank] = len(token)
        self.automaton = ahocorasick.Automaton()
        for rank in reachable:
            self.automaton.add_word(self.tokens[rank].decode("latin-1"), rank)
        self.automaton.make_automaton()
        whole = set(reachable)
        for rank in reachable:
            token = self.tokens[rank]
            self.shorter[rank] = next((r for n in range(len(token) - 1, 0, -1) if (r := ranks.get(token[:n])) is not None and r in whole), -1)
        self.cache = _Pieces(self)
        self.words = _Words(self)
        self.by_id = [self.tokens.get(i, b"") for i in range(max(self.tokens, default=-1) + 1)]

    def _learn(self, rank: int, token: bytes) -> bool:
        """Find the merge that makes a token; false if merges of lower rank never arrive at it."""
        if len(token) == 1:
            self.halves[rank] = (rank, rank)
            return True
        for n in range(len(token) - 1, 0, -1):
            a, b = self.ranks.get(token[:n]), self.ranks.get(token[n:])
            if a is not None and b is not None and a < rank and b < rank and a in self.halves and b in self.halves and self._fits(a, b):
                self.merged[a, b] = rank
                self.halves[rank] = (a, b)
                return True
        return False

    def _fits(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b side by side where they meet.

        Undoes the later of the two merges step by step: should the pieces that
        face each other ever have a merge of lower rank than what was undone,
        that merge would have come first.
        """
        limit = 1 << 62
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, self.halves[a][1]
                if a == limit:
                    limit, b = b + 1, self.halves[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.halves[b][0]
                if b + 1 == limit:
                    limit, a = a, self.halves[a][1]
                    if a == limit:
                        return True

    def encode_piece(self, piece: bytes) -> list[int]:
        if (rank := self.ranks.get(piece)) is not None:
            return [rank]
        n, sizes, memo, shorter = len(piece), self.sizes, self.memo, self.shorter
        longest = [0] * n
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - sizes[rank]] = rank
        token, out, dead = longest[0], [], set()
        at, last = 0, -1
        while True:
            end = at + sizes[token]
            fits = True
            if last >= 0:
                fits = memo.get(last << 32 | token)
                if fits is None:
                    fits = self._remember(last, token)
            if fits and end not in dead:
                if end == n:
                    out.append(token)
                    return out
                out.append(token)
                at, last, token = end, token, longest[end]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead.add(at)
                token = out.pop()
                at -= sizes[token]
                last = out[-1] if out else -1

    def _remember(self, a: int, b: int) -> bool:
        if len(self.memo) >= MEMO_PAIRS:
            self.memo.clear()
        out = self.memo[a << 32 | b] = self._fits(a, b)
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if len(self.cache) + len(self.words) > CACHE_PIECES:
            self.cache.clear()
            self.words.clear()
        first, *rest = text.split(" ")
        try:
            if first[-1:].isspace():
                raise _Spaces
            return self._pieces(first) + b"".join(map(self.words.__getitem__, rest))
        except _Spaces:
            return self._pieces(text)

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.by_id.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Pieces(dict):
    """Encoded pieces; a piece that is not there is encoded."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        ids = self.codec.encode_piece(piece.encode("utf-8", "surrogatepass"))
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            self[piece] = out
        return out


class _Spaces(Exception):
    """White space next to a space: the matches there depend on more than the word."""


class _Words(dict):
    """Encoded words with the space before them.

    A single space between two other characters always begins a match of the
    pattern, so a text may be cut there; a frequent word is then one look-up,
    whatever matches it is made of.
    """

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Spaces
        encode = self.codec.encode_piece
        ids = [i for piece in self.codec.pattern.findall(f" {word}") for i in encode(piece.encode("utf-8", "surrogatepass"))]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            self[word] = out
        return out


_CODECS: dict[tuple, Codec] = {}


def codec_for(name: str, ranks, pattern: str) -> Codec:
    """One codec for a worker process; ranks is a broadcast table."""
    if (name, pattern) not in _CODECS:
        _CODECS[name, pattern] = Codec(ranks.value, pattern)
    return _CODECS[name, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: id, n_tokens, ids (array of int, if asked for), ids_sha256, decoded_sha256.

    A null text is an empty one. Every text is encoded whole; each match of the
    pattern separately. Rows are independent of each other, so repeated rows
    give repeated results, and other columns are left behind. The vocabulary, a
    file of fixed size, is read on the driver and broadcast.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = frame.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        codec = codec_for(path, ranks, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                n, ids, sha, back = [], [], [], []
                for text in part.column("text").to_pylist():
                    packed = codec.encode(text or "")
                    n.append(len(packed) // 4)
                    sha.append(hashlib.sha256(packed).hexdigest())
                    back.append(hashlib.sha256(codec.decode(packed)).hexdigest())
                    if with_ids:
                        ids.append(np.frombuffer(packed, "<u4").astype(np.int32))
                columns = {"id": part.column("id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(sha, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
                if with_ids:
                    columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    out = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return frame.mapInArrow(run, out).withColumnRenamed("id", id_col)


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole document encoded by the multilingual ranks, and decoded again."""
    import public_tokenizers as P

    return encode_documents(documents(spark, sf_dir), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, with_ids=False)
