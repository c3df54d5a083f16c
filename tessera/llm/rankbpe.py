"""BPE with word ends, encoded by a contiguous rank array.

A distinct word is normalised and cut into pieces of mapped bytes, once per
worker: by the file's own normaliser and splitter, or by the file's pattern where
a word has only letters that every version of Unicode treats alike. A piece is
then merged here: a list holds the boundaries of its parts and a second one,
beside it, the rank of each two adjacent parts. The least rank is looked for again and again, the
boundary between its two parts is deleted and the ranks to the left and right of
it are refreshed. That is quadratic, and fastest, in short pieces; longer ones
than LONG parts keep the same ranks in a heap over linked parts, with the same
result.

Texts are cut at white space first. The normaliser makes every run of white
space one space, no piece holds white space and no composition reaches across
it, so such a word is a closed unit for the library; a frequent word is one
look-up, and so is a frequent piece of a rare word.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents

#: Parts of a piece beyond which a heap is used.
LONG = 128

#: Entries that a worker's caches of encoded words and of pieces hold before they start afresh, and the longest that they keep.
CACHE_WORDS, CACHE_LENGTH = 500_000, 64

#: The steps before the model that words below ALIKE are taken through here; characters below it are composed and have one class and lower case in every version of Unicode.
KNOWN_NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
KNOWN_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
ALIKE = "\u0250"

_NEVER = 1 << 60


class RankCodec:
    """Encoder and decoder for one tokenizer definition (the bytes of its JSON file).

    Definitions are refused that this method does not cover: other models than
    BPE with ranks alone, splitters that keep white space, decoders, and special
    tokens that hold white space or take some from around them.
    """

    def __init__(self, definition: bytes):
        from tokenizers import Tokenizer

        library = Tokenizer.from_buffer(definition)
        parts = json.loads(definition)
        model = parts["model"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        if not plain or parts.get("decoder") or parts.get("post_processor"):
            raise ValueError("only a plain BPE model without decoder and post-processor can be encoded this way")
        self.normalise = library.normalizer.normalize_str if library.normalizer else str
        self.split = library.pre_tokenizer.pre_tokenize_str
        if [p for p, _ in self.split(self.normalise("a \t\n b"))] != ["a", "b"]:
            raise ValueError("the splitter must drop white space")
        self.pattern = self._known_pattern(parts)
        self.mapped = _byte_characters()
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocabulary: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        added = {x["content"]: x for x in parts.get("added_tokens", [])}
        if any(re.search(r"\s", c) or x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for c, x in added.items()):
            raise ValueError("special tokens must stand for themselves")
        self.added = {c: x["id"] for c, x in added.items()}
        # of special tokens that begin at one place the longest is taken
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        texts = {i: t for t, i in (self.vocabulary | self.added).items()}
        self.by_id = [texts.get(i, "").encode() for i in range(max(texts, default=-1) + 1)]
        self.pieces = _Cache(self.merge)
        self.words = _Cache(self.word)

    @staticmethod
    def _known_pattern(parts: dict):
        """The splitter's pattern if normaliser and splitter are of the known form."""
        steps = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if parts.get("normalizer") != KNOWN_NORMALISER or len(steps) != 2 or steps[1] != KNOWN_BYTES:
            return None
        cut = steps[0]
        if cut.get("type") != "Split" or cut.get("behavior") != "Removed" or not cut.get("invert") or "Regex" not in cut.get("pattern", {}):
            return None
        return regex.compile(cut["pattern"]["Regex"])

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece of mapped bytes."""
        word = piece + self.suffix
        bounds = [*range(len(piece)), len(word)]
        if len(piece) > LONG:
            return self._merge_long(word, bounds)
        ranks = self.ranks
        first = [*piece[:-1], word[len(piece) - 1 :]]
        near = [ranks.get(pair, _NEVER) for pair in zip(first, first[1:], strict=False)]
        while near and (least := min(near)) < _NEVER:
            i = near.index(least)
            del bounds[i + 1], near[i]
            if i:
                near[i - 1] = ranks.get((word[bounds[i - 1] : bounds[i]], word[bounds[i] : bounds[i + 1]]), _NEVER)
            if i < len(near):
                near[i] = ranks.get((word[bounds[i] : bounds[i + 1]], word[bounds[i + 1] : bounds[i + 2]]), _NEVER)
        return self._ids(word, bounds)

    def _merge_long(self, word: str, bounds: list[int]) -> list[int]:
        """The same merges for a piece of any length: ranks in a heap, parts linked by their first characters."""
        end = dict(zip(bounds, bounds[1:], strict=False))
        start = {b: a for a, b in end.items()}

        def rank(at: int) -> int:
            middle = end[at]
            return self.ranks.get((word[at:middle], word[middle : end[middle]]), _NEVER) if middle in end else _NEVER

        now = {at: r for at in end if (r := rank(at)) < _NEVER}
        heap = [(r, at) for at, r in now.items()]
        heapq.heapify(heap)
        while heap:
            r, at = heapq.heappop(heap)
            if now.get(at) != r:
                continue
            middle = end[at]
            end[at] = end.pop(middle)
            start[end[at]] = at
            del start[middle]
            now.pop(middle, None)
            for left in (start.get(at), at):
                if left is not None:
                    now[left] = rank(left)
                    if now[left] < _NEVER:
                        heapq.heappush(heap, (now[left], left))
        return self._ids(word, [*sorted(end), len(word)])

    def _ids(self, word: str, bounds: list[int]) -> list[int]:
        # a byte without an entry of its own is dropped, as the library does without an unknown token
        return [i for a, b in zip(bounds, bounds[1:], strict=False) if (i := self.vocabulary.get(word[a:b])) is not None]

    def _plain(self, text: str) -> list[int]:
        if self.pattern is not None and max(text) < ALIKE:
            pieces = self.pattern.findall(text.lower())
            if not (text.isascii() and text.isprintable()):
                pieces = [p.encode().decode("latin-1").translate(self.mapped) for p in pieces]
        else:
            pieces = [piece for piece, _ in self.split(self.normalise(text))]
        return [i for piece in pieces for i in self.pieces[piece]]

    def word(self, word: str) -> bytes:
        """Ids of a stretch without white space, packed; special strings become their tokens."""
        ids = self._word(word)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> list[int]:
        if not word:
            return []
        if self.special is None:
            return self._plain(word)
        out, at = [], 0
        for m in self.special.finditer(word):
            out += self._plain(word[at : m.start()]) if m.start() > at else []
            out.append(self.added[m[0]])
            at = m.end()
        return out + self._plain(word[at:]) if at < len(word) else out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        for cache in (self.words, self.pieces):
            if len(cache) > CACHE_WORDS:
                cache.clear()
        # str.split() would also cut at these four, which are not white space for the library
        cut = regex.split(r"\s+", text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        return b"".join(map(self.words.__getitem__, cut))

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the texts of all ids, joined by one space, special ones among them."""
        return b" ".join(map(self.by_id.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Cache(dict):
    """Results of a function by key; long keys aren't kept."""

    def __init__(self, function):
        super().__init__()
        self.function = function

    def __missing__(self, key: str):
        out = self.function(key)
        if len(key) <= CACHE_LENGTH:
            self[key] = out
        return out


def _byte_characters() -> dict[int, str]:
    """Latin-1 characters that stand for bytes, to the visible ones that the vocabulary has for them: those that are none move up to 256 and on, in order."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in seen)}


_CODECS: dict[str, RankCodec] = {}


def _codec(name: str, definition) -> RankCodec:
    """One codec for a worker process; definition is a broadcast file."""
    if name not in _CODECS:
        _CODECS[name] = RankCodec(definition.value)
    return _CODECS[name]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: id, n_tokens, ids (array of int, if asked for), ids_sha256, decoded_sha256.

    A null text is an empty one: no ids, the digests of nothing. Every text is
    encoded whole and decoded from its ids. Rows are independent of each other:
    repeated rows give repeated results, no rows give none. Other columns,
    whatever their names, are left behind. The definition, a file of fixed size,
    is read on the driver and broadcast.
    """
    with open(path, "rb") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = frame.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        codec = _codec(path, definition)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                packed = [codec.encode(text or "") for text in part.column("text").to_pylist()]
                columns = {
                    "id": part.column("id"),
                    "n_tokens": pa.array([len(x) // 4 for x in packed], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in packed], pa.string()),
                }
                if with_ids:
                    columns["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in packed], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    out = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return frame.mapInArrow(run, out).withColumnRenamed("id", id_col)


def op11_rank_array_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole document encoded by the vocabulary with word ends, and decoded again."""
    import public_tokenizers as P

    return encode_documents(documents(spark, sf_dir), P.path("word_bpe_49k.json"), with_ids=False)
