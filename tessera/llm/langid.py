"""Language identification by hyperdimensional profiles.

Every letter has a fixed pseudo-random vector of +1 and -1. An n-gram of
letters is the product (binding) of its letters' vectors, each cyclically
permuted by its place in the n-gram; a text is the sum (bundle) of its n-grams'
vectors. A language's prototype bundles the unit vectors of its training texts.
A text gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, unused

UNKNOWN = "und"


class Profiles:
    """Letter vectors and the n-gram vectors bound from them.

    Letters fold into `letters` classes: case is dropped, a to z have classes
    of their own, other letters share the rest by code point. Class 0 is any
    run of other characters, so that word edges count.
    """

    def __init__(self, dims: int = 1024, letters: int = 64, n: int = 3, seed: int = 11):
        self.dims, self.letters, self.n = dims, letters, n
        rng = np.random.Generator(np.random.PCG64(seed))
        base = (rng.integers(0, 2, (letters, dims)) * 2 - 1).astype(np.float32)
        self.placed = [np.roll(base, n - 1 - i, axis=1) for i in range(n)]
        table = np.zeros(0x110000, np.uint8)
        points = np.arange(0x110000, dtype=np.uint64)
        alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        table[alpha] = (27 + (points[alpha] * np.uint64(0x9E3779B1) >> np.uint64(7)) % np.uint64(letters - 27)).astype(np.uint8)
        table[97:123] = np.arange(1, 27)
        self.classes = table

    def codes(self, text: str) -> np.ndarray:
        """Classes of a text's characters, with runs of class 0 as one and one at either end."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        found = np.concatenate((np.zeros(1, np.uint8), self.classes[points], np.zeros(1, np.uint8)))
        keep = np.ones(len(found), bool)
        keep[1:] = (found[1:] != 0) | (found[:-1] != 0)
        return found[keep]

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The text's distinct n-grams that hold a letter, as numbers, and how often each occurs."""
        found = self.codes(text).astype(np.int64)
        if len(found) < self.n:
            found = np.concatenate((found, np.zeros(self.n - len(found), np.int64)))
        gram = np.zeros(len(found) - self.n + 1, np.int64)
        for i in range(self.n):
            gram = gram * self.letters + found[i : i + len(gram)]
        if len(gram) > 4096:
            count = np.bincount(gram, minlength=1)
            names = np.flatnonzero(count)
            names, count = names[names > 0], count[names[names > 0]]
        else:
            names, count = np.unique(gram[gram > 0], return_counts=True)
        return names, count

    def bound(self, grams: np.ndarray) -> np.ndarray:
        out = np.ones((len(grams), self.dims), np.float32)
        for i in range(self.n):
            out *= self.placed[i][grams // self.letters ** (self.n - 1 - i) % self.letters]
        return out

    def bundles(self, texts: list[str]) -> np.ndarray:
        """Unit bundles of texts, zero rows for texts without a letter."""
        each = [self.grams(t) for t in texts]
        out = np.zeros((len(texts), self.dims), np.float32)
        names = np.unique(np.concatenate([g for g, _ in each])) if each else np.zeros(0, np.int64)
        for a in range(0, len(names), 4096):
            part = names[a : a + 4096]
            counts = np.zeros((len(texts), len(part)), np.float32)
            for i, (g, c) in enumerate(each):
                lo, hi = np.searchsorted(g, part[0]), np.searchsorted(g, part[-1], "right")
                counts[i, np.searchsorted(part, g[lo:hi])] = c[lo:hi]
            out += counts @ self.bound(part)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1)


#: Unit of the fixed-point sums of unit vectors: 2**23 rows of them stay far below 2**63.
FIXED = float(1 << 36)

_PROFILES: dict[tuple, Profiles] = {}


def profiles(**options) -> Profiles:
    key = tuple(sorted(options.items()))
    if key not in _PROFILES:
        _PROFILES[key] = Profiles(**options)
    return _PROFILES[key]


def _texts(batch: pa.RecordBatch, step: int) -> Iterator[tuple[int, list[str]]]:
    for a in range(0, batch.num_rows, step):
        yield a, [x or "" for x in batch.column("text").slice(a, step).to_pylist()]


def _labelled(rows: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """text, lang of all rows that have both."""
    return rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")


#: Fewer letters than this are too few to tell a language that wasn't learned.
LEAST_LETTERS = 20


def letters(text) -> F.Column:
    return F.length(F.regexp_replace(text, r"\P{L}+", ""))


#: Cosines are ranked by so many equal steps.
STEPS = 1_000_000


def least_scores(labelled: DataFrame, prototypes: list[tuple[str, np.ndarray]], text_col: str = "text", lang_col: str = "lang", share: float = 0.001, margin: float = 0.8, **options) -> dict[str, float]:
    """Per language, a cosine that all but `share` of its own labelled texts exceed, times a margin: what scores less is of no learned language.

    From all labelled rows with LEAST_LETTERS letters or more that are
    recognised; a language without any has 0. Cosines are counted by steps, of
    which there are as many however many rows there are.
    """
    rows = _labelled(labelled, text_col, lang_col).where(letters(F.col("text")) >= LEAST_LETTERS)
    found = predict(rows, prototypes, into=("__lang", "__score"), **options).where(F.col("__lang") == F.col("lang"))
    steps = found.groupBy("lang", F.floor(F.col("__score") * STEPS).alias("step")).agg(F.count("*").alias("n"), F.min("__score").alias("low"))
    own = Window.partitionBy("lang")
    upto = F.sum("n").over(own.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    ranked = steps.withColumns({"upto": upto, "total": F.sum("n").over(own)}).where(F.col("upto") > F.lit(share) * (F.col("total") - 1))
    low = {r["lang"]: r["low"] for r in ranked.groupBy("lang").agg(F.min_by("low", "step").alias("low")).collect()}
    return {name: margin * low.get(name, 0.0) for name, _ in prototypes}


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", **options) -> list[tuple[str, np.ndarray]]:
    """Prototypes (language, unit vector) from labelled rows.

    All rows teach, but for those without text or language. Each task sums its
    vectors per language in fixed point, so the sums of sums that Spark forms
    don't depend on their order. Languages are a closed set of labels; their
    number times `dims` reaches the driver, however many tasks there are.
    """
    rows = _labelled(labelled, text_col, lang_col)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        p = profiles(**options)
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for a, texts in _texts(batch, 64):
                for lang, v in zip(langs[a : a + 64], p.bundles(texts), strict=True):
                    total[lang] = total.get(lang, 0) + np.round(v.astype(np.float64) * FIXED).astype(np.int64)
        if total:
            yield pa.RecordBatch.from_pydict({"lang": list(total), "v": pa.array([x.tolist() for x in total.values()], pa.list_(pa.int64()))})

    parts = rows.mapInArrow(sums, "lang string, v array<long>").select("lang", F.posexplode("v").alias("place", "x"))
    summed = parts.groupBy("lang", "place").agg(F.sum("x").alias("x")).toArrow()
    found: dict[str, np.ndarray] = {}
    for lang, place, x in zip(summed.column("lang").to_pylist(), summed.column("place").to_pylist(), summed.column("x").to_pylist(), strict=True):
        found.setdefault(lang, np.zeros(profiles(**options).dims))[place] = x
    units = []
    for lang in sorted(found):
        v = found[lang]
        units.append((lang, (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32)))
    return units


def predict(docs: DataFrame, prototypes: list[tuple[str, np.ndarray]], text_col: str = "text", into: tuple[str, str] = ("lang_pred", "score"), **options) -> DataFrame:
    """All columns of docs, with the predicted language and its cosine (0 to 1; negative ones count as 0).

    A text that is null or has no letter is `und` with score 0, as is every
    text where nothing was learned; ties go to the language first in order.
    Columns of docs named as `into` are replaced. The prototypes are one vector
    per language and travel with the tasks.
    """
    names = [x for x, _ in prototypes]
    matrix = np.stack([v for _, v in prototypes]) if prototypes else None
    kept = docs.drop(*into)
    labels = [*kept.columns, *into]
    (own_text,) = unused(kept.columns, "__text")
    frame = kept.select(*kept.columns, docs[text_col].alias(own_text)) if text_col in kept.columns else docs.select(*kept.columns, F.col(text_col).alias(own_text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        p = profiles(**options)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for a in range(0, batch.num_rows, 64):
                texts = [x or "" for x in column.slice(a, 64).to_pylist()]
                bundle = p.bundles(texts)
                some = bundle.any(axis=1)
                if matrix is None:
                    lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                else:
                    cosine = bundle @ matrix.T
                    best = cosine.argmax(axis=1)
                    lang = [names[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
                    score = np.where(some, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0).astype(np.float64)
                own = [batch.column(i).slice(a, 64) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(lang, pa.string()), pa.array(score, pa.float64())], labels)

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*kept.schema.fields, StructField(into[0], StringType()), StructField(into[1], DoubleType())])
    return frame.mapInArrow(run, schema)


def fold(id_col: str):
    """The remainder by 3 of the CRC-32 of an id as text; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3, F.lit(0).cast("long"))


def op9_language_profiles(spark, sf_dir: str) -> DataFrame:
    """The language of every whole document, learned from two of three folds.

    Only documents outside fold 1 with a language teach; lang, source and
    doc_id are no inputs of a prediction.
    """
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    prototypes = learn(docs.where(fold("doc_id") != 1))
    rows = docs.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "text")
    return predict(rows, prototypes).select("doc_id", "held_out", "lang_pred", "score")
