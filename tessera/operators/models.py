"""Plug-ins: text encoders, cross-encoders and language models, and what happens where one can't be had.

A model is described by a picklable object and loaded on first use, once per
worker. Which one a run uses is settled on the driver before the plan is built,
so no part of a run ever mixes two.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import reader, rerank, retrieval


@runtime_checkable
class Encoder(Protocol):
    """Texts to vectors: name, and encode(texts, asking) giving one row of floats per text."""

    name: str

    def encode(self, texts: list[str], asking: bool = False) -> np.ndarray: ...


@runtime_checkable
class PairScorer(Protocol):
    """(question, passage) pairs to raw logits."""

    name: str

    def score(self, pairs: list[tuple[str, str]]) -> np.ndarray: ...


# fixed values: what models of this family want before a question
_ASKING = {"bge": "Represent this sentence for searching relevant passages: "}


class _Lazy:
    """Loads on first use; what is loaded stays with the process and is not sent along."""

    def _model(self):
        if "_loaded" not in self.__dict__:
            self.__dict__["_loaded"] = self.load()
        return self.__dict__["_loaded"]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_loaded"}


@dataclass
class SentenceEncoder(_Lazy):
    """A sentence-transformers model. instruction None: what the model's family wants; "" for none."""

    name: str
    batch: int = 32
    device: str | None = None
    instruction: str | None = None

    def load(self):
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError as e:
            raise RuntimeError(f"{self.name} needs the package sentence-transformers; HashedEncoder needs nothing") from e
        return SentenceTransformer(self.name, device=self.device)

    def encode(self, texts: list[str], asking: bool = False) -> np.ndarray:
        lead = self.instruction
        if lead is None:
            lead = next((v for k, v in _ASKING.items() if k in self.name.lower() and "-en" in self.name.lower()), "")
        return np.asarray(self._model().encode([lead + t for t in texts] if asking else list(texts), batch_size=self.batch, normalize_embeddings=True, show_progress_bar=False))


@dataclass
class CrossEncoder(_Lazy):
    """A sentence-transformers cross-encoder, without its activation."""

    name: str
    batch: int = 32
    device: str | None = None
    longest: int = 512

    def load(self):
        try:
            import sentence_transformers
            import torch
        except ImportError as e:
            raise RuntimeError(f"{self.name} needs the package sentence-transformers; Reranker(allow_fallback=True) does without") from e
        return sentence_transformers.CrossEncoder(self.name, device=self.device, max_length=self.longest), torch.nn.Identity()

    def score(self, pairs: list[tuple[str, str]]) -> np.ndarray:
        model, plain = self._model()
        return np.asarray(model.predict(list(pairs), batch_size=self.batch, activation_fn=plain, show_progress_bar=False), np.float64)


@dataclass
class Embedded:
    """A dense retriever from an encoder: retrieval.hybrid_search(..., dense=Embedded(encoder).search)."""

    encoder: Encoder

    def vectors(self, rows: DataFrame, key: str, asking: bool) -> DataFrame:
        """key, vec of rows (key, text); a null text is embedded as empty."""
        encoder = self.encoder
        if not isinstance(encoder, Encoder):
            raise TypeError("an encoder has a name and encode(texts, asking)")

        @F.pandas_udf("array<double>")
        def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                made = np.asarray(encoder.encode([t or "" for t in part], asking), np.float64) if len(part) else []
                if len(made) != len(part):
                    raise ValueError(f"{encoder.name} gave {len(made)} vectors for {len(part)} texts")
                yield pd.Series(list(made), index=part.index, dtype=object)

        return rows.select(key, embed("text").alias("vec"))

    def search(self, corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        return retrieval.vector_search(self.vectors(corpus, "pos", False), self.vectors(retrieval.not_blank(queries), "query_id", True), k)


class Reranker:
    """Scores pairs with a model, or lexically where the model can't be had and that is allowed.

    backend says which it is and fallback_reason why; both are known when the
    object is made.
    """

    def __init__(self, model: PairScorer | str | None = None, allow_fallback: bool = False):
        self.model: PairScorer | None = CrossEncoder(model) if isinstance(model, str) else model
        self.backend, self.fallback_reason = (self.model.name, None) if self.model else ("lexical", None)
        if self.model is not None:
            try:
                self.model.score([("a question", "a passage")])
            except Exception as e:
                if not allow_fallback:
                    raise RuntimeError(f"reranker {self.backend} can't be used: {e}") from e
                warnings.warn(f"reranker {self.backend} can't be used ({e}); scoring lexically", stacklevel=2)
                self.fallback_reason, self.backend, self.model = f"{type(e).__name__}: {e}", "lexical", None

    def score(self, pairs: DataFrame) -> DataFrame:
        """query_id, pos, logit of pairs (query_id, pos, query, passage)."""
        if self.model is None:
            return rerank.lexical_features(pairs).select("query_id", "pos", "logit")
        model = self.model

        @F.pandas_udf("double")
        def logits(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for q, p in parts:
                yield pd.Series(np.asarray(model.score(list(zip(q, p, strict=True))), np.float64) if len(q) else [], index=q.index, dtype="float64")

        return pairs.select("query_id", "pos", logits(F.coalesce("query", F.lit("")), F.coalesce("passage", F.lit(""))).alias("logit"))


def search_with(corpus: DataFrame, mode: str = "hybrid", index: retrieval.Index | None = None, encoder: Encoder | None = None) -> Callable[[DataFrame, int], DataFrame]:
    """A retriever as a function of questions (query_id, text) and k, as benchmarks take it."""
    dense = Embedded(encoder).search if encoder else None
    return lambda questions, k: retrieval.hybrid_search(corpus, questions, k, mode, index=index, dense=dense)


# ---- language models --------------------------------------------------------


@dataclass
class _Http:
    """A model behind HTTP. A busy or failing server is asked again, a few times, ever later."""

    model: str
    url: str
    key: str | None = None
    timeout: float = 60.0
    tries: int = 3
    wait: float = 1.0
    headers: dict[str, str] = field(default_factory=dict)

    def post(self, body: dict, headers: dict[str, str]) -> dict:
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers, **self.headers})
        for left in reversed(range(self.tries)):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                if left == 0 or (e.code != 429 and e.code < 500):
                    raise RuntimeError(f"{self.model}: HTTP {e.code}") from e
            except urllib.error.URLError as e:
                if left == 0:
                    raise RuntimeError(f"{self.model} can't be reached: {e.reason}") from e
            time.sleep(self.wait * 2 ** (self.tries - 1 - left))
        raise AssertionError


class ChatClient(_Http):
    """Servers that take a list of chat messages and give choices."""

    def complete(self, system: str, prompt: str, *, temperature: float, max_tokens: int) -> str:
        body = {"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}], "temperature": temperature, "max_tokens": max_tokens}
        choice = self.post(body, {"Authorization": f"Bearer {self.key}"} if self.key else {})["choices"][0]
        if choice["message"].get("refusal") or choice.get("finish_reason") == "content_filter":
            raise reader.Refusal(choice["message"].get("refusal") or "filtered")
        return choice["message"].get("content") or ""


class BlocksClient(_Http):
    """Servers that take the system text apart and give blocks of content."""

    def complete(self, system: str, prompt: str, *, temperature: float, max_tokens: int) -> str:
        body = {"model": self.model, "system": system, "messages": [{"role": "user", "content": prompt}], "temperature": temperature, "max_tokens": max_tokens}
        answer = self.post(body, {"x-api-key": self.key} if self.key else {})
        if answer.get("stop_reason") == "refusal":
            raise reader.Refusal("the model declined")
        return "".join(b.get("text", "") for b in answer["content"] if b.get("type") == "text")


def reading(client: reader.Client | None = None, allow_fallback: bool = False, backend: str = "client", **options) -> tuple[Callable[..., DataFrame], str, str | None]:
    """(read, backend, why): the reader of a whole run, as pipeline.answer takes it.

    The client is tried once, here. If that fails and it is allowed, the whole
    run reads extractively; later failures hold back single questions.
    """
    if client is not None:
        try:
            client.complete("Reply with the word ready.", "Are you ready?", temperature=0.0, max_tokens=8)
        except reader.Refusal:
            pass  # it answers, if not to this
        except Exception as e:
            if not allow_fallback:
                raise RuntimeError(f"reader {backend} can't be used: {e}") from e
            warnings.warn(f"reader {backend} can't be used ({e}); reading extractively", stacklevel=2)
            return reader.extractive, "lexical-reader", f"{type(e).__name__}: {e}"
        return lambda context, questions, forced=False: reader.with_client(context, questions, client, forced, backend, **options), backend, None
    return reader.extractive, "lexical-reader", None
