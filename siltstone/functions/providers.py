"""Models that a caller brings along: batch jobs over tables, with partial failure.

An embedder has ``model``, ``dimensions``, ``encode(texts) -> vectors`` for stored texts
and ``encode_queries(texts)`` for queries; a generator has ``model`` and
``generate(prompts, options) -> [Generated]``. Objects are sent to the tasks as they
are, so they open what they need on first use.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import urllib.request
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import MODEL_PREFIXES, cache_key, should_expand


@dataclass(frozen=True)
class Options:
    """How to generate; what a model doesn't know it may ignore."""

    max_tokens: int = 512
    temperature: float = 0.0
    stop: tuple[str, ...] = ()


@dataclass(frozen=True)
class Generated:
    text: str | None
    finish_reason: str
    prompt_tokens: int | None = None
    completion_tokens: int | None = None


class HashEmbedder:
    """Deterministic vectors for tests: bytes of stretched SHA-256 digests, centred, of length 1."""

    provider, model = "mock", "hash"

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            raw = b"".join(hashlib.sha256(f"{i}:{t}".encode()).digest() for i in range(-(-self.dimensions // 8)))
            v = np.frombuffer(raw, "<u4")[: self.dimensions].astype(np.float64) / 2**31 - 1
            out.append((v / np.linalg.norm(v)).astype(np.float32).tolist())
        return out

    encode_queries = encode


class EchoGenerator:
    """Deterministic answers for tests: the end of the prompt, up to the first stop text; a token is a word."""

    provider, model = "mock", "echo"

    def __init__(self, max_chars: int = 200):
        self.max_chars = max_chars

    def generate(self, prompts: list[str], options: Options = Options()) -> list[Generated]:
        out = []
        for p in prompts:
            text, reason = p[-self.max_chars :], "length" if len(p) > self.max_chars else "stop"
            for mark in options.stop:
                if mark in text:
                    text, reason = text[: text.index(mark)], "stop"
            words = text.split(" ")
            if len(words) > options.max_tokens:
                text, reason = " ".join(words[: options.max_tokens]), "length"
            out.append(Generated(text, reason, len(p.split()), len(text.split())))
        return out


class _Http:
    """JSON requests to a server that speaks the common completion interface; the key comes from a named environment variable."""

    provider = "http"

    def __init__(self, base_url: str, model: str, key_name: str | None = None, timeout: float = 60.0):
        self.base_url, self.model, self.key_name, self.timeout = base_url.rstrip("/"), model, key_name, timeout

    def _post(self, path: str, body: dict) -> dict:
        headers = {"Content-Type": "application/json"}
        if self.key_name and os.environ.get(self.key_name):
            headers["Authorization"] = f"Bearer {os.environ[self.key_name]}"
        request = urllib.request.Request(self.base_url + path, json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)


class HttpEmbedder(_Http):
    """``POST /embeddings``. Models of a family that tells texts from queries get its prefixes."""

    def __init__(self, base_url: str, model: str, dimensions: int, **more):
        super().__init__(base_url, model, **more)
        self.dimensions = dimensions

    def _encode(self, texts: list[str], kind: int) -> list[list[float]]:
        prefix = next((pair[kind] for pattern, pair in MODEL_PREFIXES.items() if re.match(pattern, self.model)), "")
        rows = self._post("/embeddings", {"model": self.model, "input": [prefix + t for t in texts]})["data"]
        vectors = [r["embedding"] for r in sorted(rows, key=lambda r: r.get("index", 0))]
        if any(len(v) != self.dimensions for v in vectors):
            raise ValueError(f"vectors of other than {self.dimensions} dimensions")
        return vectors

    def encode(self, texts: list[str]) -> list[list[float]]:
        return self._encode(texts, 0)

    def encode_queries(self, texts: list[str]) -> list[list[float]]:
        return self._encode(texts, 1)


class HttpGenerator(_Http):
    """``POST /chat/completions``, one request a prompt."""

    def generate(self, prompts: list[str], options: Options = Options()) -> list[Generated]:
        out = []
        for p in prompts:
            body = {"model": self.model, "messages": [{"role": "user", "content": p}], "max_tokens": options.max_tokens, "temperature": options.temperature}
            answer = self._post("/chat/completions", body | ({"stop": list(options.stop)} if options.stop else {}))
            choice, used = answer["choices"][0], answer.get("usage") or {}
            out.append(Generated(choice["message"]["content"], choice.get("finish_reason") or "stop", used.get("prompt_tokens"), used.get("completion_tokens")))
        return out


PROVIDERS = {"mock-embedder": HashEmbedder, "mock-generator": EchoGenerator, "http-embedder": HttpEmbedder, "http-generator": HttpGenerator}


def provider(name: str, **settings):
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name}; known: {sorted(PROVIDERS)}")
    return PROVIDERS[name](**settings)


def embedded(chunks: DataFrame, embedder, batch_size: int = 32, text_col: str = "content") -> DataFrame:
    """``chunk_id, content_hash, embedding, error, model, dimensions``.

    A batch that fails, or returns another number of vectors, gives rows with an
    error and no vector; the others stand. See ``checked``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for a in range(0, len(frame), batch_size):
                part = frame.iloc[a : a + batch_size]
                try:
                    vectors, error = list(embedder.encode(part["text"].tolist())), None
                    if len(vectors) != len(part):
                        raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
                except Exception as e:  # a model may fail in any way
                    vectors, error = [None] * len(part), f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"chunk_id": part["chunk_id"].to_numpy(), "content_hash": part["content_hash"].to_numpy(), "embedding": vectors, "error": error})

    out = chunks.select(F.col("chunk_id").cast("string"), "content_hash", F.col(text_col).alias("text")).mapInPandas(run, "chunk_id string, content_hash string, embedding array<float>, error string")
    return out.withColumn("model", F.lit(embedder.model)).withColumn("dimensions", F.lit(embedder.dimensions))


def checked(stored: DataFrame) -> dict:
    """Counts of a written embedding run; an error if nothing was embedded."""
    row = stored.agg(F.count("*").alias("n"), F.count("error").alias("failed"), F.max("error").alias("error")).first()
    if row["n"] and row["n"] == row["failed"]:
        raise RuntimeError(f"all {row['n']} chunks failed: {row['error']}")
    return {"embedded": row["n"] - row["failed"], "failed": row["failed"]}


def embedded_queries(queries: DataFrame, embedder) -> DataFrame:
    """``query_id, query_vector`` for ``queries(query_id, text)``; a batch that fails gives null vectors, which find nothing."""
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            try:
                vectors = list(embedder.encode_queries(frame["text"].tolist()))
                if len(vectors) != len(frame):
                    raise ValueError("another number of vectors")
            except Exception:  # a model may fail in any way
                vectors = [None] * len(frame)
            yield pd.DataFrame({"query_id": frame["query_id"], "query_vector": vectors})

    return queries.select("query_id", "text").mapInPandas(run, f"query_id {kind}, query_vector array<float>")


def generated(prompts: DataFrame, generator, options: Options = Options()) -> DataFrame:
    """``query_id, text, finish_reason, prompt_tokens, completion_tokens`` for each row of ``query_id, prompt``; nulls where the model fails."""
    kind = prompts.schema["query_id"].dataType.simpleString()
    columns = ["text", "finish_reason", "prompt_tokens", "completion_tokens"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            try:
                rows = [asdict(g) for g in generator.generate(frame["prompt"].tolist(), options)]
            except Exception:  # no answer is an outcome of its own
                rows = [asdict(Generated(None, "error"))] * len(frame)
            made = pd.DataFrame(rows, columns=columns, dtype=object)
            yield pd.DataFrame({"query_id": frame["query_id"].to_numpy(), **{c: made[c] for c in columns}})

    return prompts.select("query_id", "prompt").mapInPandas(run, f"query_id {kind}, text string, finish_reason string, prompt_tokens long, completion_tokens long")


def expanded(queries: DataFrame, generator) -> DataFrame:
    """``queries`` with ``vector_text``: a generated passage where a query is worth it, else the query.

    Each distinct query is generated once; a failure or blank text falls back to the query.
    """
    keyed = queries.withColumn("_key", cache_key(F.lower(F.trim(F.regexp_replace("query", r"\s+", " ")))))
    asked = keyed.where(should_expand(F.col("query"))).groupBy("_key").agg(F.min("query").alias("prompt"))
    texts = generated(asked.withColumnRenamed("_key", "query_id"), generator).select(F.col("query_id").alias("_key"), F.nullif(F.trim("text"), F.lit("")).alias("_text"))
    return keyed.join(texts, "_key", "left").withColumn("vector_text", F.coalesce("_text", "query")).drop("_key", "_text")
