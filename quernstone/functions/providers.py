"""Providers of embeddings and of model replies, called from executors batch by batch; the offline ones are repeatable."""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashed_embedding(text: str, dims: int = 64) -> list[float]:
    """Offline stand-in for an encoder: signed hashed words, scaled to length one."""
    v = np.zeros(dims)
    for w in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % dims] += 1.0 if h >> 63 else -1.0
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def embed(df: DataFrame, id_col: str, text_col: str, encode: Callable[[list[str]], list[list[float]]] | None = None, dims: int = 64) -> DataFrame:
    """(id, embedding): encode takes a batch of texts. Blank texts get the zero vector and are not sent."""
    call = encode or (lambda texts: [hashed_embedding(t, dims) for t in texts])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].fillna("").tolist()
            full = [i for i, t in enumerate(texts) if t.strip()]
            out = [[0.0] * dims] * len(texts)
            for i, v in zip(full, call([texts[i] for i in full]) if full else [], strict=True):
                out[i] = v
            yield pd.DataFrame({"id": b["id"], "embedding": out})

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, f"id {dict(df.dtypes)[id_col]}, embedding array<double>")


def ask_model(df: DataFrame, id_col: str, prompt_col: str, generate: Callable[[str], str], retries: int = 3) -> DataFrame:
    """(id, reply): generate is called once for each prompt, again after an error; after the last error the reply is null."""

    def reply(prompt: str) -> str | None:
        for _ in range(retries):
            try:
                return generate(prompt)
            except (OSError, ValueError):
                continue
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "reply": [reply(p) for p in b["prompt"]]})

    return df.select(F.col(id_col).alias("id"), F.col(prompt_col).alias("prompt")).mapInPandas(run, f"id {dict(df.dtypes)[id_col]}, reply string")


class HttpModel:
    """A model server with /api/generate and /api/embed, as local model runners have. Instances travel to executors; each call opens its own connection."""

    def __init__(self, host: str = "http://localhost:11434", model: str = "", embedding_model: str = "", timeout: float = 300.0):
        self.host, self.model, self.embedding_model, self.timeout = host.rstrip("/"), model, embedding_model, timeout

    def post(self, path: str, body: dict) -> dict:
        request = urllib.request.Request(f"{self.host}{path}", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)

    def generate(self, prompt: str, model: str | None = None) -> str:
        return self.post("/api/generate", {"model": model or self.model, "prompt": prompt, "stream": False})["response"]

    def embed(self, text: str, model: str | None = None) -> list[float]:
        if not text or not text.strip():
            raise ValueError("there is no text to embed")
        return self.embed_batch([text], model)[0]

    def embed_batch(self, texts: list[str], model: str | None = None) -> list[list[float]]:
        return self.post("/api/embed", {"model": model or self.embedding_model, "input": texts})["embeddings"]


def reply_object(generate: Callable[[str], str], prompt: str, retries: int = 2) -> dict:
    """The object of a reply; objects in a list are merged, later keys win. Asked again while none parses; empty after the last time."""
    for _ in range(retries + 1):
        text = generate(prompt).split("</think>")[-1]
        for opening, closing in ("{}", "[]"):
            start, end = text.find(opening), text.rfind(closing)
            if (at := text.find("[")) >= 0 and opening == "{" and at < start:
                continue  # a list comes first
            if 0 <= start < end:
                try:
                    value = json.loads(text[start : end + 1])
                except ValueError:
                    continue
                if isinstance(value, list):
                    value = {k: v for x in value if isinstance(x, dict) for k, v in x.items()}
                if value and isinstance(value, dict):
                    return value
    return {}


def token_vectors(tokens: DataFrame, vocabulary: DataFrame, token_col: str = "tok") -> DataFrame:
    """tokens with v, the vocabulary's static vector (tok, v) of each; null for tokens it lacks."""
    return tokens.join(vocabulary.select(F.col("tok").alias(token_col), "v"), token_col, "left")
