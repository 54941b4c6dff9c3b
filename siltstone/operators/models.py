"""Models behind protocols. The stand-ins here are deterministic and local; a real model takes their place in a pandas UDF."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entity types that an extractor may name, and limits of what it reads and gives.
ENTITY_TYPES = ("person", "technology", "file", "project", "concept")
MOST_ENTITIES, ENTITY_BYTES, MOST_TOKENS = 20, 8192, 512


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Extractor(Protocol):
    def __call__(self, chunk: str) -> dict: ...


class CircuitBreaker:
    """Refuses calls for `pause` seconds after `most` failures in a row, then lets one through to see."""

    def __init__(self, most: int = 5, pause: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.most, self.pause, self.clock = most, pause, clock
        self.failures, self.opened = 0, None

    def allows(self) -> bool:
        if self.opened is None:
            return True
        if self.clock() - self.opened < self.pause:
            return False
        self.opened = self.clock()  # this call is the probe; others wait for its outcome
        return True

    def succeeded(self) -> None:
        self.failures, self.opened = 0, None

    def failed(self) -> None:
        self.failures += 1
        if self.failures >= self.most:
            self.opened = self.clock()


def _hashed(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))


def hashing_embedder(dims: int = 64) -> Embedder:
    """Feature hashing of words, scaled to length 1; empty texts give zeros."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for row, text in zip(out, texts):
            for w in re.findall(r"\w+", (text or "").lower()):
                h = _hashed(w)
                row[h % dims] += 1.0 if h >> 63 else -1.0
            n = np.linalg.norm(row)
            row /= n if n else 1.0
        return out

    return embed


def token_matrix(text: str, dims: int = 16, most: int = MOST_TOKENS) -> list[list[float]]:
    """A vector of length 1 for each of the first words."""
    out = []
    for w in re.findall(r"\w+", (text or "").lower())[:most]:
        v = np.random.default_rng(_hashed(w)).normal(size=dims)
        out.append((v / np.linalg.norm(v)).tolist())
    return out


def embedded(text: Column, make: Callable[[], Embedder] = hashing_embedder) -> Column:
    """Vectors of texts, a batch at a time; null for null."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        vectors = make()(texts.fillna("").tolist())
        return pd.Series([None if t is None else v.tolist() for t, v in zip(texts, vectors)])

    return run(text)


def keyword_extractor(chunk: str) -> dict:
    """A stand-in for an extraction model: sentences that tell of a cause, a step or a fix, and names in backticks."""
    sentences = [s.strip() for s in re.split(r"(?<=[.?!])\s+|\n", chunk) if s.strip()]
    pick = lambda *signs: [s for s in sentences if any(x in s.lower() for x in signs)]
    return {
        "patterns": pick("because", "explains"), "episodes": pick("failed", "lost", "mistake"), "procedures": pick("first and", "before you", "by hand"),
        "memories": [s for s in pick("remember that", "never") if len(s.encode()) >= 10], "entities": sorted(set(re.findall(r"`([^`\s]+)`", chunk)))[:MOST_ENTITIES],
    }


def parsed_json(answer: str) -> dict | list | None:
    """JSON in an answer, with or without a fence around it; None if there is none."""
    m = re.search(r"```(?:json)?\s*(.*?)```", answer, re.S)
    try:
        return json.loads(m[1] if m else answer)
    except ValueError:
        return None


def flexible_strings(value) -> list[str]:
    """Strings of whatever JSON a model gave where a list of strings was asked for."""
    if value is None:
        return []
    if isinstance(value, (list, tuple)):
        return [s for v in value for s in flexible_strings(v)]
    return [value if isinstance(value, str) else json.dumps(value)]


def clamped_scores(scores: dict[str, float]) -> dict[str, float]:
    return {k: min(1.0, max(0.0, float(v))) for k, v in scores.items()}


def expanded_queries(query: str, rephrase: Callable[[str], list[str]], most: int = 3) -> list[str]:
    """The query and up to `most` rephrasings that aren't blank."""
    return [query, *[r.strip() for r in rephrase(query) if r and r.strip()][:most]]
