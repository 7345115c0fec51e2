"""Models as interfaces, with deterministic defaults that need no file."""

from __future__ import annotations

import re
import subprocess
import tempfile
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


_WORDS = re.compile(r"([^\W一-鿿]+)|(?=([一-鿿]{2}))")


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashedWords:
    """A bag of hashed words and ideograph pairs, of unit length; zeros for a blank text. It stands in for a trained model.

    longest: characters of a text that count, 512 for the limit of the model it stands in for; None for all."""

    def __init__(self, dim: int = 64, longest: int | None = None):
        self.dim, self.longest = dim, longest

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        found = [_WORDS.findall((t if self.longest is None else t[: self.longest]).lower()) for t in texts]
        words = {w: i for i, w in enumerate({a or b for f in found for a, b in f})}
        codes = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words))
        row = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        code = codes[np.fromiter((words[a or b] for f in found for a, b in f), np.int64, len(row))]
        np.add.at(out, (row, code % self.dim), np.where(code >> 20 & 1, 1, -1))
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.maximum(norm, 1e-12)


def embedding(c: Column, model: Embedder | None = None, batch: int = 256) -> Column:
    """The embedding of a text column by Arrow batches."""
    used = model or HashedWords()

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:  # the model is unpacked once for a task
            yield pd.Series([v for i in range(0, len(texts), batch) for v in used.embed([t or "" for t in texts.iloc[i : i + batch]])])

    return run(c)


class Completion(Protocol):
    """A language model: a prompt in, a text out."""

    def complete(self, prompt: str, max_tokens: int = 4096, temperature: float = 0.7) -> str: ...


class NoModel:
    """Stands in for a language model that isn't there: every completion is empty, so plans take their defaults."""

    def complete(self, prompt: str, max_tokens: int = 4096, temperature: float = 0.7) -> str:
        return ""


class Command:
    """A completion by a local program that reads the prompt from a file of its own and prints the text."""

    def __init__(self, program: list[str], timeout: int = 600):
        self.program, self.timeout = program, timeout

    def complete(self, prompt: str, max_tokens: int = 4096, temperature: float = 0.7) -> str:
        with tempfile.NamedTemporaryFile("w", suffix=".txt", encoding="utf-8") as f:
            f.write(prompt)
            f.flush()
            args = [a.format(prompt=f.name, max_tokens=max_tokens, temperature=temperature) for a in self.program]
            try:
                done = subprocess.run(args, capture_output=True, text=True, timeout=self.timeout)
            except FileNotFoundError as e:
                raise RuntimeError(f"no such program: {args[0]}") from e
        if done.returncode:
            raise RuntimeError(f"{args[0]} ended with {done.returncode}: {done.stderr[-500:]}")
        return done.stdout.strip()


def completion(prompt: Column, model: Completion) -> Column:
    """The model's text for each prompt; null where it fails."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        def one(p: str | None) -> str | None:
            try:
                return None if p is None else model.complete(p)
            except Exception:
                return None

        return prompts.map(one)

    return run(prompt)
