"""Text encoders (VEC-1, VEC-2, VEC-6, SRC-16)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Protocol
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM, BATCH = 1024, 32


class Encoder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """Feature hashing of words, normalised: an offline stand-in, not a neural model's equal.

    All words count unless ``max_words`` states a limit, as a neural model has one.
    """

    def __init__(self, dim: int = DIM, max_words: int | None = None):
        self.dim, self.max_words = dim, max_words

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, text in zip(out, texts):
            for word in (text or "").lower().split()[: self.max_words]:
                h = crc32(word.encode())
                row[h % self.dim] += 1 if h >> 31 else -1
        norm = np.sqrt((out.astype(np.float64) ** 2).sum(1, keepdims=True))
        return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def pick_device(available: Callable[[str], bool]) -> str:
    """The first device there is, the processor if none."""
    return next((d for d in ("mps", "cuda") if available(d)), "cpu")


def model_path(explicit: str | None, snapshots: str, hub_id: str) -> str:
    """A stated folder, else the newest complete snapshot below a folder, else the hub's name.

    A snapshot is complete with configuration, tokenizer and weights of either format.
    """
    if explicit:
        if not (path := Path(explicit).expanduser()).exists():
            raise FileNotFoundError(f"no model at {path}")
        return str(path)
    root = Path(snapshots).expanduser()
    has = lambda p, *names: any((p / n).exists() for n in names)
    whole = [p for p in root.iterdir() if has(p, "config.json") and has(p, "tokenizer.json") and has(p, "model.safetensors", "pytorch_model.bin")] if root.exists() else []
    return str(max(whole, key=lambda p: p.stat().st_mtime)) if whole else hub_id


def encode(rows: DataFrame, text_col: str = "text", *, make: Callable[[], Encoder] = HashingEncoder, batch: int = BATCH, out_col: str = "embedding") -> DataFrame:
    """``rows`` with unit vectors of a text column; the encoder is made once per worker."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make()
        for part in parts:
            texts = part.fillna("").tolist()
            vectors = [v for i in range(0, len(texts), batch) for v in encoder.encode(texts[i : i + batch])]
            yield pd.Series(vectors, index=part.index, dtype=object)

    return rows.withColumn(out_col, run(F.col(text_col)))
