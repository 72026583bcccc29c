"""A stand-in for an embedding model: hashed words, no learnt meaning. Any function of texts to vectors takes its place."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSION = 384


def hashed_words(texts: list[str], dimension: int = DIMENSION) -> np.ndarray:
    """Unit vectors of signed hashed words and word pairs."""
    import re
    import zlib

    out = np.zeros((len(texts), dimension))
    for k, t in enumerate(texts):
        words = re.findall(r"\w+", (t or "").lower())
        for term in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
            h = zlib.crc32(term.encode("utf-8", "replace"))
            out[k, h % dimension] += 1 if h >> 31 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def embed(c: Column, model: Callable[[list[str]], np.ndarray] = hashed_words) -> Column:
    @F.pandas_udf("array<double>")
    def run(text):
        import pandas as pd

        return pd.Series(list(model(text.fillna("").tolist())) if len(text) else [], dtype=object)

    return run(c)
