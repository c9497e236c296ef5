"""Tokens, term frequencies, the text splitter and the deterministic embedding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pieces import pieces

#: Runs of letters and numbers, after lower-casing.
TOKEN = r"([\p{IsAlphabetic}\p{N}]+)"
MOST_TF = 65_535


def tokens(text: Column) -> Column:
    """The lower-case tokens in their order; null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1)), F.array().cast("array<string>"))


def unique_terms(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def tokens_of(text: str) -> list[str]:
    """The same for a Python string: each character is tested, then lower-cased."""
    out, word = [], []
    for c in text:
        if c.isalnum():
            word.append(c.lower())
        elif word:
            out.append("".join(word))
            word = []
    return [*out, "".join(word)] if word else out


def split_text(text: str, size: int = 512, overlap: int = 64, tail: str = "all") -> list[str]:
    """Chunks of at most ``size`` characters that overlap by ``overlap``, cut at the last paragraph break, else after the last full stop.

    With tail="all" the end of the text is given again and again, one character shorter each time, down to the last, once what is
    left is no longer than the overlap; with tail="stop" the first chunk that reaches the end is the last.
    """
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        chunk = text[at:end]
        if end < len(text):
            if (k := chunk.rfind("\n\n")) >= 0:
                chunk = chunk[:k]
            elif (k := chunk.rfind(". ")) >= 0:
                chunk = chunk[: k + 1]
        out.append(chunk)
        if tail == "stop" and at + len(chunk) >= len(text):
            break
        at += max(1, len(chunk) - overlap)
    return out


def split(text: Column, size: int = 512, overlap: int = 64, tail: str = "all") -> Column:
    """An array of chunks; null text has none."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for (piece,) in pieces(texts):
                yield pa.array([split_text(t, size, overlap, tail) if t else [] for t in piece.to_pylist()], type=pa.list_(pa.string()))

    return run(text)


def embed_text(text: str, dim: int) -> list[float]:
    """Bytes, centred and scaled, summed by their place modulo ``dim``, then normalised; zeros for an empty text."""
    b = (np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8) - 127.5) / 127.5
    v = np.zeros(dim)
    if dim and len(b):
        full = np.zeros(-(-len(b) // dim) * dim)
        full[: len(b)] = b
        v = full.reshape(-1, dim).sum(axis=0)
        n = np.sqrt((v * v).sum())
        if n > 0:
            v = v / n
    return v.astype(np.float32).tolist()


def deterministic_embed(text: Column, dim: int) -> Column:
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([embed_text(t or "", dim) for t in texts], dtype=object)

    return run(text)
