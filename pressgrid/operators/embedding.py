"""Hash embedding of texts, and the hook for a model-backed one."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pressgrid import constants as C


class _TokenCodes(dict):
    """token -> 2 * bucket + sign bit, hashed once per Arrow batch.

    The bucket comes from MD5 bytes 0-3 (little endian), the sign from bit 0 of byte 4.
    """

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        digest = hashlib.md5(token.encode("utf-8")).digest()
        code = int.from_bytes(digest[:4], "little") % self.dim * 2 + (digest[4] & 1)
        self[token] = code
        return code


def hash_encoder(dim: int = C.EMBED_DIM):
    """Pandas UDF text -> unit-length array<float> of signed token counts per bucket.

    Hashing in the JVM costs several microseconds per token, because the lambda
    over the token array is interpreted; here a batch hashes each distinct
    token once and fills its whole matrix with one numpy call.
    """

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        known = _TokenCodes(dim)
        codes = [[known[t] for t in (text or "").lower().split()] for text in texts]
        sizes = np.fromiter(map(len, codes), dtype=np.int64, count=len(codes))
        flat = np.fromiter((c for row in codes for c in row), dtype=np.int64, count=int(sizes.sum()))
        cells = np.repeat(np.arange(len(codes)), sizes) * dim + flat // 2
        signs = flat % 2 * 2.0 - 1.0
        grid = np.bincount(cells, weights=signs, minlength=len(codes) * dim).astype(np.float64).reshape(len(codes), dim)
        norms = np.sqrt((grid * grid).sum(axis=1, keepdims=True))
        unit = np.divide(grid, norms, out=np.zeros_like(grid), where=norms > 0).astype(np.float32)
        return pd.Series(list(unit))

    return encode


def hash_embedding(df: DataFrame, text_col: str, dim: int = C.EMBED_DIM, out: str = "embedding") -> DataFrame:
    """Add the hash embedding of a text column.  No shuffle: rows never leave their task."""
    return embed_with(df, text_col, hash_encoder(dim), out)


def embed_with(df: DataFrame, text_col: str, encoder, out: str = "embedding") -> DataFrame:
    """Add vectors from a Pandas UDF column function (text -> array<float>), e.g. a model."""
    return df.withColumn(out, encoder(F.col(text_col)))


def sparse_components(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, bucket, weight) of the non-zero components.

    The outer form keeps the optimizer from testing the vector's size first,
    which would compute it twice.
    """
    return (
        df.select(key, F.posexplode_outer(vector).alias("bucket", "weight"))
        .where("weight <> 0")
    )
