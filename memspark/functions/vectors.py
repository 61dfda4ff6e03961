"""Vector helpers and the two hashing embedders."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from memspark.functions.text import runs

# Output size of each known embedding model; other models are taken to have 1536.
MODEL_DIMENSIONS = {
    "local": 384,
    "text-embedding-3-small": 1536,
    "text-embedding-3-large": 3072,
    "text-embedding-ada-002": 1536,
}
DEFAULT_MODEL_DIMENSION = 1536


def model_dimension(model: Column) -> Column:
    """Size of a model's vectors; a vendor prefix before the first slash is ignored."""
    bare = F.regexp_replace(model, r"^[^/]*/", "")
    sizes = F.create_map(*[F.lit(x) for kv in MODEL_DIMENSIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(sizes, bare), F.try_element_at(sizes, model), F.lit(DEFAULT_MODEL_DIMENSION))


def require_one_dimension(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Fail the job, in the tasks, when a row's size differs from the smallest size of the table."""
    size = F.size(vector_col)
    smallest = vectors.agg(F.min(size)).scalar()
    ok = F.when(size == smallest, F.col(vector_col)).otherwise(F.raise_error(F.lit("mixed vector dimensions")))
    return vectors.withColumn(vector_col, ok)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision: null for unequal or empty vectors, 0 when a norm is 0."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    na, nb = dot(a, a), dot(b, b)
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(usable, F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (F.sqrt(na) * F.sqrt(nb))))


_ASCII_WORD = re.compile(r"[a-z0-9]+")


def hash_embedding(dimension: int = 384):
    """Arrow UDF text -> unit vector by the hashing trick (8-byte BLAKE2b: slot from the first four bytes, sign from bit 32)."""
    if dimension <= 0:
        raise ValueError("dimension must be positive")

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        known: dict[str, tuple[int, float]] = {}

        def place(word: str) -> tuple[int, float]:
            spot = known.get(word)
            if spot is None:
                value = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                spot = known[word] = ((value & 0xFFFFFFFF) % dimension, 1.0 if (value >> 32) & 1 else -1.0)
            return spot

        out = []
        for text in texts:
            vec = np.zeros(dimension)
            found = [place(w) for w in _ASCII_WORD.findall((text or "").lower())]
            if found:
                slots, signs = zip(*found)
                np.add.at(vec, list(slots), signs)
            norm = np.linalg.norm(vec)
            out.append((vec / norm if norm > 0 else vec).astype(np.float32))
        return pd.Series(out)

    return embed


def hash_embedding_sparse(docs: DataFrame, id_col: str, text_col: str, dimension: int = 384) -> DataFrame:
    """All-SQL hashing embedder with SHA-256 slots: long form (id, slot, weight), zero weights left out.

    The texts are read and cut once. Words are counted within a row, and one shuffle by id serves both the slots and the norm.
    """
    words = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("[a-z0-9]+"), F.lit(0))
    digest = F.sha2(F.col("w.item"), 256)
    raw = (
        docs.select(F.col(id_col), F.explode(runs(words)).alias("w"))
        .select(id_col, "w", digest.alias("digest"))
        .withColumn("slot", (F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint") % dimension).cast("int"))
        .withColumn("sign", F.when(F.conv(F.substring("digest", 9, 1), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1))
        .select(id_col, "slot", (F.col("w.n") * F.col("sign")).alias("part"))
        .repartition(id_col)
        .groupBy(id_col, "slot")
        .agg(F.sum("part").alias("raw"))
        .filter("raw <> 0")
    )
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(id_col)))
    return raw.select(id_col, "slot", (F.col("raw") / norm).alias("weight"))
