"""Vector operators: cosine, exact nearest neighbours, the hashed embedder."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_camel

DIM = 384


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where sizes differ or a vector is zero."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def l2_normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: (x / n).cast("float"))).otherwise(a)


def knn(rows: DataFrame, id_col: str, vec_col: str, query: list[float], k: int) -> DataFrame:
    """id, score of the k nearest by cosine; one pass, top-k in each task first."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(F.col(id_col).alias("id"), cosine(F.col(vec_col), q).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def knn_batch(rows: DataFrame, id_col: str, vec_col: str, queries: np.ndarray, k: int) -> DataFrame:
    """query, id, score, rank for a matrix of queries: a matrix product a batch, k kept of each, then the k best."""
    spark = rows.sparkSession
    q = queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-12)
    shared = spark.sparkContext.broadcast(q.astype(np.float32))
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["v"].to_numpy()).astype(np.float32)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            sims = m @ x.T
            take = min(k, sims.shape[1])
            best = np.argpartition(-sims, take - 1, axis=1)[:, :take]
            yield pd.DataFrame({"query": np.repeat(np.arange(len(m)), take), "id": b["id"].to_numpy()[best.ravel()], "score": np.take_along_axis(sims, best, 1).ravel().astype(float)})

    near = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).mapInPandas(run, f"query long, id {id_type}, score double")
    r = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return near.withColumn("rank", r).filter(F.col("rank") <= k)


# ---- hashed embedder ---------------------------------------------------------

# Fixed value: white space and the 28 marks between words.
DELIMITERS = re.compile(r"[\s_./\\\-(){}\[\]:;,\"'`=+*&|<>#@!?]+")


def fnv1a32(data: bytes, start: int = 0x811C9DC5) -> int:
    h = start
    for c in data:
        h = ((h ^ c) * 0x01000193) & 0xFFFFFFFF
    return h


#: Features whose hashes a worker keeps, some 250 bytes each.
KEPT_FEATURES = 200_000

_SEEDS = [fnv1a32(i.to_bytes(4, "little")) for i in range(4)]


def embed_tokens(text: str) -> list[str]:
    return [p for piece in DELIMITERS.split(text) for part in split_camel(piece) if len((p := part.lower()).encode()) >= 2]


def embed_features(text: str) -> dict[str, float]:
    """Weights: of words, share of the words times ln(1 + bytes); of the lower-cased text's trigrams and bigrams, half and 0.3 of their share."""
    tokens = embed_tokens(text)
    out = {t: n / len(tokens) * math.log(1 + len(t.encode())) for t, n in Counter(tokens).items()}
    low = text.lower()
    for size, mark, share in ((3, "tri:", 0.5), (2, "bi:", 0.3)):
        total = max(1, len(low) - size + 1)
        for g, n in Counter(low[i : i + size] for i in range(len(low) - size + 1)).items():
            out[mark + g] = n / total * share
    return out


@lru_cache(KEPT_FEATURES)
def feature_hashes(feature: str) -> tuple[int, ...]:
    """The four hashes of a feature; words and grams come again in every text, so a worker keeps them."""
    raw = feature.encode()
    return tuple(fnv1a32(raw, s) for s in _SEEDS)


def embed(text: str, dim: int = DIM) -> np.ndarray:
    """Signed projection of ``embed_features`` to four places each, L2-normalised; zero for a blank text."""
    v = np.zeros(dim, np.float64)
    for t, w in embed_features(text.strip()).items():
        for h in feature_hashes(t):
            v[h % dim] += w if h >> 31 else -w
    n = np.linalg.norm(v)
    return (v / n if n else v).astype(np.float32)


def pack(v: Column) -> Column:
    """A vector as little-endian float32 bytes, by Arrow batches."""

    def run(vs: pd.Series) -> pd.Series:
        return vs.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return F.pandas_udf(run, "binary")(v)


def unpack(blob: Column) -> Column:
    """The vector of little-endian float32 bytes; a blob that is no whole number of them is null."""

    def run(bs: pd.Series) -> pd.Series:
        return bs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4").tolist())

    return F.pandas_udf(run, "array<float>")(blob)


def embed_column(text: Column) -> Column:
    """``embed`` of a column, by Arrow batches; a null is an empty text."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: embed(t or "").tolist())

    return F.pandas_udf(run, "array<float>")(text)
