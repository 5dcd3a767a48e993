"""Vectors: unit length, cosine ranking, rank fusion, and which vectors are still to be made."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

#: Fixed value: the constant of reciprocal-rank fusion.
RRF_K = 60
#: Vectors of a block; a step scores one block of queries against one block of vectors.
BLOCK = 1024
#: More than rounding to nine digits moves a score.
ROUNDING = 2e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def valid_vector(v: Column, dimensions: int) -> Column:
    """Of the right size, finite, and not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dimensions) & ~bad & (norm(v) > 0), F.lit(False))


def unit(v: Column) -> Column:
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / n)


def _blocks(vectors: DataFrame, prefix: str) -> DataFrame:
    """Unit vectors packed by BLOCK, in doubles: (ids, data); shuffled, so that pairs of partitions read them and don't make them."""
    import numpy as np

    def pack(batches):
        for b in batches:
            for i in range(0, len(b), BLOCK):
                part = b.iloc[i : i + BLOCK]
                yield pd.DataFrame({f"{prefix}_ids": [part["id"].to_numpy()], f"{prefix}_data": [np.stack(part["unit"].to_list()).astype(float).tobytes()]})

    rows = vectors.where("embedding is not null").select(F.col("vec_id").cast("long").alias("id"), unit(F.col("embedding")).alias("unit"))
    return rows.mapInPandas(pack, f"{prefix}_ids array<long>, {prefix}_data binary").repartition(f"{prefix}_ids")


def cosine_ranking(vectors: DataFrame, queries: DataFrame, k: int, floor: float | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): each query vector against all others, best first, ties by id as text.

    Any number of queries: each block of them meets each block of vectors once, and of a pair of blocks only what can be among
    a query's first k goes on. The floor is applied before ranking. Null vectors take no part; sizes must be equal."""
    import numpy as np

    def score(batches):
        for b in batches:
            for q_ids, q_data, v_ids, v_data in zip(b["q_ids"], b["q_data"], b["v_ids"], b["v_data"], strict=True):
                q, v = (np.ascontiguousarray(np.frombuffer(d).reshape(len(i), -1).T) for i, d in ((q_ids, q_data), (v_ids, v_data)))
                if len(q) != len(v):
                    raise ValueError("vectors of unlike sizes")
                total = np.zeros((q.shape[1], v.shape[1]))
                for x, y in zip(q, v, strict=True):  # one after another, as the expression over the arrays adds
                    total += x[:, None] * y
                keep = np.asarray(q_ids)[:, None] != np.asarray(v_ids)
                if floor is not None:
                    keep &= total >= floor - ROUNDING
                if k < total.shape[1]:
                    least = np.partition(np.where(keep, total, -np.inf), -k, axis=1)[:, -k]
                    keep &= total >= least[:, None] - ROUNDING
                at, to = np.nonzero(keep)
                yield pd.DataFrame({"query_id": np.asarray(q_ids)[at], "vec_id": np.asarray(v_ids)[to], "raw": total[at, to]})

    pairs = _blocks(vectors, "v").crossJoin(_blocks(queries, "q"))
    scored = pairs.mapInPandas(score, "query_id long, vec_id long, raw double").select("query_id", "vec_id", F.round("raw", 9).alias("score"))
    if floor is not None:
        scored = scored.where(F.col("score") >= floor)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").cast("string")))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def reciprocal_rank_fusion(lists: DataFrame, k: int) -> DataFrame:
    """lists (query_id, id, rank from 1) of any number of rankings -> (query_id, id, score, rank): one aggregate, no join."""
    fused = lists.groupBy("query_id", "id").agg(F.round(F.sum(1 / (RRF_K + F.col("rank"))), 12).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return fused.withColumn("rank", rank).where(F.col("rank") <= k)


def missing_vectors(chunks: DataFrame, stored: DataFrame, embedder: str) -> DataFrame:
    """Chunk versions that the store has no vector of this embedder for."""
    have = stored.where(F.col("embedder_id") == embedder).select("version_id")
    return chunks.join(have, "version_id", "left_anti")


def retained_vectors(stored: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors whose chunk version is still live."""
    return stored.join(chunks.select("version_id").distinct(), "version_id", "left_semi")


def embed_with(embed, dimensions: int):
    """A vectorised embedder seam: embed takes a list of texts and returns as many vectors, each checked."""
    @F.pandas_udf(ArrayType(FloatType()))
    def run(text: pd.Series) -> pd.Series:
        import numpy as np

        out = [np.asarray(v, np.float32) for v in embed(text.tolist())]
        if len(out) != len(text):
            raise ValueError("the embedder returned another number of vectors")
        for i, v in enumerate(out):
            n = float(np.sqrt((v.astype(float) ** 2).sum()))
            if v.shape != (dimensions,) or not np.isfinite(v).all() or n == 0:
                raise ValueError("the embedder returned a vector that is zero, not finite or of another size")
            out[i] = (v / n).astype(np.float32)
        return pd.Series(out)

    return run
