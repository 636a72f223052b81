"""Exact top-k by inner product, pruned with segment statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors of one slice and queries of one block; a task holds one of each.
SLICE, BLOCK = 16_384, 1_024
#: Rows in one packed piece on the way to its slice or block.
PACK = 2_048
#: Segments at each resolution, coarse to fine.
RESOLUTIONS = (4, 16)


def _segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, scaled so that a dot product of two rows bounds the inner product.

    Within a segment of length L the inner product is L * mean * mean' plus that of
    the deviations from the mean, at most L * deviation * deviation' in size (Cauchy
    and Schwarz); equivalently the distance is at least that of means and deviations.
    """
    parts = np.array_split(x, min(segments, x.shape[1]), axis=1)
    mean = np.stack([p.mean(axis=1) * np.sqrt(p.shape[1]) for p in parts], axis=1)
    rest = np.stack([np.sqrt(np.maximum(0, ((p - p.mean(axis=1, keepdims=True)) ** 2).sum(axis=1))) for p in parts], axis=1)
    return np.concatenate((mean, rest), axis=1)


def best_of_slice(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k best vectors other than its own, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    vectors, ids = vectors[order], ids[order]
    floats_q, floats_v = queries.astype(np.float64), vectors.astype(np.float64)
    exact = float(np.abs(floats_q).max(initial=0)) * float(np.abs(floats_v).max(initial=0)) * queries.shape[1] < 2**53
    levels = [(_segment_features(floats_q, s), _segment_features(floats_v, s)) for s in RESOLUTIONS]
    floor = np.full(len(queries), -np.inf)  # the k-th best score so far
    held: list[list[np.ndarray]] = [[np.zeros(0, np.int64), np.zeros(0, np.int64)] for _ in queries]
    for at in range(0, len(ids), PACK):
        part = slice(at, at + PACK)
        alive = np.ones((len(queries), len(ids[part])), dtype=bool)
        if at:
            for fq, fv in levels:
                rows = np.flatnonzero(alive.any(axis=1))
                bound = fq[rows] @ fv[part].T
                slack = 1e-9 * np.abs(bound) + 1e-6
                alive[rows] &= bound + slack >= floor[rows, None]
        some = np.flatnonzero(alive.any(axis=0))
        if not len(some):
            continue
        if exact:
            score = np.rint(floats_q @ floats_v[part][some].T).astype(np.int64)
        else:
            # Python's whole numbers, exact at any size; what no long holds becomes the nearest one that is.
            exact_score = queries.astype(object) @ vectors[part][some].T.astype(object)
            score = np.clip(exact_score, -(2**63), 2**63 - 1).astype(np.int64)
        mask = alive[:, some] & (ids[part][some][None, :] != query_ids[:, None])
        for q in np.flatnonzero((mask & (score >= floor[:, None])).any(axis=1)):
            take = np.flatnonzero(mask[q] & (score[q] >= floor[q]))
            s = np.concatenate((held[q][0], score[q, take]))
            v = np.concatenate((held[q][1], ids[part][some][take]))
            top = np.lexsort((v, -s))[:k]
            held[q] = [s[top], v[top]]
            if len(top) == k:
                floor[q] = s[top[-1]]
    count = [len(h[0]) for h in held]
    return np.repeat(query_ids, count), np.concatenate([h[1] for h in held]), np.concatenate([h[0] for h in held])


def packed(vectors: DataFrame, home: str) -> DataFrame:
    """(home, dim, ids, body): rows of one home packed into pieces of at most PACK vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}

        def out(key: tuple[int, int]) -> pa.RecordBatch:
            rows = held.pop(key)
            return pa.RecordBatch.from_pydict({
                home: pa.array([key[0]], pa.int32()), "dim": pa.array([key[1]], pa.int32()),
                "ids": [np.array([r[0] for r in rows], dtype=np.int64).tobytes()], "body": [np.array([r[1] for r in rows], dtype=np.int64).tobytes()],
            })

        for batch in batches:
            for h, i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = (h, len(v))
                held.setdefault(key, []).append((i, v))
                if len(held[key]) == PACK:
                    yield out(key)
        for key in list(held):
            yield out(key)

    return vectors.select(home, "vec_id", "vector").mapInArrow(run, f"{home} int, dim int, ids binary, body binary")


def top_k(embeddings: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0) -> DataFrame:
    """Each query's k largest inner products among all other rows.

    Components become floor(scale * x). Queries are the rows whose vec_id is divisible
    by ``every``. Queries travel in blocks and vectors in slices; each pair of a block
    and a slice is one task's work, and yields at most k rows a query, so the result
    is complete and exact at any size. A slice is read in parts; vectors whose bound
    from segment means and deviations, coarse then fine, is below a query's k-th best
    score so far are not compared.

    Returns query_id, rank (from 1), vec_id, score (long); ties go to the smaller
    vec_id. Rows with a null vec_id, a null vector or a null or non-finite component
    take no part. Vectors of another length than the query's are no candidates. Rows
    that repeat a vec_id are all candidates of other queries; of a query that repeats,
    one row asks. Components and scores past the range of a long become its nearest
    end. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    clean = embeddings.filter(F.col("vec_id").isNotNull() & x.isNotNull()).filter(finite)
    clean = clean.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double"))).alias("vector"))
    n = clean.count()
    slices, blocks = max(1, -(-n // SLICE)), max(1, -(-n // (every * BLOCK)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    data = packed(clean.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int")), "slice")
    asking = clean.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    asks = packed(asking.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")), "block")
    data = data.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asks = asks.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def rows(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        dim = int(frame["dim"].iloc[0])
        return np.frombuffer(b"".join(frame["ids"]), dtype=np.int64), np.frombuffer(b"".join(frame["body"]), dtype=np.int64).reshape(-1, dim)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty or not int(left["dim"].iloc[0]):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        (qi, q), (vi, v) = rows(left), rows(right)
        a, b, s = best_of_slice(q, qi, v, vi, k)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

    keys = ["block", "slice", "dim"]
    found = asks.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
