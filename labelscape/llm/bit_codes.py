"""Nearest neighbours by randomly rotated one-bit codes (operator 5).

A unit vector is rotated by a random orthogonal matrix and kept as the signs of its coordinates, packed to bits, with one correction scalar:
the inner product of the rotated vector with its own sign vector. Dividing a query's inner product with
the sign vector by that scalar estimates the cosine without bias, and the scalar also bounds the error with high probability.
Vectors whose upper bound reaches the k-th best lower bound are ranked again by their exact cosine.

Inner products come from the packed bits: a query makes a table of 256 sums for each byte of a code, and a code looks up one of each.

Queries meet all vectors block by block; a task holds one block of each. They meet twice: first codes alone give each query's k-th best lower
bound over all blocks, then blocks with their vectors rank again what reaches it. Nothing is capped: the bound decides how many are reranked.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscape.llm.common import written

#: Vectors in a block of codes, queries in a block.
BLOCK, QUERIES = 4096, 4096
#: Queries at a time, and how far two estimates of one inner product may be apart by rounding.
FEW, ROUNDING = 256, 1e-5
#: The signs that each byte stands for.
SIGNS = (2.0 * np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) - 1).astype(np.float32)


@lru_cache(maxsize=4)
def rotation(size: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and the correction scalars of the rows' directions."""
    unit = vectors / norms(vectors)[:, None]
    turned = unit @ rotation(vectors.shape[1], seed).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])


def norms(vectors: np.ndarray) -> np.ndarray:
    # scaled by the largest component, so that neither tiny nor huge vectors leave the range of numbers
    top = np.abs(vectors).max(axis=1)
    return top * np.sqrt(((vectors / top[:, None]) ** 2).sum(axis=1))


def signed_sums(bits: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Inner products of each query (a row of ``turned``) with the sign vectors that the rows of ``bits`` hold."""
    padded = np.zeros((len(turned), 8 * bits.shape[1]), np.float32)
    padded[:, :turned.shape[1]] = turned
    tables = np.ascontiguousarray((padded.reshape(len(turned), -1, 8) @ SIGNS.T).transpose(1, 2, 0))
    out = np.zeros((len(bits), len(turned)), np.float32)
    for table, column in zip(tables, bits.T):
        out += table[column]
    return out.T


def estimate(bits: np.ndarray, scalars: np.ndarray, queries: np.ndarray, seed: int,
             sureness: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines (a row for each query) and each code's error bound."""
    size = queries.shape[1]
    turned = (queries / norms(queries)[:, None] @ rotation(size, seed).T).astype(np.float32)
    inner = signed_sums(bits, turned) / np.float32(np.sqrt(size))
    error = sureness * np.sqrt(np.maximum(0, 1 - scalars ** 2) / scalars ** 2 / max(1, size - 1))
    return inner / scalars.astype(np.float32)[None, :], error.astype(np.float32)


def lower_bounds(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, bits: np.ndarray, scalars: np.ndarray, k: int, seed: int,
                 sureness: float) -> tuple[np.ndarray, np.ndarray]:
    """Query and lower bound of each query's ``k`` largest lower bounds in this block, its own row left out."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.float32))]
    for start in range(0, len(queries), FEW):
        guess, error = estimate(bits, scalars, queries[start:start + FEW], seed, sureness)
        for own, low in zip(query_ids[start:start + FEW], guess - error[None, :]):
            low = low[ids != own]
            best = np.partition(low, -k)[-k:] if len(low) > k else low
            found.append((np.full(len(best), own), best))
    return tuple(np.concatenate(c) for c in zip(*found))


def nearest(query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, ids: np.ndarray, vectors: np.ndarray, bits: np.ndarray,
            scalars: np.ndarray, k: int, seed: int, sureness: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, vector and exact cosine of each query's ``k`` best in this block (ties to the smaller id) among those whose upper bound
    reaches the query's ``least``; its own row left out."""
    lengths, found = norms(vectors), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for start in range(0, len(queries), FEW):
        some = slice(start, start + FEW)
        guess, error = estimate(bits, scalars, queries[some], seed, sureness)
        for own, query, bound, upper in zip(query_ids[some], queries[some], least[some], guess + error[None, :]):
            at = np.flatnonzero((ids != own) & (upper >= bound - ROUNDING))
            # summed row by row, so that equal vectors have equal scores
            scores = (vectors[at] / lengths[at, None] * (query / norms(query[None])[0])).sum(axis=1)
            best = np.lexsort((ids[at], -scores))[:k]
            found.append((np.full(len(best), own), ids[at[best]], scores[best]))
    return tuple(np.concatenate(c) for c in zip(*found))


def usable(vector: str) -> Column:
    """Neither null nor empty nor zero, and all components finite numbers."""
    return F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)


def search(df: DataFrame, is_query: Column, *, k: int = 5, key: str = "vec_id", vector: str = "embedding",
           seed: int = 5, sureness: float = 2.2) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` rows with the largest cosine found for every row for which ``is_query`` holds.

    ``sureness`` is the number of standard deviations in the error bound. Rows with a null key or unusable vector take no part; of
    rows with equal keys the smallest vector counts; vectors of another length than the query's are no candidates. An empty table gives no
    rows, and other columns are not looked at.
    """
    own = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("asks"))
    own = written(own.where(F.col("id").isNotNull() & usable("vector")).groupBy("id").agg(
        F.min("vector").alias("vector"), F.max("asks").alias("asks")).withColumn("size", F.size("vector")))
    counts = own.agg(F.count("*").alias("all"), F.count_if("asks").alias("asks")).head()
    many, asked = -(-counts["all"] // BLOCK) or 1, -(-counts["asks"] // QUERIES) or 1

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        table = table.combine_chunks()
        values = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        ids = table.column("id").to_numpy()
        return ids, values.reshape(len(ids), -1)

    def coded(table: pa.Table) -> pa.Table:
        ids, vectors = matrix(table)
        bits, scalars = encode(vectors, seed)
        blobs = [x.tobytes() for x in (ids, vectors, bits, scalars)]
        return pa.table({n: pa.array([v], t) for n, v, t in zip(
            ("size", "block", "ids", "vectors", "bits", "scalars"), (table.column("size")[0].as_py(), table.column("block")[0].as_py(), *blobs),
            (pa.int32(), pa.int64(), *[pa.binary()] * 4))})

    def asking(table: pa.Table) -> pa.Table:
        ids, vectors = matrix(table)
        columns = {"size": pa.array([vectors.shape[1]], pa.int32()), "part": pa.array([table.column("part")[0].as_py()], pa.int64()),
                   "query_ids": pa.array([ids.tobytes()], pa.binary()), "queries": pa.array([vectors.tobytes()], pa.binary())}
        return pa.table(columns | {"least": pa.array([table.column("least").to_numpy().astype(np.float32).tobytes()], pa.binary())})

    codes = written(own.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(many))).groupBy("size", "block").applyInArrow(
        coded, "size int, block long, ids binary, vectors binary, bits binary, scalars binary"))

    def met_by(queries: DataFrame, columns: list[str]):
        """Each block of codes beside each block of queries of its size."""
        asks = queries.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(asked))).groupBy("size", "part").applyInArrow(
            asking, "size int, part long, query_ids binary, queries binary, least binary").withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.lit(many - 1)).cast("array<long>")))
        blocks = codes.select("size", "block", *columns).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(asked - 1)).cast("array<long>")))
        unit = ["size", "block", "part"]
        return blocks.groupBy(*unit).cogroup(asks.groupBy(*unit))

    def of(table: pa.Table, name: str, kind: type, width: int = 0) -> np.ndarray:
        values = np.frombuffer(table.column(name)[0].as_py(), kind)
        return values.reshape(-1, width) if width else values

    def bound(left: pa.Table, right: pa.Table) -> pa.Table:
        out = (np.zeros(0, np.int64), np.zeros(0, np.float32))
        if left.num_rows and right.num_rows:
            size = left.column("size")[0].as_py()
            out = lower_bounds(of(right, "query_ids", np.int64), of(right, "queries", np.float64, size), of(left, "ids", np.int64),
                               of(left, "bits", np.uint8, -(-size // 8)), of(left, "scalars", np.float64), k, seed, sureness)
        return pa.table(dict(zip(("id", "lower"), map(pa.array, out))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if left.num_rows and right.num_rows:
            size = left.column("size")[0].as_py()
            out = nearest(of(right, "query_ids", np.int64), of(right, "queries", np.float64, size), of(right, "least", np.float32),
                          of(left, "ids", np.int64), of(left, "vectors", np.float64, size), of(left, "bits", np.uint8, -(-size // 8)),
                          of(left, "scalars", np.float64), k, seed, sureness)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, out))))

    queries = own.where("asks")
    lowest = met_by(queries.withColumn("least", F.lit(float("-inf")).cast("float")), ["ids", "bits", "scalars"]).applyInArrow(bound, "id long, lower float")
    lowest = lowest.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("lower")))).where(
        F.col("place") <= k).groupBy("id").agg(F.min(F.when(F.col("place") == k, F.col("lower"))).alias("least"))
    queries = queries.join(lowest, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")).cast("float")))
    best = met_by(queries, ["ids", "vectors", "bits", "scalars"]).applyInArrow(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
