"""Approximate nearest neighbours by counting collisions on sorted projections.

Each vector is projected on ``PROJECTIONS`` random lines; a block of vectors
keeps one sorted array for each.  A query opens a window around its own
projection in every array, as wide as a radius, and widens all of them radius by
radius (virtual rehashing: no table is built again).  A vector collides when it
lies in a window; one that collides often enough is verified by its distance.
A query ends when its ten nearest so far are no farther than the radius: what lies
within the radius has then been met but for a small probability.

The lines and the first radius are fitted on a bounded sample; every row is
indexed.  Queries meet the rows in blocks of bounded size on both sides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import table

#: Lines that vectors are projected on.
PROJECTIONS = 80
#: Width of a window for radius 1; a vector at the radius collides with probability 0.82.
WIDTH = 2.7
#: Share of the lines that a vector must collide on.
ENOUGH = 0.70
#: Factor between radii.
STEP = 1.15
#: Vectors that the first radius is fitted on.
SAMPLE = 1000
#: Rows of a block, and queries of a block.
ROWS, QUERIES = 8192, 1024
#: One in so many ids is a query.
EVERY = 100
#: Neighbours of a query.
NEIGHBOURS = 10


def _matrix(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks)
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def lines(dimension: int, n: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng(dimension).standard_normal((dimension, n))


def search(data: np.ndarray, ids: np.ndarray, own: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, query_own: np.ndarray, k: int, first: float) -> list[tuple[int, int, float]]:
    """(query, row, distance) of the k nearest rows found for each query, ties to the smaller id; a query's own row (same id and ``own``) is left out."""
    n, a = len(data), lines(data.shape[1])
    m = a.shape[1]
    project = data @ a
    order = np.argsort(project, axis=0, kind="stable")
    sorted_by = np.take_along_axis(project, order, 0)
    at = queries @ a
    low = np.stack([np.searchsorted(sorted_by[:, j], at[:, j]) for j in range(m)], axis=1)
    high = low.copy()
    counts = np.zeros((len(queries), n), np.int16)
    verified = [np.zeros(0, np.int64) for _ in queries]
    distances = [np.zeros(0) for _ in queries]
    active, radius, threshold = np.arange(len(queries)), first, int(np.ceil(ENOUGH * m))
    out = []
    while len(active):
        half = WIDTH * radius / 2
        new_low = np.stack([np.searchsorted(sorted_by[:, j], at[active, j] - half, "left") for j in range(m)], axis=1)
        new_high = np.stack([np.searchsorted(sorted_by[:, j], at[active, j] + half, "right") for j in range(m)], axis=1)
        done = []
        for r, q in enumerate(active.tolist()):
            parts = [order[x:y, j] for j in range(m) for x, y in ((new_low[r, j], low[q, j]), (high[q, j], new_high[r, j])) if x < y]
            low[q], high[q] = np.minimum(new_low[r], low[q]), np.maximum(new_high[r], high[q])
            if parts:
                counts[q] += np.bincount(np.concatenate(parts), minlength=n).astype(np.int16)
            met = np.flatnonzero(counts[q] >= threshold)
            new = np.setdiff1d(met, verified[q], assume_unique=True)
            new = new[~((ids[new] == query_ids[q]) & (own[new] == query_own[q]))]
            verified[q] = np.r_[verified[q], new]
            distances[q] = np.r_[distances[q], np.sqrt(((data[new] - queries[q]) ** 2).sum(axis=1))]
            within = int((distances[q] <= radius).sum())
            if within >= k or (high[q] - low[q]).min() >= n:
                best = np.lexsort((ids[verified[q]], distances[q]))[:k]
                out += [(q, int(verified[q][b]), float(distances[q][b])) for b in best]
                done.append(r)
        active = np.delete(active, done)
        radius *= STEP
    return out


def _pair_rows(k: int, first: dict[int, float]):
    def rows(data: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        ids, query_ids = data.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
        own, query_own = data.column("own").to_numpy(), queries.column("own").to_numpy()
        if len(ids) and len(query_ids):
            x, y = _matrix(data.column("embedding")), _matrix(queries.column("embedding"))
            for b in range(0, len(y), 128):  # counts of so many queries at once
                part = slice(b, b + 128)
                found += [(q + b, r, d) for q, r, d in search(x, ids, own, y[part], query_ids[part], query_own[part], k, first.get(x.shape[1], 1.0))]
        q, r, d = (np.array(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": query_ids[q], "query_own": query_own[q], "vec_id": ids[r], "score": d})

    return bw.giving_back(rows)


def first_radii(vectors: DataFrame, k: int) -> dict[int, float]:
    """For each dimension, the radius to begin with: half the k-th nearest distance within a sample of the vectors."""
    out = {}
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toPandas()["embedding"]
    for size in {len(v) for v in sample}:
        x = np.stack([np.asarray(v, float) for v in sample if len(v) == size])
        y = x[:100]
        d = np.sqrt(np.maximum((x**2).sum(1) + (y**2).sum(1)[:, None] - 2 * y @ x.T, 0))
        d.sort(axis=1)
        kth = d[:, min(k, len(x) - 1)]
        out[size] = float(max(np.median(kth[kth > 0]) / 4 if (kth > 0).any() else 1.0, 1e-12))
    return out


def neighbours(embeddings: DataFrame, k: int = NEIGHBOURS, every: int = EVERY, rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """The k nearest rows found of each row whose vec_id is divisible by ``every``, by Euclidean distance.

    Vectors that are null, empty, zero or hold null or non-finite components take
    no part, nor do rows without an id.  Vectors of different dimensions do not
    meet.  Repeated rows (same id and vector) are one; rows that share an id but
    not the vector stand for themselves, and a query leaves out only its own row.
    Ties go to the smaller vec_id.  An empty table gives an empty result; other
    columns are not read.

    Returns query_id, rank, vec_id, score.
    """
    v = F.col("embedding")
    inf = float("inf")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists(v, lambda x: x != 0)
    held = embeddings.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(good).select("vec_id", "embedding", F.xxhash64("embedding").alias("own"), F.size(v).alias("dimension"))
    held = held.dropDuplicates(["vec_id", "own"])
    n = embeddings.count()
    data_blocks, query_blocks = max(1, -(-n // rows)), max(1, -(-n // (every * queries)))
    deal = lambda blocks: F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    all_of = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    data = held.withColumn("data_block", deal(data_blocks)).withColumn("query_block", all_of(query_blocks))
    asked = held.where(F.col("vec_id") % every == 0).withColumn("query_block", deal(query_blocks)).withColumn("data_block", all_of(data_blocks))
    key = ["dimension", "data_block", "query_block"]
    found = data.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_pair_rows(k, first_radii(held, k)), "query_id long, query_own long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_own").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))
