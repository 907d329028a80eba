"""A stated set of query vectors against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows z-normalised by the population deviation; zeros where it is 0."""
    sd = v.std(axis=1, keepdims=True)
    return np.where(sd == 0, 0.0, (v - v.mean(axis=1, keepdims=True)) / np.where(sd == 0, 1, sd))


def distances(q: np.ndarray, v: np.ndarray, metric: str, cuts: list[float] | None) -> np.ndarray:
    if metric == "mindist":
        table = np.array([[0.0 if abs(a - b) <= 1 else cuts[max(a, b) - 1] - cuts[min(a, b)] for b in range(len(cuts) + 1)] for a in range(len(cuts) + 1)]) ** 2
        out = np.zeros((len(q), len(v)))
        for k in range(q.shape[1]):
            out += table[q[:, k].astype(int)[:, None] - 1, v[:, k].astype(int)[None] - 1]
        return np.sqrt(out)
    if metric == "scaled":
        q, v = scaled(q), scaled(v)
    out = np.zeros((len(q), len(v)))
    for k in range(q.shape[1]):
        out += (q[:, k, None] - v[None, :, k]) ** 2
    return np.sqrt(out)


def nearest(rows: DataFrame, every: int, top: int, metric: str = "plain", cuts: list[float] | None = None, block: int = BLOCK) -> DataFrame:
    """``query_id, id, distance, rank``: the ``top`` nearest other rows of each row whose id is divisible by ``every``.

    ``rows``: ``id, v`` (arrays of one length). Queries and rows are cut into blocks of bounded size; each pair of blocks is one group that
    keeps only its own nearest, so no group and no result grows with the data beyond ``top`` per query and block. Ties go to the smaller id.
    """
    n = rows.count()
    q_blocks, r_blocks = max(1, -(-n // (every * block))), max(1, -(-n // block))
    part = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    queries = rows.filter(F.col("id") % every == 0).select(part("id", q_blocks).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(r_blocks - 1))).alias("rb"), F.lit(True).alias("query"), "id", "v")
    others = rows.select(F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"), part("id", r_blocks).alias("rb"), F.lit(False).alias("query"), "id", "v")
    pairs = queries.unionByName(others).groupBy("qb", "rb").agg(F.collect_list(F.struct("query", "id", "v")).alias("pts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                pts = batch.column("pts")[k].values
                is_q = pts.field("query").to_numpy(zero_copy_only=False).astype(bool)
                ids = np.asarray(pts.field("id"))
                v = np.asarray(pts.field("v").flatten(), dtype=float).reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))
                qi, ri = ids[is_q], ids[~is_q]
                if not len(qi) or not len(ri):
                    continue
                order = np.argsort(ri)
                ri, rv = ri[order], v[~is_q][order]
                d = np.round(distances(v[is_q], rv, metric, cuts), 9)
                d[qi[:, None] == ri[None]] = np.inf
                near = np.argsort(d, axis=1, kind="stable")[:, :top]
                q = np.repeat(qi, near.shape[1])
                dist = np.take_along_axis(d, near, 1).ravel()
                keep = np.isfinite(dist)
                yield pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(ri[near.ravel()][keep]), pa.array(dist[keep])], names=["query_id", "id", "distance"])

    best = pairs.mapInArrow(run, "query_id long, id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 6), "id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= top)
