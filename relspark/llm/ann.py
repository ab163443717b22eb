"""Approximate nearest neighbours by inner product with cross-polytope hashing.

* *Hash.* A vector goes through three rounds of random signs and a fast Hadamard transform (a
  pseudo-rotation); its bucket is the signed axis nearest to the result. ``tables`` independent
  rotations give as many tables. If the norms differ, candidates get one more coordinate that makes
  all norms equal and queries a zero there, so that the largest inner product is the smallest angle.
* *Multiprobe.* A query looks into the ``probes`` nearest signed axes of every table.
* *Exact reranking in blocks.* A bucket's vectors are dealt by id hash into blocks of about
  ``block`` rows and its queries into blocks too; pairs of blocks meet in one matrix product, and only
  each query's best ``top`` leave the task. A bucket with a third of all vectors is so many more
  blocks, and no candidate pair is ever a row.
* Queries that found fewer than ``top`` candidates are held against all vectors in the same way.

All rows are indexed; nothing is fitted. Scores are inner products of the original vectors in double
precision, summed the same way for every pair, so equal vectors tie exactly and the smaller id wins.

Defined results: vectors that are null, empty, all zero, or hold a null or non-finite component take
no part; vectors meet only vectors of their own length; rows without an id take no part; rows that
repeat an id count as one with its best score. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import keep, shared_dir


@dataclass(frozen=True)
class CrossPolytope:
    tables: int = 10
    probes: int = 12
    block: int = 4096
    seed: int = 20


def rotate(x: np.ndarray, seed: int, table: int) -> np.ndarray:
    """Three rounds of random signs and the normalised Hadamard transform; the width is a power of two."""
    n, width = x.shape
    for turn in range(3):
        x = x * np.random.default_rng([seed, table, turn, width]).choice(np.array([-1.0, 1.0], np.float32), width)
        step = 1
        while step < width:
            x = x.reshape(n, -1, 2, step)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, width)
            step *= 2
        x = x / np.float32(np.sqrt(width))
    return x


def buckets(x: np.ndarray, how: CrossPolytope, probes: int) -> np.ndarray:
    """(rows, tables, probes): signed axes, the nearest first; axis a is 2a, its opposite 2a + 1."""
    out = np.empty((len(x), how.tables, min(probes, 2 * x.shape[1])), np.int32)
    for t in range(how.tables):
        r = rotate(x, how.seed, t)
        signed = np.stack([r, -r], axis=2).reshape(len(r), -1)
        if out.shape[2] == 1:
            out[:, t, 0] = signed.argmax(axis=1)
        else:
            near = np.argpartition(-signed, out.shape[2] - 1, axis=1)[:, : out.shape[2]]
            out[:, t] = np.take_along_axis(near, np.argsort(-np.take_along_axis(signed, near, 1), axis=1, kind="stable"), 1)
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _hashed(vectors: DataFrame, norms: dict[int, tuple[float, float]], how: CrossPolytope, probes: int, query: bool) -> DataFrame:
    """dim, t, bucket, id, v for each table (and probe)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array(batch.column(2).to_pylist())
            for dim in np.unique(sizes).tolist():
                for rows in np.array_split(np.flatnonzero(sizes == dim), max(1, int((sizes == dim).sum()) // 2000)):
                    ids, column = batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows))
                    v = _matrix(column, dim).astype(np.float64)
                    low, high = norms[dim]
                    norm = np.linalg.norm(v, axis=1, keepdims=True)
                    even = high - low <= 1e-5 * high
                    unit = v / norm if query or even else v / high
                    extra = [] if even else [np.zeros((len(v), 1)) if query else np.sqrt(np.maximum(0, 1 - (unit**2).sum(axis=1, keepdims=True)))]
                    width = 1 << max(0, dim + len(extra) - 1).bit_length()
                    x = np.concatenate([unit, *extra, np.zeros((len(v), width - dim - len(extra)))], axis=1).astype(np.float32)
                    codes = buckets(x, how, probes)
                    own = np.repeat(np.arange(len(rows)), how.tables * codes.shape[2])
                    tables = np.tile(np.repeat(np.arange(how.tables, dtype=np.int32), codes.shape[2]), len(rows))
                    yield pa.record_batch([pa.array(np.full(len(own), dim, np.int32)), pa.array(tables), pa.array(codes.reshape(-1)), ids.take(pa.array(own)), column.take(pa.array(own))], ["dim", "t", "bucket", "id", "v"])

    return vectors.select("id", "v", F.size("v").alias("dim")).mapInArrow(run, "dim int, t int, bucket int, id long, v array<double>")


def _nearest(index: DataFrame, queries: DataFrame, top: int, block: int) -> DataFrame:
    """q, id, score: for every query the best of each task's blocks, over all buckets that it looks into."""
    keys = ["dim", "t", "bucket"]
    counts = index.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    counts = F.broadcast(counts)  # one row for each signed axis of each table at most
    deal = lambda df, n: F.pmod(F.xxhash64("id"), n).cast("int")
    packed = F.collect_list(F.struct("id", "v"))
    left = index.join(counts, keys).withColumn("block", deal(index, F.col("blocks"))).groupBy(*keys, "block").agg(packed.alias("rows"))
    asked = queries.groupBy(*keys).agg(F.ceil(F.count("*") / (block // 4)).cast("int").alias("parts"))
    right = queries.join(F.broadcast(asked), keys).withColumn("part", deal(queries, F.col("parts"))).groupBy(*keys, "part").agg(packed.alias("asked"))
    right = right.join(counts, keys).select(*keys, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "asked")
    met = left.join(right, [*keys, "block"]).select("dim", "rows", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, dict[int, float]] = {}

        def flush() -> pa.RecordBatch:
            rows = [(q, i, s) for q, own in best.items() for i, s in sorted(own.items(), key=lambda x: (-x[1], x[0]))[:top]]
            best.clear()
            return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["q", "id", "score"])

        for batch in batches:
            for k in range(batch.num_rows):
                dim = batch.column(0)[k].as_py()
                (ids, v), (asked, w) = (_rows(batch.column(c)[k].values, dim) for c in (1, 2))
                by_id = np.argsort(ids, kind="stable")
                ids, v = ids[by_id], v[by_id]
                starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))  # where each id's rows begin
                scores = w @ v.T
                for j, q in enumerate(asked.tolist()):
                    row = np.where(ids == q, -np.inf, scores[j])
                    if len(starts) > top:
                        peaks = row if len(starts) == len(row) else np.maximum.reduceat(row, starts)
                        cut = np.partition(peaks, len(peaks) - top)[len(peaks) - top]
                        chosen = np.flatnonzero(row >= cut - 1e-9 * (1 + abs(cut)))
                    else:
                        chosen = np.arange(len(row))
                    chosen = chosen[ids[chosen] != q]
                    exact = (v[chosen] * w[j]).sum(axis=1)
                    order = np.lexsort((ids[chosen], -exact))
                    order = order[np.sort(np.unique(ids[chosen][order], return_index=True)[1])][:top]  # each id's best row
                    own = best.setdefault(q, {})
                    for i, s in zip(ids[chosen][order].tolist(), exact[order].tolist(), strict=True):
                        own[i] = max(s, own.get(i, -np.inf))
                    if len(own) > 8 * top:
                        best[q] = dict(sorted(own.items(), key=lambda x: (-x[1], x[0]))[:top])
                if len(best) > 20_000:
                    yield flush()
        yield flush()

    return met.mapInArrow(run, "q long, id long, score double")


def _rows(rows: pa.StructArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return rows.field("id").to_numpy(zero_copy_only=False), _matrix(rows.field("v"), dim)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    found = found.groupBy("q", "id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= top)


def search(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 20, how: CrossPolytope = CrossPolytope()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every row that ``is_query`` marks its nearest other rows."""
    folder = shared_dir(vectors.sparkSession)
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), is_query.alias("asks")).where("id IS NOT NULL AND size(v) > 0")
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(usable).groupBy("id", "v").agg(F.max("asks").alias("asks")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    rows = keep(rows, "vectors", folder)
    norms = {r["dim"]: (r["low"], r["high"]) for r in rows.groupBy(F.size("v").alias("dim")).agg(F.min("norm").alias("low"), F.max("norm").alias("high")).collect()}  # one row for each vector length
    asks = rows.where("asks")
    found = _nearest(_hashed(rows, norms, how, 1, False), _hashed(asks, norms, how, how.probes, True), top, how.block)
    ranked = keep(_ranked(found, top), "ranked", folder)

    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.countDistinct("id").alias("n"))
    have = ranked.groupBy(F.col("q").alias("id")).agg(F.max("rank").alias("have"))
    short = asks.withColumn("dim", F.size("v")).join(F.broadcast(sizes), "dim").join(have, "id", "left").where(F.coalesce("have", F.lit(0)) < F.least(F.lit(top), F.col("n") - 1))
    short = keep(short.select("id", "v"), "short", folder)
    if not short.isEmpty():
        whole = [F.size("v").alias("dim"), F.lit(0).alias("t"), F.lit(0).alias("bucket"), "id", "v"]
        more = _ranked(_nearest(rows.select(*whole), short.select(*whole), top, how.block), top)
        ranked = ranked.join(short.select(F.col("id").alias("q")).distinct(), "q", "left_anti").unionByName(more)
    return ranked.select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def ann_query(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, against all vectors."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
