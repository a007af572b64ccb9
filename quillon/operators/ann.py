"""Approximate nearest neighbours: an inverted file of cells around centroids. Every vector is in the index; a query reads the
cells nearest to it, as partitions, and ranks their vectors exactly."""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators import rank

SAMPLE, MAX_CELLS, ROUNDS = 20_000, 4096, 12


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def _matrix(column, dim: int) -> np.ndarray:
    """Unit rows; null vectors and vectors with a null are zero, like nothing; another dimension is an error."""
    rows = [v if v and None not in v else [0.0] * dim for v in column.to_pylist()]
    wrong = next((len(v) for v in rows if len(v) != dim), None)
    if wrong is not None:
        raise ValueError(f"vector dimension mismatch: expected {dim}, got {wrong}")
    return _unit(np.array(rows, np.float64).reshape(len(rows), dim))


def fit(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Centroids (unit rows) by spherical k-means over at most `sample` vectors, lowest hash of id first: the bound of what
    reaches the driver. cells defaults to the square root of the number of vectors, MAX_CELLS at most."""
    good = vectors.filter("embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)")
    n = vectors.count()
    got = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("embedding").collect()
    if not got:
        return np.zeros((0, 0))
    dims = {len(r[0]) for r in got}
    if len(dims) > 1:
        raise ValueError(f"vector dimension mismatch: expected {max(dims)}, got {min(dims)}")
    x = _unit(np.array([r[0] for r in got], np.float64))
    k = min(len(x), cells or max(1, min(MAX_CELLS, round(math.sqrt(n)))))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        at = (x @ c.T).argmax(1)
        for i in range(k):
            mine = x[at == i]
            if len(mine):
                c[i] = mine.mean(0)
        c = _unit(c)
    return c


def build(vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE) -> None:
    """vectors (doc_id, embedding) -> path/rows partitioned by cell, path/centroids."""
    c = fit(vectors, cells, sample)
    spark = vectors.sparkSession
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cell int, centroid array<double>").write.parquet(f"{path}/centroids")

    def run(batches):
        for b in batches:
            at = (_matrix(b.column(1), c.shape[1]) @ c.T).argmax(1) if len(c) else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], ["doc_id", "embedding", "cell"])

    kind = vectors.schema["doc_id"].dataType.simpleString()
    rows = vectors.select("doc_id", F.col("embedding").cast("array<float>").alias("embedding"))
    rows.mapInArrow(run, f"doc_id {kind}, embedding array<float>, cell int").write.partitionBy("cell").parquet(f"{path}/rows")


def centroids(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # MAX_CELLS at most
    return np.array([r.centroid for r in rows])


def _probes(c: np.ndarray, probes: int | None) -> int:
    """Half of the cells by default, which vectors without any cluster need for a recall of 0.9; clustered ones need few."""
    return probes or max(1, math.ceil(len(c) / 2))


def search(spark: SparkSession, path: str, query: list[float], k: int, probes: int | None = None) -> DataFrame:
    """rank.knn over the `probes` cells nearest to the query: a partition filter."""
    c = centroids(spark, path)
    probes = _probes(c, probes)
    near = np.argsort(-(c @ _unit(np.array([query], np.float64))[0]), kind="stable")[:probes]
    return rank.knn(spark.read.parquet(f"{path}/rows").filter(F.col("cell").isin(near.tolist())).select("doc_id", "embedding"), query, k)


def search_many(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """queries (doc_id long, embedding) -> (query_id, doc_id, similarity, rank): for each its k best of the nearest cells. Cells
    go in blocks of up to 1,024 vectors, so a crowded cell is many blocks; only k rows a query and block are shuffled."""
    c = centroids(spark, path)
    probes = _probes(c, probes)

    def blocks(batches, spread):
        for b in batches:
            m = _matrix(b.column(1), c.shape[1])
            ids = np.array([rank.NO_ID if i is None else i for i in b.column(0).to_pylist()], np.int64)
            cell = b.column(2).to_numpy() if not spread else None
            at = np.argsort(-(m @ c.T), axis=1, kind="stable")[:, :spread].ravel() if spread else cell
            row = np.repeat(np.arange(len(ids)), min(spread, len(c))) if spread else np.arange(len(ids))
            for x in np.unique(at):
                pick = row[at == x]
                for lo in range(0, len(pick), 1024):
                    p = pick[lo : lo + 1024]
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()), pa.array([ids[p].tolist()], pa.list_(pa.int64())), pa.array([m[p].tobytes()], pa.binary())], ["cell", "ids", "m"])

    def best(batches):
        for b in batches:
            for r in b.to_pylist():
                ids, sims = np.array(r["ids"], np.int64), np.round(np.frombuffer(r["q"]).reshape(len(r["qids"]), -1) @ np.frombuffer(r["m"]).reshape(len(r["ids"]), -1).T, 9)
                for n, row in zip(r["qids"], sims):
                    top = np.lexsort((ids, -row))[:k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), n, np.int64)), pa.array(ids[top], mask=ids[top] == rank.NO_ID), pa.array(row[top])], ["query_id", "doc_id", "similarity"])

    kind = "cell int, ids array<long>, m binary"
    ask = queries.filter("doc_id IS NOT NULL").select("doc_id", "embedding").mapInArrow(lambda b: blocks(b, probes), kind).select("cell", F.col("ids").alias("qids"), F.col("m").alias("q"))
    held = spark.read.parquet(f"{path}/rows").select("doc_id", "embedding", "cell").mapInArrow(lambda b: blocks(b, 0), kind)
    part = held.join(ask, "cell").select("ids", "m", "qids", "q").mapInArrow(best, "query_id long, doc_id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id")
    return part.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
