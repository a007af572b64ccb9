"""Ranking from the index tables: BM25, phrases, nearest neighbours, reciprocal rank fusion."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators.index import Index

K1, B = 1.2, 0.75


def _idf(n: float, df):
    return F.log(1 + (F.lit(n) - df + 0.5) / (df + 0.5))


def _saturated(tf, dl, avgdl: float):
    return (K1 + 1) * tf / (tf + K1 * (1 - B + B * dl / F.lit(avgdl or 1.0)))


def _hits(index: Index, terms: list[str]) -> DataFrame:
    """The postings of the terms: the filter reaches the scan, whose files are sorted by term."""
    return index.alive(index.postings.filter(F.col("term").isin(terms)))


def bm25(index: Index, terms: list[str]) -> DataFrame:
    """(row_id, part, score) of rows with any of the terms, from their postings alone."""
    terms = list(dict.fromkeys(terms))
    hit = _hits(index, terms).select("term", "row_id", "part", F.col("tf").cast("double").alias("tf"), F.col("dl").cast("double").alias("dl"))
    df = hit.groupBy("term").agg(F.count("*").cast("double").alias("df"))  # a row a query word
    scored = hit.join(F.broadcast(df), "term").withColumn("s", _idf(index.n, F.col("df")) * _saturated(F.col("tf"), F.col("dl"), index.avgdl))
    return scored.groupBy("row_id", "part").agg(F.sum("s").alias("score"))


def phrase(index: Index, words: list[str], offsets: list[int] | None = None) -> DataFrame:
    """(row_id, part, dl, tf): how often the words stand at the given relative positions. From positions alone; a row's lists,
    one a query word, meet by row, and only their starts in common count."""
    offsets = offsets or list(range(len(words)))
    places = F.create_map(*[x for w in dict.fromkeys(words) for x in (F.lit(w), F.array(*[F.lit(o) for v, o in zip(words, offsets) if v == w]))])
    hit = _hits(index, list(dict.fromkeys(words))).select("row_id", "part", "dl", "positions", F.explode(F.element_at(places, F.col("term"))).alias("o"))
    starts = hit.select("row_id", "part", "dl", F.transform("positions", lambda p: p - F.col("o")).alias("starts"))
    met = starts.groupBy("row_id", "part", "dl").agg(F.collect_list("starts").alias("all")).filter(F.size("all") == len(words))
    tf = F.size(F.aggregate(F.slice("all", 2, max(1, len(words))), F.get("all", F.lit(0)), F.array_intersect))
    return met.select("row_id", "part", "dl", tf.cast("long").alias("tf")).filter("tf > 0")


def phrase_bm25(index: Index, words: list[str], offsets: list[int] | None = None) -> DataFrame:
    """(row_id, part, score): BM25 of the phrase's frequency, weighed by the sum of its words' IDF. One word: plain BM25."""
    df = _hits(index, list(dict.fromkeys(words))).groupBy("term").agg(F.count("*").cast("double").alias("df"))
    repeats = F.create_map(*[x for w in dict.fromkeys(words) for x in (F.lit(w), F.lit(float(words.count(w))))])
    weight = df.agg(F.sum(_idf(index.n, F.col("df")) * F.element_at(repeats, F.col("term"))).alias("weight"))  # one row
    found = phrase(index, words, offsets).join(F.broadcast(weight))
    return found.select("row_id", "part", (F.col("weight") * _saturated(F.col("tf").cast("double"), F.col("dl").cast("double"), index.avgdl)).alias("score"))


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best of (row_id, ..., score), scores rounded to 9 decimals so that ties are ties everywhere, then by row_id."""
    return scored.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "row_id").limit(k)


def knn(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """vectors (doc_id, embedding) -> the k nearest by cosine: (doc_id, similarity, closeness, rank). One TakeOrderedAndProject.
    closeness is 1 / (1 + distance). A vector of another dimension than the query's is an error."""
    q = F.array(*[F.lit(float(x)) for x in query])
    wrong = F.raise_error(F.concat(F.lit(f"vector dimension mismatch: expected {len(query)}, got "), F.size("embedding").cast("string"))).cast("double")
    sim = F.when(F.size("embedding") != len(query), wrong).otherwise(T.cosine(F.col("embedding"), q))
    best = vectors.select("doc_id", sim.alias("similarity")).orderBy(F.desc("similarity"), "doc_id").limit(k)
    return best.select("doc_id", "similarity", (1 / (2 - F.col("similarity"))).alias("closeness"), F.row_number().over(Window.orderBy(F.desc("similarity"), "doc_id")).cast("long").alias("rank"))


NO_ID = -(1 << 63)


def _packed(batches):
    """(id, vector) rows -> rows (ids, unit vectors as bytes) of up to 1,024 vectors. As in `cosine`, vectors that are null,
    zero or hold a null are like nothing: they stay as zeros. A block of nulls alone has no bytes."""
    for b in batches:
        for lo in range(0, b.num_rows, 1024):
            ids, vs = (c[lo : lo + 1024].to_pylist() for c in b.columns)
            size = max(len(v or ()) for v in vs)
            m = np.array([v if v and None not in v else [0.0] * size for v in vs], np.float64).reshape(len(vs), size)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            m = m / np.where(norm > 0, norm, 1)
            ids = [NO_ID if i is None else i for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary())], ["ids", "m"])


def knn_many(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """vectors and queries (doc_id, embedding) -> (query_id, doc_id, similarity, rank): for every query the k nearest of
    all vectors by cosine, ties (9 decimals) by doc_id. Blocks of queries meet blocks of vectors as one matrix product each,
    which puts out k rows a query at most; only these are shuffled."""
    def best(batches):
        for b in batches:
            for r in b.to_pylist():
                ids, sims = np.array(r["ids"], np.int64), np.zeros((len(r["qids"]), len(r["ids"])))
                if r["q"] and r["m"]:
                    q, v = (np.frombuffer(r[c]).reshape(len(r[i]), -1) for c, i in (("q", "qids"), ("m", "ids")))
                    sims = np.round(q @ v.T, 9)
                for n, row in zip(r["qids"], sims):
                    top = np.lexsort((ids, -row))[:k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), n, np.int64)), pa.array(ids[top], mask=ids[top] == NO_ID), pa.array(row[top])], ["query_id", "doc_id", "similarity"])
    kind = "ids array<long>, m binary"
    ask = queries.select("doc_id", "embedding").filter("doc_id IS NOT NULL").distinct().mapInArrow(_packed, kind).select(F.col("ids").alias("qids"), F.col("m").alias("q"))
    part = vectors.select("doc_id", "embedding").mapInArrow(_packed, kind).crossJoin(ask).mapInArrow(best, "query_id long, doc_id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id")
    return part.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def rrf(text_hits: DataFrame, vector_hits: DataFrame, text_weight: float = 0.5, vector_weight: float = 0.5, k: int = 60) -> DataFrame:
    """Lists (doc_id, rank) -> (doc_id, score, match_type): weighted reciprocal rank fusion in one aggregate."""
    rows = text_hits.select("doc_id", (text_weight / (k + F.col("rank"))).alias("t"), F.lit(0.0).alias("v")).unionByName(
        vector_hits.select("doc_id", F.lit(0.0).alias("t"), (vector_weight / (k + F.col("rank"))).alias("v")))
    g = rows.groupBy("doc_id").agg(F.min_by("t", F.when(F.col("t") > 0, F.col("t"))).alias("t"), F.max("v").alias("v"))
    g = g.select("doc_id", F.coalesce("t", F.lit(0.0)).alias("t"), "v")
    kind = F.when((F.col("t") > 0) & (F.col("v") > 0), "Hybrid").when(F.col("v") > 0, "Semantic").otherwise("Text")
    return g.select("doc_id", (F.col("t") + F.col("v")).alias("score"), kind.alias("match_type"))
