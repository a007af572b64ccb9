"""Packing: optimal length buckets by dynamic programming over the global histogram, token-budget batches inside."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialise


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` length buckets with the least padding sum(count * (bound - length)); exact.

    The cost has the quadrangle inequality, so each layer is solved by divide and conquer in O(n log n) numpy steps."""
    order = np.argsort(lengths)
    x, c = np.array(lengths, float)[order], np.array(counts, float)[order]
    n, k = len(x), min(buckets, len(x))
    if not n:
        return []
    cum, mass = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])
    best, back = np.concatenate([[0], np.full(n, np.inf)]), []
    for _ in range(k):
        new, arg = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        new[0] = 0
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            cost = best[i] + (cum[j] - cum[i]) * x[j - 1] - (mass[j] - mass[i])
            at = int(np.argmin(cost))
            new[j], arg[j] = cost[at], i[at]
            todo += [(lo, j - 1, a, i[at]), (j + 1, hi, i[at], b)]
        best = new
        back.append(arg)
    out, j = [], n
    for arg in reversed(back):
        if j == 0:
            break
        out.append(int(x[j - 1]))
        j = arg[j]
    return sorted(set(out))


def pack(docs: DataFrame, buckets: int = 12, budget: int = 32_768, id_col: str = "doc_id", text_col: str = "text", rows_a_shard: int = 20_000) -> DataFrame:
    """(doc_id, n_tokens, bucket, padded, batch), one row per row of docs; tokens are words between ASCII white space.

    The histogram that comes to the driver has one row a distinct length, so the longest document bounds it. A bucket's
    batches hold max(1, floor(budget / bound)) rows in the order of (id hash shard, length, id, hash of id and text), so no batch exceeds the
    budget except a single document longer than it. Shards of a bucket are sized from its counts; only per-shard counts
    meet in the offset window. Null or empty texts have 0 tokens; repeated ids are rows of their own, and only
    fully equal ones may swap places between runs; other columns are ignored; no rows give no rows.
    """
    n = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = materialise(docs.select(F.col(id_col).alias("doc_id"), n.alias("n_tokens"), F.xxhash64(id_col, text_col).alias("h")), "packing")
    hist = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()
    total = sum(r["n"] for r in hist)
    bounds = boundaries([r["n_tokens"] for r in hist], [r["n"] for r in hist], buckets)
    bucket = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < F.col("n_tokens"))) if bounds else F.lit(0)
    shards = max(1, -(-total // rows_a_shard)) if total > rows_a_shard else 8
    r = rows.withColumn("bucket", bucket).withColumn("shard", F.pmod("h", F.lit(shards)))
    per = r.groupBy("bucket", "shard").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("bucket", "shard", before.alias("before"))
    r = r.withColumn("rn", F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("n_tokens", "doc_id", "h")))
    r = r.join(per, ["bucket", "shard"])
    bound = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds or [0]]), F.col("bucket") + 1)
    cap = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), bound)))
    return r.select("doc_id", "n_tokens", F.col("bucket").cast("int").alias("bucket"), bound.alias("padded"),
                    F.floor((F.col("before") + F.col("rn") - 1) / cap).cast("long").alias("batch"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
