"""Search over an Index: gated and exact modes, regular expressions, phrases fused with nearest neighbours."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.config import SearchConfig
from quillon.functions import text as T
from quillon.functions.regex_dialect import to_java, words_of
from quillon.operators import rank
from quillon.operators.index import Index

CONFIG = SearchConfig()


def effective_limit(limit: int | None, config: SearchConfig = CONFIG) -> int:
    return max(0, min(limit if limit is not None else config.default_limit, config.max_limit))


def path_filter(extensions=(), paths=()):
    out = F.lit(True)
    if extensions:
        out = out & F.lower(T.extension(F.col("path"))).isin([e.lower().lstrip(".") for e in extensions])
    if paths:
        out = out & reduce(lambda a, b: a | b, [F.col("path").contains(p) for p in paths])
    return out


def _finish(hits: DataFrame, snip, limit: int, extra=()) -> DataFrame:
    """hits (rows with content and score) -> at most `limit` results. match_line is the first matching line, null if no line
    matches by itself."""
    s = hits.orderBy(F.desc("score"), "row_id").limit(limit).withColumn("s", snip)
    start = F.col("line_start") + F.col("s.offset")
    is_chunk = F.col("chunk_id") != "" if "chunk_id" in hits.columns else F.lit(False)
    return s.select("doc_id", "row_id", "path", F.round("score", 6).alias("score"), start.cast("long").alias("line_start"),
                    (start + F.greatest(F.col("s.count") - 1, F.lit(0))).cast("long").alias("line_end"), F.col("s.text").alias("snippet"),
                    is_chunk.alias("is_chunk"), (F.col("line_start") + F.col("s.line")).cast("long").alias("match_line"), *extra)


def _none(index: Index) -> DataFrame:
    return index.segments[0].filter("false").withColumn("score", F.lit(0.0))


def _gate(index: Index, words: list[str], cut: int) -> DataFrame:
    """The best `cut` rows by BM25 with their content; scores are divided by the best candidate's."""
    top = rank.top(rank.bm25(index, words), cut)
    best = F.max("score").over(Window.partitionBy())  # over `cut` narrow rows
    return index.fetch(top.withColumn("score", F.when(best > 0, F.col("score") / best).otherwise(0.0)))


def search(index: Index, query: str, limit: int | None = None, mode: str = "gated", extensions=(), paths=(), config: SearchConfig = CONFIG) -> DataFrame:
    n = effective_limit(limit, config)
    fetch = min(2 * n, config.max_limit) if extensions or paths else n
    words = T.terms_of(query)
    snip = T.literal_snippet(F.col("content"), query)
    if mode == "exact":
        hits = index.docs.filter(T.contains_ci(F.col("content"), query)).filter(path_filter(extensions, paths)).select("row_id", "part")
        scored = hits.join(rank.bm25(index, words), ["row_id", "part"], "left").fillna(0.0, ["score"]) if words else hits.withColumn("score", F.lit(0.0))
        return _finish(index.fetch(rank.top(scored, n)), snip, n)
    if not words:
        return _finish(_none(index), snip, n)
    hits = _gate(index, words, 10 * fetch).filter(T.contains_ci(F.col("content"), query))
    hits = hits.orderBy(F.desc("score"), "row_id").limit(fetch).filter(path_filter(extensions, paths))
    return _finish(hits, snip, n)


def search_regex(index: Index, pattern: str, limit: int | None = None, mode: str = "gated", extensions=(), paths=(), config: SearchConfig = CONFIG) -> DataFrame:
    n = effective_limit(limit, config)
    java = to_java(pattern, multiline=mode == "exact")
    words = words_of(pattern)
    fits = F.rlike("content", F.lit(java)) & path_filter(extensions, paths)
    if mode == "exact":
        hits = index.fetch(index.docs.filter(fits).select("row_id", "part", F.lit(1.0).alias("score")).orderBy("row_id").limit(n))
    elif words:
        hits = _gate(index, words, 20 * n).filter(fits)
    else:
        first = index.docs.select("row_id", "part", F.lit(1.0).alias("score")).orderBy("row_id").limit(50 * n)  # narrow rows
        hits = index.fetch(first).filter(fits)
    return _finish(hits, T.regex_snippet(F.col("content"), to_java(pattern)), n)


def query_tokens(spark, query: str) -> list[tuple[int, str]]:
    """(position, term) of the query by the index's own tokenizer (folded to a constant, no job)."""
    return [(t.pos, t.term) for t in spark.range(1).select(T.tokens(F.lit(query)).alias("t")).first().t]


def phrase_hits(index: Index, query: str, k: int) -> DataFrame:
    """(row_id, part, score, rank): the k best rows by phrase BM25 of the query's tokens at their relative positions."""
    toks = query_tokens(index.postings.sparkSession, query)
    if not toks:
        return _none(index).select("row_id", "part", "score", F.lit(0).cast("long").alias("rank"))
    first = toks[0][0]
    best = rank.top(rank.phrase_bm25(index, [t for _, t in toks], [p - first for p, _ in toks]), k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "row_id")).cast("long"))


def search_hybrid(index: Index, vectors: DataFrame, query: str, query_vector, limit: int | None = None, extensions=(), paths=(), config: SearchConfig = CONFIG) -> DataFrame:
    """Phrase BM25 and nearest neighbours, 3 * limit rows each, fused by rank. Equal contents share a doc_id and stand as the
    first of their paths that passes the filters; neighbours whose document is gone are dropped."""
    n = effective_limit(limit, config)
    hits = phrase_hits(index, query, 3 * n)
    text = index.fetch(hits, "doc_id").select("doc_id", "rank")
    near = rank.knn(vectors, query_vector, 3 * n).select("doc_id", "rank")
    fused = rank.rrf(text, near, config.bm25_weight, config.vector_weight)
    named = index.docs.select("doc_id", "row_id", "part", "path").filter(path_filter(extensions, paths)).join(F.broadcast(fused), "doc_id")
    one = named.groupBy("doc_id", "score", "match_type").agg(F.min(F.struct("path", "row_id", "part")).alias("r"))
    best = one.select("r.row_id", "r.part", "score", "match_type").orderBy(F.desc("score"), "row_id").limit(n)
    return _finish(index.fetch(best), T.literal_snippet(F.col("content"), query), n, ["match_type"])
