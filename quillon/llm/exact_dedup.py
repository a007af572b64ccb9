"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, join_counted, marked, materialise


def normalised(text: str = "text"):
    """Each run of ASCII white space becomes one space; null counts as empty. Single spaces are left as they stand."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, digests: bool = True) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of docs.

    Only narrow rows travel. One scan notes length, prefix hash and digest; groups shrink by length, then by
    (length, prefix hash), on their counts alone, and only rows of surviving groups are grouped by full hash.
    digests=False hashes the full text of surviving groups only, in a second scan, and leaves text_sha256 null for the
    others, which meet no join at all. Every grouping is a partial aggregate, so a huge group of copies costs one row a
    task; its rows find their group in a broadcast table of at most 1,000 large groups.

    Null text equals empty text. Null ids sort after all others (a group of null ids alone keeps null, kept=true for
    all of them); repeated ids of one text are all marked kept, being the same id. Very long texts are hashed whole; no
    rows give no rows. Other columns are ignored, whatever their names.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("t"))
    sha = F.unhex(F.sha2("t", 256)).alias("sha")
    key = [F.octet_length("t").alias("len"), F.xxhash64(F.substring("t", 1, prefix)).alias("ph")]
    rid = F.xxhash64("len", "ph").alias("rid")
    narrow = materialise(base.select("doc_id", *key, *[sha] * digests), "digests" if digests else "lengths")
    by_prefix = narrow.groupBy("len", "ph").agg(F.count("*").alias("n"))
    by_len = by_prefix.groupBy("len").agg(F.sum("n").alias("all")).filter("all > 1").select("len")
    by_prefix = materialise(by_prefix.join(by_len, "len", "left_semi").filter("n > 1").select(rid).distinct(), "prefixes")
    rest = None
    if digests:
        full = marked(narrow.withColumn("rid", rid), by_prefix).filter("maybe").select("doc_id", "sha")
    else:
        rest = marked(narrow.withColumn("rid", rid), by_prefix).filter("NOT maybe").select("doc_id", F.lit(None).cast("binary").alias("sha"))
        full = materialise(marked(base.select("doc_id", "t", *key).withColumn("rid", rid), by_prefix).filter("maybe").select("doc_id", sha), "survivors")
        narrow = full
    groups = materialise(full.groupBy("sha").agg(F.min("doc_id").alias("keep"), F.count("*").alias("n")).filter("n > 1"), "groups")
    out = join_counted(narrow.select("doc_id", "sha"), groups, "sha", "n")
    if rest is not None:
        out = out.unionByName(rest.select("doc_id", "sha", F.lit(None).cast(groups.schema["keep"].dataType).alias("keep"), F.lit(None).cast("long").alias("n")))
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                      F.coalesce(F.col("doc_id") == keep, keep.isNull()).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY h)
SELECT doc_id, keep_id, n::BIGINT AS group_size, doc_id = keep_id AS kept, d.h AS text_sha256 FROM d JOIN g USING (h)
"""
