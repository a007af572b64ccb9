"""Document fingerprints from closed syncmers with their positions, in built-in functions only."""
from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents

K, S, LONG, SHOWN, BLOCK_ROWS, MOST_BLOCKS = 5, 2, 24, 64, 2000, 1 << 17
WS = r"\x20\x09-\x0D"
#: words of up to LONG characters whole, longer ones (no spaces, encoded data) as single characters
UNIT = rf"(?<![^{WS}])[^{WS}]{{1,{LONG}}}(?![^{WS}])|[^{WS}]"


def with_anchors(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Adds array<struct<h bigint, p int>> `out`: every closed syncmer of the text with its place.

    A k-mer of K units (words; single characters in words of over LONG characters) is chosen if its least inner S-unit
    substring is the first or the last one, which depends on the k-mer alone. Fewer than K units: one anchor of them
    all at 0; none: empty."""
    w, u, h = (f"__{x}_{out}" for x in "wuh")
    low = F.lower(F.col(text_col))
    df = df.withColumn(w, F.filter(F.split(low, f"[{WS}]+"), lambda x: x != ""))
    df = df.withColumn(u, F.when(F.exists(w, lambda x: F.char_length(x) > LONG), F.regexp_extract_all(low, F.lit(UNIT), F.lit(0))).otherwise(F.col(w)))
    n = F.size(u)
    at = lambda c, i: F.get(F.col(c), i)
    df = df.withColumn(h, F.when(n >= K, F.transform(F.sequence(F.lit(0), n - S), lambda i: F.xxhash64(at(u, i), at(u, i + 1)))))
    inner = range(1, K - S)

    def closed(i):
        edge = F.least(at(h, i), at(h, i + (K - S)))
        rest = [at(h, i + j) for j in inner]
        return F.when(edge <= (F.least(*rest) if len(rest) > 1 else rest[0]), F.struct(F.xxhash64(*[at(h, i + j) for j in range(K - S + 1)]).alias("h"), i.cast("int").alias("p")))

    some = F.filter(F.transform(F.sequence(F.lit(0), n - K), closed), lambda x: x.isNotNull())
    few = F.when(n > 0, F.array(F.struct(F.xxhash64(F.array_join(u, " ")).alias("h"), F.lit(0).alias("p")))).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))
    return df.withColumn(out, F.when(n >= K, some).otherwise(few)).drop(w, u, h)


def links(anchors):
    """The distinct links of a fingerprint: each anchor with the next one and the distance to it (the last one alone).
    Two texts share a link only where two anchors stand at the same distance, wherever in the texts that is."""
    after = F.slice(anchors, F.lit(2), F.greatest(F.size(anchors), F.lit(1)))
    return F.array_distinct(F.zip_with(anchors, after, lambda a, b: F.xxhash64(a["h"], b["h"], b["p"] - a["p"])))


def likeness(a, b):
    """Jaccard likeness of two whole sets of links, 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / union)


def as_text(anchors, linked):
    """Hex: a 64-bit digest of all anchors and places, then the SHOWN least links (32 bits each), as keys for an index."""
    least = F.slice(F.array_sort(F.transform(linked, lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))), 1, SHOWN)
    digest = F.lpad(F.lower(F.hex(F.xxhash64(anchors))), 16, "0")
    return F.concat(digest, F.array_join(F.transform(least, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""))


def _blocks(d: DataFrame, block_rows: int) -> DataFrame:
    """d (doc_id, t) with `block`: ranges of ids of about block_rows rows, 0 for null ids.

    Cuts come from a hash sample of about 16 distinct ids a block, so at most 16 * MOST_BLOCKS ids reach the driver;
    they only balance the work. They are a literal of two levels: a lookup takes about 2 * sqrt(blocks) steps."""
    n = d.count()
    blocks = max(1, min(MOST_BLOCKS, n // block_rows))
    step = max(1, n // (16 * blocks))
    ids = [] if blocks == 1 else sorted(int(r[0]) for r in d.filter(f"doc_id IS NOT NULL AND pmod(xxhash64(doc_id), {step}) = 0").select("doc_id").distinct().collect())
    cuts = ids[:: max(1, len(ids) // blocks)]
    wide = max(1, math.isqrt(len(cuts)))
    tiers = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    const = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)  # noqa: E731  (folded to a literal)
    d = d.withColumn("tier", F.size(F.filter(const([x[0] for x in tiers], "array<bigint>"), lambda c: c < F.col("doc_id"))))
    inside = F.filter(F.get(const(tiers, "array<array<bigint>>"), F.col("tier") - 1), lambda c: c < F.col("doc_id"))
    block = F.when(F.col("doc_id").isNull(), 0).when(F.col("tier") == 0, 1).otherwise((F.col("tier") - 1) * wide + F.size(inside) + 1)
    return d.withColumn("block", block.cast("int")).drop("tier")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_anchors), one row per row.

    Rows are dealt by ranges of ids into blocks of about block_rows rows (beyond MOST_BLOCKS of them blocks grow, and
    sort on disk); a sentinel row with the following block's first text closes each block, so the next text is found
    within it. Texts are shuffled once; anchors are computed once for each text and each edited text, after that.
    Likenesses compare whole fingerprints; nothing is sampled. Null text is empty; ids are integers, null ids come
    last; rows with one id follow by descending text; fully equal rows are neighbours. No rows give no rows.
    Very long texts cost in proportion; other columns are ignored, whatever their names.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = _blocks(d, block_rows)
    down = Window.orderBy(F.desc("block"))
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = d.groupBy("block").agg(F.max("doc_id").alias("top"))  # narrow: MOST_BLOCKS + 1 rows at most
    tops = tops.select(F.col("block").alias("closes"), F.coalesce(F.lead(F.struct("block", "top")).over(down), F.first(F.struct("block", "top")).over(whole)).alias("f"))
    ends = d.join(F.broadcast(tops), (F.col("block") == F.col("f.block")) & F.col("doc_id").eqNullSafe(F.col("f.top"))).groupBy(F.col("closes").alias("block")).agg(F.max("t").alias("t"))
    ends = ends.select(F.lit(None).cast(d.schema["doc_id"].dataType).alias("doc_id"), "t", "block", F.lit(1).alias("end"))
    both = d.withColumn("end", F.lit(0)).unionByName(ends).repartition("block").sortWithinPartitions("block", "end", F.desc_nulls_last("doc_id"), F.desc("t"))
    both = with_anchors(both, "t", "a").withColumn("l", links(F.col("a")))
    both = both.withColumn("fp", as_text(F.col("a"), F.col("l"))).withColumn("n_anchors", F.size("a").cast("long")).drop("a")
    w = Window.partitionBy("block").orderBy("end", F.desc_nulls_last("doc_id"), F.desc("t"))
    both = both.withColumn("nxt", F.lead(F.struct("t", "l")).over(w)).filter("end = 0")
    half = F.floor(F.char_length("t") / 2).cast("int")
    out = both.withColumn("edited", F.concat(F.substring(F.col("t"), F.lit(1), F.char_length("t") - half), F.substring(F.col("nxt.t"), F.lit(1), half)))
    out = with_anchors(out, "edited", "ea").withColumn("el", links(F.col("ea")))
    return out.select("doc_id", F.char_length("t").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.col("fp").alias("fingerprint"),
                      as_text(F.col("ea"), F.col("el")).alias("edited_fingerprint"), likeness(F.col("l"), F.col("el")).alias("near_edited"), likeness(F.col("l"), F.col("nxt.l")).alias("near_next"), "n_anchors")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(documents(spark, sf_dir))
