"""SimHash near-dedup: fingerprints, pigeonring candidates, exact Hamming check, components."""
from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, documents, marked, materialise

SEGMENTS, WIDTH = 4, 16
HOT = 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Lower-case A-Z, ASCII-white-space words, word shingles with repeats, XXH64 seed 42; a bit is 1 if set in over half."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    data = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if n == 1:
        hashes = np.array([h(data, 42)], dtype=np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        starts = [0, *ends[: n - 1]]
        hashes = np.fromiter((h(data[s : e - 1], 42) for s, e in zip(starts, ends[shingle - 1 :])), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 8192):  # a very long text is counted in blocks
        counts += np.unpackbits(hashes[i : i + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp long): the unsigned fingerprint's bits as a signed long."""
    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _segment(c, i: int):
    return F.shiftrightunsigned(c, 64 - WIDTH * (i + 1)).bitwiseAND(F.lit(0xFFFF).cast("long"))


def links(fps: DataFrame, budget: int = 2) -> DataFrame:
    """fps (fp long, distinct) -> pairs (a, b) that connect exactly the fingerprints at budget (2) or fewer bits.

    Four segments of 16 bits form a ring. At most two differing bits leave two segments alike; each choice of two is a
    32-bit key. A pair that shares a key must have a start on the ring from which the first l segments differ in at
    most l * 2 / 4 bits for l = 1..4 (a pigeonring chain); only then is the whole Hamming distance counted. Keys with
    more than HOT fingerprints take an exact linear way: fingerprints at two or fewer bits share a value in their
    balls of radius 1, so each links to its 65 ball values, which serve as nodes; no pairs are formed there.
    """
    if budget != 2:
        raise ValueError("the pigeonring keys here are laid out for a budget of 2 bits")
    pairs = [(i, j) for i in range(SEGMENTS) for j in range(i + 1, SEGMENTS)]
    keys = F.array(*[F.xxhash64(F.lit(k), _segment(F.col("fp"), i), _segment(F.col("fp"), j)) for k, (i, j) in enumerate(pairs)])
    keyed = fps.select("fp", F.explode(keys).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = materialise(keyed.join(sizes, "key"), "keys")
    small = keyed.filter(F.col("n") <= HOT)
    a, b = small.select("key", F.col("fp").alias("a")), small.select("key", F.col("fp").alias("b"))
    diffs = [F.bit_count(_segment(F.col("a").bitwiseXOR(F.col("b")), i)) for i in range(SEGMENTS)]
    chains = []
    for s in range(SEGMENTS):
        ring = [diffs[(s + i) % SEGMENTS] for i in range(SEGMENTS)]
        chains.append(reduce(lambda x, y: x & y, [reduce(lambda x, y: x + y, ring[:n]) * SEGMENTS <= n * budget for n in range(1, SEGMENTS + 1)]))
    chain = reduce(lambda x, y: x | y, chains)
    near = (a.join(b, "key").filter(F.col("a") < F.col("b")).filter(chain)
            .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= budget).select("a", "b", F.lit(False).alias("ball")))
    ball = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")) for i in range(64)])
    hot = keyed.filter(F.col("n") > HOT).select("fp").distinct().select(F.col("fp").alias("a"), F.explode(ball).alias("b"), F.lit(True).alias("ball"))
    return near.unionByName(hot)


def nearest_pivots(prints: DataFrame, budget: int = 6, segments: int = 10) -> DataFrame:
    """prints (fp long, sig long, n long) -> pairs (a, b, na, nb) at budget or fewer differing bits, at most one row a text b.

    Budgets too wide for links: budget differing bits leave segments - budget segments alike, each choice of so many is a
    key. Each text meets the least text of every key (the pivot) by chain and Hamming distance as in links, and keeps the
    nearest, so a family of m near copies makes less than m rows. Pairs of two texts that are no pivots are not listed.
    prints is read three times and should be a written table.
    """
    prints = prints.repartition(1 + prints.count() // 8192)  # a row makes 210 keys
    cuts = [64 * i // segments for i in range(segments + 1)]
    ones = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:])]
    signed = lambda x: F.lit(x - (1 << 64 if x >> 63 else 0)).cast("long")
    masks = F.array(*[signed(sum(pick)) for pick in combinations(ones, segments - budget)])
    keyed = prints.select(F.explode(masks).alias("mask"), "fp", "sig", "n").select(F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp", "sig", "n")
    shared = materialise(keyed.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select(F.col("key").alias("rid")), "alike")
    live = marked(keyed.withColumn("rid", F.col("key")), shared).filter("maybe").select("key", "fp", "sig", "n")
    live = materialise(live.join(shared.withColumnRenamed("rid", "key"), "key"), "keys")
    pivots = live.groupBy("key").agg(F.min(F.struct("sig", "n", "fp")).alias("p")).select("key", F.col("p.sig").alias("a"), F.col("p.n").alias("na"), F.col("p.fp").alias("fa"))
    met = live.select("key", "fp", F.col("sig").alias("b"), F.col("n").alias("nb")).join(pivots, "key").filter("a <> b").select("a", "b", "na", "nb", "fp", "fa").distinct()
    other = F.col("fp").bitwiseXOR(F.col("fa"))
    # a chain holds l * budget / segments differing bits at most in its first l segments, for every l
    spare = [F.bit_count(other.bitwiseAND(signed(x))) * segments - budget for x in ones]
    met = met.withColumn("spare", F.array(*spare, *spare[:-1]))
    chain = F.expr(f"""exists(sequence(1, {segments}), s -> aggregate(slice(spare, s, {segments}), named_struct('sum', 0, 'ok', true),
      (acc, x) -> named_struct('sum', acc.sum + x, 'ok', acc.ok AND acc.sum + x <= 0), acc -> acc.ok))""")
    near = met.filter(chain).withColumn("bits", F.bit_count(other)).filter(F.col("bits") <= budget)
    return near.groupBy("b", "nb").agg(F.min(F.struct("bits", "a", "na")).alias("p")).select("p.a", "b", "p.na", "nb")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; component_id is the smallest id reachable over links.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows give repeated rows. Null ids are
    kept in the result; a component of null ids alone has a null component_id. Other columns are ignored.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    lowest = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "lowest")
    # nodes: 2 * rank-free ids would need a lookup, so fingerprints themselves are nodes; ball values are hashed apart
    e = links(lowest.select("fp"))
    b = F.when(F.col("ball"), F.xxhash64(F.lit("ball"), F.col("b"))).otherwise(F.col("b"))
    comp = connected_components(e.select("a", b.alias("b")).filter("a <> b"))
    labelled = materialise(lowest.join(comp.select(F.col("node").alias("fp"), "label"), "fp", "left").select("fp", "low", F.coalesce("label", "fp").alias("label")), "labelled")
    least = labelled.groupBy("label").agg(F.min("low").alias("component_id"))
    final = labelled.join(least, "label").select("fp", "component_id")
    return fps.join(final, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(documents(spark, sf_dir))
