"""Helpers shared by the operators: scratch tables in the shared folder, connected components."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; a temporary folder only in local mode with that unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables; for callers, once the results that read them are written."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{spark.sparkContext.applicationId}")
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def marked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows (rid long, ...) with `maybe`: false only if rid is not among keys (rid long, a written table), true for all keys
    and a few others. A bitmap of about eight bits a key is broadcast, 64 kB to 16 MB whatever the number of keys; beyond
    16 million keys more of the others pass, which costs time only."""
    bits = 1 << min(27, max(19, (8 * keys.count()).bit_length()))
    bit = lambda c: F.pmod(c, F.lit(bits))
    maps = keys.select(bit(F.col("rid")).alias("p")).groupBy(F.floor(F.col("p") / 32768).alias("bucket")).agg(F.bitmap_construct_agg((F.col("p") % 32768).cast("long")).alias("bits"))
    d = rows.withColumn("p", bit(F.col("rid"))).withColumn("bucket", F.floor(F.col("p") / 32768))
    d = d.join(F.broadcast(maps), "bucket", "left")
    byte = F.conv(F.hex(F.substring("bits", F.floor((F.col("p") % 32768) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return d.withColumn("maybe", F.coalesce(F.getbit(byte, (F.col("p") % 8).cast("int")) == 1, F.lit(False))).drop("p", "bucket", "bits")


LARGE = 1000


def join_counted(rows: DataFrame, groups: DataFrame, key: str | list[str], count: str, how: str = "left") -> DataFrame:
    """rows join groups (key unique, never null, a written table whose `count` column counts rows of each key), left or inner.

    Groups that hold more than a thousandth of all grouped rows are fewer than LARGE, whatever the data, and are broadcast,
    so their rows stay where they are; the others' rows are shuffled, at most a thousandth of them for one key."""
    keys = [key] if isinstance(key, str) else key
    total = groups.agg(F.sum(count)).first()[0] or 0
    big = F.col(count) * LARGE > total
    hot, cold = F.broadcast(groups.filter(big)), groups.filter(~big)
    near = rows.join(hot, keys)
    far = rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys, how)
    return near.unionByName(far)


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b long, a <> b) -> (node, label): label is the smallest node reachable.

    Minimum labels spread to neighbours and then jump to their label's label, so a path of n nodes takes
    O(log n) rounds; each round is a partial aggregate and two joins on narrow rows. No edges: no rows.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        hooked = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        # the old label's node also learns the lower label, so whole trees hook at once
        hooks = hooked.filter("low < label").groupBy(F.col("label").alias("node")).agg(F.min("low").alias("hook"))
        new = (hooked.join(hooks, "node", "left").select("node", F.col("label").alias("old"), F.least("low", F.coalesce("hook", "low")).alias("label"))
               .join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")))
        new = materialise(new, "labels")
        labels = new.select("node", "label")
        if not new.filter("label < old").limit(1).count():
            return labels
