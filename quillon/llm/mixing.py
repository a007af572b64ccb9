"""Mixing sources to target weights by pivotal dependent rounding, in built-in functions only."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialise

#: units a group of fights holds; size classes an octave
CHUNK, FINE = 32, 4


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target): weights repeat over sources in code point order, null last; targets stop at
    most * size and the excess is reshared by weight. The windows run over one row a source, not over documents."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(most))
    # the level x solves sum(min(cap, w x)) = total; sources fill up in the order of cap / w
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = (per.withColumn("used", F.coalesce(F.sum("cap").over(fill), F.lit(0.0))).withColumn("w_used", F.coalesce(F.sum("w").over(fill), F.lit(0.0)))
           .withColumn("total", F.sum("source_size").over(whole) * F.lit(share)).withColumn("w_all", F.sum("w").over(whole)))
    level = (F.col("total") - F.col("used")) / (F.col("w_all") - F.col("w_used"))
    per = per.withColumn("x", F.when(level <= F.col("cap") / F.col("w"), level))
    per = per.withColumn("x", F.expr("min_by(x, CASE WHEN x IS NOT NULL THEN struct(used, w_used) END)").over(whole))
    return per.select("source", "source_size", F.coalesce(F.least("cap", F.col("w") * F.col("x")), "cap").cast("double").alias("target"))


def _fold(level: int, seed: int):
    """SQL that plays the units of xs against each other: entries (size, uid, p), result (done array<(uid, take)>, rest (uid, p,
    size)). A fight moves words from one unit to the other, up or dn, until one of the two is integral; the sum of p * size
    stays, and chance is such that every unit's expected p stays too."""
    u = f"(pmod(xxhash64(acc.uid, x.uid, {seed}, {level}), 1000003) + 0.5) / 1000003"
    up, dn = "least((1 - acc.p) * acc.size, x.p * x.size)", "least(acc.p * acc.size, (1 - x.p) * x.size)"
    gains = f"coalesce(({u}) * ({up} + {dn}) < {dn}, false)"
    kind = "array<struct<uid:bigint,take:int>>"
    acc_done = lambda take, p: f"named_struct('uid', x.uid, 'p', {p}, 'size', x.size, 'done', concat(acc.done, array(named_struct('uid', acc.uid, 'take', {take}))))"
    x_done = lambda take, p: f"named_struct('uid', acc.uid, 'p', {p}, 'size', acc.size, 'done', concat(acc.done, array(named_struct('uid', x.uid, 'take', {take}))))"
    return f"""aggregate(xs, named_struct('uid', cast(null as bigint), 'p', cast(0 as double), 'size', cast(0 as bigint), 'done', cast(array() as {kind})),
      (acc, x) -> CASE WHEN acc.uid IS NULL THEN named_struct('uid', x.uid, 'p', x.p, 'size', x.size, 'done', acc.done)
        WHEN {gains} AND (1 - acc.p) * acc.size <= x.p * x.size THEN {acc_done(1, f"x.p - {up} / x.size")}
        WHEN {gains} THEN {x_done(0, f"acc.p + {up} / acc.size")}
        WHEN acc.p * acc.size <= (1 - x.p) * x.size THEN {acc_done(0, f"x.p + {dn} / x.size")}
        ELSE {x_done(1, f"acc.p - {dn} / acc.size")} END)"""


def mix_sources(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 42, id_col="doc_id", text_col="text", source_col="source", keys: bool = False) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken), one row per row of docs.

    A document's expected copies are its source's target / size; the whole part is certain, the fraction is rounded by
    pivotal fights between documents of one source and like size, in groups of about CHUNK rows; fights conserve words, so
    only the last undecided unit of a source departs from the target, by less than its own size. Each group leaves one
    such unit, which goes on to the next level of a reduction tree until one is left a source, rounded to the nearer side. Groups are cut by hash from counts, so a hot source is many groups.

    Null text has size 0, null source is a source of its own; ids may repeat or be null (units are keyed by id, text
    and a hash of both; fully equal rows share a decision). Empty input gives no rows. Other columns are ignored.
    keys=True adds uid, the hash of id, text and source that decisions go by.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    units = materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"),
                                    F.xxhash64(F.col(id_col), F.col(text_col), F.col(source_col)).alias("uid")), "sizes")
    targets = materialise(source_targets(units, weights, share, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = targets.select("source", "source_size", "target", F.floor(rate).alias("base"), (rate - F.floor(rate)).alias("p"))
    klass = F.floor(F.log2(F.col("size") + 1) * FINE).cast("int")
    shape = units.groupBy("source", klass.alias("klass")).agg(F.approx_count_distinct("uid").alias("n"))
    same = lambda x, y: x["source"].eqNullSafe(y["source"])
    live = units.select("uid", "source", "size", klass.alias("klass")).distinct()
    r2 = rates.select(F.col("source").alias("src"), "p")
    live = live.join(r2, live["source"].eqNullSafe(r2["src"])).drop("src").filter("p > 0 and size > 0")
    shape = shape.select(F.col("source").alias("src"), F.col("klass").alias("k"), "n")
    live = live.join(shape, live["source"].eqNullSafe(shape["src"]) & (live["klass"] == shape["k"]))
    live = live.select("uid", "source", "klass", "size", "p", F.greatest(F.lit(1), F.ceil(F.col("n") / CHUNK)).cast("long").alias("parts"))
    live = live.withColumn("slot", F.pmod(F.xxhash64("uid", F.lit(seed)), F.col("parts")))
    largest = shape.agg(F.max("n")).first()[0] or 0
    levels = 1 + max(0, math.ceil(math.log(max(1, largest / CHUNK), CHUNK))) + 1
    decided = None
    for level in range(levels + 1):
        group = ["source", "klass", "slot", "parts"] if level < levels else ["source"]
        xs = F.array_sort(F.collect_list(F.struct("size", "uid", "p"))).alias("xs")
        folded = materialise(live.groupBy(*group).agg(xs).withColumn("f", F.expr(_fold(level, seed))).drop("xs"), f"fold{level}")
        done = folded.select(F.explode("f.done").alias("d")).select("d.uid", "d.take")
        decided = done if decided is None else decided.unionByName(done)
        rest = folded.select(*[c for c in ("source", "klass", "slot", "parts") if c in folded.columns], F.col("f.size").alias("size"), F.col("f.uid").alias("uid"), F.col("f.p").alias("p"))
        if level < levels:
            up = F.greatest(F.lit(1), F.ceil(F.col("parts") / CHUNK)).cast("long")
            live = rest.withColumn("slot", F.pmod("slot", up)).withColumn("parts", up)
        else:
            decided = decided.unionByName(rest.select("uid", (F.col("p") > 0.5).cast("int").alias("take")))
    out = units.join(rates, same(units, rates)).drop(rates["source"]).join(decided, "uid", "left")
    copies = (F.col("base") + F.coalesce("take", F.lit(0))).cast("int")
    return out.select(*["uid"] * keys, "doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")
