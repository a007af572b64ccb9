"""Chat formatting by quotation linking, in built-in functions only."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

MARK = r"^(?:[\x20\t]*>)+"


def _plain(c):
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def _hash(c):
    return F.sha2(_plain(c), 256)


def _units(c):
    """The whole, its paragraphs and its lines."""
    return F.filter(F.array_distinct(F.concat(F.array(c), F.split(c, r"\n\s*\n"), F.split(c, r"\n"))), lambda u: F.rlike(u, F.lit(r"\S")))


def _runs(m: DataFrame) -> DataFrame:
    """m with `lines` (array<struct<level, body>>) -> plus `runs`: maximal runs of lines of one level, joined. Linear in the lines."""
    m = m.withColumn("lv", F.transform("lines", lambda x: x["level"]))
    # one comparison more than lines: the last one, with nothing, marks the end
    m = m.withColumn("turns", F.zip_with("lv", F.concat(F.array(F.lit(-1)), F.col("lv")), lambda a, b: F.coalesce(a != b, F.lit(True))))
    m = m.withColumn("bounds", F.array_compact(F.transform("turns", lambda f, i: F.when(f, i))))
    k = F.size("bounds") - 1
    body = lambda s, e: F.array_join(F.transform(F.slice("lines", s + 1, e - s), lambda x: x["body"]), "\n")
    run = lambda s, e: F.struct(F.get("lv", s).alias("level"), body(s, e).alias("body"))
    return m.withColumn("runs", F.zip_with(F.slice("bounds", F.lit(1), k), F.slice("bounds", F.lit(2), k), run)).drop("lv", "turns", "bounds")


def reply_order(parent: DataFrame) -> DataFrame:
    """parent (conv_id, turn, reply_to), one row a reply, reply_to < turn -> (conv_id, turn, root, depth, position) of every
    message of the trees: position counts a thread's messages depth first, replies to one message by turn.

    Each tree becomes the list of its Euler tour (enter and exit of every message), ranked by pointer jumping: every
    round joins unique keys to unique keys, so neither a busy thread nor a popular message gathers, and a chain of n
    messages takes about log2(2 n) rounds. Siblings are chained within spans of 1,024 turns and then across spans."""
    edges = parent.select("conv_id", "turn", "reply_to", F.shiftright("turn", 10).alias("span"))
    within = Window.partitionBy("conv_id", "reply_to", "span").orderBy("turn")
    across = Window.partitionBy("conv_id", "reply_to").orderBy("span")
    spans = edges.groupBy("conv_id", "reply_to", "span").agg(F.min("turn").alias("head"))
    spans = spans.withColumn("next_head", F.lead("head").over(across)).drop("head")
    sib = edges.withColumn("nxt", F.lead("turn").over(within)).join(spans, ["conv_id", "reply_to", "span"])
    sib = sib.select("conv_id", "turn", "reply_to", F.coalesce("nxt", "next_head").alias("sibling"))
    child = parent.groupBy("conv_id", F.col("reply_to").alias("turn")).agg(F.min("turn").alias("child"))
    nodes = sib.join(child, ["conv_id", "turn"], "full")  # roots have children only
    tour = F.array(
        F.struct(F.lit(0).alias("kind"), F.coalesce("child", "turn").alias("to"), F.when(F.col("child").isNotNull(), 0).otherwise(1).alias("to_kind"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("d")),
        F.struct(F.lit(1).alias("kind"), F.coalesce("sibling", "reply_to").alias("to"), F.when(F.col("sibling").isNotNull(), 0).otherwise(1).alias("to_kind"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("d")))
    at = nodes.select("conv_id", "turn", F.explode(tour).alias("e")).select("conv_id", "turn", "e.*")
    at = materialise(at.withColumn("last", F.when(F.col("to").isNull(), F.col("turn"))), "tour")
    while at.filter("to IS NOT NULL").limit(1).count():
        ahead = at.select("conv_id", F.col("turn").alias("to"), F.col("kind").alias("to_kind"), F.col("to").alias("to2"), F.col("to_kind").alias("kind2"), F.col("n").alias("n2"), F.col("d").alias("d2"), F.col("last").alias("last2"))
        moved = at.filter("to IS NOT NULL").join(ahead, ["conv_id", "to", "to_kind"]).select(
            "conv_id", "turn", "kind", F.col("to2").alias("to"), F.col("kind2").alias("to_kind"), (F.col("n") + F.col("n2")).alias("n"), (F.col("d") + F.col("d2")).alias("d"), F.col("last2").alias("last"))
        at = materialise(moved.unionByName(at.filter("to IS NULL").select(*moved.columns)), "tour")
    enter = at.filter("kind = 0").select("conv_id", "turn", F.col("last").alias("root"), (-F.col("d")).cast("int").alias("depth"), "n")
    size = enter.filter("turn = root").select("conv_id", "root", F.col("n").alias("all"))
    return enter.join(size, ["conv_id", "root"]).select("conv_id", "turn", "root", "depth", (F.col("all") - F.col("n")).alias("position"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) -> one row per row: conv_id, turn, role, content (no quotes), n_quotes, levels
    (deepest), reply_to (turn), root (turn of the thread's first message), depth, position. A conversation without quotes
    in reply order is its rows by (root, position): an answer and all under it come before the next answer.

    A quoted passage is a run of lines of one level; the normalised hashes of its whole, paragraphs and lines meet those
    of whole messages, paragraphs and lines written at level 0 in the same conversation, each reduced to its first turn,
    so a hot passage is one row and a trimmed quote still links. reply_to is, at the lowest linked level, the earlier turn
    with the longest matched unit, then with the most matched characters, then the latest. Null text is empty; null ids
    never link; repeated rows stay and share a place; long texts take time in proportion; turns are integers; other
    columns are ignored. No rows give no rows. Conversations are never gathered.
    """
    lines = F.split(F.coalesce("text", F.lit("")), r"\r?\n", -1)
    parsed = F.transform(lines, lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARK, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, MARK + r"\x20?", "").alias("body")))
    m = _runs(messages.select("conv_id", "turn", "role", parsed.alias("lines")))
    own = F.trim(F.array_join(F.transform(F.filter("lines", lambda x: (x["level"] == 0) & ~F.rlike(x["body"], F.lit(r"^On .* wrote:\s*$"))), lambda x: x["body"]), "\n"), F.lit(" \n"))
    m = m.select("conv_id", "turn", "role", own.alias("content"), F.array_max(F.transform("lines", lambda x: x["level"])).alias("levels"),
                 F.filter("runs", lambda r: (r["level"] > 0) & F.rlike(r["body"], F.lit(r"\S"))).alias("quotes"))
    m = materialise(m, "messages")
    quotes = m.filter(F.size("quotes") > 0).select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.level", F.explode(_units(F.col("q.body"))).alias("u"))
    quotes = quotes.select("conv_id", "turn", "level", _hash(F.col("u")).alias("h"), F.length(_plain(F.col("u"))).alias("size")).distinct()
    asked = quotes.select("conv_id").distinct()
    first = (m.join(asked, "conv_id", "left_semi").select("conv_id", "turn", F.explode(_units(F.col("content"))).alias("u"))
             .groupBy("conv_id", _hash(F.col("u")).alias("h")).agg(F.min("turn").alias("origin")))
    hits = quotes.join(first, ["conv_id", "h"]).filter("origin < turn")
    hits = hits.groupBy("conv_id", "turn", "level", "origin").agg(F.max("size").alias("longest"), F.sum("size").alias("total"))
    parent = materialise(hits.groupBy("conv_id", "turn").agg(F.max_by("origin", F.struct(-F.col("level"), "longest", "total", "origin")).alias("reply_to")), "parents")
    tree = reply_order(parent)
    return m.join(tree.join(parent, ["conv_id", "turn"], "left"), ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "content", F.size("quotes").alias("n_quotes"), "levels", "reply_to",
        F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("position", F.lit(0)).alias("position"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
