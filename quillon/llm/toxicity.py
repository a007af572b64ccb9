"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length, with exception phrases."""
from __future__ import annotations

import math
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

FOLD = {ord(a): b for a, b in zip("аеорсухіјԁɡո０１２３４５６７８９", "aeopcyxijdgn0123456789")}
DIGITS = str.maketrans("01345789", "oieastbg")
SIGNS = str.maketrans("@$!|", "asii")
#: signs that stand for letters: @ and $ before a letter, ! and | inside a word; elsewhere they are punctuation
SIGN = re.compile(r"[@$]+(?=[^\W\d_])|(?<=[^\W\d_])[@$!|]+(?=[^\W_])")
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "stupid question", "pond scum", "sore loser")
#: The bound of the labelled rows that are read (a parameter of fit), and what an entry or phrase must show.
MAX_LABELLED, LEAST_DOCS, LEAST_ODDS, PREFIX = 40_000, 3, 2.5, 5


def fold(text: str) -> str:
    """Lower case; homoglyphs to Latin; signs and digits inside words with letters to the letters they stand for; the rest to spaces."""
    text = text.lower().translate(FOLD)
    if "@" in text or "$" in text or "!" in text or "|" in text:
        text = SIGN.sub(lambda m: m[0].translate(SIGNS), text)
    if any(c in text for c in "01345789"):
        text = " ".join(w.translate(DIGITS) if not w.isdigit() and any(c.isalpha() for c in w) else w for w in text.split())
    return " " + "".join(c if c.isalnum() else " " for c in text) + " " if not text.isalnum() else f" {text} "


def _entries(text: str) -> set[str]:
    words = set(fold(text).split())
    return {f" {w} " for w in words} | {f" {w[:PREFIX]}" for w in words if len(w) > PREFIX}


def _phrases(text: str, words: set[str]) -> set[str]:
    """Pairs of neighbouring words of which one is a whole-word entry."""
    ws = fold(text).split()
    return {f"{x} {y}" for x, y in zip(ws, ws[1:]) if x in words or y in words}


def _counted(data: DataFrame, parts) -> DataFrame:
    """data (text, toxic) -> (w, a, b): toxic and other rows that hold each part of parts(text)."""
    def run(batches):
        for b in batches:
            w, y = [], []
            for text, toxic in zip(b.column("text"), b.column("toxic").to_pylist()):
                e = parts(text.as_py() or "")
                w += e
                y += [toxic] * len(e)
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(y, pa.int32())], ["w", "y"])
    return data.select("text", "toxic").mapInArrow(run, "w string, y int").groupBy("w").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> dict[str, float | None]:
    """Entry -> weight, and exception phrase -> None, from labelled rows whose crc32(doc_id) mod 3 is not 1, at most
    max_labelled of them, lowest hash first.

    An entry is a whole word or the first five letters of a longer one; its weight is the smoothed log-odds of the
    label. All entries of at least LEAST_DOCS toxic rows and log-odds of LEAST_ODDS after one standard error are kept, so
    their number is bounded by the rows read. Pairs of an entry and a neighbour that LEAST_DOCS other rows and no toxic
    row hold become exceptions, beside the given ones. Null labels and ids are skipped; repeated labels count once (toxic
    wins); an empty or one-sided table gives an empty lexicon.
    """
    rows = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    rows = rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    data = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")  # at most max_labelled narrow rows
    n1, n0 = (float(x or 0) for x in data.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / F.lit(n1 + 1)) - F.log(b / F.lit(n0 + 1))
    top = _counted(data, _entries).filter(f"a >= {LEAST_DOCS}").withColumn("odds", odds).filter(F.col("odds") - F.sqrt(1 / a + 1 / b) >= LEAST_ODDS)
    model: dict[str, float | None] = {r["w"]: r["odds"] for r in top.select("w", "odds").collect()}
    words = {w.strip() for w in model if w.endswith(" ")}
    if words:
        safe = _counted(data, lambda t: _phrases(t, words)).filter(f"a = 0 AND b >= {LEAST_DOCS}").select("w").collect()
        model |= {r["w"]: None for r in safe}
    return model


def automaton(model: dict[str, float | None], exceptions=EXCEPTIONS):
    a = ahocorasick.Automaton()
    for w in (*exceptions, *(w for w, x in model.items() if x is None)):
        a.add_word(f" {w} ", (len(w) + 2, None))
    for w, x in model.items():
        if x is not None:
            a.add_word(w, (len(w), x))
    a.make_automaton()
    return a


def score_text(a, text: str | None) -> float:
    """1 - exp(-s): s sums the weights of matched words outside exception phrases, over a slow root of the length."""
    if not text or not len(a):
        return 0.0
    t = fold(text)
    found = [(end + 1 - n, end + 1, x) for end, (n, x) in a.iter(t)]
    safe = [(s, e) for s, e, x in found if x is None]
    best: dict[int, float] = {}
    for s, e, x in found:
        if x is not None and not any(p <= s and e <= q for p, q in safe):
            best[s] = max(best.get(s, 0.0), x)
    words = t.count(" ")
    return 1 - math.exp(-sum(best.values()) / (5.0 * math.sqrt(1 + words / 1000)))


def score(docs: DataFrame, model: dict[str, float | None], id_col: str = "doc_id", text_col: str = "text", keep=("doc_id",), threshold: float = 0.7) -> DataFrame:
    """Columns of keep plus score (0 to 1) and predicted (1 from the threshold), one row per row. Null and empty texts
    score 0; very long texts are matched whole; a column of keep named score or predicted gives way to the result."""
    keep = [c for c in keep if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the labelled rows read
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches):
        a = automaton(shared.value)
        for b in batches:
            s = [score_text(a, t.as_py()) for t in b.column(b.num_columns - 1)]
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], [*keep, "score", "predicted"])

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, f"{kinds}score double, predicted int")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "score", "predicted")
