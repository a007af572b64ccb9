"""Suffix-array dedup: minimizer anchors bring repeated strings together, enhanced suffix arrays find what repeats."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, join_counted, marked, materialise

LEAST, KMER, BLOCK, PIECE = 200, 64, 1 << 19, 1 << 22
#: contexts of one anchor that share a suffix array; larger groups are split by further anchors, ORDERS of them, then by windows
LIMIT, ORDERS = 2048, 2
TABLES = [np.random.default_rng(7 + i).integers(1, 2**63, 256, dtype=np.uint64) * 2 + 1 for i in range(ORDERS + 1)]
MULT, LOW = np.uint64(0x9E3779B97F4A7C15), np.uint64((1 << 24) - 1)


def windows(data: bytes, least: int = LEAST, kmer: int = KMER, order: int = 0):
    """(hash, lo, hi, context hash) arrays: runs of window starts lo..hi whose least k-mer is the same occurrence.

    Equal windows have their least k-mer at the same place, hence the same hash: only runs of one hash can share windows. Each order ranks k-mers differently."""
    parts = []
    for at in range(0, max(1, len(data) - least + 1), PIECE):
        b = np.frombuffer(data, np.uint8, count=min(len(data) - at, PIECE + least - 1), offset=at)
        if len(b) < least:
            break
        h, m = TABLES[order][b], 1
        with np.errstate(over="ignore"):
            step = MULT
            while m < kmer:
                h = h[:-m] * step + h[m:]
                step, m = step * step, 2 * m
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        s, w, p = (h & ~LOW) | np.arange(len(h), dtype=np.uint64), least - kmer + 1, 1
        while 2 * p <= w:
            s, p = np.minimum(s[:-p], s[p:]), 2 * p
        if w > p:
            s = np.minimum(s[: len(s) - (w - p)], s[w - p :])
        a = (s & LOW).astype(np.int64)
        lo = np.concatenate([[0], np.flatnonzero(np.diff(a)) + 1])
        hi = np.concatenate([lo[1:] - 1, [len(a) - 1]])
        x = a[lo]
        view = memoryview(data)[at:]
        ctx = np.fromiter((xxhash.xxh3_64_intdigest(view[i : j + least], k - i) for i, j, k in zip(lo.tolist(), hi.tolist(), x.tolist())), np.uint64, len(lo))
        parts.append((h[x].view(np.int64), lo + at, hi + at, ctx.view(np.int64)))
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 4


def suffix_array(values: np.ndarray):
    """Suffix array and LCP array (lcp[i] of suffixes sa[i-1], sa[i]) of an integer sequence, by prefix doubling."""
    n = len(values)
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64) + 1
    levels, step = [rank], 1
    while step < n and rank.max() < n:
        nxt = np.zeros(n, np.int64)
        nxt[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 2) + nxt, return_inverse=True)[1].astype(np.int64) + 1
        levels.append(rank)
        step *= 2
    sa = np.argsort(rank, kind="stable")
    lcp = np.zeros(n, np.int64)
    i, j = sa[:-1].copy(), sa[1:].copy()
    for level in range(len(levels) - 1, -1, -1):
        ok = (i < n) & (j < n)
        same = np.zeros(len(i), bool)
        same[ok] = levels[level][i[ok]] == levels[level][j[ok]]
        same &= np.maximum(i, j) + (1 << level) <= n
        lcp[1:] += same * (1 << level)
        i, j = i + same * (1 << level), j + same * (1 << level)
    return sa, lcp


def joined(texts: list[bytes]) -> np.ndarray:
    """Texts one after another, each closed by a separator of its own, so that no match crosses texts."""
    out = [x for n, t in enumerate(texts) for x in (np.frombuffer(t, np.uint8).astype(np.int64), np.array([256 + n]))]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def maximal_repeats(texts: list[bytes], least: int = LEAST):
    """[(length, text numbers, starts)]: all maximal repeats of `least` bytes or more with all their occurrences.

    The common-prefix intervals of the enhanced suffix array are scanned with a stack; an interval is right-maximal by
    construction and is put out if the bytes to the left of its suffixes differ (a text's start differs from everything).
    Stretches of the LCP array below `least`, or with one and the same byte to the left throughout, hold no such
    interval and are skipped before the scan."""
    values = joined(texts)
    n = len(values)
    if not n:
        return []
    sa, lcp = suffix_array(values)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    left = np.where(sa > 0, values[sa - 1], -1)
    differs = np.zeros(n, np.int64)  # differs[i]: the byte left of suffix i is another than that of suffix i - 1
    differs[1:] = (left[1:] != left[:-1]) | (left[1:] > 255) | (left[1:] < 0)
    change = np.cumsum(differs)
    deep = np.concatenate([[False], lcp[1:] >= least, [False]])
    begin, end = np.flatnonzero(deep[1:] & ~deep[:-1]) + 1, np.flatnonzero(deep[:-1] & ~deep[1:]) + 1  # lcp[begin:end] >= least
    alive = change[end - 1] > change[begin - 1]
    out = []
    for b, e in zip(begin[alive].tolist(), end[alive].tolist()):
        depths, turn = lcp[b:e].tolist(), change[b - 1 : e].tolist()
        stack: list[tuple[int, int]] = []  # (depth, first suffix of the interval), both counted from b - 1
        for i in range(1, e - b + 2):
            cur, lb = (depths[i - 1] if i <= e - b else 0), i - 1
            while stack and stack[-1][0] > cur:
                depth, lb = stack.pop()
                if turn[i - 1] > turn[lb]:
                    at = np.sort(sa[b - 1 + lb : b - 1 + i])
                    t = np.searchsorted(starts, at, "right") - 1
                    out.append((depth, t, at - starts[t]))
            if cur and (not stack or stack[-1][0] < cur):
                stack.append((cur, lb))
    return out


def _gathered(batches, resolve, names):
    """Rows sorted by kh: whole groups are gathered up to about BLOCK bytes and resolved by one enhanced suffix array."""
    rows, size = [], 0
    empty = pa.RecordBatch.from_arrays([pa.array([], pa.int64()) for _ in names], names)

    def done():
        got = resolve(rows)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], names) if got else empty

    for b in batches:
        for r in b.to_pylist():
            if rows and size > BLOCK and r["kh"] != rows[-1]["kh"]:
                yield from done()
                rows, size = [], 0
            rows.append(r)
            size += len(r["bytes"])
    if rows:
        yield from done()


def _spans(rows):
    """(rid, s, e) merged spans of maximal repeats, of contexts that stand once (those of more rows are covered whole)."""
    found = maximal_repeats([r["bytes"] for r in rows])
    if not found:
        return []
    t = np.concatenate([f[1] for f in found])
    s = np.concatenate([f[2] for f in found])
    e = s + np.repeat([f[0] for f in found], [len(f[1]) for f in found])
    once = np.array([r["c"] == 1 for r in rows])[t]
    t, s, e = t[once], s[once], e[once]
    order = np.lexsort((-e, s, t))
    out: list[list[int]] = []
    for x, a, z in zip(t[order].tolist(), s[order].tolist(), e[order].tolist()):
        if out and out[-1][0] == x and a <= out[-1][2]:
            out[-1][2] = max(out[-1][2], z)
        else:
            out.append([x, a, z])
    return [(rows[x]["rid"], rows[x]["lo"] + a, rows[x]["lo"] + z) for x, a, z in out]


def _listed(rows):
    """(group, length, kh, ctx, off) of every occurrence in a context, for every maximal repeat."""
    out = []
    for depth, t, s in maximal_repeats([r["bytes"] for r in rows]):
        first = rows[int(t[0])]
        group = xxhash.xxh3_64_intdigest(first["bytes"][int(s[0]) : int(s[0]) + depth], first["kh"] & (2**64 - 1)) - (1 << 63)
        out += [(group, depth, rows[x]["kh"], rows[x]["ctx"], a) for x, a in zip(t.tolist(), s.tolist())]
    return out


def _split(order: int):
    """Contexts of too large a group -> their runs under another order of k-mers, or their single windows (order -1), keyed
    by both anchors. Equal windows stay together; what merely shared the first anchor mostly parts."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                cols = [[] for _ in range(10)]
                for r in b.slice(at, 256).to_pylist():
                    data, seed = r["bytes"], r["kh"] & (2**64 - 1)
                    if order < 0:
                        n = len(data) - LEAST + 1
                        v = memoryview(data)
                        runs = [(xxhash.xxh3_64_intdigest(v[i : i + LEAST]), i, i, xxhash.xxh3_64_intdigest(v[i : i + LEAST], 1)) for i in range(n)]
                    else:
                        runs = list(zip(*(x.tolist() for x in windows(data, order=order))))
                    for kh, lo, hi, ctx in runs:
                        kh = xxhash.xxh3_64_intdigest((kh & (2**64 - 1)).to_bytes(8, "little"), seed) - (1 << 63)
                        ctx = ctx - (1 << 63) if order < 0 else ctx
                        for c, x in zip(cols, (kh, ctx, r["c"], r["rid"], r["lo"] + lo, r["lo"] + hi, data[lo : hi + LEAST], r["pkh"], r["pctx"], r["plo"])):
                            c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 6 else pa.int64()) for i, c in enumerate(cols)], CONTEXT)
    return run


CONTEXT = ["kh", "ctx", "c", "rid", "lo", "hi", "bytes", "pkh", "pctx", "plo"]
CONTEXT_KIND = ", ".join(f"{c} {'binary' if c == 'bytes' else 'long'}" for c in CONTEXT)


def _result(batches):
    for b in batches:
        cols = [[] for _ in range(4)]
        for t, spans in zip(b.column("t"), b.column("spans").to_pylist()):
            data, at, kept, n, removed = t.as_py().encode("utf-8", "surrogatepass"), 0, hashlib.sha256(), 0, 0
            end = -1
            for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
                if s > end:
                    kept.update(data[at:s])
                    n += 1
                    removed += e - s
                    end = at = e
                elif e > end:
                    removed += e - end
                    end = at = e
            kept.update(data[at:])
            for c, x in zip(cols, (len(data), removed, n, kept.hexdigest())):
                c.append(x)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.string() if i == 3 else pa.int64()) for i, c in enumerate(cols)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _runs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (rid, t) -> live (rid, kh, lo, hi, ctx): runs of windows whose anchor stands more than once; and their classes of
    equal contexts (kh, ctx, c, rep): c rows each, one of them as (rid, lo, hi). Hot anchors never gather."""
    def run(batches):
        for b in batches:
            cols = [[np.zeros(0, np.int64)] for _ in range(5)]
            for rid, t in zip(b.column(0).to_pylist(), b.column(1)):
                w = windows(t.as_py().encode("utf-8", "surrogatepass"))
                for c, x in zip(cols, [np.full(len(w[0]), rid, np.int64), *w]):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["rid", "kh", "lo", "hi", "ctx"])

    runs = materialise(docs.mapInArrow(run, "rid long, kh long, lo long, hi long, ctx long"), "runs")
    again = materialise(runs.groupBy("kh").agg(F.count("*").alias("n")).filter("n > 1"), "again")
    live = materialise(join_counted(runs, again, "kh", "n", "inner").drop("n"), "live")
    return live, materialise(live.groupBy("kh", "ctx").agg(F.count("*").alias("c"), F.min(F.struct("rid", "lo", "hi")).alias("rep")), "classes")


def _contexts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The bytes of one row of every class whose anchor has other contexts too: CONTEXT columns and k, contexts of the anchor."""
    groups = materialise(classes.groupBy("kh").agg(F.count("*").alias("k")).filter("k > 1"), "anchors")
    work = materialise(join_counted(classes, groups, "kh", "k", "inner").select("kh", "ctx", "c", "k", "rep.*"), "work")
    texts = marked(docs, materialise(work.select("rid").distinct(), "asked")).filter("maybe").select("rid", "t")
    need = work.groupBy("rid").agg(F.collect_list(F.struct("kh", "ctx", "c", "k", "lo", "hi")).alias("ws"))  # bounded by one text's runs
    cut = texts.join(need, "rid").withColumn("u", F.encode("t", "UTF-8")).select("rid", "u", F.explode("ws").alias("w"))
    cut = cut.select("rid", "w.*", F.expr("substring(u, cast(w.lo as int) + 1, cast(w.hi - w.lo as int) + 200)").alias("bytes"))
    # a text that stands in fully equal rows comes once for each: the same context bytes, of which one is kept
    return materialise(cut.dropDuplicates(["kh", "ctx"]), "contexts")


def _levels(docs: DataFrame):
    """Yields (members, classes, few, hot) of each level: members (kh, ctx, c, rid, lo, hi, ...) stand for their classes (kh, ctx,
    c: rows of the input); few are the contexts to be resolved by suffix arrays, in groups of at most LIMIT; hot the
    others. The first level has all anchors. Contexts of larger groups go on to the next one, with a further anchor each, and at last as
    single windows, of which equal ones are one class and others share nothing: so no group is too large and none is cut."""
    live, classes = _runs(docs)
    cut = _contexts(docs, classes)
    few, hot = cut.filter(F.col("k") <= LIMIT), cut.filter(F.col("k") > LIMIT)
    yield live, classes, few, hot
    for order in (*range(1, ORDERS + 1), -1):
        if not hot.limit(1).count():
            return
        hot = hot.drop("pkh", "pctx", "plo").selectExpr("*", "kh AS pkh", "ctx AS pctx", "lo AS plo")  # parts know the class they are cut from
        parts = materialise(hot.select(*CONTEXT).mapInArrow(_split(order), CONTEXT_KIND), f"split{order}")
        first = F.first(F.struct("rid", "lo", "hi", "bytes")).alias("rep")
        classes = materialise(parts.groupBy("kh", "ctx").agg(F.sum("c").alias("c"), first).select("kh", "ctx", "c", "rep.*"), "parts")
        groups = materialise(classes.groupBy("kh").agg(F.count("*").alias("k")).filter("k > 1"), "anchors")
        cut = materialise(join_counted(classes, groups, "kh", "k", "inner"), "contexts")
        few, hot = cut.filter(F.col("k") <= LIMIT), cut.filter(F.col("k") > LIMIT)
        if order < 0:  # single windows: whatever shares an anchor here is one class already
            few, hot = cut.filter("false"), cut.filter("false")
        yield parts, classes.select("kh", "ctx", "c", F.struct("rid", "lo", "hi").alias("rep")), few, hot


def _sorted(few: DataFrame) -> DataFrame:
    return few.select("kh", "ctx", "c", "rid", "lo", "bytes").repartition("kh").sortWithinPartitions("kh", "ctx")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """docs (rid, t) -> (rid, s, e): byte spans covered by a 200-byte string that starts anywhere else; may overlap.

    Runs of windows meet by their anchor's hash; runs of one whole context are counted by partial aggregates, so copies
    and common passages never gather. Distinct contexts of one anchor go through enhanced suffix arrays in blocks of
    bounded size: the spans are the occurrences of their maximal repeats. See _levels for anchors of very many contexts.
    Anchors and whole contexts are compared by 64-bit hashes each, strings in suffix arrays by their bytes."""
    out = None
    for members, classes, few, _ in _levels(docs):
        rows = members.filter("c = 1").drop("c") if "c" in members.columns else members
        twice = materialise(classes.filter("c > 1").select("kh", "ctx", "c"), "twice")
        full = join_counted(rows.select("kh", "ctx", "rid", "lo", "hi"), twice, ["kh", "ctx"], "c", "inner").select("rid", F.col("lo").alias("s"), (F.col("hi") + LEAST).alias("e"))
        some = full.unionByName(_sorted(few).mapInArrow(lambda b: _gathered(b, _spans, ["rid", "s", "e"]), "rid long, s long, e long"))
        out = some if out is None else out.unionByName(some)
    return out.distinct()


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(group_id, length, doc_id, start): every group of maximal repeats of 200 bytes or more with all its occurrences, in
    bytes. The string of a group stands at every place listed and nowhere else in the table.

    Repeats are maximal within an anchor's neighbourhood (a run of windows with one least k-mer, about 340 bytes at most):
    a longer repeat is listed as overlapping pieces of it. Null text is empty; of fully equal rows one is listed."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("rid", F.xxhash64("doc_id", "t"))
    rows, out = None, None
    for members, classes, few, hot in _levels(d.select("rid", "t")):
        if rows is None:
            rows = members.select("kh", "ctx", "rid", "lo")
        else:
            parents = members.select("kh", "ctx", F.col("pkh"), F.col("pctx"), (F.col("lo") - F.col("plo")).alias("delta"))
            rows = parents.join(rows.select(F.col("kh").alias("pkh"), F.col("ctx").alias("pctx"), "rid", F.col("lo").alias("at")), ["pkh", "pctx"]).select("kh", "ctx", "rid", (F.col("at") + F.col("delta")).alias("lo"))
            rows = materialise(rows, "places")
        listed = materialise(_sorted(few).mapInArrow(lambda b: _gathered(b, _listed, ["group_id", "length", "kh", "ctx", "off"]), "group_id long, length long, kh long, ctx long, off long"), "listed")
        size = F.col("rep.hi") - F.col("rep.lo") + LEAST
        whole = classes.filter("c > 1").select(F.xxhash64("kh", "ctx").alias("group_id"), size.alias("length"), "kh", "ctx", F.lit(0).cast("long").alias("off"))
        # a whole context is a group of its own unless the suffix arrays, here or at the next level, see it in others too
        whole = whole.join(hot.select("kh").distinct(), "kh", "left_anti")
        whole = whole.join(listed.select("kh", "ctx", "off", "length"), ["kh", "ctx", "off", "length"], "left_anti").select(*listed.columns)
        some = listed.unionByName(whole).join(rows, ["kh", "ctx"]).select("group_id", "length", "rid", (F.col("lo") + F.col("off")).alias("start"))
        out = some if out is None else out.unionByName(some)
    names = d.groupBy("rid").agg(F.first("doc_id").alias("doc_id"))
    return out.distinct().join(names, "rid").select("group_id", "length", "doc_id", "start")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per row of docs. Null text is empty; texts under 200
    bytes lose nothing; fully equal rows are copies of each other; null ids are kept; very long texts are cut into pieces of
    bounded memory, whole; no rows give no rows; other columns are ignored, whatever their names."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("rid", F.xxhash64("doc_id", "t"))
    spans = materialise(repeated_spans(d.select("rid", "t")), "spans")
    per = spans.groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))  # bounded by one text's length
    m = marked(d, materialise(per.select("rid"), "touched"))
    clean = m.filter("NOT maybe").select("doc_id", "t", F.lit(None).cast("array<struct<s:bigint,e:bigint>>").alias("spans"))
    hit = m.filter("maybe").select("doc_id", "t", "rid").join(per, "rid", "left").select("doc_id", "t", "spans")
    kind = d.schema["doc_id"].dataType.simpleString()
    return clean.unionByName(hit).mapInArrow(_result, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir))
