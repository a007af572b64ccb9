"""Queries of the contracts against brute force on the small tables."""
import collections
import re

import numpy as np
import xxhash

from quillon.llm import mixing, packing, simhash

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(spark, d=SMALL):
    return {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}


def words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]


def brute_fingerprint(t):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fp, near):
    root = {i: i for i in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(fp)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if near(fp[a], fp[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_op3(spark):
    fp = {i: brute_fingerprint(r.text) for i, r in texts(spark).items()}
    comp = components(fp, lambda a, b: (a ^ b).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op3(spark, SMALL).collect()}
    assert got == {i: (f"{fp[i]:016x}", comp[i]) for i in fp} and len(set(comp.values())) < len(comp)


def test_op7(spark):
    docs = texts(spark)
    size = {i: len(words(r.text)) for i, r in docs.items()}
    per = collections.Counter()
    for i, r in docs.items():
        per[r.source] += size[i]
    names = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, target, free = 1.5 * sum(size.values()), {}, set(names)
    while True:  # sources above twice their size stop there, the excess is reshared by weight
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * per[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * per[s]
            left -= target[s]
        free -= full
    got = {r.doc_id: r for r in mixing.op7(spark, SMALL).collect()}
    assert set(got) == set(docs)
    taken = collections.Counter()
    for i, r in got.items():
        assert r["size"] == size[i] and r.source_size == per[docs[i].source] and abs(r.target - target[docs[i].source]) < 1e-6
        assert r.taken in (0, size[i], 2 * size[i])
        taken[docs[i].source] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= max(size[i] for i, r in docs.items() if r.source == s) / 2 + 1e-6
    assert sorted(map(tuple, got.values())) == sorted(tuple(r) for r in mixing.op7(spark, SMALL).collect())


def test_op5(spark):
    size = {i: len(words(r.text)) for i, r in texts(spark).items()}
    got = packing.op5(spark, SMALL).collect()
    assert {r.doc_id: r.n_tokens for r in got} == size
    counts = collections.Counter(size.values())
    x = sorted(counts)
    # the least padding of at most 12 buckets, by the plain quadratic programme
    cost = lambda i, j: sum(counts[v] * (x[j] - v) for v in x[i : j + 1])
    table = np.array([[cost(i, j) if i <= j else 0 for j in range(len(x))] for i in range(len(x))], float)
    best = table[0].copy()
    for _ in range(11):
        best = np.array([min([best[j], *(best[i - 1] + table[i, j] for i in range(1, j + 1))]) for j in range(len(x))])
    assert sum(r.padded - r.n_tokens for r in got) == best[-1]
    batches = collections.defaultdict(list)
    for r in got:
        batches[r.bucket, r.batch].append(r)
    for rows in batches.values():
        assert len({r.padded for r in rows}) == 1 and (len(rows) == 1 or len(rows) * max(1, rows[0].padded) <= 32_768)


def test_odd_rows_of_mixing_and_simhash(spark):
    rows = [(1, None, None, None, None), (None, "a b c", None, None, None), (2, "a b c", "en", "s", 1), (2, "a b c", "en", "s", 1), (3, "w " * 40_000, "en", "s", 1), (4, "", "en", "t", 0)]
    f = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS uid", "2 AS size", "3 AS target", "4 AS fp", "5 AS label")
    got = simhash.simhash_dedup(f).collect()
    assert len(got) == 6 and {r.component_id for r in got if r.fingerprint == "0" * 16} == {1}
    assert {r.component_id for r in got if r.doc_id in (2, None)} == {2}
    assert sorted(str(r.doc_id) for r in mixing.mix_sources(f).collect()) == ["1", "2", "2", "3", "4", "None"]
    assert simhash.simhash_dedup(f.limit(0)).collect() == [] and mixing.mix_sources(f.limit(0)).collect() == [] and packing.pack(f.limit(0)).collect() == []
