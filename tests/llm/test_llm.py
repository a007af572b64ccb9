import collections
import hashlib
import random
import re

import numpy as np
import pytest

from quillon.llm import exact_dedup, license_scan, mixing, packing, pii, quotes, simhash, suffix_dedup, syncmers, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, "é" * 3000, "fr", "b", 3000), (5, "the same text here", "en", "b", 18), (5, "the same text here", "en", "b", 18)]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


ALL = {"pii": pii.find_pii, "exact": exact_dedup.exact_dedup, "lazy": lambda d: exact_dedup.exact_dedup(d, digests=False), "simhash": simhash.simhash_dedup,
       "license": license_scan.license_scan, "mix": mixing.mix_sources, "suffix": suffix_dedup.dedup_substrings, "pack": packing.pack,
       "syncmers": syncmers.fingerprint, "toxicity": lambda d: toxicity.score(d, {" idiot ": 9.0})}


@pytest.mark.parametrize("name", ALL)
def test_odd_rows_and_empty_tables(spark, name):
    from pyspark.sql import functions as F

    d = frame(spark, ODD).withColumn("n", F.lit(1)).withColumn("key", F.lit("x"))
    assert ALL[name](d).count() == len(ODD)
    assert ALL[name](frame(spark, [])).count() == 0


def test_exact_dedup(spark):
    rows = [(3, "a  b"), (1, "a\nb"), (2, "a c"), (4, None), (5, "")]
    for mode in (True, False):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(frame(spark, [(*r, None, None, None) for r in rows]), digests=mode).collect()}
        assert got == {1: (1, 2, True), 3: (1, 2, False), 2: (2, 1, True), 4: (4, 2, True), 5: (4, 2, False)}


def test_simhash_components_match_brute_force(spark):
    r = random.Random(1)
    fps = {r.getrandbits(64) for _ in range(100)}
    core = r.getrandbits(64)
    for _ in range(150):  # a hot group, whose keys are shared by more than HOT fingerprints
        fps.add(core ^ (1 << r.randrange(20)) ^ (1 << r.randrange(20)))
    for f in list(fps)[:60]:
        fps.add(f ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    fps = sorted(fps)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    want = collections.defaultdict(set)
    for f in fps:
        want[find(f)].add(f)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    from pyspark.sql import functions as F

    e = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    b = F.when(F.col("ball"), F.xxhash64(F.lit("ball"), F.col("b"))).otherwise(F.col("b"))
    comp = simhash.connected_components(e.select("a", b.alias("b")).filter("a <> b"))
    label = {r.node: r.label for r in comp.collect()}
    got = collections.defaultdict(set)
    for f, s in zip(fps, signed):
        got[label.get(s, s)].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_pii_base_matches_plain_patterns():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    r = random.Random(2)
    for _ in range(3000):
        t = "".join(r.choice("ab.@- 1é") for _ in range(30))
        assert [(s, e) for s, k, e in pii.base_spans(t) if k == 0] == [m.span() for m in email.finditer(t)]
    t = "x 4111 1111 1111 1111 and 10.0.0.256 10.0.0.1 +1 (988) 555-2485"
    assert [(k, t[s:e]) for s, k, e in pii.base_spans(t)] == [(2, "4111 1111 1111 1111"), (1, "10.0.0.1"), (3, "+1 (988) 555-2485")]


def test_crf_adds_forms_and_leaves_plain_numbers():
    got = pii.crf_spans(["please call (555) 331-9912 after", "the version 2.0. of 1999", "mail joe@mailhost or"])
    assert [[k for _, k, _ in x] for x in got] == [[3], [], [0]]


def test_viterbi_matches_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    e, a = rng.normal(size=(3, 4, 3)), rng.normal(size=(3, 3))
    for n, got in enumerate(pii.viterbi(e, np.ones((3, 4), bool), a)):
        best = max(itertools.product(range(3), repeat=4), key=lambda p: sum(e[n, i, x] for i, x in enumerate(p)) + sum(a[x, y] for x, y in zip(p, p[1:])))
        assert tuple(got) == best


def test_license():
    n, k, first, last, base, labels, score = license_scan.scan("Released under the MIT License. x Apache-License y GNU General Public License, version 3.")
    assert (n, k, first, last, base, score) == (15, 3, 3, 10, "apache,gpl,mit", 1.0) and "gpl-3" in labels
    assert license_scan.scan(None) == (0, 0, None, None, "", "", 0.0)


def test_mixing(spark):
    r = random.Random(3)
    rows = [(i, "w " * r.randrange(1, 60), "en", "a" if i % 3 else "bcd"[i % 9 // 3], 1) for i in range(900)]
    a = mixing.mix_sources(frame(spark, rows)).toPandas()
    b = mixing.mix_sources(frame(spark, rows[::-1])).toPandas()
    assert a.sort_values("doc_id").taken.tolist() == b.sort_values("doc_id").taken.tolist()
    assert abs(a.groupby("source").target.first().sum() - 1.5 * a["size"].sum()) < 1e-6
    for _, g in a.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max() / 2 + 1e-6
        assert g.target.iloc[0] <= 2 * g["size"].sum() + 1e-9
    assert (a.taken <= 2 * a["size"]).all()


def test_packing_boundaries_are_optimal():
    import itertools

    r = random.Random(4)
    for _ in range(50):
        x = sorted(r.sample(range(1, 40), 7))
        c = [r.randrange(1, 9) for _ in x]
        cost = lambda b: sum(n * (min(y for y in b if y >= v) - v) for v, n in zip(x, c))
        best = min(cost((*b, x[-1])) for k in range(3) for b in itertools.combinations(x[:-1], k))
        assert cost(packing.boundaries(x, c, 3)) == best


def test_packing_budget(spark):
    rows = [(i, "w " * (i % 50), "en", "a", 1) for i in range(500)]
    p = packing.pack(frame(spark, rows), buckets=4, budget=200).toPandas()
    assert len(p) == 500 and (p.n_tokens <= p.padded).all()
    for (_, pad, _), g in p.groupby(["bucket", "padded", "batch"]):
        assert len(g) == 1 or len(g) * max(1, pad) <= 200


def brute_repeats(texts):
    c = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        m = bytearray(len(t))
        for i in range(len(t) - 199):
            if c[t[i : i + 200]] > 1:
                m[i : i + 200] = b"\1" * 200
        out.append((sum(m), hashlib.sha256(bytes(x for x, y in zip(t, m) if not y)).hexdigest()))
    return out


def repetitive():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 7)))
    shared = [" ".join(word() for _ in range(80)) for _ in range(4)]
    texts = [" ".join([word() for _ in range(r.randrange(40))] + [r.choice(shared)[r.randrange(60):]] + [word() for _ in range(30)]) for _ in range(60)]
    texts += ["a" * 450, texts[0], "ab" * 300]
    return texts


@pytest.mark.parametrize("limit", [2048, 4, 1])
def test_suffix_dedup_matches_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "LIMIT", limit)
    texts = repetitive()
    got = suffix_dedup.dedup_substrings(frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    assert [(g.n_removed, g.kept_sha256) for g in got] == brute_repeats([t.encode() for t in texts])


@pytest.mark.parametrize("limit", [2048, 4])
def test_repeat_groups_list_every_occurrence(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "LIMIT", limit)
    texts = repetitive()
    groups = collections.defaultdict(set)
    for g in suffix_dedup.repeat_groups(frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect():
        groups[g.group_id, g.length].add((g.doc_id, g.start))
    data = [t.encode() for t in texts]
    cover = [bytearray(len(t)) for t in data]
    for (_, n), places in groups.items():
        i, s = min(places)
        what = data[i][s : s + n]
        want = {(j, k) for j, t in enumerate(data) for k in range(len(t) - n + 1) if t[k] == what[0] and t[k : k + n] == what}
        assert n >= 200 and len(places) > 1 and places == want
        for j, k in places:
            cover[j][k : k + n] = b"\1" * n
    assert [sum(c) for c in cover] == [n for n, _ in brute_repeats(data)]


def test_maximal_repeats_list_all_occurrences():
    got = [(n, sorted(zip(t.tolist(), s.tolist()))) for n, t, s in suffix_dedup.maximal_repeats([b"xabcdy", b"zabcdw", b"qabcr"], 3)]
    assert sorted(got) == [(3, [(0, 1), (1, 1), (2, 1)]), (4, [(0, 1), (1, 1)])]


def test_maximal_repeats_match_enumeration():
    r = random.Random(9)
    for _ in range(200):
        texts = ["".join(r.choices("ab", k=r.randrange(14))).encode() for _ in range(4)]
        at = collections.defaultdict(set)
        for i, t in enumerate(texts):
            for s in range(len(t)):
                for e in range(s + 2, len(t) + 1):
                    at[t[s:e]].add((i, s))
        side = lambda w, d: {texts[i][s + d : s + d + 1] or i for i, s in at[w] if s + d >= 0} | {("edge", i) for i, s in at[w] if s + d < 0}
        want = {(len(w), tuple(sorted(o))) for w, o in at.items() if len(o) > 1 and len(side(w, -1)) > 1 and len(side(w, len(w))) > 1}
        got = {(n, tuple(sorted(zip(t.tolist(), s.tolist())))) for n, t, s in suffix_dedup.maximal_repeats(texts, 2)}
        assert got == want


def test_quotes(spark):
    rows = [(1, 0, "user", "Hello there"), (1, 1, "assistant", "Hi. How are you?"), (1, 2, "user", "> Hi.  how are YOU?\n>> hello there\nfine"), (1, 3, "user", "> unknown\nx"), (None, None, None, None)]
    m = {r.turn: r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (m[2].reply_to, m[2].content, m[2].n_quotes, m[2].root, m[2].depth) == (1, "fine", 2, 1, 1)
    assert m[3].reply_to is None and m[3].content == "x" and None in m


def test_syncmers(spark):
    rows = [(i, " ".join(random.Random(i % 40).choices("abcdefghij", k=50 + i)), None, None, None) for i in range(90)]
    got = sorted(syncmers.fingerprint(frame(spark, rows)).collect(), reverse=True)
    text = [t for _, t, *_ in rows][::-1]
    for i, g in enumerate(got):
        n, nxt = len(text[i]), text[(i + 1) % len(text)]
        edited = text[i][: n - n // 2] + nxt[: n // 2]
        assert (g.n_chars, g.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())


def test_toxicity(spark):
    docs = [(i, ("you IDI0T scum " if i % 2 else "a fine day ") + "and so on " * 5, None, None, None) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, docs), labels)
    got = {r.doc_id: r.predicted for r in toxicity.score(frame(spark, docs), model).collect()}
    assert got == {i: i % 2 for i in range(120)}
    a = toxicity.automaton({" clown ": 9.0})
    assert toxicity.score_text(a, "a clown fish swims") == 0 and toxicity.score_text(a, "a сlоwn you are") > 0.7
