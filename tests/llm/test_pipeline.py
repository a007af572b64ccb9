import random

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_copies_match_brute_force(spark):
    r = random.Random(11)
    word = lambda: "w%d" % r.randrange(3000)
    common = [word() for _ in range(60)]
    texts = ["", " ", None, "one two", "One  two", "one two three"]
    for _ in range(40):
        base = [word() for _ in range(r.randrange(5, 400))] + (common if r.random() < 0.5 else [])
        texts.append(" ".join(base))
        for _ in range(r.randrange(3)):
            w = list(base)
            for _ in range(r.randrange(1, 2 + len(w) // 40)):
                w[r.randrange(len(w))] = word()
            texts.append(" ".join(w[r.randrange(3) :]))
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if 9 * len(a & sets[j]) >= 4 * (len(a) + len(sets[j])):
                links += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert links > 25
    got = corpus_pipeline.drop_near_copies(spark, frame(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)]), None)
    assert sorted(x.doc_id for x in got.collect()) == sorted({find(i) for i in range(len(texts))})


def test_stages_keep_null_ids_and_do_not_multiply_repeated_rows(spark):
    r = random.Random(12)
    text = lambda n: " ".join("w%d" % r.randrange(3000) for _ in range(n))
    one, two = text(30), text(30)
    rows = [(None, one, "en", "a", 1), (None, one.replace(" ", "  "), "en", "a", 1), (None, two, "en", "a", 1), (7, text(30), "en", "a", 1), (8, two.replace(" ", "\t"), "en", "a", 1)]
    rows += [(5, text(20), "en", "a", 1)] * 3 + [(8, text(25), None, None, None), (9, None, None, None, None)]
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        got = [tuple(x) for x in stage(spark, frame(spark, rows), None).collect()]
        assert len(got) == len(set(got)) == 6  # one, two (id 8 goes before null), 7, 5, and the others of 8 and 9
        assert set(got) >= {rows[3], rows[4], rows[5], rows[8], rows[9]}
        assert [x[1].split() for x in got if x[0] is None] == [one.split()]
    mixed = [tuple(x) for x in corpus_pipeline.mix(spark, frame(spark, rows), None).collect()]
    assert all(mixed.count(x) <= 2 * rows.count(x) for x in set(mixed))
    assert all(mixed.count(x) >= rows.count(x) for x in set(rows) if x[3] == "a")  # the rate of source a is 1.4


def test_a_large_family_of_near_copies_makes_no_square_of_pairs(spark, monkeypatch):
    from quillon.llm import similar

    sizes = []
    bounded = similar._bounded
    monkeypatch.setattr(similar, "_bounded", lambda pairs: (lambda out: (sizes.append(out.count()), out)[1])(bounded(pairs)))
    r = random.Random(13)
    word = lambda: "w%d" % r.randrange(9000)
    base = [word() for _ in range(120)]
    rows = []
    for i in range(700):
        w = list(base)
        w[r.randrange(120)] = word()
        rows.append((i, " ".join(w), "en", "a", 1))
    rows += [(1000 + i, " ".join(base[:30] + [word() for _ in range(200)]), "en", "a", 1) for i in range(50)]
    got = {x.doc_id for x in similar.near_copies(frame(spark, rows)).filter("doc_id = component_id").collect()}
    assert got == {0} | {1000 + i for i in range(50)}
    assert sum(sizes) < 20 * len(rows)


def test_simhash_links_every_pair_within_its_bits(spark):
    from quillon.llm import simhash

    r = random.Random(14)
    fps = []
    for _ in range(300):
        x = r.getrandbits(64)
        y = x
        for bit in r.sample(range(64), r.randrange(9)):
            y ^= 1 << bit
        fps += [x, y]
    signed = lambda x: x - (1 << 64 if x >> 63 else 0)
    prints = spark.createDataFrame([(signed(x), i, 10) for i, x in enumerate(fps)], "fp long, sig long, n long")
    got = {(x.a, x.b) for x in simhash.nearest_pivots(prints).collect()}
    bits = {(i, j): (x ^ fps[j]).bit_count() for i, x in enumerate(fps) for j in range(i + 1, len(fps))}
    assert got == {p for p, n in bits.items() if n <= 6}


def test_near_copies_of_few_edits_link_by_simhash_first(spark, monkeypatch):
    from quillon.llm import similar

    found = []
    pivots = similar.nearest_pivots
    monkeypatch.setattr(similar, "nearest_pivots", lambda prints: (lambda out: (found.append(out.select("a", "b").collect()), out)[1])(pivots(prints)))
    r = random.Random(15)
    word = lambda: "w%d" % r.randrange(9000)
    rows = []
    for i in range(60):
        w = [word() for _ in range(250)]
        rows.append((2 * i, " ".join(w), "en", "a", 1))
        w[r.randrange(250)] = word()
        rows.append((2 * i + 1, " ".join(w), "en", "a", 1))
    got = {x.doc_id for x in similar.near_copies(frame(spark, rows)).filter("doc_id = component_id").collect()}
    assert got == set(range(0, 120, 2))
    assert 54 <= len(found[0]) <= 60


def test_groups_of_a_value_do_not_grow_with_the_table(spark, monkeypatch):
    from quillon.llm import similar

    sizes = []
    bounded = similar._bounded
    monkeypatch.setattr(similar, "SAMPLE", 50)  # as if the table were 80 times as large
    monkeypatch.setattr(similar, "_bounded", lambda pairs: (sizes.append(pairs.count()), bounded(pairs))[1])
    r = random.Random(16)
    word = lambda: "w%d" % r.randrange(100_000)
    phrases = [[word() for _ in range(12)] for _ in range(20)]
    rows = [(i, " ".join([word() for _ in range(60)] + phrases[i % 20]), "en", "a", 1) for i in range(3200)]
    got = similar.near_copies(frame(spark, rows))
    assert got.filter("doc_id = component_id").count() == 3200
    assert sum(sizes) < 10_000


def test_run_matches_brute_force(spark):
    import collections
    import re

    from quillon.llm import toxicity

    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    a = toxicity.automaton(toxicity.fit(docs, labels))
    rows = [r for r in docs.collect() if toxicity.score_text(a, r.text) < 0.7]
    seen = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        seen.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r.text or ""), r)
    rows = sorted(seen.values(), key=lambda r: r.doc_id)
    sets, where = [shingles(r.text) for r in rows], collections.defaultdict(list)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, s in enumerate(sets):
        for j in {j for g in s for j in where[g]} | ({j for j in range(i) if not sets[j]} if not s else set()):
            if 9 * len(s & sets[j]) >= 4 * (len(s) + len(sets[j])):
                x, y = sorted((find(i), find(j)))
                root[y] = x
        for g in s:
            where[g].append(i)
    kept = {rows[i].doc_id: rows[i] for i in range(len(rows)) if find(i) == i}
    got = corpus_pipeline.run(spark, d).collect()
    copies = collections.Counter(r.doc_id for r in got)
    n = {i: len((r.text or "").split()) for i, r in kept.items()}
    assert len(kept) < len(rows) < docs.count() and set(copies) <= set(kept) and max(copies.values()) <= 2
    assert all(r.n_tokens == n[r.doc_id] for r in got)
    assert abs(sum(n[i] * c for i, c in copies.items()) - 1.5 * sum(n.values())) < 0.05 * sum(n.values())
    batches = collections.defaultdict(list)
    for r in got:
        batches[r.bucket, r.batch].append(r.padded)
    assert all(len(b) == 1 or len(b) * max(1, b[0]) <= 32_768 for b in batches.values())
