"""License scans against a search of every template at every place of the text."""
import collections
import random
import re

from quillon.llm import license_scan as ls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def has(words, phrase):
    return any(words[i : i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1))


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    split = [t.split() for _, t, _ in ls.TEMPLATES]
    df = collections.Counter(w for t in split for w in set(t))
    places = [(i, k) for k, p in ls.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    labels = {k for _, k in places}
    score = 1.0 if places else 0.0
    import math
    idf = {w: math.log(1 + len(split) / n) for w, n in df.items()}
    for (label, _, keys), t in zip(ls.TEMPLATES, split):
        rare = sorted(set(t), key=lambda w: (-idf[w], -len(w), w))[: ls.RARE]
        for start in range(-len(t) + 1, len(words)):
            same = [i for i, w in enumerate(t) if 0 <= start + i < len(words) and words[start + i] == w]
            if len({t[i] for i in same} & set(rare)) >= min(ls.AGREE, len(rare)) and all(has(words[max(0, start) : max(0, start + len(t))], k.split()) for k in keys):
                labels.add(label)
                score = max(score, sum(idf[t[i]] for i in same) / sum(idf[w] for w in t))
    at = [i for i, _ in places]
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({k for _, k in places})), ",".join(sorted(labels)), score)


def test_scan_matches_brute_force():
    r = random.Random(21)
    for _ in range(150):
        words = r.choices(["the", "license", "mit", "public", "software", "x", "émile", "general", "apache"], k=r.randrange(30))
        for _ in range(r.randrange(3)):
            t = r.choice(ls.TEMPLATES)[1].split()
            for _ in range(r.choice([0, 0, 1, 3])):
                t[r.randrange(len(t))] = r.choice(["gap", "license", "the"])
            at = r.randrange(len(words) + 1)
            words[at:at] = t[r.choice([0, 0, 3]) :]
        text = "".join(w.title() + r.choice([" ", ", ", "-", "\n"]) for w in words)
        got, want = ls.scan(text), brute(text)
        assert got[:6] == want[:6] and abs(got[6] - want[6]) < 1e-12


def test_every_template_names_itself_and_fragments_do_not():
    for label, text, keys in ls.TEMPLATES:
        assert label in ls.scan("x " + text.title())[5].split(",")
    assert ls.scan("the mozilla public license")[5:] == ("", 0.0)  # no rare words around it
    assert ls.scan("redistribution and use in source and binary forms")[5] == ""  # one of two mandatory phrases


def test_repeats_of_one_word_stay_cheap_and_odd_rows_have_results(spark):
    assert ls.scan("license " * 200_000)[:2] == (200_000, 0)
    assert ls.scan("unencumbered domain " * 100_000)[5] == ""
    rows = [(1, None), (2, ""), (3, " \n"), (4, "MIT License"), (4, "MIT License"), (None, "é" * 3000)]
    f = spark.createDataFrame([(*x, None, None, None) for x in rows], DOCS).selectExpr("*", "1 AS score", "2 AS labels", "3 AS n_words")
    got = sorted((str(x.doc_id), x.n_words, x.base_labels, x.score) for x in ls.license_scan(f).collect())
    assert got == [("1", 0, "", 0.0), ("2", 0, "", 0.0), ("3", 0, "", 0.0), ("4", 2, "mit", 1.0), ("4", 2, "mit", 1.0), ("None", 1, "", 0.0)]
    assert ls.license_scan(f.limit(0)).collect() == []


def test_query_matches_brute_force_on_the_small_tables(spark):
    d = "/root/testdata/sf0.001"
    text = {x.doc_id: x.text for x in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for x in ls.op6(spark, d).collect():
        want = brute(text[x.doc_id]) if len(text[x.doc_id]) < 4000 else ls.scan(text[x.doc_id])
        assert tuple(x)[1:7] == want[:6] and abs(x.score - want[6]) < 1e-12
