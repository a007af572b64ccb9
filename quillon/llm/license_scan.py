"""License scans: a positional rare-token index over template notices, verified by mandatory key phrases."""
from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
_GNU = "is free software you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version"
_CC = "this work is licensed under a creative commons {} 4 0 international license"
#: (label, template words, key phrases that must all stand in the matched span)
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "deal in the software without restriction"]),
    ("mit", "released under the mit license", ["the mit license"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license version 2 0", "except in compliance with the license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2", "licensed under the terms of the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3", "this program " + _GNU.format("general public license", 3), ["gnu general public license", "either version 3 of the license"]),
    ("gpl-2", "this program " + _GNU.format("general public license", 2), ["gnu general public license", "either version 2 of the license"]),
    ("lgpl", "this library " + _GNU.format("lesser general public license", "2 1"), ["gnu lesser general public license"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "this program " + _GNU.format("affero general public license", 3), ["gnu affero general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "the following conditions are met"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc", _CC.format("attribution noncommercial"), ["creative commons attribution noncommercial"]),
    ("cc-by-sa", _CC.format("attribution sharealike"), ["creative commons attribution sharealike"]),
    ("cc-by", _CC.format("attribution"), ["creative commons attribution 4 0"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["subject to the terms of the mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute this software", "with or without fee"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("boost", "boost software license version 1 0", ["boost software license"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["as is without any express or implied warranty", "in no event will the authors be held liable"]),
    ("epl", "made available under the terms of the eclipse public license", ["terms of the eclipse public license"]),
]
#: A template is indexed by its RARE highest-IDF words; a place needs AGREE of them (all, if it has fewer) at one relative position.
RARE, AGREE = 6, 3


@lru_cache
def index():
    """(words, key phrases, rare words) of each template, IDF over templates, postings: rare word -> [(template, position)]."""
    words = [t.encode().split() for _, t, _ in TEMPLATES]
    keys = [[k.encode().split() for k in ks] for *_, ks in TEMPLATES]
    df = Counter(w for ws in words for w in set(ws))
    idf = {w: math.log(1 + len(words) / n) for w, n in df.items()}
    rare = [set(sorted(set(ws), key=lambda w: (-idf[w], -len(w), w))[:RARE]) for ws in words]
    posts = defaultdict(list)
    for n, ws in enumerate(words):
        for i, w in enumerate(ws):
            if w in rare[n]:
                posts[w].append((n, i))
    return words, keys, rare, idf, dict(posts)


def _stands(words: list[bytes], phrase: list[bytes], at) -> list[int]:
    n = len(phrase)
    return [i for i in at if i >= 0 and words[i : i + n] == phrase]


def matches(words: list[bytes], where: dict[bytes, list[int]]):
    """(template, first word's place, share) of every place where AGREE distinct rare words of a template stand at its
    relative positions and all its key phrases stand inside the template's span. share: words in place, weighed by IDF.

    Work grows with the places of rare words; a word repeated without end alone never makes a candidate."""
    tmpl, keys, rare, idf, posts = index()
    support: dict[tuple[int, int], set[bytes]] = defaultdict(set)
    for w in sorted(where.keys() & posts.keys(), key=lambda w: (-idf[w], w)):  # highest IDF first
        for n, pos in posts[w]:
            for i in where[w]:
                support[n, i - pos].add(w)
    for (n, start), got in support.items():
        if len(got) < min(AGREE, len(rare[n])):
            continue
        ws = tmpl[n]
        here = words[max(0, start) : max(0, start + len(ws))]
        if all(_stands(here, k, range(len(here) - len(k) + 1)) for k in keys[n]):
            same = sum(idf[w] for i, w in enumerate(ws) if 0 <= start + i < len(words) and words[start + i] == w)
            yield n, start, same / sum(idf[w] for w in ws)


def scan(text: str | None):
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text.

    score: the best share of a matched template's words by IDF; 1 for a base phrase; 0 for neither."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    words = WORD.findall(data)
    places, base = [], set()
    where: dict[bytes, list[int]] = defaultdict(list)
    watch = index()[4].keys() | {b"license"}
    if not watch.isdisjoint(words):
        for i, w in enumerate(words):
            if w in watch:
                where[w].append(i)
    for label, phrase in BASE.items():
        p = phrase.encode().split()
        hits = _stands(words, p, [i - len(p) + 1 for i in where.get(b"license", ())])
        if hits:
            base.add(label)
            places += hits
    found, best = set(base), 1.0 if base else 0.0
    for n, _, share in matches(words, where):
        found.add(TEMPLATES[n][0])
        best = max(best, share)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(found)), best)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs. Null and empty texts have no words, no labels, score 0; repeats give repeated rows; very
    long texts take time in proportion to their words; other columns are ignored, whatever their names."""
    def run(batches):
        for b in batches:
            cols = list(zip(*[scan(t.as_py()) for t in b.column(1)])) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
