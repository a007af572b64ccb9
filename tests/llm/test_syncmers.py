"""Fingerprints against a plain Python model that hashes as Spark's xxhash64 does."""
import hashlib
import random
import struct

import xxhash

from quillon.llm import syncmers

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WS = " \t\n\v\f\r"


def h(*values):
    seed = 42
    for v in values:
        if v is not None:
            b = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
            seed = xxhash.xxh64_intdigest(b, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def units(text):
    words = [w for w in "".join(" " if c in WS else c for c in text.lower()).split(" ") if w]
    return [u for w in words for u in (w if len(w) > 24 else [w])] if any(len(w) > 24 for w in words) else words


def anchors(text):
    u, out = units(text), []
    if len(u) < 5:
        return [(h(" ".join(u)), 0)] if u else []
    inner = [h(a, b) for a, b in zip(u, u[1:])]
    for i in range(len(u) - 4):
        s = inner[i : i + 4]
        if min(s) in (s[0], s[3]):
            out.append((h(*s), i))
    return out


def linked(text):
    a = anchors(text)
    return {h(x[0], y[0], (y[1] - x[1],)) if y else h(x[0]) for x, y in zip(a, [*a[1:], None])}


def like(a, b):
    x, y = linked(a), linked(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def check(spark, rows, **kw):
    frame = spark.createDataFrame([(*r, None, None, None) for r in rows], DOCS)
    got = sorted(syncmers.fingerprint(frame, **kw).collect(), key=lambda r: -r.doc_id)
    text = [t or "" for _, t in sorted(rows, key=lambda r: -r[0])]
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), reverse=True)
    seen = {}
    for i, g in enumerate(got):
        t, nxt = text[i], text[(i + 1) % len(text)]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert (g.n_chars, g.edited_sha256, g.n_anchors) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), len(anchors(t)))
        assert abs(g.near_edited - like(t, edited)) < 1e-12 and abs(g.near_next - like(t, nxt)) < 1e-12
        assert seen.setdefault(t, g.fingerprint) == g.fingerprint and seen.setdefault(edited, g.edited_fingerprint) == g.edited_fingerprint
        least = sorted(x & 0xFFFFFFFF for x in linked(t))[:64]
        assert g.fingerprint[16:] == "".join(f"{x:08x}" for x in least)
    assert len(set(seen.values())) == len({tuple(anchors(t)) for t in seen})


def texts(n):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgé漢") for _ in range(r.randrange(1, 5)))
    out = [" ".join(word() for _ in range(r.randrange(60))) for _ in range(n)]
    out += [None, "", " \n\t", "one", "a b c d", "a b c d e", "漢字" * 40, "x" * 200, out[0], out[0] + " end", "start " + out[0], " a b c d e f g"]
    return out


def test_fingerprints_match_the_model(spark):
    check(spark, list(enumerate(texts(60))))


def test_blocks_give_the_same_rows(spark):
    rows = [(i * 7 - 200, t) for i, t in enumerate(texts(90))]
    check(spark, rows, block_rows=3)  # about 34 blocks: two tiers of cuts, sentinels, wrap-around


def test_anchors_stay_under_edits_and_links_need_the_same_distance():
    base = " ".join(random.Random(7).choices("abcdefghijklmnopqrstuvwxyz", k=400))
    assert like(base, "some words before " + base) > 0.9 and like(base, base[: len(base) // 2]) > 0.4
    assert like(base, " ".join(reversed(base.split()))) < 0.1


def test_null_and_repeated_ids(spark):
    rows = [(None, "x y z"), (None, "p q"), (3, "a b"), (3, "a b"), (3, None), (9, "w" * 5000)]
    frame = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOCS).selectExpr("*", "1 AS fp", "2 AS block", "3 AS `end`", "4 AS nxt", "5 AS t", "6 AS l")
    got = [(r.doc_id, r.n_chars) for r in syncmers.fingerprint(frame, block_rows=2).collect()]
    assert sorted(got, key=str) == sorted([(None, 5), (None, 3), (3, 3), (3, 3), (3, 0), (9, 5000)], key=str)
    assert syncmers.fingerprint(frame.limit(0)).collect() == []
