import random
import re

from quillon.llm import quotes

KIND = "conv_id long, turn long, role string, text string"


def linked(spark, rows):
    return quotes.link_quotes(spark.createDataFrame(rows, KIND)).collect()


def test_trimmed_quotes_link(spark):
    texts = ["first line\nsecond line\nthird line", "Para one.\n\nPara two.\n\nPara three.", "> second line\n> third line\nok", "> Para one.\n>\n> Para two.\nyes",
             "second line\nand something rather longer here\nend", "> second line\n> and something rather longer here\nhm", "> nobody said\n>\t\n> this\nx"]
    m = {r.turn: r for r in linked(spark, [(1, i, "user", t) for i, t in enumerate(texts)])}
    assert [m[i].reply_to for i in range(7)] == [None, None, 0, 1, None, 4, None]
    assert [(m[i].root, m[i].depth) for i in (2, 3, 5, 6)] == [(0, 1), (1, 1), (4, 1), (6, 0)]


def plain(c):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", c).strip(" ").lower()


def units(c):
    return {u for u in [c, *re.split(r"\n[ \t\n\x0b\f\r]*\n", c), *c.split("\n")] if u.strip()}


def model(rows):
    """conv -> turn -> (content, n_quotes, levels, reply_to, root, depth, position), for unique turns."""
    out = {}
    for conv in {c for c, *_ in rows}:
        msgs, origin, quoted = {}, {}, {}
        for _, turn, _, text in sorted(r for r in rows if r[0] == conv):
            lv = []
            for line in re.split(r"\r?\n", text or ""):
                mark = re.match(r"(?:[ \t]*>)+", line)
                lv.append((mark[0].count(">") if mark else 0, re.sub(r"^(?:[ \t]*>)+ ?", "", line)))
            runs = []
            for n, b in lv:
                if runs and runs[-1][0] == n:
                    runs[-1][1].append(b)
                else:
                    runs.append((n, [b]))
            quoted[turn] = [(n, "\n".join(b)) for n, b in runs if n and "".join(b).strip()]
            content = "\n".join(b for n, b in lv if n == 0 and not re.match(r"On .* wrote:\s*$", b)).strip(" \n")
            msgs[turn] = [content, len(quoted[turn]), max(n for n, _ in lv)]
            for u in units(content):
                origin.setdefault(plain(u), turn)
        parent = {}
        for turn, qs in quoted.items():
            got = {}
            for key in {(n, plain(u)) for n, b in qs for u in units(b)}:
                o = origin.get(key[1])
                if o is not None and o < turn:
                    got.setdefault((key[0], o), []).append(len(key[1]))
            if got:
                parent[turn] = max((-n, max(v), sum(v), o) for (n, o), v in got.items())[3]
        kids = {}
        for t in sorted(parent):
            kids.setdefault(parent[t], []).append(t)
        place = {}
        for root in [t for t in msgs if t not in parent]:
            todo, at = [(root, 0)], 0
            while todo:
                t, d = todo.pop()
                place[t] = (root, d, at)
                at += 1
                todo += [(k, d + 1) for k in reversed(kids.get(t, []))]
        out |= {(conv, t): (*m, parent.get(t), *place[t]) for t, m in msgs.items()}
    return out


def test_conversations_match_the_model(spark):
    r = random.Random(31)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randrange(1, 4)))
    rows = []
    for conv in range(25):
        past = []
        for turn in r.sample(range(5000), r.randrange(1, 40)):
            past.append(turn)
        past.sort()
        texts = {}
        for turn in past:
            body = "\n".join(" ".join(word() for _ in range(r.randrange(1, 6))) if r.random() > 0.15 else "" for _ in range(r.randrange(1, 6)))
            if texts and r.random() < 0.8:
                for src in r.sample(sorted(texts), min(len(texts), r.choice([1, 1, 2]))):
                    old = texts[src].split("\n")
                    lo = r.randrange(len(old))
                    body = "On day x wrote:\n" * (r.random() < 0.3) + "\n".join(r.choice(["> ", ">", " > "]) + x.upper() for x in old[lo : lo + r.randrange(1, 6)]) + r.choice(["\n", "\r\n"]) + body
            texts[turn] = body
            rows.append((conv, turn, "user", body))
    want = model(rows)
    got = {(x.conv_id, x.turn): tuple(x)[3:] for x in linked(spark, rows)}
    assert sum(w[3] is not None for w in want.values()) > 150 and max(w[5] for w in want.values()) > 5
    assert got == want


def test_reply_order_of_a_long_chain_and_a_popular_message(spark):
    edges = [(1, i, i - 1) for i in range(1, 300)] + [(2, i, 0) for i in range(1, 3000, 2)] + [(2, i + 1, i) for i in range(1, 3000, 2)]
    got = {(x.conv_id, x.turn): (x.root, x.depth, x.position) for x in quotes.reply_order(spark.createDataFrame(edges, "conv_id long, turn long, reply_to long")).collect()}
    assert got == {(1, i): (0, i, i) for i in range(300)} | {(2, i): (0, (1 if i % 2 else 2) if i else 0, i) for i in range(3001)}


def test_odd_messages(spark):
    long = "\n".join(("> " if i % 2 else "") + f"line {i}" for i in range(4000))
    rows = [(1, 0, "user", "hello there"), (1, 1, "user", "> hello there\nyes"), (1, 1, "user", "> hello there\nyes"), (1, None, None, "> hello there"), (None, 2, "user", "> hello there\nyes"),
            (None, None, None, None), (1, 3, "user", ""), (2, 0, "user", long)]
    f = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS lines", "2 AS runs", "3 AS root", "4 AS content")
    got = sorted(((str(x.conv_id), str(x.turn)), x.reply_to, x.depth, x.position) for x in quotes.link_quotes(f).collect())
    assert got == sorted([(("1", "0"), None, 0, 0), (("1", "1"), 0, 1, 1), (("1", "1"), 0, 1, 1), (("1", "None"), None, 0, 0), (("None", "2"), None, 0, 0), (("None", "None"), None, 0, 0), (("1", "3"), None, 0, 0), (("2", "0"), None, 0, 0)], key=str)
    assert quotes.link_quotes(f.limit(0)).collect() == []
