import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon import cli, formats, workspace
from quillon.config import Config, IndexerConfig
from quillon.functions import text as T
from quillon.functions.regex_dialect import RegexError, to_java
from quillon.operators.embed import EmbeddingCache
from quillon.plans import catalogue
from quillon.sources import tree

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_queries_match_oracle(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    want, got = con.sql(catalogue.ORACLE_SQL[name]).df(), catalogue.QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    same = lambda d: d[cols].sort_values(cols).reset_index(drop=True).astype(str)
    assert same(want).equals(same(got))


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_tokens(spark):
    assert [(t.pos, t.term) for t in one(spark, T.tokens, "$obj->get('x')")] == [(0, "$obj-"), (1, "get"), (3, "x")]
    assert [(t.pos, t.term) for t in one(spark, T.tokens, "a (b")] == [(0, "a"), (2, "b")]
    assert len(one(spark, T.tokens, "a" * 99)) == 1 and not one(spark, T.tokens, "a" * 100)


def test_lines_and_chunks(spark):
    assert one(spark, T.lines, "foo\r\nbar\r\n\nbaz\r") == ["foo", "bar", "", "baz\r"]
    assert one(spark, T.lines, "") == [] and one(spark, T.lines, "\n") == [""]
    for n, want in ((50, []), (51, [(1, 50), (41, 51)]), (90, [(1, 50), (41, 90), (81, 90)])):
        assert [(c.line_start, c.line_end) for c in one(spark, T.chunk_spans, "\n".join("x" * n))] == want


def test_globs_hidden_bytes(spark):
    g = lambda p, s: one(spark, lambda c: T.glob(c, p), s)
    assert g("**/node_modules/**", "foo/node_modules/bar/baz.js") and g("**/.git/**", ".git/config") and g("*.log", "debug.log") and not g("*.log", "debug.txt")
    assert one(spark, T.hidden, "/foo/.git/config") and not one(spark, T.hidden, "/foo/bar/baz.rs")
    assert len(one(spark, lambda c: T.byte_cut(c, 99), "é" * 80)) == 49


def test_regex_dialect(spark):
    assert not one(spark, lambda c: F.rlike(c, F.lit(to_java("foo$"))), "foo\n")
    assert one(spark, lambda c: F.rlike(c, F.lit(to_java("É"))), "é")
    for bad in ("(", "(?=x)", r"(a)\1"):
        with pytest.raises(RegexError):
            to_java(bad)


def test_formats():
    hit = {"path": "a.rs", "line_start": 10, "line_end": 25, "snippet": "fn main", "score": 0.9}
    assert "a.rs:10 (100%)" in formats.format_ai([hit]) and formats.lines_str(5, 5) == "5" and "10-25" in formats.format_pretty([hit])


def lister(spark, root, **kw):
    return {r.path: r.status for r in tree.listing(spark, str(root), **kw).collect()}


def test_walk_skips_and_reasons(spark, tmp_path):
    root, other = tmp_path / "src", tmp_path / "other"
    for d in ("a/b", "build", ".git", "_priv"):
        (root / d).mkdir(parents=True)
    other.mkdir()
    for p in ("a/x.py", "a/b/y.py", "build/z.py", ".git/c.py", "_priv/__init__.py", ".env", "big.txt", "nul.bin", "Makefile"):
        (root / p).write_text("x = 1\n")
    (other / "far.py").write_text("far\n")
    (root / "big.txt").write_text("y" * 200)
    (root / "nul.bin").write_bytes(b"a\0b")
    os.symlink(root / "a/x.py", root / "link.py")
    os.symlink(root / "nowhere", root / "broken")
    os.symlink(root, root / "a/loop")
    os.symlink(other, root / "far")
    want = {"a/x.py": "ok", "a/b/y.py": "ok", "_priv/__init__.py": "ok", "big.txt": "ok", "nul.bin": "ok", "Makefile": "ok", "far/far.py": "ok",
            "link.py": "duplicate", "broken": "broken_symlink", "a/loop": "circular_symlink"}
    assert lister(spark, root) == want
    unfollowed = lister(spark, root, follow_symlinks=False)
    assert {k for k, v in unfollowed.items() if v == "symlink_not_followed"} == {"link.py", "broken", "a/loop", "far"}
    assert tree.symlink_targets(str(root)) == sorted([str(root), str(other)])
    read = {r.path: (r.status, r.content) for r in tree.files(spark, str(root), max_file_size=100).collect()}
    assert read["big.txt"] == ("skipped", None) and read["nul.bin"] == ("binary", None) and read["a/x.py"] == ("ok", "x = 1\n")
    assert not tree.watched("a/.b/c") and not tree.watched("vendor/x.py") and tree.watched("src/main.rs")
    assert tree.watch_indexable("a.RS") and not tree.watch_indexable("Makefile") and tree.under_root("/a/b/c", ["/a/b"]) and not tree.under_root("/a/bc", ["/a/b"])


def test_gitignore(spark, tmp_path):
    (tmp_path / ".gitignore").write_text("# note\n*.log\n/top.txt\ngen/\n!keep.log\ndocs/**/x.md\n")
    paths = ["a.log", "b/c.log", "keep.log", "top.txt", "b/top.txt", "gen/x.py", "b/gen/x.py", "docs/a/b/x.md", "docs/x.md", "generic.py"]
    f = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [r.path for r in f.filter(tree.gitignored(str(tmp_path), F.col("path"))).collect()]
    assert got == ["a.log", "b/c.log", "top.txt", "gen/x.py", "b/gen/x.py", "docs/a/b/x.md", "docs/x.md"]


def test_incremental_changes_rewrite_nothing_else(spark, tmp_path):
    root = tmp_path / "src"
    (root / "pkg/sub").mkdir(parents=True)
    long = "\n".join(f"line number {i} of text" for i in range(120))
    for i in range(4):
        (root / f"pkg/f{i}.py").write_text(f"alpha beta gamma {i}\n" * 3)
    (root / "pkg/sub/g.py").write_text(long)
    w = workspace.Workspace.create(spark, str(root), Config(indexer=IndexerConfig(data_dir=str(tmp_path / "data"))))
    assert w.index_all(semantic=True)["indexed"] == 5
    first = {f: os.stat(f).st_mtime_ns for f in glob.glob(w.index_path + "/*-1/**", recursive=True)}
    (root / "pkg/f1.py").write_text("delta epsilon\n" * 5)
    w.index_file(str(root / "pkg/f1.py"))
    assert w.manifest["segments"] == [1, 2] and all(os.stat(f).st_mtime_ns == t for f, t in first.items())
    fresh = workspace.Workspace.create(spark, str(root), Config(indexer=IndexerConfig(data_dir=str(tmp_path / "again"))))
    fresh.index_all(semantic=True)
    for q in ("delta", "alpha beta", "line number 7"):
        for kw in ({}, {"mode": "exact"}):
            key = lambda r: (r.path, r.line_start, r.line_end, r.score, r.snippet, r.is_chunk, r.match_line)
            assert sorted(map(key, w.search(q, 50, **kw).collect())) == sorted(map(key, fresh.search(q, 50, **kw).collect()))
    assert {r.path for r in w.search_hybrid("delta epsilon").collect()} >= {"pkg/f1.py"}
    assert any(r.is_chunk for r in w.search("line number 7", 50).collect())
    assert w.index.n == fresh.index.n and abs(w.index.avgdl - fresh.index.avgdl) < 1e-9
    w.delete_file(str(root / "pkg/sub"))  # a directory: all below it goes
    assert {r.path for r in w.table("docs").collect()} == {f"pkg/f{i}.py" for i in range(4)} and w.manifest["files_indexed"] == 4
    w.delete_by_id(w.table("docs").filter("path = 'pkg/f0.py'").first().doc_id)
    w.compact()
    assert len(w.manifest["segments"]) == 1 and {r.path for r in w.search("alpha", mode="exact").collect()} == {"pkg/f2.py", "pkg/f3.py"}
    assert w.lookup("none").count() == 0 and w.details()["files_indexed"] == 3
    w.delete_file(*[str(root / f"pkg/f{i}.py") for i in range(4)])
    assert w.search("alpha").collect() == [] and w.search_hybrid("alpha").collect() == [] and w.manifest["files_indexed"] == 0


def test_search_details(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "v.php").write_text("<?php\n\n\necho 1;\n$variable = 2;\n")
    (root / "w.rs").write_text("a foo-bar b\nfoo bar\n")
    w = workspace.Workspace.create(spark, str(root), Config(indexer=IndexerConfig(data_dir=str(tmp_path / "data"))))
    w.index_all(semantic=True)
    assert w.search("$variable").collect() == []  # the gate knows no such term
    hit = w.search("$variable", mode="exact").first()
    assert (hit.path, hit.line_start, hit.match_line) == ("v.php", 3, 5)
    assert w.search("->").collect() == [] and w.search("foo", -1).collect() == []
    got = w.search_hybrid("foo-bar").collect()
    assert {(r.path, r.match_type) for r in got} >= {("w.rs", "Text")} or {r.path for r in got} >= {"w.rs"}
    assert [r.path for r in w.search_filtered("^foo", use_regex=True, mode="exact").collect()] == ["w.rs"]
    assert w.search_filtered("^foo", use_regex=True).collect() == []
    w.embed_query("x"), w.embed_query("x")
    assert (w.cache.hits, w.cache.hit_rate > 0) == (1, True)


def test_embedding_cache():
    c = EmbeddingCache(max_bytes=2 * 4 * 3, dim=3)
    c.insert("hello", [1.0, 2.0, 3.0])
    assert c.get("hello") and c.get("world") is None and (c.hits, c.misses, len(c), c.hit_rate) == (1, 1, 1, 0.5)
    made = []
    for _ in range(2):
        c.get_or_insert("test", lambda t: made.append(t) or [0.0])
    c.insert("third", [1.0])
    assert made == ["test"] and len(c) == 2 and c.get("hello") is None


def test_command_line_shapes(spark, tmp_path, capsys):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text("alpha\n")
    config = Config(indexer=IndexerConfig(data_dir=str(tmp_path / "data")))
    run = lambda *a: (cli.main(["-C", str(root), *a], spark, config), capsys.readouterr().out)
    assert run("alpha")[0] == 1 and run("index")[0] == 0
    assert "a.py:1" in run("alpha")[1] and "[1.000000]" in run("search", "alpha", "--scores")[1]
    assert '"total": 1' in run("alpha", "--json", "-n", "5")[1] and "| alpha" in run("--pretty", "alpha")[1]
    assert "Indexed: yes" in run("status")[1] and "terms: 1" in run("status", "--detailed")[1]
    assert "1 indexes" in run("indexes", "list")[1] and run("indexes", "remove", "nothing")[0] == 1
    assert formats.format_size(1536) == "1.5 KB" and formats.format_size(1536, 2, "bytes") == "1.50 KB" and formats.format_size(5, 2, "bytes") == "5 bytes"
    assert formats.SearchResult([], 3).is_empty


def test_watch_events(spark, tmp_path):
    root = tmp_path / "src"
    (root / "d").mkdir(parents=True)
    (root / "d/a.py").write_text("x")
    (root / "notes").write_text("no extension")
    s = tree.TreeStream({"path": str(root)})
    rows, at = s.read(s.initialOffset())
    assert [r[1:3] for r in rows] == [("DirCreated", "d"), ("Changed", "d/a.py")]
    (root / "d/a.py").unlink()
    (root / "d").rmdir()
    rows, at = s.read(at)
    assert [r[1:3] for r in rows] == [("DirDeleted", "d"), ("Deleted", "d/a.py")]
    root.joinpath("notes").unlink()
    root.rmdir()
    assert [r[1] for r in s.read(at)[0]] == ["Error"]


def test_workspace(spark, tmp_path, capsys):
    root = tmp_path / "src"
    (root / "_priv").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "hello.rs").write_text('fn hello_world() { println!("Hello!"); }')
    (root / "_priv/__init__.py").write_text("import os\nhello = 1\n")
    (root / "node_modules/x.js").write_text("hello")
    (root / ".hidden").write_text("hello")
    (root / "bad.rs").write_bytes(b"\xff\xfe")
    os.symlink(root / "hello.rs", root / "link.rs")
    config = Config(indexer=IndexerConfig(data_dir=str(tmp_path / "data")))
    with pytest.raises(workspace.NotIndexed):
        workspace.Workspace.open(spark, str(root), config)
    w = workspace.Workspace.create(spark, str(root), config)
    stats = w.index_all(semantic=True)
    assert stats["indexed"] == 2 and stats["errors"] == 1
    assert {r.path for r in w.search("hello").collect()} == {"hello.rs", "_priv/__init__.py"}  # println!("Hello!") holds the token too
    assert {r.path for r in w.search("hello", mode="exact").collect()} == {"hello.rs", "_priv/__init__.py"}
    assert {r.path for r in w.search_filtered("^import", use_regex=True).collect()} == {"_priv/__init__.py"}
    assert w.search_hybrid("hello").count() >= 1
    (root / "new.py").write_text("hello again\n")
    os.remove(root / "_priv/__init__.py")
    q = w.watch(str(tmp_path / "cp"), {"processingTime": "0 seconds"})
    q.processAllAvailable()
    (root / "new.py").unlink()
    q.processAllAvailable()
    q.stop()
    w.delete_file(str(root / "_priv/__init__.py"), str(root / "new.py"))
    assert {r.path for r in w.table("docs").collect()} == {"hello.rs"}
    assert cli.main(["-C", str(root), "search", "hello_world"], spark, config) == 0
    assert "hello.rs" in capsys.readouterr().out
    assert len(workspace.list_indexes(config)) == 1 and workspace.remove_index(config, str(root))
