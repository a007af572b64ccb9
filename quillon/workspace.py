"""A workspace: one root directory and its index, kept as segments of Parquet tables under a manifest."""
from __future__ import annotations

import hashlib
import json
import logging
import os
import shutil
import time
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.config import Config
from quillon.functions import text as T
from quillon.operators import index as tables
from quillon.operators import search
from quillon.operators.embed import EmbeddingCache, HashingEmbedder, embed_docs
from quillon.operators.index import Index
from quillon.sources import tree

LOG = logging.getLogger("quillon")
#: segments, and the share of replaced rows, beyond which a change compacts the index
MOST_SEGMENTS, MOST_DEAD = 8, 0.25


#: tables are read by these schemas, so that an empty one is a table too
SCHEMAS = {
    "docs": "doc_id string, path string, workspace string, content string, mtime long, size long, extension string, line_start long, line_end long, chunk_id string, parent_doc string, row_id string, dl long, part int",
    "postings": "term string, row_id string, part int, dl long, tf long, positions array<int>",
    "vectors": "doc_id string, embedding array<float>",
    "dead": "row_id string, dl long, chunk_id string",
}


class NotIndexed(RuntimeError):
    pass


def path_hash(path: str) -> str:
    return hashlib.sha256(path.encode()).hexdigest()[:16]


class Workspace:
    """The manifest lists the segments (generations) and holds what ranking needs: rows n and their tokens. A change writes
    the rows of changed files as a new segment, and the list of rows it replaces, without touching older tables."""

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, embedder=None):
        self.spark, self.root, self.config = spark, os.path.realpath(root), config or Config()
        self.embedder = embedder or HashingEmbedder()
        self.cache = EmbeddingCache(dim=getattr(self.embedder, "dim", 64))
        self.index_path = os.path.join(self.config.indexer.data_dir, path_hash(self.root))

    @classmethod
    def open(cls, spark, root, config=None, embedder=None):
        w = cls(spark, root, config, embedder)
        if not w.is_indexed:
            raise NotIndexed(f"{root} is not indexed")
        return w

    @classmethod
    def create(cls, spark, root, config=None, embedder=None):
        return cls(spark, root, config, embedder)

    @property
    def manifest(self) -> dict:
        try:
            with open(os.path.join(self.index_path, "workspace.json")) as f:
                return json.load(f)
        except FileNotFoundError:
            return {}

    is_indexed = property(lambda self: bool(self.manifest))
    stored_semantic_flag = property(lambda self: self.manifest.get("semantic"))
    has_semantic_index = property(lambda self: bool(self.manifest.get("semantic")))

    def _at(self, name: str, gen: int) -> str:
        return os.path.join(self.index_path, f"{name}-{gen}")

    def _all(self, name: str) -> list[DataFrame]:
        return [self._read(name, g) for g in self.manifest["segments"] if os.path.exists(self._at(name, g))]

    def _read(self, name: str, gen: int) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(self._at(name, gen))

    @property
    def index(self) -> Index:
        m = self.manifest
        dead = self._all("dead")
        return Index(self._all("docs"), reduce(DataFrame.unionByName, self._all("postings")), float(m["rows"]), m["tokens"] / m["rows"] if m["rows"] else 0.0,
                     reduce(DataFrame.unionByName, dead).select("row_id") if dead else None)

    def table(self, name: str) -> DataFrame:
        """docs or postings (living rows), or vectors (of living documents)."""
        if name == "vectors":
            v = reduce(DataFrame.unionByName, self._all("vectors"))
            return v.join(self.index.docs.select("doc_id").distinct(), "doc_id", "left_semi") if self._all("dead") else v
        return self.index.docs if name == "docs" else self.index.alive(self.index.postings)

    def _rows(self, files: DataFrame, gen: int) -> DataFrame:
        c = self.config.indexer
        ok = files.filter("status = 'ok'").filter(~T.any_glob(F.concat(F.lit("/"), F.col("path")), c.ignore_patterns))
        if c.include_extensions:
            ok = ok.filter(F.lower(T.extension(F.col("path"))).isin([e.lower().lstrip(".") for e in c.include_extensions]))
        if c.respect_gitignore:
            ok = ok.filter(~tree.gitignored(self.root, F.col("path")))
        doc_id = F.lpad(F.lower(F.hex(F.xxhash64("content"))), 16, "0")
        long = lambda x: F.lit(x).cast("long")
        base = ok.select(doc_id.alias("doc_id"), "path", F.lit(self.root).alias("workspace"), "content", "mtime", "size", T.extension(F.col("path")).alias("extension"),
                         long(1).alias("line_start"), F.size(T.lines(F.col("content"))).cast("long").alias("line_end"), F.lit("").alias("chunk_id"), F.lit("").alias("parent_doc"))
        # a file row and its chunks come from one pass over the content
        whole = F.struct(*[F.col(x) for x in base.columns])
        cid = lambda x: F.concat(F.col("doc_id"), F.lit(":"), x["chunk"].cast("string"))
        part = lambda x: F.struct(cid(x).alias("doc_id"), F.col("path"), F.col("workspace"), x["text"].alias("content"), long(0).alias("mtime"), F.octet_length(x["text"]).cast("long").alias("size"), F.lit("").alias("extension"),
                                  x["line_start"].cast("long").alias("line_start"), x["line_end"].cast("long").alias("line_end"), cid(x).alias("chunk_id"), F.col("doc_id").alias("parent_doc"))
        rows = base.select(F.explode(F.concat(F.array(whole), F.transform(T.chunk_spans(F.col("content"), c.chunk_size, c.chunk_overlap), part))).alias("r")).select("r.*")
        return rows.withColumn("row_id", F.concat_ws("#", "path", F.lpad(F.col("line_start").cast("string"), 9, "0"), "chunk_id", F.lit(str(gen))))

    def _counts(self, rows: DataFrame) -> tuple[int, int, int]:
        r = rows.agg(F.count("*"), F.sum("dl"), F.count_if(F.col("chunk_id") == "")).first()
        return r[0], r[1] or 0, r[2]

    def _write(self, docs: DataFrame, gen: int, semantic: bool, known: DataFrame | None = None) -> tuple[int, int, int]:
        os.makedirs(self.index_path, exist_ok=True)
        tables.write(docs, self._at("docs", gen), self._at("postings", gen))
        written = self._read("docs", gen)
        if semantic:
            todo = written if self.config.indexer.embed_chunks else written.filter("chunk_id = ''")
            if known is not None:
                todo = todo.join(known.select("doc_id"), "doc_id", "left_anti")  # contents seen before keep their vectors
            embed_docs(todo, self.embedder).write.mode("overwrite").parquet(self._at("vectors", gen))
        return self._counts(written)

    def _commit(self, **fields) -> None:
        """Swap the manifest by rename; tables of no listed segment go afterwards."""
        m = {"workspace": self.root, "indexed_at": datetime.now(UTC).isoformat(), **fields}
        tmp = os.path.join(self.index_path, ".workspace.json")
        with open(tmp, "w") as f:
            json.dump(m, f)
        os.replace(tmp, os.path.join(self.index_path, "workspace.json"))
        for x in os.listdir(self.index_path):
            if "-" in x and int(x.rpartition("-")[2]) not in m["segments"]:
                shutil.rmtree(os.path.join(self.index_path, x))

    def _files(self) -> DataFrame:
        return tree.files(self.spark, self.root, self.config.indexer.max_file_size, self.config.indexer.follow_symlinks)

    def index_all(self, semantic: bool | None = None) -> dict:
        """Replace the index by a snapshot of the tree; counts of what was met, skips by reason, and seconds."""
        begun = time.time()
        semantic = bool(self.stored_semantic_flag) if semantic is None else semantic
        gen = self.manifest.get("generation", 0) + 1
        os.makedirs(self.index_path, exist_ok=True)
        self._files().write.mode("overwrite").parquet(self._at("files", gen))  # the tree is read once
        files = self.spark.read.parquet(self._at("files", gen))
        rows, tokens, n = self._write(self._rows(files, gen), gen, semantic)
        by = {r["status"]: r["n"] for r in files.groupBy("status").agg(F.count("*").alias("n")).collect()}
        shutil.rmtree(self._at("files", gen))
        self._commit(files_indexed=n, semantic=semantic, generation=gen, segments=[gen], rows=rows, tokens=tokens)
        stats = {"indexed": n, "skipped": by.get("skipped", 0), "errors": by.get("error", 0), "binary": by.get("binary", 0),
                 "unique_paths": sum(v for k, v in by.items() if k not in tree.SKIPS), "skips": {k: v for k, v in by.items() if k in tree.SKIPS},
                 "embedded": self.table("vectors").count() if semantic else 0, "seconds": round(time.time() - begun, 2)}
        LOG.info("indexed %(indexed)d files, skipped %(skipped)d, errors %(errors)d in %(seconds)s s", stats)
        return stats

    def apply_changes(self, changes: DataFrame) -> None:
        """changes (seq, kind, path): the last event of a path wins. Changed files are read again, and only they; deleted ones
        go, with all below them if they were directories; other kinds change nothing."""
        m = self.manifest
        gen = m["generation"] + 1
        last = changes.filter(F.col("kind").isin("Changed", "Deleted", "DirDeleted")).groupBy("path").agg(F.max_by("kind", "seq").alias("kind"))
        os.makedirs(self.index_path, exist_ok=True)
        last.write.mode("overwrite").parquet(self._at("changes", gen))
        last = self.spark.read.parquet(self._at("changes", gen))
        narrow = self.index.docs.select("row_id", "dl", "chunk_id", "path")
        parts = F.split("path", "/", -1)
        above = narrow.withColumn("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))
        dead = narrow.join(last.select("path"), "path", "left_semi").unionByName(above.join(last.filter("kind <> 'Changed'").select("path"), "path", "left_semi"))
        dead.select("row_id", "dl", "chunk_id").distinct().write.mode("overwrite").parquet(self._at("dead", gen))
        gone = self._counts(self._read("dead", gen))
        listed = last.filter("kind = 'Changed'").select("path", F.lit(None).cast("string").alias("canonical"), F.lit(False).alias("is_symlink"), F.lit("ok").alias("status"))
        vectors = reduce(DataFrame.unionByName, self._all("vectors")) if m["semantic"] else None
        new = self._write(self._rows(tree.read_paths(listed, self.root, self.config.indexer.max_file_size), gen), gen, m["semantic"], vectors)
        shutil.rmtree(self._at("changes", gen))
        rows, tokens, n = (a - b + c for a, b, c in zip((m["rows"], m["tokens"], m["files_indexed"]), gone, new))
        self._commit(files_indexed=n, semantic=m["semantic"], generation=gen, segments=[*m["segments"], gen], rows=rows, tokens=tokens)
        held = sum(d.count() for d in self._all("dead"))
        if len(self.manifest["segments"]) > MOST_SEGMENTS or held > MOST_DEAD * max(1, rows + held):
            self.compact()

    def compact(self) -> None:
        """Rewrite the living rows as one segment; vectors are kept, not computed again."""
        m = self.manifest
        gen = m["generation"] + 1
        tables.write(self.index.docs.drop("dl", "part"), self._at("docs", gen), self._at("postings", gen))
        if m["semantic"]:
            self.table("vectors").write.mode("overwrite").parquet(self._at("vectors", gen))
        self._commit(**{k: m[k] for k in ("files_indexed", "semantic", "rows", "tokens")}, generation=gen, segments=[gen])

    def _apply(self, kind: str, paths) -> None:
        self.apply_changes(self.spark.createDataFrame([(i, kind, os.path.relpath(p, self.root)) for i, p in enumerate(paths)], "seq long, kind string, path string"))

    def index_file(self, *paths: str) -> None:
        self._apply("Changed", paths)

    def delete_file(self, *paths: str) -> None:
        self._apply("Deleted", paths)

    def delete_by_id(self, *doc_ids: str) -> None:
        """Delete the files of these contents, chunks included."""
        paths = self.index.docs.filter(F.col("doc_id").isin(list(doc_ids))).select("path").distinct()
        self.apply_changes(paths.select(F.lit(0).alias("seq"), F.lit("Deleted").alias("kind"), "path"))

    def create_watcher(self, checkpoint: str, trigger: dict | None = None):
        from quillon.streaming.watch import start

        return start(self, checkpoint, trigger)

    watch = create_watcher

    def embed_query(self, query: str) -> list[float]:
        """Through the cache; a query that cannot be embedded is the zero vector, which is near nothing."""
        def make(q):
            try:
                return self.embedder.embed(q)
            except Exception:  # noqa: BLE001  whatever a model raises
                LOG.warning("query could not be embedded")
                return [0.0] * self.cache_dim
        return self.cache.get_or_insert(query, make)

    @property
    def cache_dim(self) -> int:
        return getattr(self.embedder, "dim", 64)

    def search(self, query: str, limit=None, **kw) -> DataFrame:
        return search.search(self.index, query, limit, config=self.config.search, **kw)

    def search_filtered(self, query: str, limit=None, extensions=(), paths=(), use_regex=False, **kw) -> DataFrame:
        f = search.search_regex if use_regex else search.search
        return f(self.index, query, limit, extensions=extensions, paths=paths, config=self.config.search, **kw)

    def search_hybrid(self, query: str, limit=None, **kw) -> DataFrame:
        return search.search_hybrid(self.index, self.table("vectors"), query, self.embed_query(query), limit, config=self.config.search, **kw)

    def lookup(self, doc_id: str) -> DataFrame:
        """The row of a doc_id (the first of its paths), or none."""
        return self.index.docs.filter(F.col("doc_id") == doc_id).orderBy("path").limit(1)

    def details(self) -> dict:
        m = self.manifest
        terms = self.table("postings").agg(F.approx_count_distinct("term")).first()[0]
        return {**m, "size": directory_size(self.index_path), "terms": terms, "vectors": self.table("vectors").count() if m["semantic"] else 0}


def directory_size(path: str) -> int:
    return sum(os.path.getsize(os.path.join(d, y)) for d, _, ys in os.walk(path) for y in ys)


def list_indexes(config: Config) -> list[dict]:
    out = []
    root = config.indexer.data_dir
    for x in sorted(os.listdir(root)) if os.path.isdir(root) else []:
        p = os.path.join(root, x)
        if os.path.exists(os.path.join(p, "workspace.json")):
            with open(os.path.join(p, "workspace.json")) as f:
                m = json.load(f)
            out.append({"hash": x, "path": p, "workspace": m["workspace"], "size": directory_size(p), "semantic": m["semantic"], "orphan": not os.path.isdir(m["workspace"])})
    return out


def clean_indexes(config: Config) -> int:
    gone = [x for x in list_indexes(config) if x["orphan"]]
    for x in gone:
        shutil.rmtree(x["path"])
    return sum(x["size"] for x in gone)


def remove_index(config: Config, identifier: str) -> bool:
    found = list_indexes(config)
    hit = ([x for x in found if x["hash"] == identifier] or [x for x in found if x["workspace"] == os.path.realpath(identifier)] or [x for x in found if identifier in x["workspace"]])[:1]
    for x in hit:
        shutil.rmtree(x["path"])
    return bool(hit)
