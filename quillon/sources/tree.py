"""Source trees as DataFrames: a batch source that lists files, executor-side reading, and a stream of changes.

Spark's own file lister drops names that begin with `_` and cannot report edits or deletions, hence these sources."""
from __future__ import annotations

import json
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from quillon.config import IGNORED_DIRS, TEXT_EXTENSIONS, TEXT_NAMES, WATCH_IGNORED_DIRS

LISTED = "path string, canonical string, is_symlink boolean, status string"
READ = "path string, canonical string, is_symlink boolean, mtime long, size long, content string, status string"
CHANGES = "seq long, kind string, path string, error string"
#: statuses of entries that are not files to read
SKIPS = ("circular_symlink", "symlink_not_followed", "broken_symlink", "duplicate", "not_found")


def _skip(name: str) -> bool:
    return name.startswith(".") or name in IGNORED_DIRS


def walk(root: str, top: str, follow: bool = True):
    """(absolute path, is_symlink, status) below root/top in name order. Hidden names and ignored directories are pruned; links
    that lead nowhere, back up or may not be followed are put out with the reason instead of 'ok'."""
    stack = [(os.path.join(root, top), ())]
    while stack:
        p, above = stack.pop()
        link = os.path.islink(p)
        if os.path.basename(p).startswith("."):
            continue
        if link and not follow:
            yield p, True, "symlink_not_followed"
        elif not os.path.exists(p):
            yield p, link, "broken_symlink" if link else "not_found"
        elif os.path.isdir(p):
            real = os.path.realpath(p)
            if real in above or (link and os.path.realpath(root).startswith(real.rstrip("/") + "/")) or real == os.path.realpath(root):
                yield p, link, "circular_symlink"
            elif not _skip(os.path.basename(p)):
                stack += [(os.path.join(p, x), (*above, real)) for x in sorted(os.listdir(p), reverse=True)]
        elif os.path.isfile(p):
            yield p, link, "ok"


def symlink_targets(root: str) -> list[str]:
    """Distinct directories that links below root lead to, but for those with an ignored name."""
    found = set()
    for at, dirs, _ in os.walk(root):
        for x in dirs:
            p = os.path.join(at, x)
            real = os.path.realpath(p)
            if os.path.islink(p) and os.path.isdir(real) and os.path.basename(real) not in WATCH_IGNORED_DIRS:
                found.add(real)
    return sorted(found)


def extension(path: str) -> str:
    name = os.path.basename(path)
    return name.rpartition(".")[2].lower() if "." in name[1:] else ""


def is_text(path: str, data: bytes) -> bool:
    return extension(path) in TEXT_EXTENSIONS or os.path.basename(path).lower() in TEXT_NAMES or b"\0" not in data[:8192]


def watch_indexable(path: str) -> bool:
    """The watcher's narrower test: by extension alone."""
    return extension(path) in TEXT_EXTENSIONS


def under_root(path: str, roots: list[str]) -> bool:
    return any(path == r or path.startswith(r.rstrip("/") + "/") for r in roots)


def watched(rel: str) -> bool:
    """No component of a path below a watched root is hidden or ignored."""
    return not any(x.startswith(".") or x in WATCH_IGNORED_DIRS for x in rel.split("/"))


def read_file(path: str, limit: int):
    size = os.path.getsize(path)
    if size > limit:
        return size, None, "skipped"
    try:
        with open(path, "rb") as f:
            data = f.read()
        return (size, data.decode("utf-8"), "ok") if is_text(path, data) else (size, None, "binary")
    except (OSError, UnicodeDecodeError):
        return size, None, "error"


class TreeReader(DataSourceReader):
    """Lists paths only. Top directories are opened on the driver until there are SPREAD of them, so one big directory is
    listed by many tasks; reading is spread by the rows themselves."""

    SPREAD = 64

    def __init__(self, options):
        self.root, self.follow = os.path.realpath(options["path"]), options.get("followsymlinks", "true") == "true"

    def partitions(self):
        tops, depth = sorted(os.listdir(self.root)), 0
        while len(tops) < self.SPREAD and depth < 4:
            opened = []
            for t in tops:
                p = os.path.join(self.root, t)
                plain = os.path.isdir(p) and not os.path.islink(p) and not _skip(os.path.basename(p))
                opened += [os.path.join(t, x) for x in sorted(os.listdir(p))] if plain else [t]
            if opened == tops:
                break
            tops, depth = opened, depth + 1
        return [InputPartition(x) for x in tops] or [InputPartition("")]

    def read(self, partition):
        if not partition.value:
            return
        for p, link, status in walk(self.root, partition.value, self.follow):
            yield os.path.relpath(p, self.root), os.path.realpath(p), link, status


class TreeStream(SimpleDataSourceStreamReader):
    """Each batch is the difference between two snapshots {path: mtime_ns, directories: -1}; the offset is the snapshot."""

    def __init__(self, options):
        self.root = os.path.realpath(options["path"])

    def initialOffset(self):
        return {"files": "{}"}

    def _snapshot(self):
        if not os.path.isdir(self.root):
            return {"": -2}
        seen = {}
        for root in [self.root, *[t for t in symlink_targets(self.root) if not under_root(t, [self.root])]]:
            for at, dirs, names in os.walk(root):
                dirs[:] = sorted(d for d in dirs if watched(d) and not os.path.islink(os.path.join(at, d)))
                for d in dirs:
                    seen[os.path.relpath(os.path.join(at, d), self.root)] = -1
                for x in names:
                    p = os.path.join(at, x)
                    if watched(x) and watch_indexable(p) and os.path.isfile(p):
                        seen[os.path.relpath(p, self.root)] = os.stat(p).st_mtime_ns
        return seen

    def _diff(self, start, end):
        old, new = json.loads(start["files"]), json.loads(end["files"])
        if new.get("") == -2:
            return [(0, "Error", "", f"{self.root} is gone")]
        rows = [("DirCreated" if new[p] == -1 else "Changed", p) for p in sorted(new) if old.get(p) != new[p]]
        rows += [("DirDeleted" if old[p] == -1 else "Deleted", p) for p in sorted(old) if p not in new and p]
        return [(i, k, p, None) for i, (k, p) in enumerate(rows)]

    def read(self, start):
        end = {"files": json.dumps(self._snapshot(), sort_keys=True)}
        return iter(self._diff(start, end)), end

    def readBetweenOffsets(self, start, end):
        return iter(self._diff(start, end))


class TreeSource(DataSource):
    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return LISTED if self.options.get("mode", "files") == "files" else CHANGES

    def reader(self, schema):
        return TreeReader(self.options)

    def simpleStreamReader(self, schema):
        return TreeStream(self.options)


def _regex(rule: str) -> str:
    """A rule of .gitignore as a regular expression over root-relative paths."""
    body = rule.strip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    anchored = "/" in rule.rstrip("/")
    return ("^" if anchored else "(?:^|/)") + out + ("/" if rule.endswith("/") else "(?:/|$)")


def gitignored(root: str, path):
    """Column: the root .gitignore drops the path; the last rule that fits decides. Rules become patterns on the driver."""
    file, out = os.path.join(root, ".gitignore"), F.lit(False)
    if os.path.exists(file):
        with open(file, encoding="utf-8", errors="replace") as f:
            for rule in (x.strip() for x in f):
                if rule and not rule.startswith("#"):
                    out = F.when(F.rlike(path, F.lit(_regex(rule.lstrip("!")))), F.lit(not rule.startswith("!"))).otherwise(out)
    return out


def read_paths(listed: DataFrame, root: str, max_file_size: int = 10 << 20) -> DataFrame:
    """LISTED rows -> READ rows. Files are read where the rows are, from a file system that all executors share; rows whose
    status is not 'ok', and files that cannot be read, have no content. A null canonical path is looked up; a link to a file
    that has a path of its own below root is its duplicate."""
    root = os.path.realpath(root)

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                p, stamp, size, content, status = os.path.join(root, r["path"]), 0, 0, None, r["status"]
                if r["canonical"] is None and status == "ok":
                    r["canonical"] = os.path.realpath(p)
                    if r["canonical"] != p and under_root(r["canonical"], [root]):
                        status = "duplicate"
                if status == "ok":
                    try:
                        stamp = int(os.path.getmtime(p))
                        size, content, status = read_file(p, max_file_size)
                    except OSError:
                        status = "not_found"
                row = [r["path"], r["canonical"], r["is_symlink"], stamp, size, content, status]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                                                 ["path", "canonical", "is_symlink", "mtime", "size", "content", "status"])
    return listed.select("path", "canonical", "is_symlink", "status").mapInArrow(run, READ)


def listing(spark: SparkSession, root: str, follow_symlinks: bool = True) -> DataFrame:
    """LISTED rows of all entries; of the paths to one canonical file the first non-link path is 'ok', the others 'duplicate'."""
    spark.dataSource.register(TreeSource)
    f = spark.read.format("source_tree").option("path", root).option("followSymlinks", str(follow_symlinks).lower()).load()
    first = Window.partitionBy("canonical", F.col("status") == "ok").orderBy("is_symlink", "path")
    again = (F.row_number().over(first) > 1) & (F.col("status") == "ok")
    return f.withColumn("status", F.when(again, "duplicate").otherwise(F.col("status")))


def files(spark: SparkSession, root: str, max_file_size: int = 10 << 20, follow_symlinks: bool = True) -> DataFrame:
    """READ rows of all entries below root."""
    return read_paths(listing(spark, root, follow_symlinks), root, max_file_size)
