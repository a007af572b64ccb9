"""python -m quillon.cli QUERY, or search|index|watch|status|indexes"""
from __future__ import annotations

import argparse
import logging
import sys
import time

from pyspark.sql import SparkSession

from quillon import formats
from quillon import workspace as ws
from quillon.config import Config

COMMANDS = ("search", "index", "watch", "status", "indexes")
WITH_VALUE = ("-C", "--workspace")


def _parser() -> argparse.ArgumentParser:
    every = argparse.ArgumentParser(add_help=False)  # accepted before and after the command
    keep = argparse.SUPPRESS
    every.add_argument("-C", "--workspace", dest="root", default=keep)
    every.add_argument("-v", "--verbose", action="store_true", default=keep)
    shape = every.add_mutually_exclusive_group()
    shape.add_argument("--json", action="store_true", default=keep)
    shape.add_argument("--pretty", action="store_true", default=keep)
    p = argparse.ArgumentParser(prog="quillon", parents=[every])
    sub = p.add_subparsers(dest="cmd", required=True)
    s = sub.add_parser("search", parents=[every])
    s.add_argument("query")
    s.add_argument("-n", "--limit", dest="n", type=int, default=100)
    s.add_argument("-e", "--ext", dest="e", action="append", default=[])
    s.add_argument("-p", "--path", dest="p", action="append", default=[])
    s.add_argument("-r", "--regex", dest="r", action="store_true")
    s.add_argument("--scores", action="store_true")
    s.add_argument("--text-only", action="store_true")
    s.add_argument("--exact", action="store_true")
    i = sub.add_parser("index", parents=[every])
    i.add_argument("path", nargs="?")
    i.add_argument("--rebuild", action="store_true")
    kind = i.add_mutually_exclusive_group()
    kind.add_argument("--semantic", action="store_true")
    kind.add_argument("--text", action="store_true")
    w = sub.add_parser("watch", parents=[every])
    w.add_argument("path", nargs="?")
    w.add_argument("--checkpoint", required=True)
    sub.add_parser("status", parents=[every]).add_argument("--detailed", action="store_true")
    x = sub.add_parser("indexes", parents=[every])
    x.add_argument("action", choices=["list", "clean", "remove"])
    x.add_argument("identifier", nargs="?")
    return p


def _with_command(argv: list[str]) -> list[str]:
    """A query without a command is a search."""
    i = 0
    while i < len(argv):
        if argv[i] in COMMANDS or argv[i] in ("-h", "--help"):
            return argv
        if not argv[i].startswith("-"):
            break
        i += 2 if argv[i] in WITH_VALUE else 1
    return ["search", *argv]


def main(argv=None, spark=None, config=None) -> int:
    a = _parser().parse_args(_with_command(list(sys.argv[1:] if argv is None else argv)))
    a = argparse.Namespace(**{"root": ".", "verbose": False, "json": False, "pretty": False, **vars(a)})
    if a.verbose:
        logging.basicConfig(level=logging.INFO, stream=sys.stderr)
    config = config or Config()
    if a.cmd == "indexes":
        if a.action == "list":
            found = ws.list_indexes(config)
            for r in found:
                print(r["hash"], formats.format_size(r["size"]), r["workspace"], "(orphan)" if r["orphan"] else "")
            print(f"{len(found)} indexes, {formats.format_size(sum(r['size'] for r in found))}" if found else "No indexes found.")
        elif a.action == "clean":
            print("freed", formats.format_size(ws.clean_indexes(config)))
        else:
            return 0 if a.identifier and ws.remove_index(config, a.identifier) else 1
        return 0
    spark = spark or SparkSession.builder.master("local[*]").getOrCreate()
    w = ws.Workspace(spark, getattr(a, "path", None) or a.root, config)
    if a.cmd == "index":
        stats = w.index_all(True if a.semantic else False if a.text or a.rebuild else None)
        print(f"{stats['indexed']} files in {stats['seconds']} s, {formats.format_size(ws.directory_size(w.index_path), 2, 'bytes')}", stats)
        return 0
    if not w.is_indexed:
        print(f"Workspace: {w.root}\nIndexed: no\nTo index it, run: index [--semantic]", file=sys.stderr)
        return 1
    if a.cmd == "status":
        print(formats.format_status(w.details() if a.detailed else w.manifest, a.detailed), end="")
    elif a.cmd == "watch":
        w.create_watcher(a.checkpoint).awaitTermination()
    else:
        t = time.time()
        if w.has_semantic_index and not a.text_only and not a.r and not a.exact:
            df = w.search_hybrid(a.query, a.n, extensions=a.e, paths=a.p)
        else:
            df = w.search_filtered(a.query, a.n, a.e, a.p, a.r, mode="exact" if a.exact else "gated")
        hits = formats.SearchResult.of(df).hits
        print(formats.format_json(hits, int(1000 * (time.time() - t))) if a.json else formats.format_pretty(hits) if a.pretty else formats.format_ai(hits, a.scores))
    return 0


if __name__ == "__main__":
    sys.exit(main())
