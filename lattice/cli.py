"""Commands over a store: ``python -m lattice --db PATH COMMAND ...``; results are lines of JSON."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import functions as F

from lattice.operators import library as L
from lattice.operators import reports as R
from lattice.schema import PRODUCT, PROFILE
from lattice.session import local_session
from lattice.sources import files, pages, products, sessions, transcripts
from lattice.tools import Engine, rows

Run = Callable[[Engine, argparse.Namespace], object]


def _roots(a: argparse.Namespace) -> dict[str, str]:
    """name=path pairs; a bare path is named by its last part."""
    pairs = (x.partition("=") for x in a.roots)
    return {name if sep else name.rstrip("/").rsplit("/", 1)[-1]: path if sep else name for name, sep, path in pairs}


def _tree(e: Engine, a: argparse.Namespace):
    return files.read_tree(e.spark, _roots(a))


def _sessions(e: Engine, a: argparse.Namespace) -> list[dict]:
    return e.scan_sessions(sessions.read_lines(e.spark, a.root, a.project))


def _watch(e: Engine, a: argparse.Namespace) -> dict:
    q = e.watch(_roots(a), a.gap, a.once, a.today)
    try:
        q.awaitTermination()
    except KeyboardInterrupt:
        q.stop()
    return rows(e.watched.read().agg(F.countDistinct("file").alias("files"), F.count("*").alias("chunks")))[0]


def _xray(e: Engine, a: argparse.Namespace) -> dict:
    tree = _tree(e, a)
    return {"projects": rows(files.registry(tree)), "files": rows(files.scan_files(tree).groupBy("project", "lang").agg(F.count("*").alias("files"), F.sum("lines").alias("lines")).orderBy("project", "lang"))}


def _videos(e: Engine, a: argparse.Namespace) -> dict:
    v = e.spark.read.schema("video_id STRING, title STRING, url STRING, source_name STRING, description STRING, created STRING, duration_seconds BIGINT, vtt STRING").json(a.path)
    chunks = transcripts.video_chunks(v)
    e.index_videos(v.drop("vtt", "duration_seconds"), chunks, a.topics or ())
    return {"videos": e.store.read("videos").count(), "chunks": e.store.read("video_chunks").count()}


def _leads(e: Engine, a: argparse.Namespace) -> list[dict]:
    out = R.leads(files.json_lines(e.spark, a.products, PRODUCT), files.json_lines(e.spark, a.profiles, PROFILE), points=(a.min_points, a.max_points), upvotes=(a.min_upvotes, a.max_upvotes), role=a.role)
    if a.csv:
        files.write_csv(out, a.csv)
    return rows(out)


def _product_docs(e: Engine, a: argparse.Namespace):
    return products.product_docs(files.json_lines(e.spark, a.path, PRODUCT), a.source, a.source, a.home)


def _startup_docs(e: Engine, a: argparse.Namespace):
    found = products.startup_pages(files.json_lines(e.spark, a.path, "url STRING, html STRING"))
    for c in ("description", "founder_x"):
        found = found.withColumn(c, F.lit(None).cast("string"))
    return products.startup_docs(found, a.source, a.source, a.home).withColumn("popularity", F.lit(0).cast("bigint"))


def _import_products(e: Engine, a: argparse.Namespace) -> dict:
    merged = products.merge_dumps([files.json_lines(e.spark, p, PRODUCT) for p in a.paths])
    merged.write.mode("overwrite").json(a.out)
    return {"products": files.json_lines(e.spark, a.out, PRODUCT).count(), **rows(products.rejected(merged))[0]}


def _compact(e: Engine, a: argparse.Namespace) -> list[dict]:
    notes = e.store.read("notes").withColumn("created", F.try_to_timestamp("created", F.lit("yyyy-MM-dd")).cast("date")).withColumn("n_chars", F.length("content"))
    return rows(R.compaction_candidates(notes, F.lit(a.today).cast("date"), days=a.days, chars=a.chars, every=a.all).select("file", "title", "status", "created").orderBy("file"))


#: command: (what it does, arguments as (name, options), how)
COMMANDS: dict[str, tuple[str, tuple, Run]] = {
    "scan": ("source trees and their commit logs into the graph", (("roots", {"nargs": "+"}), ("--deep", {"action": "store_true"})), lambda e, a: e.scan(_roots(a), a.deep)),
    "query": ("a read-only statement", (("text", {}),), lambda e, a: e.query(a.text)),
    "stats": ("counts by label and edge type", (), lambda e, a: e.stats()),
    "files": ("files of a project", (("project", {}),), lambda e, a: rows(L.files_by_project(e.graph(), a.project))),
    "deps": ("packages of a project", (("project", {}),), lambda e, a: rows(L.deps_by_project(e.graph(), a.project))),
    "shared": ("packages of several projects", (), lambda e, a: e.shared()),
    "imports": ("import edges of a project", (("project", {}),), lambda e, a: rows(L.import_graph(e.graph(), a.project))),
    "callers": ("callers of a symbol", (("symbol", {}), ("--project", {})), lambda e, a: rows(L.callers_of(e.graph(), a.symbol, a.project))),
    "hierarchy": ("parents and children of a class", (("name", {}), ("--project", {})), lambda e, a: rows(L.class_hierarchy(e.graph(), a.name, a.project))),
    "explain": ("architecture of a project", (("project", {}),), lambda e, a: e.explain(a.project)),
    "repomap": ("most connected files and their symbols", (("project", {}), ("-n", {"type": int, "default": 20})), lambda e, a: e.repomap(a.project, files_=a.n)),
    "diagram": ("a chart of edges", (("project", {}), ("--kind", {"default": "deps", "choices": ["deps", "imports", "calls", "inheritance"]})), lambda e, a: e.diagram(a.project, a.kind)),
    "projects": ("stored projects", (("name", {"nargs": "?"}),), lambda e, a: e.project_info(a.name)),
    "portfolio": ("counts of every project", (), lambda e, a: e.portfolio()),
    "xray": ("stacks and languages of trees, nothing stored", (("roots", {"nargs": "+"}),), _xray),
    "scan-sessions": ("chat logs into the graph and index", (("root", {}), ("--project", {})), _sessions),
    "sessions": ("sessions of a project", (("project", {}), ("-n", {"type": int, "default": 20})), lambda e, a: rows(L.sessions_by_project(e.graph(), a.project, a.n))),
    "session-files": ("files of a session", (("session", {}),), lambda e, a: rows(L.files_in_session(e.graph(), a.session))),
    "file-sessions": ("sessions of a file", (("path", {}), ("-n", {"type": int, "default": 20})), lambda e, a: rows(L.sessions_for_file(e.graph(), a.path, a.n))),
    "session-search": ("search of sessions; --logs fills an empty index first", (("text", {}), ("-n", {"type": int, "default": 5}), ("--project", {}), ("--logs", {})), lambda e, a: e.session_search(a.text, a.n, a.project, sessions.read_lines(e.spark, a.logs) if a.logs else None)),
    "index-projects": ("chunks of code and documents", (("roots", {"nargs": "+"}),), lambda e, a: e.index_code(_tree(e, a))),
    "project-search": ("search of chunks", (("text", {}), ("-n", {"type": int, "default": 5}), ("--project", {}), ("--type", {}), ("--siblings", {"action": "store_true"})), lambda e, a: e.code_search(a.text, a.n, a.project, a.type, a.siblings)),
    "project-collections": ("indexed projects", (), lambda e, a: e.collections()),
    "project-delete": ("a project's chunks", (("project", {}),), lambda e, a: e.delete_collection(a.project)),
    "index-kb": ("notes into the index", (("roots", {"nargs": "+"}), ("--today", {"default": ""}), ("--force", {"action": "store_true"})), lambda e, a: e.index_notes(_tree(e, a), a.today, a.force)),
    "watch": ("follow trees of notes until stopped", (("roots", {"nargs": "+"}), ("--gap", {"type": int, "default": 1500}), ("--once", {"action": "store_true"}), ("--today", {})), _watch),
    "watch-search": ("full-text search of watched trees", (("text", {}), ("-n", {"type": int, "default": 5})), lambda e, a: e.watched_search(a.text, a.n)),
    "kb-search": ("search of notes", (("text", {}), ("-n", {"type": int, "default": 5}), ("--type", {}), ("--adjacency", {})), lambda e, a: e.notes_search(a.text, a.n, a.type, e.adjacency(a.adjacency) if a.adjacency else None)),
    "kb-stats": ("counts of notes", (), lambda e, a: e.notes_stats()),
    "index-videos": ("videos with subtitles, from JSON lines", (("path", {}), ("--topics", {"nargs": "*"})), _videos),
    "source-search": ("search of documents and videos", (("text", {}), ("-n", {"type": int, "default": 5}), ("--source", {})), lambda e, a: e.source_search(a.text, a.n, a.source)),
    "source-list": ("sources and their counts", (), lambda e, a: e.source_list()),
    "source-tags": ("tags and their use", (), lambda e, a: e.source_tags()),
    "source-related": ("videos with common tags", (("video", {}), ("-n", {"type": int, "default": 5})), lambda e, a: e.source_related(a.video, a.n)),
    "source-delete": ("a source's documents", (("source", {}),), lambda e, a: e.delete_source(a.source)),
    "index-products": ("products from JSON lines as documents", (("path", {}), ("source", {}), ("--home", {"default": ""})), lambda e, a: e.index_source(_product_docs(e, a))),
    "index-startups": ("stored startup pages (url and html, JSON lines) as documents", (("path", {}), ("source", {}), ("--home", {"default": ""})), lambda e, a: e.index_source(_startup_docs(e, a))),
    "import-products": ("dumps of products, the newest first, merged into one file of JSON lines", (("paths", {"nargs": "+"}), ("--out", {"required": True})), _import_products),
    "makers": ("profiles from JSON lines, linked to products", (("path", {}), ("source", {})), lambda e, a: e.index_makers(files.json_lines(e.spark, a.path, PROFILE), a.source)),
    "maker-products": ("products of a profile", (("username", {}),), lambda e, a: e.maker_products(a.username)),
    "hotfiles": ("most changed files", (("project", {}), ("-n", {"type": int, "default": 10})), lambda e, a: rows(L.hotfiles(e.graph(), a.project, a.n))),
    "compact": ("notes that are old or long", (("today", {}), ("--days", {"type": int, "default": 90}), ("--chars", {"type": int, "default": 3000}), ("--all", {"action": "store_true"})), _compact),
    "init": ("an empty store", (), lambda e, a: e.stats() if e.store.names() else (e.save(e.graph()), e.stats())[1]),
    "stacks": ("stack templates of a folder", (("folder", {}),), lambda e, a: rows(pages.stack_templates(e.spark, a.folder))),
    "leads": ("people of products and their profiles", (("products", {}), ("profiles", {}), ("--csv", {}), ("--role", {}), ("--min-points", {"type": int, "default": 5}), ("--max-points", {"type": int, "default": 1000}), ("--min-upvotes", {"type": int, "default": 5}), ("--max-upvotes", {"type": int, "default": 700})), _leads),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lattice", description=__doc__)
    p.add_argument("--db", default="lattice-store", help="folder or URI of the store")
    sub = p.add_subparsers(dest="command", required=True)
    for name, (text, arguments, run) in COMMANDS.items():
        c = sub.add_parser(name, help=text)
        for flag, options in arguments:
            c.add_argument(flag, **options)
        c.set_defaults(run=run)
    return p


def main(argv: Sequence[str] | None = None, engine: Engine | None = None) -> int:
    a = parser().parse_args(argv)
    e = engine or Engine(local_session("cli"), a.db)
    out = a.run(e, a)
    for line in out if isinstance(out, list) else [out]:
        print(line if isinstance(line, str) else json.dumps(line, ensure_ascii=False, default=str), file=sys.stdout)
    return 0
