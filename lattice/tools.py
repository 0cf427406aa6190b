"""The tool layer: one function for each tool and command, over a catalog of tables.

Results are plain lists and dicts, as a tool protocol carries them; everything before the last step
is a plan. Text limits are those of the tools' results.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lattice import cypher, schema
from lattice.functions import strings as S
from lattice.operators import chunking as C
from lattice.operators import library as L
from lattice.operators import profiles as M
from lattice.operators import reports as R
from lattice.operators import text as X
from lattice.operators import vectors as V
from lattice.operators.dml import Store, append_edges, clear_projects, number_edges, upsert_counts
from lattice.operators.graph import Graph, neighbours
from lattice.operators.joins import missing, related_by_tag, with_siblings
from lattice.operators.segments import Segments
from lattice.sources import code, files, gitlog, manifests, notes, sessions
from lattice.streaming.keyed import ChunkIndex, follow, keyed_changes, with_text
from lattice.streaming.tree import tree_changes

#: Lengths of texts in results, and the expansion's seeds.
SNIPPET, CODE_SNIPPET, CONTEXT, FETCHED = 300, 500, 1000, 8000
EXPANDED = 3


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


@dataclass
class Engine:
    """A store of tables, a graph over them, and the embedder that queries and documents share."""

    spark: SparkSession
    root: str
    embedder: Callable[[str], list[float]] = X.hash_embedding
    _cache: dict[str, Graph] = field(default_factory=dict)

    @property
    def store(self) -> Store:
        return Store(self.spark, self.root)

    # --- graph store
    @staticmethod
    def _edge_name(t: tuple[str, str, str]) -> str:
        return "edge_" + "__".join(t)

    def graph(self) -> Graph:
        """The code graph as stored; labels and types without a table are empty."""
        s = self.store
        nodes = {k: s.read(f"node_{k}", ddl) for k, ddl in schema.NODES.items()}
        edges = {t: s.read(self._edge_name(t), f"{ddl}, eid BIGINT" if t in schema.NUMBERED else ddl) for t, ddl in schema.EDGES.items()}
        return Graph(self.spark, nodes, edges)

    def save(self, g: Graph) -> None:
        for k, df in g.nodes.items():
            self.store.write(f"node_{k}", df)
        for t, df in g.edges.items():
            self.store.write(self._edge_name(t), df)

    def scan(self, roots: Mapping[str, str], deep: bool = False, log: DataFrame | None = None) -> list[dict]:
        """Scans source trees into the graph, all projects in one plan; returns the graph's statistics."""
        tree = files.read_tree(self.spark, roots)
        return self.scan_tree(tree, deep, gitlog.read_log(self.spark, dict(roots)) if log is None else log)

    def scan_tree(self, tree: DataFrame, deep: bool = False, log: DataFrame | None = None) -> list[dict]:
        g = self.graph()
        nodes, edges = clear_projects(g.nodes, g.edges, tree.select("project").distinct())
        f = files.scan_files(tree)
        source = tree.withColumn("lang", files.language(F.col("path"))).where(F.col("lang").isNotNull() & files.scannable(F.col("path")))
        records = code.parse(source, deep)
        sym = code.symbols(records)
        deps = manifests.scan_dependencies(tree)
        pk, dep = manifests.packages(deps)
        reg = files.registry(tree)
        project = reg.select(F.col("project").alias("id"), F.col("project").alias("name"), F.array_join("stacks", ",").alias("stack"), F.lit("").alias("path"), "status", "has_claude_md", F.substring("description", 1, 200).alias("description"))
        new_nodes = {"Project": project, "File": f, "Symbol": sym, "Package": pk}
        new_edges = {
            ("Project", "HAS_FILE", "File"): f.select(F.col("project").alias("src"), F.col("id").alias("dst")),
            ("File", "DEFINES", "Symbol"): sym.select(F.concat_ws("|", "project", "file").alias("src"), F.col("id").alias("dst")),
            ("Project", "DEPENDS_ON", "Package"): dep,
        }
        if log is not None:
            new_edges[("File", "MODIFIED", "File")] = gitlog.modified_edges(gitlog.parse_log(log), f)
        if deep:
            new_edges[("File", "IMPORTS", "File")], new_edges[("File", "IMPORTS", "Package")] = code.import_edges(records, f, pk)
            new_edges[("File", "CALLS", "Symbol")] = code.call_edges(records, sym)
            new_edges[("Symbol", "INHERITS", "Symbol")] = code.inherit_edges(records, sym)
        merged = dict(nodes)
        for label, df in new_nodes.items():
            merged[label] = missing(nodes[label], df, ["id"]).unionByName(df.select(*nodes[label].columns))
        joined = dict(edges)
        for t, df in new_edges.items():
            if t in schema.NUMBERED:
                joined[t] = append_edges(number_edges(edges[t]), df)
            else:
                joined[t] = edges[t].unionByName(df.select(*edges[t].columns)).dropDuplicates(["src", "dst"])
        self.save(Graph(self.spark, merged, joined))
        return rows(self.graph().stats().orderBy("kind", "name"))

    def query(self, text: str, params: Mapping[str, object] | None = None) -> list[dict]:
        """Any read-only statement; values by position."""
        return cypher.positional(cypher.run(self.graph(), text, params))

    def stats(self) -> dict:
        s = rows(self.graph().stats())
        return {**{r["name"]: r["n"] for r in s if r["kind"] == "node"}, "edges": {r["name"]: r["n"] for r in s if r["kind"] == "edge"}}

    def shared(self) -> list[dict]:
        return rows(L.shared_packages(self.graph()))

    def explain(self, project: str) -> dict | str:
        out = R.overview(self.graph(), project)
        return out if out is not None else f"Project '{project}' not found in graph."

    def repomap(self, project: str, lines: DataFrame | None = None, files_: int = 20) -> str:
        return R.repomap_yaml(R.repomap(self.graph(), project, lines, files_))

    def diagram(self, project: str, kind: str = "deps", most: int = 40) -> str:
        return R.diagram(self.graph(), kind, project, most)

    def project_info(self, name: str | None = None) -> list[dict]:
        p = self.graph().node("Project").drop("id")
        return rows((p if name is None else R.resolve_project(p, name)).orderBy("name"))

    def portfolio(self) -> list[dict]:
        return rows(R.portfolio(self.graph()))

    # --- notes
    def index_notes(self, tree: DataFrame, today: str, force: bool = False) -> dict:
        """Brings the note index up to date; counts of new, updated and unchanged notes."""
        from lattice.streaming.incremental import refresh

        docs = X.embed(notes.scan_notes(tree, today), "text")
        counts = {r["status"]: r["n"] for r in rows(refresh(self.store, "notes", docs, force=force))}
        if set(counts) - {"unchanged"} or not self.store.version("notes_terms"):
            self.store.write("notes_terms", X.inverted_index(self.store.read("notes"), "doc_id", "text"), ["bucket"])
        return counts

    def notes_search(self, query: str, n: int = 5, doc_type: str | None = None, adjacency: DataFrame | None = None) -> list[dict]:
        """Hybrid search with synthetic distances by rank; neighbours of the best results follow with relevance 0."""
        docs = self.store.read("notes")
        where = None if doc_type is None else F.col("doc_type") == doc_type
        hits = X.hybrid(docs.withColumnRenamed("text", "__text"), query, self.embedder(query), n, key="doc_id", text="__text", where=where, index=self.store.read("notes_terms") if self.store.version("notes_terms") else None).select("doc_id", "rank")
        shown = ["file", "title", F.col("doc_type").alias("type"), "tags"]
        own = hits.join(docs, "doc_id").select("rank", *shown, F.substring("content", 1, SNIPPET).alias("snippet"), (1 - (F.col("rank") - 1) * 0.1).alias("relevance"))
        out = [{k: v for k, v in r.items() if k != "rank"} for r in rows(own.orderBy("rank"))]
        if adjacency is not None:
            near = neighbours(hits.select(F.col("doc_id").alias("id"), "rank"), adjacency, EXPANDED)
            more = near.join(docs, F.col("id") == F.col("doc_id")).orderBy("via_rank", "file").select(*shown, F.substring("content", 1, SNIPPET).alias("snippet"), F.lit(0.0).alias("relevance"), F.col("via").alias("graph_source"))
            out += rows(more)
        return out

    def notes_stats(self) -> dict:
        s = rows(notes.note_stats(self.store.read("notes")))
        pick = lambda k: {r["name"]: r["n"] for r in s if r["section"] == k}
        return {"total_documents": pick("total").get("documents", 0), "by_type": pick("type"), "unique_tags": pick("tags").get("unique", 0)}

    def adjacency(self, path: str) -> DataFrame:
        """src, dst and type of a JSON file of nodes and edges."""
        f = self.spark.read.schema("nodes ARRAY<STRUCT<id: STRING>>, edges ARRAY<STRUCT<source: STRING, target: STRING, type: STRING>>").option("multiLine", True).json(path)
        return f.select(F.explode("edges").alias("e")).select(F.col("e.source").alias("src"), F.col("e.target").alias("dst"), "e.type")

    # --- code chunks
    @property
    def _chunks(self) -> Segments:
        return Segments(self.spark, f"{self.root}/code_chunks", "uid", {"chunks": []})

    def chunks(self) -> DataFrame | None:
        """The live chunks of all projects, or None before the first."""
        return self._chunks.read("chunks")

    def index_code(self, tree: DataFrame) -> dict:
        """Brings the chunks of the tree's projects up to date: files that are new or changed are cut and embedded, those that are gone leave.

        What is written grows with what changed. Counts of all live chunks.
        """
        own = tree.withColumn("language", files.language(F.col("path"), documents=True)).where(F.col("language").isNotNull() & files.scannable(F.col("path")) & ~S.looks_binary(F.col("text")))
        own = own.withColumn("digest", F.sha2("text", 256))
        known, new = self.chunks(), own
        gone: DataFrame | None = None
        if known is not None:
            old = known.select("uid", "project", F.col("file").alias("path"), "digest")
            # a file whose chunks lie there with its digest is left alone
            new = own.join(old.select("project", "path", "digest"), ["project", "path", "digest"], "left_anti")
            gone = old.join(tree.select("project").distinct(), "project", "left_semi").join(own.select("project", "path", "digest"), ["project", "path", "digest"], "left_anti").select("uid")
        kind = F.when(F.col("language") == "markdown", C.MARKDOWN).otherwise(C.CODE)
        parts = C.chunked(new.select("project", "path", "language", "digest", "text"), "text", kind)
        rel = parts.select(
            F.concat_ws("|", "project", F.col("digest"), "path", F.col("raw_index").cast("string")).alias("uid"), F.concat("path", F.lit("::chunk_"), F.col("raw_index").cast("string")).alias("id"), "project", F.col("path").alias("file"), "language", "digest",
            F.when(F.col("language") == "markdown", "doc").otherwise("code").alias("chunk_type"), F.col("raw_index").cast("bigint").alias("chunk_index"), F.col("total").cast("bigint").alias("total_chunks"), "heading", "start_line", "end_line", "text",
        )
        self._chunks.write({"chunks": X.embed(rel, "text")}, gone)
        self._chunks.compact()
        return rows(self.chunks().agg(F.countDistinct("project", "file").alias("files"), F.count("*").alias("chunks"), F.count_if(F.col("chunk_type") == "code").alias("code_chunks"), F.count_if(F.col("chunk_type") == "doc").alias("doc_chunks")))[0]

    def code_search(self, query: str, n: int = 5, project: str | None = None, chunk_type: str | None = None, siblings: bool = False, bootstrap: DataFrame | None = None) -> list[dict]:
        """The nearest chunks of one project or all; an empty index is filled from ``bootstrap`` first."""
        c = self.chunks()
        if c is None:
            if bootstrap is None:
                return []
            self.index_code(bootstrap)
            c = self.chunks()
        where = F.lit(True)
        if project is not None:
            where = where & (F.col("project") == project)
        if chunk_type is not None:
            where = where & (F.col("chunk_type") == chunk_type)
        hits = V.knn(c, self.embedder(query), n, where=where)
        out = hits.select("id", "file", "language", "chunk_type", "chunk_index", F.bround("score", 4).alias("relevance"), F.substring("text", 1, CODE_SNIPPET).alias("snippet"), "project")
        if siblings:
            other = c.select(F.col("project").alias("__p"), F.col("file").alias("__f"), F.col("chunk_index").alias("__i"))
            near = out.join(other, (F.col("project") == F.col("__p")) & (F.col("file") == F.col("__f")) & (F.col("chunk_index") != F.col("__i")), "left")
            out = near.groupBy(*[x for x in out.columns if x != "chunk_index"]).agg(F.array_sort(F.collect_set("__i")).alias("sibling_chunks"))
        return rows(out.orderBy(F.desc("relevance"), "id"))

    def collections(self) -> list[dict]:
        c = self.chunks()
        return [] if c is None else rows(c.groupBy("project").agg(F.count("*").alias("chunks"), F.countDistinct("file").alias("files")).orderBy("project"))

    def delete_collection(self, project: str) -> bool:
        c = self.chunks()
        gone = None if c is None else c.where(F.col("project") == project).select("uid")
        found = gone is not None and not gone.isEmpty()
        if found:
            self._chunks.delete(gone)
        return found

    # --- watched trees
    @property
    def watched(self) -> ChunkIndex:
        return ChunkIndex(self.spark, f"{self.root}/watched")

    def watch(self, roots: Mapping[str, str], gap: int = 1500, once: bool = False, today: str | None = None) -> StreamingQuery:
        """Follows trees of notes: their chunks and postings, and with ``today`` the note index too; a restart goes on from where it stopped.

        ``gap`` is the quiet time in milliseconds after which a file's last change counts; with ``once`` what has changed since is done at once.
        """
        roots = dict(roots)
        changes = keyed_changes(with_text(tree_changes(self.spark, roots, f"{self.root}/watch/listings"), roots), gap=0 if once else gap)
        then = None if today is None else lambda: self.index_notes(files.read_tree(self.spark, roots, "*.md"), today)
        return follow(changes, self.watched, f"{self.root}/watch/checkpoint", name="watch", once=once, then=then)

    def watched_search(self, query: str, n: int = 5) -> list[dict]:
        found = self.watched.search(query, n)
        return rows(found.select("file", "heading", "chunk_id", F.bround("score", 4).alias("relevance"), F.substring("text", 1, SNIPPET).alias("snippet")).orderBy(F.desc("relevance"), "chunk_id"))

    # --- sessions
    def index_sessions(self, summaries: DataFrame) -> None:
        self.store.merge("sessions", X.embed(summaries, "summary"), ["session_id"])

    def scan_sessions(self, lines: DataFrame) -> list[dict]:
        """Chat logs into the graph and the session index; sessions that were there before stay."""
        parsed = sessions.parse(lines)
        nodes = sessions.sessions(parsed)
        actions = sessions.file_actions(parsed, nodes)
        g = self.graph()
        g.nodes["Session"] = nodes.unionByName(g.nodes["Session"].join(nodes.select("id"), "id", "left_anti"))
        bare = actions.select(F.concat_ws("|", "project", "path").alias("id"), "path", "project").dropDuplicates(["id"])
        g.nodes["File"] = g.nodes["File"].unionByName(bare.join(g.nodes["File"].select("id"), "id", "left_anti"), allowMissingColumns=True)
        for action, df in sessions.session_edges(actions).items():
            old = g.edges[("Session", action, "File")]
            g.edges[("Session", action, "File")] = df.unionByName(old.join(df.select("src", "dst"), ["src", "dst"], "left_anti"))
        g.edges[("Session", "IN_PROJECT", "Project")] = sessions.in_project(g.nodes["Session"], g.nodes["Project"])
        self.index_sessions(sessions.summaries(parsed, nodes, actions))
        self.save(g)
        return rows(L.session_stats(self.graph()))

    def session_search(self, query: str, n: int = 5, project: str | None = None, bootstrap: DataFrame | None = None) -> list[dict]:
        """The nearest sessions; an index that is empty is filled from ``bootstrap`` (lines of chat logs) first."""
        if not self.store.version("sessions"):
            if bootstrap is None:
                return []
            self.scan_sessions(bootstrap)
        s = self.store.read("sessions")
        where = None if project is None else F.contains(F.lower("project_name"), F.lit(project.lower()))
        hits = V.knn(s, self.embedder(query), n, key="session_id", where=where)
        return rows(hits.select("session_id", "project_name", "started_at", F.bround("score", 4).alias("relevance"), F.substring("summary", 1, SNIPPET).alias("summary")))

    # --- sources
    def index_source(self, docs: DataFrame) -> dict:
        """Adds documents (doc_id, source_type, source_name, title, content, url, created, tags, text, popularity) that are new."""
        new = X.embed(docs, "text").drop("text")
        old = self.store.read("documents", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema))
        counts = rows(upsert_counts(old, new, ["doc_id"]))[0]
        self.store.write("documents", old.unionByName(missing(new, old, ["doc_id"]).select(*old.columns)))
        return counts

    def index_videos(self, videos: DataFrame, chunks: DataFrame, topics: Sequence[str] = ()) -> None:
        """Videos (video_id, title, url, source_name, description, created), their chunks in place of old ones, and zero-shot tags."""
        v = X.embed(videos.withColumn("__t", F.concat_ws("\n\n", "title", F.substring("description", 1, 3000))), "__t").drop("__t")
        self.store.merge("videos", v, ["video_id"])
        c = X.embed(chunks, "text")
        if self.store.version("video_chunks"):
            c = missing(self.store.read("video_chunks"), c, ["video_id"]).unionByName(c)
        self.store.write("video_chunks", c)
        if topics:
            t = X.embed(self.spark.createDataFrame([(x,) for x in topics], "topic STRING"), "topic")
            found = V.tags(v, t, key="video_id").select("video_id", F.col("topic").alias("tag"), F.col("confidence").alias("weight"))
            self.store.merge("video_tags", found, ["video_id", "tag"])

    def index_makers(self, profiles: DataFrame, source: str, product_type: str | None = None) -> dict:
        """Stores profiles of a source in place of their old rows and links them to that source's products; counts of created and matched profiles."""
        new = X.embed(M.stored_profiles(profiles), "text").drop("text").withColumn("source_name", F.lit(source))
        counts = rows(self.store.merge("makers", new, ["username"]))[0]
        if self.store.version("documents"):
            links = M.product_links(self.store.read("makers").where(F.col("source_name") == source), self.store.read("documents").where(F.col("source_name") == source), product_type or f"{source}-product")
            self.store.merge("maker_products", links, ["src", "dst"])
        return counts

    def maker_products(self, username: str) -> list[dict]:
        """The documents that a profile is linked to."""
        links = self.store.read("maker_products", "src STRING, dst STRING").where(F.col("src") == username)
        return rows(links.join(self.store.read("documents"), F.col("dst") == F.col("doc_id")).select("doc_id", "title", "url").orderBy("doc_id"))

    def source_search(self, query: str, n: int = 5, source: str | None = None) -> list[dict]:
        """Documents by cosine and popularity, chunks with their neighbours' text, and profiles, in one ranking; ``source`` is applied before it."""
        q = self.embedder(query)
        kinds = []
        if self.store.version("documents"):
            d = self.store.read("documents")
            d = d if source is None else d.where(F.col("source_name") == source)
            top = V.rerank(d, q, n, key="doc_id")
            kinds.append(top.select(F.col("doc_id").alias("id"), "source_type", "source_name", "title", "url", "content", "created", "tags", "relevance"))
        if self.store.version("video_chunks"):
            c, v = self.store.read("video_chunks"), self.store.read("videos").select("video_id", "title", "url", "source_name", "created")
            if source is not None:
                v = v.where(F.col("source_name") == source)
                c = c.join(v.select("video_id"), "video_id", "left_semi")
            top = V.knn(c.withColumn("id", F.concat_ws(":", "video_id", F.col("chunk_index").cast("string"))), q, n).withColumnRenamed("score", "relevance")
            # neighbours are looked up for the hits' videos alone
            near = with_siblings(c.join(top.select("video_id").distinct(), "video_id", "left_semi"), ["video_id"], "chunk_index", ["text"]).select("video_id", "chunk_index", "prev_text", "next_text")
            own = top.join(near, ["video_id", "chunk_index"]).join(v, "video_id")
            kinds.append(own.select("id", F.concat(F.lit("youtube-"), "chunk_type").alias("source_type"), "source_name", "title", "url", F.col("text").alias("content"), "created", "chapter", "start_time", "start_seconds", "relevance", S.sibling_context(F.col("prev_text"), F.col("text"), F.col("next_text"), CONTEXT).alias("context")))
        if self.store.version("makers"):
            kinds.append(M.profile_search(self.store.read("makers"), q, n, where=None if source is None else F.col("source_name") == source))
        return rows(V.merge_kinds(kinds, n)) if kinds else []

    def source_tags(self) -> list[dict]:
        t = self.store.read("video_tags")
        return rows(t.groupBy(F.col("tag").alias("name")).agg(F.count("*").alias("count"), F.bround(F.avg("weight"), 3).alias("avg_confidence")).orderBy(F.desc("count"), "name"))

    def source_related(self, video: str, n: int = 5) -> list[dict]:
        found = self.spark.createDataFrame([(video,)], "u STRING").select(F.coalesce(S.video_id(F.col("u")), "u")).first()[0]
        r = related_by_tag(self.store.read("video_tags"), "video_id", "tag", "weight", found)
        out = r.join(self.store.read("videos").select(F.col("video_id").alias("b"), "title", "url"), "b")
        return rows(out.select(F.col("b").alias("video_id"), "title", "url", "shared_tags", "overlap", F.bround("relevance", 3).alias("relevance")).orderBy(F.desc("relevance"), "video_id").limit(n))

    def videos_by_tag(self, tag: str, n: int = 20) -> list[dict]:
        t = self.store.read("video_tags").where(F.col("tag") == tag)
        return rows(t.join(self.store.read("videos"), "video_id").orderBy(F.desc("weight"), "video_id").limit(n).select("video_id", "title", "url", "source_name", "created"))

    def channel_videos(self, channel: str, n: int = 20) -> list[dict]:
        v = self.store.read("videos").where(F.col("source_name") == channel)
        return rows(v.orderBy(F.desc("created"), "video_id").limit(n).select("video_id", "title", "url", "created"))

    def source_list(self) -> list[dict]:
        """Sources with counts of documents, videos, chunks and profiles, the total of what is searched for, and the store's path."""
        names = {"SourceDoc": "documents", "Video": "videos", "Maker": "makers"}
        have = {k: self.store.read(v).withColumn("source", F.col("source_name")) for k, v in names.items() if self.store.version(v)}
        if "Video" in have and self.store.version("video_chunks"):
            have["VideoChunk"] = self.store.read("video_chunks").join(have["Video"].select("video_id", "source"), "video_id")
        return rows(R.counts_by_namespace(have).withColumn("path", F.lit(self.root))) if have else []

    def delete_source(self, source: str) -> bool:
        """Removes all that belongs to a source: documents, profiles and their links, videos with their chunks and tags."""
        own, found = F.col("source_name") == source, False
        ids = {"documents": ("doc_id", (("maker_products", "dst"),)), "makers": ("username", (("maker_products", "src"),)), "videos": ("video_id", (("video_chunks", "video_id"), ("video_tags", "video_id")))}
        for table, (key, parts) in ids.items():
            if not self.store.version(table):
                continue
            t = self.store.read(table)
            gone = t.where(own).select(F.col(key).alias("__gone"))
            if gone.isEmpty():
                continue
            found = True
            for part, column in parts:
                if self.store.version(part):
                    p = self.store.read(part)
                    self.store.write(part, p.join(gone, F.col(column) == F.col("__gone"), "left_anti"))
            self.store.write(table, t.where(~own | F.col("source_name").isNull()))
        return found

    # --- pages
    @staticmethod
    def page_text(pages: DataFrame, most: int = FETCHED) -> DataFrame:
        """url, content and truncated of stored pages."""
        text = S.html_to_text(F.col("html"))
        return pages.select("url", F.substring(text, 1, most).alias("content"), S.truncated(text, most).alias("truncated"))


def web_search(query: str, client: Callable[[str, int], list[dict]] | None = None, n: int = 10) -> list[dict]:
    """A thin client: the engine has no network of its own."""
    if client is None:
        raise RuntimeError("web search needs a client")
    return client(query, n)


def match_people(people: DataFrame, results: DataFrame) -> DataFrame:
    """username and the first search result (url, title, position) that is that person's profile."""
    both = people.join(results, "username").where(S.profile_matches(F.col("username"), F.col("url"), F.coalesce("title", F.lit(""))))
    return both.groupBy("username").agg(F.min_by("url", "position").alias("linkedin"))
