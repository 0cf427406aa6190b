"""Property graphs as tables: a frame for each label and for each (label, edge type, label).

Node frames have ``id``; edge frames ``src`` and ``dst``. Patterns are joins of these, so that
Catalyst prunes columns, pushes filters and picks the join; a filter on the edge type picks the
tables before anything is joined.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice import schema
from lattice.session import ensure_checkpoints

Triple = tuple[str, str, str]


@dataclass
class Graph:
    """Node frames by label and edge frames by triple. An edge frame may have ``eid``, a number of each edge; ``acyclic`` are types that together have no cycle."""

    spark: SparkSession
    nodes: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[Triple, DataFrame] = field(default_factory=dict)
    acyclic: frozenset[str] = frozenset()

    def repeats(self, types: Iterable[str] | None = None) -> bool:
        """Whether a directed path over edges of ``types`` could use an edge twice, as far as labels tell.

        It cannot if no edge leads within a cycle of labels, or only edges of ``acyclic`` types do.
        """
        triples = self.triples(types or None)
        ahead: dict[str, set[str]] = {}
        for a, _, b in triples:
            ahead.setdefault(a, set()).add(b)
        reached: dict[str, set[str]] = {}
        for a in ahead:
            todo, seen = [a], set()
            while todo:
                for b in ahead.get(todo.pop(), ()):
                    if b not in seen:
                        seen.add(b)
                        todo.append(b)
            reached[a] = seen
        return any(kind not in self.acyclic and a in reached.get(b, set()) | {b} for a, kind, b in triples)

    def node(self, label: str) -> DataFrame:
        if label not in self.nodes:
            return self.spark.createDataFrame([], schema.NODES[label])
        return self.nodes[label]

    def triples(self, types: Iterable[str] | None = None, src: str | None = None, dst: str | None = None) -> list[Triple]:
        wanted = None if types is None else set(types)
        return [t for t in self.edges if (wanted is None or t[1] in wanted) and src in (None, t[0]) and dst in (None, t[2])]

    def edge(self, types: Iterable[str] | None = None, src: str | None = None, dst: str | None = None, props: Iterable[str] = ()) -> DataFrame:
        """src, dst, src_label, type, dst_label and ``props`` (null where a table has none) of all edges that fit."""
        out: DataFrame | None = None
        for t in self.triples(types, src, dst):
            e = self.edges[t]
            cols = [F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.lit(t[0]).alias("src_label"), F.lit(t[1]).alias("type"), F.lit(t[2]).alias("dst_label")]
            cols += [F.col(p) if p in e.columns else F.lit(None).cast("bigint").alias(p) for p in props]
            part = e.select(*cols)
            out = part if out is None else out.unionByName(part)
        if out is None:
            extra = "".join(f", {p} BIGINT" for p in props)
            return self.spark.createDataFrame([], f"src STRING, dst STRING, src_label STRING, type STRING, dst_label STRING{extra}")
        return out

    def stats(self) -> DataFrame:
        """kind (node or edge), name, n: a row for each label and edge type, 0 for empty ones."""
        out: DataFrame | None = None
        for label, df in self.nodes.items():
            part = df.agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), F.lit(label).alias("name"), "n")
            out = part if out is None else out.unionByName(part)
        for t, df in self.edges.items():
            part = df.agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), F.lit(t[1]).alias("name"), "n")
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], "kind STRING, name STRING, n BIGINT")
        return out.groupBy("kind", "name").agg(F.sum("n").alias("n"))


def expand(edges: DataFrame, nodes: DataFrame, *, on: str = "dst", key: str = "id") -> DataFrame:
    """One hop: each edge with the node at its ``on`` end."""
    return edges.join(nodes, edges[on] == nodes[key])


def shared_endpoints(edges: DataFrame, left: str = "src", shared: str = "dst", at_least: int = 2) -> DataFrame:
    """For each shared end, the sorted distinct left ends, where there are several.

    The pattern (a)->(s)<-(b), a <> b, with the a collected, as one aggregate: no self-join.
    """
    return edges.groupBy(shared).agg(F.array_sort(F.collect_set(left)).alias("members")).where(F.size("members") >= at_least)


def shared_endpoint_pairs(edges: DataFrame, left: str = "src", shared: str = "dst") -> DataFrame:
    """The same pattern as a self-join: a, b and the shared end, ordered pairs."""
    a = edges.select(F.col(left).alias("a"), F.col(shared).alias("shared")).distinct()
    b = a.select(F.col("a").alias("b"), F.col("shared").alias("shared_b"))
    return a.join(b, (F.col("shared") == F.col("shared_b")) & (F.col("a") != F.col("b"))).select("a", "b", "shared")


def incidence(edges: DataFrame, label: str | None = None) -> DataFrame:
    """(label, id) of each end of each edge, in one pass over the edges; a self-loop counts once."""
    src, dst = (F.struct(F.col(f"{end}_label").alias("label"), F.col(end).alias("id")) for end in ("src", "dst"))
    ends = F.when(src == dst, F.array(src)).otherwise(F.array(src, dst))
    if label is not None:
        ends = F.filter(ends, lambda e: e["label"] == label)
    return edges.select(F.explode(ends).alias("e"), "type").select("e.label", "e.id", "type")


def degree(edges: DataFrame, label: str | None = None) -> DataFrame:
    """label, id, connections: edges of any type in either direction."""
    return incidence(edges, label).groupBy("label", "id").agg(F.count("*").alias("connections"))


def degree_of(g: Graph, label: str, ids: DataFrame) -> DataFrame:
    """id and connections of the nodes of ``label`` whose id is in ``ids`` (id): edges of any type in either direction, a self-loop once.

    Only tables of edges with an end of the label are read, and only ends among ``ids``, which should be few of all, are counted:
    those of each table first, so that what is exchanged is a row for each id.
    """
    own = ids.select(F.col("id").alias("__own")).distinct()
    counted: DataFrame | None = None
    for t in g.triples():
        for end, other in (("src", "dst"), ("dst", "src")):
            if t[0 if end == "src" else 2] != label:
                continue
            e = g.edges[t].select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
            if end == "dst" and t[0] == label:
                e = e.where(~F.col("src").eqNullSafe(F.col("dst")))  # counted at its other end
            part = e.join(own, F.col(end) == F.col("__own"), "left_semi").groupBy(F.col(end).alias("id")).agg(F.count("*").alias("n"))
            counted = part if counted is None else counted.unionByName(part)
    if counted is None:
        return g.spark.createDataFrame([], "id string, connections bigint")
    return counted.groupBy("id").agg(F.sum("n").alias("connections"))


def reach(edges: DataFrame, seeds: DataFrame, depth: int, *, checkpoint: bool = True) -> DataFrame:
    """id and hops (least, 1 to ``depth``) of the nodes that directed paths of up to ``depth`` edges reach.

    A loop of joins over distinct frontiers: paths are never enumerated. Lineage is cut after each
    hop by a checkpoint in the session's checkpoint folder. A seed is in the result if a path
    comes back to it.
    """
    pairs = edges.select("src", "dst").distinct()
    frontier = seeds.select(F.col(seeds.columns[0]).alias("at")).distinct()
    seen: DataFrame | None = None
    for k in range(1, depth + 1):
        step = pairs.join(frontier, pairs["src"] == frontier["at"]).select(F.col("dst").alias("id")).distinct()
        if seen is not None:
            step = step.join(seen.select("id"), "id", "left_anti")
        step = step.withColumn("hops", F.lit(k).cast("bigint"))
        if checkpoint:
            ensure_checkpoints(edges.sparkSession)
            step = step.checkpoint()
        seen = step if seen is None else seen.unionByName(step)
        frontier = step.select(F.col("id").alias("at"))
    return seen if seen is not None else edges.sparkSession.createDataFrame([], "id string, hops bigint")


def reach_shared(links: DataFrame, item: str, hub: str, seeds: DataFrame, depth: int) -> DataFrame:
    """id and hops as ``reach`` gives them over items that share a hub, without the pairs of items of a hub.

    Each hop goes from the frontier to its hubs and on to their items, both distinct. An item is no
    neighbour of itself: a hub with one item of the frontier leads to all its others.
    """
    ensure_checkpoints(links.sparkSession)
    pairs = links.select(F.col(item).alias("i"), F.col(hub).alias("h")).where("i IS NOT NULL AND h IS NOT NULL").distinct()
    frontier = seeds.select(F.col(seeds.columns[0]).alias("i")).distinct()
    seen: DataFrame | None = None
    for k in range(1, depth + 1):
        hubs = pairs.join(frontier, "i").groupBy("h").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
        step = pairs.join(hubs, "h").where("lo <> hi OR i <> lo").select(F.col("i").alias("id")).distinct()
        if seen is not None:
            step = step.join(seen.select("id"), "id", "left_anti")
        step = step.withColumn("hops", F.lit(k).cast("bigint")).checkpoint()
        seen = step if seen is None else seen.unionByName(step)
        frontier = step.select(F.col("id").alias("i"))
    return seen if seen is not None else links.sparkSession.createDataFrame([], "id string, hops bigint")


def neighbours(results: DataFrame, adjacency: DataFrame, top: int = 3) -> DataFrame:
    """One-hop neighbours of the ``top`` best of ``results`` (id, rank) over a symmetric adjacency, less the results.

    id, via (the best-ranked result that leads there) and rank of that.
    """
    best = results.where(F.col("rank") <= top).select(F.col("id").alias("via"), F.col("rank").alias("via_rank"))
    sym = adjacency.select("src", "dst").unionByName(adjacency.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = sym.join(F.broadcast(best), sym["src"] == best["via"]).select(F.col("dst").alias("id"), "via", "via_rank")
    new = near.join(results.select("id"), "id", "left_anti")
    return new.groupBy("id").agg(F.min_by("via", F.struct("via_rank", "via")).alias("via"), F.min("via_rank").alias("via_rank"))
