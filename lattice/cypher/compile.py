"""From the tree to a DataFrame.

A bound node ``v`` is the columns v.id, v.label and v.p.<property> of a frame, an edge the columns
of its table; only properties that the statement names are carried. Labels and types that a
pattern fixes choose the tables before they are joined, and a node of which nothing but its
identity is used is not joined at all. Implicit grouping, OPTIONAL MATCH as a left join with its
WHERE inside, and different edges for the edge patterns of one MATCH follow openCypher.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattice.cypher.parser import Parser
from lattice.cypher.tree import Call, Case, CypherError, Expr, Index, Item, ListOf, Literal, Match, Name, Node, Op, Param, Path, Procedure, Project, Prop, Rel, Statement, Unwind
from lattice.operators.graph import Graph
from lattice.operators.text import tfidf
from lattice.operators.vectors import knn

_AGGREGATES = ("count", "sum", "avg", "min", "max", "collect")


def _children(e: object) -> list:
    if isinstance(e, Prop):
        return [e.of]
    if isinstance(e, Index):
        return [e.of, e.at]
    if isinstance(e, (Call, Op)):
        return list(e.args)
    if isinstance(e, Case):
        return [x for x in (e.of, e.other, *[y for w in e.whens for y in w]) if x is not None]
    if isinstance(e, ListOf):
        return list(e.items)
    return []


def _walk(e: object) -> list:
    return [e, *[y for c in _children(e) for y in _walk(c)]]


def _aggregated(e: object) -> bool:
    return any(isinstance(x, Call) and x.name in _AGGREGATES for x in _walk(e))


@dataclass
class _State:
    df: DataFrame | None = None
    kinds: dict[str, str] = field(default_factory=dict)  # variable -> node, edge or value
    labels: dict[str, tuple[str, ...]] = field(default_factory=dict)


class Compiler:
    def __init__(self, g: Graph, params: Mapping[str, object]) -> None:
        self.g, self.params = g, params
        self.props: dict[str, set[str]] = {}
        self.whole: set[str] = set()
        self.n = 0

    def run(self, s: Statement) -> DataFrame:
        if s.nothing:
            return self.g.spark.createDataFrame([], "value STRING")
        self.collect(s)
        state = _State()
        for c in s.clauses:
            if isinstance(c, Match):
                state = self.match(state, c, s)
            elif isinstance(c, Unwind):
                state = self.unwind(state, c)
            elif isinstance(c, Procedure):
                state = self.procedure(state, c)
            else:
                state = self.project(state, c)
        return state.df

    def collect(self, s: Statement) -> None:
        """Which properties each variable needs, and which are used whole."""
        for c in s.clauses:
            roots: list = []
            if isinstance(c, Match):
                roots = [c.where] if c.where is not None else []
                for p in c.paths:
                    for x in (*p.nodes, *p.rels):
                        self.props.setdefault(x.var, set()).update(k for k, _ in x.props)
                        roots += [v for _, v in x.props]
            elif isinstance(c, Unwind):
                roots = [c.expr]
            elif isinstance(c, Procedure):
                roots = [*c.args, *([c.where] if c.where is not None else [])]
            else:
                roots = [i.expr for i in c.items] + [e for e, _ in c.order] + ([c.where] if c.where is not None else [])
                if c.final:
                    self.whole |= {i.expr.name for i in c.items if isinstance(i.expr, Name)}
            for r in roots:
                for e in _walk(r):
                    if isinstance(e, Prop) and isinstance(e.of, Name):
                        self.props.setdefault(e.of.name, set()).add(e.name)
                    if isinstance(e, Call) and e.name == "collect":
                        self.whole |= {a.name for a in e.args if isinstance(a, Name)}
        for c in s.clauses:  # WITH a AS b hands a's properties on
            if isinstance(c, Project) and not c.final:
                for i in c.items:
                    if isinstance(i.expr, Name) and i.alias != i.expr.name:
                        self.props.setdefault(i.expr.name, set()).update(self.props.get(i.alias, set()))

    # scans
    def wanted(self, var: str, columns: set[str], skip: tuple[str, ...]) -> list[str]:
        if var in self.whole:
            return sorted(columns - set(skip))
        return sorted(self.props.get(var, set()) - set(skip))

    def scan(self, var: str, labels: tuple[str, ...]) -> DataFrame:
        names = [x for x in self.g.nodes if not labels or x in labels]
        unknown = [x for x in labels if x not in self.g.nodes]
        if unknown:
            raise CypherError(f"no node label {unknown[0]}")
        frames = {x: self.g.nodes[x] for x in names}
        props = self.wanted(var, {c for f in frames.values() for c in f.columns}, ("id",)) + (["id"] if "id" in self.props.get(var, ()) else [])
        kinds = {p: {f.schema[p].dataType.simpleString() for f in frames.values() if p in f.columns} for p in props}
        out: DataFrame | None = None
        for label, f in frames.items():
            cols = [F.col("id").cast("string").alias(f"{var}.id"), F.lit(label).alias(f"{var}.label")]
            for p in props:
                kind = next(iter(kinds[p])) if len(kinds[p]) == 1 else "string"
                cols.append((F.col(p) if p in f.columns else F.lit(None)).cast(kind).alias(f"{var}.p.{p}"))
            part = f.select(*cols)
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise CypherError("the graph has no nodes")
        return out

    def edges(self, r: Rel, a: tuple[str, ...], b: tuple[str, ...], var: str, identity: bool) -> DataFrame:
        """Edge rows from the side of ``a``: var.from, var.to and their labels, var.type and properties."""
        unknown = [t for t in r.types if not any(k[1] == t for k in self.g.edges)]
        if unknown:
            raise CypherError(f"no edge type {unknown[0]}")
        triples = [t for t in self.g.edges if not r.types or t[1] in r.types]
        props = self.wanted(r.var, {c for t in triples for c in self.g.edges[t].columns}, ("src", "dst", "eid"))
        identity = identity or any("eid" in self.g.edges[t].columns for t in triples)
        kinds = {p: {self.g.edges[t].schema[p].dataType.simpleString() for t in triples if p in self.g.edges[t].columns} for p in props}
        out: DataFrame | None = None
        for way in (1, -1):
            if r.direction not in (0, way):
                continue
            for t in triples:
                one, two = (t[0], t[2]) if way == 1 else (t[2], t[0])
                if (a and one not in a) or (b and two not in b):
                    continue
                e = self.g.edges[t]
                if r.direction == 0 and way == -1 and t[0] == t[2]:
                    e = e.where(F.col("src") != F.col("dst"))  # a loop is one edge, whichever way it is seen
                start, end = ("src", "dst") if way == 1 else ("dst", "src")
                cols = [F.col(start).cast("string").alias(f"{var}.from"), F.lit(one).alias(f"{var}.from_label"), F.col(end).cast("string").alias(f"{var}.to"), F.lit(two).alias(f"{var}.to_label"), F.lit(t[1]).alias(f"{var}.type")]
                if identity:
                    own = ["eid"] if "eid" in e.columns else sorted(e.columns)
                    cols.append(F.xxhash64(F.lit("|".join(t)), *[F.col(c) for c in own]).alias(f"{var}.eid"))
                for p in props:
                    kind = next(iter(kinds[p])) if len(kinds[p]) == 1 else "string"
                    cols.append((F.col(p) if p in e.columns else F.lit(None)).cast(kind).alias(f"{var}.p.{p}"))
                part = e.select(*cols)
                out = part if out is None else out.unionByName(part)
        if out is None:
            extra = "".join(f", `{var}.p.{p}` STRING" for p in props) + (f", `{var}.eid` BIGINT" if identity else "")
            return self.g.spark.createDataFrame([], f"`{var}.from` STRING, `{var}.from_label` STRING, `{var}.to` STRING, `{var}.to_label` STRING, `{var}.type` STRING{extra}")
        return out

    # clauses
    def match(self, state: _State, m: Match, s: Statement) -> _State:
        if not m.optional or state.df is None:
            return self.inner(state, m, s)
        # the optional part starts from what it uses of the row, once each, and is joined back to it
        used = {x.name for root in [m.where, *[v for p in m.paths for y in (*p.nodes, *p.rels) for _, v in y.props]] if root is not None for x in _walk(root) if isinstance(x, Name)}
        used |= {x.var for p in m.paths for x in (*p.nodes, *p.rels)}
        keys = [c for c in state.df.columns if any(c == v or c.startswith(f"{v}.") for v in used)]
        keys = [c for c in keys if not isinstance(state.df.schema[c].dataType, _maps())]
        if not keys:
            found = self.inner(_State(None, {}, {}), m, s)
            df = state.df.join(found.df, F.lit(True), "left")
        else:
            some = _State(state.df.select(*[_q(c) for c in keys]).distinct(), dict(state.kinds), dict(state.labels))
            found = self.inner(some, m, s)
            right = found.df.select(*[_q(c).alias(f"__k{i}") for i, c in enumerate(keys)], *[_q(c) for c in found.df.columns if c not in keys])
            cond = F.lit(True)
            for i, c in enumerate(keys):
                cond = cond & _q(c).eqNullSafe(F.col(f"__k{i}"))
            df = state.df.join(right, cond, "left").drop(*[f"__k{i}" for i in range(len(keys))])
        return _State(df, {**found.kinds, **state.kinds}, {**found.labels, **state.labels})

    def inner(self, state: _State, m: Match, s: Statement) -> _State:
        df, kinds, labels = state.df, dict(state.kinds), dict(state.labels)
        for p in m.paths:
            for n in p.nodes:
                if n.labels:
                    labels[n.var] = n.labels
        several = sum(len(p.rels) for p in m.paths) > 1
        seen: list[tuple[str, Rel]] = []
        for p in m.paths:
            df = self.path(df, kinds, labels, p, seen, several, s)
        out = _State(df, kinds, labels)
        if m.where is not None:
            out.df = out.df.where(self.expr(m.where, out))
        return out

    def bind(self, df: DataFrame | None, kinds: dict[str, str], labels: dict[str, tuple[str, ...]], n: Node) -> DataFrame:
        if n.var not in kinds:
            scan = self.scan(n.var, labels.get(n.var, ()))
            df = scan if df is None else df.crossJoin(scan)
            kinds[n.var] = "node"
        elif n.labels:
            df = df.where(_q(f"{n.var}.label").isin(*n.labels))
        return self.filter_props(df, kinds, labels, n)

    def filter_props(self, df: DataFrame, kinds: dict, labels: dict, x: Node | Rel) -> DataFrame:
        for k, v in x.props:
            df = df.where(_q(f"{x.var}.p.{k}") == self.expr(v, _State(df, kinds, labels)))
        return df

    def path(self, df: DataFrame | None, kinds: dict, labels: dict, p: Path, seen: list, several: bool, s: Statement) -> DataFrame:
        nodes, rels = list(p.nodes), list(p.rels)
        if nodes[0].var not in kinds and nodes[-1].var in kinds:  # start at the end that is known
            nodes, rels = nodes[::-1], [Rel(r.var, r.types, r.props, -r.direction, r.hops, r.named) for r in rels[::-1]]
        if rels and df is None and not self.needs(nodes[0]) and nodes[0].var not in kinds:
            first: Node | None = nodes[0]  # nothing but its identity: the edge has it
        else:
            df, first = self.bind(df, kinds, labels, nodes[0]), None
        for r, here, there in zip(rels, nodes, nodes[1:], strict=False):
            if r.hops is not None:
                if first is not None:
                    df, first = self.bind(df, kinds, labels, first), None
                df = self.walk(df, kinds, labels, r, here, there, s)
                continue
            e = self.edges(r, labels.get(here.var, ()), labels.get(there.var, ()), r.var, several)
            if first is not None:
                df = e.withColumn(f"{first.var}.id", _q(f"{r.var}.from")).withColumn(f"{first.var}.label", _q(f"{r.var}.from_label"))
                kinds[first.var] = "node"
                first = None
            else:
                df = df.join(e, (_q(f"{here.var}.id") == _q(f"{r.var}.from")) & (_q(f"{here.var}.label") == _q(f"{r.var}.from_label")))
            for other, q in seen:
                if several and (not r.types or not q.types or set(r.types) & set(q.types)):
                    df = df.where(_q(f"{r.var}.eid") != _q(f"{other}.eid"))
            seen.append((r.var, r))
            kinds[r.var] = "edge"
            df = self.filter_props(df, kinds, labels, r)
            df = self.arrive(df, kinds, labels, there, _q(f"{r.var}.to"), _q(f"{r.var}.to_label"))
        return df

    def needs(self, n: Node) -> bool:
        return bool(self.props.get(n.var)) or n.var in self.whole

    def arrive(self, df: DataFrame, kinds: dict, labels: dict, n: Node, to: Column, to_label: Column) -> DataFrame:
        if n.var in kinds:
            df = df.where((_q(f"{n.var}.id") == to) & (_q(f"{n.var}.label") == to_label))
        elif self.needs(n):
            scan = self.scan(n.var, labels.get(n.var, ()))
            df = df.join(scan, (to == _q(f"{n.var}.id")) & (to_label == _q(f"{n.var}.label")))
        else:
            df = df.withColumn(f"{n.var}.id", to).withColumn(f"{n.var}.label", to_label)
        kinds[n.var] = "node"
        return self.filter_props(df, kinds, labels, n)

    def walk(self, df: DataFrame, kinds: dict, labels: dict, r: Rel, here: Node, there: Node, s: Statement) -> DataFrame:
        """Paths of a bounded number of edges, no edge twice; ends alone, once each, where that is all the result needs."""
        low, high = r.hops
        last = s.clauses[-1]
        ends = r.direction != 0 and low == 1 and not r.named and last.distinct and not any(_aggregated(i.expr) for i in last.items) and sum(isinstance(c, Project) for c in s.clauses) == 1
        if not ends and r.direction != 0 and not r.named and (high <= 1 or not self.g.repeats(r.types)) and not any(isinstance(f.dataType, _maps()) for f in df.schema):
            return self.count_paths(df, kinds, labels, r, here, there, s)
        level = df.withColumn("__at", _q(f"{here.var}.id")).withColumn("__at_label", _q(f"{here.var}.label")).withColumn("__used", F.array().cast("array<bigint>"))
        out = level if low == 0 else None
        for k in range(1, high + 1):
            e = self.edges(r, (), (), "__e", True)
            level = level.join(e, (F.col("__at") == _q("__e.from")) & (F.col("__at_label") == _q("__e.from_label")))
            if not ends:
                level = level.where(~F.array_contains("__used", _q("__e.eid"))).withColumn("__used", F.array_append("__used", _q("__e.eid")))
            level = level.withColumn("__at", _q("__e.to")).withColumn("__at_label", _q("__e.to_label"))
            level = level.drop(*[c for c in level.columns if c.startswith("__e.")])
            if ends:
                level = level.distinct()
            if k >= low:
                out = level if out is None else out.unionByName(level)
        if there.labels:
            out = out.where(F.col("__at_label").isin(*there.labels))
        out = self.arrive(out, kinds, labels, there, F.col("__at"), F.col("__at_label"))
        return out.drop("__at", "__at_label", "__used")

    def count_paths(self, df: DataFrame, kinds: dict, labels: dict, r: Rel, here: Node, there: Node, s: Statement) -> DataFrame:
        """Ends of paths with the number of paths in ``__paths``, or a row for each path where the statement asks for rows."""
        low, high = r.hops
        if "__paths" not in df.columns:
            df = df.withColumn("__paths", F.lit(1).cast("bigint"))
        level = df.withColumn("__at", _q(f"{here.var}.id")).withColumn("__at_label", _q(f"{here.var}.label"))
        out = level if low == 0 else None
        for k in range(1, high + 1):
            e = self.edges(r, (), (), "__e", False)
            step = level.join(e, (F.col("__at") == _q("__e.from")) & (F.col("__at_label") == _q("__e.from_label")))
            step = step.withColumn("__at", _q("__e.to")).withColumn("__at_label", _q("__e.to_label"))
            keys = [c for c in step.columns if not c.startswith("__e.") and c != "__paths"]
            level = step.groupBy(*[_q(c) for c in keys]).agg(F.sum("__paths").alias("__paths")).select(*[_q(c) for c in level.columns])
            if k >= low:
                out = level if out is None else out.unionByName(level)
        if there.labels:
            out = out.where(F.col("__at_label").isin(*there.labels))
        out = self.arrive(out, kinds, labels, there, F.col("__at"), F.col("__at_label")).drop("__at", "__at_label")
        if not self.counted(s):
            out = out.withColumn("__one", F.explode(F.array_repeat(F.lit(1), F.col("__paths").cast("int")))).drop("__one", "__paths")
        return out

    @staticmethod
    def counted(s: Statement) -> bool:
        """Whether the statement only counts and sums over its rows, so that a row may stand for several."""
        projects = [c for c in s.clauses if isinstance(c, Project)]
        calls = [x for i in projects[0].items for x in _walk(i.expr) if isinstance(x, Call) and x.name in _AGGREGATES] if len(projects) == 1 else []
        return bool(calls) and all(c.name in ("count", "sum", "min", "max") for c in calls) and not any(isinstance(c, Match) and c.optional or isinstance(c, Unwind) for c in s.clauses)

    def unwind(self, state: _State, u: Unwind) -> _State:
        df = state.df if state.df is not None else self.g.spark.range(1).select()
        values = self.value(u.expr)
        if isinstance(values, (list, tuple)) and state.df is None:
            rows = self.g.spark.createDataFrame([(v,) for v in values], [u.alias]) if values else self.g.spark.createDataFrame([], f"`{u.alias}` STRING")
            return _State(rows, {u.alias: "value"}, {})
        df = df.withColumn(u.alias, F.explode(self.expr(u.expr, state)))
        return _State(df, {**state.kinds, u.alias: "value"}, state.labels)

    def procedure(self, state: _State, c: Procedure) -> _State:
        if state.df is not None:
            raise CypherError("CALL comes first in a query")
        names = dict(c.yields) or {"node": "node", "score": "score"}
        node, score = names.get("node", "__node"), names.get("score", "__score")
        name = c.name.lower()
        label = self.value(c.args[0])
        if label not in self.g.nodes:
            raise CypherError(f"no node label {label}")
        if name == "db.idx.vector.querynodes":
            prop, k, vec = (self.value(a) for a in c.args[1:4])
            near = knn(self.g.nodes[label], vec, int(k), embedding=prop)
            hits = near.select(F.col("id").cast("string").alias("__hit"), (1 - F.col("score")).alias(score))
        elif name == "db.idx.fulltext.querynodes":
            f = self.g.nodes[label]
            words = [x.name for x in f.schema if x.dataType.typeName() == "string" and x.name != "id"]
            hits = tfidf(f.withColumn("__all", F.concat_ws(" ", *words)), str(self.value(c.args[1])), 1 << 30, text="__all").select(F.col("id").cast("string").alias("__hit"), F.col("score").alias(score))
        else:
            raise CypherError(f"no procedure {c.name}")
        df = hits.join(self.scan(node, (label,)), F.col("__hit") == _q(f"{node}.id")).drop("__hit")
        out = _State(df, {node: "node", score: "value"}, {node: (label,)})
        if c.where is not None:
            out.df = out.df.where(self.expr(c.where, out))
        return out

    def project(self, state: _State, p: Project) -> _State:
        if state.df is None:
            state = _State(self.g.spark.range(1).select(), {}, {})
        items = list(p.items)
        if p.everything:
            items = [*[Item(Name(v), v) for v in state.kinds if not v.startswith("_anon")], *items]
        if p.final and len({i.alias for i in items}) != len(items):
            raise CypherError("two columns have one name")
        grouped = any(_aggregated(i.expr) for i in items)
        kinds: dict[str, str] = {}
        labels: dict[str, tuple[str, ...]] = {}
        plain: list[tuple[str, Column]] = []
        sums: list[tuple[str, Column]] = []
        for i in items:
            if _aggregated(i.expr):
                sums.append((i.alias, self.expr(i.expr, state)))
                kinds[i.alias] = "value"
            elif isinstance(i.expr, Name) and state.kinds.get(i.expr.name) in ("node", "edge") and not p.final:
                v = i.expr.name
                plain += [(f"{i.alias}{c[len(v):]}", _q(c)) for c in state.df.columns if c.startswith(f"{v}.")]
                kinds[i.alias] = state.kinds[v]
                labels[i.alias] = state.labels.get(v, ())
            else:
                plain.append((i.alias, self.expr(i.expr, state)))
                kinds[i.alias] = "value"
        after = _State(None, kinds, labels)
        if grouped:
            df = state.df.groupBy(*[c.alias(n) for n, c in plain]).agg(*[c.alias(n) for n, c in sums])
            order_state = after
        else:
            extra = [] if p.distinct else [c for c in state.df.columns if c not in {n for n, _ in plain}]
            df = state.df.select(*[c.alias(n) for n, c in plain], *[_q(c) for c in extra])
            if p.distinct:
                df = df.distinct()
                order_state = after
            else:
                order_state = _State(None, {**state.kinds, **kinds}, {**state.labels, **labels})
        order_state.df = df
        if p.order:
            by = []
            for e, down in p.order:
                same = next((i.alias for i in items if i.expr == e), None)
                c = _q(same) if same is not None and same in df.columns else self.expr(e, order_state)
                by.append(c.desc_nulls_first() if down else c.asc_nulls_last())
            df = df.orderBy(*by)
        if p.skip is not None:
            df = df.offset(int(self.value(p.skip)))
        if p.limit is not None:
            df = df.limit(int(self.value(p.limit)))
        df = df.select(*[_q(n) for n, _ in plain], *[_q(n) for n, _ in sums])
        if grouped or p.final:  # the written order of columns
            order = [n for i in items for n in ([i.alias] if i.alias in df.columns else [c for c in df.columns if c.startswith(f"{i.alias}.")])]
            df = df.select(*[_q(n) for n in order])
        after.df = df
        if p.where is not None:
            after.df = df.where(self.expr(p.where, after))
        return after

    # expressions
    def value(self, e: Expr) -> object:
        """A constant, or None where it is not one."""
        if isinstance(e, Literal):
            return e.value
        if isinstance(e, Param):
            if e.name not in self.params:
                raise CypherError(f"no parameter ${e.name}")
            return self.params[e.name]
        if isinstance(e, ListOf):
            return [self.value(x) for x in e.items]
        return None

    def expr(self, e: Expr, s: _State) -> Column:
        if isinstance(e, Literal):
            return F.lit(e.value)
        if isinstance(e, Param):
            v = self.value(e)
            return F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v)
        if isinstance(e, ListOf):
            return F.array(*[self.expr(x, s) for x in e.items])
        if isinstance(e, Name):
            kind = s.kinds.get(e.name)
            if kind is None:
                raise CypherError(f"unknown variable {e.name}")
            if kind == "value":
                return _q(e.name)
            skip = (".eid", ".from", ".to", ".from_label", ".to_label")
            return F.struct(*[_q(c).alias(c[len(e.name) + 1 :].removeprefix("p.")) for c in s.df.columns if c.startswith(f"{e.name}.") and not c.endswith(skip)])
        if isinstance(e, Prop):
            if isinstance(e.of, Name) and s.kinds.get(e.of.name) in ("node", "edge"):
                c = f"{e.of.name}.p.{e.name}"
                return _q(c) if c in s.df.columns else F.lit(None)
            return self.expr(e.of, s)[e.name]
        if isinstance(e, Index):
            return F.get(self.expr(e.of, s), self.expr(e.at, s))
        if isinstance(e, Case):
            out = None
            for cond, then in e.whens:
                c = self.expr(cond, s) if e.of is None else self.expr(e.of, s) == self.expr(cond, s)
                out = F.when(c, self.expr(then, s)) if out is None else out.when(c, self.expr(then, s))
            return out if e.other is None else out.otherwise(self.expr(e.other, s))
        if isinstance(e, Op):
            return self.op(e, s)
        return self.call(e, s)

    def entity(self, e: Expr, s: _State) -> Column | None:
        """The identity of a node or edge variable."""
        if not isinstance(e, Name) or s.kinds.get(e.name) not in ("node", "edge"):
            return None
        if s.kinds[e.name] == "node":
            return F.struct(_q(f"{e.name}.label"), _q(f"{e.name}.id"))
        number = [_q(f"{e.name}.eid")] if f"{e.name}.eid" in s.df.columns else []
        return F.struct(_q(f"{e.name}.type"), _q(f"{e.name}.from"), _q(f"{e.name}.to")) if not number else F.struct(_q(f"{e.name}.type"), *number)

    def op(self, e: Op, s: _State) -> Column:
        if e.op in ("=", "<>"):
            ids = [self.entity(a, s) for a in e.args]
            if all(i is not None for i in ids):
                return ids[0] == ids[1] if e.op == "=" else ids[0] != ids[1]
        if e.op == "IN":
            v = self.value(e.args[1])
            left = self.expr(e.args[0], s)
            return left.isin(list(v)) if isinstance(v, (list, tuple)) else F.array_contains(self.expr(e.args[1], s), left)
        if e.op in ("FILLED", "EMPTY") and isinstance(e.args[0], Name) and s.kinds.get(e.args[0].name) == "node":
            c = _q(f"{e.args[0].name}.id")
            return c.isNotNull() if e.op == "FILLED" else c.isNull()
        a = [self.expr(x, s) for x in e.args]
        simple = {
            "NOT": lambda: ~a[0], "MINUS": lambda: -a[0], "FILLED": lambda: a[0].isNotNull(), "EMPTY": lambda: a[0].isNull(), "AND": lambda: a[0] & a[1], "OR": lambda: a[0] | a[1],
            "XOR": lambda: (a[0] | a[1]) & ~(a[0] & a[1]), "=": lambda: a[0] == a[1], "<>": lambda: a[0] != a[1], "<": lambda: a[0] < a[1], "<=": lambda: a[0] <= a[1], ">": lambda: a[0] > a[1], ">=": lambda: a[0] >= a[1],
            "CONTAINS": lambda: F.contains(a[0], a[1]), "STARTS": lambda: F.startswith(a[0], a[1]), "ENDS": lambda: F.endswith(a[0], a[1]), "-": lambda: a[0] - a[1], "*": lambda: a[0] * a[1], "/": lambda: a[0] / a[1], "%": lambda: a[0] % a[1],
        }
        if e.op == "+":
            text = any(isinstance(x, Literal) and isinstance(x.value, str) for x in e.args)
            return F.concat(*[x.cast("string") for x in a]) if text else a[0] + a[1]
        return simple[e.op]()

    def call(self, e: Call, s: _State) -> Column:
        # a row that stands for several paths counts as many times
        times = F.col("__paths") if s.df is not None and "__paths" in s.df.columns else None
        if e.name == "count":
            if e.star:
                return F.count(F.lit(1)) if times is None else F.coalesce(F.sum(times), F.lit(0))
            only = e.args[0]
            c = _q(f"{only.name}.id" if s.kinds[only.name] == "node" else f"{only.name}.type") if isinstance(only, Name) and s.kinds.get(only.name) in ("node", "edge") else self.expr(only, s)
            if e.distinct:
                return F.countDistinct(self.entity(only, s) if self.entity(only, s) is not None else c)
            return F.count(c) if times is None else F.coalesce(F.sum(F.when(c.isNotNull(), times)), F.lit(0))
        if e.name in ("type", "labels", "id") and isinstance(e.args[0], Name):
            v = e.args[0].name
            return _q(f"{v}.type") if e.name == "type" else F.array(_q(f"{v}.label")) if e.name == "labels" else _q(f"{v}.id")
        a = [self.expr(x, s) for x in e.args]
        if e.name in ("sum", "avg", "min", "max"):
            if e.distinct:
                return {"sum": F.sum_distinct, "avg": F.avg, "min": F.min, "max": F.max}[e.name](a[0])
            return F.sum(a[0] * times) if e.name == "sum" and times is not None else {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[e.name](a[0])
        if e.name == "collect":
            # lists are sorted, so that a result does not depend on the order of rows
            return F.array_sort(F.collect_set(a[0]) if e.distinct else F.collect_list(a[0]))
        functions = {
            "size": lambda: F.size(a[0]), "length": lambda: F.length(a[0]), "tolower": lambda: F.lower(a[0]), "toupper": lambda: F.upper(a[0]), "trim": lambda: F.trim(a[0]), "coalesce": lambda: F.coalesce(*a),
            "abs": lambda: F.abs(a[0]), "round": lambda: F.round(a[0]), "floor": lambda: F.floor(a[0]), "ceil": lambda: F.ceil(a[0]), "log10": lambda: F.log10(a[0]), "sqrt": lambda: F.sqrt(a[0]), "tostring": lambda: a[0].cast("string"),
            "tointeger": lambda: a[0].try_cast("bigint"), "tofloat": lambda: a[0].try_cast("double"), "split": lambda: F.split(a[0], F.concat(F.lit("\\Q"), a[1], F.lit("\\E"))), "replace": lambda: F.replace(a[0], a[1], a[2]), "vecf32": lambda: a[0].cast("array<float>"),
            "range": lambda: F.sequence(a[0], a[1]), "head": lambda: F.get(a[0], F.lit(0)), "last": lambda: F.element_at(a[0], -1),
        }
        if e.name == "substring":
            return F.substr(a[0], a[1] + 1, a[2]) if len(a) > 2 else F.substr(a[0], a[1] + 1)
        if e.name not in functions:
            raise CypherError(f"no function {e.name}")
        return functions[e.name]()


def _q(name: str) -> Column:
    """A column whose name may hold dots."""
    return F.col(f"`{name}`")


def _maps() -> tuple[type, ...]:
    from pyspark.sql.types import MapType

    return (MapType,)


def run(g: Graph, text: str, params: Mapping[str, object] | None = None) -> DataFrame:
    """The rows of a read-only statement; columns are named as in RETURN."""
    return Compiler(g, params or {}).run(Parser(text).statement())


def positional(df: DataFrame) -> list[dict]:
    """Rows as the raw query tool gives them: ``value`` for one column, else ``col_0`` and on."""
    names = ["value"] if len(df.columns) == 1 else [f"col_{k}" for k in range(len(df.columns))]
    return [dict(zip(names, r, strict=True)) for r in df.collect()]
