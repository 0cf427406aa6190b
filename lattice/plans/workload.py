"""The registered queries: each a DataFrame plan over the driver tables and, where SQL can say it, the same in SQL.

Sums of money are exact decimals turned into doubles, so that they do not depend on the order of
rows; lists are sorted and joined by bars; every limit follows a total order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattice.functions import strings as S
from lattice.operators import graph as G
from lattice.operators import joins as J
from lattice.operators import text as X
from lattice.operators import vectors as V
from lattice.plans.star import load, star_graph


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = Query(f, sql)
        return f

    return add


def money(c: str | Column) -> Column:
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")).cast("double")


def bars(c: Column) -> Column:
    return F.array_join(c, "|")


# --- graph ------------------------------------------------------------------------------------------


@query("""SELECT 'node' AS kind, 'Region' AS name, count(*) AS n FROM region UNION ALL SELECT 'node', 'Nation', count(*) FROM nation UNION ALL SELECT 'node', 'Customer', count(*) FROM customer
UNION ALL SELECT 'node', 'Supplier', count(*) FROM supplier UNION ALL SELECT 'node', 'Part', count(*) FROM part UNION ALL SELECT 'node', 'Order', count(*) FROM orders""")
def graph_stats_nodes(spark: SparkSession, d: str) -> DataFrame:
    return star_graph(spark, d).stats().where(F.col("kind") == "node")


@query("""SELECT 'IN_REGION' AS name, count(*) AS n FROM nation UNION ALL SELECT 'IN_NATION', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'PLACED', count(*) FROM orders
UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'SUPPLIES', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)""")
def graph_stats_edges(spark: SparkSession, d: str) -> DataFrame:
    return star_graph(spark, d).stats().where(F.col("kind") == "edge").select("name", "n")


@query("SELECT o_orderkey::VARCHAR AS order_id, o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_custkey = 7")
def orders_of_customer(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d)
    e = g.edge(["PLACED"]).where(F.col("src") == "7")
    return G.expand(e, g.node("Order")).select(F.col("id").alias("order_id"), "status", "priority").orderBy("priority", "order_id")


@query("SELECT DISTINCT p_partkey::VARCHAR AS part_id, p_name AS name FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE o_custkey = 7")
def parts_of_customer(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d)
    placed = g.edge(["PLACED"]).where(F.col("src") == "7").select(F.col("dst").alias("order_id"))
    parts = g.edge(["CONTAINS"]).join(placed, F.col("src") == F.col("order_id")).select("dst").distinct()
    return G.expand(parts, g.node("Part")).select(F.col("id").alias("part_id"), "name")


_SHARED = "SELECT l_partkey::VARCHAR AS part_id, count(DISTINCT l_suppkey) AS n_suppliers, string_agg(DISTINCT l_suppkey::VARCHAR, '|' ORDER BY l_suppkey::VARCHAR) AS suppliers FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2"


@query(_SHARED)
def shared_parts_across_suppliers(spark: SparkSession, d: str) -> DataFrame:
    e = star_graph(spark, d).edge(["SUPPLIES"])
    found = G.shared_endpoints(e)
    return found.select(F.col("dst").alias("part_id"), F.size("members").cast("bigint").alias("n_suppliers"), bars(F.col("members")).alias("suppliers")).orderBy(F.desc("n_suppliers"), "part_id")


@query(_SHARED)
def shared_parts_selfjoin(spark: SparkSession, d: str) -> DataFrame:
    pairs = G.shared_endpoint_pairs(star_graph(spark, d).edge(["SUPPLIES"]))
    return pairs.groupBy(F.col("shared").alias("part_id")).agg(F.countDistinct("a").alias("n_suppliers"), bars(F.array_sort(F.collect_set("a"))).alias("suppliers"))


@query("SELECT l_partkey AS part, count(*) AS changes, sum(l_quantity)::BIGINT AS added FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def hot_parts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("changes"), F.sum("l_quantity").cast("bigint").alias("added")).orderBy(F.desc("changes"), "part").limit(20)


@query("SELECT c_name AS name, n AS orders FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey ORDER BY n DESC, c_name LIMIT 20")
def hub_customers(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d)
    counted = g.edge(["PLACED"]).groupBy("src").agg(F.count("*").alias("orders"))
    return G.expand(counted, g.node("Customer"), on="src").select("name", "orders").orderBy(F.desc("orders"), "name").limit(20)


@query("SELECT l_partkey AS part, count(*) AS orders, sum(q)::BIGINT AS quantity FROM (SELECT l_orderkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def hot_parts_by_order(spark: SparkSession, d: str) -> DataFrame:
    per = load(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    return per.groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("orders"), F.sum("q").cast("bigint").alias("quantity")).orderBy(F.desc("orders"), "part").limit(20)


@query("SELECT p_name AS package, count(*) AS importers FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def importers_of_part(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d)
    counted = g.edge(["CONTAINS"]).groupBy("dst").agg(F.count("*").alias("n"))
    return G.expand(counted, g.node("Part")).groupBy(F.col("name").alias("package")).agg(F.sum("n").alias("importers"))


@query("SELECT l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_orderkey = 42")
def lines_in_order(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").where(F.col("l_orderkey") == 42).select("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("SELECT event_id, event_type, value FROM events WHERE user_id = 5 ORDER BY ts DESC, event_id LIMIT 20")
def user_sessions_recent(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").where(F.col("user_id") == 5).orderBy(F.desc("ts"), "event_id").limit(20).select("event_id", "event_type", "value")


@query("SELECT user_id, event_type AS action, count(*) AS n FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1, 2")
def files_in_session_multitype(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").where(F.col("event_type").isin("view", "click", "purchase")).groupBy("user_id", F.col("event_type").alias("action")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT l_orderkey AS order_key, p_name AS name FROM part JOIN lineitem ON p_partkey = l_partkey WHERE contains(p_name, 'ed')")
def sessions_for_name_contains(spark: SparkSession, d: str) -> DataFrame:
    named = load(spark, d, "part").where(F.contains("p_name", F.lit("ed"))).select("p_partkey", "p_name")
    return load(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(named, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("order_key"), F.col("p_name").alias("name")).distinct()


@query("""SELECT n_name AS source, 'Customer' AS target_type, c_name AS target FROM nation JOIN customer ON c_nationkey = n_nationkey
UNION ALL SELECT n_name, 'Supplier', s_name FROM nation JOIN supplier ON s_nationkey = n_nationkey""")
def polymorphic_targets(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d)
    e = G.expand(g.edge(["IN_NATION"]), g.node("Nation").select("id", F.col("name").alias("source")))
    c = g.node("Customer").select(F.col("id").alias("c_id"), F.col("name").alias("c"))
    s = g.node("Supplier").select(F.col("id").alias("s_id"), F.col("name").alias("s"))
    both = e.join(c, (F.col("src") == F.col("c_id")) & (F.col("src_label") == "Customer"), "left").join(s, (F.col("src") == F.col("s_id")) & (F.col("src_label") == "Supplier"), "left")
    return both.select("source", F.col("src_label").alias("target_type"), F.coalesce("c", "s").alias("target"))


@query("SELECT l_orderkey AS order_key, sum(n - own)::BIGINT AS callers FROM lineitem JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1) USING (l_partkey) JOIN (SELECT l_partkey, l_suppkey, count(*) AS own FROM lineitem GROUP BY 1, 2) USING (l_partkey, l_suppkey) GROUP BY 1 HAVING sum(n - own) > 0")
def callers_residual_all(spark: SparkSession, d: str) -> DataFrame:
    """For every order the callers of its parts: lines of the part less those of the same supplier, by aggregates instead of all pairs."""
    line = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").where(F.col("l_suppkey").isNotNull())
    own = line.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("own"))
    other = own.join(own.groupBy("l_partkey").agg(F.sum("own").alias("n")), "l_partkey").select("l_partkey", "l_suppkey", (F.col("n") - F.col("own")).alias("other"))
    per = line.groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.count("*").alias("k")).join(other, ["l_partkey", "l_suppkey"])
    return per.groupBy(F.col("l_orderkey").alias("order_key")).agg(F.sum(F.col("k") * F.col("other")).alias("callers")).where("callers > 0")


@query("SELECT 'parent' AS role, r_name AS name, n_name AS of FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'child', n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def hierarchy_up_down(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d)
    e = g.edge(["IN_REGION"])
    n = g.node("Nation").select(F.col("id").alias("n_id"), F.col("name").alias("n"))
    r = g.node("Region").select(F.col("id").alias("r_id"), F.col("name").alias("r"))
    j = e.join(n, F.col("src") == F.col("n_id")).join(r, F.col("dst") == F.col("r_id"))
    return j.select(F.lit("parent").alias("role"), F.col("r").alias("name"), F.col("n").alias("of")).unionByName(j.select(F.lit("child").alias("role"), F.col("n").alias("name"), F.col("r").alias("of")))


@query("""SELECT label, id, count(*) AS connections FROM (
SELECT 'Nation' AS label, n_nationkey AS id FROM nation UNION ALL SELECT 'Region', n_regionkey FROM nation UNION ALL SELECT 'Customer', c_custkey FROM customer UNION ALL SELECT 'Nation', c_nationkey FROM customer
UNION ALL SELECT 'Supplier', s_suppkey FROM supplier UNION ALL SELECT 'Nation', s_nationkey FROM supplier UNION ALL SELECT 'Customer', o_custkey FROM orders UNION ALL SELECT 'Order', o_orderkey FROM orders
UNION ALL SELECT 'Order', l_orderkey FROM lineitem UNION ALL SELECT 'Part', l_partkey FROM lineitem
UNION ALL SELECT 'Supplier', l_suppkey FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) UNION ALL SELECT 'Part', l_partkey FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) GROUP BY 1, 2""")
def degree_centrality(spark: SparkSession, d: str) -> DataFrame:
    return G.degree(star_graph(spark, d).edge()).select("label", F.col("id").cast("bigint").alias("id"), "connections")


_TOKENS = ["red", "ed", "blue", "o", "green", "steel", "mint", "zz"]


@query(f"SELECT p_partkey AS part, fragment FROM part JOIN (SELECT unnest({_TOKENS!r}) AS fragment) ON contains(p_name, fragment)")
def contains_theta_join(spark: SparkSession, d: str) -> DataFrame:
    f = spark.createDataFrame([(t,) for t in _TOKENS], "fragment string")
    return J.contains_join(load(spark, d, "part").select(F.col("p_partkey").alias("part"), "p_name"), "p_name", f, "fragment").select("part", "fragment")


@query("SELECT n_nationkey AS nation, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def exact_name_link(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = load(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nation")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def skip_existing_anti(spark: SparkSession, d: str) -> DataFrame:
    known = load(spark, d, "orders").where(F.col("o_totalprice") > 300000).select(F.col("o_custkey").alias("c_custkey"))
    return J.missing(load(spark, d, "customer").select("c_custkey"), known, ["c_custkey"])


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def seen_semi(spark: SparkSession, d: str) -> DataFrame:
    known = load(spark, d, "orders").where(F.col("o_totalprice") > 300000).select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").select("c_custkey").join(known, "c_custkey", "left_semi")


@query("SELECT conv_id, turn, CASE WHEN lag(turn) OVER w = turn - 1 THEN lag(role) OVER w END AS prev_role, CASE WHEN lead(turn) OVER w = turn + 1 THEN lead(role) OVER w END AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def neighbour_chunks(spark: SparkSession, d: str) -> DataFrame:
    return J.with_siblings(load(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", ["role"]).select("conv_id", "turn", "prev_role", "next_role")


@query("SELECT l_orderkey AS order_key, string_agg(DISTINCT l_linenumber::VARCHAR, '|' ORDER BY l_linenumber::VARCHAR) AS siblings FROM lineitem GROUP BY 1")
def sibling_collect(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(bars(F.array_sort(F.collect_set(F.col("l_linenumber").cast("string")))).alias("siblings"))


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(nullif(d.lang, ''), l.lang) AS lang, greatest(d.n, l.n) AS n FROM (SELECT doc_id, lang, n_chars AS n FROM documents) d FULL JOIN (SELECT doc_id, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS lang, 1000::BIGINT AS n FROM labels) l ON d.doc_id = l.doc_id")
def merge_with_precedence_all(spark: SparkSession, d: str) -> DataFrame:
    """Documents and labels merged: the document's language first, the greater number."""
    a = load(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").alias("n"))
    b = load(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("lang"), F.lit(1000).cast("bigint").alias("n"))
    return J.merge_by_key(a, b, "doc_id", {"lang": "left", "n": "greatest"})


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def priority_dedup(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    return J.dedupe_by_priority(o, ["o_custkey"], [F.col("o_orderpriority"), F.desc("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


@query("SELECT c_custkey, coalesce(n, 0) AS points FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey WHERE coalesce(n, 0) BETWEEN 5 AND 1000")
def profile_join_filter(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "orders").where(F.col("o_orderstatus") == "F").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = load(spark, d, "customer").select("c_custkey").join(p, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", F.coalesce("n", F.lit(0)).cast("bigint").alias("points")).where(F.col("points").between(5, 1000))


@query("""WITH adj AS (SELECT a.n_nationkey AS s, b.n_nationkey AS t FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey), sym AS (SELECT s, t FROM adj UNION ALL SELECT t, s FROM adj),
res AS (SELECT * FROM (VALUES (0, 1), (3, 2), (7, 3), (9, 4)) v(id, rank)) SELECT t::BIGINT AS id, arg_min(s, rank)::BIGINT AS via FROM sym JOIN res ON s = id AND rank <= 3 WHERE t NOT IN (SELECT id FROM res) GROUP BY t""")
def expand_one_hop(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "nation")
    a, b = n.select(F.col("n_nationkey").cast("bigint").alias("src"), F.col("n_regionkey").alias("ra")), n.select(F.col("n_nationkey").cast("bigint").alias("dst"), F.col("n_regionkey").alias("rb"))
    adj = a.join(b, (F.col("ra") == F.col("rb")) & (F.col("src") < F.col("dst")))
    results = spark.createDataFrame([(0, 1), (3, 2), (7, 3), (9, 4)], "id bigint, rank bigint")
    return G.neighbours(results, adj).select("id", "via")


@query("""WITH t AS (SELECT o_custkey AS c, l_partkey AS p, sum(l_quantity)::BIGINT AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
SELECT b.c AS b, count(*) AS overlap, sum(a.w + b.w)::BIGINT / 2.0::DOUBLE AS relevance, string_agg(a.p::VARCHAR, '|' ORDER BY a.p) AS shared FROM t a JOIN t b ON a.p = b.p AND a.c <> b.c WHERE a.c = 7 GROUP BY 1""")
def related_by_shared_tag(spark: SparkSession, d: str) -> DataFrame:
    o, line = load(spark, d, "orders").select("o_orderkey", "o_custkey"), load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    t = o.join(line, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "l_partkey").agg(F.sum("l_quantity").cast("bigint").alias("w"))
    return J.related_by_tag(t, "o_custkey", "l_partkey", "w", 7).select("b", "overlap", "relevance", bars(F.transform("shared_tags", lambda x: x.cast("string"))).alias("shared"))


@query("SELECT rank, p_partkey, p_name FROM (VALUES (1, 30), (2, 10), (3, 20), (4, 999999999)) v(rank, k) JOIN part ON p_partkey = k")
def fetch_in_rank_order(spark: SparkSession, d: str) -> DataFrame:
    ids = spark.createDataFrame([(1, 30), (2, 10), (3, 20), (4, 999999999)], "rank int, p_partkey bigint")
    return J.in_order(ids, load(spark, d, "part").select("p_partkey", "p_name"), "p_partkey").select("rank", "p_partkey", "p_name")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT a.l_partkey AS s, b.l_partkey AS t FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey),
r AS (SELECT t AS id, 1::BIGINT AS hops FROM e WHERE s = 1 UNION SELECT t, hops + 1 FROM r JOIN e ON s = id WHERE hops < 3) SELECT id, min(hops) AS hops FROM r GROUP BY 1""")
def bounded_paths_1_3(spark: SparkSession, d: str) -> DataFrame:
    """Parts that up to three shared orders lead to from part 1, as surveyed: distinct ends and least hops."""
    return G.reach_shared(load(spark, d, "lineitem"), "l_partkey", "l_orderkey", spark.createDataFrame([(1,)], "at bigint"), 3)


@query("""SELECT event_id, user_id, (SELECT max(h) FROM (SELECT user_id AS u, event_id AS h, ts AS t FROM events WHERE event_type = 'signup') s WHERE s.u = e.user_id AND s.t = (SELECT max(ts) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'signup' AND x.ts <= e.ts)) AS chapter FROM events e WHERE event_type <> 'signup'""")
def interval_assignment(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    marks = e.where(F.col("event_type") == "signup").select("user_id", "ts", F.col("event_id").alias("chapter"))
    points = e.where(F.col("event_type") != "signup").select("event_id", "user_id", "ts")
    return J.interval_assign(points, "ts", marks, "ts", ["user_id"], ["chapter"]).select("event_id", "user_id", "chapter")


# --- aggregates and windows -------------------------------------------------------------------------


@query("SELECT lang, count(*) AS files, sum(n_chars)::BIGINT AS chars FROM documents WHERE lang IS NOT NULL AND lang <> '' GROUP BY 1")
def language_breakdown(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "documents").where(F.col("lang").isNotNull() & (F.col("lang") != ""))
    return x.groupBy("lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))


@query(r"""WITH p AS (SELECT string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS p FROM pages) SELECT CASE WHEN len(p) >= 3 THEN p[1] || '/' || p[2] || '/' WHEN len(p) = 2 THEN p[1] || '/' ELSE '(root)' END AS layer, count(*) AS files FROM p GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12""")
def dir_layers(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return load(spark, d, "pages").groupBy(S.directory_key(path).alias("layer")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "layer").limit(12)


@query("SELECT 'Base class' AS fact, p_brand AS name, count(*) AS n FROM part GROUP BY 2 HAVING count(*) >= 2 UNION ALL SELECT 'CRUD', 'steel', count(*) FROM part WHERE p_type LIKE '%STEEL' HAVING count(*) > 3")
def pattern_facts(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part")
    base = p.groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n")).where(F.col("n") >= 2).select(F.lit("Base class").alias("fact"), "name", "n")
    crud = p.where(F.endswith("p_type", F.lit("STEEL"))).agg(F.count("*").alias("n")).where(F.col("n") > 3).select(F.lit("CRUD").alias("fact"), F.lit("steel").alias("name"), "n")
    return base.unionByName(crud)


@query("SELECT tag, count(*) AS n, sum(p_retailprice::DECIMAL(18,2))::DOUBLE / count(*) AS avg_confidence FROM (SELECT unnest(string_split(p_name, ' ')) AS tag, p_retailprice FROM part) GROUP BY 1")
def tag_usage(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("tag"), "p_retailprice")
    return t.groupBy("tag").agg(F.count("*").alias("n"), (money("p_retailprice") / F.count("*")).alias("avg_confidence"))


@query("SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_id, (ts, event_id)) AS last_event, count(*) FILTER (event_type = 'click') AS clicks, count(*) AS n FROM events GROUP BY 1")
def first_last_per_session(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.count("*").alias("n"))


_PRIORITY = {"view": 1, "click": 2, "purchase": 3}


@query("SELECT user_id, ts::DATE::VARCHAR AS day, arg_max(event_type, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END) AS action, count(*) AS n FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1, 2")
def priority_action(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").where(F.col("event_type").isin(list(_PRIORITY)))
    rank = F.create_map(*[F.lit(x) for kv in _PRIORITY.items() for x in kv])[F.col("event_type")]
    return e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.max_by("event_type", rank).alias("action"), F.count("*").alias("n"))


@query("SELECT conv_id, string_agg(substr(text, 1, 40), '|' ORDER BY turn) AS prompts FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'user') WHERE r <= 3 GROUP BY 1")
def ordered_topn_concat(spark: SparkSession, d: str) -> DataFrame:
    u = load(spark, d, "conversations").where(F.col("role") == "user")
    lists = u.groupBy("conv_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("turn", F.substring("text", 1, 40).alias("t")))), 1, 3).alias("x"))
    return lists.select("conv_id", F.array_join(F.transform("x", lambda y: y["t"]), "|").alias("prompts"))


@query("SELECT conv_id, CASE WHEN bool_or(role = 'system') THEN 'system' WHEN bool_or(role = 'user') THEN 'user' ELSE 'assistant' END AS role, max(length(text)) AS longest, count(*) FILTER (role = 'user') AS users FROM conversations GROUP BY 1")
def role_rollup(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "conversations")
    role = F.when(F.bool_or(F.col("role") == "system"), "system").when(F.bool_or(F.col("role") == "user"), "user").otherwise("assistant")
    return c.groupBy("conv_id").agg(role.alias("role"), F.max(F.length("text")).cast("bigint").alias("longest"), F.count_if(F.col("role") == "user").alias("users"))


@query("SELECT count(DISTINCT trim(t)) AS unique_tags, count(*) AS tags FROM (SELECT unnest(string_split(source || ',' || lang, ',')) AS t FROM documents)")
def tag_explode_distinct(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "documents").select(F.explode(F.split(F.concat_ws(",", "source", "lang"), ",")).alias("t"))
    return t.agg(F.countDistinct(F.trim("t")).alias("unique_tags"), F.count("*").alias("tags"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM events")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return load(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("header"))


@query("SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type")
def dedup_consecutive(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(spark, d, "events").withColumn("p", F.lag("event_type").over(w))
    return e.where(F.col("p").isNull() | (F.col("p") != F.col("event_type"))).select("event_id")


@query("SELECT doc_id, count(*) AS lines, count(DISTINCT line) AS first_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1")
def first_occurrence_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    w = Window.partitionBy("doc_id", "line").orderBy("no")
    first = lines.withColumn("r", F.row_number().over(w))
    return first.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.col("r") == 1).alias("first_lines"))


@query("SELECT conv_id, turn, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin FROM conversations")
def running_offset(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return load(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("bigint").alias("begin"))


# --- vectors ----------------------------------------------------------------------------------------


def _floor6(c: Column) -> Column:
    return (F.floor(c * 1e6 + 0.5) / 1e6).cast("double")


_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_COS = f"list_cosine_similarity(embedding::DOUBLE[], {_Q})"


def _with_query(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    q = e.where(F.col("vec_id") == 0).select(F.col("embedding").alias("__q"))
    return e.crossJoin(F.broadcast(q))  # one row


@query(f"SELECT vec_id, floor(s * 1e6 + 0.5) / 1e6 AS score FROM (SELECT vec_id, {_COS} AS s FROM embeddings) ORDER BY s DESC, vec_id LIMIT 10")
def knn_exact(spark: SparkSession, d: str) -> DataFrame:
    return V.knn(_with_query(spark, d), F.col("__q"), 10, key="vec_id").select("vec_id", _floor6(F.col("score")).alias("score"))


@query(f"SELECT vec_id, floor(s * 1e6 + 0.5) / 1e6 AS score FROM (SELECT vec_id, {_COS} AS s FROM embeddings WHERE label = 3) ORDER BY s DESC, vec_id LIMIT 10")
def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    return V.knn(_with_query(spark, d), F.col("__q"), 10, key="vec_id", where=F.col("label") == 3).select("vec_id", _floor6(F.col("score")).alias("score"))


@query(f"SELECT vec_id, floor(s * 1e6 + 0.5) / 1e6 AS score FROM (SELECT vec_id, label, {_COS} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 40) WHERE label = 3")
def knn_postfiltered(spark: SparkSession, d: str) -> DataFrame:
    return V.knn(_with_query(spark, d), F.col("__q"), 40, key="vec_id", where=F.col("label") == 3, postfilter=True).select("vec_id", _floor6(F.col("score")).alias("score"))


@query()
def knn_lsh(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    q = e.where(F.col("vec_id") == 0).first()["embedding"]
    return V.knn_lsh(e, q, 10, key="vec_id", bucket=2.0).select("vec_id", _floor6(F.col("score")).alias("score"))


@query(f"""WITH n AS (SELECT vec_id, {_COS} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 30) SELECT vec_id, floor(r * 1e6 + 0.5) / 1e6 AS relevance FROM (SELECT vec_id, 0.85 * s + CASE WHEN vec_id > 0 THEN least(log10(vec_id + 1) / 25.0, 0.15) ELSE 0 END AS r FROM n) ORDER BY r DESC, vec_id LIMIT 10""")
def rerank_popularity(spark: SparkSession, d: str) -> DataFrame:
    return V.rerank(_with_query(spark, d), F.col("__q"), 10, popularity="vec_id", key="vec_id").select("vec_id", _floor6(F.col("relevance")).alias("relevance"))


@query(f"""WITH c AS (SELECT vec_id, label, {_COS} * CASE WHEN label = 0 THEN 0.85 ELSE 1 END AS r FROM embeddings), t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY r DESC, vec_id) AS k FROM c)
SELECT vec_id, label AS kind, floor(r * 1e6 + 0.5) / 1e6 AS relevance FROM t WHERE k <= 10 ORDER BY r DESC, label, vec_id LIMIT 10""")
def multi_kind_merge(spark: SparkSession, d: str) -> DataFrame:
    e = _with_query(spark, d).withColumn("relevance", V.cosine(F.col("embedding"), F.col("__q")) * F.when(F.col("label") == 0, 0.85).otherwise(1.0))
    e = e.select("vec_id", F.col("label").alias("kind"), "relevance")
    return V.merge_kinds_by(e, "kind", 10, key="vec_id").select("vec_id", "kind", _floor6(F.col("relevance")).alias("relevance"))


@query(f"SELECT vec_id, label, floor(s * 1e6 + 0.5) / 1e6 AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS k FROM (SELECT vec_id, label, {_COS} AS s FROM embeddings)) WHERE k <= 3")
def cross_namespace_topn(spark: SparkSession, d: str) -> DataFrame:
    e = _with_query(spark, d).withColumn("s", V.cosine(F.col("embedding"), F.col("__q"))).select("vec_id", "label", "s")
    return V.top_per(e, ["label"], [F.desc("s"), F.col("vec_id")], 3).select("vec_id", "label", _floor6(F.col("s")).alias("score"))


@query("""WITH a AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part), b AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size, p_partkey) AS r FROM part),
u AS (SELECT * FROM a WHERE r <= 50 UNION ALL SELECT * FROM b WHERE r <= 50) SELECT id, floor(sum(1.0 / (60 + r)) * 1e9 + 0.5) / 1e9 AS score FROM u GROUP BY id""")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part")
    a = V.ranked(p.orderBy(F.desc("p_retailprice"), "p_partkey").limit(50), [F.desc("p_retailprice"), F.col("p_partkey")]).select(F.lit(0).alias("list_id"), F.col("p_partkey").alias("id"), "rank")
    b = V.ranked(p.orderBy("p_size", "p_partkey").limit(50), [F.col("p_size"), F.col("p_partkey")]).select(F.lit(1).alias("list_id"), F.col("p_partkey").alias("id"), "rank")
    return V.fuse(a.unionByName(b)).select("id", (F.floor(F.col("score") * 1e9 + 0.5) / 1e9).cast("double").alias("score"))


@query("""WITH t AS (SELECT label AS topic, arg_min(embedding, vec_id)::DOUBLE[] AS c FROM embeddings GROUP BY 1), s AS (SELECT vec_id, topic, list_cosine_similarity(embedding::DOUBLE[], c) AS s FROM embeddings, t)
SELECT vec_id, topic, floor(s * 1e6 + 0.5) / 1e6 AS confidence FROM s WHERE s >= 0.3""")
def zero_shot_tags(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    topics = e.groupBy(F.col("label").alias("topic")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return V.tags(e, topics, key="vec_id").select("vec_id", "topic", _floor6(F.col("confidence")).alias("confidence"))


# --- text -------------------------------------------------------------------------------------------

_WORDS = "the nation der"


@query("""WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM documents), p AS (SELECT term, doc_id, count(*) AS tf FROM t WHERE term IN ('the', 'nation', 'der') GROUP BY 1, 2),
f AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)::DOUBLE) AS idf FROM p GROUP BY 1) SELECT doc_id, floor(sum(tf * idf) * 1e6 + 0.5) / 1e6 AS score FROM p JOIN f USING (term) GROUP BY 1 ORDER BY sum(tf * idf) DESC, 1 LIMIT 20""")
def fulltext_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return X.tfidf(load(spark, d, "documents"), _WORDS, 20, key="doc_id").select("doc_id", _floor6(F.col("score")).alias("score"))


@query()
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    docs = X.embed(load(spark, d, "documents").select("doc_id", "text"), "text")
    return X.hybrid(docs, _WORDS, X.hash_embedding(_WORDS), 10, key="doc_id").select("doc_id", "rank", "score")


@query(f"""WITH d AS (SELECT doc_id, text, {_COS} AS s FROM documents JOIN embeddings ON vec_id = doc_id), w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM d),
p AS (SELECT term, doc_id, count(*) AS tf FROM w WHERE term IN ('the', 'nation', 'der') GROUP BY 1, 2), f AS (SELECT term, ln(((SELECT count(*) FROM d) + 1) / (count(*) + 1)::DOUBLE) AS idf FROM p GROUP BY 1),
u AS (SELECT * FROM (SELECT 0 AS l, doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM d) WHERE r <= 30 UNION ALL SELECT * FROM (SELECT 1, doc_id, row_number() OVER (ORDER BY sum(tf * idf) DESC, doc_id) AS r FROM p JOIN f USING (term) GROUP BY doc_id) WHERE r <= 30),
g AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + r)) AS score FROM u GROUP BY 1 ORDER BY 2 DESC, min((l, r)), 1 LIMIT 10)
SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS rank, floor(score * 1e9 + 0.5) / 1e9 AS score FROM g""")
def hybrid_by_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search with stored vectors in place of the feature hash."""
    e = load(spark, d, "embeddings")
    q = e.where("vec_id = 0").first()["embedding"]
    docs = load(spark, d, "documents").select("doc_id", "text").join(e.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    out = X.hybrid(docs, _WORDS, q, 10, key="doc_id")
    return out.select("doc_id", "rank", (F.floor(F.col("score") * 1e9 + 0.5) / 1e9).cast("double").alias("score"))


@query(r"""SELECT page_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 1, 500) AS content FROM pages""")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", S.html_to_text(F.col("html"), 500).alias("content"))


@query(r"SELECT page_id, list_last(string_split(rtrim(regexp_replace(url, '[?#].*$', ''), '/'), '/')) AS slug FROM pages")
def url_slug(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", S.slug_of(F.col("url")).alias("slug"))


@query("SELECT page_id, md5('page:' || url) AS doc_id, sha256(html) AS content_hash FROM pages")
def md5_ids(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", S.doc_id("page", F.col("url")).alias("doc_id"), S.content_hash(F.col("html")).alias("content_hash"))


@query("SELECT page_id, CASE WHEN url LIKE 'http://%' THEN 'http' WHEN url LIKE 'https://%' THEN 'https' ELSE '' END AS scheme, length(url) AS n FROM pages")
def url_clean(spark: SparkSession, d: str) -> DataFrame:
    scheme = F.when(F.startswith("url", F.lit("http://")), "http").when(F.startswith("url", F.lit("https://")), "https").otherwise("")
    return load(spark, d, "pages").select("page_id", scheme.alias("scheme"), F.length("url").cast("bigint").alias("n"))


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _last(mark: str, n: int, end: int, extra: int = 0) -> str:
    """Where to cut at the last ``mark`` of ``n`` characters between the least length and ``end``; null without one."""
    part = f"substr(rest, {X.CHUNK_LEAST + 1}, {end - X.CHUNK_LEAST})"
    return f"{X.CHUNK_LEAST + extra} + length({part}) - nullif(strpos(reverse({part}), reverse({mark})), 0) + 1 - {n}"


_CHUNKS = f"""WITH RECURSIVE r AS (SELECT doc_id, 0::BIGINT AS i, {_strip("coalesce(text, '')")} AS rest, NULL::VARCHAR AS chunk FROM documents
UNION ALL SELECT doc_id, i + 1, CASE WHEN length(rest) > {X.CHUNK_MOST} THEN {_strip('substr(rest, cut + 1)')} ELSE '' END, CASE WHEN length(rest) > {X.CHUNK_MOST} THEN {_strip('substr(rest, 1, cut)')} ELSE rest END
FROM (SELECT *, coalesce({_last('chr(10) || chr(10)', 2, X.CHUNK_MOST)}, {_last('chr(10)', 1, X.CHUNK_MOST)}, {_last("'. '", 2, X.CHUNK_MOST - 1, 1)}, {_last("' '", 1, X.CHUNK_MOST)}, {X.CHUNK_MOST}) AS cut FROM r WHERE rest <> ''))
SELECT doc_id, i - 1 AS chunk_index, doc_id || '::chunk_' || (i - 1) AS chunk_id, chunk AS text, count(*) OVER (PARTITION BY doc_id) AS total_chunks FROM r WHERE chunk IS NOT NULL"""


@query(_CHUNKS)
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return X.chunks(load(spark, d, "documents"), "doc_id", "text")


@query("""WITH c AS (SELECT doc_id, n_chars, unnest(range(0, 100, 25)) AS start FROM documents), l AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), 100) AS nxt FROM c)
SELECT doc_id, start, floor(start / 100.0::DOUBLE * n_chars)::BIGINT AS begin, floor(nxt / 100.0::DOUBLE * n_chars)::BIGINT AS "end" FROM l""")
def proportional_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "n_chars", F.lit(100).cast("bigint").alias("duration"))
    chapters = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(75), F.lit(25)).cast("array<bigint>")).alias("start"))
    return X.proportional_spans(docs, "doc_id", "n_chars", chapters, "start", "duration").select("doc_id", "start", "begin", "end")


@query("SELECT d.doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN sha256(d.text) <> o.h THEN 'updated' ELSE 'unchanged' END AS status FROM documents d LEFT JOIN (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 3 <> 0) o ON d.doc_id = o.doc_id")
def incremental_classify(spark: SparkSession, d: str) -> DataFrame:
    from lattice.operators.dml import classify

    docs = load(spark, d, "documents").select("doc_id", S.content_hash(F.col("text")).alias("content_hash"))
    old = load(spark, d, "documents").where(F.col("doc_id") % 3 != 0).select("doc_id", S.content_hash(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_hash"))
    return classify(docs, old, "doc_id", "content_hash").select("doc_id", "status")


@query("SELECT event_id, CAST(props::JSON ->> 'k' AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'featured' WHEN o_orderkey % 7 > 0 THEN 'launched' ELSE 'created' END AS status FROM orders")
def status_case(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select("o_orderkey", S.product_status(F.when(F.col("o_orderstatus") == "F", "x"), F.col("o_orderkey") % 7).alias("status"))


@query("SELECT doc_id FROM documents WHERE source <> 'src1' AND (DATE '2024-01-01' + (doc_id % 400)::INTEGER < DATE '2024-12-01' - 90 OR n_chars >= 3000)")
def compaction_candidates(spark: SparkSession, d: str) -> DataFrame:
    from lattice.operators.reports import compaction_candidates as candidates

    docs = load(spark, d, "documents").select("doc_id", "n_chars", F.col("source").alias("status"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 400).cast("int")).alias("created"))
    return candidates(docs, F.lit("2024-12-01").cast("date"), days=90, chars=3000, done="src1").select("doc_id")


@query("""WITH g AS (SELECT user_id, ts, event_id, event_type, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS last_event, count(*) AS n FROM s GROUP BY user_id, k""")
def debounce_batch(spark: SparkSession, d: str) -> DataFrame:
    from lattice.streaming.debounce import debounce

    return debounce(load(spark, d, "events"), ["user_id"], "ts", {"event_type": "event_type", "last_event": "event_id"}, "6 hours", ties=["event_id"]).select("user_id", "event_type", "last_event", "n")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || '*' ELSE c_name END AS c_name FROM customer UNION ALL SELECT -c_custkey, c_name FROM customer WHERE c_custkey % 10 = 0")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    from lattice.operators.dml import upsert

    old = load(spark, d, "customer").select("c_custkey", "c_name")
    new = old.where(F.col("c_custkey") % 2 == 0).select("c_custkey", F.concat("c_name", F.lit("*")).alias("c_name")).unionByName(old.where(F.col("c_custkey") % 10 == 0).select((-F.col("c_custkey")).alias("c_custkey"), "c_name"))
    return upsert(old, new, ["c_custkey"])


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY 1 UNION ALL SELECT DISTINCT l_orderkey, 1 FROM lineitem WHERE l_orderkey % 4 = 0")
def replace_children(spark: SparkSession, d: str) -> DataFrame:
    from lattice.operators.dml import replace_children as replace

    line = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    new = line.where(F.col("l_orderkey") % 4 == 0).select("l_orderkey").distinct().withColumn("l_linenumber", F.lit(0))
    return replace(line, new, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT n_name AS project, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS files, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS packages FROM nation")
def overview_report(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("project"))
    c = load(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("files"))
    s = load(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("packages"))
    j = n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return j.select("project", F.coalesce("files", F.lit(0)).cast("bigint").alias("files"), F.coalesce("packages", F.lit(0)).cast("bigint").alias("packages"))


# --- extensions -------------------------------------------------------------------------------------


@query("SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ext_tumbling(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return e.select(F.col("w.start").cast("bigint").alias("start"), "event_type", "n")


@query("SELECT (epoch(time_bucket(INTERVAL 1 HOUR, ts)) - h * 3600)::BIGINT AS start, count(*) AS n FROM events, range(0, 2) r(h) GROUP BY 1")
def ext_sliding(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return e.select(F.col("w.start").cast("bigint").alias("start"), "n")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS price FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), money("l_extendedprice").alias("price"))


@query("SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC)::BIGINT AS r FROM orders")
def ext_rank(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))
    return load(spark, d, "orders").select("o_custkey", "o_orderkey", F.rank().over(w).cast("bigint").alias("r"))
