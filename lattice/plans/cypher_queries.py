"""Registered Cypher statements over the star graph, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattice.cypher import run
from lattice.plans.star import star_graph
from lattice.plans.workload import QUERIES, Query

STATEMENTS: dict[str, tuple[str, str]] = {
    "cypher_property_map": ("MATCH (c:Customer {id: '7'})-[:PLACED]->(o:Order) RETURN o.id AS order_id, o.priority AS priority ORDER BY priority, order_id", "SELECT o_orderkey::VARCHAR AS order_id, o_orderpriority AS priority FROM orders WHERE o_custkey = 7"),
    "cypher_two_hops": ("MATCH (c:Customer {id: '7'})-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part) RETURN DISTINCT p.name AS name", "SELECT DISTINCT p_name AS name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_custkey = 7"),
    "cypher_shared": (
        "MATCH (a:Supplier)-[:SUPPLIES]->(p:Part)<-[:SUPPLIES]-(b:Supplier) WHERE a.name <> b.name AND p.size < 3 RETURN p.id AS part, COUNT(DISTINCT a.name) AS suppliers ORDER BY suppliers DESC",
        "SELECT p_partkey::VARCHAR AS part, count(DISTINCT l_suppkey) AS suppliers FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 3 GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1",
    ),
    "cypher_group_limit": ("MATCH (o:Order)-[r:CONTAINS]->(p:Part) RETURN p.id AS part, COUNT(r) AS changes, SUM(r.quantity) AS added ORDER BY changes DESC, part LIMIT 10", "SELECT l_partkey::VARCHAR AS part, count(*) AS changes, sum(l_quantity)::BIGINT AS added FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    "cypher_untyped_in": (
        "MATCH (n:Nation)<-[r]-(x) WHERE TYPE(r) IN ['IN_NATION'] RETURN n.name AS nation, labels(x)[0] AS kind, COUNT(*) AS n",
        "SELECT n_name AS nation, 'Customer' AS kind, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 UNION ALL SELECT n_name, 'Supplier', count(*) FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1",
    ),
    "cypher_undirected": ("MATCH (n:Nation)-[r]-() RETURN n.name AS nation, COUNT(r) AS connections", "SELECT n_name AS nation, 1 + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS connections FROM nation"),
    "cypher_contains": ("MATCH (p:Part) WHERE p.name CONTAINS 'ed' AND (p.brand ENDS WITH '1' OR p.brand ENDS WITH '2') RETURN p.id AS part", "SELECT p_partkey::VARCHAR AS part FROM part WHERE contains(p_name, 'ed') AND (p_brand LIKE '%1' OR p_brand LIKE '%2')"),
    "cypher_case": ("MATCH (o:Order) RETURN CASE WHEN o.status = 'F' THEN 'done' ELSE 'open' END AS state, COUNT(*) AS n", "SELECT CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS state, count(*) AS n FROM orders GROUP BY 1"),
    "cypher_optional": (
        "MATCH (n:Nation) OPTIONAL MATCH (s:Supplier)-[:IN_NATION]->(n) WHERE s.balance > 5000 RETURN n.name AS nation, COUNT(s) AS rich",
        "SELECT n_name AS nation, count(s_suppkey) AS rich FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1",
    ),
    "cypher_with": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, COUNT(o) AS orders WHERE orders > 15 MATCH (c)-[:IN_NATION]->(n:Nation) RETURN n.name AS nation, COUNT(*) AS busy, SUM(orders) AS orders",
        "SELECT n_name AS nation, count(*) AS busy, sum(n)::BIGINT AS orders FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15) JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1",
    ),
    "cypher_unwind": ("UNWIND ['7', '8', '9'] AS k MATCH (c:Customer {id: k})-[:PLACED]->(o:Order) RETURN k AS customer, COUNT(o) AS orders", "SELECT o_custkey::VARCHAR AS customer, count(*) AS orders FROM orders WHERE o_custkey IN (7, 8, 9) GROUP BY 1"),
    "cypher_comma": ("MATCH (r:Region), (n:Nation) WHERE r.name <> n.name RETURN COUNT(*) AS pairs", "SELECT count(*) AS pairs FROM region, nation WHERE r_name <> n_name"),
    "cypher_var_length": ("MATCH (s:Supplier {id: '3'})-[:IN_NATION|IN_REGION*1..2]->(x) RETURN DISTINCT labels(x)[0] AS kind, x.name AS name", "SELECT 'Nation' AS kind, n_name AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey = 3 UNION SELECT 'Region', r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_suppkey = 3"),
    "cypher_any_label": ("MATCH (n) RETURN labels(n)[0] AS kind, COUNT(n) AS n", "SELECT 'Region' AS kind, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders"),
    "cypher_parallel_edges": (
        "MATCH (o:Order)-[a:CONTAINS]->(p:Part), (o)-[b:CONTAINS]->(p) RETURN p.id AS part, COUNT(*) AS pairs, COUNT(DISTINCT a) AS edges",
        "SELECT part, sum(n * (n - 1))::BIGINT AS pairs, sum(n)::BIGINT AS edges FROM (SELECT l_partkey::VARCHAR AS part, l_orderkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1",
    ),
    "cypher_path_counts": (
        "MATCH (n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED|CONTAINS*1..2]->(x) RETURN n.name AS nation, labels(x)[0] AS kind, COUNT(*) AS paths, COUNT(DISTINCT x) AS ends, MAX(c.balance) AS balance",
        """WITH p AS (SELECT c_nationkey, c_custkey, c_acctbal, 'Order' AS kind, o_orderkey AS x FROM customer JOIN orders ON o_custkey = c_custkey UNION ALL SELECT c_nationkey, c_custkey, c_acctbal, 'Part', l_partkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey)
        SELECT n_name AS nation, kind, count(*) AS paths, count(DISTINCT x) AS ends, max(c_acctbal) AS balance FROM p JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2""",
    ),
    "cypher_skip": ("MATCH (n:Nation) RETURN n.name AS name ORDER BY name SKIP 5 LIMIT 5", "SELECT n_name AS name FROM nation ORDER BY 1 LIMIT 5 OFFSET 5"),
}


def _runner(text: str):
    def f(spark: SparkSession, d: str) -> DataFrame:
        return run(star_graph(spark, d), text)

    return f


for _name, (_text, _sql) in STATEMENTS.items():
    QUERIES[_name] = Query(_runner(_text), _sql)
