"""The driver tables as a property graph, and loaders with the engine's types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.operators.graph import Graph


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; timestamps without zone become instants in UTC, as watermarks need."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    for f in df.schema:
        if f.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, nations, customers, suppliers, parts and orders; an edge for each reference."""
    t = lambda name: spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    region, nation, customer, supplier, part, orders, line = (t(n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"))
    key = lambda c: F.col(c).cast("string")
    return Graph(
        spark,
        {
            "Region": region.select(key("r_regionkey").alias("id"), F.col("r_name").alias("name")),
            "Nation": nation.select(key("n_nationkey").alias("id"), F.col("n_name").alias("name")),
            "Customer": customer.select(key("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")),
            "Supplier": supplier.select(key("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
            "Part": part.select(key("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").cast("bigint").alias("size")),
            "Order": orders.select(key("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")),
        },
        {
            ("Nation", "IN_REGION", "Region"): nation.select(key("n_nationkey").alias("src"), key("n_regionkey").alias("dst")),
            ("Customer", "IN_NATION", "Nation"): customer.select(key("c_custkey").alias("src"), key("c_nationkey").alias("dst")),
            ("Supplier", "IN_NATION", "Nation"): supplier.select(key("s_suppkey").alias("src"), key("s_nationkey").alias("dst")),
            ("Customer", "PLACED", "Order"): orders.select(key("o_custkey").alias("src"), key("o_orderkey").alias("dst")),
            ("Order", "CONTAINS", "Part"): line.select(key("l_orderkey").alias("src"), key("l_partkey").alias("dst"), F.col("l_quantity").cast("bigint").alias("quantity"), F.xxhash64(*line.columns).alias("eid")),
            ("Supplier", "SUPPLIES", "Part"): line.select(key("l_suppkey").alias("src"), key("l_partkey").alias("dst")).distinct(),
        },
    )
