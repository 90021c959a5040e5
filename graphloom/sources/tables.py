"""Edge lists from relational tables. Ids of different kinds are kept apart by offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PART, SUPPLIER, ORDER, NATION, CUSTOMER, REGION = 0, 10**9, 2 * 10**9, 3 * 10**9, 4 * 10**9, 5 * 10**9


def edges_of(df: DataFrame, v0, v1) -> DataFrame:
    """v0, v1 as longs, from any two columns; rows without both ends are left out."""
    out = df.select(F.expr(v0).cast("long").alias("v0"), F.expr(v1).cast("long").alias("v1"))
    return out.where("v0 IS NOT NULL AND v1 IS NOT NULL")


def read_edges(spark: SparkSession, path: str, kind: str = "parquet", v0: str = "v0", v1: str = "v1", **options) -> DataFrame:
    """An edge list from any format that Spark reads (parquet, csv, json, orc, text with a separator option)."""
    return edges_of(spark.read.format(kind).options(**options).load(path), f"`{v0}`", f"`{v1}`")


def write_edges(edges: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    edges.write.format(kind).mode(mode).save(path)


def part_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_of(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_partkey", f"l_suppkey + {SUPPLIER}")


def customer_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_of(spark.read.parquet(f"{sf_dir}/orders.parquet"), f"o_custkey + {CUSTOMER}", f"o_orderkey + {ORDER}")


def order_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's consecutive orders."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("following", F.lead("o_orderkey").over(w))
    return edges_of(orders.where("following IS NOT NULL"), f"o_orderkey + {ORDER}", f"following + {ORDER}")


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    s = edges_of(table("supplier"), f"s_suppkey + {SUPPLIER}", f"CAST(s_nationkey AS BIGINT) + {NATION}")
    c = edges_of(table("customer"), f"c_custkey + {CUSTOMER}", f"CAST(c_nationkey AS BIGINT) + {NATION}")
    n = edges_of(table("nation"), f"CAST(n_nationkey AS BIGINT) + {NATION}", f"CAST(n_regionkey AS BIGINT) + {REGION}")
    return s.unionByName(c).unionByName(n)


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of the above and a self-loop for each line of every seventh part."""
    loops = edges_of(spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_partkey % 7 = 0"), "l_partkey", "l_partkey")
    out = loops
    for make in (part_supplier, customer_order, order_chain, geography):
        out = out.unionByName(make(spark, sf_dir))
    return out


# The same lists in SQL.
_PS = f"SELECT CAST(l_partkey AS BIGINT) AS v0, CAST(l_suppkey + {SUPPLIER} AS BIGINT) AS v1 FROM lineitem"
_CO = f"SELECT CAST(o_custkey + {CUSTOMER} AS BIGINT) AS v0, CAST(o_orderkey + {ORDER} AS BIGINT) AS v1 FROM orders"
_CHAIN = f"""SELECT CAST(o_orderkey + {ORDER} AS BIGINT) AS v0, CAST(following + {ORDER} AS BIGINT) AS v1 FROM (
  SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS following FROM orders)
  WHERE following IS NOT NULL"""
_GEO = f"""SELECT CAST(s_suppkey + {SUPPLIER} AS BIGINT) AS v0, CAST(s_nationkey AS BIGINT) + {NATION} AS v1 FROM supplier
  UNION ALL SELECT CAST(c_custkey + {CUSTOMER} AS BIGINT), CAST(c_nationkey AS BIGINT) + {NATION} FROM customer
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) + {NATION}, CAST(n_regionkey AS BIGINT) + {REGION} FROM nation"""
_LOOPS = "SELECT CAST(l_partkey AS BIGINT) AS v0, CAST(l_partkey AS BIGINT) AS v1 FROM lineitem WHERE l_partkey % 7 = 0"
SQL = {
    "ps": _PS,
    "co": _CO,
    "chain": _CHAIN,
    "geo": _GEO,
    "mix": " UNION ALL ".join(f"SELECT * FROM ({x})" for x in (_LOOPS, _PS, _CO, _CHAIN, _GEO)),
}
GRAPHS = {"ps": part_supplier, "co": customer_order, "chain": order_chain, "geo": geography, "mix": mixed}
