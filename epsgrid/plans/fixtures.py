"""Point sets built from the driver's tables (whole tables, no subsets).

Each function returns ``(df, id_col, features)``.  The SQL text next to each
one is the same projection for DuckDB, used by the oracle queries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# hours since 2024-01-01 without any time-zone dependence (ts is timestamp_ntz)
_HOURS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 3.6e9 - 473352"


def events2d(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(
        F.col("event_id"), F.expr(_HOURS).alias("x1"), F.col("value").alias("x2"))
    return df, "event_id", ["x1", "x2"]


EVENTS2D_SQL = ("SELECT event_id, epoch_us(ts) / 3.6e9 - 473352 AS x1, value AS x2 FROM events")


def parts2d(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(
        F.col("p_partkey"), F.col("p_size").cast("double").alias("x1"),
        F.col("p_retailprice").alias("x2"))
    return df, "p_partkey", ["x1", "x2"]


PARTS2D_SQL = "SELECT p_partkey, CAST(p_size AS DOUBLE) AS x1, p_retailprice AS x2 FROM part"


def customers1d(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey"), F.col("c_acctbal").alias("x1"))
    return df, "c_custkey", ["x1"]


CUSTOMERS1D_SQL = "SELECT c_custkey, c_acctbal AS x1 FROM customer"


def orders2d(spark, sf_dir):
    """Order total price (in thousands) against order day."""
    df = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate) / 8.64e10")
        .alias("x1"),
        (F.col("o_totalprice") / F.lit(1000.0)).alias("x2"))
    return df, "o_orderkey", ["x1", "x2"]


ORDERS2D_SQL = ("SELECT o_orderkey, epoch_us(o_orderdate) / 8.64e10 AS x1, "
                "o_totalprice / 1000.0 AS x2 FROM orders")


LINEITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def lineitems3d(spark, sf_dir):
    """All lineitems; the point id is generated (the table has no short key)."""
    df = table(spark, sf_dir, "lineitem").select(
        *LINEITEM_KEY, F.col("l_quantity").alias("x1"),
        (F.col("l_extendedprice") / F.lit(1000.0)).alias("x2"),
        (F.col("l_discount") * F.lit(100.0)).alias("x3"))
    return df, None, ["x1", "x2", "x3"]


LINEITEMS3D_SQL = ("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, "
                   "l_quantity AS x1, l_extendedprice / 1000.0 AS x2, l_discount * 100.0 AS x3 "
                   "FROM lineitem")


EMBEDDING = 64


def _blocks(k: int) -> list[range]:
    """The positions of a whole embedding in ``k`` blocks of (almost) equal length."""
    cuts = [round(i * EMBEDDING / k) for i in range(k + 1)]
    return [range(a, b) for a, b in zip(cuts, cuts[1:])]


def emb(spark, sf_dir, k: int):
    """Whole embeddings folded into ``k`` numbers: the sums of ``k`` blocks of components."""
    total = lambda r: reduce(lambda a, b: a + b, [F.col("embedding")[i].cast("double") for i in r])
    df = table(spark, sf_dir, "embeddings").select(
        "vec_id", *[total(r).alias(f"x{i + 1}") for i, r in enumerate(_blocks(k))])
    return df, "vec_id", [f"x{i + 1}" for i in range(k)]


def emb_sql(k: int) -> str:
    total = lambda r: " + ".join(f"CAST(embedding[{i + 1}] AS DOUBLE)" for i in r)
    return ("SELECT vec_id, " + ", ".join(f"{total(r)} AS x{i + 1}" for i, r in enumerate(_blocks(k)))
            + " FROM embeddings")
