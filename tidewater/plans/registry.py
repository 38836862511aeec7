"""Where queries are registered, and the joined tables that several read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, days: tuple[str, ...] = ()) -> Callable:
    """Register a query by its name, with its SQL if there is any; `days` are dates that are returned as text."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = (lambda spark, d: f(spark, d).withColumns({c: F.col(c).cast("string") for c in days})) if days else f
        if sql:
            ORACLES[f.__name__] = f"SELECT * REPLACE ({', '.join(f'{c}::VARCHAR AS {c}' for c in days)}) FROM ({sql})" if days else sql
        return f

    return put


def star(spark: SparkSession, d: str) -> DataFrame:
    """Orders' lines with nation (sector), part (tool), brand and order date; dimensions go by AQE's choice of join."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    sector = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(nations, "c_nationkey").select("c_custkey", "n_name")
    return lines.join(orders, "l_orderkey").join(sector, "c_custkey").select("n_name", F.col("l_partkey").alias("p_partkey"), F.to_date("o_orderdate").alias("day"))


STAR = "SELECT n_name, l_partkey AS p_partkey, o_orderdate::DATE AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
