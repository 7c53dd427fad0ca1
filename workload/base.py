"""How queries register, and the tables several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.sources.files import read_parquet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query '{name}' is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{folder}/{name}.parquet")


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, as the SQL side gives them."""
    casts = {f.name: F.col(f.name).cast("double") for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)}
    return df.withColumns(casts) if casts else df


# Money is summed as decimals: sums then do not depend on the order of the rows.
def sales(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line item, with the names of its part."""
    lines, parts = table(spark, folder, "lineitem"), table(spark, folder, "part")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("l_orderkey").alias("order_id"),
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        F.col("l_shipdate").alias("date"),
        F.col("p_brand").alias("product"),
        F.col("p_type").alias("category"),
        F.col("l_returnflag").alias("region"),
        F.col("l_quantity").cast("decimal(5,0)").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("unit_price"),
        F.round(F.col("l_discount") * 100).cast("decimal(3,0)").alias("discount_pct"),
    )


SALES = """
sales AS (
  SELECT l_orderkey AS order_id, l_partkey, l_suppkey, l_linenumber, l_shipdate AS date,
         p_brand AS product, p_type AS category, l_returnflag AS region,
         CAST(l_quantity AS DECIMAL(5,0)) AS quantity,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS unit_price,
         CAST(ROUND(l_discount * 100) AS DECIMAL(3,0)) AS discount_pct,
         CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(1 - l_discount AS DECIMAL(4,2)) AS net_price,
         CAST(l_quantity AS DECIMAL(5,0)) * (CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(1 - l_discount AS DECIMAL(4,2))) AS revenue
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""


def assets(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order, read as an asset with a price, a size and a change in percent."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("asset_id"),
        F.concat(F.lit("A"), F.col("o_orderkey").cast("string")).alias("symbol"),
        F.col("o_orderpriority").alias("sector"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("price_usd"),
        (F.round(F.col("o_totalprice") * 100).cast("bigint") * 1000).alias("market_cap_usd"),
        (F.col("o_custkey") * 1000).alias("volume_24h_usd"),
        ((F.col("o_orderkey") * 37 % 2001 - 1000) / 100).cast("decimal(6,2)").alias("change_24h_pct"),
    )


ASSETS = """
assets AS (
  SELECT o_orderkey AS asset_id, 'A' || o_orderkey AS symbol, o_orderpriority AS sector,
         CAST(o_totalprice AS DECIMAL(12,2)) AS price_usd,
         CAST(ROUND(o_totalprice * 100) AS BIGINT) * 1000 AS market_cap_usd,
         o_custkey * 1000 AS volume_24h_usd,
         CAST((o_orderkey * 37 % 2001 - 1000) / 100.0 AS DECIMAL(6,2)) AS change_24h_pct
  FROM orders
)"""

CLASSIFIED = (
    ASSETS
    + """,
classified AS (
  SELECT *,
    CASE WHEN change_24h_pct > 0.1 THEN 'gain' WHEN change_24h_pct < -0.1 THEN 'loss' ELSE 'flat' END AS direction,
    CASE WHEN ABS(change_24h_pct) < 0.1 THEN 'flat' WHEN ABS(change_24h_pct) >= 5 THEN 'strong'
         WHEN ABS(change_24h_pct) >= 2 THEN 'moderate' ELSE 'slight' END AS magnitude,
    CASE WHEN market_cap_usd >= 30000000000 THEN 'large' WHEN market_cap_usd >= 10000000000 THEN 'mid'
         WHEN market_cap_usd >= 2000000000 THEN 'small' ELSE 'micro' END AS market_tier
  FROM assets
),
enriched AS (
  SELECT *, CASE WHEN ABS(change_24h_pct) < 0.1 THEN 'flat' ELSE magnitude || '_' || direction END AS change_class
  FROM classified
)"""
)
