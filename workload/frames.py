"""Projection, cleaning, filters, sorts, set operations and scalar functions."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tablecraft.functions.columns import text_to_long
from tablecraft.operators import filters, projection
from tablecraft.registry import apply_transform, pandas_rowwise

from .base import ASSETS, CLASSIFIED, SALES, assets, plain, query, sales, table


def classified(spark, folder):
    change = projection.classify_change(assets(spark, folder))
    return projection.add_market_tier(change, large_cap=3e10, mid_cap=1e10, small_cap=2e9)


@query(
    "rename_and_select",
    "SELECT o_orderkey AS id, o_totalprice AS price, o_orderstatus FROM orders",
)
def _(spark, folder):
    return projection.rename_and_select(
        table(spark, folder, "orders"),
        ["o_orderkey", "o_totalprice", "not_there", "o_orderstatus"],
        {"o_orderkey": "id", "o_totalprice": "price"},
    )


@query("select_rename", "SELECT c_custkey AS id, c_name AS value FROM customer")
def _(spark, folder):
    params = {"select": ["c_custkey", "c_name"], "rename": {"c_custkey": "id", "c_name": "value"}}
    return apply_transform("select_rename", {"customer": table(spark, folder, "customer")}, params)


@query("reorder_columns", "SELECT s_name, s_suppkey, s_nationkey, s_acctbal FROM supplier")
def _(spark, folder):
    return projection.reorder_columns(table(spark, folder, "supplier"), ["s_name", "s_suppkey"])


@query(
    "cast_columns",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey,
              CAST(o_orderdate AS VARCHAR)[1:10] AS day, o_orderstatus
       FROM orders""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    cast = projection.cast_columns(orders, {"o_orderkey": "str", "o_custkey": "float", "o_orderdate": "str"})
    return cast.select("o_orderkey", "o_custkey", F.substring("o_orderdate", 1, 10).alias("day"), "o_orderstatus")


@query(
    "coerce_types",
    """SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS BIGINT) AS as_int,
              TRY_CAST(CASE WHEN event_type = 'view' THEN '' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS as_float,
              CAST(TRY_CAST(CASE WHEN event_type = 'click' THEN 'soon' ELSE '2024-01-' || LPAD(CAST(user_id % 28 + 1 AS VARCHAR), 2, '0') END AS TIMESTAMP) AS DATE) AS as_day
       FROM events""",
)
def _(spark, folder):
    events = table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("user_id").cast("string")).alias("as_int"),
        F.when(F.col("event_type") == "view", "").otherwise(F.col("value").cast("string")).alias("as_float"),
        F.when(F.col("event_type") == "click", "soon")
        .otherwise(F.concat(F.lit("2024-01-"), F.lpad((F.col("user_id") % 28 + 1).cast("string"), 2, "0")))
        .alias("as_day"),
    )
    coerced = projection.coerce_types(events, {"as_int": "int", "as_float": "float", "as_day": "datetime64[ns]", "gone": "int"})
    return coerced.withColumn("as_day", F.col("as_day").cast("date"))


@query(
    "coerce_types_fractions",
    "SELECT o_orderkey, o_totalprice, CAST(o_custkey AS BIGINT) AS as_int FROM orders",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("as_int"))
    return projection.coerce_types(orders, {"o_totalprice": "int", "as_int": "int"})


@query(
    "map_values_large_keys",
    """SELECT o_orderkey, CASE o_orderkey + 3000000000 WHEN 3000000001 THEN 9 WHEN 3000000002 THEN 8 ELSE o_orderkey + 3000000000 END AS big,
              CASE o_orderpriority WHEN '1' THEN 'one' WHEN '5-LOW' THEN 'low' ELSE o_orderpriority END AS o_orderpriority FROM orders""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", (F.col("o_orderkey") + F.lit(3_000_000_000)).cast("bigint").alias("big"), "o_orderpriority"
    )
    mapped = projection.map_values(orders, "big", {1: 7, 3_000_000_001: 9, 3_000_000_002: 8, "x": 1})
    return projection.map_values(mapped, "o_orderpriority", {1: "one", "5-LOW": "low"})


@query(
    "map_values",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus
       FROM orders""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return projection.map_values(orders, "o_orderstatus", {"F": "finished", "O": "open"})


@query(
    "map_multi_key",
    """SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus,
              CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'back' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'out'
                   ELSE 'other' END AS state
       FROM lineitem""",
)
def _(spark, folder):
    lookup = {("A", "F"): "back", ("N", "O"): "out"}
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return projection.map_multi_key(lines, ["l_returnflag", "l_linestatus"], lookup, "state", "other")


@query(
    "derive_columns",
    """SELECT p_partkey, p_size * 2 AS double_size, p_size * 2 + 1 AS more, CAST(POWER(p_size, 2) AS DOUBLE) AS square,
              p_brand || ' ' || p_type AS full_name FROM part""",
)
def _(spark, folder):
    derived = projection.derive_columns(
        table(spark, folder, "part"),
        {
            "double_size": "p_size * 2",
            "more": "double_size + 1",
            "square": "power(p_size, 2)",
            "full_name": "p_brand || ' ' || p_type",
        },
    )
    return derived.select("p_partkey", "double_size", "more", "square", "full_name")


@query(
    "add_revenue",
    f"""WITH {SALES} SELECT order_id, l_partkey, l_suppkey, l_linenumber, CAST(net_price AS DOUBLE) AS net_price,
        CAST(revenue AS DOUBLE) AS revenue FROM sales""",
)
def _(spark, folder):
    priced = projection.add_revenue(sales(spark, folder))
    return plain(priced.select("order_id", "l_partkey", "l_suppkey", "l_linenumber", "net_price", "revenue"))


@query(
    "classify_change",
    f"""WITH {CLASSIFIED} SELECT asset_id, CAST(change_24h_pct AS DOUBLE) AS change_24h_pct, direction, magnitude, change_class
        FROM enriched""",
)
def _(spark, folder):
    out = projection.classify_change(assets(spark, folder))
    return plain(out.select("asset_id", "change_24h_pct", "direction", "magnitude", "change_class"))


@query("add_market_tier", f"WITH {CLASSIFIED} SELECT asset_id, market_cap_usd, market_tier FROM enriched")
def _(spark, folder):
    out = projection.add_market_tier(assets(spark, folder), large_cap=3e10, mid_cap=1e10, small_cap=2e9)
    return out.select("asset_id", "market_cap_usd", "market_tier")


@query(
    "pnl_class",
    """SELECT event_id, CASE WHEN value - 50 >= 20 THEN 'strong_gain' WHEN value - 50 >= 5 THEN 'gain'
              WHEN value - 50 <= -20 THEN 'strong_loss' WHEN value - 50 <= -5 THEN 'loss' ELSE 'flat' END AS pnl_class
       FROM events""",
)
def _(spark, folder):
    shifted = table(spark, folder, "events").select("event_id", (F.col("value") - 50).alias("pnl_pct"))
    return projection.pnl_class(shifted).select("event_id", "pnl_class")


@query(
    "fill_defaults",
    """SELECT d.doc_id, COALESCE(quality, -1) AS quality, COALESCE(NULLIF(lang, 'en'), 'default') AS lang
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def _(spark, folder):
    joined = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    holes = joined.select("doc_id", "quality", F.nullif("lang", F.lit("en")).alias("lang"))
    return projection.fill_defaults(holes, {"quality": -1, "lang": "default", "gone": 0})


@query(
    "mask_secrets",
    """SELECT event_id, user_key AS key, CASE WHEN regexp_matches(user_key, '(?i)(password|passwd|pwd|secret|token|key|dsn|credential|api_key)')
              THEN '***' ELSE props END AS value
       FROM (SELECT event_id, props, CASE event_type WHEN 'click' THEN 'API_Token' WHEN 'view' THEN 'db_password' ELSE event_type END AS user_key
             FROM events)""",
)
def _(spark, folder):
    named = F.when(F.col("event_type") == "click", "API_Token").when(F.col("event_type") == "view", "db_password")
    pairs = table(spark, folder, "events").select(
        "event_id", named.otherwise(F.col("event_type")).alias("key"), F.col("props").alias("value")
    )
    return projection.mask_secrets(pairs)


@query(
    "cast_sort_movers",
    """SELECT CAST(event_id AS INTEGER) AS rank, event_type AS name, CAST(user_id AS BIGINT) AS market_cap_usd,
              CAST(value AS DOUBLE) AS price_usd, ROUND(CAST(NULLIF(value - 50, 0) AS DOUBLE), 2) AS change_24h_pct
       FROM events WHERE NULLIF(value - 50, 0) IS NOT NULL ORDER BY ABS(value - 50) DESC""",
)
def _(spark, folder):
    events = table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("rank"),
        F.col("event_type").alias("name"),
        F.col("user_id").cast("string").alias("market_cap_usd"),
        F.col("value").alias("price_usd"),
        F.nullif(F.col("value") - 50, F.lit(0.0)).alias("change_24h_pct"),
    )
    return projection.cast_sort_movers(events)


@query(
    "map_multi_key_table",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, COALESCE(n, 0) AS n_orders FROM lineitem LEFT JOIN
       (SELECT l_partkey AS p, l_suppkey AS s, COUNT(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) ON l_partkey = p AND l_suppkey = s""",
)
def _(spark, folder):
    lines = table(spark, folder, "lineitem")
    lookup = lines.filter("l_returnflag = 'R'").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    rows = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return projection.map_multi_key(rows, ["l_partkey", "l_suppkey"], lookup, "n_orders", 0)


# --- filters -----------------------------------------------------------------

LABELLED = """(SELECT d.doc_id, n_chars, quality, CASE WHEN lang = 'fr' THEN CAST('NaN' AS DOUBLE) ELSE CAST(n_chars AS DOUBLE) END AS score
               FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def labelled(spark, folder):
    joined = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    score = F.when(F.col("lang") == "fr", float("nan")).otherwise(F.col("n_chars").cast("double"))
    return joined.select("doc_id", "n_chars", "quality", score.alias("score"))


@query("drop_nulls", f"SELECT doc_id, n_chars, quality FROM {LABELLED} WHERE quality IS NOT NULL AND NOT isnan(score)")
def _(spark, folder):
    return filters.drop_nulls(labelled(spark, folder), ["quality", "score"]).select("doc_id", "n_chars", "quality")


@query("drop_nulls_all", f"SELECT doc_id, n_chars, quality FROM {LABELLED} WHERE quality IS NOT NULL OR NOT isnan(score)")
def _(spark, folder):
    kept = filters.drop_nulls(labelled(spark, folder), ["quality", "score"], "all")
    return kept.select("doc_id", "n_chars", "quality")


@query("filter_nulls", f"SELECT doc_id, quality FROM {LABELLED} WHERE quality IS NOT NULL")
def _(spark, folder):
    return filters.filter_nulls(labelled(spark, folder).select("doc_id", "quality"), "quality")


@query(
    "filter_by_date",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01' ORDER BY o_orderdate",
)
def _(spark, folder):
    return filters.filter_by_date(table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "1998-06-01")


@query(
    "filter_recent",
    "SELECT l_orderkey, l_partkey, l_shipdate FROM lineitem WHERE CAST(l_shipdate AS DATE) >= DATE '2001-11-04' - INTERVAL '400' DAY",
)
def _(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    return filters.filter_recent(lines, "l_shipdate", 400, datetime.date(2001, 11, 4))


@query(
    "filter_recent_text",
    """SELECT event_id, day FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN 'soon' ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS day FROM events)
       WHERE TRY_CAST(day AS DATE) >= DATE '2024-01-31' - INTERVAL '10' DAY""",
)
def _(spark, folder):
    day = F.when(F.col("event_type") == "click", "soon").otherwise(F.col("ts").cast("date").cast("string"))
    events = table(spark, folder, "events").select("event_id", day.alias("day"))
    return filters.filter_recent(events, "day", 10, datetime.date(2024, 1, 31))


@query("filter_where", "SELECT * FROM lineitem WHERE l_quantity > 30 AND l_discount BETWEEN 0.02 AND 0.06")
def _(spark, folder):
    return filters.filter_where(table(spark, folder, "lineitem"), "l_quantity > 30 AND l_discount BETWEEN 0.02 AND 0.06")


@query(
    "filter_code_length",
    "SELECT p_partkey, p_type, p_retailprice FROM part WHERE p_retailprice IS NOT NULL AND LENGTH(p_type) = 5 ORDER BY p_retailprice DESC",
)
def _(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_type", "p_retailprice")
    return filters.filter_code_length(parts, "p_type", "p_retailprice", 5)


@query("not_completed", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(spark, folder):
    nodes = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    done = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return filters.not_completed(nodes, done, "o_orderkey")


@query("sort_desc", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC")
def _(spark, folder):
    return filters.sort_desc(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")


@query("sql_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100")
def _(spark, folder):
    return filters.sql_top_n(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 100, ["o_orderkey"])


@query("sample_first_n", "SELECT * FROM events ORDER BY event_id LIMIT 50")
def _(spark, folder):
    return filters.sample_first_n(table(spark, folder, "events"), ["event_id"])


@query(
    "union_all",
    "SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier",
)
def _(spark, folder):
    customers = table(spark, folder, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    suppliers = table(spark, folder, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return filters.union_all(customers, suppliers)


@query("set_difference", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def _(spark, folder):
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"))
    pending = table(spark, folder, "orders").filter("o_orderstatus = 'P'")
    return filters.set_difference(customers, pending.select(F.col("o_custkey").alias("id")))


@query(
    "registered_union",
    """SELECT c_name AS name, 'customer' AS node_id FROM customer UNION ALL SELECT s_name, 'supplier' FROM supplier
       UNION ALL SELECT n_name, 'nation' FROM nation""",
)
def _(spark, folder):
    return filters.registered_union(
        {
            "customer": table(spark, folder, "customer").select(F.col("c_name").alias("name")),
            "supplier": table(spark, folder, "supplier").select(F.col("s_name").alias("name")),
            "nation": table(spark, folder, "nation").select(F.col("n_name").alias("name")),
        }
    )


# --- scalar functions --------------------------------------------------------


@query(
    "scalar_surface",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
              ABS(l_quantity - 25) AS distance, ROUND(l_extendedprice / 1000, 1) AS thousands, CAST(l_quantity AS INTEGER) AS whole,
              TRY_CAST(l_returnflag AS INTEGER) AS no_number, STRFTIME(l_shipdate, '%Y-%m') AS month,
              CAST(CAST(l_shipdate AS DATE) + INTERVAL '30' DAY AS DATE) AS due, LENGTH(l_returnflag) AS n,
              CASE WHEN l_discount > 0.05 THEN 'high' ELSE 'low' END AS band, COALESCE(NULLIF(l_linestatus, 'O'), 'none') AS status,
              l_returnflag IS NOT DISTINCT FROM NULLIF(l_returnflag, 'A') AS same, UPPER(LOWER(l_returnflag)) AS flag,
              regexp_matches(l_returnflag, '[AR]') AS back
       FROM lineitem""",
)
def _(spark, folder):
    text = """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
               abs(l_quantity - 25) AS distance, round(l_extendedprice / 1000, 1) AS thousands, cast(l_quantity AS int) AS whole,
               date_format(l_shipdate, 'yyyy-MM') AS month,
               cast(l_shipdate AS date) + INTERVAL '30' DAY AS due, length(l_returnflag) AS n,
               CASE WHEN l_discount > 0.05 THEN 'high' ELSE 'low' END AS band, coalesce(nullif(l_linestatus, 'O'), 'none') AS status,
               l_returnflag IS NOT DISTINCT FROM nullif(l_returnflag, 'A') AS same, upper(lower(l_returnflag)) AS flag,
               l_returnflag RLIKE '[AR]' AS back
        FROM {lines}"""
    flagged = spark.sql(text, lines=table(spark, folder, "lineitem"))
    return flagged.withColumn("no_number", text_to_long(F.col("flag")).cast("int"))


@query(
    "transform_registry",
    f"""WITH {ASSETS} SELECT asset_id, CASE WHEN market_cap_usd >= 50000000000 THEN 'large' WHEN market_cap_usd >= 5000000000 THEN 'mid'
        WHEN market_cap_usd >= 500000000 THEN 'small' ELSE 'micro' END AS market_tier FROM assets""",
)
def _(spark, folder):
    out = apply_transform("add_market_tier", {"a": assets(spark, folder)}, {})
    return out.select("asset_id", "market_tier")


@query("pandas_rowwise", "SELECT event_id, value * 2 AS doubled FROM events")
def _(spark, folder):
    events = table(spark, folder, "events").select("event_id", "value")
    return pandas_rowwise(
        events, lambda rows: rows.assign(doubled=rows["value"] * 2)[["event_id", "doubled"]], "event_id long, doubled double"
    )
