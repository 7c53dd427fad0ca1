"""Joins, aggregates, windows, cubes, previews and charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.operators import aggregates, cube, joins, preview, projection, windows

from .base import ASSETS, CLASSIFIED, SALES, assets, plain, query, sales, table
from .frames import classified


def priced(spark, folder):
    return projection.add_revenue(sales(spark, folder))


# --- joins -------------------------------------------------------------------

PNL = """
pnl AS (
  SELECT l.*, p_retailprice AS price_usd, p_size,
         l_quantity * p_retailprice AS current_value_usd, l_quantity * l_tax AS cost_usd
  FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_tax FROM lineitem) l
  LEFT JOIN part ON l.l_partkey = p_partkey AND p_size <= 40
)"""


@query(
    "compute_pnl",
    f"""WITH {PNL} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, price_usd, ROUND(current_value_usd, 4) AS current_value_usd,
        ROUND(cost_usd, 4) AS cost_usd, ROUND(current_value_usd - cost_usd, 4) AS pnl_usd,
        ROUND((current_value_usd - cost_usd) / NULLIF(cost_usd, 0) * 100, 3) AS pnl_pct FROM pnl""",
)
def _(spark, folder):
    positions = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.concat(F.lit("sym"), F.col("l_partkey").cast("string")).alias("symbol"),
        F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("cost_basis_usd"),
    )
    prices = (
        table(spark, folder, "part")
        .filter("p_size <= 40")
        .select(F.concat(F.lit("SYM"), F.col("p_partkey").cast("string")).alias("symbol"), F.col("p_retailprice").alias("price_usd"))
    )
    out = joins.compute_pnl(positions, prices)
    return out.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "price_usd",
        F.round("current_value_usd", 4).alias("current_value_usd"), F.round("cost_usd", 4).alias("cost_usd"),
        F.round("pnl_usd", 4).alias("pnl_usd"), F.round("pnl_pct", 3).alias("pnl_pct"),
    )


@query(
    "customer_sales",
    """WITH s AS (SELECT o_custkey AS customer_id, o_orderpriority AS product, CAST(COUNT(*) AS BIGINT) AS units_sold,
                  CAST(ROUND(SUM(CAST(o_totalprice AS DECIMAL(12,2))), 2) AS DOUBLE) AS total_revenue
                  FROM orders GROUP BY 1, 2)
       SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment, product, units_sold, total_revenue
       FROM customer LEFT JOIN s ON c_custkey = s.customer_id AND product IS NOT NULL""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("customer_id"), F.col("o_orderpriority").alias("product"),
        F.lit(1).alias("quantity"), F.col("o_totalprice").cast("decimal(12,2)").alias("revenue"),
    )
    sums = (
        orders.groupBy("customer_id", "product")
        .agg(F.sum("quantity").alias("units_sold"), F.round(F.sum("revenue"), 2).alias("total_revenue"))
    )
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"), F.col("c_mktsegment").alias("segment")
    )
    return plain(joins.customer_sales(customers, sums))


@query(
    "full_outer_null_safe",
    """WITH a AS (SELECT NULLIF(c_nationkey, 3) AS nation, COUNT(*) AS n FROM customer WHERE c_nationkey > 1 GROUP BY 1),
            b AS (SELECT NULLIF(s_nationkey, 3) AS nation, COUNT(*) AS m FROM supplier WHERE s_nationkey < 20 GROUP BY 1)
       SELECT COALESCE(a.nation, b.nation) AS nation, n AS l_n, m AS r_m, n IS NOT NULL AS in_left, m IS NOT NULL AS in_right
       FROM a FULL OUTER JOIN b ON a.nation IS NOT DISTINCT FROM b.nation""",
)
def _(spark, folder):
    a = table(spark, folder, "customer").filter("c_nationkey > 1").groupBy(F.nullif("c_nationkey", F.lit(3)).alias("nation"))
    b = table(spark, folder, "supplier").filter("s_nationkey < 20").groupBy(F.nullif("s_nationkey", F.lit(3)).alias("nation"))
    counted = (a.agg(F.count(F.lit(1)).alias("n")), b.agg(F.count(F.lit(1)).alias("m")))
    out = joins.full_outer_null_safe(*counted, ["nation"])
    return out.withColumnsRenamed({"_in_left": "in_left", "_in_right": "in_right"})


# --- aggregates --------------------------------------------------------------


@query(
    "group_summary",
    """SELECT l_returnflag, l_linestatus, CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS total,
              CAST(SUM(l_quantity) AS DOUBLE) / COUNT(*) AS mean_qty, COUNT(l_orderkey) AS lines, MIN(l_tax) AS min_tax, MAX(l_tax) AS max_tax,
              CAST(median(l_extendedprice) AS DOUBLE) AS mid, ROUND(stddev_samp(l_quantity), 6) AS spread, COUNT(DISTINCT l_partkey) AS parts
       FROM lineitem GROUP BY 1, 2""",
)
def _(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn("price", F.col("l_extendedprice").cast("decimal(12,2)"))
    out = aggregates.group_summary(
        lines,
        ["l_returnflag", "l_linestatus"],
        {
            "total": ["price", "sum"],
            "mean_qty": ["l_quantity", "mean"],
            "lines": ["l_orderkey", "count"],
            "min_tax": ["l_tax", "min"],
            "max_tax": ["l_tax", "max"],
            "mid": ["l_extendedprice", "median"],
            "spread": ["l_quantity", "std"],
            "parts": ["l_partkey", "nunique"],
            "skipped": ["gone", "sum"],
        },
    )
    return plain(out.withColumn("spread", F.round("spread", 6)))


@query(
    "group_summary_nulls",
    """SELECT lang, CAST(COALESCE(SUM(quality), 0) AS BIGINT) AS good, COUNT(quality) AS labelled, median(quality) AS mid
       FROM (SELECT NULLIF(lang, 'fr') AS lang, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
       WHERE lang IS NOT NULL GROUP BY 1""",
)
def _(spark, folder):
    joined = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    holes = joined.withColumn("lang", F.nullif("lang", F.lit("fr")))
    return aggregates.group_summary(
        holes, ["lang"], {"good": ["quality", "sum"], "labelled": ["quality", "count"], "mid": ["quality", "median"]}
    )


@query("group_summary_size", "SELECT event_type, COUNT(*) AS count FROM events GROUP BY 1")
def _(spark, folder):
    return aggregates.group_summary(table(spark, folder, "events"), ["event_type"], {"x": ["gone", "sum"]})


@query(
    "monthly_rollup",
    f"""WITH {SALES} SELECT STRFTIME(CAST(date AS DATE), '%Y-%m') AS year_month, category, COUNT(*) AS row_count,
        CAST(SUM(unit_price) AS DOUBLE) AS total_value, CAST(CAST(CAST(SUM(unit_price) AS DOUBLE) / COUNT(*) AS DECIMAL(18,6)) AS DOUBLE) AS avg_value,
        CAST(MIN(unit_price) AS DOUBLE) AS min_value, CAST(MAX(unit_price) AS DOUBLE) AS max_value FROM sales GROUP BY 1, 2""",
)
def _(spark, folder):
    return plain(aggregates.monthly_rollup(sales(spark, folder), "date", "unit_price", "category"))


@query(
    "monthly_summary",
    f"""WITH {SALES} SELECT STRFTIME(date, '%Y-%m') AS month, category, COUNT(*) AS order_count, CAST(SUM(quantity) AS DOUBLE) AS units_sold,
        CAST(ROUND(SUM(revenue), 2) AS DOUBLE) AS total_revenue,
        CAST(ROUND(CAST(CAST(SUM(discount_pct) AS DOUBLE) / COUNT(*) AS DECIMAL(12,4)), 1) AS DOUBLE) AS avg_discount_pct
        FROM sales GROUP BY 1, 2 ORDER BY month, total_revenue DESC""",
)
def monthly_summary(spark, folder):
    out = aggregates.monthly_summary(priced(spark, folder))
    return plain(out).orderBy("month", F.col("total_revenue").desc())


@query(
    "top_products",
    f"""WITH {SALES} SELECT product, category, CAST(SUM(quantity) AS DOUBLE) AS units_sold, CAST(ROUND(SUM(revenue), 2) AS DOUBLE) AS total_revenue,
        CAST(ROUND(CAST(CAST(SUM(net_price) AS DOUBLE) / COUNT(*) AS DECIMAL(20,8)), 2) AS DOUBLE) AS avg_net_price,
        CAST(ROUND(CAST(CAST(SUM(discount_pct) AS DOUBLE) / COUNT(*) AS DECIMAL(12,4)), 1) AS DOUBLE) AS avg_discount_pct
        FROM sales GROUP BY 1, 2 ORDER BY SUM(revenue) DESC, product, category LIMIT 20""",
)
def _(spark, folder):
    return plain(aggregates.top_products(priced(spark, folder), 20))


@query(
    "recent_sales_agg",
    f"""WITH {SALES} SELECT product, category, CAST(SUM(quantity) AS DOUBLE) AS units_sold,
        CAST(ROUND(SUM(revenue), 2) AS DOUBLE) AS total_revenue FROM sales GROUP BY 1, 2""",
)
def _(spark, folder):
    return plain(aggregates.recent_sales_agg(priced(spark, folder)))


@query(
    "sector_summary",
    f"""WITH {CLASSIFIED} SELECT sector, market_tier, COUNT(*) AS asset_count,
        CAST(ROUND(CAST(CAST(SUM(change_24h_pct) AS DOUBLE) / COUNT(*) AS DECIMAL(16,6)), 2) AS DOUBLE) AS avg_change_24h_pct,
        ROUND(CAST(SUM(market_cap_usd) AS DOUBLE) / 1e9, 1) AS total_market_cap_bn, ROUND(CAST(SUM(volume_24h_usd) AS DOUBLE) / 1e9, 2) AS total_volume_24h_bn,
        COUNT(*) FILTER (WHERE direction = 'gain') AS gainers, COUNT(*) FILTER (WHERE direction = 'loss') AS losers
        FROM enriched GROUP BY 1, 2""",
)
def _(spark, folder):
    return plain(aggregates.sector_summary(classified(spark, folder)))


@query(
    "dq_sector_summary",
    f"""WITH {CLASSIFIED} SELECT sector, COUNT(*) AS asset_count,
        CAST(ROUND(CAST(CAST(SUM(change_24h_pct) AS DOUBLE) / COUNT(*) AS DECIMAL(16,6)), 2) AS DOUBLE) AS avg_change_24h_pct,
        ROUND(CAST(SUM(market_cap_usd) AS DOUBLE) / 1e9, 1) AS total_market_cap_bn,
        COUNT(*) FILTER (WHERE change_class = 'strong_gain') AS strong_gainers,
        COUNT(*) FILTER (WHERE change_class = 'strong_loss') AS strong_losers FROM enriched GROUP BY 1""",
)
def _(spark, folder):
    return plain(aggregates.dq_sector_summary(classified(spark, folder)))


@query(
    "revenue_by_region",
    f"""WITH {SALES} SELECT region, CAST(SUM(revenue) AS DOUBLE) AS total_revenue, COUNT(order_id) AS order_count,
        ROUND(CAST(SUM(revenue) AS DOUBLE) / COUNT(revenue), 4) AS avg_order_value FROM sales GROUP BY 1""",
)
def _(spark, folder):
    out = aggregates.revenue_by_region(priced(spark, folder))
    return plain(out.withColumn("avg_order_value", F.round("avg_order_value", 4)))


@query(
    "tag_counts",
    r"""SELECT tag, COUNT(*) AS count FROM (
          SELECT unnest(string_split_regex(lower(trim(text, E' \n\t\r')), '[ \n\t\r]+')) AS tag FROM benchmark
          UNION ALL SELECT unnest(string_split(p_name, ' ')) FROM part) GROUP BY 1""",
)
def _(spark, folder):
    words = F.split(F.lower(F.regexp_replace("text", "^[ \n\t\r]+|[ \n\t\r]+$", "")), "[ \n\t\r]+")
    texts = table(spark, folder, "benchmark").select(words.alias("tags"))
    names = table(spark, folder, "part").select(F.split("p_name", " ").alias("tags"))
    return aggregates.tag_counts(texts, names)


@query(
    "row_and_column_counts",
    """SELECT 'orders' AS output, COUNT(*) AS row_count, CAST(6 AS BIGINT) AS column_count FROM orders
       UNION ALL SELECT 'lineitem', COUNT(*), 11 FROM lineitem UNION ALL SELECT 'part', COUNT(*), 6 FROM part""",
)
def _(spark, folder):
    return aggregates.row_and_column_counts({n: table(spark, folder, n) for n in ("orders", "lineitem", "part")})


# --- windows -----------------------------------------------------------------


@query(
    "top_movers",
    f"""WITH {CLASSIFIED} SELECT rank() OVER (ORDER BY ABS(change_24h_pct) DESC) AS mover_rank, symbol, sector, market_tier,
        CAST(price_usd AS DOUBLE) AS price_usd, CAST(change_24h_pct AS DOUBLE) AS change_24h_pct, change_class,
        ROUND(CAST(market_cap_usd AS DOUBLE) / 1e9, 1) AS market_cap_bn
        FROM enriched ORDER BY ABS(change_24h_pct) DESC, asset_id LIMIT 25""",
)
def _(spark, folder):
    out = windows.top_movers(
        classified(spark, folder), 25, keep=["symbol", "sector", "market_tier"], tie_breakers=["asset_id"]
    )
    return plain(out)


@query(
    "deduplicate_by_key",
    """SELECT event_id, ts, user_id, event_type, value FROM (
         SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id) AS rn FROM events) WHERE rn = 1""",
)
def _(spark, folder):
    events = table(spark, folder, "events").drop("props")
    return windows.deduplicate_by_key(events, ["user_id", "event_type"], "ts", ["event_id"])


LINE_TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query(
    "top_n_by_group",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_extendedprice, CAST(_rn AS INTEGER) AS _rn FROM (
         SELECT *, ROW_NUMBER() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS _rn
         FROM lineitem) WHERE _rn <= 5""",
)
def _(spark, folder):
    lines = table(spark, folder, "lineitem").select(*LINE_TIES, "l_returnflag", "l_extendedprice")
    return windows.top_n_by_group(lines, "l_returnflag", "l_extendedprice", 5, LINE_TIES)


@query("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice ASC NULLS LAST, o_orderkey LIMIT 30")
def _(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return windows.top_n(orders, 30, "o_totalprice", ascending=True, tie_breakers=["o_orderkey"])


@query(
    "top_n_partitioned",
    """SELECT doc_id, lang, quality FROM (
         SELECT d.doc_id, NULLIF(lang, 'fr') AS lang, quality,
                ROW_NUMBER() OVER (PARTITION BY NULLIF(lang, 'fr') ORDER BY quality DESC NULLS LAST, d.doc_id) AS rn
         FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE rn <= 40 AND lang IS NOT NULL""",
)
def _(spark, folder):
    joined = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    holes = joined.select("doc_id", F.nullif("lang", F.lit("fr")).alias("lang"), "quality")
    return windows.top_n(holes, 40, "quality", partition_by="lang", tie_breakers=["doc_id"])


def _register_ranks() -> None:
    """One query per way to rank tied values, over all rows and per group."""
    ranks = {
        "dense": "dense_rank() OVER w",
        "min": "rank() OVER w",
        "max": "rank() OVER w + COUNT(*) OVER (PARTITION BY {part}l_quantity) - 1",
        "average": "(rank() OVER w + rank() OVER w + COUNT(*) OVER (PARTITION BY {part}l_quantity) - 1) // 2",
        "first": "row_number() OVER (w_first)",
    }
    for method, rank in ranks.items():
        for group in (None, "l_returnflag"):
            part = f"{group}, " if group else ""
            by = f"PARTITION BY {group} " if group else ""
            order = "l_quantity DESC"
            ties = ", " + ", ".join(LINE_TIES)
            over = rank.replace("OVER (w_first)", f"OVER ({by}ORDER BY {order}{ties})")
            over = over.replace("OVER w", f"OVER ({by}ORDER BY {order})").replace("{part}", part)
            sql = f"SELECT {', '.join(LINE_TIES)}, l_returnflag, l_quantity, CAST({over} AS BIGINT) AS rank FROM lineitem"
            name = f"add_rank_{method}" + ("_grouped" if group else "")

            def run(spark, folder, method=method, group=group):
                lines = table(spark, folder, "lineitem").select(*LINE_TIES, "l_returnflag", "l_quantity")
                return windows.add_rank(lines, "l_quantity", method=method, group_by=group, tie_breakers=LINE_TIES)

            query(name, sql)(run)


_register_ranks()


@query("probe_row_id", "SELECT *, ROW_NUMBER() OVER (ORDER BY event_id) - 1 AS _row_id FROM events")
def _(spark, folder):
    return windows.probe_row_id(table(spark, folder, "events"), ["event_id"])


@query("probe_row_id_all", "SELECT o_orderkey, o_orderdate, ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS _row_id FROM orders")
def _(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return windows.probe_row_id(orders, ["o_orderdate", "o_orderkey"])


@query(
    "last_state",
    """SELECT event_id, ts, user_id, event_type FROM (
         SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
       WHERE before IS DISTINCT FROM event_type""",
)
def _(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type")
    return windows.last_state(events, "user_id", ["ts", "event_id"], ["event_type"])


# --- cube --------------------------------------------------------------------


def facts(spark, folder):
    orders = table(spark, folder, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(12,2)"))
    nations = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return orders.join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )


STAR = """orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


@query(
    "cube_query",
    f"""SELECT r_name, n_name,
          CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS "F · total",
          COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS f_n,
          CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) FILTER (WHERE o_orderstatus = 'O') AS DOUBLE) AS "O · total",
          COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS o_n
        FROM {STAR} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND r_name IN ('ASIA', 'EUROPE', 'AFRICA')
        GROUP BY 1, 2""",
)
def _(spark, folder):
    out = cube.cube_query(
        facts(spark, folder),
        {"total": F.sum("price"), "n": F.count(F.lit(1))},
        ["r_name", "n_name"],
        {"o_orderstatus": ["F", "O"]},
        slicers={"c_mktsegment": ["BUILDING", "MACHINERY"]},
        sets={"r_name": ["ASIA", "EUROPE", "AFRICA"]},
    )
    renamed = out.withColumns({"f_n": F.coalesce("F · n", F.lit(0)), "o_n": F.coalesce("O · n", F.lit(0))})
    return plain(renamed.drop("F · n", "O · n"))


@query(
    "cube_calculated",
    f"""SELECT r_name, CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total, COUNT(*) AS n,
        ROUND(CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) / COUNT(*), 3) AS mean FROM {STAR} GROUP BY 1""",
)
def _(spark, folder):
    out = cube.cube_query(
        facts(spark, folder),
        {"total": F.sum("price"), "n": F.count(F.lit(1))},
        ["r_name"],
        calculated={"mean": "round(cast(total AS double) / n, 3)"},
        non_empty_columns=True,
    )
    return plain(out)


# One member of each level is missing, so that a total and a missing member meet.
HOLED = f"(SELECT *, NULLIF(r_name, 'ASIA') AS area, NULLIF(n_name, 'FRANCE') AS land, NULLIF(o_orderstatus, 'P') AS status FROM {STAR})"


def holed(spark, folder):
    found = facts(spark, folder)
    for level, source, member in (("area", "r_name", "ASIA"), ("land", "n_name", "FRANCE"), ("status", "o_orderstatus", "P")):
        found = found.withColumn(level, F.nullif(source, F.lit(member)))
    return found


TOTAL = "CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE)"


@query(
    "cube_rollup",
    f"""SELECT area, land, GROUPING(area, land) AS grouping_id, {TOTAL} AS total, COUNT(DISTINCT o_custkey) AS customers, COUNT(*) AS n
        FROM {HOLED} GROUP BY ROLLUP (area, land)""",
)
def _(spark, folder):
    measures = {"total": F.sum("price"), "customers": F.count_distinct("o_custkey"), "n": F.count(F.lit(1))}
    return plain(cube.cube_query(holed(spark, folder), measures, ["area", "land"], totals="rollup"))


@query(
    "cube_totals",
    f"""SELECT area, c_mktsegment, GROUPING(area, c_mktsegment) AS grouping_id,
          CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) FILTER (WHERE status = 'F') AS DOUBLE) AS "F · total",
          CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) FILTER (WHERE status = 'O') AS DOUBLE) AS "O · total",
          {TOTAL} AS "All · total", COUNT(*) FILTER (WHERE status = 'F') AS "F · n", COUNT(*) FILTER (WHERE status = 'O') AS "O · n", COUNT(*) AS "All · n"
        FROM {HOLED} GROUP BY CUBE (area, c_mktsegment)""",
)
def _(spark, folder):
    out = cube.cube_query(
        holed(spark, folder),
        {"total": F.sum("price"), "n": F.count(F.lit(1))},
        ["area", "c_mktsegment"],
        {"status": ["F", "O"]},
        totals="cube",
        column_total="All",
    )
    return plain(out.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in ("F · n", "O · n")}))


@query(
    "cube_grouping_sets",
    f"""SELECT area, land, c_mktsegment, GROUPING(area, land, c_mktsegment) AS grouping_id, MAX(o_totalprice) AS largest
        FROM {HOLED} WHERE status = 'F' GROUP BY GROUPING SETS ((area, land, c_mktsegment), (c_mktsegment), (area, c_mktsegment))""",
)
def _(spark, folder):
    levels = ["area", "land", "c_mktsegment"]
    sets = [["c_mktsegment"], ["c_mktsegment", "area"]]
    return cube.cube_query(holed(spark, folder), {"largest": F.max("o_totalprice")}, levels, slicers={"status": "F"}, totals=sets)


@query("level_members", "SELECT DISTINCT c_name AS member FROM customer")
def _(spark, folder):
    return cube.level_members(table(spark, folder, "customer"), "c_name")


@query(
    "cube_metadata",
    """SELECT 'customer' AS dimension, 'r_name' AS level, 0 AS level_number, COUNT(DISTINCT r_name) AS n_members FROM region
       UNION ALL SELECT 'customer', 'n_name', 1, COUNT(DISTINCT n_name) FROM nation
       UNION ALL SELECT 'part', 'p_brand', 0, COUNT(DISTINCT p_brand) FROM part
       UNION ALL SELECT 'part', 'p_partkey', 1, COUNT(DISTINCT p_partkey) FROM part""",
)
def _(spark, folder):
    nations = table(spark, folder, "region").join(table(spark, folder, "nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return cube.cube_metadata(
        {"customer": (nations, ["r_name", "n_name"]), "part": (table(spark, folder, "part"), ["p_brand", "p_partkey"])}
    )


# --- previews and charts -----------------------------------------------------


@query("preview", "SELECT * FROM events ORDER BY event_id LIMIT 1000")
def _(spark, folder):
    return preview.preview(table(spark, folder, "events"), ["event_id"])[0]


@query("preview_where", "SELECT *, (SELECT COUNT(*) FROM events WHERE value > 100) AS total_rows FROM events WHERE value > 100")
def _(spark, folder):
    rows, total = preview.preview(table(spark, folder, "events"), ["event_id"], 10, "value > 100")
    return rows.withColumn("total_rows", total.scalar())


@query(
    "chart_pivot",
    """SELECT day, MAX(v) FILTER (WHERE event_type = 'click') AS click, MAX(v) FILTER (WHERE event_type = 'view') AS view FROM (
         SELECT CAST(ts AS DATE) AS day, event_type, LAST_VALUE(value) OVER (PARTITION BY CAST(ts AS DATE), event_type ORDER BY ts, event_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v FROM events) GROUP BY 1""",
)
def _(spark, folder):
    events = table(spark, folder, "events").withColumn("day", F.col("ts").cast("date"))
    return preview.chart_pivot(events, "day", ["value"], "event_type", ["click", "view"], ["ts", "event_id"])


@query(
    "chart_series",
    """SELECT CAST(ts AS DATE) AS x, event_type AS series, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2""",
)
def _(spark, folder):
    events = table(spark, folder, "events").withColumn("day", F.col("ts").cast("date"))
    return preview.chart_series(events, "day", ["value"], "event_type", ["ts", "event_id"])


@query(
    "infer_chart_columns",
    """SELECT 'event_id' AS "column", TRUE AS is_numeric, FALSE AS is_date UNION ALL SELECT 'event_type', COUNT(TRY_CAST(event_type AS DOUBLE)) > 0, FALSE FROM events
       UNION ALL SELECT 'value', TRUE, FALSE UNION ALL SELECT 'day', FALSE, TRUE
       UNION ALL SELECT 'digits', COUNT(TRY_CAST(digits AS DOUBLE)) > 0, FALSE FROM (SELECT CASE WHEN value > 100 THEN '7' ELSE 'x' END AS digits FROM events)""",
)
def _(spark, folder):
    events = table(spark, folder, "events").select(
        "event_id", "event_type", "value", F.col("ts").cast("date").cast("string").alias("day"),
        F.when(F.col("value") > 100, "7").otherwise("x").alias("digits"),
    )
    return preview.infer_chart_columns(events)


@query(
    "pie_shares",
    f"""WITH {ASSETS}, s AS (SELECT sector AS name, CAST(COUNT(*) AS DOUBLE) AS value FROM assets GROUP BY 1)
        SELECT name, value, value / (SELECT SUM(value) FROM s) AS share FROM s""",
)
def _(spark, folder):
    counted = assets(spark, folder).groupBy("sector").agg(F.count(F.lit(1)).alias("n"))
    return preview.pie_shares(counted, "sector", "n")
