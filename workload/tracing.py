"""Column lineage and row provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.plans import lineage, provenance
from tablecraft.session import new_path

from .base import query, table
from .graphs import tagged

# Each order is a node. It reads columns (parts) of tables (suppliers); a third of
# them pass through, and its status is a new column.
INPUTS = """inputs AS (
  SELECT DISTINCT 'o' || l_orderkey AS node_id, l_linenumber * 1000000 + l_suppkey AS input_no, 's' || l_suppkey AS source_node_id, 'p' || l_partkey AS "column"
  FROM lineitem)"""
OUTPUTS = """outputs AS (
  SELECT DISTINCT 'o' || l_orderkey AS node_id, 'p' || l_partkey AS "column" FROM lineitem WHERE l_returnflag = 'A'
  UNION SELECT 'o' || o_orderkey, 'status' FROM orders)"""
ACCESSED = """accessed AS (
  SELECT DISTINCT 'o' || l_orderkey AS node_id, l_linenumber * 1000000 + l_suppkey AS input_no, 's' || l_suppkey AS source_node_id,
         CASE WHEN l_returnflag = 'R' THEN NULL ELSE 'p' || l_partkey END AS "column"
  FROM lineitem WHERE l_linestatus = 'O')"""


def by_name(outputs: str, known: str, confidence: str, expand: bool = False) -> str:
    """SQL of lineage by name; without ``expand`` a new column has one line per input."""
    column = 'k."column"' if expand else "'*'"
    return f"""SELECT o.node_id, o."column" AS output_column, f.source_node_id, o."column" AS source_column, '{confidence}' AS confidence
      FROM {outputs} o JOIN (SELECT node_id, "column", arg_min(source_node_id, input_no) AS source_node_id FROM {known} GROUP BY 1, 2) f
        ON o.node_id = f.node_id AND o."column" = f."column"
      UNION ALL SELECT {'' if expand else 'DISTINCT '}o.node_id, o."column", k.source_node_id, {column}, '{confidence}'
      FROM {outputs} o JOIN {known} k ON o.node_id = k.node_id
      WHERE NOT EXISTS (SELECT 1 FROM {known} x WHERE x.node_id = o.node_id AND x."column" = o."column")"""


def inputs(spark, folder):
    return (
        table(spark, folder, "lineitem")
        .select(
            tagged("o", "l_orderkey").alias("node_id"),
            (F.col("l_linenumber") * F.lit(1000000) + F.col("l_suppkey")).alias("input_no"),
            tagged("s", "l_suppkey").alias("source_node_id"),
            tagged("p", "l_partkey").alias("column"),
        )
        .distinct()
    )


def outputs(spark, folder):
    passed = table(spark, folder, "lineitem").filter("l_returnflag = 'A'")
    new = table(spark, folder, "orders").select(tagged("o", "o_orderkey").alias("node_id"), F.lit("status").alias("column"))
    return passed.select(tagged("o", "l_orderkey").alias("node_id"), tagged("p", "l_partkey").alias("column")).union(new).distinct()


@query("lineage_schema_diff", f"WITH {INPUTS}, {OUTPUTS} {by_name('outputs', 'inputs', 'schema_diff')}")
def schema_diff(spark, folder):
    return lineage.lineage_schema_diff(inputs(spark, folder), outputs(spark, folder))


@query("lineage_schema_diff_expanded", f"WITH {INPUTS}, {OUTPUTS} {by_name('outputs', 'inputs', 'schema_diff', True)}")
def _(spark, folder):
    return lineage.lineage_schema_diff(inputs(spark, folder), outputs(spark, folder), expand=True)


READ = """read AS (
  SELECT DISTINCT node_id, input_no, source_node_id, "column" FROM accessed WHERE "column" IS NOT NULL
  UNION SELECT i.node_id, i.input_no, i.source_node_id, i."column" FROM inputs i
        WHERE EXISTS (SELECT 1 FROM accessed a WHERE a.node_id = i.node_id AND a.source_node_id = i.source_node_id AND a."column" IS NULL)),
watched AS (SELECT * FROM outputs WHERE node_id IN (SELECT node_id FROM read)),
unwatched AS (SELECT * FROM outputs WHERE node_id NOT IN (SELECT node_id FROM read))"""


@query(
    "lineage_tracked",
    f"""WITH {INPUTS}, {OUTPUTS}, {ACCESSED}, {READ}
        {by_name('watched', 'read', 'tracked')} UNION ALL {by_name('unwatched', 'inputs', 'schema_diff')}""",
)
def _(spark, folder):
    column = F.when(F.col("l_returnflag") != "R", tagged("p", "l_partkey"))
    accessed = (
        table(spark, folder, "lineitem")
        .filter("l_linestatus = 'O'")
        .select(
            tagged("o", "l_orderkey").alias("node_id"),
            (F.col("l_linenumber") * F.lit(1000000) + F.col("l_suppkey")).alias("input_no"),
            tagged("s", "l_suppkey").alias("source_node_id"),
            column.alias("column"),
        )
        .distinct()
    )
    return lineage.lineage_tracked(accessed, inputs(spark, folder), outputs(spark, folder))


# A lineage table of three hops: supplier, part, order, customer.
LINEAGE = """lineage AS (
  SELECT DISTINCT 'p' || l_partkey AS node_id, 'cost' AS output_column, 's' || l_suppkey AS source_node_id, 'price' AS source_column,
         CASE l_returnflag WHEN 'A' THEN 'sql_exact' WHEN 'N' THEN 'tracked' ELSE 'schema_diff' END AS confidence FROM lineitem
  UNION SELECT 'o' || l_orderkey, 'total', 'p' || l_partkey, 'cost', CASE l_linestatus WHEN 'O' THEN 'sql_exact' ELSE 'tracked' END FROM lineitem
  UNION SELECT 'c' || o_custkey, 'spent', 'o' || o_orderkey, 'total', 'sql_exact' FROM orders)"""


def hops(spark, folder):
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    flag = F.when(F.col("l_returnflag") == "A", "sql_exact").when(F.col("l_returnflag") == "N", "tracked").otherwise("schema_diff")

    def rows(df, node, output, source, column, confidence):
        return df.select(
            node.alias("node_id"), F.lit(output).alias("output_column"), source.alias("source_node_id"),
            F.lit(column).alias("source_column"), confidence.alias("confidence"),
        )

    status = F.when(F.col("l_linestatus") == "O", "sql_exact").otherwise("tracked")
    return (
        rows(lines, tagged("p", "l_partkey"), "cost", tagged("s", "l_suppkey"), "price", flag)
        .union(rows(lines, tagged("o", "l_orderkey"), "total", tagged("p", "l_partkey"), "cost", status))
        .union(rows(orders, tagged("c", "o_custkey"), "spent", tagged("o", "o_orderkey"), "total", F.lit("sql_exact")))
        .distinct()
    )


@query(
    "lineage_upsert",
    f"""WITH {LINEAGE} SELECT * FROM lineage WHERE node_id NOT IN (SELECT 'p' || p_partkey FROM part WHERE p_size > 25)
        UNION ALL SELECT 'p' || p_partkey, 'cost', 'catalogue', 'retail', 'sql_exact' FROM part WHERE p_size > 25""",
)
def _(spark, folder):
    fresh = table(spark, folder, "part").filter("p_size > 25").select(
        tagged("p", "p_partkey").alias("node_id"), F.lit("cost").alias("output_column"), F.lit("catalogue").alias("source_node_id"),
        F.lit("retail").alias("source_column"), F.lit("sql_exact").alias("confidence"),
    )
    return lineage.lineage_upsert(hops(spark, folder), fresh)


@query(
    "lineage_stored",
    f"""WITH {LINEAGE} SELECT * FROM lineage WHERE node_id NOT IN (SELECT 'p' || p_partkey FROM part WHERE p_size > 25 OR p_brand = 'Brand#11')
        UNION ALL SELECT 'p' || p_partkey, 'cost', 'catalogue', 'retail', 'sql_exact' FROM part WHERE p_size > 25""",
)
def _(spark, folder):
    """Kept as a table: filled, then replaced node by node; parts of one brand lose their rows."""
    stored = lineage.LineageTable(new_path(spark, "lineage-table"), buckets=64).create(spark)
    stored.replace(hops(spark, folder))
    parts = table(spark, folder, "part")
    fresh = parts.filter("p_size > 25").select(
        tagged("p", "p_partkey").alias("node_id"), F.lit("cost").alias("output_column"), F.lit("catalogue").alias("source_node_id"),
        F.lit("retail").alias("source_column"), F.lit("sql_exact").alias("confidence"),
    )
    stored.replace(fresh, parts.filter("p_brand = 'Brand#11'").select(tagged("p", "p_partkey")))
    return stored.read(spark)


@query("lineage_query", f"WITH {LINEAGE} SELECT * FROM lineage ORDER BY node_id, output_column, source_node_id")
def _(spark, folder):
    return lineage.lineage_query(hops(spark, folder))


@query(
    "lineage_edges",
    f"""WITH {LINEAGE} SELECT source_node_id, node_id, output_column, source_column, confidence,
        COUNT(*) OVER (PARTITION BY source_node_id, node_id) AS n_mappings FROM lineage""",
)
def _(spark, folder):
    return lineage.lineage_edges(hops(spark, folder))


@query(
    "lineage_closure",
    f"""WITH RECURSIVE {LINEAGE}, r AS (SELECT *, CASE confidence WHEN 'sql_exact' THEN 1 WHEN 'tracked' THEN 2 ELSE 3 END AS step FROM lineage),
        walk(node_id, col, sure) AS (
          SELECT 'c' || c_custkey, 'spent', 1 FROM customer WHERE c_mktsegment = 'MACHINERY'
          UNION SELECT source_node_id, source_column, GREATEST(sure, step) FROM walk JOIN r ON r.node_id = walk.node_id AND r.output_column = walk.col)
        SELECT node_id, col AS "column", CASE MIN(sure) WHEN 1 THEN 'sql_exact' WHEN 2 THEN 'tracked' ELSE 'schema_diff' END AS confidence
        FROM walk WHERE node_id NOT LIKE 'c%' GROUP BY 1, 2""",
)
def _(spark, folder):
    starts = table(spark, folder, "customer").filter("c_mktsegment = 'MACHINERY'")
    return lineage.lineage_closure(hops(spark, folder), starts.select(tagged("c", "c_custkey").alias("node_id"), F.lit("spent").alias("column")))


# --- row provenance ------------------------------------------------------------

NUMBERED = """orders_id AS (SELECT *, ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS id FROM orders),
customer_id AS (SELECT *, ROW_NUMBER() OVER (ORDER BY c_custkey) - 1 AS id FROM customer)"""


def numbered_orders(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return provenance.stamp_row_id(orders, ["o_orderkey"])


def numbered(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return numbered_orders(spark, folder), provenance.stamp_row_id(customers, ["c_custkey"])


@query("stamp_row_id", "SELECT *, ROW_NUMBER() OVER (ORDER BY p_partkey) - 1 AS _row_id FROM part")
def _(spark, folder):
    return provenance.stamp_row_id(table(spark, folder, "part"), ["p_partkey"])


@query(
    "trace_rowwise",
    f"WITH {NUMBERED} SELECT 'open' AS node_id, id AS output_row_id, 'orders' AS source_node_id, id AS source_row_id FROM orders_id WHERE o_orderstatus = 'O'",
)
def _(spark, folder):
    orders = numbered_orders(spark, folder)
    return provenance.trace_rowwise(orders.filter("o_orderstatus = 'O'"), "open", "orders")


def joined(orders, customers):
    left = orders.withColumnRenamed("_row_id", "_left_id")
    right = customers.withColumnRenamed("_row_id", "_right_id")
    both = left.join(right.filter("c_mktsegment <> 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return both.withColumn("_row_id", F.col("_left_id"))


@query(
    "trace_join",
    f"""WITH {NUMBERED}, j AS (SELECT o.id AS l, c.id AS r FROM orders_id o LEFT JOIN customer_id c ON o_custkey = c_custkey AND c_mktsegment <> 'BUILDING')
        SELECT 'joined' AS node_id, l AS output_row_id, 'orders' AS source_node_id, l AS source_row_id FROM j
        UNION ALL SELECT 'joined', l, 'customer', r FROM j WHERE r IS NOT NULL""",
)
def _(spark, folder):
    out = joined(*numbered(spark, folder))
    return provenance.trace_join(out, "joined", {"orders": "_left_id", "customer": "_right_id"})


def grouped(orders):
    counted = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return provenance.stamp_row_id(counted, ["o_custkey"])


GROUPED = "grouped AS (SELECT o_custkey, COUNT(*) AS n, ROW_NUMBER() OVER (ORDER BY o_custkey) - 1 AS id FROM orders GROUP BY 1)"


@query(
    "trace_group",
    f"""WITH {NUMBERED}, {GROUPED} SELECT 'per_customer' AS node_id, g.id AS output_row_id, 'orders' AS source_node_id, o.id AS source_row_id
        FROM orders_id o JOIN grouped g ON o.o_custkey = g.o_custkey""",
)
def _(spark, folder):
    orders = numbered_orders(spark, folder)
    return provenance.trace_group(orders, grouped(orders), ["o_custkey"], "per_customer", "orders")


@query(
    "trace_opaque",
    f"WITH {GROUPED} SELECT 'per_customer' AS node_id, id AS output_row_id, '__opaque__' AS source_node_id, CAST(-1 AS BIGINT) AS source_row_id FROM grouped",
)
def _(spark, folder):
    return provenance.trace_opaque(grouped(table(spark, folder, "orders")), "per_customer")


@query(
    "probe_status",
    f"""WITH {GROUPED} SELECT 'orders' AS node_id, 'ok' AS status, COUNT(*) AS row_count FROM orders
        UNION ALL SELECT 'per_customer', 'opaque', COUNT(*) FROM grouped UNION ALL SELECT 'export', 'skipped', 0""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders")
    groups = grouped(orders)
    return provenance.probe_status({"orders": orders, "per_customer": groups}, provenance.trace_opaque(groups, "per_customer"), ["export"])


def walked(spark, folder):
    """Orders and customers are joined, then the joined rows are grouped by customer."""
    orders, customers = numbered(spark, folder)
    wide = joined(orders, customers)
    groups = grouped(orders)
    edges = provenance.trace_join(wide, "joined", {"orders": "_left_id", "customer": "_right_id"}).unionByName(
        provenance.trace_group(wide, groups, ["o_custkey"], "per_customer", "joined")
    )
    starts = groups.select(F.lit("per_customer").alias("node_id"), F.col("_row_id").alias("row_id"))
    return provenance.trace_rows(edges, starts, {"orders": orders, "customer": customers})


WALKED = f"""{NUMBERED}, {GROUPED}, j AS (
  SELECT g.id AS start_row, o.id AS l, o.o_orderkey, c.id AS r, c.c_name FROM orders_id o JOIN grouped g ON g.o_custkey = o.o_custkey
  LEFT JOIN customer_id c ON o.o_custkey = c_custkey AND c_mktsegment <> 'BUILDING'),
walked AS (
  SELECT start_row, 'orders' AS node_id, l AS row_id, CAST(1 AS BIGINT) AS paths, CAST(o_orderkey AS VARCHAR) AS value, FALSE AS opaque FROM j
  UNION ALL SELECT start_row, 'customer', r, COUNT(*), ANY_VALUE(c_name), FALSE FROM j WHERE r IS NOT NULL GROUP BY 1, 3)"""


@query("trace_rows", f"WITH {WALKED} SELECT start_row, node_id, row_id, paths, value, opaque FROM walked")
def _(spark, folder):
    value = F.coalesce(F.get_json_object("row_values", "$.c_name"), F.get_json_object("row_values", "$.o_orderkey"))
    return walked(spark, folder).select("start_row", "node_id", "row_id", "paths", value.alias("value"), "opaque")


@query(
    "trace_by_source",
    f"""WITH {WALKED}, rows AS (SELECT DISTINCT node_id, row_id, opaque FROM walked)
        SELECT *, COUNT(*) OVER (PARTITION BY node_id) AS n_rows FROM rows""",
)
def _(spark, folder):
    return provenance.trace_by_source(walked(spark, folder)).select("node_id", "row_id", "opaque", "n_rows")
