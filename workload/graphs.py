"""Dependency graphs: customers order parts, suppliers deliver them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.plans import graph

from .base import query, table


def tagged(letter, column):
    return F.concat(F.lit(letter), F.col(column).cast("string"))


def edges(spark, folder):
    """Customer to order to part to supplier."""
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    return (
        orders.select(tagged("c", "o_custkey").alias("src"), tagged("o", "o_orderkey").alias("dst"))
        .unionByName(lines.select(tagged("o", "l_orderkey").alias("src"), tagged("p", "l_partkey").alias("dst")))
        .unionByName(lines.select(tagged("p", "l_partkey").alias("src"), tagged("s", "l_suppkey").alias("dst")))
    )


def cyclic(spark, folder):
    """The same, with each supplier also being the customer of its number."""
    back = table(spark, folder, "supplier").select(tagged("s", "s_suppkey").alias("src"), tagged("c", "s_suppkey").alias("dst"))
    return edges(spark, folder).unionByName(back)


EDGES = """edges AS (
  SELECT DISTINCT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders
  UNION SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem)"""


def walk(starts: str, forward: bool = True, extra: str = "") -> str:
    a, b = ("src", "dst") if forward else ("dst", "src")
    return f"""WITH RECURSIVE {EDGES}{extra}, walk(node, depth) AS (
      {starts} UNION SELECT e.{b}, depth + 1 FROM walk JOIN edges e ON e.{a} = walk.node WHERE depth < 6)"""


@query("reachable", walk("SELECT 'c' || c_custkey, 0 FROM customer WHERE c_mktsegment = 'BUILDING'") + " SELECT node, MIN(depth) AS depth FROM walk GROUP BY 1")
def _(spark, folder):
    starts = table(spark, folder, "customer").filter("c_mktsegment = 'BUILDING'").select(tagged("c", "c_custkey"))
    return graph.reachable(edges(spark, folder), starts)


@query("downstream", walk("SELECT 'p' || p_partkey, 0 FROM part WHERE p_size > 40") + " SELECT node, MIN(depth) AS depth FROM walk WHERE depth > 0 GROUP BY 1")
def _(spark, folder):
    return graph.downstream(edges(spark, folder), table(spark, folder, "part").filter("p_size > 40").select(tagged("p", "p_partkey")))


@query("upstream", walk("SELECT 's' || s_suppkey, 0 FROM supplier WHERE s_acctbal < 2000", False) + " SELECT node, MIN(depth) AS depth FROM walk GROUP BY 1")
def _(spark, folder):
    return graph.upstream(edges(spark, folder), table(spark, folder, "supplier").filter("s_acctbal < 2000").select(tagged("s", "s_suppkey")))


@query(
    "graph_levels",
    walk("SELECT DISTINCT src, 0 FROM edges WHERE src NOT IN (SELECT dst FROM edges)") + " SELECT node, MAX(depth) AS level FROM walk GROUP BY 1",
)
def _(spark, folder):
    return graph.graph_levels(edges(spark, folder))


@query(
    "find_cycles",
    f"""WITH RECURSIVE {EDGES}, e AS (SELECT * FROM edges UNION SELECT 's' || s_suppkey, 'c' || s_suppkey FROM supplier),
        walk(node, n) AS (SELECT src, 0 FROM e UNION SELECT e.dst, n + 1 FROM walk JOIN e ON e.src = walk.node WHERE n < 9)
        SELECT DISTINCT node FROM walk WHERE n = 9""",
)
def _(spark, folder):
    return graph.find_cycles(cyclic(spark, folder))


@query(
    "dangling_and_duplicate",
    """SELECT 'dangling' AS problem, 'order' || l_orderkey AS name, COUNT(DISTINCT l_partkey) AS n_nodes FROM lineitem
       WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY 2
       UNION ALL SELECT 'duplicate', 'total' || o_custkey, COUNT(DISTINCT o_orderkey) FROM orders WHERE o_orderstatus = 'F' GROUP BY 2 HAVING COUNT(*) > 1""",
)
def _(spark, folder):
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    output = F.when(F.col("o_orderstatus") == "F", tagged("total", "o_custkey")).otherwise(tagged("order", "o_orderkey"))
    nodes = orders.select(F.col("o_orderkey").alias("node"), output.alias("output"))
    inputs = lines.select(F.col("l_partkey").alias("node"), tagged("order", "l_orderkey").alias("input"))
    return graph.dangling_and_duplicate(nodes, inputs)


@query(
    "stale_nodes",
    walk("SELECT 'o' || o_orderkey, 0 FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'") + " SELECT node, MIN(depth) AS depth FROM walk GROUP BY 1",
)
def _(spark, folder):
    orders = table(spark, folder, "orders")
    stored = orders.select(tagged("o", "o_orderkey").alias("node"), F.nullif("o_orderstatus", F.lit("P")).alias("hash"))
    edited = F.when(F.col("o_orderpriority") == "1-URGENT", F.regexp_replace("o_orderstatus", "[FP]", "X"))
    current = orders.select(tagged("o", "o_orderkey").alias("node"), edited.otherwise(F.col("o_orderstatus")).alias("hash"))
    return graph.stale_nodes(edges(spark, folder), stored, current)


@query(
    "node_edges",
    """SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def _(spark, folder):
    nodes = table(spark, folder, "orders").select(tagged("o", "o_orderkey").alias("node"), tagged("out_", "o_orderkey").alias("output"))
    inputs = table(spark, folder, "lineitem").select(tagged("p", "l_partkey").alias("node"), tagged("out_", "l_orderkey").alias("input"))
    return graph.node_edges(nodes, inputs)


@query(
    "normalise_path",
    """SELECT c_custkey, '/lake/seg/' || lower(c_mktsegment) || '/' || lower(c_name) AS path, '/base/' || lower(c_name) AS relative FROM customer""",
)
def _(spark, folder):
    raw = F.concat(F.lit("/Lake//tmp/./old/../../Seg/"), "c_mktsegment", F.lit("/"), "c_name")
    return table(spark, folder, "customer").select(
        "c_custkey",
        graph.normalise_path(raw).alias("path"),
        graph.normalise_path(F.concat(F.lit("./x/../"), "c_name"), "/base/").alias("relative"),
    )


@query(
    "sink_source_edges",
    """WITH sinks AS (SELECT 'load_' || o_orderkey AS pipeline, '/Lake//customer/./' || o_custkey || '.dta' AS path, o_custkey AS k, o_orderstatus = 'P' AS t FROM orders
                      UNION ALL SELECT 'mart_' || c_custkey, '/lake/customer/' || c_custkey || '.dta', c_custkey, FALSE FROM customer),
            sources AS (SELECT 'mart_' || c_custkey AS pipeline, c_custkey AS k, c_acctbal < 0 AS t FROM customer
                        UNION ALL SELECT 'audit_' || o_orderkey, o_custkey, FALSE FROM orders
                        UNION ALL SELECT 'zeta_' || c_custkey, c_custkey, TRUE FROM customer WHERE c_mktsegment = 'BUILDING'),
            named AS (SELECT 'mart_' || c_custkey AS pipeline FROM customer)
       SELECT s.pipeline AS source_pipeline, r.pipeline AS target_pipeline, s.path AS shared_path, NOT (s.t OR r.t) AS resolved
       FROM sinks s JOIN sources r ON s.k = r.k WHERE s.pipeline <> r.pipeline
         AND (s.pipeline IN (SELECT pipeline FROM named) OR r.pipeline IN (SELECT pipeline FROM named))""",
)
def _(spark, folder):
    sinks, sources = uses(spark, folder)
    named = table(spark, folder, "customer").select(tagged("mart_", "c_custkey").alias("pipeline"))
    return graph.sink_source_edges(sinks, sources, named)


@query(
    "shared_paths",
    """WITH uses AS (SELECT o_custkey AS k, 'writer' AS role, 'load_' || o_orderkey AS pipeline, o_orderstatus = 'P' AS templated FROM orders
                     UNION ALL SELECT c_custkey, 'writer', 'mart_' || c_custkey, FALSE FROM customer
                     UNION ALL SELECT c_custkey, 'reader', 'mart_' || c_custkey, c_acctbal < 0 FROM customer
                     UNION ALL SELECT o_custkey, 'reader', 'audit_' || o_orderkey, FALSE FROM orders
                     UNION ALL SELECT c_custkey, 'reader', 'zeta_' || c_custkey, TRUE FROM customer WHERE c_mktsegment = 'BUILDING')
       SELECT '/lake/customer/' || k || '.dta' AS shared_path, role, pipeline, templated FROM uses""",
)
def _(spark, folder):
    return graph.shared_paths(*uses(spark, folder))


def uses(spark, folder):
    """Pipelines that write and read one file per customer."""
    orders, customers = table(spark, folder, "orders"), table(spark, folder, "customer")

    def rows(df, name, key, path, key2, flag):
        where = F.concat(F.lit(path), F.col(key2).cast("string"), F.lit(".dta"))
        return df.select(tagged(name, key).alias("pipeline"), where.alias("path"), flag.alias("templated"))

    no = F.lit(False)
    sinks = rows(orders, "load_", "o_orderkey", "/Lake//customer/./", "o_custkey", F.col("o_orderstatus") == "P").unionByName(
        rows(customers, "mart_", "c_custkey", "/lake/customer/", "c_custkey", no)
    )
    sources = (
        rows(customers, "mart_", "c_custkey", "/lake/tmp/../customer/", "c_custkey", F.col("c_acctbal") < 0)
        .unionByName(rows(orders, "audit_", "o_orderkey", "/lake/customer/", "o_custkey", no))
        .unionByName(rows(customers.filter("c_mktsegment = 'BUILDING'"), "zeta_", "c_custkey", "/LAKE/customer/", "c_custkey", F.lit(True)))
    )
    return sinks, sources
