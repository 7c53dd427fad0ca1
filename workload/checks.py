"""Quality checks, contracts and diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.operators import diff, quality
from tablecraft.operators.quality import Check

from .base import plain, query, table

# Orders with a third of the statuses missing and order keys that repeat customers.
CHECKED = "(SELECT *, NULLIF(o_orderstatus, 'P') AS status FROM orders)"


def checked(spark, folder):
    return table(spark, folder, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("P")))


def line(no, type_, label, column, observed, bound, passed, message, source):
    """One line of a report as SQL."""
    name = f"'{column}'" if column else "CAST(NULL AS VARCHAR)"
    return f"""SELECT 'orders' AS "table", {no} AS check_no, '{type_}' AS type, '{label}' AS label, {name} AS "column",
        CAST({observed} AS DOUBLE) AS observed, CAST({bound} AS DOUBLE) AS bound, {passed} AS passed,
        CASE WHEN NOT ({passed}) THEN {message} END AS message FROM {source}"""


ROWS = f"(SELECT COUNT(*) AS n FROM {CHECKED})"
NULLS = f"(SELECT AVG(CASE WHEN status IS NULL THEN 1.0 ELSE 0.0 END) AS r FROM {CHECKED})"
RANGE = f"(SELECT MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM {CHECKED})"
COPIES = f"(SELECT COUNT(*) - COUNT(DISTINCT o_custkey) AS d FROM {CHECKED})"
KEYS = f"(SELECT COUNT(*) - COUNT(DISTINCT o_orderkey) AS d FROM {CHECKED})"


def count_lines(no):
    low = line(no, "row_count", "row_count", None, "n", 1000000, "n >= 1000000", "'[row_count] row count ' || format('{:,}', n) || ' < min 1,000,000'", ROWS)
    high = line(no, "row_count", "row_count", None, "n", 1000, "n <= 1000", "'[row_count] row count ' || format('{:,}', n) || ' > max 1,000'", ROWS)
    return f"{low} UNION ALL {high}"


def null_line(no):
    return line(no, "null_rate", "holes", "status", "r", 0.2, "r <= 0.2", "'[holes:status] null rate ' || printf('%.3f%%', r * 100) || ' > max 20.000%'", NULLS)


def range_lines(no):
    low = line(no, "value_range", "value_range", "o_totalprice", "lo", 0, "lo >= 0", "''", RANGE)
    high = line(no, "value_range", "value_range", "o_totalprice", "hi", 250000, "hi <= 250000", "'[value_range:o_totalprice] max value ' || CAST(hi AS VARCHAR) || ' > 250000.0'", RANGE)
    return f"{low} UNION ALL {high}"


def unique_lines(no):
    bad = line(no, "unique", "unique", "o_custkey", "d", 0, "d = 0", "'[unique:o_custkey] ' || format('{:,}', d) || ' duplicate value(s) found'", COPIES)
    good = line(no + 1, "unique", "unique", "o_orderkey", "d", 0, "d = 0", "''", KEYS)
    return f"{bad} UNION ALL {good}"


ROW_COUNT = Check("row_count", min_rows=1_000_000, max_rows=1_000)
NULL_RATE = Check("null_rate", "status", name="holes", max_null_rate=0.2)
VALUE_RANGE = Check("value_range", "o_totalprice", min_value=0, max_value=250_000)
UNIQUE = [Check("unique", "o_custkey"), Check("unique", "o_orderkey")]
ABSENT = Check("null_rate", "gone", max_null_rate=0.1)


def _reports():
    reports = {
        "dq_row_count": ([ROW_COUNT], count_lines(0)),
        "dq_null_rate": ([NULL_RATE], null_line(0)),
        "dq_value_range": ([VALUE_RANGE], range_lines(0)),
        "dq_unique": (UNIQUE, unique_lines(0)),
        "dq_report": (
            [ROW_COUNT, NULL_RATE, VALUE_RANGE, *UNIQUE, ABSENT],
            " UNION ALL ".join(
                [count_lines(0), null_line(1), range_lines(2), unique_lines(3)]
                + [line(5, "null_rate", "null_rate", "gone", "NULL", "NULL", "FALSE", "'[null_rate] column ''gone'' not found'", "(SELECT 1)")]
            ),
        ),
    }
    for name, (checks, sql) in reports.items():

        def run(spark, folder, checks=checks):
            return quality.dq_report(checked(spark, folder), checks, "orders")

        query(name, sql)(run)


_reports()


@query(
    "dq_observe",
    """SELECT COUNT(*) AS rows, CAST(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS null_rate,
              MIN(value) AS low, MAX(value) AS high FROM events""",
)
def _(spark, folder):
    events = table(spark, folder, "events").withColumn("kind", F.nullif("event_type", F.lit("error")))
    checks = [Check("row_count", min_rows=1), Check("null_rate", "kind", max_null_rate=0.5), Check("value_range", "value", min_value=0)]
    watched, seen = quality.dq_observe(events, checks)
    # What a writer would take, written nowhere.
    watched.write.format("noop").mode("overwrite").save()
    measured = seen.get
    return spark.createDataFrame(
        [(measured["_rows"], measured["_null1"], measured["_min2"], measured["_max2"])],
        "rows long, null_rate double, low double, high double",
    )


@query(
    "dq_violations",
    f"""SELECT o_orderkey, CONCAT_WS(',', CASE WHEN status IS NULL THEN 'holes' END, CASE WHEN o_totalprice < 0 OR o_totalprice > 250000 THEN 'value_range' END,
              CASE WHEN copies > 1 THEN 'unique' END) AS violations
        FROM (SELECT *, COUNT(*) OVER (PARTITION BY o_custkey) AS copies FROM {CHECKED})
        WHERE status IS NULL OR o_totalprice < 0 OR o_totalprice > 250000 OR copies > 1""",
)
def _(spark, folder):
    out = quality.dq_violations(checked(spark, folder), [ROW_COUNT, NULL_RATE, VALUE_RANGE, UNIQUE[0]])
    return out.select("o_orderkey", F.array_join("_violations", ",").alias("violations"))


# --- contracts: each order is a table, its lines are columns -------------------

EXPECTED = """expected AS (
  SELECT DISTINCT 't' || l_orderkey AS table_name, 'c' || l_partkey AS "column",
         CASE WHEN l_partkey % 2 = 0 THEN 'int64' ELSE 'float64' END AS expected
  FROM lineitem WHERE l_returnflag <> 'R')"""
OBSERVED = """observed AS (
  SELECT DISTINCT 't' || l_orderkey AS table_name, 'c' || l_partkey AS "column",
         CASE WHEN l_partkey % 3 = 0 THEN 'bigint' ELSE 'double' END AS actual
  FROM lineitem WHERE l_linestatus = 'O')"""


def contract(spark, folder):
    lines = table(spark, folder, "lineitem")
    name = F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("table_name")
    column = F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("column")
    wanted = F.when(F.col("l_partkey") % 2 == 0, "int64").otherwise("float64").alias("dtype")
    seen = F.when(F.col("l_partkey") % 3 == 0, "bigint").otherwise("double").alias("dtype")
    expected = lines.filter("l_returnflag <> 'R'").select(name, column, wanted).distinct()
    return expected, lines.filter("l_linestatus = 'O'").select(name, column, seen).distinct()


@query(
    "contract_report",
    f"""WITH {EXPECTED}, {OBSERVED}, known AS (SELECT * FROM observed WHERE table_name IN (SELECT table_name FROM expected)),
        both_sides AS (SELECT COALESCE(e.table_name, o.table_name) AS table_name, COALESCE(e."column", o."column") AS "column", expected, actual
                 FROM expected e FULL OUTER JOIN known o ON e.table_name = o.table_name AND e."column" = o."column")
        SELECT table_name, "column", CASE WHEN actual IS NULL THEN 'missing' WHEN expected IS NULL THEN 'extra' ELSE 'dtype' END AS kind,
               expected, actual,
               CASE WHEN actual IS NULL THEN 'missing column ''' || "column" || ''' (expected dtype ''' || expected || ''')'
                    WHEN expected IS NULL THEN 'extra column not in schema: ''' || "column" || ''''
                    ELSE 'column ''' || "column" || ''': expected dtype ''' || expected || ''', got ''' || actual || '''' END AS message
        FROM both_sides WHERE actual IS NULL OR expected IS NULL OR (expected = 'int64') <> (actual = 'bigint')""",
)
def _(spark, folder):
    return quality.contract_report(*contract(spark, folder))


@query(
    "contract_conformance",
    """SELECT 'k' AS "column", 'int' AS dtype, TRUE AS found, COUNT(*) AS n_values, COUNT(*) AS n_conforming, CAST(1 AS DOUBLE) AS share FROM events
       UNION ALL SELECT 'kind', 'double', TRUE, COUNT(*), COUNT(TRY_CAST(kind AS DOUBLE)), CAST(COUNT(TRY_CAST(kind AS DOUBLE)) AS DOUBLE) / COUNT(*)
       FROM (SELECT CASE WHEN event_type = 'click' THEN '1.5' ELSE event_type END AS kind FROM events)
       UNION ALL SELECT 'gone', 'int', FALSE, 0, 0, NULL""",
)
def _(spark, folder):
    events = table(spark, folder, "events").select(
        F.get_json_object("props", "$.k").alias("k"), F.when(F.col("event_type") == "click", "1.5").otherwise(F.col("event_type")).alias("kind")
    )
    return quality.contract_conformance(events, {"k": "int", "kind": "double", "gone": "int"})


# --- diffs: orders against a changed copy --------------------------------------

SHADOW = """shadow AS (
  SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 13 = 0 THEN CAST(o_totalprice AS DECIMAL(12,2)) + 5
              WHEN o_orderkey % 7 = 0 THEN CAST(o_totalprice AS DECIMAL(12,2)) + 0.5 ELSE CAST(o_totalprice AS DECIMAL(12,2)) END AS price
  FROM orders WHERE o_orderpriority <> '5-LOW' OR o_totalprice < 400000
  UNION ALL SELECT o_orderkey + (SELECT MAX(o_orderkey) + 1 FROM orders), o_custkey, 1.00 FROM orders WHERE o_totalprice < 10000)"""
PRIMARY = "main AS (SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(12,2)) AS price FROM orders)"
DIFF = f"""{PRIMARY}, {SHADOW}, wide AS (
  SELECT COALESCE(p.o_orderkey, s.o_orderkey) AS o_orderkey, p.o_custkey AS p_o_custkey, s.o_custkey AS s_o_custkey, p.price AS p_price, s.price AS s_price,
         p.o_orderkey IS NOT NULL AS in_p, s.o_orderkey IS NOT NULL AS in_s,
         ABS(COALESCE(p.price, 0) - COALESCE(s.price, 0)) AS abs_price, ABS(COALESCE(p.o_custkey, 0) - COALESCE(s.o_custkey, 0)) AS abs_custkey
  FROM main p FULL OUTER JOIN shadow s ON p.o_orderkey IS NOT DISTINCT FROM s.o_orderkey),
diff AS (
  SELECT *, CASE WHEN NOT in_p THEN 'shadow_only' WHEN NOT in_s THEN 'primary_only'
                 WHEN abs_price > 1 OR abs_price / NULLIF(ABS(COALESCE(p_price, 0)), 0) > 0.0004 THEN 'breach' ELSE 'within_tolerance' END AS status,
            CASE WHEN COALESCE(p_price, 0) <> 0 THEN CAST(abs_price AS DOUBLE) / CAST(ABS(p_price) AS DOUBLE) END AS rel_price
  FROM wide)"""

SPEC = diff.DiffSpec(
    ["o_orderkey"], {"price": diff.Tolerance(absolute=1, relative=0.0004)}, row_count_tolerance_pct=0.05
)


def primary(spark, folder, *more):
    return table(spark, folder, "orders").select(*more, "o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(12,2)").alias("price"))


def shadow(spark, folder):
    """The primary with some rows gone, some new and some prices changed."""
    p = primary(spark, folder, "o_orderpriority")
    changed = (
        F.when(F.col("o_orderkey") % 13 == 0, F.col("price") + F.lit(5).cast("decimal(12,2)"))
        .when(F.col("o_orderkey") % 7 == 0, F.col("price") + F.lit(0.5).cast("decimal(12,2)"))
        .otherwise(F.col("price"))
    )
    top = p.agg(F.max("o_orderkey") + 1).scalar()
    new = p.filter("price < 10000").select(
        (F.col("o_orderkey") + top).alias("o_orderkey"), "o_custkey", F.lit(1).cast("decimal(12,2)").alias("price")
    )
    kept = p.filter("o_orderpriority <> '5-LOW' OR price < 400000").withColumn("price", changed.cast("decimal(12,2)"))
    return kept.drop("o_orderpriority").unionByName(new)


def diffed(spark, folder, spec=SPEC):
    return diff.diff_tables(primary(spark, folder), shadow(spark, folder), spec)


DIFF_COLUMNS = """o_orderkey, p_o_custkey, s_o_custkey, CAST(p_price AS DOUBLE) AS p_price, CAST(s_price AS DOUBLE) AS s_price,
  CAST(abs_price AS DOUBLE) AS abs_price, ROUND(rel_price, 5) AS rel_price, CAST(in_p AND in_s AS INTEGER) AS _match_key, status AS _diff_status"""


def shown(df):
    out = df.withColumnsRenamed({"_abs_price": "abs_price"}).withColumn("rel_price", F.round(F.col("_rel_price").cast("double"), 5))
    return plain(out.drop("_rel_price", "_abs_o_custkey", "_rel_o_custkey"))


@query("diff_tables", f"WITH {DIFF} SELECT {DIFF_COLUMNS} FROM diff")
def _(spark, folder):
    return shown(diffed(spark, folder))


STATUS = """CASE WHEN COUNT(*) FILTER (WHERE status <> 'within_tolerance') > 0
    OR ABS(COUNT(*) FILTER (WHERE in_p) - COUNT(*) FILTER (WHERE in_s)) > 0.05 * COUNT(*) FILTER (WHERE in_p) THEN 'breach'
  WHEN MAX(GREATEST(abs_custkey, abs_price)) FILTER (WHERE in_p AND in_s) > 0 THEN 'warn' ELSE 'pass' END"""

SUMMARY = f"""SELECT 'orders' AS node_id, {STATUS} AS status, COUNT(*) FILTER (WHERE in_p) AS total_primary, COUNT(*) FILTER (WHERE in_s) AS total_shadow,
  COUNT(*) FILTER (WHERE in_p AND in_s) AS matched, COUNT(*) FILTER (WHERE status = 'primary_only') AS primary_only,
  COUNT(*) FILTER (WHERE status = 'shadow_only') AS shadow_only, COUNT(*) FILTER (WHERE status = 'breach') AS breach_count,
  COUNT(*) FILTER (WHERE status = 'within_tolerance') AS within_tolerance_count,
  ABS(COUNT(*) FILTER (WHERE in_p) - COUNT(*) FILTER (WHERE in_s)) > 0.05 * COUNT(*) FILTER (WHERE in_p) AS row_count_breached,
  CAST(MAX(abs_custkey) FILTER (WHERE in_p AND in_s) AS DOUBLE) AS max_diff_o_custkey, CAST(MAX(abs_price) FILTER (WHERE in_p AND in_s) AS DOUBLE) AS max_diff_price"""


@query("diff_summary", f"WITH {DIFF} {SUMMARY} FROM diff")
def _(spark, folder):
    return diff.diff_summary(diffed(spark, folder), SPEC, "orders")


@query(
    "diff_changed",
    f"""WITH {DIFF} SELECT {DIFF_COLUMNS} FROM diff WHERE NOT COALESCE(in_p AND in_s AND abs_price = 0 AND abs_custkey = 0, FALSE)""",
)
def _(spark, folder):
    """The rows that differ at all, found through digests of buckets."""
    changed = diff.diff_changed(primary(spark, folder), shadow(spark, folder), SPEC).diff
    return shown(changed.filter("NOT coalesce(_match_key = 1 AND _abs_price = 0 AND _abs_o_custkey = 0, false)"))


@query("diff_changed_summary", f"WITH {DIFF} {SUMMARY} FROM diff")
def _(spark, folder):
    return diff.diff_summary(diff.diff_changed(primary(spark, folder), shadow(spark, folder), SPEC), SPEC, "orders")


@query(
    "diff_pct_rows_allowed",
    """SELECT CASE WHEN COUNT(*) FILTER (WHERE event_id % 20 = 0) > 0.06 * COUNT(*) THEN 'breach' WHEN COUNT(*) FILTER (WHERE event_id % 20 = 0) > 0 THEN 'warn' ELSE 'pass' END AS status,
              COUNT(*) FILTER (WHERE event_id % 20 = 0) AS breach_count, COUNT(*) AS matched FROM events""",
)
def _(spark, folder):
    events = table(spark, folder, "events").select("event_id", F.col("value").cast("decimal(12,2)").alias("value"))
    changed = F.when(F.col("event_id") % 20 == 0, F.col("value") + F.lit(9).cast("decimal(12,2)")).otherwise(F.col("value"))
    spec = diff.DiffSpec(["event_id"], default_tolerance=diff.Tolerance(absolute=1, pct_rows_allowed=0.06), unique_keys=True)
    compared = diff.diff_tables(events, events.withColumn("value", changed.cast("decimal(12,2)")), spec)
    return diff.diff_summary(compared, spec).select("status", "breach_count", "matched")


@query(
    "diff_sample",
    f"WITH {DIFF} SELECT {DIFF_COLUMNS} FROM diff WHERE status <> 'within_tolerance' ORDER BY o_orderkey LIMIT 100",
)
def _(spark, folder):
    return shown(diff.diff_sample(diffed(spark, folder), ["o_orderkey"]))


@query(
    "diff_repeated_keys",
    """WITH p AS (SELECT l_orderkey, l_quantity, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS copy FROM lineitem),
            s AS (SELECT l_orderkey, l_quantity, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS copy FROM lineitem WHERE l_returnflag <> 'R')
       SELECT COALESCE(p.l_orderkey, s.l_orderkey) AS l_orderkey, p.l_quantity AS p_l_quantity, s.l_quantity AS s_l_quantity,
              CASE WHEN p.copy IS NULL THEN 'shadow_only' WHEN s.copy IS NULL THEN 'primary_only'
                   WHEN ABS(p.l_quantity - s.l_quantity) > 0 THEN 'breach' ELSE 'within_tolerance' END AS _diff_status
       FROM p FULL OUTER JOIN s ON p.l_orderkey = s.l_orderkey AND p.copy = s.copy""",
)
def _(spark, folder):
    lines = table(spark, folder, "lineitem")
    kept = lines.filter("l_returnflag <> 'R'").select("l_orderkey", "l_quantity")
    out = diff.diff_tables(lines.select("l_orderkey", "l_quantity"), kept, diff.DiffSpec(["l_orderkey"], exact=True))
    return out.select("l_orderkey", "p_l_quantity", "s_l_quantity", "_diff_status")


@query(
    "shadow_run",
    """WITH p AS (SELECT o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total FROM orders GROUP BY 1),
            s AS (SELECT o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) + 1 AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
       SELECT COALESCE(p.o_custkey, s.o_custkey) AS o_custkey, p.total AS p_total, s.total AS s_total,
              CASE WHEN p.o_custkey IS NULL THEN 'shadow_only' WHEN s.o_custkey IS NULL THEN 'primary_only'
                   WHEN ABS(p.total - s.total) > 1.5 THEN 'breach' ELSE 'within_tolerance' END AS _diff_status
       FROM p FULL OUTER JOIN s ON p.o_custkey = s.o_custkey""",
)
def _(spark, folder):
    def by_customer(inputs):
        total = F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast("double").alias("total")
        return inputs["orders"].groupBy("o_custkey").agg(total)

    out = diff.shadow_run(
        by_customer,
        by_customer,
        {"orders": table(spark, folder, "orders")},
        diff.DiffSpec(["o_custkey"], default_tolerance=diff.Tolerance(absolute=1.5), unique_keys=True),
        preprocess_sql="SELECT * FROM {input} WHERE o_orderstatus <> 'P'",
        postprocess_sql="SELECT o_custkey, total + 1 AS total FROM {output}",
    )
    return out.select("o_custkey", "p_total", "s_total", "_diff_status")


@query(
    "shadow_overview",
    f"""WITH {DIFF} SELECT node_id, status, total_primary, total_shadow, matched, breach_count FROM ({SUMMARY} FROM diff)
        UNION ALL SELECT 'lineitem', 'not_run', NULL, NULL, NULL, NULL""",
)
def _(spark, folder):
    summary = diff.diff_summary(diffed(spark, folder), SPEC, "orders")
    expected = spark.createDataFrame([("orders",), ("lineitem",)], "node_id string")
    return diff.shadow_overview([summary], expected)
