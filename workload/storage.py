"""Sources and sinks: what is written is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablecraft.plans.runlog import manifest, manifest_changes
from tablecraft.session import new_path, settle
from tablecraft.sources import files, records, tables, writers

from .base import query, table


def fresh(name: str) -> str:
    """A table name nothing uses yet."""
    return f"tc_{name}_{uuid.uuid4().hex[:12]}"


@query("read_parquet", "SELECT l_returnflag, COUNT(*) AS n, CAST(SUM(l_quantity) AS DOUBLE) AS qty FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY 1")
def _(spark, folder):
    lines = files.read_parquet(spark, f"{folder}/lineitem.parquet").filter(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return lines.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


@query("read_any", "SELECT COUNT(*) AS n, COUNT(DISTINCT p_brand) AS brands FROM part")
def _(spark, folder):
    return files.read_any(spark, f"{folder}/part.parquet").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_brand").alias("brands"))


@query("read_csv", "SELECT * FROM customer")
def _(spark, folder):
    customers = table(spark, folder, "customer")
    path = new_path(spark, "csv")
    writers.write_csv(customers, path)
    return files.read_csv(spark, path, customers.schema)


@query("write_csv", "SELECT event_id, user_id, event_type, value, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events")
def _(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("date").alias("day"))
    path = new_path(spark, "csv")
    writers.write_csv(events, path)
    read = files.read_csv(spark, path)
    return read.withColumns({"event_id": F.col("event_id").cast("bigint"), "user_id": F.col("user_id").cast("bigint")})


@query("csv_options_rfc4180", "SELECT page_id, url, html FROM pages")
def _(spark, folder):
    pages = table(spark, folder, "pages")
    path = new_path(spark, "csv")
    writers.write_csv(pages, path)
    return files.read_csv(spark, path, pages.schema, multiLine=True)


@query("read_stata", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(spark, folder):
    path = new_path(spark, "stata")
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    settle(writers.write_stata(suppliers, path))
    return files.read_stata(spark, path)


@query("write_stata", "SELECT CAST(COUNT(*) AS BIGINT) AS rows FROM orders")
def _(spark, folder):
    orders = table(spark, folder, "orders")
    manifest = settle(writers.write_stata(orders, new_path(spark, "stata")))
    return manifest.agg(F.sum("rows").alias("rows"))


@query("paged_source", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, folder):
    events = table(spark, folder, "events")
    pages = -(-events.count() // 2000)
    path = new_path(spark, "pages")
    row = F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "props": '), "props", F.lit("}"))
    paged = events.select(row.alias("row"), F.pmod(F.xxhash64("event_id"), F.lit(pages)).alias("page"))
    paged.repartition(pages, "page").write.partitionBy("page").text(path)

    def fetch(request):
        """Answer with the stored rows of a page, as an interface would."""
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(request["url"] if ":" in request["url"] else "file://" + request["url"])
        files = store.get_file_info(fs.FileSelector(f"{root}/page={request['page']}", allow_not_found=True))
        parts = [f.path for f in files if f.base_name.startswith("part-")]
        rows = [line for p in parts for line in store.open_input_stream(p).read().decode().splitlines()]
        return 200, '{"items": [' + ", ".join(rows) + "]}"

    bodies = records.paged_source(spark, path, pages, fetch)
    found = records.json_records(bodies, "body", "event_id bigint, props variant", "items")
    return found.select("event_id", F.variant_get("props", "$.k", "bigint").alias("k"))


MANIFEST = """SELECT concat(lang, '/', source, '/', doc_id) AS file, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS sha256
  FROM documents WHERE source NOT IN ('src3', 'src4')"""


def document_files(spark, folder):
    """Documents as files, in a folder per language and source."""
    path = F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string"))
    return table(spark, folder, "documents").select(path.alias("path"), "text", "n_chars")


@query("file_manifest", MANIFEST)
def _(spark, folder):
    return manifest(document_files(spark, folder), "path", "text", ["src3", "src4"])


@query(
    "manifest_changes",
    """SELECT concat(lang, '/', source, '/', doc_id) AS file, CASE WHEN n_chars % 3 = 0 THEN 'removed' ELSE 'changed' END AS change
       FROM documents WHERE n_chars % 3 < 2""",
)
def _(spark, folder):
    old = document_files(spark, folder)
    text = F.when(F.col("n_chars") % 3 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = old.filter("n_chars % 3 > 0").withColumn("text", text)
    return manifest_changes(manifest(old, "path", "text", []), manifest(new, "path", "text", []))


@query("read_table", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def _(spark, folder):
    return tables.read_table(
        spark,
        query="SELECT n_name, r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey WHERE r_name <> :skip",
        args={"skip": "ASIA"},
        nation=table(spark, folder, "nation"),
        region=table(spark, folder, "region"),
    )


@query("read_external_table", "SELECT * FROM part")
def _(spark, folder):
    name = fresh("external")
    writers.push_table(table(spark, folder, "part"), name, path=new_path(spark, "table"))
    return tables.read_external_table(spark, name, "spark_catalog.default")


@query("push_table", "SELECT s_suppkey AS id, s_acctbal AS balance FROM supplier UNION ALL SELECT c_custkey, c_acctbal FROM customer")
def _(spark, folder):
    name = fresh("push")
    first = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    writers.push_table(first, name, path=new_path(spark, "table"))
    writers.push_table(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), name, "append")
    return tables.read_table(spark, name)


@query("run_ddl", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def _(spark, folder):
    name = fresh("ddl")
    writers.run_ddl(spark, f"CREATE TABLE {name} (id INT, name STRING) USING parquet LOCATION '{new_path(spark, 'table')}'")
    table(spark, folder, "nation").createOrReplaceTempView(f"{name}_in")
    writers.run_ddl(spark, f"INSERT INTO {name} SELECT n_nationkey, n_name FROM {name}_in")
    return tables.read_table(spark, name)


@query("materialize", "SELECT l_suppkey, CAST(SUM(l_quantity) AS DOUBLE) AS qty FROM lineitem GROUP BY 1")
def _(spark, folder):
    sums = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("qty"))
    return writers.materialize(sums, fresh("result"), new_path(spark, "table"))


@query(
    "json_records",
    """SELECT event_id, CAST(json_extract(r, '$.k') AS BIGINT) AS k, json_extract_string(r, '$.kind') AS kind FROM (
         SELECT event_id, unnest([CAST(props AS JSON), json_object('k', event_id, 'kind', event_type)]) AS r FROM events)""",
)
def _(spark, folder):
    body = F.concat(
        F.lit('{"data": {"items": ['), "props", F.lit(', {"k": '), F.col("event_id").cast("string"),
        F.lit(', "kind": "'), "event_type", F.lit('"}]}}'),
    )
    bodies = table(spark, folder, "events").select("event_id", body.alias("body"))
    return records.json_records(bodies, "body", "k bigint, kind string", "data.items", ["event_id"])


@query("json_record_single", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, folder):
    return records.json_records(table(spark, folder, "events"), "props", None, None, ["event_id"])
