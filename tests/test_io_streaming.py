"""Sources, sinks, previews and streams."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.operators import cube, preview
from tablecraft.operators.quality import Check
from tablecraft.session import shared_folder
from tablecraft.sources import files, records, tables, writers
from tablecraft.sources.tables import Connection
from tablecraft.streaming import flows


def test_csv_round_trip_with_awkward_cells(spark, tmp_path, rows):
    data = [(1, 'say "hi", ok'), (2, "two\nlines"), (3, None), (4, "tab\t;"), (5, "carriage\rreturn"), (6, "back\\slash")]
    df = spark.createDataFrame(data, "a int, b string")
    path = str(tmp_path / "csv")
    writers.write_csv(df, path)
    assert rows(files.read_csv(spark, path, df.schema, multiLine=True)) == data
    text = "".join(p.read_bytes().decode() for p in (tmp_path / "csv").glob("part-*.csv"))
    assert '"say ""hi"", ok"' in text and "back\\slash" in text


def test_csv_infers_types_and_keeps_dates_as_text(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b,d\n1,2.5,2024-01-08\n3,4.0,2024-01-09\n")
    df = files.read_any(spark, str(tmp_path / "x.csv"))
    assert df.dtypes == [("a", "int"), ("b", "double"), ("d", "string")]
    assert df.count() == 2


def test_read_any_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="missing"):
        files.read_any(spark, "")
    with pytest.raises(ValueError, match="'.xyz'"):
        files.read_any(spark, "/a/b.xyz")
    with pytest.raises(ValueError, match="unsupported format"):
        files.read_any(spark, "/a/b.csv", format="excel")
    spark.range(2).write.parquet(str(tmp_path / "noext"))
    assert files.read_any(spark, str(tmp_path / "noext"), format="parquet").count() == 2


def test_stata_round_trip(spark, tmp_path, rows):
    data = [(1, "x", 1.5, True), (2, None, None, False), (None, "é" * 700, 2.5, True)]
    df = spark.createDataFrame(data, "a long, b string, c double, d boolean").drop("d")
    folder = str(tmp_path / "dta")
    manifest = writers.write_stata(df.repartition(2), folder, rows_per_file=1)
    assert manifest.agg(F.sum("rows")).first()[0] == 3
    back = files.read_stata(spark, folder, "a bigint, b string, c double")
    assert rows(back) == sorted([(1, "x", 1.5), (2, "", None), (None, "é" * 700, 2.5)], key=repr)
    assert [f.dataType.simpleString() for f in files.read_stata(spark, folder).schema.fields][1:] == ["string", "double"]


def test_read_table_rules(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert tables.read_table(spark, "three").count() == 3
    assert tables.read_table(spark, query="SELECT DATE '2024-02-29' AS leap, 366 AS days").columns == ["leap", "days"]
    assert tables.read_table(spark, "three", "x", override="SELECT 7 AS n").first().n == 7
    assert tables.read_table(spark, "three", "x", template="SELECT id FROM three WHERE id > :a", args={"a": 1}).count() == 1
    for bad in ({"table": "a", "query": "b"}, {}):
        with pytest.raises(ValueError, match="specif"):
            tables.read_table(spark, **bad)


def test_connections():
    known = {"main": Connection("jdbc:a")}
    assert tables.resolve_connection(url="jdbc:x", key="main", connections=known).url == "jdbc:x"
    assert tables.resolve_connection(key="main", connections=known).url == "jdbc:a"
    inline = tables.resolve_connection(subprotocol="postgresql", server="h:1", database="d", user="u")
    assert (inline.url, inline.options) == ("jdbc:postgresql://h:1/d", {"user": "u"})
    with pytest.raises(KeyError, match="other"):
        tables.resolve_connection(key="other", connections=known)
    with pytest.raises(ValueError, match="no connection"):
        tables.resolve_connection()


def test_jdbc_options(spark):
    connection = Connection("jdbc:a", {"user": "u"})
    assert tables.jdbc_options(connection, query="SELECT 1", partition=None)["query"] == "SELECT 1"
    ranged = tables.jdbc_options(connection, table="t", partition=("id", 0, 100, 4))
    assert (ranged["partitionColumn"], ranged["numPartitions"], ranged["dbtable"], ranged["user"]) == ("id", "4", "t", "u")
    with pytest.raises(ValueError):
        tables.jdbc_options(connection, partition=None)
    df = spark.createDataFrame([(1, float("nan"), "a", [1])], "i int, f double, s string, l array<int>")
    ready = writers.for_jdbc(df)
    assert tuple(ready.first()) == (1, None, "a", "[1]")
    assert writers.jdbc_column_types(ready) == "`i` BIGINT, `f` DOUBLE, `s` STRING, `l` STRING"
    with pytest.raises(ValueError, match="mode"):
        writers.push_jdbc(df, connection, "t", "merge")


def test_push_and_materialize(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    writers.push_table(df, "pushed")
    writers.push_table(df.select(F.lit(2).alias("other"), F.lit("b").alias("names")), "pushed", "append")
    assert rows(spark.table("pushed")) == [(1, "a"), (2, "b")]
    writers.push_table(df, "pushed")
    assert spark.table("pushed").count() == 1
    for bad in ({"table": ""}, {"table": "t", "mode": "merge"}):
        with pytest.raises(ValueError):
            writers.push_table(df, **bad)
    writers.materialize(df, "step.one")
    writers.materialize(df.union(df), "step.one")
    assert writers.stored(spark, "step.one").count() == 2 and "step_one" in writers.stored_names(spark)
    with pytest.raises(KeyError):
        writers.stored(spark, "nothing")


# --- records ---------------------------------------------------------------------


def bodies(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, body string")


def test_json_records(spark, rows):
    df = bodies(spark, '{"d": {"items": [{"a": 1, "b": "x"}, {"a": 2}]}}', '{"d": {"items": {"b": "y"}}}', None)
    out = records.json_records(df, "body", "a int, b string", "d.items", ["id"])
    assert rows(out) == sorted([(0, 1, "x"), (0, 2, None), (1, None, "y")], key=repr)
    found = records.json_records(df, "body", None, "d.items")
    assert found.dtypes == [("a", "bigint"), ("b", "string")] and found.count() == 3
    nested = bodies(spark, '{"o": {"x": 1.5}, "l": [1], "n": null}', '{"o": null}')
    typed = records.json_records(nested, "body")
    assert dict(typed.dtypes)["n"] == "string" and [r.o.x if r.o else None for r in typed.collect()][1] is None
    listed = bodies(spark, '[{"page": 1}, [{"a": 5}]]')
    assert rows(records.json_records(listed, "body", "a int", ["1"])) == [(5,)]
    assert rows(records.json_records(bodies(spark, '{"a": 3}'), "body", "a int")) == [(3,)]


@pytest.mark.parametrize(
    ("text", "message"),
    [('{"d": {}}', "key 'items' not found"), ('{"e": 1}', "key 'd' not found"), ('{"d": {"items": 3}}', "expected a list or an object")],
)
def test_json_record_errors(spark, text, message):
    with pytest.raises(Exception, match=message):
        records.json_records(bodies(spark, text), "body", "a int", "d.items").collect()


def test_paged_source(spark, rows):
    def fetch(request):
        return 200, '{"items": [{"n": %d}], "token": "%s"}' % (request["page"], request["headers"]["t"])

    pages = records.paged_source(spark, "http://unused", 3, fetch, headers={"t": "s"})
    assert pages.rdd.getNumPartitions() == 3
    assert rows(records.json_records(pages, "body", "n int", "items")) == [(0,), (1,), (2,)]
    with pytest.raises(Exception, match="status 404"):
        records.paged_source(spark, "http://unused", 1, lambda r: (404, "")).collect()
    with pytest.raises(ValueError, match="url"):
        records.paged_source(spark, "", 1)
    with pytest.raises(ValueError, match="method"):
        records.paged_source(spark, "u", 1, method="PUT")


# --- previews and cubes -------------------------------------------------------------


def test_preview(spark):
    df = spark.createDataFrame([(i, float("nan") if i == 0 else 1.0) for i in range(5)], "i int, f double")
    shown, total = preview.preview(df, ["i"], 2)
    assert [tuple(r) for r in shown.collect()] == [(0, None), (1, 1.0)] and total.first().total_rows == 5
    shown, total = preview.preview(df, ["i"], 2, "i >= 1")
    assert shown.count() == total.first().total_rows == 4
    assert preview.preview(df, ["i"], 0)[0].count() == 5
    with pytest.raises(ValueError, match="WHERE"):
        preview.preview(df, ["i"], where="zz = 1")


def test_chart_pivot_names_and_last_value(spark):
    df = spark.createDataFrame([("x", "a", 1, 10, 1), ("x", "a", 2, 20, 2), ("x", None, 3, 30, 3)], "x string, g string, v int, w int, t int")
    out = preview.chart_pivot(df, "x", ["v", "w"], "g", ["a", ""], ["t"])
    assert out.columns == ["x", "a · v", "a · w", " · v", " · w"]
    assert tuple(out.first()) == ("x", 2, 20, 3, 30)
    assert preview.chart_pivot(df, "x", ["v"]).columns == ["x", "v"]


def test_cube_axes(spark):
    df = spark.createDataFrame([("n", "a", 1), ("n", "b", 2), ("s", "a", 3), ("s", "c", 4)], "r string, c string, v int")
    out = cube.cube_query(df, {"t": F.sum("v")}, ["r"], {"c": ["a", "b", "z"]}, calculated={"ab": "`a · t` + `b · t`"}, non_empty_columns=True)
    assert out.columns == ["r", "a · t", "b · t", "ab"]
    sliced = cube.cube_query(df, {"t": F.sum("v")}, ["r"], {"c": ["b"]}, slicers={"r": ["n", "s"]})
    assert [tuple(r) for r in sliced.collect()] == [("n", 2)]
    kept = cube.cube_query(df, {"t": F.sum("v")}, ["r"], {"c": ["b"]}, non_empty_rows=False)
    assert kept.count() == 2


# --- streams --------------------------------------------------------------------------


@pytest.fixture
def arriving(spark, tmp_path):
    """Events in four files, oldest first, read one file at a time."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "in")
    size = events.count() // 4 + 1
    for i in range(4):
        part = events.filter(F.floor(F.col("event_id") / size) == i)
        part.coalesce(1).write.mode("append").parquet(path)
    return events, flows.read_stream(spark, path, events.schema, maxFilesPerTrigger="1")


def test_stream_latest_state_over_batches(spark, arriving, rows):
    events, stream = arriving
    changes = flows.run_available(flows.stream_latest_state(stream, "user_id", ["ts", "event_id"], ["event_type"]), "update")
    assert changes.select("_batch").distinct().count() == 4
    latest = flows.latest_rows(changes, "user_id").select("user_id", "event_type")
    expected = events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    assert rows(latest) == rows(expected)


def test_stream_dq_emits_closed_windows(spark, arriving, rows):
    events, stream = arriving
    checks = [Check("row_count", min_rows=1), Check("value_range", "value", min_value=0)]
    out = flows.run_available(flows.stream_dq(stream, checks, "ts", "1 day", "0 seconds"))
    batch = events.groupBy(F.date_trunc("day", "ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    closed = batch.join(batch.agg(F.max("d").alias("last")), F.col("d") < F.col("last")).select("d", "n")
    assert rows(out.select("window_start", "rows")) == rows(closed)
    assert out.filter("NOT passed").isEmpty()


def test_stream_dq_unique_over_batches(spark, arriving, rows):
    """Several unique columns beside other checks; each closed window once, as batch SQL has it."""
    events, stream = arriving
    marked = stream.withColumn("kind", F.nullif("event_type", F.lit("error")))
    checks = [Check("unique", "user_id"), Check("null_rate", "kind", max_null_rate=1), Check("unique", "kind"), Check("value_range", "value")]
    out = flows.run_available(flows.stream_dq(marked, checks, "ts", "1 day", "0 seconds"))
    events.withColumn("kind", F.nullif("event_type", F.lit("error"))).createOrReplaceTempView("arrived")
    expected = spark.sql(
        """SELECT date_trunc('day', ts) AS d, count(*), avg(int(kind IS NULL)), min(value), max(value), count(*) - count(DISTINCT user_id),
                  count(*) - count(DISTINCT kind) - max(int(kind IS NULL)) FROM arrived GROUP BY 1
           HAVING date_trunc('day', max(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM arrived)"""
    )
    names = ["window_start", "rows", "null_rate_kind", "min_value", "max_value", "duplicates_user_id", "duplicates_kind"]
    assert rows(out.select(*names)) == rows(expected)


def test_stream_dq_unique_with_late_rows(spark, tmp_path, rows):
    """A repeat that comes in a later batch counts; one whose window is closed is dropped with its window's other rows."""
    path, schema = str(tmp_path / "late"), "at timestamp, x double, tag string"
    arrivals = [
        [("2024-01-01 00:05:00", 1.0, "a"), ("2024-01-01 00:10:00", None, "a"), ("2024-01-01 01:05:00", 5.0, None)],
        [("2024-01-01 00:50:00", 1.0, "b"), ("2024-01-01 00:55:00", float("nan"), None), ("2024-01-01 01:40:00", 5.0, None)],
        [("2024-01-01 01:45:00", -0.0, "c"), ("2024-01-01 01:46:00", 0.0, "d")],
        [("2024-01-01 00:20:00", 1.0, "a"), ("2024-01-01 05:00:00", 9.0, "z")],
        [("2024-01-01 05:00:00", 9.0, "z")],
    ]
    for i, batch in enumerate(arrivals):
        part = spark.createDataFrame(batch, "at string, x double, tag string").withColumn("at", F.col("at").cast("timestamp"))
        part.coalesce(1).write.mode("append").parquet(path)
    stream = flows.read_stream(spark, path, T._parse_datatype_string(schema), maxFilesPerTrigger="1")
    out = flows.run_available(flows.stream_dq(stream, [Check("unique", "x"), Check("unique", "tag")], "at", "1 hour", "30 minutes"))
    got = rows(out.select(F.date_format("window_start", "HH"), "rows", "duplicates_x", "duplicates_tag", "passed"))
    # 00: four rows in time, x 1, null, 1, NaN; tags a, a, b, null. 01: x 5, 5, -0, 0; tags null, null, c, d.
    # The second batch moves the watermark to 01:10, the third closes the window: the row of 00:20 comes too late.
    assert got == [("00", 4, 2, 1, False), ("01", 4, 2, 1, False)]


def test_states_of_silent_keys_end(spark, tmp_path, rows):
    """Ten batches of new keys, one of which comes back: state rows stop growing, and the table holds every key."""
    path, schema = str(tmp_path / "keys"), "k string, at timestamp, n int, note string"
    data = []
    for hour in range(10):
        batch = [(f"k{hour}-{i}", f"2024-01-01 {hour:02}:{minute:02}:00", minute, "x" if minute == 10 else None) for i in range(20) for minute in (10, 20)]
        data.append(batch + ([("back", f"2024-01-01 {hour:02}:30:00", hour, "seen" if hour == 0 else None)] if hour in (0, 1, 6) else []))
    data.append([("end", "2024-01-03 00:00:00", 0, None)])
    for batch in data:
        part = spark.createDataFrame(batch, "k string, at string, n int, note string").withColumn("at", F.col("at").cast("timestamp"))
        part.coalesce(1).write.mode("append").parquet(path)
    stream = flows.read_stream(spark, path, T._parse_datatype_string(schema), maxFilesPerTrigger="1")
    closed = flows.stream_closed_states(stream, "k", ["at"], ["n", "note"], "at", "90 minutes", "0 seconds")
    target = str(tmp_path / "closed")
    run = closed.writeStream.option("checkpointLocation", str(tmp_path / "progress")).format("parquet").option("path", target)
    query = run.trigger(availableNow=True).start()
    query.awaitTermination()
    sizes = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert len(sizes) >= 10 and max(sizes) <= 3 * 21 and sizes[9] <= max(sizes[:5])

    states = spark.read.parquet(target)
    assert states.count() == 202 and states.filter("k = 'back'").count() == 2
    events = [row for batch in data for row in batch if row[0] != "end"]
    expected = {}
    for k, at, n, note in sorted(events, key=lambda e: e[1]):
        expected[k] = (k, n, note or expected.get(k, (None, None, None))[2])
    assert rows(flows.latest_states(states, "k", ["n", "note"]).select("k", "n", "note")) == sorted(expected.values(), key=repr)


def test_shared_folder_is_the_named_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")

