"""Lineage, provenance, graphs and run logs."""

import datetime

import pytest
from pyspark.sql import functions as F

from tablecraft.plans import doubling, exact, graph, lineage, provenance, runlog


# --- exact lineage ---------------------------------------------------------------


@pytest.fixture
def frames(spark):
    raw = spark.createDataFrame([(1.0, 2.0, "a")], "price double, volume double, k string")
    dim = spark.createDataFrame([("a", "x")], "k string, name string")
    raw.createOrReplaceTempView("raw")
    dim.createOrReplaceTempView("dim")
    return {"raw": raw, "dim": dim}


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("SELECT k, upper(name) FROM dim", {"k": ["dim.k"], "upper(name)": ["dim.name"]}),
        ("SELECT d.* FROM raw r JOIN dim d USING (k)", {"k": ["dim.k"], "name": ["dim.name"]}),
        ("SELECT CASE WHEN volume > 5 THEN price END AS dear, 'c' AS c FROM raw", {"dear": ["raw.price", "raw.volume"], "c": []}),
        (
            "WITH c AS (SELECT k, sum(price) p FROM raw GROUP BY k) SELECT a.p + b.p AS s, a.k FROM c a JOIN c b ON a.k = b.k",
            {"s": ["raw.price"], "k": ["raw.k"]},
        ),
        (
            "SELECT count(*) n, r.k, max(name) m FROM raw r JOIN dim d ON r.k = d.k GROUP BY r.k",
            {"n": [], "k": ["raw.k"], "m": ["dim.name"]},
        ),
        ("SELECT price x FROM raw UNION ALL SELECT volume FROM raw", {"x": ["raw.price", "raw.volume"]}),
        ("SELECT a.price - b.volume AS d FROM raw a JOIN raw b ON a.k = b.k", {"d": ["raw.price", "raw.volume"]}),
        ("SELECT row_number() OVER (PARTITION BY k ORDER BY volume) rn FROM raw", {"rn": ["raw.k", "raw.volume"]}),
        ("SELECT e FROM raw LATERAL VIEW explode(array(price, volume)) t AS e", {"e": ["raw.price", "raw.volume"]}),
    ],
)
def test_exact_lineage_of_sql(spark, frames, text, expected):
    found = exact.lineage_rows(spark.sql(text), frames)
    assert {c: [".".join(s) for s in sources] for c, sources in found.items()} == expected


def test_exact_lineage_of_frames(spark, frames):
    raw, dim = frames["raw"], frames["dim"]
    step = raw.join(dim, "k").withColumn("z", F.col("price") + F.length("name")).groupBy("name").agg(F.sum("z").alias("zz"))
    assert exact.lineage_rows(step, frames) == {"name": [("dim", "name")], "zz": [("dim", "name"), ("raw", "price")]}
    passed = spark.sql("SELECT price + 1 AS z FROM {t}", t=raw)
    assert exact.lineage_rows(passed, frames) == {"z": [("raw", "price")]}
    table = exact.lineage_exact(spark.sql("SELECT 1 AS one, k FROM raw"), frames, "n")
    assert {tuple(r) for r in table.collect()} == {
        ("n", "one", None, None, "sql_exact"),
        ("n", "k", "raw", "k", "sql_exact"),
    }


# --- lineage from names ------------------------------------------------------------

INPUT = "node_id string, input_no long, source_node_id string, column string"


def test_schema_diff(spark, rows):
    inputs = spark.createDataFrame([("n", 0, "a", "x"), ("n", 0, "a", "y"), ("n", 1, "b", "x"), ("n", 1, "b", "z")], INPUT)
    outputs = spark.createDataFrame([("n", "x"), ("n", "new"), ("empty", "q")], "node_id string, column string")
    got = rows(lineage.lineage_schema_diff(inputs, outputs, expand=True).drop("confidence"))
    assert got == sorted(
        [("n", "x", "a", "x")] + [("n", "new", s, c) for s, c in (("a", "x"), ("a", "y"), ("b", "x"), ("b", "z"))], key=repr
    )
    short = lineage.lineage_schema_diff(inputs, outputs).drop("confidence")
    assert rows(short) == [("n", "new", "a", "*"), ("n", "new", "b", "*"), ("n", "x", "a", "x")]


def test_tracked(spark, rows):
    inputs = spark.createDataFrame([("n", 0, "a", "x"), ("n", 0, "a", "y"), ("m", 0, "a", "x"), ("b", 0, "a", "x"), ("b", 0, "a", "y")], INPUT)
    accessed = spark.createDataFrame([("n", 0, "a", "x"), ("b", 0, "a", None)], INPUT)
    outputs = spark.createDataFrame([("n", "x"), ("n", "new"), ("m", "new"), ("b", "new")], "node_id string, column string")
    assert rows(lineage.lineage_tracked(accessed, inputs, outputs, expand=True)) == sorted(
        [
            ("n", "x", "a", "x", "tracked"),
            ("n", "new", "a", "x", "tracked"),
            ("m", "new", "a", "x", "schema_diff"),
            ("b", "new", "a", "x", "tracked"),
            ("b", "new", "a", "y", "tracked"),
        ],
        key=repr,
    )


def chain(spark):
    return spark.createDataFrame(
        [
            ("c", "z", "b", "y", "sql_exact"),
            ("b", "y", "a", "x", "schema_diff"),
            ("c", "z", "a", "x", "tracked"),
            ("a", "x", "c", "z", "sql_exact"),
        ],
        "node_id string, output_column string, source_node_id string, source_column string, confidence string",
    )


def test_closure_keeps_the_surest_path_and_ends_on_cycles(spark, rows):
    start = spark.createDataFrame([("c", "z")], "node_id string, column string")
    assert rows(lineage.lineage_closure(chain(spark), start)) == [("a", "x", "tracked"), ("b", "y", "sql_exact")]
    down = spark.createDataFrame([("b", "y")], "node_id string, column string")
    assert rows(lineage.lineage_closure(chain(spark), down, "downstream")) == [("a", "x", "sql_exact"), ("c", "z", "sql_exact")]


def test_upsert_query_edges(spark, rows):
    table = chain(spark)
    fresh = table.filter("node_id = 'b'").withColumn("confidence", F.lit("tracked"))
    assert lineage.lineage_upsert(table, fresh).filter("node_id = 'b' AND confidence = 'tracked'").count() == 1
    assert [r.source_node_id for r in lineage.lineage_query(table, "c").collect()] == ["a", "b"]
    edges = {(r.source_node_id, r.node_id): r.n_mappings for r in lineage.lineage_edges(table).collect()}
    assert edges == {("a", "b"): 1, ("a", "c"): 1, ("b", "c"): 1, ("c", "a"): 1}


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_stored_lineage_rewrites_only_touched_partitions(spark, rows, tmp_path):
    columns = ", ".join(f"{c} string" for c in lineage.LINEAGE)
    every = [(f"n{i}", f"c{j}", "src", f"s{j}", "tracked") for i in range(40) for j in range(3)]
    table = lineage.LineageTable(str(tmp_path / "kept"), buckets=16).create(spark)
    assert rows(table.read(spark)) == []
    table.replace(spark.createDataFrame(every, columns))
    assert rows(table.read(spark)) == sorted(every)
    table.create(spark)  # leaves what is there
    before = files(tmp_path / "kept")

    touched = table.replace(spark.createDataFrame([("n7", "new", "src", "s0", "sql_exact"), ("n99", "c", "src", "s", "tracked")], columns))
    expected = [r for r in every if r[0] != "n7"] + [("n7", "new", "src", "s0", "sql_exact"), ("n99", "c", "src", "s", "tracked")]
    assert rows(table.read(spark)) == sorted(expected) and 1 <= len(touched) <= 2
    after = files(tmp_path / "kept")
    same = {f for f in before if after.get(f) == before[f]}
    assert {f.split("/")[0] for f in before.keys() - same} == {f"bucket={b}" for b in touched} and same

    # Nodes that have no columns any more, down to the last row of a partition.
    table.replace(spark.createDataFrame([], columns), spark.createDataFrame([(f"n{i}",) for i in range(100)], "node string"))
    assert rows(table.read(spark)) == []
    assert table.replace(spark.createDataFrame([(None, "c", "s", "s", "tracked")], columns)) == []


def test_stored_lineage_of_one_node_reads_one_partition(spark, rows, tmp_path):
    columns = ", ".join(f"{c} string" for c in lineage.LINEAGE)
    table = lineage.LineageTable(str(tmp_path / "kept"), buckets=16).create(spark)
    table.replace(spark.createDataFrame([(f"n{i}", "c", "src", "s", "tracked") for i in range(40)], columns))
    one = table.read(spark, "n7")
    assert rows(one) == [("n7", "c", "src", "s", "tracked")]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(node_id,n7)" in plan
    assert len(one.inputFiles()) > 1  # all files are listed, and one partition is left to read
    scanned = one._jdf.queryExecution().executedPlan().collectLeaves().head()
    scanned.execute()
    number = plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
    assert "bucket" in number and "= " in number
    assert table.read(spark, "nowhere").isEmpty()


def test_equal_items_give_one_row(spark):
    traced = spark.range(5000).select(F.lit("src").alias("node_id"), F.lit(1).alias("row_id"), F.lit("{}").alias("row_values"), F.lit(False).alias("opaque"))
    (only,) = provenance.trace_by_source(traced).collect()
    assert only.n_rows == 1


def test_closure_of_a_long_chain(spark):
    links = [(f"n{i}", "x", f"n{i + 1}", "x", "tracked") for i in range(30)] + [("n30", "x", "n0", "x", "sql_exact")]
    table = spark.createDataFrame(links, "node_id string, output_column string, source_node_id string, source_column string, confidence string")
    start = spark.createDataFrame([("n0", "x")], "node_id string, column string")
    assert lineage.lineage_closure(table, start).count() == 30


# --- provenance ----------------------------------------------------------------------


def edge_table(spark, data):
    return spark.createDataFrame(data, "node_id string, output_row_id long, source_node_id string, source_row_id long")


def test_trace_to_the_source(spark):
    source = spark.createDataFrame([(i, f"town{i}", i % 3 or None) for i in range(8)], "_row_id int, town string, zone int")
    # Every second row went on, in reverse.
    edges = edge_table(spark, [("north", i, "towns", 7 - 2 * i) for i in range(4)])
    for row, source_row, zone in ((1, 5, 2), (2, 3, "null")):
        (r,) = provenance.trace_row(edges, "north", row, {"towns": source}).collect()
        assert (r.node_id, r.row_id, r.opaque) == ("towns", source_row, False)
        assert r.row_values == f'{{"town":"town{source_row}","zone":{zone}}}'
    assert provenance.trace_row(edges, "south", 0, {"towns": source}).count() == 0
    assert provenance.trace_row(edges, "north", 4, {"towns": source}).count() == 0


def test_trace_opaque_and_shared_paths(spark, rows):
    source = spark.createDataFrame([(0, "v")], "_row_id int, x string")
    edges = edge_table(
        spark,
        [("agg", 0, "__opaque__", -1), ("out", 0, "l", 0), ("out", 0, "r", 0), ("out", 0, "agg", 0), ("l", 0, "src", 0), ("r", 0, "src", 0)],
    )
    out = provenance.trace_row(edges, "out", 0, {"src": source})
    assert rows(out.select("node_id", "row_id", "paths", "opaque")) == [("agg", 0, 1, True), ("src", 0, 2, False)]


def test_trace_goes_all_the_way(spark):
    source = spark.createDataFrame([(0, "v")], "_row_id int, x string")
    edges = edge_table(spark, [(f"n{i}", 0, f"n{i + 1}", 0) for i in range(30)])
    assert provenance.trace_row(edges, "n0", 0, {"n30": source}).count() == 1
    circle = edge_table(spark, [("a", 0, "b", 0), ("b", 0, "a", 0)])
    with pytest.raises(ValueError, match="cycle"):
        provenance.trace_row(circle, "a", 0, {"c": source})


def test_trace_group_matches_missing_keys(spark, rows):
    data = spark.createDataFrame([("a", 0), ("a", 1), (None, 2), (None, 3)], "g string, _row_id long")
    out = spark.createDataFrame([("a", 2, 0), (None, 2, 1)], "g string, n int, _row_id long")
    edges = provenance.trace_group(data, out, ["g"], "sum", "src")
    assert rows(edges.select("output_row_id", "source_row_id")) == [(0, 0), (0, 1), (1, 2), (1, 3)]


def test_status_of_probed_nodes(spark, rows):
    out = spark.createDataFrame([(0,)], "_row_id long")
    status = provenance.probe_status({"a": out, "b": out}, provenance.trace_opaque(out, "b"), ["sink"], ["bad"])
    assert rows(status) == [("a", "ok", 1), ("b", "opaque", 1), ("bad", "failed", 0), ("sink", "skipped", 0)]


# --- graphs --------------------------------------------------------------------------


def graph_of(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_reachable(spark, rows):
    diamond = graph_of(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "y"))
    assert rows(graph.downstream(diamond, nodes(spark, "a"))) == [("b", 1), ("c", 1), ("d", 2)]
    assert rows(graph.upstream(diamond, nodes(spark, "d"))) == [("a", 2), ("b", 1), ("c", 1), ("d", 0)]
    assert rows(graph.reachable(diamond, nodes(spark, "a"), max_depth=1)) == [("a", 0), ("b", 1), ("c", 1)]
    assert rows(graph.downstream(diamond, nodes(spark, "nowhere"))) == []
    cycle = graph_of(spark, ("a", "b"), ("b", "a"))
    assert rows(graph.downstream(cycle, nodes(spark, "a"))) == [("a", 2), ("b", 1)]


def test_levels_and_cycles(spark, rows):
    dag = graph_of(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"))
    assert rows(graph.graph_levels(dag, nodes(spark, "a", "b", "c", "d", "lone"))) == [("a", 0), ("b", 1), ("c", 2), ("d", 3), ("lone", 0)]
    assert rows(graph.find_cycles(dag)) == []
    looped = graph_of(spark, ("r", "a"), ("a", "b"), ("b", "a"), ("b", "z"))
    assert rows(graph.find_cycles(looped)) == [("a",), ("b",), ("z",)]
    assert rows(graph.graph_levels(looped)) == [("r", 0)]


# --- deep graphs ---------------------------------------------------------------------


@pytest.fixture
def settled(monkeypatch):
    """Counts the rounds of a loop by the tables it writes under one label."""
    labels = []

    def counting(module):
        write = module.settle

        def settle(df, label="step"):
            labels.append(label)
            return write(df, label)

        monkeypatch.setattr(module, "settle", settle)

    for module in (doubling, graph, lineage, provenance):
        counting(module)
    return labels


def chain_of(spark, n):
    return spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))


def test_chain_of_5000_nodes_in_few_rounds(spark, settled):
    links = chain_of(spark, 5000)
    out = graph.reachable(links, spark.range(1))
    assert (out.count(), out.agg(F.sum("depth"), F.max("depth")).first()) == (5000, (4999 * 2500, 4999))
    assert settled.count("frontier") + settled.count("gained") <= 20
    bounded = graph.reachable(links, spark.range(1), max_depth=700)
    assert (bounded.count(), bounded.agg(F.max("depth")).first()[0]) == (701, 700)


def test_levels_of_a_deep_graph_in_few_rounds(spark, settled):
    """A chain with shortcuts, side roots, and a circle far down."""
    links = chain_of(spark, 600)
    skips = links.filter("src % 10 = 0").select("src", (F.col("src") + 2).alias("dst"))
    side = spark.createDataFrame([(9001, 500), (9002, 9001), (20, 9100), (590, 580), (9200, 9201)], "src long, dst long")
    edges = links.unionByName(skips.filter("dst < 600")).unionByName(side)
    found = {r.node: r.level for r in graph.graph_levels(edges).collect()}
    expected = {i: i for i in range(580)} | {9002: 0, 9001: 1, 9100: 21, 9200: 0, 9201: 1}
    assert found == expected
    assert settled.count("degrees") + settled.count("gained") + settled.count("shortcuts") <= 40
    assert sorted(r.node for r in graph.find_cycles(edges).collect()) == list(range(580, 600))


def test_closure_of_a_deep_chain_in_few_rounds(spark, settled):
    n = 2000
    step = F.when(F.col("id") == 900, "schema_diff").otherwise("tracked")
    table = spark.range(n).select(
        F.concat(F.lit("n"), "id").alias("node_id"), F.lit("x").alias("output_column"), F.concat(F.lit("n"), (F.col("id") + 1) % n).alias("source_node_id"),
        F.lit("x").alias("source_column"), step.alias("confidence"),
    )
    out = lineage.lineage_closure(table, spark.createDataFrame([("n0", "x")], "node_id string, column string"))
    assert {r.confidence: r["count"] for r in out.groupBy("confidence").count().collect()} == {"tracked": 900, "schema_diff": n - 901}
    assert settled.count("closure") + settled.count("gained") <= 20


def test_deep_traces_count_every_path(spark, settled):
    """Two rows per node, both of which come from both of the next: 2^40 paths."""
    depth = 40
    edges = edge_table(spark, [(f"n{i}", a, f"n{i + 1}", b) for i in range(depth) for a in (0, 1) for b in (0, 1)] + [(f"n{depth - 1}", 0, "__opaque__", -1)])
    source = spark.createDataFrame([(0, "v"), (1, "w")], "_row_id int, x string")
    out = provenance.trace_row(edges, "n0", 0, {f"n{depth}": source})
    assert sorted((r.node_id, r.row_id, r.paths, r.row_values, r.opaque) for r in out.collect()) == [
        ("n39", 0, 2**38, "{}", True), ("n40", 0, 2**39, '{"x":"v"}', False), ("n40", 1, 2**39, '{"x":"w"}', False),
    ]
    assert settled.count("walk") + settled.count("gained") <= 16
    circle = edge_table(spark, [(f"n{i}", 0, f"n{(i + 1) % 20}", 0) for i in range(20)])
    with pytest.raises(ValueError, match="cycle"):
        provenance.trace_row(circle, "n0", 0, {"c": source})


@pytest.mark.parametrize("affordable", [0, 10_000])
def test_wide_graphs_go_on_edge_by_edge(spark, rows, monkeypatch, affordable):
    """With no room for shortcuts the same comes out by single steps."""
    import random

    monkeypatch.setattr(doubling, "GROWTH", 0)
    monkeypatch.setattr(doubling, "AFFORDABLE", affordable)
    rng = random.Random(2)
    pairs = [(rng.randrange(i), i) for i in range(1, 60) for _ in range(2)] + [(i, i + 1) for i in range(25)] + [(58, 57), (57, 58)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    depth, level, todo = {0: 0}, {}, [0]
    for node in todo:
        for a, b in pairs:
            if a == node and b not in depth:
                depth[b] = depth[node] + 1
                todo.append(b)
    looped = {57, 58}
    while more := {b for a, b in pairs if a in looped} - looped:
        looped |= more
    for node in range(60):
        if node not in looped:
            level[node] = max((level[a] + 1 for a, b in pairs if b == node), default=0)
    assert rows(graph.reachable(edges, spark.range(1))) == sorted(depth.items(), key=repr)
    assert rows(graph.graph_levels(edges)) == sorted(level.items(), key=repr)
    assert rows(graph.find_cycles(edges)) == sorted((n,) for n in looped)


def test_edges_by_output_name_and_problems(spark, rows):
    made = spark.createDataFrame([("n1", "t1"), ("n2", "t2"), ("n3", "t2"), ("n4", None)], "node string, output string")
    reads = spark.createDataFrame([("n2", "t1"), ("n3", "gone")], "node string, input string")
    assert rows(graph.node_edges(made, reads)) == [("n1", "n2")]
    assert rows(graph.dangling_and_duplicate(made, reads)) == [("dangling", "gone", 1), ("duplicate", "t2", 2)]


def test_stale_nodes(spark, rows):
    hashes = "node string, hash string"
    stored = spark.createDataFrame([("a", "1"), ("b", None), ("c", "3")], hashes)
    current = spark.createDataFrame([("a", "2"), ("b", "2"), ("c", "3")], hashes)
    edges = graph_of(spark, ("a", "c"), ("b", "z"))
    assert rows(graph.stale_nodes(edges, stored, current)) == [("a", 0), ("c", 1)]


def test_normalise_path(spark):
    df = spark.createDataFrame([("/A/./b//C/../d.DTA",), ("../x",), ("/",), ("/..",), ("rel/y",)], "p string")
    got = [r.n for r in df.select(graph.normalise_path(F.col("p"), "/Base/dir").alias("n")).collect()]
    assert got == ["/a/b/d.dta", "/base/x", "/", "/", "/base/dir/rel/y"]


def test_sink_source_edges(spark, rows):
    columns = "pipeline string, path string, templated boolean"
    sinks = spark.createDataFrame([("a", "/w/s.dta", False), ("b", "/w/t.dta", True), ("c", "/w/own.dta", False), ("d", "/w/none", False)], columns)
    sources = spark.createDataFrame([("x", "/W/./s.dta", False), ("y", "/w/s.dta", False), ("z", "/w/t.dta", False), ("c", "/w/own.dta", False)], columns)
    named = spark.createDataFrame([("a",), ("z",), ("c",)], "pipeline string")
    edges = [("a", "x", "/w/s.dta", True), ("a", "y", "/w/s.dta", True), ("b", "z", "/w/t.dta", False)]
    assert rows(graph.sink_source_edges(sinks, sources, named)) == edges
    assert rows(graph.sink_source_edges(sinks, sources, named.filter("pipeline = 'y'"))) == []
    assert rows(graph.sink_source_edges(sinks, sources, spark.createDataFrame([("y",)], "pipeline string"))) == edges[1:2]
    uses = rows(graph.shared_paths(sinks, sources).select("shared_path", "role", "pipeline"))
    assert [u for u in uses if u[0] == "/w/s.dta"] == [("/w/s.dta", "reader", "x"), ("/w/s.dta", "reader", "y"), ("/w/s.dta", "writer", "a")]
    assert not any(u[0] == "/w/none" for u in uses)


# --- run logs ------------------------------------------------------------------------


def at(minute):
    return datetime.datetime(2024, 1, 1, 0, minute)


def test_fold_status(spark):
    events = spark.createDataFrame(
        [("n", 1, "running", None, "h1"), ("n", 2, "failed", "boom", None), ("n", 3, "completed", None, None), ("m", 1, "running", None, None)],
        "node string, t int, status string, error string, hash string",
    )
    got = {r.node: (r.status, r.error, r.hash) for r in runlog.fold_status(events, "node", ["t"], fields=["error", "hash"]).collect()}
    assert got == {"n": ("completed", "boom", "h1"), "m": ("running", None, None)}
    cleared = runlog.fold_status(events, "node", ["t"], fields=["error"], clear_on_success="error")
    assert {r.node: r.error for r in cleared.collect()} == {"n": None, "m": None}
    states = runlog.fold_status(events, "node", ["t"])
    assert [r.node for r in runlog.completed_nodes(states, "node").collect()] == ["n"]


def test_latest_and_conflicts(spark, rows):
    sessions = spark.createDataFrame(
        [("p", 1, "finalized", at(1)), ("p", 2, "running", at(2)), ("q", 3, "abandoned", at(1)), ("p", 4, "active", at(0))],
        "pipeline string, id int, status string, created_at timestamp_ntz",
    )
    keys = spark.createDataFrame([("p",), ("q",), ("r",)], "pipeline string")
    got = {r.pipeline: r.last_run_status for r in runlog.latest_per_key(keys, sessions, "pipeline", ["created_at"]).collect()}
    assert got == {"p": "running", "q": "never", "r": "never"}
    assert rows(runlog.active_conflicts(sessions, "pipeline")) == [("p", 2)]
    listed = runlog.list_runs(sessions, pipeline="P", limit=2, pipeline_col="pipeline")
    assert [r.id for r in listed.collect()] == [2, 1]


def test_durations_registration_and_meta(spark, rows):
    nodes_ = spark.createDataFrame([("a", at(1), at(3)), ("b", at(2), None)], "n string, started_at timestamp_ntz, finished_at timestamp_ntz")
    assert {r.n: r.duration_s for r in runlog.run_durations(nodes_).collect()} == {"a": 120.0, "b": None}
    runs = spark.createDataFrame([("r", 1, "x"), ("r", 2, None), ("s", 1, "y")], "run_id string, t int, v string")
    assert rows(runlog.register_run(runs, "run_id", ["t"])) == [("r", 2, None), ("s", 1, "y")]
    assert rows(runlog.meta_upsert(runs.filter("v is not null"), "run_id", "v", ["t"])) == [("r", "x"), ("s", "y")]


def test_file_manifest(spark, tmp_path, rows):
    import hashlib

    for name, text in (("a.py", "one"), ("sub/b.py", "two"), ("runs/c.py", "three"), ("sub/d.txt", "four")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    old = runlog.file_manifest(spark, str(tmp_path), "*.py")
    assert rows(old) == [(n, len(t), hashlib.sha256(t.encode()).hexdigest()) for n, t in (("a.py", "one"), ("sub/b.py", "two"))]
    new = old.filter("file <> 'a.py'").withColumn("sha256", F.lit("x"))
    assert rows(runlog.manifest_changes(old, new)) == [("a.py", "removed"), ("sub/b.py", "changed")]
