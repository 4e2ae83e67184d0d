"""The engine's own operators on small inputs with known answers."""

import math
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidewater.functions import geo, net, scalars, sketches, vector
from tidewater.operators.etl import PipelineError, dispatch, run_processors, table_suffix, transform
from tidewater.operators.logquery import LogQueryError, canonical_time, log_query
from tidewater.operators.promql import PromQL, PromQLError, parse
from tidewater.operators.promql.evaluator import Grid
from tidewater.operators.range_select import Item, RangeError, range_select
from tidewater.plans.engine import Engine
from tidewater.plans.tables import TimeSeriesTable
from tidewater.sources import files, lines
from tidewater.streaming.flow import Flow, FlowManager, tumble_start

T0 = datetime(1970, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def metrics(spark):
    rows = [("a", at(0), 1.0), ("a", at(10), 2.0), ("a", at(20), 4.0), ("b", at(0), 10.0), ("b", at(10), 5.0), ("b", at(20), 7.0)]
    buckets = [(le, at(0), v) for le, v in (("0.1", 10.0), ("1", 60.0), ("+Inf", 100.0))]
    return PromQL(spark, {
        "m": TimeSeriesTable(spark.createDataFrame(rows, "host string, ts timestamp, v double"), "ts", ["host"], ["v"]),
        "h": TimeSeriesTable(spark.createDataFrame(buckets, "le string, ts timestamp, v double"), "ts", ["le"], ["v"]),
    })


def values(df, *labels):
    return {(*[r[c] for c in labels], int(r.ts.replace(tzinfo=timezone.utc).timestamp())): r.value for r in df.collect()}


def test_instant_lookback_is_left_open(metrics):
    assert values(metrics.query_range("m", 10, 10 + 320, 310, 310_000), "host") == {("a", 10): 2.0, ("b", 10): 5.0, ("a", 320): 4.0, ("b", 320): 7.0}
    assert values(metrics.query_range("m", 330, 330, 1, 310_000), "host") == {}


def test_rate_increase_delta(metrics):
    got = values(metrics.query("increase(m[20s])", 20), "host")
    assert got[("a", 20)] == pytest.approx(4.0)
    assert values(metrics.query("delta(m[21s])", 20), "host")[("b", 20)] == pytest.approx(-3.0 * 21 / 20)
    assert values(metrics.query("irate(m[1m])", 20), "host")[("b", 20)] == pytest.approx(0.2)
    assert values(metrics.query("resets(m[1m]) + changes(m[1m])", 20), "host") == {("a", 20): 2.0, ("b", 20): 3.0}


def test_subquery_grid(metrics):
    assert values(metrics.query('sum_over_time(m{host="a"}[50s:10s])', 300), "host") == {("a", 300): 20.0}


def test_histogram_quantile(metrics):
    assert values(metrics.query("histogram_quantile(0.5, h)", 0)) == {(0,): pytest.approx(0.1 + 0.9 * 40 / 50)}
    assert values(metrics.query("histogram_quantile(0.99, h)", 0)) == {(0,): 1.0}
    assert values(metrics.query("histogram_quantile(2, h)", 0)) == {(0,): math.inf}


def test_operators(metrics):
    assert values(metrics.query("m / 0", 0), "host") == {("a", 0): math.inf, ("b", 0): math.inf}
    assert values(metrics.query("m > 3 or missing", 0), "host") == {("b", 0): 10.0}
    assert values(metrics.query("2 ^ 3 ^ 2 - 1", 0)) == {(0,): 511.0}
    assert values(metrics.query("-m + on (host) m", 0), "host") == {("a", 0): 0.0, ("b", 0): 0.0}
    assert values(metrics.query("sum(m @ 20)", 0)) == {(0,): 11.0}
    assert values(metrics.query("absent(nothing{x=\"y\"})", 0), "x") == {("y", 0): 1.0}
    assert values(metrics.query("double_exponential_smoothing(m[1m], 0.5, 0.5)", 20), "host")[("a", 20)] == pytest.approx(3.5)
    assert values(metrics.query("timestamp(m)", 25), "host") == {("a", 25): 20.0, ("b", 25): 20.0}
    assert values(metrics.query("stdvar(m) + group(m)", 0)) == {(0,): 21.25}
    assert [r.host for r in metrics.query("sort_desc(m)", 0).collect()] == ["b", "a"]


@pytest.mark.parametrize("bad", ["m[", "sum m", "{x='1'}", "1 > 2", "m[5m]", "rate(m)", "nofunc(m)", 'm{__name__!="x"}', "topk(m)"])
def test_promql_errors(metrics, bad):
    with pytest.raises(PromQLError):
        metrics.query(bad, 0)


def test_parse_precedence():
    tree = parse("a + b * c or d unless e")
    assert tree.op == "or" and tree.left.op == "+" and tree.left.right.op == "*" and tree.right.op == "unless"


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([("x", at(0), 1.0), ("x", at(1), 2.0), ("x", at(12), 6.0), ("y", at(3), None)], "host string, ts timestamp, v double")


def slots(df, name="v"):
    return sorted((r.host, int(r.ts.replace(tzinfo=timezone.utc).timestamp()), r[name]) for r in df.collect())


def test_range_slots(points):
    assert slots(range_select(points, "ts", [Item("sum", "v", "5s", "v")], "5s", ["host"])) == [("x", 0, 3.0), ("x", 10, 6.0), ("y", 0, None)]
    assert slots(range_select(points.where("host = 'x'"), "ts", [Item("count", "v", "10s", "v")], "5s", ["host"])) == [("x", -5, 2), ("x", 0, 2), ("x", 5, 1), ("x", 10, 1)]
    gap = range_select(points.where("host = 'x'"), "ts", [Item("count", "v", "1s", "v")], "5s", ["host"])
    assert slots(gap) == [("x", 0, 1)]


@pytest.mark.parametrize("fill, middle", [("NULL", None), ("PREV", 3.0), ("LINEAR", 4.5), (9, 9.0)])
def test_range_fill(points, fill, middle):
    got = slots(range_select(points.where("host = 'x'"), "ts", [Item("sum", "v", "5s", "v", fill)], "5s", ["host"]))
    assert got == [("x", 0, 3.0), ("x", 5, middle), ("x", 10, 6.0)]


def test_range_errors(points):
    for item, align in ((Item("sum", "v", "0s", "v"), "5s"), (Item("sum", "v", "5x", "v"), "5s"), (Item("nope", "v", "5s", "v"), "5s")):
        with pytest.raises(RangeError):
            range_select(points, "ts", [item], align, ["host"])


def test_merge_modes(spark):
    df = spark.createDataFrame([("a", at(0), 1, None, 1, False), ("a", at(0), None, 2, 2, False), ("b", at(0), 5, 5, 1, False), ("b", at(0), None, None, 2, True)], "k string, ts timestamp, x int, y int, seq int, gone boolean")
    read = lambda mode: sorted((r.k, r.x, r.y) for r in TimeSeriesTable(df, "ts", ["k"], ["x", "y"], mode, "seq", "gone").read().collect())
    assert read("last_row") == [("a", None, 2)] and read("last_non_null") == [("a", 1, 2)]
    kept = TimeSeriesTable(df, "ts", ["k"], ["x", "y"], "append", ttl_seconds=60).read(now=datetime(1970, 1, 1, 1))
    assert kept.count() == 0


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_functions(spark):
    L = F.lit
    v, w = F.array(L(3.0), L(4.0)).cast("array<float>"), F.array(L(0.0), L(0.0)).cast("array<float>")
    assert one(spark, vector.vec_norm(v), vector.vec_cos_distance(v, w), vector.vec_subvector(v, L(1), L(2)), vector.vec_to_string(v), vector.vec_elem_product(v)) == ([pytest.approx(0.6), pytest.approx(0.8)], 1.0, [4.0], "[3,4]", 12.0)
    assert one(spark, net.ipv4_to_cidr(L("192.168.1.0")), net.ipv4_to_cidr(L("10.1.2.3"), L(8)), net.ipv4_string_to_num(L("1.2.3.400")), net.ipv6_in_range(L("2001:db8::1"), L("2001:db8::/32"))) == ("192.168.1.0/24", "10.0.0.0/8", None, True)
    assert one(spark, geo.geohash(L(57.64911), L(10.40744), 11), F.round(geo.distance_sphere_m(L(0.0), L(0.0), L(0.0), L(180.0)) / 1000)) == ("u4pruydqqvj", 20015.0)
    square, dot = L("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))"), L("POINT(1 1)")
    assert one(spark, geo.st_contains(square, dot), geo.st_area(square), geo.st_intersects(square, L("POLYGON((3 3, 9 3, 9 9, 3 9, 3 3))"))) == (True, 16.0, True)
    assert one(spark, scalars.insert(L("Quadratic"), L(3), L(4), L("What")), scalars.format_number(L(2.5), 0), scalars.if_(L(0), L("a"), L("b")), scalars.gcd(L(84), L(-36)), scalars.elt(L(0), L("a"))) == ("QuWhattic", "3", "b", 12, None)
    assert one(spark, scalars.json_is(L('{"a":1}'), "object"), scalars.json_get(L('{"a":{"b":2}}'), "a.b", "int"), scalars.json_get(L('{"a":"x"}'), "a", "int")) == (True, 2, None)
    assert one(spark, scalars.matches_term(L("cat, dog"), "cat"), scalars.matches_term(L("concat"), "cat"), scalars.matches(L("The quick fox"), '"quick fox" -lazy'), scalars.matches(L("a b"), "c OR b AND a")) == (True, False, True, True)


def test_sketches(spark):
    df = spark.range(1, 2001).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("x"))
    whole = sketches.uddsketch_merge(sketches.uddsketch_state(df, ["g"], "x", 128, 0.01), [], "state", 128, 0.01)
    got = whole.select(sketches.uddsketch_calc(0.5, F.col("state"))).first()[0]
    assert abs(got - 1000) / 1000 < 0.08
    assert df.agg(sketches.hll_count(sketches.hll(F.col("x").cast("string")))).first()[0] == pytest.approx(2000, rel=0.03)


def test_log_query(spark):
    assert canonical_time({"start": "2024-02"}) == (datetime(2024, 2, 1), datetime(2024, 3, 1))
    assert canonical_time({"end": "2024-01-02", "span": "60"}) == (datetime(2024, 1, 1, 23, 59), datetime(2024, 1, 2))
    for bad in ({}, {"start": "2024-01-01", "span": "5m"}, {"end": "2024"}):
        with pytest.raises(LogQueryError):
            canonical_time(bad)
    df = spark.createDataFrame([(at(i), "err" if i == 5 else "ok", '{"n": 3}') for i in range(10)], "ts timestamp, m string, j string")
    near = log_query(df, {"filters": {"Single": {"column": "m", "filters": [{"Prefix": "e"}]}}, "context": {"Lines": [1, 2]}})
    assert sorted(r.ts.second for r in near.collect()) == [4, 5, 6, 7]
    assert log_query(df, {"exprs": [{"Decompose": {"expr": "j", "schema": [["n", "int"]]}}, {"Filter": {"BinaryOp": {"left": "n", "op": ">", "right": 2}}}], "limit": {"skip": 4, "fetch": 3}}).count() == 3


def test_etl(spark):
    df = spark.createDataFrame([('127.0.0.1 - "GET /a" 200', "a,b", "1.5", "br=3200,bs,ot=v", "\x1b[31mred\x1b[0m 2024-05-06")], "line string, pair string, num string, cmcd string, ansi string")
    out = run_processors(df, [
        {"dissect": {"field": "line", "pattern": '%{ip} %{?skip} "%{verb} %{path}" %{code}'}}, {"csv": {"field": "pair", "target_fields": ["p", "q"]}}, {"cmcd": {"fields": ["cmcd"]}}, {"decolorize": {"field": "ansi"}},
        {"regex": {"fields": ["ansi"], "pattern": r"(?<the_year>\d+)-(?<month>\d+)"}}, {"date": {"fields": ["ansi, day"], "formats": ["red %Y-%m-%d"]}}, {"gsub": {"field": "path", "pattern": "/", "replacement": "_"}},
        {"digest": {"fields": ["line"], "presets": ["ip", "quoted", "numbers"]}}, {"urlencoding": {"fields": ["pair, enc"], "method": "encode"}}, {"letter": {"fields": ["verb"], "method": "lower"}},
    ]).first()
    assert (out.ip, out.verb, out.path, out.code, out.p, out.q, out.cmcd_br, out.cmcd_bs, out.cmcd_ot, out.ansi_the_year, out.ansi_month) == ("127.0.0.1", "get", "_a", "200", "a", "b", 3200, True, "v", "2024", "05")
    assert out.day.day == 6 and out.enc == "a%2Cb" and "127" not in out.line_digest
    with pytest.raises(PipelineError):
        run_processors(df, [{"letter": {"field": "none"}}])
    cast = transform(df, [{"fields": ["num, n"], "type": "float64", "index": "tag"}])
    assert cast.first().n == 1.5 and cast.schema["n"].metadata == {"index": "tag"}
    assert dispatch(df, "num", {"1.5": "x"})["x"].count() == 1 and table_suffix(df, "_${num}").first()._table == "_1.5"


def test_sources(spark, tmp_path):
    text = spark.createDataFrame([("cpu,host=a\\ b,dc=x usage=1.5,note=\"q w\",n=3i 1700000000000000000",), ("# no",), ("",)], "value string")
    row = lines.influx_lines(text).first()
    assert (row.measurement, row.tags["host"], row.fields["usage"], row.fields["note"], row.fields["n"]) == ("cpu", "a b", "1.5", "q w", "3")
    put = lines.opentsdb_points(spark.createDataFrame([('{"metric":"m","timestamp":1700000000,"value":2,"tags":{"h":"x"}}',)], "value string")).first()
    assert put.metric == "m" and put.tags == {"h": "x"}
    df = spark.range(5).select(F.col("id"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("s"))
    for kind in ("parquet", "csv", "json", "orc"):
        files.write(df, f"{tmp_path}/{kind}", kind)
        back = files.conform(files.read(spark, f"{tmp_path}/{kind}", kind), df.schema)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_engine_statements(spark, points, tmp_path):
    e = Engine(spark)
    e.register("p", TimeSeriesTable(points, "ts", ["host"], ["v"]))
    got = e.sql("SELECT ts, host, sum(v) RANGE '5s' FILL 0 AS s FROM p WHERE host = 'x' ALIGN '5s' ORDER BY ts")
    assert [r.s for r in got.collect()] == [3.0, 0.0, 6.0]
    assert [r.c for r in e.sql("SELECT ts, count(v) RANGE '20s' AS c FROM p ALIGN '20s' BY ()").collect()] == [3]
    assert sorted(r.total for r in e.sql("TQL EVAL (0, 10, '10s') sum(p) AS total").collect()) == [1.0, 2.0]
    assert e.sql("WITH q (t, x) AS (TQL EVAL (0, 0, '1s') sum(p)) SELECT x FROM q").first().x == 1.0
    assert {r["Semantic Type"] for r in e.sql("DESCRIBE TABLE p").collect()} == {"TAG", "TIMESTAMP", "FIELD"}
    e.sql(f"COPY (SELECT * FROM p) TO '{tmp_path}/c' WITH (FORMAT = 'json')")
    e.sql(f"COPY p FROM '{tmp_path}/c' WITH (FORMAT = 'json')")
    assert e.sql("SELECT count(*) AS n FROM p").first().n == 8
    assert e.sql("SELECT count(*) AS n FROM p WHERE host @@ 'x'").first().n == 6
    for bad in ("SELECT ts, avg(v) RANGE '5s' FROM p", "SELECT ts, avg(v) RANGE '5s' AS a FROM (SELECT * FROM p) q ALIGN '5s'"):
        with pytest.raises(RangeError):
            e.sql(bad)


def test_flow_batching(spark, tmp_path):
    rows = spark.createDataFrame([(1, at(0), 1.0), (2, at(70), 2.0)], "seq int, ts timestamp, v double")
    plan = lambda df: df.groupBy(tumble_start("ts", "1 minute").alias("window_start")).agg(F.sum("v").alias("s"))
    flows = FlowManager(spark, str(tmp_path))
    flows.create(Flow("f", "sink", plan, "ts", 60, sequence="seq"))
    assert sorted(r.s for r in flows.flush("f", rows).collect()) == [1.0, 2.0]
    more = rows.union(spark.createDataFrame([(3, at(75), 5.0), (4, at(90_000), 1.0)], rows.schema))
    assert sorted(r.s for r in flows.flush("f", more).collect()) == [1.0, 1.0, 7.0]
    assert flows.show().count() == 1
    flows.drop("f")


def test_flow_streaming(spark, tmp_path):
    rows = spark.createDataFrame([(at(i), 1.0) for i in range(0, 300, 10)], "ts timestamp, v double")
    rows.write.parquet(f"{tmp_path}/in")
    flows = FlowManager(spark, f"{tmp_path}/out")
    flows.create(Flow("s", "sink", lambda df: df, "ts", 60))
    q = flows.stream("s", spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), lambda df: df.groupBy(F.window("ts", "1 minute")).agg(F.count("*").alias("n")), f"{tmp_path}/cp", mode="complete", table="flow_out")
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("flow_out").collect()) == [6] * 5


def test_registry(spark, sf_dir):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() >= 0
    for name in ("pricing_summary", "promql_sum_by", "range_fill_prev", "lateral_join"):
        assert entry.queries()[name](spark, sf_dir).count() > 0


def test_promql_whole_table(spark, tmp_path):
    from tidewater.plans import registry, timeseries

    t0 = 1704067200 + 1800  # three days from half past midnight; one row an hour and user
    rows = [(i * 3 + u, at(t0 + i * 3600), u, "click", float(i * u)) for i in range(72) for u in range(3)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert timeseries.whole_span(spark, str(tmp_path)) == (1704067200, 1704067200 + 72 * 3600)
    hour = {i: 1704067200 + (i + 1) * 3600 for i in range(72)}
    assert values(timeseries.QUERIES["promql_sum_by"](spark, str(tmp_path))) == {(hour[i],): 3.0 * i for i in range(72)}
    assert values(timeseries.QUERIES["promql_offset"](spark, str(tmp_path))) == {(hour[i] + 3600,): 3.0 * i for i in range(72)}
    rate = values(registry.flagship(spark, str(tmp_path)), "user_id")
    assert all(rate[(str(u), hour[i])] == pytest.approx(u / 3600, abs=2e-6) for u in range(3) for i in range(6, 72))
    spark.createDataFrame([], "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/none/events.parquet")
    assert timeseries.QUERIES["promql_absent"](spark, f"{tmp_path}/none").count() == 0


def test_statements(spark, tmp_path):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string"))
    e.sql("INSERT INTO t (s, k) VALUES ('c', 3)")
    e.sql("DELETE FROM t WHERE k = 1")
    e.sql("CREATE VIEW v AS SELECT k * 10 AS x FROM t")
    assert sorted(r.x for r in e.sql("SELECT x FROM v").collect()) == [20, 30]
    e.sql("PREPARE q AS SELECT s FROM t WHERE k = $1")
    assert [r.s for r in e.sql("EXECUTE q (3)").collect()] == ["c"]
    e.sql("DEALLOCATE q")
    e.sql(f"COPY t TO '{tmp_path}/t' WITH (FORMAT = 'parquet')")
    e.sql(f"CREATE EXTERNAL TABLE x WITH (location = '{tmp_path}/t', format = 'parquet')")
    e.sql("TRUNCATE TABLE t")
    assert e.sql("SELECT count(*) AS n FROM x").first().n == 2 and e.sql("SELECT count(*) AS n FROM t").first().n == 0
    e.sql("DROP VIEW v")
    assert [r.Tables for r in e.sql("SHOW TABLES").collect()] == ["t", "x"]


def test_traces(spark):
    from tidewater.plans import traces

    rows = [("web", f"op{i % 2}", "client", f"t{i // 5}", f"s{i}", at(i), i * 10, {"k": str(i)}) for i in range(20)]
    spans = spark.createDataFrame(rows, "service_name string, span_name string, span_kind string, trace_id string, span_id string, ts timestamp, duration_ns long, attributes map<string,string>")
    assert traces.services(spans).count() == 1 and traces.operations(spans, "web").count() == 2 and traces.get_trace(spans, "t1").count() == 5
    got = traces.find_traces(spans, "web", "op0", min_ns=100, limit=1).collect()
    assert sorted(r.span_id for r in got) == ["s15", "s16", "s17"]


def test_matching_needs_one_series_a_group(spark):
    left = TimeSeriesTable(spark.createDataFrame([("a", "x", at(0), 1.0), ("a", "y", at(0), 2.0)], "host string, dc string, ts timestamp, v double"), "ts", ["host", "dc"], ["v"])
    right = TimeSeriesTable(spark.createDataFrame([("a", at(0), 4.0)], "host string, ts timestamp, v double"), "ts", ["host"], ["v"])
    engine = PromQL(spark, {"l": left, "r": right})
    assert values(engine.query("l * on(host) group_left r", 0), "host", "dc") == {("a", "x", 0): 4.0, ("a", "y", 0): 8.0}
    for query in ("l * on(host) r", "r * on(host) l", "r * on(host) group_left l"):
        with pytest.raises(Exception, match="match"):
            engine.query(query, 0).collect()


@pytest.mark.parametrize("name", ["sum_over_time", "count_over_time", "avg_over_time", "min_over_time", "max_over_time", "first_over_time", "last_over_time", "present_over_time"])
def test_windows_from_panes_equal_brute_force(spark, name):
    samples = [(0, 3.0), (1, -2.0), (5, 7.5), (6, 1.0), (10, 4.0), (11, 4.0), (25, 0.5), (30, 9.0)]
    table = TimeSeriesTable(spark.createDataFrame([("a", at(t), v) for t, v in samples], "host string, ts timestamp, v double"), "ts", ["host"], ["v"])
    made = {
        "sum_over_time": sum, "count_over_time": lambda x: float(len(x)), "avg_over_time": lambda x: sum(x) / len(x), "min_over_time": min, "max_over_time": max,
        "first_over_time": lambda x: x[0], "last_over_time": lambda x: x[-1], "present_over_time": lambda x: 1.0,
    }[name]
    want = {("a", t): pytest.approx(made(held)) for t in range(1, 50, 6) if (held := [v for s, v in samples if t - 15 < s <= t])}
    assert values(PromQL(spark, {"m": table}).query_range(f"{name}(m[15s])", 1, 49, 6), "host") == want


def test_range_slots_from_panes_equal_brute_force(spark):
    samples = [(0, 3), (1, -2), (5, None), (6, 1), (10, 4), (25, 7)]
    df = spark.createDataFrame([("x", at(t), v) for t, v in samples], "host string, ts timestamp, v int")
    items = [Item("sum", "v", "15s", "s"), Item("count", "v", "9s", "n"), Item("avg", "v", "6s", "a"), Item("min", "v", "15s", "lo"), Item("max", "v", "15s", "hi")]
    got = {int(r.ts.replace(tzinfo=timezone.utc).timestamp()): (r.s, r.n, r.a, r.lo, r.hi) for r in range_select(df, "ts", items, "6s", ["host"]).collect()}
    inside = lambda t, span: [v for s, v in samples if t <= s < t + span]
    want = {}
    for t in range(-30, 40, 6):
        if inside(t, 15):
            long, n, a = ([v for v in inside(t, k) if v is not None] for k in (15, 9, 6))
            want[t] = (sum(long) if long else None, len(n), sum(a) / len(a) if a else None, min(long, default=None), max(long, default=None))
    assert got == want


def test_shapes_with_dents_holes_and_touching_edges(spark):
    L = F.lit
    cup = L("POLYGON((0 0, 9 0, 9 9, 6 9, 6 3, 3 3, 3 9, 0 9, 0 0))")
    over = L("POLYGON((1 8, 8 8, 8 8.5, 1 8.5, 1 8))")  # its corners lie in the arms, its middle in the dent
    ring = L("POLYGON((0 0, 9 0, 9 9, 0 9, 0 0), (3 3, 6 3, 6 6, 3 6, 3 3))")
    inner, whole = L("POLYGON((1 1, 8 1, 8 8, 1 8, 1 1))"), L("POLYGON((0 0, 9 0, 9 9, 0 9, 0 0))")
    beside = L("POLYGON((9 2, 12 2, 12 4, 9 4, 9 2))")
    hole = L("POLYGON((3 3, 6 3, 6 6, 3 6, 3 3))")
    assert one(spark, geo.st_contains(cup, over), geo.st_intersects(cup, over), geo.st_contains(ring, inner), geo.st_contains(whole, inner)) == (False, True, False, True)
    assert one(spark, geo.st_intersects(whole, beside), geo.st_contains(whole, beside), geo.st_contains(whole, whole), geo.st_contains(ring, hole)) == (True, False, True, False)
    assert one(spark, geo.st_contains(whole, L("POINT(0 3)")), geo.st_intersects(whole, L("POINT(0 3)")), geo.st_contains(whole, L("POINT(1 3)")), geo.st_within(L("LINESTRING(0 0, 9 9)"), whole)) == (False, True, True, True)
    assert one(spark, geo.st_contains(cup, L("LINESTRING(1 8, 8 8)")), geo.st_contains(whole, L("LINESTRING(0 0, 9 0)")), geo.st_contains(ring, whole), geo.st_area(ring)) == (False, False, False, 72.0)


def test_bulk_lines_with_deletes_and_schema_from_the_first_lines(spark, tmp_path):
    body = ['{"create":{"_index":"a"}}', '{"m":1}', '{"delete":{"_index":"a","_id":"1"}}', '{"index":{"_index":"b"}}', '{"delete":1,"m":2}']
    df = spark.createDataFrame(list(enumerate(body)), "n long, value string")
    assert [tuple(r) for r in lines.elasticsearch_bulk(df).orderBy("index").collect()] == [("a", '{"m":1}'), ("b", '{"delete":1,"m":2}')]
    (tmp_path / "x.json").write_text('{"a":1}\n{"a":2}\n{"a":3,"b":"late"}\n')
    assert files.read(spark, str(tmp_path / "x.json"), "json", {"schema_infer_max_record": "2"}).columns == ["a"]
    assert files.read(spark, str(tmp_path / "x.json"), "json").columns == ["a", "b"]


def test_digest_presets_keep_their_order_and_names(spark):
    df = spark.createDataFrame([("GET (1) 「x」 'q' 10.0.0.1:80 DEADBEEF-0000-0000-0000-00000000000F 7",)], "line string")
    spec = lambda *p: [{"digest": {"fields": ["line"], "presets": list(p)}}]
    assert run_processors(df, spec("bracketed", "quoted", "ip", "uuid", "numbers")).first().line_digest.split() == ["GET"]
    with pytest.raises(PipelineError):
        run_processors(df, spec("bracket"))


def test_flow_marks_outlive_the_manager(spark, tmp_path):
    rows = spark.createDataFrame([(at(0), 1.0, 1), (at(70), 2.0, 2)], "ts timestamp, v double, seq long")
    plan = lambda df: df.groupBy(tumble_start("ts", "1 minute").alias("w")).agg(F.sum("v").alias("s"))
    flow = Flow("f", "out", plan, "ts", 60, "w", sequence="seq")
    first = FlowManager(spark, str(tmp_path))
    first.create(flow)
    assert first.flush("f", rows).count() == 2
    second = FlowManager(spark, str(tmp_path))
    second.create(flow)
    assert second._held("f") == 2
    assert second.flush("f", rows).count() == 2 and second.marks["f"] == 2
    second.drop("f")
    assert second._held("f") is None


def test_change_over_windows_is_its_sql_to_the_last_digit(spark, tmp_path):
    """Ties of the rounding, and samples of one millisecond in different microseconds."""
    import random

    import duckdb

    from tidewater.plans.timeseries import ORACLE_SQL, QUERIES, rounded

    ties = [k / 1000 for k in range(-3005, 3006, 10)] + [k / 40 for k in range(200)]
    got = [r.v for r in spark.createDataFrame([(v,) for v in ties], "v double").select(rounded(F.col("v"), 2).alias("v")).collect()]
    assert got == [r[0] for r in duckdb.execute("SELECT round(v, 2) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [ties]).fetchall()]
    assert math.isnan(spark.range(1).select(rounded(F.lit(math.nan), 2)).first()[0])
    pick, rows = random.Random(5), []
    for n in range(6000):
        us = pick.randrange(48 * 3600) * 1_000_000 + pick.randrange(3) * 300
        rows.append((n, T0 + timedelta(days=19000, microseconds=us), pick.randrange(40), ("click", "view")[n % 2], pick.randrange(40) / 4))
        if n % 3 == 0:
            rows.append((-n, rows[-1][1] + timedelta(microseconds=pick.choice([7, 90])), *rows[-1][2:4], pick.randrange(40) / 4))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    base = duckdb.connect()
    base.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("promql_delta", "promql_increase", "promql_rate", "promql_changes", "promql_idelta", "promql_irate", "promql_instant_selector", "promql_last_over_time"):
        want = base.execute(f"SELECT event_type, user_id, epoch_us(ts), value FROM ({ORACLE_SQL[name]})").fetchall()
        made = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select("event_type", "user_id", F.unix_micros("ts"), "value").collect()]
        assert sorted(made) == sorted(want), name


def test_windows_of_one_sample_are_not_aggregated(spark):
    import statistics

    samples = [(0, 3.0), (1, -2.0), (2, 7.5), (40, 1.0), (80, 4.0), (81, 2.0), (95, 0.5), (102, 9.0), (300, 6.0)]
    table = TimeSeriesTable(spark.createDataFrame([("a", at(t), v) for t, v in samples] + [("b", at(7), 1.5)], "host string, ts timestamp, v double"), "ts", ["host"], ["v"])
    engine, made = PromQL(spark, {"m": table}), {
        "changes(m[15s])": lambda x: float(sum(a != b for a, b in zip(x, x[1:]))), "resets(m[15s])": lambda x: float(sum(b < a for a, b in zip(x, x[1:]))),
        "stdvar_over_time(m[15s])": statistics.pvariance, "mad_over_time(m[15s])": lambda x: statistics.median(abs(v - statistics.median(x)) for v in x),
        "quantile_over_time(0.5, m[15s])": statistics.median, "quantile_over_time(2, m[15s])": lambda x: math.inf, "idelta(m[15s])": lambda x: x[-1] - x[-2] if len(x) > 1 else None,
    }
    for query, value in made.items():
        want = {(h, t): pytest.approx(y) for h, rows in (("a", samples), ("b", [(7, 1.5)])) for t in range(0, 400, 6) if (x := [v for s, v in rows if t - 15 < s <= t]) and (y := value(x)) is not None}
        assert values(engine.query_range(query, 0, 399, 6), "host") == want, query
    many, one, _ = engine.windows(parse("changes(m[15s])").args[0], Grid(0, 399_000, 6000, 300_000))
    held = [(t, [s for s, _ in samples if t - 15 < s <= t]) for t in range(0, 400, 6)]
    assert many.df.count() == sum(len(x) for _, x in held if len(x) > 1)
    assert one.df.count() == sum(len(x) == 1 for _, x in held) + 2  # and two of b


def test_gaps_are_filled_from_the_slots_before_them(spark):
    held = {"x": {0: 3.0, 1: None, 4: 6.0, 2500: 1.0, 2503: None}, "y": {7: None, 9: 2.0}, None: {2: 5.0, 4: 9.0}}
    df = spark.createDataFrame([(h, at(t), v) for h, rows in held.items() for t, v in rows.items()], "host string, ts timestamp, v double")
    items = [Item("max", "v", "1s", "n", "NULL"), Item("max", "v", "1s", "p", "PREV"), Item("max", "v", "1s", "l", "LINEAR"), Item("max", "v", "1s", "c", 8), Item("count", "v", "1s", "z")]
    made = range_select(df, "ts", items, "1s", ["host"])
    want = []
    for h, rows in held.items():
        points = sorted((t, v) for t, v in rows.items() if v is not None)
        for t in range(min(rows), max(rows) + 1):
            lo, hi = max((p for p in points if p[0] <= t), default=None), min((p for p in points if p[0] >= t), default=None)
            v = rows.get(t)
            line = v if v is not None else lo[1] + (hi[1] - lo[1]) * (t - lo[0]) / (hi[0] - lo[0]) if lo and hi else None
            want.append((h, t, v, lo and lo[1], None if line is None else pytest.approx(line), 8.0 if v is None else v, None if t not in rows else int(v is not None)))
    got = {(r.host, int(r.ts.replace(tzinfo=timezone.utc).timestamp())): (r.n, r.p, r.l, r.c, r.z) for r in made.collect()}
    assert got == {w[:2]: w[2:] for w in want} and len(want) == made.count()
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
