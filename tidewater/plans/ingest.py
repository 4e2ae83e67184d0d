"""Queries over log pipelines, traces, files and flows, with their DuckDB forms; all over the whole event table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.etl import dispatch, run_processors, table_suffix, transform
from tidewater.operators.promql import PromQL
from tidewater.plans import traces
from tidewater.plans.engine import Engine
from tidewater.plans.timeseries import TS, event_metric, events, instant_sql, whole_span
from tidewater.sources.shared import shared_path
from tidewater.streaming.flow import Flow, FlowManager, tumble_start

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, oracle
        return f

    return add


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id and a request line."""
    line = F.concat("event_type", F.lit(' - "GET /u/'), "user_id", F.lit('"  '), "event_id")
    return events(spark, sf_dir).select("event_id", line.alias("line"))


@query("etl_dissect", "SELECT event_id, event_type AS kind, 'GET' AS verb, '/u/' || user_id AS path, CAST(event_id AS VARCHAR) AS id FROM events")
def etl_dissect(spark, sf_dir):
    return run_processors(log_lines(spark, sf_dir), [{"dissect": {"field": "line", "pattern": '%{kind} %{?skip} "%{verb} %{path}"%{->}%{id}'}}]).select("event_id", "kind", "verb", "path", F.trim("id").alias("id"))


@query("etl_regex", "SELECT event_id, event_type AS line_kind, CAST(user_id AS VARCHAR) AS line_the_user FROM events")
def etl_regex(spark, sf_dir):
    return run_processors(log_lines(spark, sf_dir), [{"regex": {"fields": ["line"], "pattern": r'^(?<kind>\w+) - "GET /u/(?<the_user>\d+)"'}}]).drop("line")


@query("etl_csv", "SELECT event_id, event_type AS a, 'x,' || user_id AS b, CAST(value AS VARCHAR) AS c FROM events")
def etl_csv(spark, sf_dir):
    text = F.concat("event_type", F.lit(',"x,'), "user_id", F.lit('",'), "value").alias("t")
    return run_processors(events(spark, sf_dir).select("event_id", text), [{"csv": {"field": "t", "target_fields": ["a", "b", "c"]}}]).drop("t")


@query(
    "etl_text",
    """SELECT event_id, event_type AS colour, regexp_replace(event_type, '[aeiou]', '_', 'g') AS vowels, event_type || '-' || user_id AS joined, upper(event_type[1]) || event_type[2:] AS capital,
    url_encode(props || '*~+ ä') AS encoded, props || '*~+ ä' AS decoded FROM events""",
)
def etl_text(spark, sf_dir):
    rows = events(spark, sf_dir).select(
        "event_id", F.concat(F.lit("\x1b[31m"), "event_type", F.lit("\x1b[0m")).alias("colour"), F.col("event_type").alias("vowels"), F.array("event_type", F.col("user_id").cast("string")).alias("joined"),
        F.col("event_type").alias("capital"), F.concat("props", F.lit("*~+ ä")).alias("plain"),
    )
    steps = [
        {"decolorize": {"field": "colour"}}, {"gsub": {"field": "vowels", "pattern": "[aeiou]", "replacement": "_"}}, {"join": {"field": "joined", "separator": "-"}}, {"letter": {"field": "capital", "method": "capital"}},
        {"urlencoding": {"fields": ["plain, encoded"], "method": "encode"}}, {"urlencoding": {"fields": ["encoded, decoded"], "method": "decode"}}, {"select": {"type": "exclude", "fields": ["plain"]}},
    ]
    return run_processors(rows, steps)


@query("etl_times", "SELECT event_id, date_trunc('second', ts) AS day, date_trunc('millisecond', ts) AS at FROM events")
def etl_times(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.date_format("ts", "dd/MM/yyyy HH:mm:ss").alias("day"), F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("at"))
    return run_processors(rows, [{"date": {"field": "day", "formats": ["%Y-%m-%d", "%d/%m/%Y %H:%M:%S"]}}, {"epoch": {"field": "at", "resolution": "millisecond"}}])


@query("etl_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS t, json_type(props, '$.k') IS NOT NULL AS found FROM events")
def etl_json(spark, sf_dir):
    out = run_processors(events(spark, sf_dir), [{"json_parse": {"fields": ["props, v"]}}, {"simple_extract": {"fields": ["props, t"], "key": "k"}}])
    k = F.try_variant_get("v", "$.k", "bigint")
    return out.select("event_id", k.alias("k"), "t", k.isNotNull().alias("found"))


@query("etl_cmcd", "SELECT event_id, user_id AS c_br, true AS c_bs, event_type AS c_sid, CAST(1.5 AS DOUBLE) AS c_pr, CAST(NULL AS BIGINT) AS c_tb FROM events")
def etl_cmcd(spark, sf_dir):
    text = F.concat(F.lit("br="), "user_id", F.lit(',bs,pr=1.5,sid="'), "event_type", F.lit('"'))
    return run_processors(events(spark, sf_dir).select("event_id", text.alias("c")), [{"cmcd": {"field": "c"}}]).select("event_id", "c_br", "c_bs", "c_sid", "c_pr", "c_tb")


@query("etl_transform", "SELECT event_id AS id, value AS v, coalesce(TRY_CAST(event_type AS INTEGER), 7) AS n, ts AS at FROM events")
def etl_transform(spark, sf_dir):
    rows = events(spark, sf_dir).select(*[F.col(c).cast("string").alias(c) for c in ("event_id", "value", "event_type", "ts")])
    return transform(rows, [
        {"fields": ["event_id, id"], "type": "int64", "index": "tag"}, {"fields": ["value, v"], "type": "float64"}, {"fields": ["event_type, n"], "type": "int32", "default": 7}, {"fields": ["ts, at"], "type": "time", "index": "timestamp"},
    ])


@query("etl_dispatch", "SELECT event_id, CASE event_type WHEN 'error' THEN 'bad' WHEN 'signup' THEN 'new' ELSE '' END AS part FROM events")
def etl_dispatch(spark, sf_dir):
    parts = dispatch(events(spark, sf_dir), "event_type", {"error": "bad", "signup": "new"})
    first, *rest = [df.select("event_id", F.lit(suffix).alias("part")) for suffix, df in parts.items()]
    for df in rest:
        first = first.unionByName(df)
    return first


@query("etl_table_suffix", "SELECT '_' || event_type || '_' || user_id AS _table, count(*) AS n FROM events GROUP BY 1")
def etl_table_suffix(spark, sf_dir):
    return table_suffix(events(spark, sf_dir), "_${event_type}_${user_id}").groupBy("_table").agg(F.count(F.lit(1)).alias("n"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a span of its user's trace."""
    return events(spark, sf_dir).select(
        F.col("event_type").alias("service_name"), F.concat(F.lit("op"), F.col("event_id") % 5).alias("span_name"), F.when(F.col("value") > 50, "SERVER").otherwise("CLIENT").alias("span_kind"),
        F.col("user_id").cast("string").alias("trace_id"), F.lpad(F.col("event_id").cast("string"), 20, "0").alias("span_id"), "ts", (F.col("value") * 1000).cast("bigint").alias("duration_ns"), F.create_map(F.lit("props"), F.col("props")).alias("attributes"),
    )


@query("trace_services", "SELECT DISTINCT event_type AS service_name FROM events")
def trace_services(spark, sf_dir):
    return traces.services(spans(spark, sf_dir))


@query("trace_operations", "SELECT DISTINCT 'op' || (event_id % 5) AS span_name, 'SERVER' AS span_kind FROM events WHERE event_type = 'error' AND value > 50")
def trace_operations(spark, sf_dir):
    return traces.operations(spans(spark, sf_dir), "error", "SERVER")


@query("trace_get", "SELECT event_type AS service_name, lpad(CAST(event_id AS VARCHAR), 20, '0') AS span_id, ts FROM events WHERE user_id = 13")
def trace_get(spark, sf_dir):
    return traces.get_trace(spans(spark, sf_dir), "13").select("service_name", "span_id", "ts")


@query(
    "trace_find",
    """WITH newest AS (SELECT user_id FROM events WHERE event_type = 'error' AND event_id % 5 = 2 AND value > 20 GROUP BY 1 ORDER BY max(ts) DESC, CAST(user_id AS VARCHAR) LIMIT 20)
    SELECT trace_id, span_id FROM (SELECT CAST(user_id AS VARCHAR) AS trace_id, lpad(CAST(event_id AS VARCHAR), 20, '0') AS span_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r
    FROM events WHERE user_id IN (FROM newest)) WHERE r <= 3""",
)
def trace_find(spark, sf_dir):
    return traces.find_traces(spans(spark, sf_dir), "error", "op2", min_ns=20_001, limit=20).select("trace_id", "span_id")


@query("label_values", "SELECT DISTINCT event_type FROM events")
def label_values(spark, sf_dir):
    return PromQL(spark, {"m": event_metric(spark, sf_dir)}).label_values("m", "event_type")


@query("tql_eval", f"SELECT event_type, {TS}, CAST(count(*) AS DOUBLE) AS n FROM {instant_sql()} GROUP BY event_type, t")
def tql_eval(spark, sf_dir):
    engine = Engine(spark)
    engine.register("m", event_metric(spark, sf_dir))
    low, high = whole_span(spark, sf_dir) or (0, 0)
    return engine.sql(f"TQL EVAL ({low}, {high}, '1h', '1h') count by (event_type) (m) AS n")


def copied(kind: str, options: str = ""):
    """COPY of a query to files and back into a table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark).load(sf_dir, ["events"])
        path = shared_path(spark, kind)
        given = f"FORMAT='{kind}'{options}"
        engine.sql(f"COPY (SELECT event_id, event_type, value, props FROM events) TO '{path}' WITH ({given})")
        engine.sql(f"CREATE EXTERNAL TABLE back WITH (LOCATION='{path}', {given})")
        return engine.sql("SELECT CAST(event_id AS BIGINT) AS event_id, event_type, CAST(value AS DOUBLE) AS value, props FROM back")

    return run


for _kind, _options in (("parquet", ""), ("json", ", COMPRESSION_TYPE='gzip'"), ("orc", "")):
    query(f"copy_{_kind}", "SELECT event_id, event_type, value, props FROM events")(copied(_kind, _options))


@query("flow_windows", "SELECT event_type, date_trunc('hour', ts) AS w, count(*) AS n, max(value) AS top FROM events GROUP BY 1, 2")
def flow_windows(spark, sf_dir):
    """A flow over rows that come in two parts; the second run writes only the days that the second part touches."""
    rows = events(spark, sf_dir)
    plan = lambda df: df.groupBy("event_type", tumble_start("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    flows = FlowManager(spark, shared_path(spark, "flows"))
    flows.create(Flow("hourly", "sink", plan, "ts", 3600, "w", sequence="event_id"))
    half = rows.agg(F.max("event_id")).first()[0]
    flows.flush("hourly", rows.where(F.col("event_id") <= (half or 0) // 2))
    return flows.flush("hourly", rows)
