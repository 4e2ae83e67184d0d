"""Time-series queries over the event stream, with their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import geo, net, scalars, sketches, vector
from tidewater.operators import anomaly
from tidewater.operators.etl import run_processors
from tidewater.operators.logquery import log_query
from tidewater.operators.promql import PromQL
from tidewater.operators.range_select import Item, range_select
from tidewater.plans.tables import TimeSeriesTable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def event_metric(spark: SparkSession, sf_dir: str) -> TimeSeriesTable:
    """Values by event type and user; of equal times the greatest value counts."""
    return TimeSeriesTable(events(spark, sf_dir).select("event_type", "user_id", "ts", "value"), "ts", ["event_type", "user_id"], ["value"], merge="last_row")


def rounded(v: Column, digits: int) -> Column:
    """As the SQL rounds: the double product is rounded, half away from zero. Spark's round takes the shortest decimal form instead, which parts from it at ties."""
    scaled = v * 10.0**digits
    size = F.abs(scaled)
    whole = F.floor(size).cast("double")
    near = F.signum(scaled) * (whole + F.when(size - whole >= 0.5, 1.0).otherwise(0.0)) / 10.0**digits
    return F.when(size < 2.0**52, near).otherwise(v)  # larger ones are whole; NaN is greater than all


HOURS = "(SELECT epoch_ms(min(ts)) // 3600000 FROM events)", "(SELECT (epoch_ms(max(ts)) + 3599999) // 3600000 FROM events)"


def grid_sql(before: int = 0, after: int = 0) -> str:
    """Hours from that of the first row to the one at or after the last row, and some more on either side, as milliseconds t."""
    return f"(SELECT unnest(range({HOURS[0]} - {before}, {HOURS[1]} + {after} + 1)) * 3600000 AS t)"


GRID = grid_sql()
SERIES = "(SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, epoch_ms(ts) AS ts, max(value) AS v FROM events GROUP BY ALL)"
#: Samples at one time of a series in different microseconds fall together in milliseconds; the later row counts.
SAMPLES = "(SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) // 1000 AS ms, epoch_us(ts) AS us, max(value) AS v FROM events GROUP BY ALL)"


def whole_span(spark: SparkSession, sf_dir: str) -> tuple[int, int] | None:
    """Seconds of the hour of the first row and of the hour at or after the last one; None where no row has a time."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events(spark, sf_dir).agg(F.min(us), F.max(us)).first()
    return None if low is None else (low // 3_600_000_000 * 3600, -(-high // 3_600_000_000) * 3600)


def promql(text: str, ahead: int = 0, step: float = 3600, lookback: int | None = 3_600_000):
    """Evaluates hourly from the first hour of the table to its last and ``ahead`` seconds more, so that every row is read."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        span = whole_span(spark, sf_dir)
        low, high = span or (0, 0)
        out = PromQL(spark, {"m": event_metric(spark, sf_dir)}).query_range(text, low, high + ahead, step, lookback)
        return out if span else out.limit(0)

    return run


def instant_sql(extra: str = "") -> str:
    """Instant vector of m on the grid with a lookback of an hour."""
    return f"(SELECT event_type, user_id, t, arg_max(v, us) AS v FROM {SAMPLES} s JOIN {GRID} g ON s.ms <= g.t AND s.ms > g.t - 3600000 {extra} GROUP BY ALL)"


def window_sql(span_ms: int) -> str:
    return f"(SELECT event_type, user_id, t, us, ms, v FROM {SAMPLES} s JOIN {GRID} g ON s.ms <= g.t AND s.ms > g.t - {span_ms})"


TS = "CAST(make_timestamp(t * 1000) AS TIMESTAMP) AS ts"
PROMQL: dict[str, tuple[str, str]] = {
    "promql_instant_selector": ('m{event_type="click"}', f"SELECT event_type, user_id, {TS}, v AS value FROM {instant_sql()} WHERE event_type = 'click'"),
    "promql_regex_matchers": ('m{event_type=~"c.*|view", user_id!~"1.*"}', f"SELECT event_type, user_id, {TS}, v AS value FROM {instant_sql()} WHERE regexp_full_match(event_type, 'c.*|view') AND NOT regexp_full_match(user_id, '1.*')"),
    "promql_sum_by": ("sum by (event_type) (m)", f"SELECT event_type, {TS}, round(sum(v), 4) AS value FROM {instant_sql()} GROUP BY event_type, t"),
    "promql_avg_without": ("avg without (user_id) (m + 0.0000001)", f"SELECT event_type, {TS}, round(avg(v) + 1e-7, 4) AS value FROM {instant_sql()} GROUP BY event_type, t"),
    "promql_min_max_count": ("max(m) - min(m) + count(m)", f"SELECT {TS}, round(max(v) - min(v) + count(*), 4) AS value FROM {instant_sql()} GROUP BY t"),
    "promql_stddev": ("stddev by (event_type) (m)", f"SELECT event_type, {TS}, round(stddev_pop(v), 4) AS value FROM {instant_sql()} GROUP BY event_type, t"),
    "promql_quantile": ("quantile by (event_type) (0.75, m)", f"SELECT event_type, {TS}, round(quantile_cont(v, 0.75), 4) AS value FROM {instant_sql()} GROUP BY event_type, t"),
    "promql_topk": ("topk by (event_type) (2, m)", f"SELECT event_type, user_id, {TS}, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, t ORDER BY v DESC, event_type, user_id) AS n FROM {instant_sql()}) WHERE n <= 2"),
    "promql_bottomk": ("bottomk(3, m)", f"SELECT event_type, user_id, {TS}, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY v, event_type, user_id) AS n FROM {instant_sql()}) WHERE n <= 3"),
    "promql_count_values": ('count_values("bucket", floor(m / 100))', f"SELECT format('{{:.0f}}', floor(v / 100)) AS bucket, {TS}, CAST(count(*) AS DOUBLE) AS value FROM {instant_sql()} GROUP BY 1, t"),
    "promql_sum_over_time": ("sum_over_time(m[2h])", f"SELECT event_type, user_id, {TS}, round(sum(v), 4) AS value FROM {window_sql(7200000)} GROUP BY event_type, user_id, t"),
    "promql_avg_over_time": ("avg_over_time(m[2h])", f"SELECT event_type, user_id, {TS}, round(avg(v), 4) AS value FROM {window_sql(7200000)} GROUP BY event_type, user_id, t"),
    "promql_min_over_time": ("min_over_time(m[2h])", f"SELECT event_type, user_id, {TS}, min(v) AS value FROM {window_sql(7200000)} GROUP BY event_type, user_id, t"),
    "promql_max_over_time": ("max_over_time(m[2h])", f"SELECT event_type, user_id, {TS}, max(v) AS value FROM {window_sql(7200000)} GROUP BY event_type, user_id, t"),
    "promql_count_over_time": ("count_over_time(m[2h])", f"SELECT event_type, user_id, {TS}, CAST(count(*) AS DOUBLE) AS value FROM {window_sql(7200000)} GROUP BY event_type, user_id, t"),
    "promql_last_over_time": ("last_over_time(m[2h])", f"SELECT event_type, user_id, {TS}, arg_max(v, us) AS value FROM {window_sql(7200000)} GROUP BY event_type, user_id, t"),
    "promql_stdvar_over_time": ("stdvar_over_time(m[6h]) + 0.0000001", f"SELECT event_type, user_id, {TS}, round(var_pop(v) + 1e-7, 3) AS value FROM {window_sql(21600000)} GROUP BY event_type, user_id, t"),
    "promql_quantile_over_time": ("quantile_over_time(0.9, m[6h])", f"SELECT event_type, user_id, {TS}, round(quantile_cont(v, 0.9), 4) AS value FROM {window_sql(21600000)} GROUP BY event_type, user_id, t"),
    "promql_changes": ("changes(m[6h])", f"SELECT event_type, user_id, {TS}, CAST(count(*) FILTER (v <> p) AS DOUBLE) AS value FROM (SELECT *, lag(v) OVER (PARTITION BY event_type, user_id, t ORDER BY us) AS p FROM {window_sql(21600000)}) GROUP BY event_type, user_id, t"),
    "promql_resets": ("resets(m[6h])", f"SELECT event_type, user_id, {TS}, CAST(count(*) FILTER (v < p) AS DOUBLE) AS value FROM (SELECT *, lag(v) OVER (PARTITION BY event_type, user_id, t ORDER BY us) AS p FROM {window_sql(21600000)}) GROUP BY event_type, user_id, t"),
    "promql_delta": (
        "delta(m[6h])",
        f"""SELECT event_type, user_id, {TS}, round((v1 - v0) * (d + CASE WHEN a < 1.1 * d / (n - 1) THEN a ELSE d / (n - 1) / 2 END + CASE WHEN b < 1.1 * d / (n - 1) THEN b ELSE d / (n - 1) / 2 END) / d, 1) AS value
        FROM (SELECT event_type, user_id, t, count(*) AS n, arg_min(v, us) AS v0, arg_max(v, us) AS v1, (max(ms) - min(ms)) / 1000.0 AS d, (min(ms) - t + 21600000) / 1000.0 AS a, (t - max(ms)) / 1000.0 AS b
              FROM {window_sql(21600000)} GROUP BY event_type, user_id, t) WHERE n > 1 AND d > 0""",
    ),
    "promql_rate": (
        "rate(m[6h])",
        f"""SELECT event_type, user_id, {TS}, round(c * (d + CASE WHEN a < 1.1 * d / (n - 1) THEN a ELSE d / (n - 1) / 2 END + CASE WHEN b < 1.1 * d / (n - 1) THEN b ELSE d / (n - 1) / 2 END) / d / 21600, 6) AS value
        FROM (SELECT event_type, user_id, t, n, d, b, c, CASE WHEN c > 0 AND v0 >= 0 THEN least(a, d * v0 / c) ELSE a END AS a
              FROM (SELECT event_type, user_id, t, count(*) AS n, arg_min(v, us) AS v0, arg_max(v, us) - arg_min(v, us) + coalesce(sum(p) FILTER (v < p), 0) AS c, (max(ms) - min(ms)) / 1000.0 AS d, (min(ms) - t + 21600000) / 1000.0 AS a, (t - max(ms)) / 1000.0 AS b
                    FROM (SELECT *, lag(v) OVER (PARTITION BY event_type, user_id, t ORDER BY us) AS p FROM {window_sql(21600000)}) GROUP BY event_type, user_id, t)) WHERE n > 1 AND d > 0""",
    ),
    "promql_deriv": ("deriv(m[6h])", f"SELECT event_type, user_id, {TS}, round(regr_slope(v, (ms - t) / 1000.0), 3) + 0.0 AS value FROM {window_sql(21600000)} GROUP BY event_type, user_id, t HAVING count(*) > 1 AND max(ms) > min(ms)"),
    "promql_predict_linear": ("predict_linear(m[6h], 600)", f"SELECT event_type, user_id, {TS}, round(avg(v) + regr_slope(v, (ms - t) / 1000.0) * (max(ms - t) / 1000.0 + 600 - avg((ms - t) / 1000.0)), 2) AS value FROM {window_sql(21600000)} GROUP BY event_type, user_id, t HAVING count(*) > 1 AND max(ms) > min(ms)"),
    "promql_vector_scalar": ("m * 2 - 1 > 100", f"SELECT event_type, user_id, {TS}, round(v * 2 - 1, 6) AS value FROM {instant_sql()} WHERE v * 2 - 1 > 100"),
    "promql_bool_comparison": ("m >= bool 50", f"SELECT event_type, user_id, {TS}, CAST(v >= 50 AS DOUBLE) AS value FROM {instant_sql()}"),
    "promql_vector_vector": ('sum by (user_id) (m{event_type="click"}) / on (user_id) sum by (user_id) (m)', f"SELECT user_id, {TS}, round(sum(v) FILTER (event_type = 'click') / sum(v), 6) AS value FROM {instant_sql()} GROUP BY user_id, t HAVING count(*) FILTER (event_type = 'click') > 0"),
    "promql_group_left": ("m / on (event_type) group_left sum by (event_type) (m)", f"SELECT event_type, user_id, {TS}, round(v / sum(v) OVER (PARTITION BY event_type, t), 6) AS value FROM {instant_sql()}"),
    "promql_and": ('m and on (user_id) m{event_type="error"}', f"SELECT event_type, user_id, {TS}, v AS value FROM {instant_sql()} a WHERE EXISTS (SELECT 1 FROM {instant_sql()} b WHERE b.event_type = 'error' AND b.user_id = a.user_id AND b.t = a.t)"),
    "promql_unless": ('m unless on (user_id) m{event_type="error"}', f"SELECT event_type, user_id, {TS}, v AS value FROM {instant_sql()} a WHERE NOT EXISTS (SELECT 1 FROM {instant_sql()} b WHERE b.event_type = 'error' AND b.user_id = a.user_id AND b.t = a.t)"),
    "promql_or": ('m{event_type="click"} or m{event_type="view"}', f"SELECT event_type, user_id, {TS}, v AS value FROM {instant_sql()} WHERE event_type IN ('click', 'view')"),
    "promql_offset": ("sum(m offset 1h)", f"SELECT CAST(make_timestamp((t + 0) * 1000) AS TIMESTAMP) AS ts, round(sum(v), 4) AS value FROM (SELECT event_type, user_id, t, arg_max(v, us) AS v FROM {SAMPLES} s JOIN {grid_sql(0, 1)} g ON s.ms <= g.t - 3600000 AND s.ms > g.t - 7200000 GROUP BY ALL) GROUP BY t"),
    "promql_time_functions": ("hour(vector(time())) + day_of_week(vector(time()))", f"SELECT {TS}, CAST(hour(make_timestamp(t * 1000)) + dayofweek(make_timestamp(t * 1000)) AS DOUBLE) AS value FROM {GRID}"),
    "promql_absent": ('absent(m{event_type="missing"})', f"SELECT 'missing' AS event_type, {TS}, CAST(1 AS DOUBLE) AS value FROM {GRID}"),
    "promql_label_replace": ('label_replace(sum by (event_type) (m), "kind", "$1x", "event_type", "(.).*")', f"SELECT event_type, substr(event_type, 1, 1) || 'x' AS kind, {TS}, round(sum(v), 4) AS value FROM {instant_sql()} GROUP BY event_type, t"),
    "promql_label_join": ('label_join(m, "both", "-", "event_type", "user_id")', f"SELECT event_type, user_id, event_type || '-' || user_id AS \"both\", {TS}, v AS value FROM {instant_sql()}"),
    "promql_math": ("sqrt(abs(m)) + ln(m + 1) + round(m, 5) + clamp(m, 10, 20)", f"SELECT event_type, user_id, {TS}, round(sqrt(abs(v)) + ln(v + 1) + floor(v / 5 + 0.5) * 5 + greatest(10, least(20, v)), 5) AS value FROM {instant_sql()}"),
    "promql_scalar": ("scalar(sum(m)) + 1", f"SELECT {TS}, coalesce(round(sum(v) + 1, 4), 'nan'::DOUBLE) AS value FROM {GRID} g LEFT JOIN {instant_sql()} i USING (t) GROUP BY t"),
    "promql_subquery": ("max_over_time(sum(m)[3h:1h])", f"SELECT CAST(make_timestamp(g.t * 1000) AS TIMESTAMP) AS ts, round(max(s), 4) AS value FROM {GRID} g JOIN (SELECT t, sum(v) AS s FROM (SELECT event_type, user_id, t, arg_max(v, us) AS v FROM {SAMPLES} s JOIN {grid_sql(3)} g ON s.ms <= g.t AND s.ms > g.t - 3600000 GROUP BY ALL) GROUP BY t) i ON i.t <= g.t AND i.t > g.t - 10800000 GROUP BY g.t"),
    "promql_increase": (
        "increase(m[6h]) + 0.000001",
        f"""SELECT event_type, user_id, {TS}, round(c * (d + CASE WHEN a < 1.1 * d / (n - 1) THEN a ELSE d / (n - 1) / 2 END + CASE WHEN b < 1.1 * d / (n - 1) THEN b ELSE d / (n - 1) / 2 END) / d + 1e-6, 2) AS value
        FROM (SELECT event_type, user_id, t, n, d, b, c, CASE WHEN c > 0 AND v0 >= 0 THEN least(a, d * v0 / c) ELSE a END AS a
              FROM (SELECT event_type, user_id, t, count(*) AS n, arg_min(v, us) AS v0, arg_max(v, us) - arg_min(v, us) + coalesce(sum(p) FILTER (v < p), 0) AS c, (max(ms) - min(ms)) / 1000.0 AS d, (min(ms) - t + 21600000) / 1000.0 AS a, (t - max(ms)) / 1000.0 AS b
                    FROM (SELECT *, lag(v) OVER (PARTITION BY event_type, user_id, t ORDER BY us) AS p FROM {window_sql(21600000)}) GROUP BY event_type, user_id, t)) WHERE n > 1 AND d > 0""",
    ),
    "promql_idelta": ("idelta(m[6h])", f"SELECT event_type, user_id, {TS}, round(l[-1] - l[-2], 4) + 0.0 AS value FROM (SELECT event_type, user_id, t, list(v ORDER BY us) AS l FROM {window_sql(21600000)} GROUP BY ALL) WHERE len(l) > 1"),
    "promql_irate": ("irate(m[6h])", f"SELECT event_type, user_id, {TS}, round(CASE WHEN l[-1] < l[-2] THEN l[-1] ELSE l[-1] - l[-2] END * 1000 / (k[-1] - k[-2]), 6) + 0.0 AS value FROM (SELECT event_type, user_id, t, list(v ORDER BY us) AS l, list(ms ORDER BY us) AS k FROM {window_sql(21600000)} GROUP BY ALL) WHERE len(l) > 1 AND k[-1] > k[-2]"),
    "promql_present_over_time": ("present_over_time(m[2h])", f"SELECT event_type, user_id, {TS}, CAST(1 AS DOUBLE) AS value FROM {window_sql(7200000)} GROUP BY event_type, user_id, t"),
    "promql_absent_over_time": ('absent_over_time(m{event_type="missing"}[1h])', f"SELECT 'missing' AS event_type, {TS}, CAST(1 AS DOUBLE) AS value FROM {GRID}"),
    "promql_unary_minus": ("-m", f"SELECT event_type, user_id, {TS}, -v AS value FROM {instant_sql()}"),
    "promql_sort_desc": ("sort_desc(max by (event_type) (m))", f"SELECT event_type, {TS}, max(v) AS value FROM {instant_sql()} GROUP BY event_type, t"),
    "promql_at": ("sum(m @ 1704110400)", f"SELECT {TS}, (SELECT round(sum(v), 4) FROM {instant_sql()} WHERE t = 1704110400000) AS value FROM {GRID}"),
}
ROUNDED = {
    "promql_sum_by": 4, "promql_avg_without": 4, "promql_min_max_count": 4, "promql_stddev": 4, "promql_quantile": 4, "promql_sum_over_time": 4, "promql_avg_over_time": 4, "promql_stdvar_over_time": 3, "promql_quantile_over_time": 4,
    "promql_delta": 1, "promql_rate": 6, "promql_deriv": 3, "promql_predict_linear": 2, "promql_vector_scalar": 6, "promql_vector_vector": 6, "promql_group_left": 6, "promql_offset": 4, "promql_label_replace": 4, "promql_math": 5, "promql_scalar": 4,
    "promql_subquery": 4, "promql_increase": 2, "promql_idelta": 4, "promql_irate": 6, "promql_at": 4,
}
#: Seconds by which a query looks back with an offset: the whole table's last rows are seen so much later.
AHEAD = {"promql_offset": 3600}
for _name, (_text, _sql) in PROMQL.items():
    _run = promql(_text, AHEAD.get(_name, 0))
    if _name in ROUNDED:
        QUERIES[_name] = lambda spark, sf_dir, f=_run, d=ROUNDED[_name]: f(spark, sf_dir).withColumn("value", rounded(F.col("value"), d) + 0.0)
    else:
        QUERIES[_name] = _run
    ORACLE_SQL[_name] = _sql


@query("range_avg_5m", "SELECT event_type, time_bucket(INTERVAL '5 minutes', ts) AS ts, round(avg(value), 6) AS v, count(*) AS n FROM events GROUP BY 1, 2")
def range_avg(spark, sf_dir):
    out = range_select(events(spark, sf_dir), "ts", [Item("avg", "value", "5m", "v"), Item("count", "value", "5m", "n")], "5m", ["event_type"])
    return out.withColumn("v", F.round("v", 6))


@query(
    "range_overlapping",
    """SELECT event_type, make_timestamp(s * 1000000) AS ts, round(sum(value), 4) AS v, max(CASE WHEN u < s + 3600 THEN value END) AS m FROM (
    SELECT event_type, value, epoch_us(ts) / 1e6 AS u, unnest(range(CAST(floor(epoch_us(ts) / 1e6 / 3600) AS BIGINT) - 2, CAST(floor(epoch_us(ts) / 1e6 / 3600) AS BIGINT) + 1)) * 3600 AS s FROM events) WHERE u < s + 10800 GROUP BY event_type, s""",
)
def range_overlapping(spark, sf_dir):
    out = range_select(events(spark, sf_dir), "ts", [Item("sum", "value", "3h", "v"), Item("max", "value", "1h", "m")], "1h", ["event_type"])
    return out.withColumn("v", F.round("v", 4))


FILL_SLOTS = "WITH s AS (SELECT user_id, epoch(time_bucket(INTERVAL '1 hour', ts)) AS b, avg(value) AS v FROM events GROUP BY 1, 2), d AS (SELECT user_id, unnest(range(CAST(min(b) AS BIGINT), CAST(max(b) AS BIGINT) + 1, 3600)) AS b FROM s GROUP BY 1), j AS (SELECT d.user_id, d.b, s.v FROM d LEFT JOIN s ON d.user_id = s.user_id AND d.b = s.b)"


def filled(kind):
    def run(spark, sf_dir):
        out = range_select(events(spark, sf_dir).withColumn("user_id", F.col("user_id")), "ts", [Item("avg", "value", "1h", "v", kind)], "1h", ["user_id"])
        return out.withColumn("v", rounded(F.col("v") + 1e-7, 3))

    return run


query("range_fill_null", f"{FILL_SLOTS} SELECT user_id, make_timestamp(CAST(b * 1000000 AS BIGINT)) AS ts, round(v + 1e-7, 3) AS v FROM j")(filled("NULL"))
query("range_fill_prev", f"{FILL_SLOTS} SELECT user_id, make_timestamp(CAST(b * 1000000 AS BIGINT)) AS ts, round(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY b) + 1e-7, 3) AS v FROM j")(filled("PREV"))
query("range_fill_constant", f"{FILL_SLOTS} SELECT user_id, make_timestamp(CAST(b * 1000000 AS BIGINT)) AS ts, round(coalesce(v, 0) + 1e-7, 3) AS v FROM j")(filled(0.0))
query(
    "range_fill_linear",
    FILL_SLOTS + """, e AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN b END IGNORE NULLS) OVER p AS b0, last_value(v IGNORE NULLS) OVER p AS v0, first_value(CASE WHEN v IS NOT NULL THEN b END IGNORE NULLS) OVER f AS b1, first_value(v IGNORE NULLS) OVER f AS v1
    FROM j WINDOW p AS (PARTITION BY user_id ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT user_id, make_timestamp(CAST(b * 1000000 AS BIGINT)) AS ts, round(coalesce(v, v0 + (v1 - v0) * (b - b0) / nullif(b1 - b0, 0)) + 1e-7, 3) AS v FROM e""",
)(filled("LINEAR"))


@query("last_point", "SELECT event_type, user_id, max(ts) AS ts, arg_max(value, struct_pack(ts := ts, value := value)) AS value FROM events GROUP BY 1, 2")
def last_point(spark, sf_dir):
    return event_metric(spark, sf_dir).last_rows()


@query("dedup_last_row", "SELECT user_id, date_trunc('hour', ts) AS ts, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def dedup_last_row(spark, sf_dir):
    df = events(spark, sf_dir).select("user_id", F.date_trunc("hour", "ts").alias("ts"), "event_type", "value", "event_id")
    return TimeSeriesTable(df, "ts", ["user_id"], ["event_type", "value"], merge="last_row", sequence="event_id").read()


@query("dedup_last_non_null", "SELECT user_id, date_trunc('hour', ts) AS ts, arg_max(CASE WHEN value > 50 THEN value END, event_id) FILTER (value > 50) AS a, arg_max(event_type, event_id) FILTER (event_type <> 'click') AS b FROM events GROUP BY 1, 2")
def dedup_last_non_null(spark, sf_dir):
    df = events(spark, sf_dir).select("user_id", F.date_trunc("hour", "ts").alias("ts"), F.when(F.col("value") > 50, F.col("value")).alias("a"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("b"), "event_id")
    return TimeSeriesTable(df, "ts", ["user_id"], ["a", "b"], merge="last_non_null", sequence="event_id").read()


@query("tombstones", "SELECT user_id, ts, value, event_id FROM (SELECT user_id, date_trunc('hour', ts) AS ts, arg_max(value, event_id) AS value, arg_max(event_type = 'error', event_id) AS gone, max(event_id) AS event_id FROM events GROUP BY 1, 2) WHERE NOT gone")
def tombstones(spark, sf_dir):
    df = events(spark, sf_dir).select("user_id", F.date_trunc("hour", "ts").alias("ts"), "value", (F.col("event_type") == "error").alias("gone"), "event_id")
    return TimeSeriesTable(df, "ts", ["user_id"], ["value"], merge="last_row", sequence="event_id", tombstone="gone").read()


@query("anomaly_zscore", "SELECT event_id, round(CASE WHEN count(*) OVER w >= 2 THEN CASE WHEN stddev_pop(value) OVER w = 0 THEN 0 ELSE abs(value - avg(value) OVER w) / stddev_pop(value) OVER w END END, 5) AS z FROM events WINDOW w AS (PARTITION BY user_id)")
def anomaly_zscore(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.round(anomaly.anomaly_score_zscore(F.col("value"), Window.partitionBy("user_id")), 5).alias("z"))


@query(
    "anomaly_mad",
    """WITH a AS (SELECT event_id, user_id, value, median(value) OVER (PARTITION BY user_id) AS m, count(*) OVER (PARTITION BY user_id) AS n FROM events), b AS (SELECT *, median(abs(value - m)) OVER (PARTITION BY user_id) AS d FROM a)
    SELECT event_id, CASE WHEN n >= 3 AND d > 0 THEN round(abs(value - m) / (d * 1.4826), 5) END AS s FROM b""",
)
def anomaly_mad(spark, sf_dir):
    return anomaly.mad_scores(events(spark, sf_dir).select("event_id", "user_id", "value"), "value", ["user_id"]).select("event_id", F.round("score", 5).alias("s"))


@query(
    "anomaly_iqr",
    """WITH a AS (SELECT event_id, value, quantile_cont(value, 0.25) OVER w AS q1, quantile_cont(value, 0.75) OVER w AS q3, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id))
    SELECT event_id, CASE WHEN n >= 3 THEN round(greatest(0, q1 - 1.5 * (q3 - q1) - value, value - q3 - 1.5 * (q3 - q1)) / (q3 - q1), 5) END AS s FROM a""",
)
def anomaly_iqr(spark, sf_dir):
    return anomaly.iqr_scores(events(spark, sf_dir).select("event_id", "user_id", "value"), "value", 1.5, ["user_id"]).select("event_id", F.round("score", 5).alias("s"))


@query("vector_distances", "SELECT vec_id, round(1 - list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE)) / sqrt(64 * list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 8) AS cos, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE - 1) * (x::DOUBLE - 1))), 5) AS l2, CAST(len(embedding) AS BIGINT) AS dim FROM embeddings")
def vector_distances(spark, sf_dir):
    v, one = F.col("embedding"), F.array_repeat(F.lit(1.0).cast("float"), 64)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.round(vector.vec_cos_distance(v, one), 8).alias("cos"), F.round(vector.vec_l2sq_distance(v, one), 5).alias("l2"), vector.vec_dim(v).alias("dim"))


@query("vector_avg", "SELECT label, round(list_sum(list(x ORDER BY i)), 3) AS total, count(*) AS dim FROM (SELECT label, i, CAST(avg(x) AS FLOAT)::DOUBLE AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY label, i) GROUP BY label")
def vector_avg(spark, sf_dir):
    out = vector.vec_avg(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), ["label"], "embedding", "v")
    return out.select("label", F.round(vector.vec_elem_sum(F.col("v")), 3).alias("total"), vector.vec_dim(F.col("v")).alias("dim"))


@query("vector_knn", "SELECT vec_id FROM (SELECT vec_id, list_sum(list_transform(embedding, lambda x: (x::DOUBLE - 0.1) * (x::DOUBLE - 0.1))) AS d FROM embeddings) ORDER BY d LIMIT 10")
def vector_knn(spark, sf_dir):
    import struct

    tenth = struct.unpack("f", struct.pack("f", 0.1))[0]
    return vector.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding", [0.1 if tenth else 0.1] * 64, 10, "l2sq").select("vec_id")


@query("ip_functions", "SELECT user_id, format('{}.{}.{}.{}', (n >> 24) & 255, (n >> 16) & 255, (n >> 8) & 255, n & 255) AS ip, n AS num, (n >> 16) = 2560 AS inside FROM (SELECT DISTINCT user_id, 167772160 + user_id * 7919 AS n FROM events)")
def ip_functions(spark, sf_dir):
    ip = net.ipv4_num_to_string(F.lit(167772160) + F.col("user_id") * 7919)
    df = events(spark, sf_dir).select("user_id").distinct().withColumn("ip", ip)
    return df.select("user_id", "ip", net.ipv4_string_to_num(F.col("ip")).alias("num"), net.ipv4_in_range(F.col("ip"), F.lit("10.0.0.0/16")).alias("inside"))


@query("geo_distance", "SELECT DISTINCT user_id, round(2 * 6371008.8 * asin(least(1.0, sqrt(power(sin(radians(user_id % 90) / 2), 2)))), 1) AS m FROM events")
def geo_distance(spark, sf_dir):
    zero = F.lit(0.0)
    return events(spark, sf_dir).select("user_id").distinct().select("user_id", F.round(geo.distance_sphere_m(zero, zero, (F.col("user_id") % 90).cast("double"), zero), 1).alias("m"))


@query("geohash_cells")
def geohash_cells(spark, sf_dir):
    lat, lon = (F.col("user_id") % 180 - 90).cast("double"), (F.col("user_id") * 7 % 360 - 180).cast("double")
    return events(spark, sf_dir).select("user_id").distinct().select("user_id", geo.geohash(lat, lon, 9).alias("hash"), geo.geohash_neighbours(lat, lon, 6).alias("around"))


@query("json_functions", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS s, json_exists(props, '$.k') AS has, json_exists(props, '$.z') AS none FROM events")
def json_functions(spark, sf_dir):
    p = F.col("props")
    return events(spark, sf_dir).select("event_id", scalars.json_get(p, "k", "int").alias("k"), scalars.json_get(p, "k", "string").alias("s"), scalars.json_path_exists(p, "$.k").alias("has"), scalars.json_path_exists(p, "$.z").alias("none"))


@query("mysql_string_functions", "SELECT n_nationkey, CASE n_regionkey WHEN 1 THEN 'a' WHEN 2 THEN 'b' END AS e, CASE n_name WHEN 'x' THEN 1 ELSE 0 END AS f, n_name AS c, substr(n_name, 1, 1) || 'ZZ' || substr(n_name, 4) AS i, gcd(n_nationkey, 12) AS g FROM nation")
def mysql_string_functions(spark, sf_dir):
    n = F.col("n_name")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        "n_nationkey", scalars.elt(F.col("n_regionkey"), F.lit("a"), F.lit("b")).alias("e"), scalars.field(n, F.lit("x")).alias("f"), scalars.concat(n, F.lit(None).cast("string")).alias("c"),
        scalars.insert(n, F.lit(2), F.lit(2), F.lit("ZZ")).alias("i"), scalars.gcd(F.col("n_nationkey"), F.lit(12)).alias("g"),
    )


@query("date_bin", "SELECT time_bucket(INTERVAL '15 minutes', ts) AS b, strftime(min(ts), '%Y-%m-%d %H:%M') AS first, CAST(floor(epoch(max(ts))) AS BIGINT) AS last FROM events GROUP BY 1")
def date_bin(spark, sf_dir):
    return events(spark, sf_dir).groupBy(scalars.date_bin(900_000_000, F.col("ts")).alias("b")).agg(scalars.date_format(F.min("ts"), "%Y-%m-%d %H:%M").alias("first"), scalars.to_unixtime(F.max("ts")).alias("last"))


@query("full_text_matches", r"SELECT doc_id FROM documents WHERE (contains(lower(text), 'the') AND contains(lower(text), 'that')) AND NOT contains(lower(text), 'whining')")
def full_text_matches(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where(scalars.matches(F.col("text"), "the AND that -whining")).select("doc_id")


@query("matches_term", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^A-Za-z0-9_])the([^A-Za-z0-9_]|$)')")
def matches_term(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where(scalars.matches_term(F.col("text"), "the")).select("doc_id")


@query("hll_distinct")
def hll_distinct(spark, sf_dir):
    states = events(spark, sf_dir).groupBy("event_type", F.date_trunc("day", "ts").alias("d")).agg(sketches.hll(F.col("user_id").cast("string")).alias("s"))
    return states.groupBy("event_type").agg(sketches.hll_count(sketches.hll_merge(F.col("s"))).alias("users"))


@query("count_hash", "SELECT count(*) AS n FROM (SELECT DISTINCT event_type, user_id FROM events)")
def count_hash(spark, sf_dir):
    return events(spark, sf_dir).agg(sketches.count_hash(F.col("event_type"), F.col("user_id")).alias("n"))


@query("uddsketch_quantiles")
def uddsketch_quantiles(spark, sf_dir):
    days = sketches.uddsketch_state(events(spark, sf_dir).withColumn("d", F.to_date("ts")), ["event_type", "d"], "value", 256, 0.01)
    whole = sketches.uddsketch_merge(days, ["event_type"], "state", 256, 0.01)
    return whole.select("event_type", *[sketches.uddsketch_calc(p, F.col("state")).alias(f"p{int(p * 100)}") for p in (0.5, 0.95)])


@query("log_query", "SELECT event_id, ts, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-03' AND (contains(event_type, 'e') OR value BETWEEN 10 AND 20) ORDER BY ts LIMIT 100")
def run_log_query(spark, sf_dir):
    spec = {
        "time_filter": {"start": "2024-01-02"}, "columns": ["event_id", "ts", "event_type", "value"], "limit": {"fetch": 100},
        "filters": {"Or": [{"Single": {"column": "event_type", "filters": [{"Contains": "e"}]}}, {"Single": {"column": "value", "filters": [{"Between": {"start": 10, "end": 20}}]}}]},
    }
    return log_query(events(spark, sf_dir), spec)


@query("log_query_context", "SELECT event_id FROM (SELECT event_id, bool_or(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS near FROM events) WHERE near")
def log_query_context(spark, sf_dir):
    spec = {"filters": {"Single": {"column": "event_type", "filters": [{"Exact": "error"}]}}, "context": {"Lines": [2, 1]}, "context_by": ["user_id"], "columns": ["event_id"]}
    return log_query(events(spark, sf_dir), spec)


@query("log_query_aggregate", "SELECT event_type, count(value) AS n, max(value) AS top FROM events GROUP BY 1")
def log_query_aggregate(spark, sf_dir):
    return log_query(events(spark, sf_dir), {"exprs": [{"AggrFunc": {"expr": [{"name": "count", "args": ["value"], "alias": "n"}, {"name": "max", "args": ["value"], "alias": "top"}], "by": ["event_type"]}}]})


@query("etl_pipeline", r"SELECT event_id, upper(event_type) AS kind, json_extract_string(props, '$.k') AS k, regexp_replace(props, '\d+', '', 'g') AS props_digest FROM events WHERE lower(event_type) NOT IN ('error')")
def etl_pipeline(spark, sf_dir):
    steps = [
        {"json_path": {"fields": ["props, k"], "json_path": "$.k"}}, {"digest": {"fields": ["props"], "presets": ["numbers"]}}, {"letter": {"fields": ["event_type, kind"], "method": "upper"}},
        {"filter": {"field": "event_type", "targets": ["ERROR"]}}, {"select": {"fields": ["event_id", "kind", "k", "props_digest"]}},
    ]
    return run_processors(events(spark, sf_dir), steps)


@query("double_groupby", "SELECT user_id, date_trunc('hour', ts) AS hour, round(avg(value), 6) AS v FROM events GROUP BY 1, 2")
def double_groupby(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.round(F.avg("value"), 6).alias("v"))


@query("groupby_orderby_limit", "SELECT time_bucket(INTERVAL '1 minute', ts) AS minute, max(value) AS v FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1 ORDER BY 1 DESC LIMIT 5")
def groupby_orderby_limit(spark, sf_dir):
    return events(spark, sf_dir).where(F.col("ts") < F.lit("2024-01-20").cast("timestamp")).groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(F.max("value").alias("v")).orderBy(F.col("minute").desc()).limit(5)


@query("high_value_all", "SELECT event_id, user_id, ts, value FROM events WHERE value > 90")
def high_value_all(spark, sf_dir):
    return events(spark, sf_dir).where("value > 90").select("event_id", "user_id", "ts", "value")


@query("trace_earliest_three", "SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r <= 3")
def trace_earliest_three(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 3").select("event_id", "user_id")
