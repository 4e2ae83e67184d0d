"""Ingest formats over text and JSON columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def influx_lines(df: DataFrame, column: str = "value", precision: str = "ns") -> DataFrame:
    """measurement, tags (map), fields (map of texts), ts of InfluxDB lines; comments and empty lines go."""
    unit = {"ns": 1000, "us": 1, "ms": 1 / 1000, "s": 1 / 1_000_000}[precision]
    line = F.trim(F.col(column))
    rows = df.where((line != "") & ~line.startswith("#"))
    split_on = lambda c, sep: F.split(c, rf"(?<!\\){sep}")
    plain = lambda c: F.regexp_replace(c, r"\\([ ,=])", "$1")
    parts = F.split(line, r'(?<!\\) (?=(?:[^"]*"[^"]*")*[^"]*$)')
    head = split_on(F.get(parts, F.lit(0)), ",")
    pair = lambda kv: F.struct(plain(F.get(split_on(kv, "="), F.lit(0))).alias("key"), plain(F.get(F.split(kv, r"(?<!\\)=", 2), F.lit(1))).alias("value"))
    fields = F.split(F.get(parts, F.lit(1)), r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    value = lambda v: F.regexp_replace(F.regexp_replace(v, r'^"(.*)"$', "$1"), r"^(-?\d+)[iu]$", "$1")
    stamp = F.get(parts, F.lit(2)).try_cast("bigint")
    return rows.select(
        plain(F.get(head, F.lit(0))).alias("measurement"), F.map_from_entries(F.transform(F.slice(head, 2, F.size(head)), pair)).alias("tags"),
        F.transform_values(F.map_from_entries(F.transform(fields, pair)), lambda k, v: value(v)).alias("fields"), F.timestamp_micros((stamp / unit).cast("bigint")).alias("ts"),
    )


def opentsdb_points(df: DataFrame, column: str = "value") -> DataFrame:
    """metric, ts, value, tags of OpenTSDB JSON points; times above 10 digits are milliseconds."""
    p = F.from_json(F.col(column), "metric string, timestamp bigint, value double, tags map<string,string>")
    rows = df.select(p.alias("p")).where("p.metric is not null")
    us = F.when(F.col("p.timestamp") > 9_999_999_999, F.col("p.timestamp") * 1000).otherwise(F.col("p.timestamp") * 1_000_000)
    return rows.select("p.metric", F.timestamp_micros(us).alias("ts"), "p.value", "p.tags")


def loki_streams(df: DataFrame, column: str = "value") -> DataFrame:
    """labels, ts, line of a Loki push request."""
    schema = "streams array<struct<stream:map<string,string>,values:array<array<string>>>>"
    s = df.select(F.explode(F.from_json(F.col(column), schema)["streams"]).alias("s")).select("s.stream", F.explode("s.values").alias("v"))
    return s.select(F.col("stream").alias("labels"), F.timestamp_micros((F.get("v", F.lit(0)).cast("decimal(20,0)") / 1000).cast("bigint")).alias("ts"), F.get("v", F.lit(1)).alias("line"))


def elasticsearch_bulk(df: DataFrame, column: str = "value", order: str = "n", request: str | None = None) -> DataFrame:
    """index and document of bulk lines: an action line, then its document; ``delete`` actions have none.

    ``order`` numbers the lines of a request from 0; ``request`` names the column that
    tells requests apart, without it all lines are one request. A line that holds
    nothing but a delete action is one, wherever it stands.
    """
    from pyspark.sql import Window

    index = F.coalesce(F.get_json_object(column, "$.create._index"), F.get_json_object(column, "$.index._index"))
    gone = F.get_json_object(column, "$.delete").startswith("{") & (F.json_object_keys(column) == F.array(F.lit("delete")))
    w = Window.partitionBy(F.col(request) if request else F.lit(1)).orderBy(order)
    # without the delete actions, actions and documents take turns
    rows = df.withColumn("_gone", F.coalesce(gone, F.lit(False))).where("not _gone")
    rows = rows.withColumn("index", F.lag(index).over(w)).withColumn("_place", F.row_number().over(w))
    return rows.where("_place % 2 = 0").select("index", F.col(column).alias("document"))


def remote_write(series: DataFrame) -> DataFrame:
    """labels (map with __name__) and samples (array of ts_ms, value) to metric, labels, ts, value."""
    rows = series.select("labels", F.explode("samples").alias("s"))
    return rows.select(F.col("labels")["__name__"].alias("metric"), F.map_filter("labels", lambda k, _: k != "__name__").alias("labels"), F.timestamp_millis("s.ts_ms").alias("ts"), F.col("s.value").alias("value"))
