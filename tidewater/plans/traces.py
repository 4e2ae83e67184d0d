"""Trace queries over a span table: service_name, span_name, span_kind, trace_id, span_id, ts, duration_ns, attributes (map)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def services(spans: DataFrame) -> DataFrame:
    return spans.select("service_name").distinct()


def operations(spans: DataFrame, service: str, kind: str | None = None) -> DataFrame:
    hit = F.col("service_name") == service
    return spans.where(hit & (F.col("span_kind") == kind) if kind else hit).select("span_name", "span_kind").distinct()


def get_trace(spans: DataFrame, trace_id: str, start=None, end=None) -> DataFrame:
    df = spans.where(F.col("trace_id") == trace_id)
    df = df.where(F.col("ts") >= F.lit(start)) if start is not None else df
    return df.where(F.col("ts") <= F.lit(end)) if end is not None else df


def find_traces(spans: DataFrame, service: str, operation: str | None = None, tags: dict | None = None, min_ns: int | None = None, max_ns: int | None = None, limit: int = 100, spans_each: int | None = 3) -> DataFrame:
    """Spans of the newest traces with a matching span; the earliest ``spans_each`` of each trace, or all."""
    hit = F.col("service_name") == service
    if operation:
        hit = hit & (F.col("span_name") == operation)
    for k, v in (tags or {}).items():
        hit = hit & (F.col("attributes")[k] == v)
    if min_ns is not None:
        hit = hit & (F.col("duration_ns") >= min_ns)
    if max_ns is not None:
        hit = hit & (F.col("duration_ns") <= max_ns)
    newest = spans.where(hit).groupBy("trace_id").agg(F.max("ts").alias("_t")).orderBy(F.col("_t").desc(), "trace_id").limit(limit).select("trace_id")
    found = spans.join(newest, "trace_id", "left_semi")
    if spans_each is None:
        return found
    w = Window.partitionBy("trace_id").orderBy("ts", "span_id")
    return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= spans_each).drop("_n")
