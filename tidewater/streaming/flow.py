"""Continuous aggregation: flows that keep a sink table up to date.

In batching mode a run finds the time windows touched by new rows, computes them
again from the source and replaces them in the sink. In streaming mode a flow is
a Structured Streaming query with a watermark and state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumble(ts: Column | str, size: str) -> Column:
    return F.window(ts, size)


def tumble_start(ts: Column | str, size: str) -> Column:
    return F.window(ts, size)["start"]


def tumble_end(ts: Column | str, size: str) -> Column:
    return F.window(ts, size)["end"]


@dataclass
class Flow:
    """source: a reader of the whole source; window: size of a time window in seconds; keys: columns of the sink's key.

    plan turns rows of whole windows into sink rows, which carry the window's
    start in ``window_col``. expire_after (seconds before the newest row) leaves
    old windows alone.
    """

    name: str
    sink: str
    plan: Callable[[DataFrame], DataFrame]
    time_index: str
    window_seconds: int
    window_col: str = "window_start"
    keys: list[str] = field(default_factory=list)
    sequence: str | None = None
    expire_after: int | None = None
    comment: str = ""


class FlowManager:
    """Creates, runs and drops flows over Parquet tables under one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.flows = spark, folder.rstrip("/"), {}
        self.marks: dict[str, int] = {}  # the greatest sequence seen; kept in the folder too, for the next manager

    def create(self, flow: Flow, replace: bool = False) -> None:
        if flow.name in self.flows and not replace:
            raise ValueError(f"flow {flow.name} exists")
        if replace:  # another plan: all windows are made again
            self.marks.pop(flow.name, None)
            self._mark(flow.name, None)
        self.flows[flow.name] = flow

    def drop(self, name: str) -> None:
        del self.flows[name]
        self.marks.pop(name, None)
        self._mark(name, None)

    def show(self) -> DataFrame:
        return self.spark.createDataFrame([(f.name, f.sink, f.comment) for f in self.flows.values()], "flow_name string, sink string, comment string")

    def _bin(self, flow: Flow) -> Column:
        s = F.unix_seconds(F.col(flow.time_index).cast("timestamp"))
        return F.timestamp_seconds(s - F.pmod(s, F.lit(flow.window_seconds)))

    def flush(self, name: str, source: DataFrame, now_partition: str | None = None) -> DataFrame:
        """Brings the sink up to date with the source and returns it. Sink files are split by day of the window, and only touched days are written."""
        flow = self.flows[name]
        rows = source.withColumn("_w", self._bin(flow))
        fresh = rows
        if flow.sequence and name not in self.marks and (held := self._held(name)) is not None:
            self.marks[name] = held
        if flow.sequence and name in self.marks:
            fresh = rows.where(F.col(flow.sequence) > self.marks[name])
        top = source.agg(F.max(flow.time_index).alias("t"), *([F.max(flow.sequence).alias("s")] if flow.sequence else [])).first()
        if top is None or top["t"] is None:
            return self.sink(name)
        dirty = fresh.select("_w").distinct()
        if flow.expire_after is not None:
            dirty = dirty.where(F.col("_w") >= F.lit(top["t"]) - F.make_dt_interval(secs=F.lit(float(flow.expire_after))))
        days = dirty.select(F.to_date("_w").alias("day")).distinct()
        whole = rows.withColumn("day", F.to_date("_w")).join(days, "day", "left_semi").drop("_w", "day")
        made = flow.plan(whole).withColumn("day", F.to_date(flow.window_col))
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{self.folder}/{flow.sink}")
        if flow.sequence:
            self.marks[name] = top["s"]
            self._mark(name, top["s"])
        return self.sink(name)

    def _mark(self, name: str, value: int | None) -> None:
        """Written after the sink: a run that dies between the two is repeated, with the same windows."""
        rows = self.spark.range(1).select(F.lit(value).cast("long").alias("mark"))
        rows.write.mode("overwrite").parquet(f"{self.folder}/_marks_{name}")

    def _held(self, name: str) -> int | None:
        try:
            return self.spark.read.schema("mark long").parquet(f"{self.folder}/_marks_{name}").agg(F.max("mark")).first()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def sink(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self.flows[name].sink}").drop("day")

    def stream(self, name: str, source: DataFrame, aggregate: Callable[[DataFrame], DataFrame], checkpoint: str, late: str = "0 seconds", mode: str = "append", table: str | None = None) -> StreamingQuery:
        """Starts a streaming flow over a stream; ``aggregate`` gets it with its watermark. Rows go to a memory table, or with mode append to the sink's files."""
        flow = self.flows[name]
        out = aggregate(source.withWatermark(flow.time_index, late)).writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        if table:
            return out.format("memory").queryName(table).start()
        return out.format("parquet").option("path", f"{self.folder}/{flow.sink}").start()
