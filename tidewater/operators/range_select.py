"""RANGE queries: aggregates over aligned, possibly overlapping slots, with filling.

A slot t covers rows with t <= ts < t + range. Rows go to slots by arithmetic on
their timestamps; items of different ranges share one pass, each looking only at
the rows inside its own range.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT_US = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000, "y": 31_557_600_000_000}


class RangeError(ValueError):
    """The RANGE query is not valid."""


def duration_us(text: str) -> int:
    parts = re.findall(r"(\d+)(us|ms|[smhdwy])", text.strip())
    if not parts or "".join(a + b for a, b in parts) != text.strip():
        raise RangeError(f"not a valid duration string: {text!r}")
    total = sum(int(n) * UNIT_US[u] for n, u in parts)
    if total <= 0:
        raise RangeError("duration must be positive")
    return total


@dataclass
class Item:
    """One RANGE item. agg: sum, avg, min, max, count, count_distinct, first_value, last_value, stddev, var, median; fill: None, NULL, PREV, LINEAR or a constant."""

    agg: str
    value: str | Column
    range: str
    name: str
    fill: object = None
    order_by: str | None = None


AGGREGATES = {
    "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "count_distinct": F.count_distinct, "stddev": F.stddev_pop, "stddev_samp": F.stddev_samp, "stddev_pop": F.stddev_pop,
    "var": F.var_pop, "var_samp": F.var_samp, "var_pop": F.var_pop, "median": F.median, "approx_distinct": F.approx_count_distinct,
}


def range_select(df: DataFrame, time_index: str, items: list[Item], align: str, by: list[str] | None = None, to: int | str = "CALENDAR", fill: object = None, now_us: int | None = None) -> DataFrame:
    """by columns, the slot's start under the time index's name, and the items; rows without a time are left out."""
    if not items:
        raise RangeError("a RANGE query needs a RANGE item")
    step, by = duration_us(align), list(by or [])
    if isinstance(to, str):
        if to.upper() not in ("CALENDAR", "NOW"):
            raise RangeError("TO accepts NOW, CALENDAR or a timestamp")
        if to.upper() == "NOW" and now_us is None:
            raise RangeError("TO NOW needs now_us")
        to = 0 if to.upper() == "CALENDAR" else now_us
    phase = to % step
    spans = [duration_us(i.range) for i in items]
    longest, us = max(spans), F.unix_micros(F.col(time_index).cast("timestamp"))
    rows = df.where(F.col(time_index).isNotNull()).withColumn("_us", us)
    past = F.col("_us") - phase
    last = ((past - F.pmod(past, F.lit(step))) / step).cast("long")
    values = {i.name: F.col(i.value) if isinstance(i.value, str) else i.value for i in items}
    if longest > step and (panes := _panes(rows, by, items, values, spans, step, phase)) is not None:
        rows, values = panes
    if longest <= step:  # a row has one slot at most
        slotted = rows.withColumn("_slot", last * step + phase)
    else:
        back = -(-longest // step)
        slotted = rows.withColumn("_slot", F.explode(F.sequence((last - back + 1) * step + phase, last * step + phase, F.lit(step).cast("long"))))
    slotted = slotted.where(F.col("_us") < F.col("_slot") + longest)
    aggs = []
    for item, span in zip(items, spans):
        value = values[item.name]
        inside = F.lit(True) if span == longest else F.col("_us") < F.col("_slot") + span
        if item.agg in ("first_value", "last_value"):
            key = F.struct(F.col(item.order_by) if item.order_by else F.col("_us"), F.col("_us"))
            made = (F.min_by if item.agg == "first_value" else F.max_by)(value, F.when(inside, key))
        elif isinstance(value, Pane):
            made = value.whole(inside)
        elif item.agg in AGGREGATES:
            made = AGGREGATES[item.agg](F.when(inside, value))
        else:
            raise RangeError(f"unknown aggregate {item.agg}")
        aggs.append(made.alias(item.name))
    out = slotted.groupBy(*by, "_slot").agg(*aggs)
    fills = [i.fill if i.fill is not None else fill for i in items]
    if any(f is not None for f in fills):
        out = _filled(out, by, items, fills, step)
    return out.select(*by, F.timestamp_micros("_slot").alias(time_index), *[i.name for i in items])


@dataclass
class Pane:
    """An item's partial aggregate over a pane, and what a slot makes of the panes inside it."""

    parts: list[Column]
    whole: Callable[[Column], Column]


def _pane(item: Item, value: Column, kind: T.DataType, at: str) -> Pane | None:
    """None where the item has no exact partial aggregate of bounded size."""
    a, n = f"_a_{at}", f"_n_{at}"
    if item.agg == "count":
        return Pane([F.count(value).alias(a)], lambda inside: F.coalesce(F.sum(F.when(inside, F.col(a))), F.lit(0).cast("long")))
    if item.agg in ("min", "max"):
        best = F.min if item.agg == "min" else F.max
        return Pane([best(value).alias(a)], lambda inside: best(F.when(inside, F.col(a))))
    if item.agg == "sum" and isinstance(kind, (T.IntegralType, T.FractionalType)) and not isinstance(kind, T.DecimalType):
        return Pane([F.sum(value).alias(a)], lambda inside: F.sum(F.when(inside, F.col(a))))
    if item.agg == "avg" and isinstance(kind, (T.IntegralType, T.FractionalType)) and not isinstance(kind, T.DecimalType):
        parts = [F.sum(value.cast("double")).alias(a), F.count(value).alias(n)]
        return Pane(parts, lambda inside: F.sum(F.when(inside, F.col(a))) / F.nullif(F.sum(F.when(inside, F.col(n))), F.lit(0)))
    return None


def _panes(rows: DataFrame, by: list[str], items: list[Item], values: dict, spans: list[int], step: int, phase: int) -> tuple[DataFrame, dict] | None:
    """Rows aggregated by pane, where every item can be put together from panes.

    Slots and ranges are made of whole panes, as long as the greatest common divisor
    of the step and the ranges; a pane stands at its first microsecond. So panes are
    repeated for the slots that overlap, not rows.
    """
    types = rows.select(*[values[i.name].alias(i.name) for i in items]).schema
    made = {i.name: _pane(i, values[i.name], types[k].dataType, str(k)) for k, i in enumerate(items)}
    if any(pane is None for pane in made.values()):
        return None
    width = math.gcd(step, *spans)
    at = F.col("_us") - F.pmod(F.col("_us") - phase, F.lit(width))
    return rows.groupBy(*by, at.alias("_pane")).agg(*[c for pane in made.values() for c in pane.parts]).withColumnRenamed("_pane", "_us"), made


#: Slots of one array at most when a gap is filled; longer gaps take several.
BLOCK = 1024


def _filled(out: DataFrame, by: list[str], items: list[Item], fills: list, step: int) -> DataFrame:
    """Missing slots between a group's first and last one are made and filled.

    A slot that exists knows the next one and the points that fill the gap between
    them, so only slots that exist are sorted; the others are made from them in place.
    """
    slot = F.col("_slot")
    order = Window.partitionBy(*by).orderBy("_slot")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the next point is the last one seen from the other end: a frame that only grows, so linear in the slots
    after = Window.partitionBy(*by).orderBy(slot.desc()).rowsBetween(Window.unboundedPreceding, -1)
    known = {"_end": F.coalesce(F.lead("_slot").over(order) - step, slot)}
    later, made = {}, {}
    for i, (item, fill) in enumerate(zip(items, fills)):
        v, kind = F.col(item.name), fill.upper() if isinstance(fill, str) else fill
        here = F.col("_at") == slot  # the slot that existed
        if kind is None or kind == "NULL":
            made[item.name] = F.when(here, v)
        elif kind == "PREV":
            known[f"_p{i}"] = F.last(v, ignorenulls=True).over(before)
            made[item.name] = F.col(f"_p{i}")
        elif kind == "LINEAR":
            point = F.when(v.isNotNull(), F.struct(slot.alias("s"), v.cast("double").alias("v")))
            known[f"_p{i}"], later[f"_n{i}"] = F.last(point, ignorenulls=True).over(before), F.last(point, ignorenulls=True).over(after)
            lo, hi = F.col(f"_p{i}"), F.col(f"_n{i}")
            line = lo["v"] + (hi["v"] - lo["v"]) * (F.col("_at") - lo["s"]) / (hi["s"] - lo["s"])
            made[item.name] = F.coalesce(F.when(here, v.cast("double")), line)
        elif isinstance(fill, str):
            raise RangeError(f"unknown FILL {fill!r}")
        else:
            made[item.name] = F.coalesce(F.when(here, v), F.lit(fill).cast(out.schema[item.name].dataType))
    df = out.withColumns(known).withColumns(later) if later else out.withColumns(known)
    block = F.explode(F.sequence(slot, F.col("_end"), F.lit(BLOCK * step))).alias("_from")
    df = df.select("*", block)
    df = df.select("*", F.explode(F.sequence("_from", F.least(F.col("_from") + (BLOCK - 1) * step, F.col("_end")), F.lit(step))).alias("_at"))
    return df.select(*by, F.col("_at").alias("_slot"), *[made[i.name].alias(i.name) for i in items])
