"""Log queries given as a nested dictionary."""

from __future__ import annotations

import re
from calendar import monthrange
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class LogQueryError(ValueError):
    """The request is not valid."""


def canonical_time(spec: dict) -> tuple[datetime, datetime]:
    """[start, end) of a time filter. A start alone covers its day, month or year; a span is whole seconds."""
    start, end, span = spec.get("start"), spec.get("end"), spec.get("span")
    if start is None and end is None:
        raise LogQueryError("a time filter needs a start or an end")

    def point(text: str) -> datetime:
        for fmt, size in (("%Y-%m-%d", 10), ("%Y-%m", 7), ("%Y", 4)):
            if len(text) == size:
                return datetime.strptime(text, fmt)
        return datetime.fromisoformat(text.replace("Z", "+00:00")).replace(tzinfo=None)

    seconds = None
    if span is not None:
        if not re.fullmatch(r"\d+", str(span)):
            raise LogQueryError("span is a whole number of seconds")
        seconds = timedelta(seconds=int(span))
    if start is not None and end is not None:
        a, b = point(start), point(end)
    elif start is not None and seconds is not None:
        a = point(start)
        b = a + seconds
    elif end is not None and seconds is not None:
        b = point(end)
        a = b - seconds
    elif start is not None:
        a = point(start)
        days = {10: 1, 7: monthrange(a.year, a.month)[1] if len(start) == 7 else 0, 4: (datetime(a.year + 1, 1, 1) - a).days if len(start) == 4 else 0}.get(len(start))
        if days is None:
            raise LogQueryError("a time without an end needs a span")
        b = a + timedelta(days=days)
    else:
        raise LogQueryError("an end needs a start or a span")
    if b <= a:
        raise LogQueryError("the end must be after the start")
    return a, b


def content_filter(col: Column, spec) -> Column:
    """One content filter: {"Contains": "x"}, {"Between": {...}}, "Exist", {"Compound": [[...], "And"]}, ..."""
    if isinstance(spec, str):
        return {"Exist": lambda: col.isNotNull(), "IsTrue": lambda: col.cast("boolean"), "IsFalse": lambda: ~col.cast("boolean")}[spec]()
    ((kind, arg),) = spec.items()
    if kind == "Compound":
        parts, op = arg
        return reduce((lambda a, b: a & b) if op == "And" else (lambda a, b: a | b), [content_filter(col, p) for p in parts])
    if kind == "Between":
        low = col >= arg["start"] if arg.get("start_inclusive", True) else col > arg["start"]
        high = col <= arg["end"] if arg.get("end_inclusive", True) else col < arg["end"]
        return low & high
    if kind == "GreatThan":
        return col >= arg["value"] if arg.get("inclusive") else col > arg["value"]
    if kind == "LessThan":
        return col <= arg["value"] if arg.get("inclusive") else col < arg["value"]
    return {
        "Exact": lambda: col == arg, "Prefix": lambda: col.startswith(arg), "Postfix": lambda: col.endswith(arg), "Contains": lambda: col.contains(arg), "Regex": lambda: col.rlike(arg),
        "In": lambda: col.isin(arg), "Equal": lambda: col == arg,
    }[kind]()


def filter_column(spec: dict) -> Column:
    """A tree of {"And": [...]}, {"Or": [...]}, {"Not": ...}, {"Single": {"column", "filters"}}."""
    ((kind, arg),) = spec.items()
    if kind == "Not":
        return ~filter_column(arg)
    if kind in ("And", "Or"):
        return reduce((lambda a, b: a & b) if kind == "And" else (lambda a, b: a | b), [filter_column(a) for a in arg])
    col = F.col(arg["column"])
    return reduce(lambda a, b: a & b, [content_filter(col, f) for f in arg["filters"]])


def with_context(df: DataFrame, hit: Column, time_index: str, context: dict, by: list[str]) -> DataFrame:
    """Rows around hits: {"Lines": [before, after]} or {"Seconds": [before, after]}, within series ``by``."""
    ((kind, (before, after)),) = context.items()
    base = Window.partitionBy(*[F.col(c) for c in by]) if by else Window.partitionBy(F.lit(1))
    if kind == "Lines":
        w = base.orderBy(time_index).rowsBetween(-after, before)
    else:
        w = base.orderBy(F.unix_seconds(time_index)).rangeBetween(-after, before)
    return df.withColumn("_near", F.max(F.coalesce(hit, F.lit(False))).over(w)).where("_near").drop("_near")


def _expr(node) -> Column:
    if isinstance(node, str):
        return F.col(node)
    if not isinstance(node, dict):
        return F.lit(node)
    ((kind, arg),) = node.items()
    if kind == "Literal":
        return F.lit(arg)
    if kind == "ScalarFunc":
        col = F.call_function(arg["name"], *[_expr(a) for a in arg["args"]])
        return col.alias(arg["alias"]) if arg.get("alias") else col
    if kind == "BinaryOp":
        a, b = _expr(arg["left"]), _expr(arg["right"])
        return {"+": a + b, "-": a - b, "*": a * b, "/": a / b, "=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "And": a & b, "Or": a | b}[arg["op"]]
    if kind == "Alias":
        return _expr(arg["expr"]).alias(arg["alias"])
    raise LogQueryError(f"unknown expression {kind}")


def log_query(df: DataFrame, spec: dict, time_index: str = "ts") -> DataFrame:
    """Runs a request: time_filter, filters, context, columns, exprs, limit."""
    if spec.get("time_filter"):
        a, b = canonical_time(spec["time_filter"])
        df = df.where((F.col(time_index) >= F.lit(a)) & (F.col(time_index) < F.lit(b)))
    if spec.get("filters"):
        hit = filter_column(spec["filters"])
        df = with_context(df, hit, time_index, spec["context"], spec.get("context_by", [])) if spec.get("context") else df.where(hit)
    if spec.get("columns"):
        df = df.select(*spec["columns"])
    for node in spec.get("exprs", []):
        ((kind, arg),) = node.items()
        if kind == "AggrFunc":
            aggs = [F.call_function(f["name"], *[_expr(a) for a in f["args"]]).alias(f.get("alias", f["name"])) for f in arg["expr"]]
            df = df.groupBy(*[_expr(b) for b in arg.get("by", [])]).agg(*aggs)
        elif kind == "Filter":
            df = df.where(filter_column(arg) if set(arg) & {"And", "Or", "Not", "Single"} else _expr(arg))
        elif kind == "Decompose":
            schema = ", ".join(f"`{k}` {t}" for k, t in arg["schema"])
            df = df.withColumn("_d", F.from_json(arg["expr"], schema)).select("*", "_d.*").drop("_d")
        else:
            made = _expr(node)
            name = arg.get("alias")
            df = df.withColumn(name, made) if name else df.select("*", made)
    limit = spec.get("limit") or {}
    if limit.get("skip") or limit.get("fetch") is not None:
        df = df.orderBy(F.col(time_index).asc_nulls_last() if time_index in df.columns else F.lit(1))
        df = df.offset(limit["skip"]) if limit.get("skip") else df
        df = df.limit(limit["fetch"]) if limit.get("fetch") is not None else df
    return df
