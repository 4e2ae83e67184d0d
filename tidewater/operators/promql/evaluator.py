"""PromQL evaluation on a grid of times, as DataFrame plans.

A vector is a DataFrame of its label columns, the grid time ``_t`` in
milliseconds and the value ``_v``. Samples reach the grid by arithmetic on their
timestamps, never by a join with the grid:

* an instant selector keeps the last sample of every grid cell (a partial
  aggregate), finds the next cell that has one, and repeats the sample up to
  there or to the end of the lookback;
* a range function gives each sample, with the one before it, to the grid times
  whose window holds it and another one and aggregates natively, so that windows
  are never gathered into arrays, but for Holt's smoothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators.promql.parser import Aggregate, Binary, Call, Number, PromQLError, Selector, Subquery, Text, Unary, parse
from tidewater.plans.tables import TimeSeriesTable

NAN = float("nan")
COMPARE = {"==", "!=", "<", "<=", ">", ">="}


@dataclass
class Grid:
    start: int
    end: int
    step: int
    lookback: int

    @property
    def points(self) -> int:
        return (self.end - self.start) // self.step + 1 if self.end >= self.start else 0


@dataclass
class Vector:
    df: DataFrame
    labels: list[str]


@dataclass
class Scalar:
    """A number for every grid time: a column over ``_t``, or with ``df`` a table (_t, _v)."""

    column: Column
    value: float | None = None
    df: DataFrame | None = None


def ms(ts: str) -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


def divide(a: Column, b: Column) -> Column:
    zero = b == 0
    return F.when(zero & (F.isnan(a) | (a == 0)), F.lit(NAN)).when(zero, F.when((a > 0), F.lit(math.inf)).otherwise(F.lit(-math.inf))).otherwise(a / F.when(~zero, b))


def modulo(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(NAN)).otherwise(a % F.when(b != 0, b))


ARITHMETIC = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide, "%": modulo, "^": lambda a, b: F.pow(a, b), "atan2": lambda a, b: F.atan2(a, b),
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def not_nan(v: Column) -> Column:
    return F.when(~F.isnan(v), v)


def log_of(f):
    return lambda v: F.when(v < 0, F.lit(NAN)).when(v == 0, F.lit(-math.inf)).otherwise(f(F.when(v > 0, v)))


MATH = {
    "abs": F.abs, "ceil": lambda v: F.when(F.abs(v) < 2**53, F.ceil(v).cast("double")).otherwise(v), "floor": lambda v: F.when(F.abs(v) < 2**53, F.floor(v).cast("double")).otherwise(v),
    "exp": F.exp, "ln": log_of(F.log), "log2": log_of(F.log2), "log10": log_of(F.log10), "sqrt": lambda v: F.when(v < 0, F.lit(NAN)).otherwise(F.sqrt(v)),
    "sgn": F.signum, "deg": F.degrees, "rad": F.radians, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh,
}


def clock(v: Column) -> Column:
    return F.timestamp_seconds(v)


DATES = {
    "minute": lambda v: F.minute(clock(v)), "hour": lambda v: F.hour(clock(v)), "day_of_week": lambda v: F.dayofweek(clock(v)) - 1, "day_of_month": lambda v: F.dayofmonth(clock(v)),
    "day_of_year": lambda v: F.dayofyear(clock(v)), "days_in_month": lambda v: F.dayofmonth(F.last_day(clock(v))), "month": lambda v: F.month(clock(v)), "year": lambda v: F.year(clock(v)),
}
RANGE_FUNCTIONS = {
    "rate", "increase", "delta", "irate", "idelta", "avg_over_time", "min_over_time", "max_over_time", "sum_over_time", "count_over_time", "last_over_time", "first_over_time", "present_over_time",
    "absent_over_time", "stdvar_over_time", "stddev_over_time", "quantile_over_time", "changes", "resets", "deriv", "predict_linear", "double_exponential_smoothing", "holt_winters", "mad_over_time",
}

#: Functions whose windows are put together from panes: what a pane holds, and what a window makes of its panes.
PANES = {
    "sum_over_time": lambda: ([F.sum("v").alias("a")], F.sum("a")),
    "count_over_time": lambda: ([F.count("v").alias("a")], F.sum("a").cast("double")),
    "avg_over_time": lambda: ([F.sum("v").alias("a"), F.count("v").alias("n")], F.sum("a") / F.nullif(F.sum("n"), F.lit(0))),
    "min_over_time": lambda: ([F.min(not_nan(F.col("v"))).alias("a")], F.coalesce(F.min("a"), F.lit(NAN))),
    "max_over_time": lambda: ([F.max(not_nan(F.col("v"))).alias("a")], F.coalesce(F.max("a"), F.lit(NAN))),
    "first_over_time": lambda: ([F.min_by("v", "us").alias("a"), F.min("us").alias("at")], F.min_by("a", "at")),
    "last_over_time": lambda: ([F.max_by("v", "us").alias("a"), F.max("us").alias("at")], F.max_by("a", "at")),
    "present_over_time": lambda: ([F.lit(1.0).alias("a")], F.max("a")),
}


class PromQL:
    """Evaluates queries over named time-series tables."""

    def __init__(self, spark: SparkSession, tables: dict[str, TimeSeriesTable], lookback_ms: int = 300_000):
        self.spark, self.tables, self.lookback = spark, tables, lookback_ms

    def query_range(self, query: str, start: float, end: float, step: float, lookback_ms: int | None = None) -> DataFrame:
        """Labels, ts (timestamp) and value; times are seconds."""
        if step <= 0:
            raise PromQLError("step must be positive")
        grid = Grid(round(start * 1000), round(end * 1000), round(step * 1000), lookback_ms or self.lookback)
        tree = parse(query)
        out = self.eval(tree, grid)
        if isinstance(out, Scalar):
            out = Vector(self.scalar_table(out, grid), [])
        ordered = isinstance(tree, Call) and tree.name.startswith("sort")
        df = out.df.select(*[F.col(f"`{c}`") for c in out.labels], F.timestamp_millis("_t").alias("ts"), F.col("_v").alias("value"), *(["_rank"] if ordered else []))
        if ordered:
            df = df.orderBy("ts", "_rank").drop("_rank")
        return df

    def query(self, query: str, at: float) -> DataFrame:
        return self.query_range(query, at, at, 1)

    def label_values(self, metric: str, label: str, start: float | None = None, end: float | None = None) -> DataFrame:
        table = self.tables[metric]
        df = table.read()
        if start is not None:
            df = df.where(F.col(table.time_index) >= F.timestamp_seconds(F.lit(start)))
        if end is not None:
            df = df.where(F.col(table.time_index) <= F.timestamp_seconds(F.lit(end)))
        return df.select(F.col(label).cast("string").alias(label)).where(F.col(label).isNotNull()).distinct()

    # sources

    def grid_table(self, grid: Grid) -> DataFrame:
        return self.spark.range(grid.points).select((F.col("id") * grid.step + grid.start).alias("_t"))

    def scalar_table(self, s: Scalar, grid: Grid) -> DataFrame:
        return s.df if s.df is not None else self.grid_table(grid).select("_t", s.column.cast("double").alias("_v"))

    def samples(self, node: Selector, low: int, high: int) -> Vector:
        """(labels, ts, us, v) with low < ts <= high, times after the offset; filters reach the scan. Of equal milliseconds us has the order."""
        table = self.tables.get(node.name)
        if table is None:
            return Vector(self.spark.createDataFrame([], "ts long, us long, v double"), [])
        fields, matchers = table.fields, []
        for label, op, value in node.matchers:
            if label == "__field__":
                fields = [f for f in fields if {"=": f == value, "!=": f != value}.get(op, False)]
            elif label not in ("__schema__", "__database__"):
                matchers.append((label, op, value))
        if len(fields) != 1:
            raise PromQLError(f"{node.name} has fields {table.fields}; choose one by __field__")
        df = table.read()
        for label, op, value in matchers:
            known = label in table.tags
            col = F.coalesce(F.col(label).cast("string"), F.lit("")) if known else F.lit("")
            if op in ("=", "!="):
                plain = F.col(label) == value if known and value and op == "=" else (col == value if op == "=" else col != value)
                df = df.where(plain)
            else:
                hit = col.rlike(f"^(?:{value})$")
                df = df.where(hit if op == "=~" else ~hit)
        t, off = F.col(table.time_index), node.offset_ms
        df = df.where((t > F.timestamp_millis(F.lit(low - off - 1))) & (t < F.timestamp_millis(F.lit(high - off + 1))))
        labels = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in table.tags]
        df = df.select(*labels, (ms(table.time_index) + off).alias("ts"), F.unix_micros(t.cast("timestamp")).alias("us"), F.col(fields[0]).cast("double").alias("v"))
        return Vector(df.where((F.col("ts") > low) & (F.col("ts") <= high) & F.col("v").isNotNull()), list(table.tags))

    def instant(self, node: Selector, grid: Grid) -> Vector:
        if node.at is not None:
            return self.pinned(node, grid)
        src = self.samples(node, grid.start - grid.lookback, grid.end)
        cell = F.greatest(F.lit(0), F.ceil((F.col("ts") - grid.start) / grid.step)).cast("long")
        last = src.df.groupBy(*src.labels, cell.alias("k")).agg(F.max_by("v", "us").alias("_v"), F.max("ts").alias("ts"))
        after = F.lead("k").over(Window.partitionBy(*src.labels).orderBy("k")) if src.labels else F.lead("k").over(Window.partitionBy(F.lit(1)).orderBy("k"))
        until = F.floor((F.col("ts") + grid.lookback - 1 - grid.start) / grid.step).cast("long")
        until = F.least(until, F.coalesce(after - 1, F.lit(grid.points - 1)), F.lit(grid.points - 1))
        spread = last.withColumn("_to", until).where("_to >= k")
        return Vector(spread.select(*src.labels, F.explode(F.sequence(F.col("k") * grid.step + grid.start, F.col("_to") * grid.step + grid.start, F.lit(grid.step).cast("long"))).alias("_t"), "_v"), src.labels)

    def pinned(self, node, grid: Grid) -> Vector:
        at = {"start": grid.start, "end": grid.end}.get(node.at, None) if isinstance(node.at, str) else round(node.at * 1000)
        one = self.eval(replace(node, at=None), Grid(at, at, grid.step, grid.lookback))
        return Vector(one.df.drop("_t").crossJoin(F.broadcast(self.grid_table(grid))), one.labels)

    def windows(self, node, grid: Grid) -> tuple[Vector, Vector, int]:
        """Samples of a range: (labels, _t, ts, us, v, p, pt), p and pt being the sample before.

        First come the windows of two samples or more, then those of one (labels, _t, v),
        which need no aggregation: it would hold a group for each of them.
        """
        src, span = self.ranged(node, grid), node.range_ms
        w = Window.partitionBy(*src.labels).orderBy("us") if src.labels else Window.partitionBy(F.lit(1)).orderBy("us")
        lined = src.df.select(*src.labels, "ts", "us", "v", F.lag("v").over(w).alias("p"), F.lag("ts").over(w).alias("pt"), F.lead("ts").over(w).alias("nt"))
        first = lambda t: F.ceil((t - grid.start) / grid.step).cast("long")
        last = lambda t: F.floor((t + span - 1 - grid.start) / grid.step).cast("long")
        # windows _lo to _before hold the sample before too, _after to _hi the one after
        lined = lined.withColumns({"_lo": F.greatest(F.lit(0).cast("long"), first(F.col("ts"))), "_hi": F.least(F.lit(grid.points - 1).cast("long"), last(F.col("ts")))}).where("_hi >= _lo")
        before = F.when(F.col("pt").isNull(), F.col("_lo") - 1).otherwise(F.least(last(F.col("pt")), F.col("_hi")))
        after = F.when(F.col("nt").isNull(), F.col("_hi") + 1).otherwise(F.greatest(first(F.col("nt")), F.col("_lo")))
        lined = lined.withColumns({"_before": before, "_after": F.greatest(after, before + 1)})
        at = lambda k: k * grid.step + grid.start
        times = lambda a, b: F.when(a <= b, F.sequence(at(a), at(b), F.lit(grid.step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
        lo, hi, before, after = (F.col(c) for c in ("_lo", "_hi", "_before", "_after"))
        many = lined.select(*src.labels, "ts", "us", "v", "p", "pt", F.explode(F.concat(times(lo, before), times(after, hi))).alias("_t"))
        one = lined.select(*src.labels, "v", F.explode(times(F.greatest(lo, before + 1), F.least(hi, after - 1))).alias("_t"))
        return Vector(many, src.labels), Vector(one, src.labels), span

    def panes(self, node, grid: Grid, aggs: list[Column]) -> Vector:
        """Windows of partial aggregates: (labels, _t, aggregates).

        Every window is made of whole panes, as long as the greatest common divisor of
        step and range. Samples are aggregated by pane first, so what is repeated for
        each window is a pane, not a sample.
        """
        src = self.ranged(node, grid)
        width = math.gcd(grid.step, node.range_ms)
        end = (F.ceil((F.col("ts") - grid.start) / width) * width + grid.start).cast("long")
        made = src.df.groupBy(*src.labels, end.alias("_pane")).agg(*aggs).withColumnRenamed("_pane", "ts")
        return Vector(self.spread(made, src.labels, [c for c in made.columns if c not in (*src.labels, "ts")], grid, node.range_ms), src.labels)

    @staticmethod
    def spread(df: DataFrame, labels: list[str], keep: list[str], grid: Grid, span: int) -> DataFrame:
        """Rows at ``ts`` repeated for every window (_t - span, _t] that holds them."""
        low = F.greatest(F.lit(0), F.ceil((F.col("ts") - grid.start) / grid.step)).cast("long")
        high = F.least(F.lit(grid.points - 1), F.floor((F.col("ts") + span - 1 - grid.start) / grid.step)).cast("long")
        held = df.withColumn("_lo", low).withColumn("_hi", high).where("_hi >= _lo")
        return held.select(*labels, *keep, F.explode(F.sequence(F.col("_lo") * grid.step + grid.start, F.col("_hi") * grid.step + grid.start, F.lit(grid.step).cast("long"))).alias("_t"))

    def ranged(self, node, grid: Grid) -> Vector:
        """Samples (labels, ts, us, v) that windows of the grid can hold."""
        if isinstance(node, Subquery):
            step = node.step_ms or grid.step
            low = grid.start - node.range_ms - node.offset_ms
            first = (low // step + 1) * step
            inner = self.eval(node.expr, Grid(first, grid.end - node.offset_ms, step, grid.lookback))
            if isinstance(inner, Scalar):
                inner = Vector(self.scalar_table(inner, Grid(first, grid.end - node.offset_ms, step, grid.lookback)), [])
            src = Vector(inner.df.select(*inner.labels, (F.col("_t") + node.offset_ms).alias("ts"), F.col("_t").alias("us"), F.col("_v").alias("v")), inner.labels)
        elif isinstance(node, Selector) and node.range_ms is not None:
            src = self.samples(node, grid.start - node.range_ms, grid.end)
        else:
            raise PromQLError("expected a range vector")
        return src

    # evaluation

    def eval(self, node, grid: Grid):
        if isinstance(node, Number):
            return Scalar(F.lit(node.value), node.value)
        if isinstance(node, Selector):
            if node.range_ms is not None:
                raise PromQLError("a range vector needs a function")
            return self.instant(node, grid)
        if isinstance(node, Unary):
            inner = self.eval(node.expr, grid)
            if node.op == "+":
                return inner
            if isinstance(inner, Scalar):
                return Scalar(-inner.column, None if inner.value is None else -inner.value, None if inner.df is None else inner.df.withColumn("_v", -F.col("_v")))
            return Vector(inner.df.withColumn("_v", -F.col("_v")), inner.labels)
        if isinstance(node, Binary):
            return self.binary(node, grid)
        if isinstance(node, Aggregate):
            return self.aggregate(node, grid)
        if isinstance(node, Call):
            return self.call(node, grid)
        raise PromQLError(f"cannot evaluate {type(node).__name__}")

    def vector(self, node, grid: Grid) -> Vector:
        out = self.eval(node, grid)
        if not isinstance(out, Vector):
            raise PromQLError("expected an instant vector")
        return out

    def constant(self, node) -> float:
        if isinstance(node, Number):
            return node.value
        if isinstance(node, Unary) and isinstance(node.expr, Number):
            return -node.expr.value if node.op == "-" else node.expr.value
        raise PromQLError("expected a number")

    def aggregate(self, node: Aggregate, grid: Grid) -> Vector:
        src = self.vector(node.expr, grid)
        keep = [c for c in src.labels if c in node.by] if node.by is not None else ([c for c in src.labels if c not in node.without] if node.without is not None else [])
        v = F.col("_v")
        if node.op in ("topk", "bottomk"):
            k = int(self.constant(node.param))
            order = v.desc() if node.op == "topk" else v.asc()
            w = Window.partitionBy(*keep, "_t").orderBy(F.isnan(v), order, *src.labels)
            return Vector(src.df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n"), src.labels)
        if node.op == "count_values":
            if not isinstance(node.param, Text):
                raise PromQLError("count_values needs a label")
            name = node.param.value
            text = F.when(v == F.floor(v), F.format_string("%.0f", v)).otherwise(v.cast("string"))
            df = src.df.withColumn(name, text).groupBy(*[c for c in keep if c != name], name, "_t").agg(F.count(F.lit(1)).cast("double").alias("_v"))
            return Vector(df, [*[c for c in keep if c != name], name])
        if node.op == "quantile":
            q = self.constant(node.param)
            agg = F.lit(NAN) if math.isnan(q) else F.lit(-math.inf) if q < 0 else F.lit(math.inf) if q > 1 else F.percentile(v, F.lit(q))
            return Vector(src.df.groupBy(*keep, "_t").agg(agg.alias("_v")), keep)
        agg = {
            "sum": F.sum(v), "avg": F.avg(v), "count": F.count(v).cast("double"), "stddev": F.stddev_pop(v), "stdvar": F.var_pop(v), "group": F.max(F.lit(1.0)),
            "min": F.coalesce(F.min(not_nan(v)), F.lit(NAN)), "max": F.coalesce(F.max(not_nan(v)), F.lit(NAN)),
        }[node.op]
        return Vector(src.df.groupBy(*keep, "_t").agg(agg.alias("_v")), keep)

    def binary(self, node: Binary, grid: Grid):
        left, right = self.eval(node.left, grid), self.eval(node.right, grid)
        op = ARITHMETIC.get(node.op)
        both_scalar = isinstance(left, Scalar) and isinstance(right, Scalar)
        if node.op in ("and", "or", "unless"):
            if isinstance(left, Scalar) or isinstance(right, Scalar):
                raise PromQLError("set operators need vectors")
            return self.set_op(node, left, right)
        if both_scalar:
            if node.op in COMPARE and not node.is_bool:
                raise PromQLError("comparisons between scalars must use bool")
            if left.df is None and right.df is None:
                return Scalar(op(left.column, right.column).cast("double"))
            df = self.scalar_table(left, grid).join(self.scalar_table(right, grid).withColumnRenamed("_v", "_w"), "_t")
            return Scalar(F.col("_v"), df=df.select("_t", op(F.col("_v"), F.col("_w")).cast("double").alias("_v")))
        if isinstance(left, Scalar) or isinstance(right, Scalar):
            vec, sca, flipped = (right, left, True) if isinstance(left, Scalar) else (left, right, False)
            df, w = vec.df, sca.column.cast("double")
            if sca.df is not None:
                df, w = df.join(F.broadcast(sca.df.withColumnRenamed("_v", "_w")), "_t"), F.col("_w")  # one row a grid time
            v = F.col("_v")
            value = op(w, v) if flipped else op(v, w)
            if node.op in COMPARE:
                df = df.withColumn("_v", value.cast("double")) if node.is_bool else df.where(value)
            else:
                df = df.withColumn("_v", value)
            return Vector(df.select(*vec.labels, "_t", "_v"), vec.labels)
        return self.match(node, left, right, op)

    def keys(self, node: Binary, left: Vector, right: Vector) -> list[str]:
        every = list(dict.fromkeys([*left.labels, *right.labels]))
        if node.on is not None:
            return node.on
        return [c for c in every if c not in (node.ignoring or [])]

    @staticmethod
    def padded(v: Vector, keys: list[str]) -> DataFrame:
        """Labels that a side lacks are empty strings."""
        return v.df.withColumns({k: F.lit("") for k in keys if k not in v.labels})

    def set_op(self, node: Binary, left: Vector, right: Vector) -> Vector:
        keys = self.keys(node, left, right)
        l, r = self.padded(left, keys), self.padded(right, keys)
        if node.op != "or":
            how = "left_semi" if node.op == "and" else "left_anti"
            return Vector(l.join(r.select(*keys, "_t").distinct(), [*keys, "_t"], how).select(*left.labels, "_t", "_v"), left.labels)
        labels = list(dict.fromkeys([*left.labels, *right.labels]))
        extra = r.join(l.select(*keys, "_t").distinct(), [*keys, "_t"], "left_anti")
        every = [self.padded(Vector(d, v.labels), labels).select(*labels, "_t", "_v") for d, v in ((l, left), (extra, right))]
        return Vector(every[0].unionByName(every[1]), labels)

    @staticmethod
    def single(df: DataFrame, keys: list[str], others: list[str], message: str) -> DataFrame:
        """At most one row for a time and a match group, else the query fails. It groups by what the join hashes by."""
        one = F.when(F.count(F.lit(1)) == 1, F.first("_t")).otherwise(F.raise_error(F.lit(message)).cast("long"))
        return df.groupBy(*keys, F.col("_t").alias("_at")).agg(one.alias("_t"), *[F.first(c).alias(c) for c in others]).drop("_at")

    def match(self, node: Binary, left: Vector, right: Vector, op) -> Vector:
        keys = self.keys(node, left, right)
        many, one = (right, left) if node.group == "group_right" else (left, right)
        include = [c for c in node.include if c in one.labels]
        m, o = self.padded(many, keys), self.padded(one, keys)
        o = o.select(*[F.col(k).alias(k) for k in keys], "_t", F.col("_v").alias("_w"), *[F.col(c).alias(f"_in_{c}") for c in include])
        if not set(one.labels) <= set(keys):  # else a series is its own match group
            o = self.single(o, keys, ["_w", *[f"_in_{c}" for c in include]], "found duplicate series for the match group on the one side; many-to-many matching is not allowed")
        df = m.join(o, [*keys, "_t"])
        if not node.group and not set(many.labels) <= set(keys):
            df = self.single(df, keys, ["_v", "_w", *[c for c in many.labels if c not in keys]], "multiple matches for labels: many-to-one matching must be explicit (group_left or group_right)")
        a, b = (F.col("_w"), F.col("_v")) if node.group == "group_right" else (F.col("_v"), F.col("_w"))
        value = op(a, b)
        if node.group:
            labels = [*[c for c in many.labels if c not in include], *include]
        else:
            labels = [k for k in keys if k in left.labels or k in right.labels]
        if node.op in COMPARE:
            df = df.withColumn("_out", value.cast("double")) if node.is_bool else df.where(value).withColumn("_out", a)
            labels = many.labels if not node.group and not node.is_bool and node.on is None else labels
        else:
            df = df.withColumn("_out", value)
        named = [F.col(f"_in_{c}").alias(c) if c in include else F.col(c) for c in labels]
        return Vector(df.select(*named, "_t", F.col("_out").alias("_v")), labels)

    def call(self, node: Call, grid: Grid):
        name, args = node.name, node.args
        if name in RANGE_FUNCTIONS:
            return self.range_call(name, args, grid)
        if name == "time":
            return Scalar(F.col("_t") / 1000)
        if name == "pi":
            return Scalar(F.lit(math.pi), math.pi)
        if name == "vector":
            inner = self.eval(args[0], grid)
            return Vector(self.scalar_table(inner, grid), [])
        if name == "scalar":
            src = self.vector(args[0], grid)
            one = src.df.groupBy("_t").agg(F.when(F.count(F.lit(1)) == 1, F.first("_v")).alias("_v"))
            return Scalar(F.col("_v"), df=self.grid_table(grid).join(one, "_t", "left").select("_t", F.coalesce("_v", F.lit(NAN)).alias("_v")))
        if name == "absent":
            src = self.vector(args[0], grid)
            labels = [(m[0], m[2]) for m in args[0].matchers if m[1] == "="] if isinstance(args[0], Selector) else []
            df = self.grid_table(grid).join(src.df.select("_t").distinct(), "_t", "left_anti")
            return Vector(df.select(*[F.lit(v).alias(k) for k, v in labels], "_t", F.lit(1.0).alias("_v")), [k for k, _ in labels])
        if name in DATES:
            if not args:
                return Vector(self.grid_table(grid).select("_t", DATES[name](F.col("_t") / 1000).cast("double").alias("_v")), [])
            src = self.vector(args[0], grid)
            return Vector(src.df.withColumn("_v", DATES[name](F.col("_v")).cast("double")), src.labels)
        if name == "histogram_quantile":
            return self.histogram_quantile(self.constant(args[0]), self.vector(args[1], grid))
        if name in ("sort", "sort_desc", "sort_by_label", "sort_by_label_desc"):
            src = self.vector(args[0], grid)
            by = [F.col("_v")] if name.startswith(("sort_desc",)) or name == "sort" else [F.col(a.value) for a in args[1:]]
            keys = [c.desc() if name.endswith("_desc") else c.asc() for c in by]
            w = Window.partitionBy("_t").orderBy(*keys, *src.labels)
            return Vector(src.df.withColumn("_rank", F.row_number().over(w)), src.labels)
        if name in ("label_replace", "label_join"):
            return self.relabel(name, args, grid)
        if name == "timestamp":
            if isinstance(args[0], Selector):
                src = self.samples(args[0], grid.start - grid.lookback, grid.end)
                stamped = Vector(src.df.withColumn("v", F.col("ts") / 1000), src.labels)
                return self.spread_last(stamped, grid)
            src = self.vector(args[0], grid)
            return Vector(src.df.withColumn("_v", F.col("_t") / 1000), src.labels)
        inner = self.eval(args[0], grid) if args else None
        v = inner.column.cast("double") if isinstance(inner, Scalar) else F.col("_v")
        if name in MATH:
            out = MATH[name](v)
        elif name == "round":
            to = self.constant(args[1]) if len(args) > 1 else 1.0
            out = F.floor(v / (to or 1.0) + 0.5) * (to or 1.0)
        elif name == "clamp":
            lo, hi = self.constant(args[1]), self.constant(args[2])
            if lo > hi:
                return Vector(inner.df.where(F.lit(False)), inner.labels)
            out = F.when(F.isnan(v), v).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), v)))
        elif name in ("clamp_min", "clamp_max"):
            bound = F.lit(self.constant(args[1]))
            out = F.when(F.isnan(v), v).otherwise(F.greatest(v, bound) if name == "clamp_min" else F.least(v, bound))
        else:
            raise PromQLError(f"unknown function {name}")
        if isinstance(inner, Scalar):
            return Scalar(out)
        return Vector(inner.df.withColumn("_v", out.cast("double")), inner.labels)

    def spread_last(self, src: Vector, grid: Grid) -> Vector:
        low = F.greatest(F.lit(0), F.ceil((F.col("ts") - grid.start) / grid.step)).cast("long")
        high = F.least(F.lit(grid.points - 1), F.floor((F.col("ts") + grid.lookback - 1 - grid.start) / grid.step)).cast("long")
        df = src.df.withColumn("_lo", low).withColumn("_hi", high).where("_hi >= _lo")
        df = df.select(*src.labels, "us", "v", F.explode(F.sequence(F.col("_lo") * grid.step + grid.start, F.col("_hi") * grid.step + grid.start, F.lit(grid.step).cast("long"))).alias("_t"))
        return Vector(df.groupBy(*src.labels, "_t").agg(F.max_by("v", "us").alias("_v")), src.labels)

    def relabel(self, name: str, args: list, grid: Grid) -> Vector:
        src = self.vector(args[0], grid)
        texts = [a.value for a in args[1:]]
        at = lambda c: F.col(c) if c in src.labels else F.lit("")
        if name == "label_join":
            dst, sep, *rest = texts
            value = F.concat_ws(sep, *[at(c) for c in rest])
        else:
            dst, repl, source, regex = texts
            pattern = f"^(?:{regex})$"
            value = F.when(at(source).rlike(pattern), F.regexp_replace(at(source), pattern, repl)).otherwise(at(dst))
        return Vector(src.df.withColumn(dst, value), [*src.labels, *([dst] if dst not in src.labels else [])])

    def histogram_quantile(self, q: float, src: Vector) -> Vector:
        labels = [c for c in src.labels if c != "le"]
        bound = F.when(F.col("le").isin("+Inf", "Inf", "inf"), F.lit(math.inf)).otherwise(F.col("le").try_cast("double"))
        df = src.df.withColumn("_b", bound).where(F.col("_b").isNotNull() & ~F.isnan("_v"))
        if math.isnan(q) or q < 0 or q > 1:
            value = F.lit(NAN if math.isnan(q) else -math.inf if q < 0 else math.inf)
            return Vector(df.groupBy(*labels, "_t").agg(value.alias("_v")), labels)
        w = Window.partitionBy(*labels, "_t").orderBy("_b")
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = df.withColumn("_v", F.max("_v").over(upto)).withColumn("_pb", F.lag("_b").over(w)).withColumn("_pv", F.lag("_v").over(w))
        whole = Window.partitionBy(*labels, "_t")
        df = df.withColumn("_n", F.max("_v").over(whole)).withColumn("_top", F.max("_b").over(whole)).withColumn("_fin", F.max(F.when(F.col("_b") < math.inf, F.col("_b"))).over(whole))
        rank = F.lit(q) * F.col("_n")
        hit = df.where((F.col("_v") >= rank)).groupBy(*labels, "_t").agg(F.min_by(F.struct("_b", "_v", "_pb", "_pv", "_n", "_top", "_fin"), F.col("_b")).alias("h")).select(*labels, "_t", "h.*")
        start, below = F.coalesce("_pb", F.lit(0.0)), F.coalesce("_pv", F.lit(0.0))
        inside = start + (F.col("_b") - start) * divide(rank - below, F.col("_v") - below)
        value = (
            F.when((F.col("_top") < math.inf) | (F.col("_n") == 0) | F.col("_fin").isNull(), F.lit(NAN)).when(F.col("_b") == math.inf, F.col("_fin"))
            .when(F.col("_pb").isNull() & (F.col("_b") <= 0), F.col("_b")).otherwise(inside)
        )
        return Vector(hit.select(*labels, "_t", value.alias("_v")), labels)

    def range_call(self, name: str, args: list, grid: Grid) -> Vector:
        params = [a for a in args if not isinstance(a, Subquery) and not (isinstance(a, Selector) and a.range_ms is not None)]
        ranged = next((a for a in args if a not in params), None)
        if ranged is None:
            raise PromQLError(f"{name} needs a range vector")
        if ranged.at is not None:
            at = {"start": grid.start, "end": grid.end}.get(ranged.at) if isinstance(ranged.at, str) else round(ranged.at * 1000)
            one = self.range_call(name, [replace(a, at=None) if a is ranged else a for a in args], Grid(at, at, grid.step, grid.lookback))
            return Vector(one.df.drop("_t").crossJoin(F.broadcast(self.grid_table(grid))), one.labels)
        if name == "absent_over_time":
            src = self.panes(ranged, grid, [F.lit(1).alias("_some")])
            labels = [(m[0], m[2]) for m in ranged.matchers if m[1] == "="] if isinstance(ranged, Selector) else []
            df = self.grid_table(grid).join(src.df.select("_t").distinct(), "_t", "left_anti")
            return Vector(df.select(*[F.lit(v).alias(k) for k, v in labels], "_t", F.lit(1.0).alias("_v")), [k for k, _ in labels])
        if name in PANES:
            parts, whole = PANES[name]()
            src = self.panes(ranged, grid, parts)
            return Vector(src.df.groupBy(*src.labels, "_t").agg(whole.alias("_v")), src.labels)
        src, single, span = self.windows(ranged, grid)
        t, ts, v, p = F.col("_t"), F.col("ts"), F.col("v"), F.col("p")
        held = F.col("pt") > t - span  # the sample before lies in the window too
        x = (ts - t) / 1000
        group = src.df.groupBy(*src.labels, "_t")
        if name in ("rate", "increase", "delta"):
            counter = name != "delta"
            stats = group.agg(
                F.count(F.lit(1)).alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.min_by("v", "us").alias("v0"), F.max_by("v", "us").alias("v1"),
                F.sum(F.when(held & (v < p), p).otherwise(0.0)).alias("drops"),
            ).where("n > 1 and t1 > t0")
            return Vector(stats.select(*src.labels, "_t", self.extrapolated(counter, name == "rate", span).alias("_v")), src.labels)
        if name in ("irate", "idelta"):
            last = group.agg(F.max_by(F.struct("ts", "v", F.when(held, p).alias("p"), "pt"), F.col("us")).alias("s")).select(*src.labels, "_t", "s.*").where("p is not null")
            change = F.when(F.col("v") < F.col("p"), F.col("v")).otherwise(F.col("v") - F.col("p")) if name == "irate" else F.col("v") - F.col("p")
            last = last.where("ts > pt") if name == "irate" else last
            value = change / ((F.col("ts") - F.col("pt")) / 1000) if name == "irate" else change
            return Vector(last.select(*src.labels, "_t", value.alias("_v")), src.labels)
        if name in ("double_exponential_smoothing", "holt_winters"):
            sf, tf = (self.constant(a) for a in params)
            rows = group.agg(F.sort_array(F.collect_list(F.struct("us", "v"))).alias("s")).where("size(s) > 1")
            first, second = F.col("s")[0]["v"], F.col("s")[1]["v"]
            state = F.aggregate(
                F.slice("s", 2, F.size("s") - 1), F.struct(first.alias("l"), (second - first).alias("b"), F.lit(True).alias("f")),
                lambda a, y: F.struct(
                    (y["v"] * sf + (a["l"] + a["b"]) * (1 - sf)).alias("l"),
                    ((y["v"] * sf + (a["l"] + a["b"]) * (1 - sf) - a["l"]) * tf + a["b"] * (1 - tf)).alias("b"), F.lit(False).alias("f"),
                ),
                lambda a: a["l"],
            )
            return Vector(rows.select(*src.labels, "_t", state.alias("_v")), src.labels)
        if name == "quantile_over_time":
            q = self.constant(params[0])
            outside = NAN if math.isnan(q) else -math.inf if q < 0 else math.inf if q > 1 else None
            agg, alone = (F.percentile(v, F.lit(q)), v) if outside is None else (F.lit(outside), F.lit(outside))
        elif name == "predict_linear":
            s = self.constant(params[0])
            slope = F.regr_slope(v, x)
            agg = F.when(F.count(F.lit(1)) > 1, F.avg(v) + slope * (F.max(x) + s - F.avg(x)))
        elif name == "mad_over_time":
            rows = group.agg(F.collect_list("v").alias("s"), F.percentile(v, F.lit(0.5)).alias("m"))
            flat = rows.select(*src.labels, "_t", "m", F.explode("s").alias("v")).groupBy(*src.labels, "_t").agg(F.percentile(F.abs(F.col("v") - F.col("m")), F.lit(0.5)).alias("_v"))
            return self.beside(flat, single, F.abs(v - v))
        else:
            agg = {
                "stdvar_over_time": F.var_pop(v), "stddev_over_time": F.stddev_pop(v),
                "changes": F.sum(F.when(held & (v != p), 1.0).otherwise(0.0)), "resets": F.sum(F.when(held & (v < p), 1.0).otherwise(0.0)), "deriv": F.when(F.count(F.lit(1)) > 1, F.regr_slope(v, x)),
            }[name]
            alone = F.lit(0.0) if name in ("changes", "resets") else v - v
        out = group.agg(agg.alias("_v"))
        if name in ("deriv", "predict_linear"):
            return Vector(out.where("_v is not null"), src.labels)
        return self.beside(out, single, alone)

    @staticmethod
    def beside(many: DataFrame, single: Vector, value: Column) -> Vector:
        """Windows of several samples, and those of one, whose value is a column over v."""
        return Vector(many.unionByName(single.df.select(*single.labels, "_t", value.alias("_v"))), single.labels)

    @staticmethod
    def extrapolated(counter: bool, per_second: bool, span: int) -> Column:
        """Change over the window, extended to its edges as Prometheus documents it."""
        change = F.col("v1") - F.col("v0") + F.col("drops") if counter else F.col("v1") - F.col("v0")
        sampled, gaps = (F.col("t1") - F.col("t0")) / 1000, F.col("n") - 1
        to_start, to_end = (F.col("t0") - (F.col("_t") - span)) / 1000, (F.col("_t") - F.col("t1")) / 1000
        if counter:
            to_zero = sampled * F.col("v0") / F.when(change > 0, change)
            to_start = F.when((change > 0) & (F.col("v0") >= 0), F.least(to_start, to_zero)).otherwise(to_start)
        reach = lambda gap: F.when(gap < 1.1 * sampled / gaps, gap).otherwise(sampled / gaps / 2)
        over = change * (sampled + reach(to_start) + reach(to_end)) / sampled  # in the order of its SQL, to the last bit
        return over / (span / 1000) if per_second else over
