"""Mergeable sketches and multi-column distinct counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hll(value: Column) -> Column:
    """HyperLogLog state with 2^14 registers."""
    return F.hll_sketch_agg(value, 14)


def hll_merge(state: Column) -> Column:
    return F.hll_union_agg(state)


def hll_count(state: Column) -> Column:
    return F.hll_sketch_estimate(state)


def count_hash(*columns: Column) -> Column:
    """Distinct tuples of columns by their 64-bit digests; all-null tuples count as one."""
    return F.count_distinct(F.xxhash64(*columns))


def _gamma(error: float) -> float:
    return (1 + error) / (1 - error)


def uddsketch_state(df: DataFrame, by: list[str], value: str, max_buckets: int, error: float, name: str = "state") -> DataFrame:
    """A sketch a group: counts by logarithmic bucket. Values are counted by bucket first, so partial aggregation shrinks them."""
    log_gamma = math.log(_gamma(error))
    v = F.col(value)
    bucket = F.when(v == 0, F.lit(None).cast("int")).otherwise(F.ceil(F.log(F.abs(v)) / log_gamma).cast("int"))
    rows = df.where(v.isNotNull() & ~F.isnan(v.cast("double"))).groupBy(*by, F.signum(v).cast("int").alias("_s"), bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    buckets = F.sort_array(F.collect_list(F.struct(F.col("_s").alias("s"), F.col("_b").alias("b"), F.col("_n").alias("n"))))
    return _shrunk(rows.groupBy(*by).agg(buckets.alias("_all")), by, max_buckets, error, name)


def _shrunk(df: DataFrame, by: list[str], max_buckets: int, error: float, name: str, level_col: str | None = None) -> DataFrame:
    """While there are too many buckets, pairs of neighbours become one and the error grows."""
    halve = lambda s, _: F.when(F.size(s["buckets"]) <= max_buckets, s).otherwise(
        F.struct(
            F.transform(
                F.array_distinct(F.transform(s["buckets"], lambda x: F.struct(x["s"].alias("s"), F.ceil(x["b"] / 2).cast("int").alias("b")))),
                lambda k: F.struct(
                    k["s"].alias("s"), k["b"].alias("b"),
                    F.aggregate(F.filter(s["buckets"], lambda x: (x["s"] == k["s"]) & F.ceil(x["b"] / 2).cast("int").eqNullSafe(k["b"])), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n"),
                ),
            ).alias("buckets"),
            (2 * s["error"] / (1 + s["error"] * s["error"])).alias("error"), s["start"].alias("start"), (s["level"] + 1).alias("level"),
        )
    )
    now = F.lit(float(error)) if level_col is None else F.aggregate(F.array_repeat(F.lit(0), F.col(level_col)), F.lit(float(error)), lambda e, _: 2 * e / (1 + e * e))
    first = F.struct(F.col("_all").alias("buckets"), now.alias("error"), F.lit(float(error)).alias("start"), (F.lit(0) if level_col is None else F.col(level_col)).alias("level"))
    return df.select(*by, F.aggregate(F.sequence(F.lit(1), F.lit(20)), first, halve).alias(name))


def uddsketch_merge(df: DataFrame, by: list[str], state: str, max_buckets: int, error: float, name: str = "state") -> DataFrame:
    """One sketch a group from many of the same error."""
    s = F.col(state)
    level = F.max(s["level"]).over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))  # finer sketches shrink to the coarsest
    same = F.assert_true(F.abs(s["start"] - error) < 1e-12, F.lit("sketch parameters differ")).isNull()
    rows = df.where(same).withColumn("_l", level).select(*by, "_l", F.pow(F.lit(2), F.col("_l") - s["level"]).alias("_f"), F.explode(s["buckets"]).alias("x"))
    bucket = F.ceil(F.col("x.b") / F.col("_f")).cast("int")
    sums = rows.groupBy(*by, "_l", F.col("x.s").alias("_s"), bucket.alias("_b")).agg(F.sum("x.n").alias("_n"))
    buckets = F.sort_array(F.collect_list(F.struct(F.col("_s").alias("s"), F.col("_b").alias("b"), F.col("_n").alias("n"))))
    return _shrunk(sums.groupBy(*by).agg(buckets.alias("_all"), F.max("_l").alias("_l")), by, max_buckets, error, name, "_l")


def uddsketch_calc(p: float, state: Column) -> Column:
    """The p-quantile within the sketch's relative error."""
    error = state["error"]
    gamma = (1 + error) / (1 - error)
    at = lambda x: F.when(x["s"] == 0, F.lit(0.0)).otherwise(x["s"] * 2 * F.pow(gamma, x["b"]) / (gamma + 1))
    ordered = F.array_sort(F.transform(state["buckets"], lambda x: F.struct(at(x).alias("v"), x["n"].alias("n"))))
    total = F.aggregate(ordered, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    rank = F.lit(p) * (total - 1)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("v"))
    step = lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), F.when(a["v"].isNull() & (a["n"] + x["n"] > rank), x["v"]).otherwise(a["v"]).alias("v"))
    return F.aggregate(ordered, start, step, lambda a: a["v"])
