"""Anomaly scores over window frames; nulls, NaN and infinities are no samples.

``mad_scores`` and ``iqr_scores`` are for windows that are whole partitions: they
aggregate a group once and join the quantiles back. ``anomaly_score_mad`` and
``anomaly_score_iqr`` are for moving frames; every row then sorts its own frame.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F


def _finite(x: Column) -> Column:
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < math.inf), x)


def _ratio(distance: Column, spread: Column) -> Column:
    return F.when(spread == 0, F.when(distance == 0, F.lit(0.0)).otherwise(F.lit(math.inf))).otherwise(distance / F.when(spread != 0, spread))


def anomaly_score_zscore(x: Column, w: WindowSpec) -> Column:
    v = _finite(x)
    score = _ratio(F.abs(v - F.avg(v).over(w)), F.stddev_pop(v).over(w))
    return F.when(v.isNotNull() & (F.count(v).over(w) >= 2), score)


def _quantile(sorted_: Column, q: float) -> Column:
    pos = (F.size(sorted_) - 1) * F.lit(q)
    lo, hi = F.floor(pos).cast("int"), F.ceil(pos).cast("int")
    return F.get(sorted_, lo) + (F.get(sorted_, hi) - F.get(sorted_, lo)) * (pos - lo)


def anomaly_score_mad(x: Column, w: WindowSpec) -> Column:
    v = _finite(x)
    values = F.sort_array(F.collect_list(v).over(w))
    median = _quantile(values, 0.5)
    mad = _quantile(F.array_sort(F.transform(values, lambda y: F.abs(y - median))), 0.5)
    return F.when(v.isNotNull() & (F.size(values) >= 3), _ratio(F.abs(v - median), mad * 1.4826))


def anomaly_score_iqr(x: Column, k: float, w: WindowSpec) -> Column:
    v = _finite(x)
    if k is None or k < 0:
        return F.lit(None).cast("double")
    values = F.sort_array(F.collect_list(v).over(w))
    q1, q3 = _quantile(values, 0.25), _quantile(values, 0.75)
    iqr = q3 - q1
    past = F.greatest(F.lit(0.0), q1 - k * iqr - v, v - (q3 + k * iqr))
    return F.when(v.isNotNull() & (F.size(values) >= 3), _ratio(past, iqr))


def _joined(df: DataFrame, by: list[str], stats: DataFrame) -> DataFrame:
    """df with the columns of its group; null keys are a group."""
    right = stats.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], *[c for c in stats.columns if c not in by])
    on = None
    for i, c in enumerate(by):
        same = F.col(c).eqNullSafe(F.col(f"_k{i}"))
        on = same if on is None else on & same
    made = df.join(right, on) if on is not None else df.crossJoin(right)  # without keys there is one row of statistics
    return made.drop(*[f"_k{i}" for i in range(len(by))])


def mad_scores(df: DataFrame, value: str, by: list[str], name: str = "score") -> DataFrame:
    """df with the MAD score of ``value`` among the rows of its group."""
    v = _finite(F.col(value))
    median = df.groupBy(*by).agg(F.percentile(v, F.lit(0.5)).alias("_median"), F.count(v).alias("_n"))
    rows = _joined(df, by, median)
    spread = rows.groupBy(*by).agg(F.percentile(F.abs(v - F.col("_median")), F.lit(0.5)).alias("_mad"))
    score = F.when(v.isNotNull() & (F.col("_n") >= 3), _ratio(F.abs(v - F.col("_median")), F.col("_mad") * 1.4826))
    return _joined(rows, by, spread).withColumn(name, score).drop("_median", "_n", "_mad")


def iqr_scores(df: DataFrame, value: str, k: float, by: list[str], name: str = "score") -> DataFrame:
    """df with the IQR score of ``value`` among the rows of its group."""
    v = _finite(F.col(value))
    if k is None or k < 0:
        return df.withColumn(name, F.lit(None).cast("double"))
    stats = df.groupBy(*by).agg(F.percentile(v, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"), F.count(v).alias("_n"))
    q1, q3 = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    past = F.greatest(F.lit(0.0), q1 - k * (q3 - q1) - v, v - (q3 + k * (q3 - q1)))
    return _joined(df, by, stats).withColumn(name, F.when(v.isNotNull() & (F.col("_n") >= 3), _ratio(past, q3 - q1))).drop("_q", "_n")
