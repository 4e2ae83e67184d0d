"""Vector functions over array<float> columns, in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _d(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def _sum(v: Column) -> Column:
    return F.aggregate(_d(v), F.lit(0.0), lambda a, x: a + x)


def parse_vec(s: Column) -> Column:
    return F.from_json(s, "array<float>")


def vec_to_string(v: Column) -> Column:
    return F.when(v.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: F.when(x == F.floor(x), F.format_string("%.0f", x.cast("double"))).otherwise(x.cast("string"))), ","), F.lit("]")))


def vec_dot_product(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def vec_l2sq_distance(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def vec_cos_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where a side has no length."""
    norm = F.sqrt(vec_dot_product(a, a)) * F.sqrt(vec_dot_product(b, b))
    return F.when(norm == 0, F.lit(1.0)).otherwise(1 - vec_dot_product(a, b) / F.when(norm != 0, norm))


def vec_scalar_add(s: Column, v: Column) -> Column:
    return F.transform(v, lambda x: (x + s).cast("float"))


def vec_scalar_mul(s: Column, v: Column) -> Column:
    return F.transform(v, lambda x: (x * s).cast("float"))


def _pairwise(a: Column, b: Column, f) -> Column:
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: f(x, y).cast("float")))


def vec_add(a: Column, b: Column) -> Column:
    return _pairwise(a, b, lambda x, y: x + y)


def vec_sub(a: Column, b: Column) -> Column:
    return _pairwise(a, b, lambda x, y: x - y)


def vec_mul(a: Column, b: Column) -> Column:
    return _pairwise(a, b, lambda x, y: x * y)


def vec_div(a: Column, b: Column) -> Column:
    return _pairwise(a, b, lambda x, y: x / F.when(y != 0, y))


def vec_norm(v: Column) -> Column:
    size = F.sqrt(vec_dot_product(v, v))
    return F.transform(v, lambda x: (x / F.when(size != 0, size)).cast("float"))


def vec_dim(v: Column) -> Column:
    return F.when(v.isNotNull(), F.size(v).cast("long"))


def vec_kth_elem(v: Column, k: Column) -> Column:
    return F.get(v, k)


def vec_subvector(v: Column, start: Column, end: Column) -> Column:
    return F.slice(v, start + 1, end - start)


def vec_elem_sum(v: Column) -> Column:
    return _sum(v)


def vec_elem_product(v: Column) -> Column:
    return F.aggregate(_d(v), F.lit(1.0), lambda a, x: a * x)


def vec_elem_avg(v: Column) -> Column:
    return F.when(F.size(v) > 0, _sum(v) / F.size(v))


def _by_element(df: DataFrame, by: list[str], v: str, agg, name: str) -> DataFrame:
    """Element-wise aggregate: elements are rows, aggregated partially, and put back in order."""
    rows = df.where(F.col(v).isNotNull()).select(*by, F.posexplode(v).alias("_i", "_x"))
    each = rows.groupBy(*by, "_i").agg(agg(F.col("_x").cast("double")).alias("_x"))
    return each.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"].cast("float")).alias(name))


def vec_sum(df: DataFrame, by: list[str], v: str, name: str = "vec_sum") -> DataFrame:
    return _by_element(df, by, v, F.sum, name)


def vec_avg(df: DataFrame, by: list[str], v: str, name: str = "vec_avg") -> DataFrame:
    return _by_element(df, by, v, F.avg, name)


def vec_product(df: DataFrame, by: list[str], v: str, name: str = "vec_product") -> DataFrame:
    return _by_element(df, by, v, F.product, name)


def nearest(df: DataFrame, v: str, query: list[float], k: int, metric: str = "cos") -> DataFrame:
    """Exact k nearest rows: a top-k without a global sort."""
    q = F.array(*[F.lit(float(x)) for x in query])
    measure = {"cos": vec_cos_distance, "l2sq": vec_l2sq_distance, "dot": lambda a, b: -vec_dot_product(a, b)}[metric]
    return df.withColumn("distance", measure(F.col(v), q)).where("distance is not null").orderBy("distance").limit(k)
