"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import drop_table, materialize

SALTS = 8


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and its neighbours; a hub's rows spread over SALTS tasks."""
    pairs = pairs.withColumn("_s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.bit_or(F.expr("shiftleft(1, _s)")).alias("_has")).withColumn("m", F.least("u", "m"))
    salts = F.filter(F.array(*[F.lit(i) for i in range(SALTS)]), lambda i: F.col("_has").bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0)  # a copy for each task that has rows of u, not for all
    right = least.select("u", "m", F.explode(salts).alias("_s"))
    return pairs.join(right, ["u", "_s"]).drop("_s")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the least id reachable, for every id on an edge. Edges live in written tables, never on the driver."""
    now = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialize(large, "large-star")
        small = _with_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        last, now = now, materialize(small, "small-star")
        drop_table(last)
        drop_table(large)
        mark = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    stars = now.groupBy("u").agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("u")).distinct().withColumn("component", F.col("u"))
    return stars.unionByName(roots).groupBy(F.col("u").alias("id")).agg(F.min("component").alias("component"))
