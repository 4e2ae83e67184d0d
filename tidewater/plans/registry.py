"""Registry of the engine's queries and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.plans import ingest, timeseries
from tidewater.plans.engine import Engine
from tidewater.plans.relational import SQL

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "documents")


def _statement(text: str) -> Callable[[SparkSession, str], DataFrame]:
    names = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    return lambda spark, sf_dir: Engine(spark).load(sf_dir, names).sql(text)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _statement(text) for name, (text, _) in SQL.items()} | timeseries.QUERIES | ingest.QUERIES
ORACLE_SQL: dict[str, str] = {name: duck or text for name, (text, duck) in SQL.items()} | timeseries.ORACLE_SQL | ingest.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly rate of every series over the whole table."""
    return QUERIES["promql_rate"](spark, sf_dir)
