"""File sources and sinks: Parquet, CSV, NDJSON and ORC, with pattern filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str, kind: str = "parquet", options: dict | None = None, schema: StructType | str | None = None) -> DataFrame:
    """Options: pattern (regular expression on file names), has_header, delimiter, skip_bad_records, schema_infer_max_record.

    With schema_infer_max_record = n the schema of CSV and JSON comes from the first n
    lines that a scan gives (n and the header of CSV); without it from all of them.
    """
    options = {k.lower(): v for k, v in (options or {}).items()}
    if kind in ("csv", "json") and schema is None and options.get("schema_infer_max_record"):
        schema = _inferred(spark, path, kind, options)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "csv":
        reader = reader.option("header", options.get("has_header", "true")).option("sep", options.get("delimiter", ","))
        reader = reader.option("mode", "DROPMALFORMED" if options.get("skip_bad_records", "false") == "true" else "FAILFAST")
        reader = reader.option("inferSchema", "true") if schema is None else reader
    elif kind not in ("parquet", "json", "orc"):
        raise ValueError(f"unknown format {kind}")
    df = reader.format(kind).load(path)
    if options.get("pattern"):
        df = df.where(F.regexp_extract(F.col("_metadata.file_name"), options["pattern"], 0) != "")
    return df


def _inferred(spark: SparkSession, path: str, kind: str, options: dict) -> StructType:
    """Schema of the first lines; their number is the caller's bound on what the driver holds."""
    head = options.get("has_header", "true") == "true" and kind == "csv"
    lines = [r[0] for r in spark.read.text(path).limit(int(options["schema_infer_max_record"]) + head).collect()]
    some = spark.sparkContext.parallelize(lines, 1)
    if kind == "json":
        return spark.read.json(some).schema
    return spark.read.option("header", str(head).lower()).option("sep", options.get("delimiter", ",")).option("inferSchema", "true").csv(some).schema


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of a schema by name, cast; columns that are missing are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def write(df: DataFrame, path: str, kind: str = "parquet", options: dict | None = None, partition_by: list[str] | None = None) -> None:
    """Options: compression, has_header, delimiter, mode."""
    options = {k.lower(): v for k, v in (options or {}).items()}
    writer = df.write.mode(options.get("mode", "overwrite")).format(kind)
    if kind == "csv":
        writer = writer.option("header", options.get("has_header", "true")).option("sep", options.get("delimiter", ","))
    codec = options.get("compression_type") or options.get("compression")
    if codec:
        writer = writer.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def copy_database_to(tables: dict[str, DataFrame], path: str, kind: str = "parquet", time_index: dict[str, str] | None = None, start=None, end=None) -> list[str]:
    """Every table under its name; a time range applies to tables with a time index."""
    out = []
    for name, df in tables.items():
        ts = (time_index or {}).get(name)
        if ts and start is not None:
            df = df.where(F.col(ts) >= F.lit(start))
        if ts and end is not None:
            df = df.where(F.col(ts) < F.lit(end))
        write(df, f"{path}/{name}", kind)
        out.append(name)
    return out


def copy_database_from(spark: SparkSession, path: str, names: list[str], kind: str = "parquet") -> dict[str, DataFrame]:
    return {name: read(spark, f"{path}/{name}", kind) for name in names}
