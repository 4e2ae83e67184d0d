"""The SQL facade: named tables, SELECT, RANGE and TQL statements, COPY, SHOW and DESCRIBE."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.promql import PromQL
from tidewater.operators.promql.parser import duration_ms
from tidewater.operators.range_select import Item, RangeError, range_select
from tidewater.plans import statements
from tidewater.plans.dialect import translate
from tidewater.plans.tables import TimeSeriesTable
from tidewater.sources import files

TQL = re.compile(r"^\s*TQL\s+(EVAL|EVALUATE|EXPLAIN|ANALYZE)\s*(?:VERBOSE\s*)?\(\s*([^)]*)\)\s*(.*)$", re.I | re.S)
RANGE_ITEM = re.compile(r"^\s*(\w+)\s*\(\s*(DISTINCT\s+)?(.*?)(?:\s+ORDER\s+BY\s+(\w+)\s*(?:ASC)?)?\s*\)\s*RANGE\s+'([^']+)'(?:\s+FILL\s+('?[-\w.]+'?))?(?:\s+AS\s+(\w+)|\s+(\w+))?\s*$", re.I | re.S)
RANGE_QUERY = re.compile(
    r"^\s*SELECT\s+(?P<items>.*?)\s+FROM\s+(?P<table>\w+|\(.*?\)(?:\s+AS)?\s+\w+)(?:\s+WHERE\s+(?P<where>.*?))?\s+ALIGN\s+'(?P<align>[^']+)'(?:\s+TO\s+(?P<to>'[^']+'|\w+))?(?:\s+BY\s*\((?P<by>.*?)\))?"
    r"(?:\s+FILL\s+(?P<fill>'?[-\w.]+'?))?(?:\s+ORDER\s+BY\s+(?P<order>.*?))?(?:\s+LIMIT\s+(?P<limit>\d+))?\s*;?\s*$",
    re.I | re.S,
)


def split_top(text: str, sep: str = ",") -> list[str]:
    """Parts at the top level of parentheses and quotes."""
    out, depth, quote, part = [], 0, "", ""
    for ch in text:
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        elif ch == sep and not depth:
            out.append(part.strip())
            part = ""
            continue
        part += ch
    return [*out, part.strip()] if part.strip() else out


class Engine:
    """Tables and statements of one session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, {}
        self.prepared: dict[str, str] = {}
        self.state = statements.State()

    def register(self, name: str, table: TimeSeriesTable | DataFrame) -> None:
        """A time-series table, or a plain frame without a time index."""
        self.tables[name] = table
        view = table.read() if isinstance(table, TimeSeriesTable) else table
        if statements.SEQUENCE in view.columns:  # tables made by CREATE TABLE
            view = view.select(*[c for c in table.df.columns if c != statements.SEQUENCE])
        view.createOrReplaceTempView(name)

    def load(self, sf_dir: str, names: list[str]) -> Engine:
        for name in names:
            self.register(name, self.spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        return self

    def promql(self) -> PromQL:
        return PromQL(self.spark, {k: t for k, t in self.tables.items() if isinstance(t, TimeSeriesTable)})

    def sql(self, text: str, args: dict | None = None) -> DataFrame:
        """Runs one statement."""
        if m := TQL.match(text):
            return self._tql(m[1].upper(), m[2], m[3])
        if m := re.match(r"^\s*WITH\s+(\w+)(?:\s*\(([^)]*)\))?\s+AS\s*\(\s*(TQL\s.*?)\)\s*(SELECT\s.*)$", text, re.I | re.S):
            inner = self.sql(m[3].strip())
            if m[2]:
                inner = inner.toDF(*[c.strip() for c in m[2].split(",")])
            inner.createOrReplaceTempView(m[1])
            return self.sql(m[4], args)
        if re.search(r"\bALIGN\s+'", text, re.I) and re.search(r"\bRANGE\s+'", text, re.I):
            return self._range(text)
        if re.search(r"\bRANGE\s+'[^']+'", text, re.I):
            raise RangeError("a RANGE query needs ALIGN")
        if m := re.match(r"^\s*COPY\s+(\w+|\(.*\))\s+(TO|FROM)\s+'([^']+)'(?:\s+WITH\s*\((.*)\))?\s*;?\s*$", text, re.I | re.S):
            return self._copy(m[1], m[2].upper(), m[3], m[4] or "")
        if re.match(r"^\s*SHOW\s+TABLES\s*;?\s*$", text, re.I):
            return self.spark.createDataFrame([(n,) for n in sorted(self.tables)], "Tables string")
        if m := re.match(r"^\s*DESC(?:RIBE)?(?:\s+TABLE)?\s+(\w+)\s*;?\s*$", text, re.I):
            return self.describe(m[1])
        done = self._statement(text)
        if done is None:
            done = statements.run(self, text.strip().rstrip(";").strip())
        if done is not None:
            return done
        return self._spark_sql(self._system_tables(translate(text, self._whole_columns())), args)

    def _whole_columns(self) -> frozenset:
        """Lower-case names of columns that are integers in every table that has them."""
        kinds: dict[str, bool] = {}
        for table in self.tables.values():
            for f in (table.df if isinstance(table, TimeSeriesTable) else table).schema:
                kinds[f.name.lower()] = kinds.get(f.name.lower(), True) and f.dataType.typeName() in ("byte", "short", "integer", "long")
        return frozenset(name for name, whole in kinds.items() if whole)

    def _spark_sql(self, text: str, args: dict | None = None) -> DataFrame:
        """Analyses under the arithmetic of the dialect: integers wrap, and a bad cast gives null."""
        name = "spark.sql.ansi.enabled"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, "false")
        try:
            return self.spark.sql(text, args=args) if args else self.spark.sql(text)
        finally:
            self.spark.conf.set(name, before)

    def _system_tables(self, text: str) -> str:
        """Makes views of the system tables that the text names: numbers and information_schema.*"""
        if re.search(r"\bnumbers\b", text, re.I) and "numbers" not in self.tables:
            self.spark.range(100).select(F.col("id").cast("int").alias("number")).createOrReplaceTempView("numbers")
        for name in {m.lower() for m in re.findall(r"\binformation_schema\.(\w+)", text, re.I)}:
            maker = getattr(self, f"information_schema_{name}", None)
            if maker is None:
                raise ValueError(f"no table information_schema.{name}")
            maker().createOrReplaceTempView(f"information_schema_{name}")
        return re.sub(r"\binformation_schema\.(\w+)", lambda m: f"information_schema_{m[1].lower()}", text, flags=re.I)

    def _statement(self, text: str) -> DataFrame | None:
        """DDL and DML over registered tables; None for anything else."""
        ok = lambda n: self.spark.createDataFrame([(n,)], "result string")
        text = text.strip().rstrip(";").strip()
        if m := re.match(r"^CREATE\s+EXTERNAL\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)\s+WITH\s*\((.*)\)$", text, re.I | re.S):
            opts = {k.lower(): v for k, v in re.findall(r"(\w+)\s*=\s*'([^']*)'", m[2])}
            self.register(m[1], files.read(self.spark, opts.pop("location"), opts.pop("format", "parquet").lower(), opts))
            return ok(m[1])
        if m := re.match(r"^CREATE\s+(?:OR\s+REPLACE\s+)?VIEW\s+(\w+)\s+AS\s+(.*)$", text, re.I | re.S):
            self.register(m[1], self.sql(m[2]))
            return ok(m[1])
        if m := re.match(r"^DROP\s+(?:TABLE|VIEW)\s+(?:IF\s+EXISTS\s+)?(\w+)$", text, re.I):
            self.tables.pop(m[1], None)
            self.spark.catalog.dropTempView(m[1])
            return ok(m[1])
        if m := re.match(r"^(?:DELETE\s+FROM\s+(\w+)(?:\s+WHERE\s+(.*))?|TRUNCATE\s+(?:TABLE\s+)?(\w+))$", text, re.I | re.S):
            name = m[1] or m[3]
            self._replace(name, lambda df: df.where(~F.coalesce(F.expr(m[2]), F.lit(False))) if m[2] else df.limit(0))
            return ok(name)
        if m := re.match(r"^INSERT\s+INTO\s+(\w+)(?:\s*\(([^)]*)\))?\s+(VALUES.*|SELECT.*)$", text, re.I | re.S):
            new = self.sql(m[3])
            names = [c.strip() for c in m[2].split(",")] if m[2] else None
            self.state.inserts += 1

            def added(df: DataFrame) -> DataFrame:
                rows = new.toDF(*(names or [c for c in df.columns if c != statements.SEQUENCE]))
                if statements.SEQUENCE in df.columns:
                    rows = rows.withColumn(statements.SEQUENCE, F.lit(self.state.inserts).cast("long"))
                return df.unionByName(files.conform(rows, df.schema))

            self._replace(m[1], added)
            return ok(m[1])
        if m := re.match(r"^PREPARE\s+(\w+)\s+(?:FROM\s+'(.*)'|AS\s+(.*))$", text, re.I | re.S):
            self.prepared[m[1]] = m[2] or m[3]
            return ok(m[1])
        if m := re.match(r"^EXECUTE\s+(\w+)(?:\s+USING\s+(.*)|\s*\((.*)\))?$", text, re.I | re.S):
            given = split_top(m[2] or m[3] or "")
            return self.sql(re.sub(r"\$(\d+)", lambda d: given[int(d[1]) - 1], re.sub(r"\?", lambda _, it=iter(given): next(it), self.prepared[m[1]])))
        if m := re.match(r"^DEALLOCATE\s+(?:PREPARE\s+)?(\w+)$", text, re.I):
            del self.prepared[m[1]]
            return ok(m[1])
        return None

    def _replace(self, name: str, change) -> None:
        table = self.tables[name]
        if isinstance(table, TimeSeriesTable):
            table.df = change(table.df)
            self.register(name, table)
        else:
            self.register(name, change(table))

    def describe(self, name: str) -> DataFrame:
        t = self.tables[name]
        df = t.df.drop(statements.SEQUENCE) if isinstance(t, TimeSeriesTable) else t
        role = lambda c: "FIELD" if not isinstance(t, TimeSeriesTable) else "TIMESTAMP" if c == t.time_index else "TAG" if c in t.tags else "FIELD"
        key = lambda c: "PRI" if isinstance(t, TimeSeriesTable) and c in [*t.tags, t.time_index] else ""
        return self.spark.createDataFrame([(f.name, f.dataType.simpleString(), key(f.name), role(f.name)) for f in df.schema], "`Column` string, `Type` string, `Key` string, `Semantic Type` string")

    def information_schema_columns(self) -> DataFrame:
        rows = [(n, c["Column"], c["Type"], c["Semantic Type"]) for n in sorted(self.tables) for c in self.describe(n).collect()]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, data_type string, semantic_type string")

    def information_schema_tables(self) -> DataFrame:
        rows = [("public", n, "BASE TABLE" if isinstance(t, TimeSeriesTable) else "VIEW") for n, t in sorted(self.tables.items())]
        return self.spark.createDataFrame(rows, "table_schema string, table_name string, table_type string")

    def information_schema_schemata(self) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in sorted(self.state.databases)], "schema_name string")

    def information_schema_flows(self) -> DataFrame:
        return self.spark.createDataFrame([(n, f["sink"], f["query"]) for n, f in sorted(self.state.flows.items())], "flow_name string, sink_table_name string, flow_definition string")

    def _tql(self, mode: str, window: str, query: str) -> DataFrame:
        query, alias = re.match(r"^(.*?)(?:\s+AS\s+(\w+))?\s*;?\s*$", query.strip(), re.I | re.S).groups()

        def seconds(x: str) -> float:
            x = x.strip()
            quoted = x.strip("'\"")
            if re.fullmatch(r"-?\d+(?:\.\d+)?", quoted):
                return float(quoted)
            if re.fullmatch(r"(?:\d+(?:ms|[smhdwy]))+", quoted):
                return duration_ms(quoted) / 1000
            return float(self.spark.sql(f"SELECT unix_micros(CAST({x if x.startswith(chr(39)) or '(' in x else repr(quoted)} AS TIMESTAMP)) / 1e6").first()[0])

        parts = split_top(window)
        start, end, step = (seconds(p) for p in parts[:3])
        lookback = round(seconds(parts[3]) * 1000) if len(parts) > 3 else None
        df = self.promql().query_range(query, start, end, step, lookback)
        if alias:
            df = df.withColumnRenamed("value", alias)
        if mode == "ANALYZE":
            return statements.analyzed(df)
        if mode == "EXPLAIN":
            return self.spark.createDataFrame([(df._jdf.queryExecution().toString(),)], "plan string")
        return df

    def _range(self, text: str) -> DataFrame:
        m = RANGE_QUERY.match(text)
        if not m:
            raise RangeError("cannot read the RANGE query")
        source = m["table"]
        name = source if re.fullmatch(r"\w+", source) else None
        if name:
            df, table = self.spark.table(name), self.tables.get(name)
        else:
            inner = re.match(r"^\((.*)\)(?:\s+AS)?\s+(\w+)$", source, re.I | re.S)
            df, table = self.sql(inner[1]), None
        if m["where"]:
            df = df.where(m["where"])
        ts = table.time_index if isinstance(table, TimeSeriesTable) else next((f.name for f in df.schema if f.dataType.typeName().startswith("timestamp")), None)
        if ts is None:
            raise RangeError("the source has no time index")
        const = lambda x: None if x is None else (x.strip("'").upper() if x.strip("'").upper() in ("NULL", "PREV", "LINEAR") else float(x.strip("'")))
        items, plain = [], []
        for part in split_top(m["items"]):
            r = RANGE_ITEM.match(part)
            if r:
                agg = "count_distinct" if r[2] else r[1].lower()
                value = F.lit(1) if r[3].strip() == "*" else F.expr(r[3])
                label = r[7] or r[8] or re.sub(r"\s+", " ", part)
                items.append(Item(agg, value, r[5], label, const(r[6]), r[4]))
            elif re.search(r"\bRANGE\b", part, re.I):
                raise RangeError(f"cannot read the RANGE item {part!r}")
            else:
                plain.append(part)
        if m["by"] is None:
            if not isinstance(table, TimeSeriesTable):
                raise RangeError("a RANGE query over a derived table needs BY")
            by = table.tags
        else:
            by = []
            for i, e in enumerate(split_top(m["by"])):
                alias = re.match(r"^(.*?)\s+AS\s+(\w+)$", e, re.I | re.S)
                col = alias[2] if alias else (e if e in df.columns else f"_by{i}")
                if col not in df.columns:
                    df = df.withColumn(col, F.expr(alias[1] if alias else e))
                by.append(col)
        to = (m["to"] or "CALENDAR").strip("'")
        if to.upper() not in ("CALENDAR", "NOW"):
            to = self.spark.sql(f"SELECT unix_micros(CAST('{to}' AS TIMESTAMP))").first()[0]
            if to is None:
                raise RangeError("TO accepts NOW, CALENDAR or a timestamp")
        now = self.spark.sql("SELECT unix_micros(current_timestamp())").first()[0] if to == "NOW" else None
        out = range_select(df, ts, items, m["align"], by, to, const(m["fill"]), now)
        labels = [i.name for i in items]
        shown = [F.expr(p) for p in plain] if plain else []
        out = out.select(*shown, *[F.col(f"`{x}`") for x in labels])
        if m["order"]:
            out = out.orderBy(*[F.expr(re.sub(r"\s+(ASC|DESC)$", "", o, flags=re.I)).desc_nulls_first() if re.search(r"\sDESC$", o, re.I) else F.expr(re.sub(r"\s+ASC$", "", o, flags=re.I)).asc_nulls_last() for o in split_top(m["order"])])
        return out.limit(int(m["limit"])) if m["limit"] else out

    def _copy(self, what: str, way: str, path: str, options: str) -> DataFrame:
        opts = {k.lower(): v for k, v in re.findall(r"(\w+)\s*=\s*'([^']*)'", options)}
        kind = opts.pop("format", "parquet").lower()
        if way == "TO":
            df = self.sql(what[1:-1]) if what.startswith("(") else self.spark.table(what)
            files.write(df, path, kind, opts)
            return self.spark.createDataFrame([(path,)], "path string")
        target = self.tables[what]
        df = target.df if isinstance(target, TimeSeriesTable) else target
        merged = df.unionByName(files.conform(files.read(self.spark, path, kind, opts), df.schema))
        if isinstance(target, TimeSeriesTable):
            target.df = merged
            self.register(what, target)
        else:
            self.register(what, merged)
        return self.spark.createDataFrame([(path,)], "path string")
