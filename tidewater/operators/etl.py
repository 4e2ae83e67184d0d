"""Log pipelines: an ordered list of processors over string fields, each a DataFrame transform."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.scalars import STRFTIME

CMCD_INT = ("br", "bl", "d", "dl", "mtp", "rtp", "tb")
CMCD_BOOL = ("bs", "su")
CMCD_TEXT = ("cid", "nor", "nrr", "ot", "sf", "sid", "st", "v")
CMCD_FLOAT = ("pr",)


class PipelineError(ValueError):
    """The pipeline is not valid."""


def _fields(spec: dict) -> list[tuple[str, str]]:
    """(source, target) of each field; "a, b" renames a to b."""
    names = spec.get("fields") or ([spec["field"]] if "field" in spec else [])
    return [tuple(x.strip() for x in n.split(",", 1)) if "," in n else (n, n) for n in names]


def _java_time(fmt: str) -> str:
    return "".join(STRFTIME[p] if p.startswith("%") else re.sub("[A-Za-z]+", r"'\g<0>'", p) for p in re.findall(r"%\d?[A-Za-z%]|[^%]+", fmt))


def _cmcd(df, spec):
    for src, dst in _fields(spec):
        parts = F.split(F.col(src), ",")
        entries = F.map_from_entries(F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)), F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("true"))))
        m = F.when(F.col(src).isNotNull(), entries)
        cols = {}
        for k in (*CMCD_INT, *CMCD_BOOL, *CMCD_TEXT, *CMCD_FLOAT):
            raw = F.regexp_replace(m[k], '^"|"$', "")
            kind = "bigint" if k in CMCD_INT else "boolean" if k in CMCD_BOOL else "double" if k in CMCD_FLOAT else "string"
            cols[f"{dst}_{k}"] = raw.try_cast(kind)
        df = df.withColumns(cols)
    return df


def _csv(df, spec):
    quote, sep = spec.get("quote", '"'), spec.get("separator", ",")
    for src, _ in _fields(spec):
        names = spec["target_fields"]
        schema = ", ".join(f"`{n}` string" for n in names)
        options = {"sep": sep, "quote": quote, "ignoreLeadingWhiteSpace": str(spec.get("trim", False)).lower(), "ignoreTrailingWhiteSpace": str(spec.get("trim", False)).lower()}
        df = df.withColumn("_c", F.from_csv(F.col(src), schema, options)).select("*", "_c.*").drop("_c")
    return df


def _date(df, spec):
    for src, dst in _fields(spec):
        tries = [F.try_to_timestamp(F.col(src), F.lit(_java_time(f))) for f in spec["formats"]]
        out = F.coalesce(*tries)
        df = df.withColumn(dst, F.to_utc_timestamp(out, spec["timezone"]) if spec.get("timezone") else out)
    return df


def _epoch(df, spec):
    unit = {"s": 1_000_000, "sec": 1_000_000, "second": 1_000_000, "ms": 1_000, "millisecond": 1_000, "milli": 1_000, "us": 1, "microsecond": 1, "micro": 1}.get(spec.get("resolution", "ms"))
    for src, dst in _fields(spec):
        n = F.col(src).try_cast("bigint")
        df = df.withColumn(dst, F.timestamp_micros(n * unit if unit else F.expr(f"try_cast(`{src}` as bigint) div 1000")))
    return df


# Names and patterns of the digest presets, which pipelines in use rely on.
DIGEST = {
    "numbers": r"\d+",
    "quoted": r"[\"'“”‘’][^\"'“”‘’]*[\"'“”‘’]",
    "bracketed": r"[({\[<「『【〔［｛〈《][^(){}\[\]<>「」『』【】〔〕［］｛｝〈〉《》]*[)}\]>」』】〕］｝〉》]",
    "uuid": r"\b[0-9a-fA-F]{8}\b-[0-9a-fA-F]{4}\b-[0-9a-fA-F]{4}\b-[0-9a-fA-F]{4}\b-[0-9a-fA-F]{12}\b",
    "ip": r"((\d{1,3}\.){3}\d{1,3}(:\d+)?|(\[[0-9a-fA-F:]+\])(:\d+)?)",
}


def _digest(df, spec):
    presets = spec.get("presets", [])
    if unknown := [p for p in presets if p not in DIGEST]:
        raise PipelineError(f"unknown digest presets: {', '.join(map(str, unknown))}")
    for src, dst in _fields(spec):
        out = F.col(src)
        for p in [DIGEST[x] for x in presets] + list(spec.get("regex", [])):
            out = F.regexp_replace(out, p, "")
        df = df.withColumn(f"{dst}_digest", out)
    return df


def dissect_regex(pattern: str) -> tuple[str, list[str]]:
    """Regex and names of a dissect pattern: %{a}, %{?skip}, %{}, %{+append}, %{a->} for padding."""
    out, names = "", []
    for lit, key in re.findall(r"([^%]*(?:%(?!\{)[^%]*)*)(?:%\{([^}]*)\})?", pattern):
        out += re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", lit)
        if key or "%{" + key + "}" in pattern and (lit + "%{" + key + "}") in pattern:
            pad = key.endswith("->")
            key = key.removesuffix("->")
            names.append("" if key.startswith("?") or not key else key)
            out += "(.*?)" + (" *" if pad else "")
    return f"^{out}$", names


def _dissect(df, spec):
    for src, _ in _fields(spec):
        cols: dict[str, Column] = {}
        for pattern in spec.get("patterns") or [spec["pattern"]]:
            regex, names = dissect_regex(pattern)
            hit = F.col(src).rlike(regex)
            joined: dict[str, list] = {}
            for i, n in enumerate(names, 1):
                if n:
                    joined.setdefault(n.lstrip("+").split("/")[0], []).append(F.regexp_extract(F.col(src), regex, i))
            for n, parts in joined.items():
                value = F.when(hit, F.concat_ws(spec.get("append_separator", ""), *parts))
                cols[n] = F.coalesce(cols[n], value) if n in cols else value
        df = df.withColumns(cols)
    return df


def _filter(df, spec):
    values = [str(t) for t in spec["targets"]]
    keep_case = spec.get("case_sensitive", False)
    for src, _ in _fields(spec):
        col = F.col(src).cast("string")
        hit = col.isin(values) if keep_case else F.lower(col).isin([v.lower() for v in values])
        hit = F.coalesce(hit, F.lit(False))
        hit = ~hit if spec.get("match_op", "in") in ("not_in", "notin") else hit
        df = df.where(~hit if spec.get("mode", "simple") != "keep" else hit)
    return df


def _regex(df, spec):
    for src, dst in _fields(spec):
        for pattern in spec.get("patterns") or [spec["pattern"]]:
            names = re.findall(r"\(\?P?<([A-Za-z_]\w*)>", pattern)
            java = re.sub(r"\(\?P<", "(?<", pattern)
            index = re.compile(re.sub(r"\(\?<(?=[A-Za-z_])", "(?P<", java)).groupindex
            plain = _plain(java)
            df = df.withColumns({f"{dst}_{n}": F.when(F.col(src).rlike(plain), F.regexp_extract(F.col(src), plain, index[n])) for n in names})
    return df


def _plain(pattern: str) -> str:
    """Named groups as plain ones: Java names hold no underscore."""
    return re.sub(r"\(\?<[A-Za-z_]\w*>", "(", pattern)


def _each(spec, df, f):
    return df.withColumns({dst: f(F.col(src)) for src, dst in _fields(spec)})


def _url_encode(c: Column) -> Column:
    """Per cent encoding: a space is %20, and of the signs only - . _ ~ stay."""
    form = F.url_encode(c)
    return F.replace(F.replace(F.replace(form, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _url_decode(c: Column) -> Column:
    """A plus is itself; a text with a broken escape stays."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def _select(df, spec):
    names = _fields(spec)
    if spec.get("type", "include") == "exclude":
        return df.drop(*[a for a, _ in names])
    return df.select(*[F.col(a).alias(b) for a, b in names])


PROCESSORS = {
    "cmcd": _cmcd, "csv": _csv, "date": _date, "epoch": _epoch, "timestamp": _epoch, "digest": _digest, "dissect": _dissect, "filter": _filter, "regex": _regex, "select": _select,
    "decolorize": lambda df, s: _each(s, df, lambda c: F.regexp_replace(c, "\x1b\\[[0-9;]*m", "")),
    "gsub": lambda df, s: _each(s, df, lambda c: F.regexp_replace(c, s["pattern"], s["replacement"])),
    "join": lambda df, s: _each(s, df, lambda c: F.array_join(c, s.get("separator", ","))),
    "json_parse": lambda df, s: _each(s, df, F.try_parse_json),
    "json_path": lambda df, s: _each(s, df, lambda c: F.get_json_object(c, s["json_path"])),
    "simple_extract": lambda df, s: _each(s, df, lambda c: F.get_json_object(c, "$." + s["key"])),
    "letter": lambda df, s: _each(s, df, {"upper": F.upper, "lower": F.lower, "capital": lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2**31 - 1))}[s.get("method", "lower")]),
    "urlencoding": lambda df, s: _each(s, df, _url_decode if s.get("method", "decode") == "decode" else _url_encode),
}


def run_processors(df: DataFrame, processors: list[dict]) -> DataFrame:
    """Applies [{name: options}, ...] in order. Missing fields are an error unless ignore_missing is set."""
    for item in processors:
        ((name, spec),) = item.items()
        if name == "vrl":
            raise PipelineError("vrl programs are not supported")
        if name not in PROCESSORS:
            raise PipelineError(f"unknown processor {name}")
        missing = [a for a, _ in _fields(spec) if a not in df.columns]
        if missing and not spec.get("ignore_missing"):
            raise PipelineError(f"{name}: missing field {missing[0]}")
        kept = [n for n, (a, _) in zip(spec.get("fields") or [spec.get("field")], _fields(spec)) if a not in missing]
        if kept:
            df = PROCESSORS[name](df, {k: v for k, v in spec.items() if k != "field"} | {"fields": kept})
    return df


def transform(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Casts [{fields, type, index, default, on_failure}] and keeps only their fields; roles go into column metadata."""
    out = []
    for rule in rules:
        kind = {"int32": "int", "int64": "bigint", "uint64": "decimal(20,0)", "uint32": "bigint", "float64": "double", "float32": "float", "time": "timestamp", "epoch": "timestamp", "string": "string", "boolean": "boolean", "json": "string"}
        type_ = rule["type"].split(",")[0].strip()
        for src, dst in _fields(rule):
            col = F.col(src).try_cast(kind.get(type_, type_))
            if rule.get("default") is not None:
                col = F.coalesce(col, F.lit(rule["default"]).cast(kind.get(type_, type_)))
            out.append(col.alias(dst, metadata={"index": rule["index"]} if rule.get("index") else {}))
    return df.select(*out)


def dispatch(df: DataFrame, field: str, rules: dict[str, str]) -> dict[str, DataFrame]:
    """One frame for every rule value (under its table suffix) and "" for the rest."""
    out = {suffix: df.where(F.col(field) == value) for value, suffix in rules.items()}
    out[""] = df.where(F.col(field).isNull() | ~F.col(field).isin(list(rules)))
    return out


def table_suffix(df: DataFrame, template: str, name: str = "_table") -> DataFrame:
    """Target table of each row from a template such as "_${app}"; a missing variable gives null."""
    parts = re.split(r"\$\{(\w+)\}", template)
    return df.withColumn(name, F.concat(*[F.lit(p) if i % 2 == 0 else F.col(p).cast("string") for i, p in enumerate(parts)]))
