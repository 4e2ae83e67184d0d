"""Scalar functions whose meaning differs from Spark's function of that name, or that Spark lacks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%p": "a", "%I": "hh", "%f": "SSSSSS", "%3f": "SSS", "%6f": "SSSSSS", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%%": "%"}


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNotNull() & low.isNotNull() & high.isNotNull(), F.greatest(low, F.least(high, x)))


def clamp_min(x: Column, low: Column) -> Column:
    return F.when(x.isNotNull() & low.isNotNull(), F.greatest(low, x))


def clamp_max(x: Column, high: Column) -> Column:
    return F.when(x.isNotNull() & high.isNotNull(), F.least(high, x))


def mod(a: Column, b: Column) -> Column:
    return F.when(b != 0, a % F.when(b != 0, b))


def if_(condition: Column, yes: Column, no: Column) -> Column:
    """Numbers other than 0 are true; null is false."""
    return F.when(F.coalesce(condition.cast("double") != 0, F.lit(False)), yes).otherwise(no)


def gcd(a: Column, b: Column) -> Column:
    """Euclid's steps: 92 are enough for 64-bit numbers."""
    start = F.struct(F.abs(a.cast("long")).alias("a"), F.abs(b.cast("long")).alias("b"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(s["a"] % F.when(s["b"] != 0, s["b"])).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])


def date_format(ts: Column, fmt: str) -> Column:
    """strftime patterns."""
    out = []
    for piece in re.findall(r"%\d?[A-Za-z%]|[^%]+", fmt):
        if piece.startswith("%"):
            if piece not in STRFTIME:
                raise ValueError(f"unsupported pattern {piece}")
            out.append(STRFTIME[piece])
        else:
            out.append(re.sub("[A-Za-z]+", r"'\g<0>'", piece))
    return F.date_format(ts, "".join(out))


def to_unixtime(x: Column) -> Column:
    return F.floor(F.unix_micros(x.cast("timestamp")) / 1_000_000)


def date_bin(interval_us: int, ts: Column, origin_us: int = 0) -> Column:
    past = F.unix_micros(ts.cast("timestamp")) - origin_us
    return F.timestamp_micros(past - F.pmod(past, F.lit(interval_us)) + origin_us)


def elt(n: Column, *texts: Column) -> Column:
    return F.when(n >= 1, F.try_element_at(F.array(*texts), n.cast("int")))


def field(s: Column, *texts: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*texts), s), F.lit(0)).cast("long")


def format_number(x: Column, digits: int) -> Column:
    digits = min(max(digits, 0), 30)
    return F.format_number(F.round(x, digits), digits)


def insert(s: Column, pos: Column, length: Column, new: Column) -> Column:
    inside = (pos >= 1) & (pos <= F.length(s))
    rest = F.when((length < 0) | (pos + length > F.length(s)), F.lit("")).otherwise(F.substr(s, pos + length, F.length(s)))
    return F.when(inside, F.concat(F.substr(s, F.lit(1), pos - 1), new, rest)).otherwise(F.when(pos.isNotNull() & length.isNotNull() & new.isNotNull(), s))


def regexp_extract(s: Column, pattern: str) -> Column:
    """The first match as a whole; null if there is none."""
    return F.regexp_substr(s, F.lit(pattern))


def concat(*parts: Column) -> Column:
    """Nulls are skipped."""
    return F.concat_ws("", *parts)


def matches_term(text: Column, term: str) -> Column:
    """Exact term at ASCII word bounds; Han text needs no bounds; an empty term matches an empty text."""
    if not term:
        return text == ""
    if re.search(r"[一-鿿]", term):
        return F.contains(text, F.lit(term))
    left = r"(?<![A-Za-z0-9_])" if re.match(r"\w", term, re.A) else ""
    right = r"(?![A-Za-z0-9_])" if re.search(r"\w\Z", term, re.A) else ""
    return text.rlike(left + re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", term) + right)


def match_query(query: str) -> tuple:
    """Tree of a full-text query: ("term", text), ("not", node), ("and" | "or", nodes).

    Terms, "phrases", AND, OR, NOT, +must, -not and parentheses. Terms side by side:
    musts and nots bind, the rest needs one hit unless a must is there.
    """
    toks = re.findall(r'"[^"]*"|[()]|[+-]?[^\s()"]+|[+-](?=["(])', query)
    at = 0

    def unit() -> tuple[str, tuple]:
        nonlocal at
        t = toks[at]
        at += 1
        if t in "+-" or t.upper() == "NOT":
            return ("-" if t != "+" else "+"), unit()[1]
        if t == "(":
            inner = either()
            at += 1
            return "", inner
        if t[0] in "+-" and len(t) > 1:
            return t[0], ("term", t[1:].strip('"'))
        return "", ("term", t.strip('"'))

    def group() -> tuple:
        nonlocal at
        must, never, may = [], [], []
        while at < len(toks) and toks[at] != ")" and toks[at].upper() != "OR":
            if toks[at].upper() == "AND":
                at += 1
                sign, right = unit()
                if sign == "-":
                    never.append(right)
                else:
                    left = may.pop() if may else must.pop()
                    may.append(("and", [left, right]))
                continue
            sign, node = unit()
            {"+": must, "-": never, "": may}[sign].append(node)
        some = [("or", may)] if may and not must else []
        return "and", must + [("not", n) for n in never] + some

    def either() -> tuple:
        nonlocal at
        parts = [group()]
        while at < len(toks) and toks[at].upper() == "OR":
            at += 1
            parts.append(group())
        return "or", parts

    return either()


def matches(text: Column, query: str) -> Column:
    """Boolean full-text query over a text, ignoring case."""
    low = F.lower(text)

    def column(node: tuple) -> Column:
        if node[0] == "term":
            return F.contains(low, F.lit(node[1].lower()))
        if node[0] == "not":
            return ~column(node[1])
        out = None
        for part in map(column, node[1]):
            out = part if out is None else (out & part if node[0] == "and" else out | part)
        return F.lit(True) if out is None else out

    return column(match_query(query))


def json_get(j: Column, path: str, kind: str) -> Column:
    """Typed value at a path of a JSON text; null on mismatch. kind: int, float, string, bool or object."""
    path = path if path.startswith("$") else f"$.{path}"
    types = {"int": "bigint", "float": "double", "string": "string", "bool": "boolean"}
    if kind == "object":
        return F.get_json_object(j, path)
    return F.try_variant_get(F.try_parse_json(j), path, types[kind])


def json_is(j: Column, kind: str) -> Column:
    """Type test of a JSON text: null, int, float, string, bool, array or object."""
    schema = F.schema_of_variant(F.try_parse_json(j))
    tests = {"null": schema == "VOID", "int": schema == "BIGINT", "float": schema.startswith("DECIMAL") | (schema == "DOUBLE"), "string": schema == "STRING", "bool": schema == "BOOLEAN", "array": schema.startswith("ARRAY"), "object": schema.startswith("OBJECT")}
    return tests[kind]


def json_object_keys(j: Column) -> Column:
    return F.json_object_keys(j)


def json_path_exists(j: Column, path: str) -> Column:
    return F.when(j.isNotNull(), F.get_json_object(j, path).isNotNull() | F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(j), path, "variant")) == "VOID", F.lit(False)))
