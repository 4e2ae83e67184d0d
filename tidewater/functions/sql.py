"""Functions of the SQL dialect as text over Spark's own functions, so that Catalyst sees plain expressions.

``MACROS`` maps a name to a maker of Spark SQL from the texts of the arguments.
Arguments that are constants (paths, patterns, queries, intervals) are read when
the statement is translated.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from tidewater.functions.scalars import STRFTIME, match_query


class SqlFunctionError(ValueError):
    """A call that the dialect does not allow."""


def constant(text: str) -> str:
    """The value of a quoted text."""
    text = text.strip()
    if not re.fullmatch(r"'(?:[^']|'')*'", text, re.S):
        raise SqlFunctionError(f"a constant text is needed, not {text}")
    return text[1:-1].replace("''", "'")


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fill(template: str) -> Callable[[list[str]], str]:
    """A maker from a template with {0}, {1}, ...; the arguments stand in parentheses."""
    wanted = 1 + max((int(k) for k in re.findall(r"\{(\d+)\}", template)), default=-1)

    def make(args: list[str]) -> str:
        if len(args) != wanted:
            raise SqlFunctionError(f"{wanted} arguments are needed, not {len(args)}")
        return "(" + re.sub(r"\{(\d+)\}", lambda m: f"({args[int(m[1])]})", template) + ")"

    return make


def renamed(name: str) -> Callable[[list[str]], str]:
    return lambda args: f"{name}({', '.join(args)})"


def optional(few: Callable, more: Callable, at: int) -> Callable[[list[str]], str]:
    """``few`` up to ``at`` arguments, ``more`` beyond."""
    return lambda args: few(args) if len(args) <= at else more(args)


def _json_path(text: str) -> str:
    path = constant(text)
    return path if path.startswith("$") else f"$.{path}"


def _json_get(kind: str) -> Callable[[list[str]], str]:
    return lambda args: f"try_variant_get(try_parse_json({args[0]}), {quoted(_json_path(args[1]))}, '{kind}')"


def _json_is(test: str) -> Callable[[list[str]], str]:
    return lambda args: f"(schema_of_variant(try_parse_json({args[0]})) {test})"


def _json_object(args: list[str]) -> str:
    """Duplicate keys: the last one wins; values keep their type."""
    if len(args) % 2:
        raise SqlFunctionError("json_object needs pairs of a key and a value")
    last = {}
    for key, value in zip(args[::2], args[1::2]):
        last[key.strip()] = value
    return f"to_json(named_struct({', '.join(f'{k}, {v}' for k, v in last.items())}), map('ignoreNullFields', 'false'))" if last else "'{}'"


OPERATORS = {"==": "=", "=": "=", "!=": "<>", "<>": "<>", "<": "<", "<=": "<=", ">": ">", ">=": ">="}


def _json_path_match(args: list[str]) -> str:
    """Predicates of the form $.path op constant, joined by && and ||; null where the path gives nothing."""
    text = constant(args[1])

    def one(part: str) -> str:
        m = re.fullmatch(r"\s*(\$[\w.\[\]*'\"]*)\s*(==|=|!=|<>|<=|>=|<|>)\s*(.+?)\s*", part)
        if not m:
            raise SqlFunctionError(f"cannot read the predicate {part!r}")
        path, op, value = m[1], OPERATORS[m[2]], m[3]
        if re.fullmatch(r"-?\d+(?:\.\d+)?", value):
            kind, literal = "double", f"{value}D"
        elif value.lower() in ("true", "false"):
            kind, literal = "boolean", value
        elif value.lower() == "null":
            return f"(schema_of_variant(try_variant_get(try_parse_json({args[0]}), {quoted(path)}, 'variant')) {op} 'VOID')"
        else:
            kind, literal = "string", quoted(value.strip("\"'"))
        return f"(try_variant_get(try_parse_json({args[0]}), {quoted(path)}, '{kind}') {op} {literal})"

    return "(" + " OR ".join(" AND ".join(one(p) for p in either.split("&&")) for either in text.split("||")) + ")"


def _date_format(args: list[str]) -> str:
    pattern, out = constant(args[1]), []
    for piece in re.findall(r"%\d?[A-Za-z%]|[^%]+", pattern):
        if piece.startswith("%") and piece not in STRFTIME:
            raise SqlFunctionError(f"unsupported pattern {piece}")
        out.append(STRFTIME[piece] if piece.startswith("%") else re.sub("[A-Za-z]+", r"'\g<0>'", piece))
    return f"date_format({args[0]}, {quoted(''.join(out))})"


UNIT_US = {"microsecond": 1, "millisecond": 1000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6, "week": 7 * 86400 * 10**6}


def interval_us(text: str) -> int:
    """Microseconds of INTERVAL '5 minutes', '5 minutes', INTERVAL 5 MINUTE or '5m'."""
    body = re.sub(r"^\s*INTERVAL\b", "", text.strip(), flags=re.I).replace("'", " ").strip().lower()
    short = {"us": "microsecond", "ms": "millisecond", "s": "second", "m": "minute", "h": "hour", "d": "day", "w": "week"}
    total, rest = 0.0, re.sub(r"(\d+(?:\.\d+)?)\s*([a-z]+)", lambda m: "", body).strip()
    for n, unit in re.findall(r"(\d+(?:\.\d+)?)\s*([a-z]+)", body):
        unit = short.get(unit, unit.rstrip("s") if unit not in short else unit)
        if unit not in UNIT_US:
            raise SqlFunctionError(f"unknown unit {unit}")
        total += float(n) * UNIT_US[unit]
    if rest or total <= 0:
        raise SqlFunctionError(f"cannot read the interval {text}")
    return int(total)


def _date_bin(args: list[str]) -> str:
    step = interval_us(args[0])
    origin = f"unix_micros(CAST({args[2]} AS TIMESTAMP))" if len(args) > 2 else "0L"
    return f"timestamp_micros(unix_micros(CAST({args[1]} AS TIMESTAMP)) - pmod(unix_micros(CAST({args[1]} AS TIMESTAMP)) - {origin}, {step}L))"


def _matches(args: list[str]) -> str:
    def text(node) -> str:
        kind, *rest = node
        if kind == "term":
            return f"contains(lower({args[0]}), {quoted(rest[0].lower())})"
        if kind == "not":
            return f"(NOT {text(rest[0])})"
        return "(" + f" {kind.upper()} ".join(map(text, rest[0])) + ")" if rest[0] else "true"

    return text(match_query(constant(args[1])))


def _matches_term(args: list[str]) -> str:
    term = constant(args[1])
    if not term:
        return f"({args[0]} = '')"
    if re.search(r"[一-鿿]", term):
        return f"contains({args[0]}, {quoted(term)})"
    left = r"(?<![A-Za-z0-9_])" if re.match(r"\w", term, re.A) else ""
    right = r"(?![A-Za-z0-9_])" if re.search(r"\w\Z", term, re.A) else ""
    return f"({args[0]} RLIKE {quoted(left + re.sub(r'([^A-Za-z0-9_\s])', r'\\\1', term) + right)})"


DOT = "aggregate(zip_with({0}, {1}, (tw_x, tw_y) -> CAST(tw_x AS DOUBLE) * CAST(tw_y AS DOUBLE)), 0D, (tw_s, tw_v) -> tw_s + tw_v)"
NORM = "sqrt(aggregate({%d}, 0D, (tw_s, tw_v) -> tw_s + CAST(tw_v AS DOUBLE) * CAST(tw_v AS DOUBLE)))"
SAME = "IF(size({0}) = size({1}), %s, NULL)"
PAIR = SAME % "zip_with({0}, {1}, (tw_x, tw_y) -> CAST(%s AS FLOAT))"
FOLD = "aggregate(transform({0}, tw_x -> CAST(tw_x AS DOUBLE)), %s, (tw_s, tw_v) -> tw_s %s tw_v)"
BYTE = r"(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)"
QUAD = f"^{BYTE}\\\\.{BYTE}\\\\.{BYTE}\\\\.{BYTE}$"
IP4 = f"IF({{0}} RLIKE '{QUAD}', aggregate(split({{0}}, '\\\\.'), 0L, (tw_s, tw_v) -> tw_s * 256 + try_cast(tw_v AS BIGINT)), NULL)"
TO4 = "concat_ws('.', CAST(shiftright({0}, 24) & 255 AS STRING), CAST(shiftright({0}, 16) & 255 AS STRING), CAST(shiftright({0}, 8) & 255 AS STRING), CAST({0} & 255 AS STRING))"
MASK = "IF({0} = 0, 0L, 4294967296L - CAST(pow(2, 32 - {0}) AS BIGINT))"
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def _inline(template: str, *args: str) -> str:
    return fill(template)(list(args))


def _ipv4_to_cidr(args: list[str]) -> str:
    n = _inline(IP4, args[0])
    bits = args[1] if len(args) > 1 else f"CASE WHEN {n} % 4294967296 = 0 THEN 0 WHEN {n} % 16777216 = 0 THEN 8 WHEN {n} % 65536 = 0 THEN 16 WHEN {n} % 256 = 0 THEN 24 ELSE 32 END"
    return f"concat({_inline(TO4, f'{n} & {_inline(MASK, bits)}')}, '/', CAST({bits} AS STRING))"


def _ipv4_in_range(args: list[str]) -> str:
    net, mask = f"split_part({args[1]}, '/', 1)", _inline(MASK, f"try_cast(split_part({args[1]}, '/', 2) AS INT)")
    return f"({_inline(IP4, args[0])} & {mask} = {_inline(IP4, net)} & {mask})"


def _geohash(args: list[str]) -> str:
    lat, lon, length = args
    n = int(length)
    if not 0 < n <= 12:
        raise SqlFunctionError("geohash takes 1 to 12 characters")
    bits = 5 * n
    n_lon, n_lat = (bits + 1) // 2, bits // 2
    x = f"CAST(least(floor((({lon}) + 180D) / 360D * {2**n_lon}L), {2**n_lon - 1}L) AS BIGINT)"
    y = f"CAST(least(floor((({lat}) + 90D) / 180D * {2**n_lat}L), {2**n_lat - 1}L) AS BIGINT)"
    letters = []
    for c in range(n):
        parts = []
        for k in range(5):
            i = 5 * c + k
            source, shift = (x, n_lon - 1 - i // 2) if i % 2 == 0 else (y, n_lat - 1 - i // 2)
            parts.append(f"shiftleft(shiftright({source}, {shift}) & 1, {4 - k})")
        letters.append(f"substr('{BASE32}', CAST({' + '.join(parts)} + 1 AS INT), 1)")
    return f"concat({', '.join(letters)})"


# Fixed values of the S2 curve: the place of each quadrant (2i + j) on the curve by orientation, and how each place turns it.
S2_PLACES = "array(array(0, 1, 3, 2), array(0, 3, 1, 2), array(2, 3, 1, 0), array(2, 1, 3, 0))"
S2_TURNS = "array(1, 0, 0, 3)"


def _s2_cell(args: list[str]) -> str:
    """The leaf cell of a point as the 64 bits of a BIGINT; null outside the valid degrees."""
    if len(args) != 2:
        raise SqlFunctionError("s2_latlng_to_cell takes a latitude and a longitude")
    let = lambda value, name, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    square = lambda u: f"IF({u} >= 0, 0.5D * sqrt(1 + 3 * {u}), 1 - 0.5D * sqrt(1 - 3 * {u}))"
    grid = lambda u: f"CAST(least(greatest(floor({square(u)} * 1073741824D), 0L), 1073741823L) AS BIGINT)"
    degrees = f"named_struct('a', radians(CAST({args[0]} AS DOUBLE)), 'o', radians(CAST({args[1]} AS DOUBLE)))"
    point = "named_struct('x', cos(tw_d.a) * cos(tw_d.o), 'y', cos(tw_d.a) * sin(tw_d.o), 'z', sin(tw_d.a))"
    axis = "CASE WHEN abs(tw_p.x) > abs(tw_p.y) AND abs(tw_p.x) > abs(tw_p.z) THEN IF(tw_p.x < 0, 3, 0) WHEN abs(tw_p.x) <= abs(tw_p.y) AND abs(tw_p.y) > abs(tw_p.z) THEN IF(tw_p.y < 0, 4, 1) ELSE IF(tw_p.z < 0, 5, 2) END"
    u = "CASE tw_f WHEN 0 THEN tw_p.y / tw_p.x WHEN 1 THEN -tw_p.x / tw_p.y WHEN 2 THEN -tw_p.x / tw_p.z WHEN 3 THEN tw_p.z / tw_p.x WHEN 4 THEN tw_p.z / tw_p.y ELSE -tw_p.y / tw_p.z END"
    v = "CASE tw_f WHEN 0 THEN tw_p.z / tw_p.x WHEN 1 THEN tw_p.z / tw_p.y WHEN 2 THEN -tw_p.y / tw_p.z WHEN 3 THEN tw_p.y / tw_p.x WHEN 4 THEN -tw_p.x / tw_p.y ELSE -tw_p.x / tw_p.z END"
    place = f"get(get({S2_PLACES}, tw_s.t), CAST(2 * (shiftright(tw_g.i, tw_k) & 1) + (shiftright(tw_g.j, tw_k) & 1) AS INT))"
    step = let(place, "tw_q", f"named_struct('t', tw_s.t ^ get({S2_TURNS}, tw_q), 'n', tw_s.n * 4 + tw_q)")
    walk = f"aggregate(sequence(29, 0, -1), named_struct('t', tw_f & 1, 'n', CAST(0 AS BIGINT)), (tw_s, tw_k) -> {step}, tw_s -> shiftleft(CAST(tw_f AS BIGINT), 61) | shiftleft(tw_s.n, 1) | 1L)"
    cell = let(f"named_struct('u', {u}, 'v', {v})", "tw_w", let(f"named_struct('i', {grid('tw_w.u')}, 'j', {grid('tw_w.v')})", "tw_g", walk))
    inside = f"abs(CAST({args[0]} AS DOUBLE)) <= 90 AND abs(CAST({args[1]} AS DOUBLE)) <= 180"
    return f"IF({inside}, {let(degrees, 'tw_d', let(point, 'tw_p', let(axis, 'tw_f', cell)))}, NULL)"


def _sphere(args: list[str]) -> str:
    """Great-circle metres between two WKT points."""
    lon, lat = (lambda w, i=i: f"CAST(regexp_extract({w}, 'POINT\\\\s*\\\\(\\\\s*(\\\\S+)\\\\s+([^\\\\s)]+)', {i}) AS DOUBLE)" for i in (1, 2))
    a, b = args
    half = f"pow(sin(radians({lat(b)} - {lat(a)}) / 2), 2) + cos(radians({lat(a)})) * cos(radians({lat(b)})) * pow(sin(radians({lon(b)} - {lon(a)}) / 2), 2)"
    return f"(2 * 6371008.8D * asin(least(1D, sqrt({half}))))"


def _plane(args: list[str]) -> str:
    """Distance of two WKT points in the plane."""
    at = lambda w, i: f"CAST(regexp_extract({w}, 'POINT\\\\s*\\\\(\\\\s*(\\\\S+)\\\\s+([^\\\\s)]+)', {i}) AS DOUBLE)"
    a, b = args
    return f"sqrt(pow({at(a, 1)} - {at(b, 1)}, 2) + pow({at(a, 2)} - {at(b, 2)}, 2))"


PATH = "array_sort(collect_list(named_struct('t', {2}, 'lat', CAST({0} AS DOUBLE), 'lng', CAST({1} AS DOUBLE))))"
COUNT_KEY = "count(DISTINCT xxhash64(%s))"

MACROS: dict[str, Callable[[list[str]], str]] = {
    # vectors
    "parse_vec": fill("from_json({0}, 'array<float>')"),
    "vec_to_string": fill("concat('[', array_join(transform({0}, tw_x -> IF(tw_x = floor(tw_x), format_string('%.0f', CAST(tw_x AS DOUBLE)), CAST(tw_x AS STRING))), ','), ']')"),
    "vec_dot_product": fill(SAME % DOT),
    "vec_l2sq_distance": fill(SAME % "aggregate(zip_with({0}, {1}, (tw_x, tw_y) -> pow(CAST(tw_x AS DOUBLE) - CAST(tw_y AS DOUBLE), 2)), 0D, (tw_s, tw_v) -> tw_s + tw_v)"),
    "vec_cos_distance": fill(SAME % f"IF({NORM % 0} * {NORM % 1} = 0, 1D, 1D - {DOT} / nullif({NORM % 0} * {NORM % 1}, 0))"),
    "vec_scalar_add": fill("transform({1}, tw_x -> CAST(tw_x + {0} AS FLOAT))"),
    "vec_scalar_mul": fill("transform({1}, tw_x -> CAST(tw_x * {0} AS FLOAT))"),
    "vec_add": fill(PAIR % "tw_x + tw_y"),
    "vec_sub": fill(PAIR % "tw_x - tw_y"),
    "vec_mul": fill(PAIR % "tw_x * tw_y"),
    "vec_div": fill(PAIR % "tw_x / nullif(tw_y, 0)"),
    "vec_norm": fill(f"transform({{0}}, tw_x -> CAST(tw_x / nullif({NORM % 0}, 0) AS FLOAT))"),
    "vec_dim": fill("IF({0} IS NULL, NULL, CAST(size({0}) AS BIGINT))"),
    "vec_kth_elem": fill("get({0}, {1})"),
    "vec_subvector": fill("slice({0}, {1} + 1, {2} - {1})"),
    "vec_elem_sum": fill(FOLD % ("0D", "+")),
    "vec_elem_product": fill(FOLD % ("1D", "*")),
    "vec_elem_avg": fill(f"IF(size({{0}}) > 0, {FOLD % ('0D', '+')} / size({{0}}), NULL)"),
    # addresses
    "ipv4_string_to_num": fill(IP4), "inet_aton": fill(IP4), "ipv4_num_to_string": fill(TO4), "inet_ntoa": fill(TO4), "ipv4_to_cidr": _ipv4_to_cidr, "ipv4_in_range": _ipv4_in_range,
    # JSON
    "parse_json": fill("try_parse_json({0})"), "json_to_string": fill("to_json({0})"),
    "json_get_int": _json_get("bigint"), "json_get_float": _json_get("double"), "json_get_string": _json_get("string"), "json_get_bool": _json_get("boolean"),
    "json_get_object": lambda args: f"get_json_object({args[0]}, {quoted(_json_path(args[1]))})", "json_get": lambda args: f"get_json_object({args[0]}, {quoted(_json_path(args[1]))})",
    "json_is_null": _json_is("= 'VOID'"), "json_is_int": _json_is("= 'BIGINT'"), "json_is_float": _json_is("RLIKE '^(DECIMAL|DOUBLE)'"), "json_is_string": _json_is("= 'STRING'"),
    "json_is_bool": _json_is("= 'BOOLEAN'"), "json_is_array": _json_is("LIKE 'ARRAY%'"), "json_is_object": _json_is("LIKE 'OBJECT%'"),
    "json_object": _json_object, "json_path_match": _json_path_match,
    "json_path_exists": lambda args: f"(schema_of_variant(try_variant_get(try_parse_json({args[0]}), {quoted(_json_path(args[1]))}, 'variant')) IS NOT NULL)",
    # numbers
    "clamp": fill("IF({0} IS NULL OR {1} IS NULL OR {2} IS NULL, NULL, greatest({1}, least({2}, {0})))"), "clamp_min": fill("IF({0} IS NULL OR {1} IS NULL, NULL, greatest({1}, {0}))"),
    "clamp_max": fill("IF({0} IS NULL OR {1} IS NULL, NULL, least({1}, {0}))"),
    "gcd": fill("aggregate(sequence(1, 92), named_struct('a', abs(CAST({0} AS BIGINT)), 'b', abs(CAST({1} AS BIGINT))), (tw_s, tw_v) -> named_struct('a', IF(tw_s.b = 0, tw_s.a, tw_s.b), 'b', IF(tw_s.b = 0, 0L, tw_s.a % nullif(tw_s.b, 0))), tw_s -> tw_s.a)"),
    # times
    "date_format": _date_format, "date_bin": _date_bin, "to_unixtime": fill("CAST(floor(unix_micros(CAST({0} AS TIMESTAMP)) / 1000000D) AS BIGINT)"),
    "to_timestamp_millis": fill("timestamp_millis({0})"), "to_timestamp_micros": fill("timestamp_micros({0})"), "to_timestamp_nanos": fill("timestamp_micros({0} div 1000)"), "to_timestamp_seconds": fill("timestamp_seconds({0})"),
    # texts
    "field": lambda args: f"CAST(coalesce(array_position(array({', '.join(args[1:])}), {args[0]}), 0) AS BIGINT)",
    "regexp_extract": optional(fill("regexp_substr({0}, {1})"), renamed("regexp_extract"), 2), "regexp_like": fill("{0} RLIKE {1}"),
    "string_to_array": fill("split({0}, concat('\\\\Q', {1}, '\\\\E'), -1)"), "mid": renamed("substr"), "octet_length": renamed("octet_length"), "strpos": renamed("instr"), "array_to_string": renamed("array_join"),
    "matches": _matches, "matches_term": _matches_term,
    # other names
    "arrow_typeof": renamed("typeof"), "ucase": renamed("upper"), "lcase": renamed("lower"), "ifnull": renamed("coalesce"),
    "std": renamed("stddev_pop"), "variance": renamed("var_samp"), "var": renamed("var_samp"), "var_sample": renamed("var_samp"), "var_population": renamed("var_pop"), "stddev_population": renamed("stddev_pop"),
    "version": lambda args: "'tidewater'", "build": lambda args: "'tidewater'", "database": renamed("current_database"), "timezone": lambda args: "current_timezone()",
    "connection_id": lambda args: "CAST(0 AS INT)", "pg_backend_pid": lambda args: "CAST(0 AS BIGINT)", "read_preference": lambda args: "'LEADER'",
    # aggregates
    "approx_distinct": renamed("approx_count_distinct"), "approx_median": fill("percentile_approx({0}, 0.5D, 100000)"),
    "approx_percentile_cont": optional(fill("percentile_approx({0}, {1}, 100000)"), lambda args: fill("percentile_approx({0}, {1}, 100000)")(args[:2]), 2),
    "approx_percentile_cont_with_weight": fill("percentile({0}, {2}, CAST({1} AS BIGINT))"),
    "hll": fill("hll_sketch_agg({0}, 14)"), "hll_merge": renamed("hll_union_agg"), "hll_count": renamed("hll_sketch_estimate"), "count_hash": lambda args: COUNT_KEY % ", ".join(args),
    "geo_path": fill(f"transform({PATH}, tw_p -> named_struct('lat', tw_p.lat, 'lng', tw_p.lng))"),
    "json_encode_path": fill(f"to_json(transform({PATH}, tw_p -> array(tw_p.lng, tw_p.lat)))"),
    # places
    "geohash": _geohash, "wkt_point_from_latlng": fill("concat('POINT(', CAST({1} AS STRING), ' ', CAST({0} AS STRING), ')')"), "st_distance_sphere_m": _sphere, "st_distance": _plane,
    "s2_latlng_to_cell": _s2_cell,
    "s2_cell_level": fill("CAST(30 - (length(bin({0} & -({0}))) - 1) div 2 AS INT)"),
    "s2_cell_parent": fill("(({0} & -(shiftleft(1L, 2 * (30 - {1})))) | shiftleft(1L, 2 * (30 - {1})))"),
    "s2_cell_to_token": fill("regexp_replace(lower(lpad(hex({0}), 16, '0')), '0+$', '')"),
}
