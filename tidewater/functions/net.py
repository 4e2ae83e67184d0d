"""IPv4 and IPv6 functions."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ipv4_num_to_string(n: Column) -> Column:
    n = n.cast("long")
    return F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def ipv4_string_to_num(s: Column) -> Column:
    """Null where the text is no dotted quad."""
    good = s.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
    part = F.split(F.when(good, s), r"\.")
    return sum((F.get(part, F.lit(i)).cast("long") * (256 ** (3 - i)) for i in range(1, 4)), F.get(part, F.lit(0)).cast("long") * 256**3)


def _mask(bits: Column) -> Column:
    return F.when(bits == 0, F.lit(0).cast("long")).otherwise((F.lit(2**32) - F.pow(F.lit(2), F.lit(32) - bits)).cast("long"))


def ipv4_to_cidr(s: Column, bits: Column | None = None) -> Column:
    """The network of an address; without a mask its trailing zero bytes give one."""
    n = ipv4_string_to_num(s)
    auto = F.when(n % 2**32 == 0, 0).when(n % 2**24 == 0, 8).when(n % 2**16 == 0, 16).when(n % 2**8 == 0, 24).otherwise(32)
    bits = auto if bits is None else bits
    return F.concat(ipv4_num_to_string(n.bitwiseAND(_mask(bits))), F.lit("/"), bits.cast("string"))


def ipv4_in_range(s: Column, cidr: Column) -> Column:
    net, bits = F.split_part(cidr, F.lit("/"), F.lit(1)), F.split_part(cidr, F.lit("/"), F.lit(2)).try_cast("int")
    mask = _mask(bits)
    return ipv4_string_to_num(s).bitwiseAND(mask) == ipv4_string_to_num(net).bitwiseAND(mask)


def _each(f, kind: T.DataType):
    def safe(*values):
        try:
            return None if any(v is None for v in values) else f(*values)
        except ValueError:
            return None

    @F.pandas_udf(kind)
    def one(a: pd.Series) -> pd.Series:
        return pd.Series([safe(x) for x in a], dtype=object)

    @F.pandas_udf(kind)
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([safe(x, y) for x, y in zip(a, b)], dtype=object)

    return one, two


ipv6_num_to_string = _each(lambda h: str(ipaddress.IPv6Address(int(h, 16))), T.StringType())[0]
ipv6_string_to_num = _each(lambda s: ipaddress.IPv6Address(s).packed.hex(), T.StringType())[0]
ipv6_to_cidr = _each(lambda s, bits: str(ipaddress.IPv6Network((s, int(bits)), strict=False)), T.StringType())[1]
ipv6_in_range = _each(lambda s, cidr: ipaddress.IPv6Address(s) in ipaddress.IPv6Network(cidr, strict=False), T.BooleanType())[1]
