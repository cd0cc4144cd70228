"""Scalar functions of the dialect, as column expressions; pandas functions only for hashes, inet and geometry."""

from __future__ import annotations

import ipaddress
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ------------------------------------------------------------------ operators


def true_div(a: Column, b: Column) -> Column:
    """Division of integers as a decimal."""
    return a.cast("decimal(20,0)") / b.cast("decimal(20,0)")


def trunc_div(a: Column, b: Column) -> Column:
    """// : the quotient truncated towards zero."""
    q = a / b
    return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q))


def log(x: Column, base: Column | float | None = None) -> Column:
    """Decimal logarithm, or log(x, base). Spark's ln is off in the last place for some arguments, ln(3) among them, so that of a base given as a number is C's."""
    if base is None:
        return F.log10(x)
    return F.ln(x) / (F.ln(base) if isinstance(base, Column) else F.lit(math.log(base)))


def trunc(x: Column) -> Column:
    """x without its fraction, as a double. The sign of zero, nan, infinities and doubles beyond a long stay."""
    d = x.cast("double")
    return F.when(F.abs(d) < float("inf"), F.signum(d) * F.abs((x - x % 1).cast("double"))).otherwise(d)


def round_scaled(x: Column, places: int) -> Column:
    """A double rounded as C does it, half away from zero on x * 10^places, with the sign of zero; Spark's round works on the decimal digits of x and loses that sign."""
    scaled = x * 10.0**places
    return F.when(F.abs(scaled) < float("inf"), F.signum(x) * F.abs(F.round(scaled, 0) / 10.0**places)).otherwise(x)


def checked_sqrt(x: Column) -> Column:
    return F.when(x < 0, F.raise_error(F.lit("cannot take square root of a negative number")).cast("double")).otherwise(F.sqrt(x))


def row_less(a: list[Column], b: list[Column]) -> Column:
    """Row comparison a < b by SQL rules for nulls."""
    out = F.lit(False)
    for x, y in reversed(list(zip(a, b, strict=True))):
        out = (x < y) | ((x == y) & out)
    return out


# ------------------------------------------------------------------ strings


def concat(*parts: Column) -> Column:
    """Concatenation that skips nulls."""
    return F.concat_ws("", *parts)


def regexp_replace_first(s: Column, pattern: str, to: str) -> Column:
    """Replaces the first match only; to has no group references."""
    first = F.regexp_extract(s, f"(?s)^(.*?)(?:{pattern})", 1)
    hit = s.rlike(pattern)
    rest = F.regexp_extract(s, f"(?s)^.*?(?:{pattern})(.*)$", 1)
    return F.when(hit, F.concat(first, F.lit(to), rest)).otherwise(s)


def quote_literal(s: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("''")), F.lit("'"))


def get_bit(data: Column, n: int) -> Column:
    """Bit n of bytes, the highest bit of the first byte being 0."""
    byte = F.conv(F.substring(F.hex(data), 2 * (n // 8) + 1, 2), 16, 10).cast("int")
    return F.shiftright(byte, 7 - n % 8).bitwiseAND(1)


# English digits.
DIGITS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]


def to_english(n: Column) -> Column:
    """Decimal digits of a number in words, joined by hyphens."""
    words = F.array(*[F.lit(d) for d in DIGITS])
    digits = F.filter(F.split(F.abs(n).cast("string"), ""), lambda d: d != "")
    said = F.array_join(F.transform(digits, lambda d: F.element_at(words, d.cast("int") + 1)), "-")
    return F.when(n < 0, F.concat(F.lit("minus-"), said)).otherwise(said)


# ------------------------------------------------------------------ date and time


def day_of_week(d: Column) -> Column:
    """Sunday is 0."""
    return (F.dayofweek(d) - 1).cast("double")


def date_trunc(unit: str, ts: Column) -> Column:
    """date_trunc with decades, centuries and millennia."""
    years = {"decade": 10, "century": 100, "millennium": 1000}.get(unit)
    if years is None:
        return F.date_trunc(unit, ts)
    shift = 0 if years == 10 else 1
    return F.make_timestamp_ntz((F.floor((F.year(ts) - shift) / F.lit(years)) * years + shift).cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


# Strftime directives and their pattern letters.
STRFTIME = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%p": "a",
    "%y": "yy", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%i": "mm", "%s": "ss", "%h": "hh", "%T": "HH:mm:ss",
}


def date_pattern(fmt: str) -> str:
    """The datetime pattern of a strftime format."""
    out, i = "", 0
    while i < len(fmt):
        if fmt[i] == "%" and fmt[i : i + 2] in STRFTIME:
            out += STRFTIME[fmt[i : i + 2]]
            i += 2
        else:
            out += f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i]
            i += 1
    return out


def strftime(ts: Column, fmt: str) -> Column:
    return F.date_format(ts, date_pattern(fmt))


def strptime(s: Column, fmt: str) -> Column:
    return F.to_timestamp_ntz(s, F.lit(date_pattern(fmt)))


def time_to_sec(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def age_months_days(a: Column, b: Column) -> tuple[Column, Column]:
    """Symbolic months and days from b to a, days counted in the month after the whole months."""
    months = (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)
    months = months - F.when(F.dayofmonth(a) < F.dayofmonth(b), 1).otherwise(0)
    return months, F.datediff(a, F.add_months(b, months))


# ------------------------------------------------------------------ arrays, JSON


def array_position(a: Column, x: Column) -> Column:
    return F.nullif(F.array_position(a, x), F.lit(0).cast("long"))


def array_upper(a: Column) -> Column:
    return F.nullif(F.size(a), F.lit(0))


def array_contains_all(a: Column, b: Column) -> Column:
    """a @> b; null elements never match."""
    return F.forall(b, lambda x: F.coalesce(F.array_contains(a, x), F.lit(False)))


def json_typeof(j: Column) -> Column:
    kind = F.schema_of_variant(F.parse_json(j))
    return F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number")


# ------------------------------------------------------------------ hashes


def _fnv(bits: int, mix_first: bool):
    # Offset basis and prime of the hash.
    basis, prime = {32: (2166136261, 16777619), 64: (14695981039346656037, 1099511628211)}[bits]
    kind = np.uint64

    @F.pandas_udf(T.LongType())
    def run(s: pd.Series) -> pd.Series:
        texts = [(x or "").encode() for x in s]
        size = np.array([len(t) for t in texts])
        wide = np.zeros((len(texts), size.max(initial=0)), np.uint8)
        for i, t in enumerate(texts):
            wide[i, : len(t)] = np.frombuffer(t, np.uint8)
        h = np.full(len(texts), basis, kind)
        with np.errstate(over="ignore"):
            for j in range(wide.shape[1]):  # all rows a byte at a time
                b = wide[:, j].astype(kind)
                new = (h ^ b) * kind(prime) if mix_first else (h * kind(prime)) & kind(2**bits - 1) ^ b
                h = np.where(size > j, new & kind(2**bits - 1), h)
        return pd.Series(h.view(np.int64)).where(s.notna().values)

    return run


def fnv32(s):
    return _fnv(32, False)(s)


def fnv32a(s):
    return _fnv(32, True)(s)


def fnv64(s):
    return _fnv(64, False)(s)


def fnv64a(s):
    return _fnv(64, True)(s)


def _crc32c_table() -> np.ndarray:
    poly, out = 0x82F63B78, np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(poly), out >> 1)
    return out


@F.pandas_udf(T.LongType())
def crc32c(s: pd.Series) -> pd.Series:
    table = _crc32c_table()
    texts = [(x or "").encode() for x in s]
    size = np.array([len(t) for t in texts])
    wide = np.zeros((len(texts), size.max(initial=0)), np.uint8)
    for i, t in enumerate(texts):
        wide[i, : len(t)] = np.frombuffer(t, np.uint8)
    crc = np.full(len(texts), 0xFFFFFFFF, np.uint32)
    for j in range(wide.shape[1]):
        new = table[(crc ^ wide[:, j]) & 255] ^ (crc >> 8)
        crc = np.where(size > j, new, crc)
    return pd.Series((crc ^ 0xFFFFFFFF).astype(np.int64)).where(s.notna().values)


# ------------------------------------------------------------------ inet


@F.pandas_udf(T.BooleanType())
def inet_contained(a: pd.Series, b: pd.Series) -> pd.Series:
    """a <<= b."""

    def one(x, y):
        if x is None or y is None:
            return None
        m, n = ipaddress.ip_interface(x).network, ipaddress.ip_interface(y).network
        return m.version == n.version and m.subnet_of(n)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def inet_overlap(a: Column, b: Column) -> Column:
    """a && b."""
    return inet_contained(a, b) | inet_contained(b, a)
