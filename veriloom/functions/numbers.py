"""Printed numbers: a token's text decides how far its value is known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(token: Column) -> Column:
    """The value of a token, null where it is none; thousands separators are allowed."""
    return F.replace(token, F.lit(","), F.lit("")).try_cast("double")


def places(token: Column) -> Column:
    return F.length(F.split_part(token, F.lit("."), F.lit(2)))


def half_unit(token: Column) -> Column:
    """Half a unit in the last printed place."""
    return 0.5 * F.pow(F.lit(10.0), -places(token).cast("double"))


def canonical(token: Column) -> Column:
    """0.850 as 0.85 and 60.0 as 60; a token that is no number is trimmed."""
    v = token.try_cast("double")
    plain = sub_zeros(token)
    return F.when(v.isNull(), F.trim(token)).when((v == F.floor(v)) & (F.abs(v) < 1e15), v.cast("decimal(38,0)").cast("string")).otherwise(F.coalesce(plain, v.cast("string")))


def sub_zeros(token: Column) -> Column:
    """A decimal's shortest text, from its digits, so that no exponent appears."""
    d = token.try_cast("decimal(38,18)").cast("string")
    return F.regexp_replace(F.regexp_replace(d, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def with_suffix(token: Column) -> Column:
    """A number with a thousand or million suffix, softeners before it ignored."""
    t = F.trim(F.regexp_replace(F.trim(token), "^[~≈ ]+", ""))
    last = F.upper(F.right(t, F.lit(1)))
    by = F.when(last == "K", 1e3).when(last == "M", 1e6).otherwise(1.0)
    bare = F.when(last.isin("K", "M"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    return num(F.trim(bare)) * by


def tidy(value: Column, places_: int = 3) -> Column:
    return F.format_string(f"%.{places_}f", value)


def p_text(p: Column) -> Column:
    """A p value as papers print it."""
    return F.when(p < 0.001, "< .001").otherwise(F.regexp_replace(F.format_string("%.3f", p), "^0", ""))
