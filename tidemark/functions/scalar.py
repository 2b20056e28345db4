"""Column expressions without Python: buckets of time, saturation, finite and NaN rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MIN, INT_MAX = -(2**31), 2**31 - 1
UINT_MAX = 2**32 - 1


def nanoseconds(ts: Column | str) -> Column:
    """Nanoseconds since the epoch of a timestamp (microsecond precision); the session's time zone must be UTC for timestamp_ntz."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp")) * F.lit(1000).cast("bigint")


def bucket(ns: Column, ns_per_row: int) -> Column:
    """The time row that an instant falls in; rounds down, also before the epoch."""
    ns, width = ns.cast("bigint"), F.lit(ns_per_row).cast("bigint")
    return F.call_function("div", ns - F.pmod(ns, width), width)


def cyclic_slot(ns: Column, interval_ns: int, samples: int) -> Column:
    """The interval's place in a ring of `samples`, from 1."""
    return (F.pmod(bucket(ns, interval_ns), F.lit(samples)) + 1).cast("int")


def saturate_int(total: Column) -> Column:
    """A 64-bit sum as a 32-bit integer that stops at its limits."""
    return F.greatest(F.least(total, F.lit(INT_MAX)), F.lit(INT_MIN)).cast("int")


def saturate_uint(total: Column) -> Column:
    return F.greatest(F.least(total, F.lit(UINT_MAX)), F.lit(0)).cast("bigint")


def is_finite(x: Column) -> Column:
    """False for null, NaN and both infinities."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def type_name(code: Column) -> Column:
    """The name of a field's value type code."""
    names = {-1: "mismatch", 1: "binary", 2: "integer", 3: "double", 4: "bool"}  # fixed values
    out = F.lit("string")
    for k, v in names.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def field_name(reference: Column) -> Column:
    """x of ``Fields[x]``, else null."""
    found = F.regexp_extract(reference, r"^Fields\[([^\]]+)\]$", 1)
    return F.when(found != "", found)
