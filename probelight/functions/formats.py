"""Scalar expressions: durations, identities, ratios, filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = (("d", 86_400_000, None), ("h", 3_600_000, 24), ("m", 60_000, 60), ("s", 1000, 60), ("ms", 1, 1000))


def _part(ms: Column, size: int, cycle: int | None) -> Column:
    q = F.floor(ms / size).cast("long")
    return q if cycle is None else q % cycle


def format_duration(ms: Column) -> Column:
    """1d 2h 3m 4s 5ms; zero parts are left out, 0 is 0ms, null is the empty string."""
    parts = [F.when(_part(ms, n, c) > 0, F.concat(_part(ms, n, c).cast("string"), F.lit(u))) for u, n, c in _UNITS]
    return F.when(ms.isNull(), "").when(ms == 0, "0ms").otherwise(F.concat_ws(" ", *parts))


def format_duration_rounded(ms: Column) -> Column:
    """The largest unit alone; null is 0ms."""
    out = F.lit("0ms")
    for u, n, c in reversed(_UNITS):
        out = F.when(ms >= n, F.concat(_part(ms, n, None).cast("string"), F.lit(u))).otherwise(out)
    return out


def build_id(group: Column, app: Column, version: Column, commit: Column, instance: Column) -> Column:
    """group:app:(first of version, commit, instance that isn't blank); an error if group, app or all three are blank."""
    full = lambda x: F.nullif(F.trim(x), F.lit(""))
    last = F.coalesce(full(version), full(commit), full(instance))
    out = F.concat_ws(":", group, app, last)
    return F.when(full(group).isNull() | full(app).isNull() | last.isNull(), F.raise_error(F.lit("a build needs group, app, and a version, commit or instance"))).otherwise(out)


def parse_build_id(text: str) -> tuple[str, str, str]:
    parts = text.split(":")
    if len(parts) != 3 or not all(parts):
        raise ValueError(f"not a build id: {text!r}")
    return parts[0], parts[1], parts[2]


def signature(cls: Column, name: Column, params: Column, returns: Column) -> Column:
    return F.concat_ws(":", cls, name, params, returns)


def method_id(sig: Column, checksum: Column, probes: Column) -> Column:
    return F.md5(F.concat_ws(":", sig, checksum, probes.cast("string")))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def among(column: str, values: Sequence[str] | None) -> Column | None:
    """column is one of ``values``; None (no filter) if none are given."""
    return F.col(column).isin(list(values)) if values else None


def where_given(df, *conditions: Column | None):
    for c in conditions:
        if c is not None:
            df = df.filter(c)
    return df


def method_pattern(package: str | None = None, cls: str | None = None, name: str | None = None) -> str | None:
    """LIKE pattern over signatures, class:name:params:returns; None if nothing is given."""
    if not (package or cls or name):
        return None
    if package and not cls:
        return f"{package}%:{name or '%'}:%:%"
    return f"{cls or '%'}:{name or '%'}:%:%"


def combined_checksum(checksum: Column) -> Column:
    """Aggregate: the sum of signed base-36 longs modulo 2^64, in base 36; empty ones are skipped, bad ones an error."""
    text = F.nullif(checksum, F.lit(""))
    bad = ~text.rlike("^[+-]?[0-9a-zA-Z]{1,13}$")
    number = F.conv(text, 36, -10).cast("decimal(38,0)")
    total = F.sum(F.when(bad, F.raise_error(F.lit("not a base-36 checksum")).cast("decimal(38,0)")).otherwise(number))
    wrapped = F.pmod(F.coalesce(total, F.lit(0).cast("decimal(38,0)")) + F.lit(str(2**63)).cast("decimal(38,0)"), F.lit(str(2**64)).cast("decimal(38,0)")) - F.lit(str(2**63)).cast("decimal(38,0)")
    return F.lower(F.conv(wrapped.cast("string"), 10, -36))


def git_date(text: Column) -> Column:
    """'EEE MMM d HH:mm:ss yyyy Z' as local wall time; the offset and the day's name are dropped."""
    return F.try_to_timestamp(F.substring_index(F.substr(text, F.lit(5)), " ", 4), F.lit("MMM d HH:mm:ss yyyy")).cast("timestamp_ntz")
