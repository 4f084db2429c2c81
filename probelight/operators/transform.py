"""Transformers: filters, and the folds of the metric tables as group-wise ORs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelight.functions import probes

BUILD_KEYS = ["group_id", "app_id", "build_id", "method_id", "env_id", "result", "tag", "task_id"]
DAY_KEYS = ["group_id", "app_id", "method_id", "day", "branch", "env_id", "result", "tag", "task_id"]
SESSION_KEYS = ["group_id", "app_id", "build_id", "method_id", "session_id", "env_id", "result", "tag"]
DEFINITION_KEYS = ["group_id", "app_id", "build_id", "method_id", "session_id", "definition_id", "env_id", "result"]
MAPPING_KEYS = ["group_id", "app_id", "signature", "definition_id", "branch", "env_id", "task_id"]


def keep(predicate: Column | str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.filter(predicate)


has_session = keep("session_id IS NOT NULL")
has_session_and_definition = keep("session_id IS NOT NULL AND definition_id IS NOT NULL")
passed_only = keep("definition_id IS NOT NULL AND result = 'PASSED'")


def chain(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = df.transform(s)
        return df

    return run


def in_words(facts: DataFrame) -> DataFrame:
    """Facts with their probe vectors as words beside their lengths in bits, for several folds to read."""
    return facts.withColumns({"probes": probes.to_words(F.col("probes")), "_bits": F.length("probes")})


def _words(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, day, the probe vector as words, and its length, which must be the same for all vectors of a key."""
    return (facts if "_bits" in facts.columns else in_words(facts)).select(*dict.fromkeys([*keys, "day"]), "probes", "_bits")


def _fold(facts: DataFrame, keys: list[str], width: int | None, **aggs: Column) -> DataFrame:
    return probes.checked_or_by(_words(facts, keys), keys, "_bits", "probes", width, **aggs)


def build_method_coverage(facts: DataFrame, width: int | None = None) -> DataFrame:
    return _fold(facts, BUILD_KEYS, width, created_at_day=F.max("day"))


def method_daily_coverage(facts: DataFrame, width: int | None = None) -> DataFrame:
    return _fold(facts, DAY_KEYS, width)


def coverage_snapshots(daily: DataFrame, width: int | None = None) -> DataFrame:
    """Daily coverage summed up: for each month that a key has rows in, the OR of all its days to the month's end.

    A snapshot holds from ``month`` (its first day) until before ``until``, the key's next one (null: for good).  So what a
    key had covered before a day is one snapshot and the days of that day's month.
    """
    keys = [c for c in DAY_KEYS if c != "day"]
    rows = daily.select(*keys, F.trunc("day", "month").alias("month"), "probes")
    # with a known width one shuffle by key serves the grouping and both windows
    months = probes.or_by(rows if width is None else rows.repartition(*keys), [*keys, "month"], width=width)
    out = probes.running_or(months, keys, "month", width=width)
    return out.withColumn("until", F.lead("month").over(Window.partitionBy(*keys).orderBy("month")))


def session_coverage(facts: DataFrame, width: int | None = None) -> DataFrame:
    return _fold(has_session(facts), SESSION_KEYS, width, created_at_day=F.max("day"))


def definition_coverage(facts: DataFrame, width: int | None = None) -> DataFrame:
    return _fold(has_session_and_definition(facts), DEFINITION_KEYS, width, created_at_day=F.max("day"))


def test_to_code_mapping(facts: DataFrame) -> DataFrame:
    return passed_only(facts).groupBy(*MAPPING_KEYS).agg(F.max("day").alias("updated_at_day"))


def last_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``, ties by the whole row."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("_o"), *rest)).alias("_r"))
    return best.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*df.columns)
