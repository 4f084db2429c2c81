"""List and report queries over the analytic functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelight.functions.formats import ratio, where_given

from . import coverage, impact
from .coverage import Tables


def page(df: DataFrame, number: int = 1, size: int = 100) -> DataFrame:
    """A page of an ordered frame."""
    return df.offset((number - 1) * size).limit(size) if number > 1 else df.limit(size)


def page_total(items: int, number: int, size: int, count) -> int:
    """A short page tells the total; a full one asks ``count``."""
    return (number - 1) * size + items if items < size and (items or number == 1) else count()


def ordered(df: DataFrame, by: Sequence[tuple[str, bool]], allowed: Sequence[str]) -> DataFrame:
    """Sorted by (column, descending) pairs; columns outside ``allowed`` are an error."""
    for c, _ in by:
        if c not in allowed:
            raise ValueError(f"can't sort by {c!r}")
    return df.orderBy(*(F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_last() for c, d in by))


def applications(t: Tables, group: str | None = None) -> DataFrame:
    return where_given(t["builds"], F.col("group_id") == group if group else None).select("group_id", "app_id").distinct()


def builds(t: Tables, group=None, app=None, branch=None, commit=None, version=None, env_ids=None) -> DataFrame:
    eq = lambda c, v: F.col(c) == v if v else None
    envs = F.arrays_overlap("app_env_ids", F.array(*map(F.lit, env_ids))) if env_ids else None
    return where_given(t["builds"], eq("group_id", group), eq("app_id", app), eq("branch", branch), eq("commit_sha", commit), eq("build_version", version), envs)


def version_order() -> list[Column]:
    """The three parts of a version, compared as text."""
    return [F.split_part("build_version", F.lit("."), F.lit(k)) for k in (1, 2, 3)]


def build_exists(t: Tables, build: str) -> DataFrame:
    return t["builds"].filter(F.col("build_id") == build).limit(1).select("build_id")


def build_diff_report(t: Tables, build: str, baseline: str, threshold: int = 0) -> DataFrame:
    """One row: changes, tested changes, coverage of the changes, impacted tests and their results on the build."""
    c = coverage.changes(t, build, baseline, include_deleted=True)
    n = lambda k: F.count_if(F.col("change") == k)
    counts = c.agg(n("new").alias("new_methods"), n("modified").alias("modified_methods"), n("deleted").alias("deleted_methods"))
    tested = coverage.changes_with_coverage(t, build, baseline, results=["PASSED"]).filter(F.col("aggregated_covered") > threshold).agg(n("new").alias("tested_new"), n("modified").alias("tested_modified"))
    cov = coverage.methods_with_coverage(t, [build], baseline).agg(F.sum("isolated_covered").alias("i"), F.sum("aggregated_covered").alias("a"), F.sum("probes_count").alias("n")).select(ratio(F.col("i"), F.col("n")).alias("isolated_ratio"), ratio(F.col("a"), F.col("n")).alias("aggregated_ratio"))
    tests = impact.impacted_tests(t, build, baseline).select("group_id", "definition_id")
    of_build = t["session_builds"].filter(F.col("build_id") == build).select("session_id").distinct()
    results = t["launches"].filter(F.col("result").isin("PASSED", "FAILED")).join(of_build, "session_id", "left_semi").groupBy("group_id", "definition_id").agg(F.min("result").alias("r"))
    flag = lambda v: F.sum(F.when(F.col("r") == v, 1).otherwise(0)).cast("long")
    impacted = tests.join(results, ["group_id", "definition_id"], "left").agg(F.count("*").alias("impacted_tests"), flag("PASSED").alias("passed_impacted"), flag("FAILED").alias("failed_impacted"))
    return counts.crossJoin(tested).crossJoin(cov).crossJoin(impacted)  # one row each


def coverage_by_session(t: Tables, build: str, session: str, number: int = 1, size: int = 100, **filters) -> DataFrame:
    """A page of a build's methods with a test session's coverage, which counts as isolated and as aggregated."""
    return _by(t, "session_coverage", build, number, size, session=session, **filters)


def coverage_by_definition(t: Tables, build: str, definition: str, session: str | None = None, number: int = 1, size: int = 100, **filters) -> DataFrame:
    """As ``coverage_by_session`` for a test definition."""
    return _by(t, "definition_coverage", build, number, size, session=session, definition=definition, **filters)


def _by(t: Tables, table: str, build: str, number: int, size: int, **filters) -> DataFrame:
    m = coverage.methods_by(t, table, build, **filters)
    both = [F.col(c).alias(f"{k}_{c}") for k in ("isolated", "aggregated") for c in ("covered", "missed", "ratio")]
    return page(m.select("build_id", "signature", "method_id", "class_name", "method_name", "probes_count", *both).orderBy("signature", "method_id"), number, size)


def methods_count(t: Tables, build: str, **filters) -> DataFrame:
    """The number of a build's methods."""
    return coverage.get_methods(t, build, **filters).agg(F.count("*").alias("n"))


def metrics_period(settings: DataFrame, today: Column) -> DataFrame:
    """(group_id, since): the first day that a group's metrics go back to; without a period of its own 1900-01-01."""
    return settings.select("group_id", F.coalesce(F.date_sub(today, F.col("metrics_period_days").cast("int")), F.to_date(F.lit("1900-01-01"))).alias("since"))


def refresh_status(metadata: DataFrame) -> DataFrame:
    """Per group the worst status, the last watermark, summed durations and rows, and joined errors."""
    order = F.expr("CASE status WHEN 'FAILED' THEN 1 WHEN 'EXTRACTING' THEN 2 WHEN 'LOADING' THEN 3 ELSE 4 END")
    return metadata.groupBy("group_id").agg(F.min_by("status", order).alias("status"), F.max("last_processed_at").alias("last_processed_at"), F.sum("duration").alias("duration"), F.sum("rows").alias("rows"), F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("errors"))
