"""Incremental extractors: a window of the watermark column, then joins.  No paging, no order: Spark reads ranges.

All read the raw layer, one schema for batch tables and for what the streams ingest (``sources/raw_layer.py``), and give
the time that their window is about as ``at``.  A window is (since, until], of instants; dates stand for their midnight.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHOD = ["group_id", "app_id", "method_id"]
BUILD = ["group_id", "app_id", "build_id"]


class Raw(dict):
    """Raw tables by name, made when they are asked for; ``builds`` are the raw ones also among metric tables.

    ``given`` ones stand for those of ``tables``; with ``group`` only its rows are there.
    """

    def __init__(self, tables: Mapping[str, DataFrame], group: str | None = None, given: dict[str, DataFrame] | None = None):
        super().__init__(given or {})
        self.tables, self.group = tables, group

    def __missing__(self, name: str) -> DataFrame:
        if name == "builds" and "raw_builds" in getattr(self.tables, "makers", self.tables):
            name = "raw_builds"
        df = self.tables[name]
        return df if self.group is None or "group_id" not in df.columns else df.filter(F.col("group_id") == self.group)

    def __or__(self, other: dict[str, DataFrame]) -> Raw:
        return Raw(self.tables, self.group, {**self, **other})


def instant(x: datetime | date | Column) -> Column:
    """A bound as a time without a zone; text, so that no session's zone shifts it."""
    return x if isinstance(x, Column) else F.lit(x.isoformat(" ") if isinstance(x, datetime) else str(x)).cast("timestamp_ntz")


def within(df: DataFrame, column: str, since=None, until=None) -> DataFrame:
    """Rows of (since, until]; a bound that isn't given is left out, so the filters reach the scan."""
    if since is not None:
        df = df.filter(F.col(column) > instant(since))
    if until is not None:
        df = df.filter(F.col(column) <= instant(until))
    return df


def not_ignored(methods: DataFrame, rules: DataFrame) -> DataFrame:
    """Methods that no ignore rule of their app matches by name or class (regular expressions, found anywhere)."""
    r = rules.alias("r")
    m = methods.alias("m")
    hit = F.rlike("m.method_name", F.col("r.name_pattern")) | F.rlike("m.class_name", F.col("r.classname_pattern"))
    on = (F.col("m.group_id") == F.col("r.group_id")) & (F.col("m.app_id") == F.col("r.app_id")) & F.coalesce(hit, F.lit(False))
    return m.join(r, on, "left_anti").select("m.*")


def builds(raw: Raw, since=None, until=None) -> DataFrame:
    """Builds by their last update, with the sorted distinct environments of all their instances (null if none).

    ``updated_at`` is that of the build or its newest instance in the window, whichever is later.
    """
    i = raw["instances"]
    envs = i.filter(F.coalesce("env_id", F.lit("")) != "").groupBy("build_id").agg(F.array_sort(F.collect_set("env_id")).alias("app_env_ids"))
    newest = within(i, "created_at", since, until).groupBy("build_id").agg(F.max("created_at").alias("_newest"))
    out = within(raw["builds"], "updated_at", since, until).withColumn("at", F.col("updated_at")).join(envs, "build_id", "left").join(newest, "build_id", "left")
    out = out.withColumn("updated_at", F.greatest("updated_at", "_newest")).drop("_newest")
    return out.withColumns({"created_day": F.to_date("created_at"), "updated_day": F.to_date("updated_at")})


def build_methods(raw: Raw, since=None, until=None) -> DataFrame:
    m = not_ignored(raw["raw_methods"].filter("probes_count > 0"), raw["rules"])
    rows = within(raw["raw_build_methods"], "created_at", since, until).withColumnsRenamed({"created_at": "at"}).withColumn("created_day", F.to_date("at"))
    return rows.join(m, METHOD)


def _facts(raw: Raw, coverage: DataFrame) -> DataFrame:
    """Coverage with branch, environment and signature; its build, instance and method must be known.

    Methods come last: rows that lie together by method stay where they are in the folds, whose keys have the method.
    """
    m = not_ignored(raw["raw_methods"], raw["rules"]).select(*METHOD, "signature")
    i = raw["instances"].select("group_id", "app_id", "instance_id", "env_id")
    return coverage.join(raw["builds"].select(*BUILD, "branch"), BUILD).join(i, ["group_id", "app_id", "instance_id"]).join(m, METHOD)


FACT = ["group_id", "app_id", "build_id", "method_id", "signature", "env_id", "branch", "session_id", "task_id", "definition_id", "result", "tag", "day", "probes", "probes_count", "at"]


def coverage(raw: Raw, since=None, until=None) -> DataFrame:
    """Coverage that no test launch caused, with the session and task it came with, if the session is known."""
    rows = within(raw["raw_coverage"].filter("launch_id IS NULL"), "created_at", since, until).withColumnsRenamed({"created_at": "at", "session_id": "_session"})
    s = raw["sessions"].select("group_id", "session_id", F.col("session_id").alias("_session"), "task_id")
    none = {c: F.lit(None).cast("string") for c in ("definition_id", "result", "tag")}
    return _facts(raw, rows.join(s, ["group_id", "_session"], "left")).withColumns({**none, "day": F.to_date("at")}).select(*FACT)


def _tests(raw: Raw, launches: DataFrame) -> DataFrame:
    """Launches with definition, its tags, and session."""
    d = raw["definitions"].select("group_id", "definition_id", "tags")
    s = raw["sessions"].select("group_id", "session_id", "task_id")
    l = launches.select("group_id", "launch_id", "definition_id", "session_id", "result", F.col("created_at").alias("at"))
    return l.join(d, ["group_id", "definition_id"]).join(s, ["group_id", "session_id"])


def _of_tests(raw: Raw, tests: DataFrame) -> DataFrame:
    """The tests' coverage, one row for each tag (one with null where there is none)."""
    c = raw["raw_coverage"].filter("launch_id IS NOT NULL").withColumn("day", F.to_date("created_at")).drop("session_id", "created_at")
    return _facts(raw, c.join(tests, ["group_id", "launch_id"])).withColumn("tag", F.explode_outer(F.split("tags", ","))).select(*FACT)


def test_launch_coverage(raw: Raw, since=None, until=None, session_id: str | None = None, definition_id: str | None = None) -> DataFrame:
    """Coverage by test launch, for each of the definition's tags; the window is of the launch's time."""
    l = within(raw["launches"], "created_at", since, until)
    l = l.filter(F.col("session_id") == session_id) if session_id else l
    l = l.filter(F.col("definition_id") == definition_id) if definition_id else l
    return _of_tests(raw, _tests(raw, l))


def requested_coverage(raw: Raw, since=None, until=None) -> DataFrame:
    """As ``test_launch_coverage`` for requested (session, definition); an empty definition asks for all of the session."""
    q = within(raw["requests"], "requested_at", since, until).groupBy("group_id", "session_id", F.coalesce("definition_id", F.lit("")).alias("definition_id")).agg(F.max("requested_at").alias("_one"))
    whole = q.filter("definition_id = ''").select("group_id", "session_id", F.col("_one").alias("_whole"))
    # two joins, each by all of its keys: a session's launches and requests never meet in all pairs
    tests = _tests(raw, raw["launches"]).join(whole, ["group_id", "session_id"], "left").join(q, ["group_id", "session_id", "definition_id"], "left")
    tests = tests.withColumn("at", F.greatest("_one", "_whole")).filter("at IS NOT NULL").drop("_one", "_whole")
    return _of_tests(raw, tests)


def test_launches(raw: Raw, since=None, until=None) -> DataFrame:
    """Results as 0/1 flags; success is any result but FAILED, and a null result is no success."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    r = F.col("result")
    return within(raw["launches"], "created_at", since, until).withColumns({
        "passed": flag(r == "PASSED"), "failed": flag(r == "FAILED"), "skipped": flag(r == "SKIPPED"),
        "smart_skipped": flag(r == "SMART_SKIPPED"), "success": flag(r != "FAILED"), "created_day": F.to_date("created_at"), "at": F.col("created_at")})


def test_definitions(raw: Raw, since=None, until=None) -> DataFrame:
    return within(raw["definitions"], "updated_at", since, until).withColumns({"updated_day": F.to_date("updated_at"), "at": F.col("updated_at")})


def test_sessions(raw: Raw, since=None, until=None) -> DataFrame:
    return within(raw["sessions"], "created_at", since, until).withColumns({"started_day": F.to_date("created_at"), "at": F.col("created_at")})


def test_session_builds(raw: Raw, since=None, until=None) -> DataFrame:
    """Links of sessions and builds; the window is of the link's own time, so links to old builds count."""
    out = within(raw["session_builds"], "created_at", since, until).withColumnsRenamed({"created_at": "at"})
    return out.select("group_id", "session_id", "build_id", "at").join(raw["builds"].select("group_id", "build_id", "app_id"), ["group_id", "build_id"])


EXTRACTORS = {
    "builds": builds, "build_methods": build_methods, "coverage": coverage, "test_launch_coverage": test_launch_coverage, "test_launches": test_launches,
    "test_definitions": test_definitions, "test_sessions": test_sessions, "test_session_builds": test_session_builds, "requested_coverage": requested_coverage,
}
