"""Incremental runs of the named pipelines: watermarks, lookback, shared extraction, failure isolation, reruns.

Per pipeline and context (a group, or one test session or definition of it) the store's table etl_metadata holds
last_processed_at, status and totals.  A run reads (watermark - lookback, until], writes with the pipeline's upsert
policy, and moves the watermark only after the write.  Watermarks are instants: what arrives later on a day that was
processed before is read by the next run.  Upserts are idempotent, so reading a stretch again is harmless.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelight.functions import probes
from probelight.operators import extract, transform
from probelight.operators.upsert import Store

EPOCH = datetime(1970, 1, 1)


@dataclass(frozen=True)
class Pipeline:
    """source: name of the extractor; steps: transformers (those of policy "or" also take the width); table, keys, policy: the loader."""

    name: str
    source: str
    table: str
    keys: list[str]
    policy: str
    steps: Callable[..., DataFrame] = field(default=lambda df: df)
    columns: list[str] | None = None


_METHOD = ["group_id", "app_id", "method_id"]
_day = lambda f: lambda df, width=None: f(df, width).withColumnRenamed("created_at_day", "updated_at_day")
_links = lambda df: transform.has_session(df).select("group_id", "app_id", "build_id", "session_id").distinct()
_LINK = ["group_id", "app_id", "build_id", "session_id"]
_select = lambda *c: lambda df: df.select(*c).distinct()

PIPELINES = {
    p.name: p
    for p in (
        Pipeline("builds", "builds", "builds", ["group_id", "app_id", "build_id"], "replace", columns=["build_version", "branch", "commit_sha", "app_env_ids", "updated_at", "updated_day"]),
        Pipeline("build_methods", "build_methods", "build_methods", ["build_id", *_METHOD], "keep", _select("build_id", *_METHOD, "created_day")),
        Pipeline("methods", "build_methods", "methods", _METHOD, "keep", lambda df: transform.last_of(df.drop("build_id"), _METHOD, "at")),
        Pipeline("test_launches", "test_launches", "test_launches", ["group_id", "launch_id"], "replace"),
        Pipeline("test_definitions", "test_definitions", "test_definitions", ["group_id", "definition_id"], "replace"),
        Pipeline("test_sessions", "test_sessions", "test_sessions", ["group_id", "session_id"], "replace"),
        Pipeline("test_session_builds", "test_session_builds", "test_session_builds", _LINK, "keep", _select(*_LINK)),
        Pipeline("build_method_test_session_coverage", "coverage", "session_coverage", transform.SESSION_KEYS, "or", _day(transform.session_coverage)),
        Pipeline("build_method_coverage", "coverage", "build_method_coverage", transform.BUILD_KEYS, "or", _day(transform.build_method_coverage)),
        Pipeline("method_daily_coverage", "coverage", "method_daily_coverage", transform.DAY_KEYS, "or", transform.method_daily_coverage),
        Pipeline("test_session_builds_from_coverage", "coverage", "test_session_builds", _LINK, "keep", _links),
        Pipeline("build_method_test_definition_coverage", "test_launch_coverage", "definition_coverage", transform.DEFINITION_KEYS, "or", _day(transform.definition_coverage)),
        Pipeline("build_method_test_session_coverage_from_test_launches", "test_launch_coverage", "session_coverage", transform.SESSION_KEYS, "or", _day(transform.session_coverage)),
        Pipeline("build_method_coverage_from_test_launches", "test_launch_coverage", "build_method_coverage", transform.BUILD_KEYS, "or", _day(transform.build_method_coverage)),
        Pipeline("method_daily_coverage_from_test_launches", "test_launch_coverage", "method_daily_coverage", transform.DAY_KEYS, "or", transform.method_daily_coverage),
        Pipeline("build_method_test_definition_coverage_by_request", "requested_coverage", "definition_coverage", transform.DEFINITION_KEYS, "or", _day(transform.definition_coverage)),
        Pipeline("test_to_code_mapping", "test_launch_coverage", "test_to_code_mapping", transform.MAPPING_KEYS, "forward", transform.test_to_code_mapping),
        Pipeline("test_session_builds_from_test_launches", "test_launch_coverage", "test_session_builds", _LINK, "keep", _links),
    )
}
#: Vectors of more words are folded word by word: an aggregate for each would be too many.
WIDE = 16
#: Where a run keeps what it reads several times: facts and folds grow with the input, executors' memory doesn't.
KEPT = StorageLevel.DISK_ONLY
#: Run on demand only.
ON_DEMAND = ("build_method_test_definition_coverage", "build_method_test_definition_coverage_by_request")

CONTEXT = ["group_id", "session_id", "definition_id"]
META = "pipeline string, group_id string, session_id string, definition_id string, last_processed_at timestamp_ntz, status string, error string, duration double, rows long"


def watermarks(store: Store, group: str, session_id: str | None = None, definition_id: str | None = None) -> dict[str, datetime]:
    """Watermarks of a group's runs, or of those for one session or definition."""
    meta = store.read("etl_metadata")
    if meta is None:
        return {}
    mine = meta.filter(_of(group, session_id or "", definition_id or "")).filter("last_processed_at IS NOT NULL")
    return {r.pipeline: r.last_processed_at for r in mine.select("pipeline", "last_processed_at").collect()}  # a row for each pipeline


def _of(group: str, session_id: str | None, definition_id: str | None) -> Column:
    """Rows of a context; what isn't given doesn't matter."""
    out = F.col("group_id") == group
    for c, v in (("session_id", session_id), ("definition_id", definition_id)):
        out = out if v is None else out & (F.col(c) == v)
    return out


def words_of_methods(t: Mapping[str, DataFrame]) -> int | None:
    """Words of the longest vector that a method has, at which one shuffle folds; None beyond ``WIDE``, or without methods.

    Coverage is of a method whose id has the number of probes, so a longer vector is an error.
    """
    n = t["raw_methods"].agg(F.max("probes_count")).first()[0]
    return -(-n // probes.WORD) if n and n <= WIDE * probes.WORD else None


def run_etl(store: Store, t: Mapping[str, DataFrame], group: str, names: list[str] | None = None, until: datetime | None = None, lookback: timedelta = timedelta(0), delay: timedelta = timedelta(0), now: datetime | None = None, init: datetime = EPOCH, full_refresh: bool = False, session_id: str | None = None, definition_id: str | None = None) -> dict[str, dict]:
    """Runs pipelines over the raw tables ``t`` for a group; returns each one's status (SUCCESS, FAILED or SKIPPED), rows, error.

    The run reads up to ``until``, or up to ``delay`` before ``now``.  With a session or definition only its launches count,
    with watermarks of their own (pipelines of test launch coverage only).  Pipelines with one extractor share one scan from
    the earliest of their starts, of which each takes its own stretch.  A pipeline that fails, even one whose source can't be
    planned, keeps its watermark and the others go on.  A full refresh takes in all pipelines that write the same tables;
    the context's old rows go in the same write that brings the first new ones, so a failure leaves them.
    """
    spark = store.spark
    wanted = [PIPELINES[n] for n in (names or [n for n in PIPELINES if n not in ON_DEMAND])]
    narrow = {k: v for k, v in (("session_id", session_id), ("definition_id", definition_id)) if v}
    if narrow and {p.source for p in wanted} != {"test_launch_coverage"}:
        raise ValueError("only pipelines of test launch coverage run for a session or definition")
    end = until or ((now or datetime.now(UTC).replace(tzinfo=None)) - delay)
    marks = {} if full_refresh else watermarks(store, group, session_id, definition_id)
    stale: set[str] = set()
    if full_refresh:
        stale = {p.table for p in wanted}
        wanted += [p for p in PIPELINES.values() if p.table in stale and p not in wanted and p.name not in ON_DEMAND and not narrow]
    mine = extract.Raw(t, group)
    since = {p.name: (marks[p.name] - lookback if p.name in marks else init) for p in wanted}
    due = [p for p in wanted if since[p.name] < end and marks.get(p.name, EPOCH) < end]
    out = {p.name: {"status": "SKIPPED", "rows": 0, "error": None, "duration": 0.0} for p in wanted if p not in due}
    for source in dict.fromkeys(p.source for p in due):
        group_of = [p for p in due if p.source == source]
        first, shared, width = min(since[p.name] for p in group_of), None, None
        for p in group_of:
            begun, new = time.time(), None
            try:
                if shared is None:
                    shared = extract.EXTRACTORS[source](mine, first, end, **narrow)
                    if any(x.policy == "or" for x in group_of):
                        width = words_of_methods(mine)
                    if len(group_of) > 1:
                        shared = (transform.in_words(shared) if "probes" in shared.columns else shared).persist(KEPT)
                rows = shared if since[p.name] == first else extract.within(shared, "at", since[p.name])
                new = (p.steps(rows, width) if p.policy == "or" else p.steps(rows)).persist(KEPT)
                n = new.count()
                if n or p.table in stale:
                    gone = _of(group, session_id, definition_id) if p.table in stale else None
                    store.upsert(p.table, new, p.keys, p.policy, p.columns, gone, order="at" if "at" in new.columns else None, width=width)
                    stale.discard(p.table)
                out[p.name] = {"status": "SUCCESS", "rows": n, "error": None}
            except Exception as e:  # any failure of this pipeline; the others go on
                out[p.name] = {"status": "FAILED", "rows": 0, "error": str(e)[:500]}
            out[p.name]["duration"] = time.time() - begun
            if new is not None:
                new.unpersist()
        if shared is not None:
            shared.unpersist()
    rows = [(n, group, session_id or "", definition_id or "", end if r["status"] == "SUCCESS" else marks.get(n), r["status"], r["error"], float(r["duration"]), int(r["rows"])) for n, r in out.items() if r["status"] != "SKIPPED"]
    if rows:
        new, old = spark.createDataFrame(rows, META), store.read("etl_metadata")
        store.write("etl_metadata", new if old is None else _accumulated(old, new))
    return out


def _accumulated(old: DataFrame, new: DataFrame) -> DataFrame:
    """Status and watermark of the new run, durations and rows added up."""
    keys = ["pipeline", *CONTEXT]
    n = new.select(*keys, *(F.col(c).alias(f"_{c}") for c in new.columns if c not in keys))
    both = old.join(n, keys, "full")
    last = lambda c: F.when(F.col("_status").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    add = lambda c: (F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0))).cast(old.schema[c].dataType).alias(c)
    return both.select(*keys, last("last_processed_at"), last("status"), last("error"), add("duration"), add("rows"))


def refresh(store: Store, t: Mapping[str, DataFrame], group: str, fresh_after: datetime, **options) -> dict[str, dict]:
    """Runs what lies before ``fresh_after`` and isn't processed yet, before a query that needs it."""
    return run_etl(store, t, group, until=fresh_after, **options)


def coverage_bits(df: DataFrame, n: str = "probes_count") -> DataFrame:
    """Probe words as bit strings, for files that others read."""
    return df.withColumn("probes", probes.to_bits(F.col("probes"), F.col(n)))
