"""The incremental pipelines as queries: each runs through ``run_etl`` in two stretches of time into a store of its own."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelight.functions import probes
from probelight.operators import extract
from probelight.operators.upsert import Store
from probelight.sources import managed
from probelight.streaming import etl

from . import report
from .metrics import bits
from .stored import Tables
from .views import FLAGS

MIDDLE, END = datetime(1995, 6, 30, 13, 20), datetime(2010, 1, 1)


def store(t: Tables) -> Store:
    """A store in the shared folder, gone when the application ends."""
    return Store(t.spark, f"{t.root}/stores/{uuid.uuid4().hex}")


def _loaded(t, *names: str) -> Store:
    """A store after two runs of pipelines, the second one with the first one's watermarks."""
    s = store(t)
    for until in (MIDDLE, END):
        run(s, raw(t), list(names), until=until)
    return s


def raw(t) -> extract.Raw:
    """The raw tables; a pipeline makes those that its extractor reads."""
    return extract.Raw(t)


def run(s: Store, x: Mapping[str, DataFrame], names: list[str] | None, want: str = "SUCCESS", **options) -> None:
    """A run of which all pipelines end with the wanted status."""
    for name, r in etl.run_etl(s, x, "g1", names, **options).items():
        if r["status"] != want:
            raise RuntimeError(f"{name}: {r['status']}: {r['error']}")


def _bits(df: DataFrame) -> DataFrame:
    return df.withColumn("bits", probes.to_bits(F.col("probes"), F.size("probes") * probes.WORD)).drop("probes")


def _rows(pipeline: str, *columns: str):
    """The rows that a pipeline wrote, as SQL expressions."""

    def rows(t) -> DataFrame:
        df = _loaded(t, pipeline).read(etl.PIPELINES[pipeline].table)
        return (_bits(df) if "probes" in df.columns else df).selectExpr(*columns)

    return rows


def _metadata(t) -> DataFrame:
    return _loaded(t, "test_launches", "test_sessions").read("etl_metadata")


def run_metadata(t) -> DataFrame:
    return _metadata(t).select("pipeline", "status", "rows", F.col("last_processed_at").cast("string").alias("until"))


def refresh_status(t) -> DataFrame:
    return report.refresh_status(_metadata(t)).select("group_id", "status", "rows", F.col("last_processed_at").cast("string").alias("until"), "errors")


def rules(t) -> DataFrame:
    """A rule for each class, made twice over; those of one app are deleted."""
    s = store(t)
    r = t["raw_methods"].select("group_id", "app_id", F.lit(None).cast("string").alias("name_pattern"), F.concat(F.lit("^"), "class_name", F.lit("$")).alias("classname_pattern")).distinct()
    managed.create_rules(s, r)
    managed.create_rules(s, r)
    s.delete("ignore_rules", "app_id = 'app-1'")
    return managed.list_rules(s, "g1").select("app_id", "name_pattern", "classname_pattern")


def stored_requests(t) -> DataFrame:
    """Requests are added, renewed a day later where they ask for a whole session, and one session's is deleted."""
    s, r = store(t), t["requests"]
    managed.request_coverage(s, r)
    managed.request_coverage(s, r.filter("definition_id = ''").withColumn("requested_at", F.col("requested_at") + F.expr("INTERVAL '1' DAY")))
    managed.delete_request(s, "g1", "s1997-3")
    return s.read("coverage_requests").select("session_id", "definition_id", F.col("requested_at").cast("string").alias("requested"), F.col("created_at").cast("string").alias("created"))


def definitions_between(t, since, until) -> DataFrame:
    return extract.test_definitions(extract.Raw(t), since, until).select("definition_id", "test_path", F.col("updated_day").cast("string").alias("day"))


def session_builds_between(t, since, until) -> DataFrame:
    return extract.test_session_builds(extract.Raw(t), since, until).select("session_id", "app_id", "build_id")


def late_rows(t) -> DataFrame:
    """Launches of one day that arrive in three parts, with a run at eight, at noon and on the next day: none is lost."""
    s, x = store(t), raw(t)
    day = x["launches"].withColumn("created_at", F.to_timestamp_ntz(F.lit("1996-03-01")) + (F.col("created_at") - F.col("created_at").cast("date").cast("timestamp_ntz")))
    for hour in (8, 12, 24):
        until = datetime(1996, 3, 1) + timedelta(hours=hour)
        run(s, x | {"launches": day.filter(F.col("created_at") <= extract.instant(until))}, ["test_launches"], until=until)
    return s.read("test_launches").select("launch_id", F.col("created_at").cast("string").alias("created_at"))


def looked_back(t) -> DataFrame:
    """Sessions that are written an hour late are found by a run that looks back two hours, up to ten minutes before now."""
    s, x = store(t), raw(t)
    now, late = datetime(1996, 3, 1, 12), F.pmod(F.xxhash64("session_id"), F.lit(2)) == 1
    at = extract.instant(now) - F.when(late, F.expr("INTERVAL '50' MINUTE")).when(F.length("session_id") == 7, F.expr("INTERVAL '5' MINUTE")).otherwise(F.expr("INTERVAL '20' MINUTE"))
    sessions = x["sessions"].withColumn("created_at", at)
    run(s, x | {"sessions": sessions.filter(~late)}, ["test_sessions"], now=now, delay=timedelta(minutes=10))
    run(s, x | {"sessions": sessions}, ["test_sessions"], want="SKIPPED", now=now, delay=timedelta(minutes=10))
    run(s, x | {"sessions": sessions}, ["test_sessions"], now=now + timedelta(hours=1), delay=timedelta(minutes=10), lookback=timedelta(hours=2))
    run(s, x | {"sessions": sessions.limit(0)}, ["test_sessions"], now=now + timedelta(hours=2))
    return s.read("test_sessions").select("session_id", "task_id")


def rerun(t) -> DataFrame:
    """A full refresh drops what the source has no more: of the launches two runs loaded, those of one session go."""
    s = _loaded(t, "test_launches")
    run(s, raw(t) | {"launches": t["launches"].filter("session_id <> 's1997-3'")}, ["test_launches"], until=END, full_refresh=True)
    return s.read("test_launches").select("launch_id", "session_id")


def of_different_starts(t) -> DataFrame:
    """Pipelines of one extractor with different watermarks share a scan from the earlier one."""
    s, names = store(t), ["build_method_test_session_coverage", "test_session_builds_from_coverage"]
    run(s, raw(t), names[:1], until=MIDDLE)
    run(s, raw(t), names, until=END)
    a = s.read("session_coverage").groupBy("app_id", "build_id", "session_id").agg(F.count("*").alias("n"))
    return s.read("test_session_builds").join(a, ["app_id", "build_id", "session_id"], "full").select("app_id", "build_id", "session_id", "n")


def isolated_failure(t) -> DataFrame:
    """Definitions can't be read, sessions can: the failure is on record, the other pipeline's watermark moves."""
    s = store(t)
    bad = raw(t) | {"definitions": t["definitions"].withColumn("test_name", F.raise_error(F.lit("unreadable")).cast("string"))}
    etl.run_etl(s, bad, "g1", ["test_definitions", "test_sessions"], until=END)
    return s.read("etl_metadata").select("pipeline", "status", F.col("last_processed_at").cast("string").alias("until"), F.coalesce(F.col("error").contains("unreadable"), F.lit(False)).alias("told"), "rows")


def fresh_definition(t) -> DataFrame:
    """Definition coverage is refreshed for one session's definition before it is asked for, with a watermark of its own.

    Another definition of the session, loaded before, keeps its rows, also when the first is refreshed from the start.
    """
    s, one, two = store(t), *(r.definition_id for r in t["launches"].filter("session_id = 's1997-3'").select("definition_id").distinct().orderBy("definition_id").limit(2).collect())
    for d in (one, two):
        etl.refresh(s, raw(t), "g1", END, names=["build_method_test_definition_coverage"], session_id="s1997-3", definition_id=d)
    run(s, raw(t), ["build_method_test_definition_coverage"], until=END, full_refresh=True, session_id="s1997-3", definition_id=one)
    run(s, raw(t), ["build_method_test_definition_coverage"], want="SKIPPED", until=END, session_id="s1997-3", definition_id=two)
    return _bits(s.read("definition_coverage")).drop("group_id", "updated_at_day")


SINCE, UNTIL = datetime(1994, 6, 30, 9), datetime(1998, 6, 30, 21)
_PAD = f"{bits('probes')} AS bits"
_B, _D, _S, _T = ("app_id", "build_id", "method_id", "env_id", "result", "tag", "task_id", "bits"), ("app_id", "method_id", "day", "branch", "env_id", "result", "tag", "task_id", "bits"), ("app_id", "build_id", "method_id", "session_id", "env_id", "result", "tag", "bits"), ("app_id", "build_id", "method_id", "session_id", "definition_id", "env_id", "result", "bits")


def _fold(keys: tuple[str, ...], table: str) -> str:
    """DuckDB: the OR of a table's probes by keys, the last of which is the bits."""
    k = ", ".join(keys[:-1])
    out = ", ".join("day::VARCHAR AS day" if c == "day" else c for c in keys[:-1])
    return f"SELECT {out}, {_PAD} FROM (SELECT {k}, bit_or(probes) AS probes FROM {table} GROUP BY {k})"


def _day(columns: tuple[str, ...]) -> list[str]:
    return ["CAST(day AS STRING) AS day" if c == "day" else c for c in columns]


#: name -> (query over the derived tables, DuckDB query over the same, further CTEs)
REGISTERED = {
    "i13_ignore_rules": (rules, "SELECT DISTINCT app_id, NULL::VARCHAR AS name_pattern, '^' || class_name || '$' AS classname_pattern FROM raw_methods WHERE app_id <> 'app-1'"),
    "i14_coverage_requests": (stored_requests, "SELECT session_id, definition_id, (requested_at + CASE WHEN definition_id = '' THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END)::VARCHAR AS requested, requested_at::VARCHAR AS created FROM requests WHERE NOT (session_id = 's1997-3' AND definition_id = '')"),
    "e7_test_definitions_between": (lambda t: definitions_between(t, SINCE, UNTIL), f"SELECT definition_id, test_path, updated_day::VARCHAR AS day FROM definitions WHERE updated_at > TIMESTAMP '{SINCE}' AND updated_at <= TIMESTAMP '{UNTIL}'"),
    "e9_test_session_builds_between": (lambda t: session_builds_between(t, SINCE, UNTIL), f"SELECT session_id, app_id, build_id FROM session_builds WHERE created_at > TIMESTAMP '{SINCE}' AND created_at <= TIMESTAMP '{UNTIL}'"),
    "s1_late_rows_of_a_day": (late_rows, "SELECT launch_id, (TIMESTAMP '1996-03-01' + (created_at - date_trunc('day', created_at)))::VARCHAR AS created_at FROM launches"),
    "s2_lookback_and_delay": (looked_back, "SELECT session_id, task_id FROM sessions"),
    "s5_full_refresh": (rerun, "SELECT launch_id, session_id FROM launches WHERE session_id <> 's1997-3'"),
    "s6_shared_scan_of_different_starts": (of_different_starts, f"SELECT app_id, build_id, session_id, count(*) AS n FROM (SELECT DISTINCT app_id, build_id, session_id, method_id, env_id, result, tag FROM f3 WHERE session_id IS NOT NULL) GROUP BY ALL"),
    "s7_failure_isolation": (isolated_failure, f"SELECT 'test_definitions' AS pipeline, 'FAILED' AS status, NULL::VARCHAR AS until, true AS told, 0::BIGINT AS rows UNION ALL SELECT 'test_sessions', 'SUCCESS', '{END}', false, count(*) FROM sessions"),
    "s11_fresh_definition_coverage": (fresh_definition, f"SELECT app_id, build_id, method_id, session_id, definition_id, env_id, result, {_PAD} FROM bmdc WHERE session_id = 's1997-3' AND definition_id IN (SELECT DISTINCT definition_id FROM launches WHERE session_id = 's1997-3' ORDER BY definition_id LIMIT 2)"),
    "p8_session_coverage_etl": (_rows("build_method_test_session_coverage", *_S), _fold(_S, "(SELECT * FROM f3 WHERE session_id IS NOT NULL)")),
    "p11_session_builds_from_coverage_etl": (_rows("test_session_builds_from_coverage", "app_id", "build_id", "session_id"), "SELECT DISTINCT app_id, build_id, session_id FROM f3 WHERE session_id IS NOT NULL"),
    "p1_builds_etl": (_rows("builds", "build_id", "branch", "array_join(app_env_ids, ',') AS envs"), "SELECT build_id, branch, (SELECT string_agg(DISTINCT env_id, ',' ORDER BY env_id) FROM instances i WHERE i.build_id = b.build_id) AS envs FROM builds b"),
    "p2_build_methods_etl": (_rows("build_methods", "app_id", "build_id", "method_id"), "SELECT app_id, build_id, method_id FROM build_methods"),
    "p3_methods_etl": (_rows("methods", "app_id", "method_id", "signature", "probes_count"), "SELECT DISTINCT m.app_id, m.method_id, signature, probes_count FROM build_methods b JOIN methods m ON b.app_id = m.app_id AND b.method_id = m.method_id"),
    "p4_test_launches_etl": (_rows("test_launches", "launch_id", "definition_id", "session_id", "duration", *FLAGS), "SELECT launch_id, definition_id, session_id, duration, " + ", ".join(f"(result {q})::BIGINT AS {c}" for c, q in (("passed", "= 'PASSED'"), ("failed", "= 'FAILED'"), ("skipped", "= 'SKIPPED'"), ("smart_skipped", "= 'SMART_SKIPPED'"), ("success", "<> 'FAILED'"))) + " FROM launches"),
    "p5_test_definitions_etl": (_rows("test_definitions", "definition_id", "test_path", "test_name", "tags"), "SELECT definition_id, test_path, test_name, tags FROM definitions"),
    "p6_test_sessions_etl": (_rows("test_sessions", "session_id", "task_id", "CAST(started_day AS STRING) AS started_day"), "SELECT session_id, task_id, started_day::VARCHAR AS started_day FROM sessions"),
    "p7_test_session_builds_etl": (_rows("test_session_builds", "app_id", "build_id", "session_id"), "SELECT app_id, build_id, session_id FROM session_builds"),
    "p9_build_method_coverage_etl": (_rows("build_method_coverage", *_B), _fold(_B, "f3")),
    "p10_method_daily_coverage_etl": (_rows("method_daily_coverage", *_day(_D)), _fold(_D, "f3")),
    "p12_definition_coverage_etl": (_rows("build_method_test_definition_coverage", *_T), _fold(_T, "f4")),
    "p13_session_coverage_from_launches_etl": (_rows("build_method_test_session_coverage_from_test_launches", *_S), _fold(_S, "f4")),
    "p14_build_method_coverage_from_launches_etl": (_rows("build_method_coverage_from_test_launches", *_B), _fold(_B, "f4")),
    "p15_method_daily_coverage_from_launches_etl": (_rows("method_daily_coverage_from_test_launches", *_day(_D)), _fold(_D, "f4")),
    "p16_definition_coverage_by_request_etl": (_rows("build_method_test_definition_coverage_by_request", *_T), _fold(_T, "(SELECT * FROM f4 WHERE EXISTS (SELECT 1 FROM requests q WHERE q.session_id = f4.session_id AND (q.definition_id = '' OR q.definition_id = f4.definition_id)))")),
    "p17_test_to_code_mapping_etl": (_rows("test_to_code_mapping", "app_id", "signature", "definition_id", "branch", "env_id", "task_id", "CAST(updated_at_day AS STRING) AS updated_at_day"), "SELECT app_id, signature, definition_id, branch, env_id, task_id, updated_at_day::VARCHAR AS updated_at_day FROM mapping"),
    "p18_session_builds_from_launches_etl": (_rows("test_session_builds_from_test_launches", "app_id", "build_id", "session_id"), "SELECT DISTINCT app_id, build_id, session_id FROM f4"),
    "s10_run_metadata": (run_metadata, f"SELECT 'test_launches' AS pipeline, 'SUCCESS' AS status, count(*) AS rows, '{END}' AS until FROM launches UNION ALL SELECT 'test_sessions', 'SUCCESS', count(*), '{END}' FROM sessions"),
    "r19_refresh_status": (refresh_status, f"SELECT group_id, 'SUCCESS' AS status, count(*) AS rows, '{END}' AS until, '' AS errors FROM (SELECT group_id FROM launches UNION ALL SELECT group_id FROM sessions) GROUP BY group_id"),
}
