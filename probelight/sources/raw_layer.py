"""The raw layer: what the streams ingested, under the names and columns that the extractors read.

Every table is there, empty if nothing came yet.  Times are those of the records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelight.operators.upsert import Store

_KEY = "group_id string, app_id string"
#: Columns of the ingested tables that the raw layer needs.
INGESTED = {
    "builds": f"id string, {_KEY}, commit_sha string, build_version string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "build_infos": f"id string, {_KEY}, branch string, updated_at timestamp_ntz",
    "instances": f"id string, {_KEY}, build_id string, env_id string, created_at timestamp_ntz",
    "methods": f"{_KEY}, method_id string, class_name string, method_name string, method_params string, return_type string, body_checksum string, signature string, probes_count int",
    "build_methods": f"build_id string, {_KEY}, method_id string, created_at timestamp_ntz",
    "method_coverage": f"{_KEY}, instance_id string, build_id string, method_id string, test_id string, test_session_id string, probes string, probes_count int, created_at timestamp_ntz",
    "test_definitions": "id string, group_id string, runner string, name string, path string, tags array<string>, updated_at timestamp_ntz",
    "test_launches": "id string, group_id string, test_session_id string, test_definition_id string, result string, duration int, created_at timestamp_ntz",
    "test_sessions": "id string, group_id string, test_task_id string, created_at timestamp_ntz, build_ids array<string>",
    "ignore_rules": f"{_KEY}, name_pattern string, classname_pattern string",
    "coverage_requests": "group_id string, session_id string, definition_id string, requested_at timestamp_ntz",
}


def raw_tables(store: Store) -> dict[str, DataFrame]:
    """The extractors' tables over a store that ``ingest_stream`` writes."""
    t = {}
    for name, ddl in INGESTED.items():
        df = store.read(name)
        t[name] = store.spark.createDataFrame([], ddl) if df is None else df.select(*(c.split()[0] for c in ddl.split(", ")))
    info = t["build_infos"].select("id", "branch", F.col("updated_at").alias("_info"))
    builds = t["builds"].join(info, "id", "left").withColumn("updated_at", F.greatest("updated_at", "_info")).drop("_info").withColumnRenamed("id", "build_id")
    definitions = t["test_definitions"].withColumn("tags", F.when(F.size("tags") > 0, F.array_join("tags", ",")))
    sessions = t["test_sessions"].withColumnsRenamed({"id": "session_id", "test_task_id": "task_id"})
    return {
        "builds": builds,
        "instances": t["instances"].withColumnRenamed("id", "instance_id"),
        "raw_methods": t["methods"].withColumn("probes_count", F.col("probes_count").cast("long")),
        "raw_build_methods": t["build_methods"],
        "raw_coverage": t["method_coverage"].withColumnsRenamed({"test_id": "launch_id", "test_session_id": "session_id"}),
        "definitions": definitions.withColumnsRenamed({"id": "definition_id", "name": "test_name", "path": "test_path", "runner": "test_runner"}),
        "launches": t["test_launches"].withColumnsRenamed({"id": "launch_id", "test_session_id": "session_id", "test_definition_id": "definition_id"}).withColumn("duration", F.col("duration").cast("long")),
        "sessions": sessions.drop("build_ids"),
        "session_builds": sessions.select("group_id", "session_id", "created_at", F.explode("build_ids").alias("build_id")),
        "rules": t["ignore_rules"],
        "requests": t["coverage_requests"],
    }
