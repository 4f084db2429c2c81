"""From records to reports: the derived domain as JSON records, ingested by the stream, loaded by two ETL runs, queried.

The records of the second half come after the first run.  A launch is reported when the last of its coverage was, as its
time is what the launch coverage extractor goes by.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelight.operators.upsert import Store
from probelight.sources import managed, raw_layer
from probelight.streaming import etl, ingest_stream

from . import coverage, impact
from .etl_queries import END, MIDDLE, run, store
from .stored import metric_tables


#: Methods of one payload at most.  Readers hold thousands of payloads at a time, so none may grow with the data.
A_PAYLOAD = 100


def _head() -> list[Column]:
    return [F.col("group_id").alias("groupId"), F.col("app_id").alias("appId"), F.split_part("build_id", F.lit(":"), F.lit(3)).alias("buildVersion")]


def _record(df: DataFrame, key: str, at: str = "created_at") -> DataFrame:
    """A record for each row, at the row's time."""
    return df.select(F.lit(key).alias("key"), F.to_json(F.struct(*(c for c in df.columns if c != at))).alias("value"), F.col(at).alias("ts"))


def records(t) -> DataFrame:
    """Everything that agents and test runners would have sent."""
    b, m1 = t["raw_builds"], t["m1"]
    method = F.struct(F.col("class_name").alias("classname"), F.col("method_name").alias("name"), F.col("method_params").alias("params"), F.col("return_type").alias("returnType"), F.col("probes_count").alias("probesCount"), F.lit(0).alias("probesStartPos"), F.col("body_checksum").alias("bodyChecksum"))
    c = t["told_coverage"].filter("method_id IS NOT NULL")
    one = F.array(F.struct("signature", F.col("body_checksum").alias("bodyChecksum"), F.coalesce("launch_id", F.lit("TEST_CONTEXT_NONE")).alias("testId"), F.coalesce("session_id", F.lit("GLOBAL")).alias("testSessionId"), F.col("probes").alias("stringProbes")))
    definition = F.array(F.struct(F.col("definition_id").alias("id"), F.col("test_runner").alias("runner"), F.col("test_name").alias("name"), F.col("test_path").alias("path"), F.split("tags", ",").alias("tags")))
    launch = F.array(F.struct(F.col("launch_id").alias("id"), F.col("definition_id").alias("testDefinitionId"), "result", "duration"))
    ended = t["ended_launches"]
    links = t["session_builds"].groupBy("session_id").agg(F.collect_list(F.struct(F.col("app_id").alias("appId"), F.split_part("build_id", F.lit(":"), F.lit(3)).alias("buildVersion"))).alias("builds"))
    told = t["definitions"].select(F.col("group_id").alias("groupId"), definition.alias("definitions"), F.explode(F.array(F.lit("1990-01-01").cast("timestamp_ntz"), "updated_at")).alias("at"))  # before all launches, and again
    parts = [
        _record(b.select(*_head(), F.col("commit_sha").alias("commitSha"), "created_at"), "builds"),
        _record(b.select(*_head(), "branch", "created_at"), "builds-info"),
        _record(t["instances"].select(*_head(), F.col("instance_id").alias("instanceId"), F.col("env_id").alias("envId"), "created_at"), "instances"),
        _record(m1.groupBy("group_id", "app_id", "build_id", F.floor(F.col("p_partkey") / A_PAYLOAD)).agg(F.collect_list(method).alias("methods"), F.min("year_at").alias("created_at")).select(*_head(), "methods", "created_at"), "methods"),
        _record(c.select(*_head(), F.col("instance_id").alias("instanceId"), one.alias("coverage"), "created_at"), "coverage"),
        _record(told, "test-definitions", "at"),
        _record(ended.select(F.col("group_id").alias("groupId"), F.col("session_id").alias("testSessionId"), launch.alias("launches"), "created_at"), "test-launches"),
        _record(t["sessions"].join(links, "session_id", "left").select(F.col("session_id").alias("id"), F.col("group_id").alias("groupId"), F.col("task_id").alias("testTaskId"), "builds", "created_at"), "test-sessions"),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def ended_launches(t) -> DataFrame:
    """Launches at the time of the last of their coverage."""
    last = t["raw_coverage"].filter("launch_id IS NOT NULL").groupBy("launch_id").agg(F.max("created_at").alias("_last"))
    return t["launches"].join(last, "launch_id", "left").withColumn("created_at", F.greatest("created_at", "_last")).drop("_last")


#: Rows of a file of records at most, as a compressed one is read by one task.
A_FILE = 250_000
_loaded: dict[str, Store] = {}


def loaded(t) -> Store:
    """The metric store after both halves, once for the derived tables' folder."""
    if t.root not in _loaded:
        here = f"{t.root}/records/{uuid.uuid4().hex}"
        late = F.col("ts") > F.lit(str(MIDDLE)).cast("timestamp_ntz")
        raw, metrics = store(t), store(t)
        managed.create_rules(raw, t["rules"])
        # what both halves' records are made of is folded once
        with raw.staged(ended_launches(t)) as ended, raw.staged(t["session_builds"]) as links:
            every = records(t | {"ended_launches": ended, "session_builds": links})
            for half, until in ((~late, MIDDLE), (late, END)):
                every.filter(half).write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", A_FILE).json(f"{here}/in")
                ingest_stream.run(ingest_stream.from_files(t.spark, f"{here}/in"), raw, f"{here}/checkpoint").awaitTermination()
                run(metrics, raw_layer.raw_tables(raw), None, until=until)
        _loaded[t.root] = metrics
    return _loaded[t.root]


def methods_with_coverage(t, build: str) -> DataFrame:
    return coverage.methods_with_coverage(metric_tables(loaded(t)), [build])


def impacted_tests(t, build: str, baseline: str) -> DataFrame:
    return impact.impacted_tests(metric_tables(loaded(t)), build, baseline, statuses=None)


def refreshed(t) -> DataFrame:
    """The pipelines' last state over both runs."""
    return loaded(t).read("etl_metadata").select("pipeline", "status", F.col("last_processed_at").cast("string").alias("until"))


#: Pipelines that run without being asked.
SCHEDULED = tuple(p for p in etl.PIPELINES if p not in etl.ON_DEMAND)
