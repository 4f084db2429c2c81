"""Ingest and streaming operators as queries: payloads are made from the derived tables, then ingested."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelight.functions import probes
from probelight.functions.formats import format_duration, format_duration_rounded, method_pattern
from probelight.sources import payloads

from .stored import shared_dir

TS = "TIMESTAMP_NTZ '2001-01-01 00:00:00'"
#: Rows of one payload at most, as a sender bounds its batches; those of a build or session grow with the data.
A_PAYLOAD = 1000


def _records(df: DataFrame, key: str) -> DataFrame:
    """One JSON record for each row."""
    return df.select(F.lit(key).alias("key"), F.to_json(F.struct("*")).alias("value"), F.expr(TS).alias("ts"))


def _parsed(df: DataFrame, key: str) -> DataFrame:
    return payloads.split_records(_records(df, key))[0][key]


def _head() -> list:
    return [F.col("group_id").alias("groupId"), F.col("app_id").alias("appId"), F.split_part("build_id", F.lit(":"), F.lit(3)).alias("buildVersion")]


def _batch(number: Column) -> Column:
    """The payload that a row goes into, by a number that its payload's other rows don't have."""
    return F.floor(number / A_PAYLOAD).alias("_batch")


def builds(t):
    b = t["builds"].select(*_head(), F.col("commit_sha").alias("commitSha"), F.lit("x").alias("unknownField"))
    return payloads.save_builds(_parsed(b, "builds")).select("id", "app_id", "build_version", "commit_sha")


def build_infos(t):
    b = t["builds"].select(*_head(), "branch", F.concat(F.lit("Tue Mar 4 05:06:07 "), F.col("y").cast("string"), F.lit(" +0300")).alias("commitDate"))
    return payloads.save_build_info(_parsed(b, "builds-info")).select("id", "branch", F.date_format("committed_at", "yyyy-MM-dd HH:mm:ss").alias("committed_at"))


def instances(t):
    i = t["instances"].select(*_head(), F.col("instance_id").alias("instanceId"), F.col("env_id").alias("envId"))
    return payloads.save_instances(_parsed(i, "instances"))[0].select("id", "build_id", "env_id", "status")


def missing_builds(t):
    i = t["instances"].select(*_head(), F.col("instance_id").alias("instanceId"), F.col("env_id").alias("envId"))
    known = t["builds"].filter("y % 2 = 0").select(F.col("build_id").alias("id"))
    return payloads.save_instances(_parsed(i, "instances"), known)[1].select("id", "app_id")


def heartbeats(t):
    li = t["li"]
    p = li.select(F.concat_ws(":", "build_id", "env_id").alias("instanceId"), F.when(F.col("l_linenumber") % 2 == 0, "SHUTDOWN").otherwise("RUNNING").alias("status"), "created_at", "l_orderkey", "l_linenumber")
    one = p.groupBy("instanceId", "created_at").agg(F.min("status").alias("status"))
    known = t["instances"].select(F.col("instance_id").alias("id"), F.lit("RUNNING").alias("status"))
    return payloads.heartbeats(one, known).select("id", "status", F.date_format("last_heartbeat_at", "yyyy-MM-dd").alias("day"))


def _methods(t) -> DataFrame:
    m = F.struct(F.col("class_name").alias("classname"), F.col("method_name").alias("name"), F.col("method_params").alias("params"), F.col("return_type").alias("returnType"), F.col("probes_count").alias("probesCount"), F.lit(0).alias("probesStartPos"), F.col("body_checksum").alias("bodyChecksum"))
    return _parsed(t["m1"].groupBy("build_id", "group_id", "app_id", _batch(F.col("p_partkey"))).agg(F.collect_list(m).alias("methods")).select(*_head(), "methods"), "methods")


def methods(t):
    return payloads.save_methods(_methods(t))[0].select("app_id", "method_id", "signature", F.col("probes_count").cast("long").alias("probes_count"))


def build_methods(t):
    return payloads.save_methods(_methods(t), t["builds"].filter("y = 1997").select("build_id"))[1].select("build_id", "method_id")


def coverage(t):
    c = t["raw_coverage"].join(t["raw_methods"].select("app_id", "method_id", "signature", "body_checksum"), ["app_id", "method_id"])
    flags = F.transform(F.filter(F.split("probes", ""), lambda x: x != ""), lambda x: x == "1")
    as_bools = F.col("instance_id").endswith("A")
    row = F.struct("signature", F.col("body_checksum").alias("bodyChecksum"), F.coalesce("launch_id", F.lit("TEST_CONTEXT_NONE")).alias("testId"), F.lit("GLOBAL").alias("testSessionId"), F.when(as_bools, flags).alias("probes"), F.when(~as_bools, F.col("probes")).alias("stringProbes"))
    p = c.groupBy("build_id", "group_id", "app_id", "day", F.hour("created_at")).agg(F.collect_list(row).alias("coverage")).select(*_head(), "coverage")
    return payloads.save_coverage(_parsed(p, "coverage")).select("app_id", "build_id", "method_id", "test_id", "probes")


def definitions(t):
    d = F.struct(F.col("definition_id").alias("id"), F.col("test_runner").alias("runner"), F.col("test_name").alias("name"), F.col("test_path").alias("path"), F.split("tags", ",").alias("tags"))
    number = F.substr("definition_id", F.lit(2)).cast("long")
    p = t["definitions"].groupBy(F.col("group_id").alias("groupId"), "test_path", _batch(number)).agg(F.collect_list(d).alias("definitions")).select("groupId", "definitions")
    return payloads.save_test_definitions(_parsed(p, "test-definitions")).select("id", "name", "path", "runner", F.array_join("tags", ",").alias("tags"))


def launches(t):
    l = F.struct(F.col("launch_id").alias("id"), F.col("definition_id").alias("testDefinitionId"), "result", "duration")
    p = t["launches"].groupBy(F.col("group_id").alias("groupId"), F.col("session_id").alias("testSessionId"), _batch(F.col("launch_id").cast("long"))).agg(F.collect_list(l).alias("launches")).drop("_batch")
    return payloads.save_test_launches(_parsed(p, "test-launches")).select("id", "test_session_id", "test_definition_id", "result", F.col("duration").cast("long").alias("duration"))


def metadata(t):
    details = F.struct(F.lit("junit").alias("runner"), F.lit("p").alias("path"), F.concat(F.lit("n"), F.col("definition_id")).alias("testName"))
    x = F.struct(F.col("launch_id").alias("testLaunchId"), F.col("definition_id").alias("testDefinitionId"), "result", "duration", details.alias("details"))
    p = t["launches"].groupBy(F.col("group_id").alias("groupId"), F.col("session_id").alias("sessionId"), _batch(F.col("launch_id").cast("long"))).agg(F.collect_list(x).alias("tests")).drop("_batch")
    return payloads.save_test_metadata(_parsed(p, "test-metadata"))[1].select("id", "type", "name").distinct()


def sessions(t):
    s = F.struct(F.split_part("build_id", F.lit(":"), F.lit(2)).alias("appId"), F.split_part("build_id", F.lit(":"), F.lit(3)).alias("buildVersion"))
    p = t["session_builds"].groupBy(F.col("session_id").alias("id"), F.col("group_id").alias("groupId")).agg(F.collect_list(s).alias("builds")).withColumn("testTaskId", F.lit("check"))
    return payloads.save_test_sessions(_parsed(p, "test-sessions"))[1].select("test_session_id", "build_id")


def settings(t):
    saved = t["rules"].select("group_id").distinct().withColumns({"retention_period_days": F.lit(30), "metrics_period_days": F.lit(None).cast("int")})
    return payloads.group_settings(t["builds"].withColumn("group_id", F.concat_ws("-", "group_id", F.when(F.col("y") > 1999, "new"))), saved, None, 90)


def _class_parts(t) -> DataFrame:
    w = Window.partitionBy("build_id", "class_name").orderBy("p_partkey").rowsBetween(Window.unboundedPreceding, -1)
    bits = F.expr("substr(repeat(CASE p_partkey % 3 WHEN 0 THEN '100' WHEN 1 THEN '001' ELSE '000' END, 44), 1, CAST(probes_count AS INT))")
    return t["m1"].select("build_id", "class_name", "method_id", "p_partkey", "probes_count", F.coalesce(F.sum("probes_count").over(w), F.lit(0)).alias("probe_start_pos"), bits.alias("bits"))


def class_probes(t):
    return probes.concat_by_position(_class_parts(t), ["build_id", "class_name"], "probe_start_pos", "bits")


def method_slices(t):
    parts = _class_parts(t)
    whole = probes.concat_by_position(parts, ["build_id", "class_name"], "probe_start_pos", "bits").withColumnRenamed("bits", "class_probes")
    m = parts.select("build_id", "class_name", "method_id", F.col("probe_start_pos").cast("int"), F.col("probes_count").cast("int"))
    return probes.split_class_probes(whole, m, ["build_id", "class_name"]).select("build_id", "method_id", "probes")


def durations(t):
    return t["launches"].select("launch_id", format_duration(F.col("duration") * 1000).alias("text"), format_duration_rounded(F.col("duration") * 1000).alias("rounded"))


def by_criteria(t):
    return t["methods"].filter(F.col("signature").like(method_pattern(cls="com/Brand1%"))).select("app_id", "method_id")


_PARTS = ("parts", """SELECT build_id, class_name, method_id, p_partkey, probes_count, coalesce(sum(probes_count) OVER (PARTITION BY build_id, class_name ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos,
  substr(repeat(CASE p_partkey % 3 WHEN 0 THEN '100' WHEN 1 THEN '001' ELSE '000' END, 44), 1, probes_count::INT) AS bits FROM m1""")  # fmt: skip
_MS = "(duration * 1000)"
_TEXT = f"CASE WHEN {_MS} = 0 THEN '0ms' ELSE concat_ws(' ', " + ", ".join(f"CASE WHEN {e} > 0 THEN ({e})::VARCHAR || '{u}' END" for u, e in (("d", f"{_MS} // 86400000"), ("h", f"{_MS} // 3600000 % 24"), ("m", f"{_MS} // 60000 % 60"), ("s", f"{_MS} // 1000 % 60"), ("ms", f"{_MS} % 1000"))) + ") END"
_ROUND = "CASE " + " ".join(f"WHEN {_MS} >= {n} THEN ({_MS} // {n})::VARCHAR || '{u}'" for u, n in (("d", 86400000), ("h", 3600000), ("m", 60000), ("s", 1000), ("ms", 1))) + " ELSE '0ms' END"

#: name -> (query over derived tables, DuckDB query, further CTEs)
REGISTERED = {
    "i3_save_builds": (builds, "SELECT build_id AS id, app_id, y::VARCHAR AS build_version, commit_sha FROM builds"),
    "i4_save_build_info": (build_infos, "SELECT build_id AS id, branch, y::VARCHAR || '-03-04 05:06:07' AS committed_at FROM builds"),
    "i5_save_instances": (instances, "SELECT instance_id AS id, build_id, env_id, 'RUNNING' AS status FROM instances"),
    "i5_missing_builds": (missing_builds, "SELECT build_id AS id, app_id FROM builds WHERE y % 2 <> 0"),
    "i6_heartbeats": (heartbeats, "SELECT build_id || ':' || env_id AS id, arg_max(s, created_at) AS status, max(created_at)::DATE::VARCHAR AS day FROM (SELECT build_id, env_id, created_at, min(CASE WHEN l_linenumber % 2 = 0 THEN 'SHUTDOWN' ELSE 'RUNNING' END) AS s FROM li GROUP BY ALL) WHERE build_id || ':' || env_id IN (SELECT instance_id FROM instances) GROUP BY build_id, env_id"),
    "i7_save_methods": (methods, "SELECT app_id, method_id, signature, probes_count FROM raw_methods"),
    "i7_save_build_methods": (build_methods, "SELECT build_id, method_id FROM raw_build_methods WHERE build_id NOT LIKE '%:1997'"),
    "i8_save_coverage": (coverage, "SELECT app_id, build_id, method_id, launch_id AS test_id, probes FROM raw_coverage"),
    "i9_save_test_definitions": (definitions, "SELECT definition_id AS id, test_name AS name, test_path AS path, test_runner AS runner, tags FROM definitions"),
    "i10_save_test_launches": (launches, "SELECT launch_id AS id, session_id AS test_session_id, definition_id AS test_definition_id, result, duration FROM launches"),
    "i11_save_test_metadata": (metadata, "SELECT DISTINCT definition_id AS id, 'placeholder' AS type, 'n' || definition_id AS name FROM launches"),
    "i12_save_test_sessions": (sessions, "SELECT session_id AS test_session_id, build_id FROM session_builds"),
    "i15_group_settings": (settings, "SELECT DISTINCT group_id || CASE WHEN y > 1999 THEN '-new' ELSE '' END AS group_id, CASE WHEN y <= 1999 THEN 30 END AS retention_period_days, 90 AS metrics_period_days FROM builds"),
    "i16_class_probes_to_methods": (method_slices, "SELECT build_id, method_id, bits AS probes FROM parts WHERE bits LIKE '%1%'", _PARTS),
    "i17_concat_by_position": (class_probes, "SELECT build_id, class_name, string_agg(bits, '' ORDER BY pos) AS bits FROM parts GROUP BY build_id, class_name", _PARTS),
    "x_format_duration": (durations, f"SELECT launch_id, {_TEXT} AS text, {_ROUND} AS rounded FROM launches"),
    "r18_method_criteria": (by_criteria, "SELECT app_id, method_id FROM methods WHERE class_name LIKE 'com/Brand1%'"),
}


def quarantine(spark, sf_dir: str) -> DataFrame:
    """Events as records, their type as key: only those named like a payload and with good JSON pass."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    key = F.when(F.col("event_type") == "signup", "builds").when(F.col("event_type") == "view", "methods").otherwise(F.col("event_type"))
    value = F.when((F.col("event_type") == "view") & (F.col("event_id") % 2 == 0), F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    _, bad = payloads.split_records(e.select(key.alias("key"), value.alias("value"), "ts"))
    return bad.groupBy("key").agg(F.count("*").alias("n"))


QUARANTINE_SQL = """
SELECT CASE event_type WHEN 'view' THEN 'methods' ELSE event_type END AS key, count(*) AS n FROM events
WHERE event_type NOT IN ('signup', 'view') OR event_type = 'view' AND event_id % 2 = 0 GROUP BY ALL"""


def _stream_store(spark, *deltas: str):
    """(a store in the shared folder that goes when the application ends, with further tables kept as deltas; a folder for checkpoints in it)."""
    from probelight.operators.upsert import DELTAS, Store

    root = f"{shared_dir(spark)}/daily-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return Store(spark, root, deltas=(*DELTAS, *deltas)), f"{root}/checkpoint"


def daily_stream(spark, sf_dir: str) -> DataFrame:
    """Daily counts of the events as a stream, which keeps the open days as state and upserts the days that change."""
    from probelight.streaming.ingest_stream import daily_counts, upsert_changes

    path = f"{sf_dir}/events*.parquet"  # a glob: a stream reads no single file
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    store, checkpoint = _stream_store(spark)
    counts = daily_counts(stream.withColumn("ts", F.col("ts").cast("timestamp"))).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "value")
    upsert_changes(counts, store, "daily", ["day", "event_type"], "replace", checkpoint).awaitTermination()
    return store.read("daily").select("day", "event_type", "n", F.round("value", 2).alias("value"))


#: Micro-batches of a stream at most: beyond two files a batch, batches grow with the data, not their number.
BATCHES = 8


def daily_coverage_stream(t) -> DataFrame:
    """Daily method coverage of the facts as a stream, some files a micro-batch in any order of time, however late.

    As a batch may concern any month, the table is kept as deltas: a batch writes its own rows, once.
    """
    from probelight.operators import transform
    from probelight.streaming.ingest_stream import or_daily_coverage

    from .derive import WORDS

    facts, folder = t["plain_facts"], f"{t.root}/streamed-facts-{uuid.uuid4().hex}"
    facts = facts.select(*(c for c in transform.DAY_KEYS if c != "day"), "at", "probes")
    facts.write.parquet(folder)
    files = len(t.spark.read.schema(facts.schema).parquet(folder).inputFiles())
    stream = t.spark.readStream.schema(facts.schema).option("maxFilesPerTrigger", max(2, -(-files // BATCHES))).parquet(folder)
    store, checkpoint = _stream_store(t.spark, "method_daily_coverage")
    or_daily_coverage(stream, store, "method_daily_coverage", WORDS, checkpoint).awaitTermination()
    return store.read("method_daily_coverage").drop("group_id")


DAILY_SQL = "SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ts::DATE, event_type"
