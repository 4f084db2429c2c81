"""Always-on aggregations: builds, test definitions, sessions, files, and definitions within sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelight.functions.formats import format_duration

Tables = dict[str, DataFrame]
FLAGS = ("passed", "failed", "skipped", "smart_skipped", "success")


def _sums() -> list[Column]:
    return [F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in FLAGS]


def _result() -> Column:
    some = lambda c: F.max(F.coalesce(c, F.lit(0))) > 0
    return F.when(some("failed"), "FAILED").when(some("passed"), "PASSED").when(some("smart_skipped"), "SMART_SKIPPED").when(some("skipped"), "SKIPPED").otherwise("UNKNOWN")


def builds_with_statistics(t: Tables) -> DataFrame:
    bm = t["build_methods"].join(t["methods"], ["group_id", "app_id", "method_id"], "left").groupBy("build_id").agg(
        F.count_distinct("class_name").alias("total_classes"), F.count_distinct("signature").alias("total_methods"), F.sum(F.coalesce("probes_count", F.lit(0))).cast("long").alias("total_probes"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return t["builds"].join(bm, "build_id", "left").select(*t["builds"].columns, zero("total_classes"), zero("total_methods"), zero("total_probes"))


def definitions_with_statistics(t: Tables) -> DataFrame:
    """A definition that was never launched has one launch and no success rate, as a left join counts."""
    keys = ["group_id", "definition_id", "test_path", "test_name", "test_runner", "tags"]
    joined = t["definitions"].join(t["test_launches"], ["group_id", "definition_id"], "left")
    out = joined.groupBy(*keys).agg(F.count("*").alias("launches"), F.avg(F.coalesce("duration", F.lit(0))).alias("avg_duration"), *_sums(), F.sum("success").alias("_s"))
    return out.withColumn("success_rate", F.col("_s").cast("double") / F.col("launches")).drop("_s")


def sessions_with_statistics(t: Tables) -> DataFrame:
    d = definitions_with_statistics(t).select("group_id", "definition_id", F.round("avg_duration").cast("long").alias("_avg"))
    joined = t["sessions"].join(t["test_launches"], ["group_id", "session_id"], "left").join(d, ["group_id", "definition_id"], "left")
    out = joined.groupBy("group_id", "session_id", "task_id", "started_day").agg(
        F.count_distinct("definition_id").alias("definitions"), F.count("*").alias("launches"), _result().alias("result"), F.sum(F.coalesce("duration", F.lit(0))).cast("long").alias("duration"),
        *_sums(), F.sum("success").alias("_s"), F.sum(F.when(F.col("smart_skipped") == 1, F.col("_avg")).otherwise(0)).cast("long").alias("time_saved"))
    return out.withColumn("success_rate", F.col("_s").cast("double") / F.col("launches")).drop("_s")


def file_launches(t: Tables) -> DataFrame:
    joined = t["definitions"].join(t["test_launches"], ["group_id", "definition_id"], "left")
    return joined.groupBy("group_id", "test_path", "session_id").agg(
        F.count_distinct("definition_id").alias("definitions"), F.count_distinct("launch_id").alias("launches"), _result().alias("result"), F.sum(F.coalesce("duration", F.lit(0))).cast("long").alias("duration"), *_sums())


def session_definitions(t: Tables) -> DataFrame:
    joined = t["sessions"].join(t["test_launches"], ["group_id", "session_id"]).join(t["definitions"], ["group_id", "definition_id"])
    out = joined.groupBy("group_id", "session_id", "definition_id").agg(
        F.min("test_path").alias("test_path"), F.min("test_name").alias("test_name"), F.sum(F.coalesce("duration", F.lit(0))).cast("long").alias("duration"), _result().alias("result"),
        F.array_join(F.min(F.split("tags", ",")), ", ").alias("tags"))
    return out.withColumn("duration_text", format_duration(F.col("duration")))
