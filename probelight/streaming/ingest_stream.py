"""Structured Streaming ingest: records from Kafka or JSON files, written to the raw tables in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from probelight.functions import probes
from probelight.operators import transform
from probelight.operators.upsert import Store
from probelight.sources import payloads

RECORD = "key string, value string, ts timestamp_ntz"


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """Records as JSON lines (key, value, ts)."""
    return spark.readStream.schema(RECORD).json(path)


def from_kafka(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Records of a topic from its start, with headers; needs Spark's Kafka package."""
    raw = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "includeHeaders": "true"} | options).load()
    return raw.select(F.col("key").cast("string"), F.col("value").cast("string"), F.col("timestamp").cast("timestamp_ntz").alias("ts"), "headers")


def write_batch(records: DataFrame, store: Store, stream: str | None = None, batch: int = 0) -> None:
    """One micro-batch into the raw tables; a batch that is run again changes nothing.

    Coverage and quarantined records are logs: a batch adds its rows once, by the number of the stream's batch.  The other
    tables are upserted; repeated rows of a key follow their time.  A record is parsed once, into a folder that goes after
    the batch: a batch of any size is held by no executor, and each payload type reads its own columns and row groups.
    """
    with store.staged(payloads.parsed(records.select("key", "value", "ts"))) as rows:
        p, bad = payloads.split_parsed(rows)
        here = {r["_kind"] for r in rows.select("_kind").distinct().collect()}  # at most the known keys and null
        if None in here:
            store.append("quarantine", bad, stream, batch)
        up = store.upsert
        if "builds" in here:
            new = payloads.kept_from(store.read("builds"), payloads.save_builds(p["builds"]), "created_at")
            up("builds", new.withColumn("_at", F.col("updated_at")), ["id", "group_id", "app_id"], "replace", order="_at")
        if "builds-info" in here:
            up("build_infos", payloads.save_build_info(p["builds-info"]), ["id", "group_id", "app_id"], "replace")
        if "instances" in here:
            instances, builds = payloads.save_instances(p["instances"], store.read("builds"))
            instances = payloads.kept_from(store.read("instances"), instances.withColumn("last_heartbeat_at", F.lit(None).cast("timestamp_ntz")), "status", "created_at", "last_heartbeat_at")
            up("instances", instances, ["id"], "replace")
            up("builds", builds, ["id", "group_id", "app_id"], "replace")
        if "heartbeats" in here and (known := store.read("instances")) is not None:
            mine = known.join(p["heartbeats"].select(F.col("instanceId").alias("id")).distinct(), "id", "left_semi")
            up("instances", payloads.heartbeats(p["heartbeats"], mine), ["id"], "replace")
        if "methods" in here:
            methods, links = payloads.save_methods(p["methods"], store.read("finalized"))
            up("methods", methods, ["group_id", "app_id", "method_id"], "keep")
            up("build_methods", links, ["build_id", "group_id", "app_id", "method_id"], "keep")
        if "coverage" in here:
            store.append("method_coverage", payloads.save_coverage(p["coverage"]), stream, batch)
        definitions = [payloads.save_test_definitions(p["test-definitions"])] if "test-definitions" in here else []
        launches = [payloads.save_test_launches(p["test-launches"])] if "test-launches" in here else []
        if "test-metadata" in here:
            a, b = payloads.save_test_metadata(p["test-metadata"])
            launches.append(a)
            definitions.append(b)
        for x in definitions:
            up("test_definitions", x.withColumn("_at", F.col("updated_at")), ["id", "group_id"], "replace", order="_at")
        for x in launches:
            up("test_launches", x.withColumn("_at", F.col("created_at")), ["id", "group_id"], "replace", order="_at")
        if "test-sessions" in here:
            up("test_sessions", payloads.save_sessions(p["test-sessions"]).withColumn("_at", F.col("created_at")), ["id", "group_id"], "replace", order="_at")


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark keeps in a query's checkpoint: the same after a restart, another one for a new checkpoint."""
    return spark.read.json(f"{checkpoint.rstrip('/')}/metadata").first().id


def run(stream: DataFrame, store: Store, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts the query; ``availableNow=True`` drains what is there and stops."""
    trigger = trigger or {"availableNow": True}
    write = lambda df, n: write_batch(df, store, _stream_id(store.spark, checkpoint), n)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def daily_counts(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Tumbling daily counts by event type with a watermark for late events."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def daily_coverage(facts: DataFrame, width: int, delay: str = "1 day") -> DataFrame:
    """The fold of method_daily_coverage over a stream of facts with their time ``at``: one state row for each open day and key.

    Facts later than the watermark are dropped, and days before it leave the state.  ``width``: the most words of a vector.
    """
    keys = [c for c in transform.DAY_KEYS if c != "day"]
    words = facts.select(*keys, F.col("at").cast("timestamp").alias("at"), probes.to_words(F.col("probes")).alias("probes"))
    by_day = words.withWatermark("at", delay).groupBy(F.window("at", "1 day").alias("_window"), *keys)
    size = F.max(F.when(F.size("probes") > width, F.raise_error(F.lit(f"a vector has more than {width} words")).cast("int")).otherwise(F.size("probes")))
    vector = F.slice(F.array(*(F.bit_or(F.get("probes", k)) for k in range(width))), F.lit(1), size)
    return by_day.agg(vector.alias("probes")).select(*keys, F.to_date("_window.start").alias("day"), "probes")


def or_daily_coverage(facts: DataFrame, store: Store, table: str, width: int, checkpoint: str, **trigger) -> StreamingQuery:
    """The fold of method_daily_coverage over a stream of facts that may be late by any time, without state: no day closes.

    A micro-batch is folded by itself and OR-ed into the table, which has to be among the store's ``deltas``: executors hold
    no keys between batches, and a batch writes what it brings.  A batch that is run again changes nothing.
    """
    trigger = trigger or {"availableNow": True}
    fold = lambda df: transform.method_daily_coverage(df.withColumn("day", F.to_date("at")), width)
    write = lambda df, _: store.upsert(table, fold(df), transform.DAY_KEYS, "or", width=width)
    return facts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def upsert_changes(changes: DataFrame, store: Store, table: str, keys: list[str], policy: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes the rows that each micro-batch changed (``update`` mode) into a table by key, so closed windows need no state.

    A batch that is run again changes nothing, as a window's row has all that the window had so far.
    """
    trigger = trigger or {"availableNow": True}
    write = lambda df, _: store.upsert(table, df, keys, policy)
    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
