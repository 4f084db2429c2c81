"""Ingest payloads: schemas by record key, and their transforms into raw tables.

A record is (key, value): the key names the payload type, the value is its JSON.  Unknown keys and bad JSON go to
quarantine; fields that a schema doesn't know are ignored.  Every transform is relational and works on streams'
micro-batches as on batches.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelight.functions.formats import build_id, git_date, method_id, signature

_BUILD = "groupId string, appId string, commitSha string, buildVersion string"
SCHEMAS = {
    "builds": f"{_BUILD}, instanceId string, agentVersion string, agentEnvironment string, agentParams string",
    "builds-info": f"{_BUILD}, branch string, commitDate string, commitMessage string, commitAuthor string",
    "instances": f"{_BUILD}, instanceId string, envId string, agentVersion string",
    "heartbeats": "groupId string, appId string, instanceId string, status string",
    "methods": f"{_BUILD}, instanceId string, methods array<struct<classname:string,name:string,params:string,returnType:string,probesCount:int,probesStartPos:int,bodyChecksum:string>>",
    "coverage": f"{_BUILD}, instanceId string, coverage array<struct<signature:string,bodyChecksum:string,testId:string,testSessionId:string,probes:array<boolean>,stringProbes:string>>",
    "test-definitions": "groupId string, definitions array<struct<id:string,type:string,runner:string,name:string,path:string,tags:array<string>,metadata:string>>",
    "test-launches": "groupId string, testSessionId string, launches array<struct<id:string,testDefinitionId:string,result:string,duration:int>>",
    "test-metadata": "groupId string, sessionId string, tests array<struct<testLaunchId:string,testDefinitionId:string,result:string,duration:int,details:struct<runner:string,path:string,testName:string,testParams:array<string>,metadata:string,tags:array<string>>>>",
    "test-sessions": "id string, groupId string, testTaskId string, startedAt timestamp_ntz, builds array<struct<appId:string,instanceId:string,commitSha:string,buildVersion:string>>",
}


def split_records(records: DataFrame, key: str = "key", value: str = "value", at: str = "ts") -> tuple[dict[str, DataFrame], DataFrame]:
    """(payloads by key with their time ``at``, quarantined records)."""
    good, bad = {}, records.filter(F.col(key).isNull() | ~F.col(key).isin(list(SCHEMAS)))
    for k in SCHEMAS:
        mine = records.filter(F.col(key) == k).withColumn("_p", _payload(value, k))
        broken = _broken(F.col("_p"))
        good[k] = mine.filter(~broken).select("_p.*", F.col(at).alias("created_at")).drop("_bad")
        bad = bad.unionByName(mine.filter(broken).drop("_p"))
    return good, bad


def _payload(value: str, kind: str) -> Column:
    return F.from_json(value, f"{SCHEMAS[kind]}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})


def _broken(payload: Column) -> Column:
    return payload.isNull() | payload["_bad"].isNotNull()


def parsed(records: DataFrame) -> DataFrame:
    """Records (key, value, ts), each parsed once: its payload in a column named after its type, the type as ``_kind``.

    Of unknown keys and bad JSON ``_kind`` is null, and only these keep their value.
    """
    rows = records.select("*", *(F.when(F.col("key") == k, _payload("value", k)).alias(k) for k in SCHEMAS))
    kind = F.coalesce(*(F.when((F.col("key") == k) & ~_broken(F.col(k)), k) for k in SCHEMAS))
    return rows.withColumn("_kind", kind).withColumn("value", F.when(F.col("_kind").isNull(), F.col("value")))


def split_parsed(rows: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """``split_records`` of what ``parsed`` gave."""
    good = {k: rows.filter(F.col("_kind") == k).select(F.col(k).alias("_p"), F.col("ts").alias("created_at")).select("_p.*", "created_at").drop("_bad") for k in SCHEMAS}
    return good, rows.filter("_kind IS NULL").select("key", "value", "ts")


def _build(df: DataFrame, prefix: str = "") -> DataFrame:
    c = lambda n: F.col(f"{prefix}{n}")
    instance = c("instanceId") if f"{prefix}instanceId" in df.columns or prefix else F.lit(None).cast("string")
    return df.withColumn("build_id", build_id(F.col("groupId"), c("appId"), c("buildVersion"), c("commitSha"), instance))


def save_builds(p: DataFrame) -> DataFrame:
    return _build(p).select(F.col("build_id").alias("id"), F.col("groupId").alias("group_id"), F.col("appId").alias("app_id"), F.col("commitSha").alias("commit_sha"), F.col("buildVersion").alias("build_version"), "created_at", F.col("created_at").alias("updated_at"))


def save_build_info(p: DataFrame) -> DataFrame:
    return _build(p).select(F.col("build_id").alias("id"), F.col("groupId").alias("group_id"), F.col("appId").alias("app_id"), "branch", git_date(F.col("commitDate")).alias("committed_at"), F.col("commitAuthor").alias("commit_author"), F.col("commitMessage").alias("commit_message"), F.col("created_at").alias("updated_at"))


def save_instances(p: DataFrame, builds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(instances, builds that weren't there yet)."""
    rows = _build(p)
    instances = rows.select(F.col("instanceId").alias("id"), F.col("groupId").alias("group_id"), F.col("appId").alias("app_id"), "build_id", F.col("envId").alias("env_id"), F.lit("RUNNING").alias("status"), "created_at")
    new = save_builds(p).dropDuplicates(["id"])
    return instances, new if builds is None else new.join(builds.select("id"), "id", "left_anti")


def heartbeats(p: DataFrame, instances: DataFrame) -> DataFrame:
    """The instances, those with a heartbeat with the status and time of their latest one."""
    last = p.groupBy(F.col("instanceId").alias("id")).agg(F.max_by("status", "created_at").alias("_s"), F.max("created_at").alias("_t"))
    old = F.col("last_heartbeat_at") if "last_heartbeat_at" in instances.columns else F.lit(None).cast("timestamp")
    return instances.join(last, "id", "left").withColumns({"status": F.coalesce("_s", "status"), "last_heartbeat_at": F.coalesce("_t", old)}).drop("_s", "_t")


def kept_from(known: DataFrame | None, rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with the columns that a known row of their id keeps, so that they can replace it whole."""
    if known is None:
        return rows
    old = known.select("id", *(F.col(c).alias(f"_{c}") for c in columns)).dropDuplicates(["id"])
    return rows.join(old, "id", "left").withColumns({c: F.coalesce(f"_{c}", F.col(c)) for c in columns}).select(rows.columns)


def save_methods(p: DataFrame, finalized: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(methods, build methods); payloads of builds that are VALID already are rejected whole."""
    rows = _build(p)
    if finalized is not None:
        rows = rows.join(finalized.select("build_id"), "build_id", "left_anti")
    m = rows.select("groupId", "appId", "build_id", "created_at", F.explode("methods").alias("m"))
    sig = signature(F.col("m.classname"), F.col("m.name"), F.col("m.params"), F.col("m.returnType"))
    m = m.withColumns({"signature": sig, "method_id": method_id(sig, F.col("m.bodyChecksum"), F.col("m.probesCount"))})
    ids = [F.col("groupId").alias("group_id"), F.col("appId").alias("app_id"), "method_id"]
    methods = m.select(*ids, F.col("m.classname").alias("class_name"), F.col("m.name").alias("method_name"), F.col("m.params").alias("method_params"), F.col("m.returnType").alias("return_type"), F.col("m.bodyChecksum").alias("body_checksum"), "signature", F.col("m.probesCount").alias("probes_count"))
    return methods.dropDuplicates(["group_id", "app_id", "method_id"]), m.select("build_id", *ids, F.col("m.probesStartPos").alias("probe_start_pos"), "created_at").dropDuplicates(["build_id", "group_id", "app_id", "method_id"])


def save_coverage(p: DataFrame) -> DataFrame:
    """Coverage rows with at least one set bit; contexts that mean none become null."""
    c = _build(p).select("groupId", "appId", "build_id", F.col("instanceId").alias("instance_id"), "created_at", F.explode("coverage").alias("c"))
    bits = F.coalesce(F.array_join(F.transform("c.probes", lambda b: F.when(b, "1").otherwise("0")), ""), F.col("c.stringProbes"))
    c = c.withColumn("probes", bits).filter(F.col("probes").contains("1"))
    n = F.length("probes")
    return c.select(F.col("groupId").alias("group_id"), F.col("appId").alias("app_id"), "instance_id", "build_id", method_id(F.col("c.signature"), F.col("c.bodyChecksum"), n).alias("method_id"), F.nullif("c.testId", F.lit("TEST_CONTEXT_NONE")).alias("test_id"), F.nullif("c.testSessionId", F.lit("GLOBAL")).alias("test_session_id"), "probes", n.alias("probes_count"), "created_at")


def save_test_definitions(p: DataFrame) -> DataFrame:
    d = p.select("groupId", "created_at", F.explode("definitions").alias("d"))
    return d.select(F.col("d.id").alias("id"), F.col("groupId").alias("group_id"), F.col("d.type").alias("type"), F.col("d.runner").alias("runner"), F.col("d.name").alias("name"), F.col("d.path").alias("path"), F.col("d.tags").alias("tags"), F.col("d.metadata").alias("metadata"), F.col("created_at").alias("updated_at"))


def save_test_launches(p: DataFrame) -> DataFrame:
    l = p.select("groupId", "testSessionId", "created_at", F.explode("launches").alias("l"))
    return l.select(F.col("l.id").alias("id"), F.col("groupId").alias("group_id"), F.col("testSessionId").alias("test_session_id"), F.col("l.testDefinitionId").alias("test_definition_id"), F.col("l.result").alias("result"), F.col("l.duration").alias("duration"), "created_at")


def save_test_metadata(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(launches, definitions of type placeholder) of the legacy payload."""
    t = p.select("groupId", "sessionId", "created_at", F.explode("tests").alias("t"))
    launches = t.select(F.col("t.testLaunchId").alias("id"), F.col("groupId").alias("group_id"), F.col("sessionId").alias("test_session_id"), F.col("t.testDefinitionId").alias("test_definition_id"), F.col("t.result").alias("result"), F.col("t.duration").alias("duration"), "created_at")
    definitions = t.select(F.col("t.testDefinitionId").alias("id"), F.col("groupId").alias("group_id"), F.lit("placeholder").alias("type"), F.col("t.details.runner").alias("runner"), F.col("t.details.testName").alias("name"), F.col("t.details.path").alias("path"), F.col("t.details.tags").alias("tags"), F.col("t.details.metadata").alias("metadata"), F.col("created_at").alias("updated_at"))
    return launches, definitions


def save_test_sessions(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions, their builds).  A session's links replace those it had: drop its old rows first."""
    sessions = p.select("id", F.col("groupId").alias("group_id"), F.col("testTaskId").alias("test_task_id"), F.col("startedAt").alias("started_at"), "created_at")
    b = p.select("id", "groupId", "created_at", F.explode("builds").alias("b"))
    links = b.select(F.col("id").alias("test_session_id"), build_id(F.col("groupId"), F.col("b.appId"), F.col("b.buildVersion"), F.col("b.commitSha"), F.col("b.instanceId")).alias("build_id"), F.col("groupId").alias("group_id"), "created_at")
    return sessions, links.dropDuplicates(["test_session_id", "build_id"])


def save_sessions(p: DataFrame) -> DataFrame:
    """Sessions with the ids of their builds, so that a session that comes again replaces its links in one row."""
    ids = F.transform("builds", lambda b: build_id(F.col("groupId"), b["appId"], b["buildVersion"], b["commitSha"], b["instanceId"]))
    return p.select("id", F.col("groupId").alias("group_id"), F.col("testTaskId").alias("test_task_id"), F.col("startedAt").alias("started_at"), "created_at", F.array_distinct(ids).alias("build_ids"))


def ignore_rule(group: str, app: str, name_pattern: str | None = None, classname_pattern: str | None = None) -> dict:
    """A rule's row; at least one pattern that isn't empty, and each a regular expression."""
    given = [x for x in (name_pattern, classname_pattern) if x]
    if not given:
        raise ValueError("a rule needs a pattern")
    for x in given:
        re.compile(x)
    return {"group_id": group, "app_id": app, "name_pattern": name_pattern or None, "classname_pattern": classname_pattern or None}


def group_settings(builds: DataFrame, saved: DataFrame, retention_days: int | None = None, metrics_days: int | None = None) -> DataFrame:
    """All groups that have builds, with their saved periods or the defaults."""
    d = lambda c, v: F.coalesce(F.col(c), F.lit(v).cast("int")).alias(c)
    return builds.select("group_id").distinct().join(saved, "group_id", "left").select("group_id", d("retention_period_days", retention_days), d("metrics_period_days", metrics_days))
