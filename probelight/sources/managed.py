"""Rows that users manage beside the ingested ones: method ignore rules and requests for coverage, kept in the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelight.operators.upsert import Store

from .payloads import ignore_rule

RULE = "group_id string, app_id string, name_pattern string, classname_pattern string"
REQUEST_KEYS = ["group_id", "session_id", "definition_id"]


def rule_id() -> Column:
    """A rule's id, the same for the same rule."""
    return F.md5(F.concat_ws("\x00", "group_id", "app_id", F.coalesce("name_pattern", F.lit("")), F.coalesce("classname_pattern", F.lit(""))))


def create_rules(store: Store, rules: DataFrame) -> None:
    """Adds rules; one that is there already stays as it is."""
    store.upsert("ignore_rules", rules.withColumn("id", rule_id()), ["id"], "keep")


def create_rule(store: Store, group: str, app: str, name_pattern: str | None = None, classname_pattern: str | None = None) -> None:
    create_rules(store, store.spark.createDataFrame([ignore_rule(group, app, name_pattern, classname_pattern)], RULE))


def list_rules(store: Store, group: str | None = None, app: str | None = None) -> DataFrame:
    rules = store.read("ignore_rules")
    out = store.spark.createDataFrame([], f"{RULE}, id string") if rules is None else rules
    for c, v in (("group_id", group), ("app_id", app)):
        out = out.filter(F.col(c) == v) if v is not None else out
    return out


def delete_rule(store: Store, rule: str) -> None:
    store.delete("ignore_rules", F.col("id") == rule)


def request_coverage(store: Store, requests: DataFrame) -> None:
    """Adds or renews requests (group_id, session_id, definition_id, requested_at); a null definition asks for the whole session."""
    new = requests.select("group_id", "session_id", F.coalesce("definition_id", F.lit("")).alias("definition_id"), "requested_at", F.col("requested_at").alias("created_at"))
    store.upsert("coverage_requests", new, REQUEST_KEYS, "replace", ["requested_at"])


def delete_request(store: Store, group: str, session: str, definition: str | None = None) -> None:
    """Deletes one request; without a definition that of the whole session, not those of its definitions."""
    store.delete("coverage_requests", (F.col("group_id") == group) & (F.col("session_id") == session) & (F.col("definition_id") == (definition or "")))
