"""Test impact: which tests and methods a change concerns, by the test-to-code mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelight.functions.formats import among, where_given

from .coverage import Tables, changes

IMPACTED, NOT_IMPACTED, UNKNOWN = "IMPACTED", "NOT_IMPACTED", "UNKNOWN_IMPACT"


def _definitions(t: Tables, tags=None, path_like: str | None = None, name_like: str | None = None) -> DataFrame:
    d = t["definitions"]
    wanted = F.coalesce(F.arrays_overlap(F.split("tags", ","), F.array(*map(F.lit, tags))), F.lit(False)) if tags else None
    return where_given(d, wanted, F.col("test_path").like(f"{path_like}%") if path_like else None, F.col("test_name").like(f"{name_like}%") if name_like else None)


def _mapping(t: Tables, app: str, branches=None, env_ids=None, task_id=None) -> DataFrame:
    m = t["mapping"].filter(F.col("app_id") == app)
    m = where_given(m, among("branch", branches), among("env_id", env_ids), F.col("task_id") == task_id if task_id else None)
    return m.select("group_id", "definition_id", "signature").distinct()


def impacted_tests(t: Tables, build: str, baseline: str, tags=None, path_like=None, name_like=None, branches=None, env_ids=None, statuses=(IMPACTED,), **change_filters) -> DataFrame:
    """Definitions with impacted_methods and status.  statuses None: all; only IMPACTED: an inner join is enough."""
    app = build.split(":")[1]
    c = changes(t, build, baseline, include_deleted=True, **change_filters).select("signature", F.lit(True).alias("_changed"))
    d, m = _definitions(t, tags, path_like, name_like), _mapping(t, app, branches, env_ids)
    keys = ["group_id", "definition_id", "test_path", "test_name", "test_runner", "tags"]
    if statuses and tuple(statuses) == (IMPACTED,):
        hit = m.join(c, "signature").groupBy("group_id", "definition_id").agg(F.count_distinct("signature").alias("impacted_methods"))
        return d.join(hit, ["group_id", "definition_id"]).select(*keys, "impacted_methods", F.lit(IMPACTED).alias("status"))
    per = m.join(c, "signature", "left").groupBy("group_id", "definition_id").agg(F.count_if("_changed").alias("impacted_methods"))
    out = d.join(per, ["group_id", "definition_id"], "left")
    status = F.when(F.col("impacted_methods").isNull(), UNKNOWN).when(F.col("impacted_methods") > 0, IMPACTED).otherwise(NOT_IMPACTED)
    out = out.withColumn("status", status).withColumn("impacted_methods", F.coalesce("impacted_methods", F.lit(0).cast("long")))
    return where_given(out.select(*keys, "impacted_methods", "status"), among("status", statuses))


def impacted_methods(t: Tables, build: str, baseline: str, tags=None, path_like=None, name_like=None, branches=None, env_ids=None, task_id=None, **change_filters) -> DataFrame:
    """Changed signatures with the number of test definitions mapped to them."""
    app = build.split(":")[1]
    c = changes(t, build, baseline, include_deleted=True, **change_filters)
    m = _mapping(t, app, branches, env_ids, task_id).join(_definitions(t, tags, path_like, name_like).select("group_id", "definition_id"), ["group_id", "definition_id"], "left_semi")
    n = m.groupBy("group_id", "signature").agg(F.count_distinct("definition_id").alias("impacted_tests"))
    return c.join(n, ["group_id", "signature"])
