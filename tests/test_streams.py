"""Streaming ingest and incremental pipelines."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from probelight.functions import probes
from probelight.operators import extract, transform
from probelight.operators.upsert import Store
from probelight.sources import raw_layer
from probelight.streaming import etl, ingest_stream


def record(key, ts="2024-01-01T00:00:00", **value):
    return json.dumps({"key": key, "value": json.dumps(value), "ts": ts})


BUILD = {"groupId": "g", "appId": "a", "buildVersion": "1"}
METHOD = {"classname": "c/K", "name": "m", "params": "()", "returnType": "void", "probesCount": 3, "probesStartPos": 0, "bodyChecksum": "1"}


def test_ingest_from_files(spark, tmp_path):
    source, store = tmp_path / "in", Store(spark, f"file://{tmp_path}/store")
    source.mkdir()
    cov = {"signature": "c/K:m:():void", "bodyChecksum": "1", "testId": "TEST_CONTEXT_NONE", "testSessionId": "s"}
    first = [
        record("builds", **BUILD, commitSha="c"), record("instances", **BUILD, instanceId="i", envId="e"), record("methods", **BUILD, methods=[METHOD, METHOD]),
        record("coverage", **BUILD, instanceId="i", coverage=[cov | {"probes": [True, False, True]}, cov | {"stringProbes": "000"}]),
        record("test-sessions", id="s", groupId="g", testTaskId="t", builds=[{"appId": "a", "buildVersion": "1"}]), record("nonsense", x=1), json.dumps({"key": "builds", "value": "{", "ts": "2024-01-01T00:00:00"}),
        record("test-metadata", groupId="g", sessionId="s", tests=[{"testLaunchId": "l", "testDefinitionId": "d", "result": "PASSED", "duration": 5, "details": {"runner": "junit", "path": "p", "testName": "n"}}]),
    ]
    (source / "1.json").write_text("\n".join(first))
    run = lambda: ingest_stream.run(ingest_stream.from_files(spark, str(source)), store, f"{tmp_path}/ck").awaitTermination()
    run()
    assert [(r.id, r.commit_sha) for r in store.read("builds").collect()] == [("g:a:1", "c")]
    assert [r.status for r in store.read("instances").collect()] == ["RUNNING"]
    m, c = store.read("methods").collect(), store.read("method_coverage").collect()
    assert len(m) == 1 and [(x.method_id, x.probes, x.test_id, x.test_session_id) for x in c] == [(m[0].method_id, "101", None, "s")]
    assert store.read("quarantine").count() == 2
    assert [r.type for r in store.read("test_definitions").collect()] == ["placeholder"]
    (source / "2.json").write_text("\n".join([
        record("heartbeats", "2024-01-02T00:00:00", groupId="g", appId="a", instanceId="i", status="SHUTDOWN"),
        record("test-sessions", id="s", groupId="g", testTaskId="t", builds=[{"appId": "a", "buildVersion": "2"}]), record("builds", **BUILD, commitSha="d")]))
    run()
    assert [r.status for r in store.read("instances").collect()] == ["SHUTDOWN"]
    assert [r.build_id for r in raw_layer.raw_tables(store)["session_builds"].collect()] == ["g:a:2"]
    assert [(r.id, r.commit_sha) for r in store.read("builds").collect()] == [("g:a:1", "d")]


def test_batches_add_what_they_bring(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    rows = lambda *x: spark.createDataFrame([tuple(json.loads(r)[k] for k in ("key", "value")) + (dt.datetime.fromisoformat(json.loads(r)["ts"]),) for r in x], ingest_stream.RECORD)
    cov = {"signature": "c/K:m:():void", "bodyChecksum": "1", "testId": "l", "testSessionId": "s", "stringProbes": "101"}
    launch = lambda n, result: record("test-launches", f"2024-01-0{n}T00:00:00", groupId="g", testSessionId="s", launches=[{"id": "l", "testDefinitionId": "d", "result": result, "duration": n}])
    first = rows(record("builds", **BUILD, commitSha="c"), record("instances", **BUILD, instanceId="i", envId="e"), record("coverage", **BUILD, instanceId="i", coverage=[cov, cov]), launch(3, "FAILED"), launch(2, "PASSED"), record("unknown", x=1))
    for _ in range(2):  # the second time is a batch that is run again
        ingest_stream.write_batch(first, store, "one", 0)
    assert store.read("method_coverage").count() == 2 and store.read("quarantine").count() == 1
    assert [(r.result, r.duration) for r in store.read("test_launches").collect()] == [("FAILED", 3)]
    before = {f for f in tmp_path.rglob("part-*")}
    ingest_stream.write_batch(rows(record("heartbeats", "2024-01-02T00:00:00", groupId="g", appId="a", instanceId="i", status="SHUTDOWN"), record("heartbeats", groupId="g", appId="a", instanceId="nobody", status="RUNNING"), record("builds", "2024-01-02T00:00:00", **BUILD, commitSha="d"), record("coverage", **BUILD, instanceId="i", coverage=[cov])), store, "one", 1)
    ingest_stream.write_batch(rows(record("instances", "2024-01-03T00:00:00", **BUILD, instanceId="i", envId="f")), store, "one", 2)
    assert before <= {f for f in tmp_path.rglob("part-*")}  # nothing old was rewritten or dropped
    assert [(r.id, r.status, r.env_id, r.created_at) for r in store.read("instances").collect()] == [("i", "SHUTDOWN", "f", at(1))]
    assert [(r.commit_sha, r.created_at, r.updated_at) for r in store.read("builds").collect()] == [("d", at(1), at(2))]
    assert store.read("method_coverage").count() == 3
    raw = raw_layer.raw_tables(store)
    assert {k: v.count() for k, v in raw.items()} == {"builds": 1, "instances": 1, "raw_methods": 0, "raw_build_methods": 0, "raw_coverage": 3, "definitions": 0, "launches": 1, "sessions": 0, "session_builds": 0, "rules": 0, "requests": 0}


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def raw(spark, days):
    """Coverage of one method on some days, with the rest of the raw layer."""
    f = spark.createDataFrame
    m = "group_id string, app_id string, method_id string, class_name string, method_name string, signature string, probes_count long"
    return {
        "builds": f([("g", "a", "g:a:1", "v", "main", "c", at(1), at(1))], "group_id string, app_id string, build_id string, build_version string, branch string, commit_sha string, created_at timestamp_ntz, updated_at timestamp_ntz"),
        "instances": f([("g", "a", "i", "g:a:1", "e", at(1))], "group_id string, app_id string, instance_id string, build_id string, env_id string, created_at timestamp_ntz"),
        "raw_methods": f([("g", "a", "m", "c/K", "m", "c/K:m", 4)], m), "raw_build_methods": f([("g", "a", "g:a:1", "m", at(1))], "group_id string, app_id string, build_id string, method_id string, created_at timestamp_ntz"),
        "rules": f([], "group_id string, app_id string, name_pattern string, classname_pattern string"),
        "raw_coverage": f([("g", "a", "g:a:1", "i", "m", b, 4, x if isinstance(x, dt.datetime) else at(x), l, s) for x, b, l, s in ((*d, None)[:4] for d in days)], "group_id string, app_id string, build_id string, instance_id string, method_id string, probes string, probes_count long, created_at timestamp_ntz, launch_id string, session_id string"),
        "launches": f([("g", "l", "t", "s", "PASSED", 5, at(2))], "group_id string, launch_id string, definition_id string, session_id string, result string, duration long, created_at timestamp_ntz"),
        "definitions": f([("g", "t", "p", "n", "junit", "x,y", at(1))], "group_id string, definition_id string, test_path string, test_name string, test_runner string, tags string, updated_at timestamp_ntz"),
        "sessions": f([("g", "s", "task", at(2))], "group_id string, session_id string, task_id string, created_at timestamp_ntz"),
        "session_builds": f([("g", "g:a:1", "s", at(2))], "group_id string, build_id string, session_id string, created_at timestamp_ntz"),
    }


def ones(store, table):
    return store.read(table).agg(F.sum(probes.popcount(F.col("probes")))).first()[0]


def test_incremental_equals_rerun(spark, tmp_path):
    t = raw(spark, [(2, "1000", None), (3, "0100", "l"), (5, "0010", None)])
    store, full = Store(spark, f"file://{tmp_path}/a"), Store(spark, f"file://{tmp_path}/b")
    names = ["build_method_coverage", "build_method_coverage_from_test_launches", "test_to_code_mapping"]
    first = etl.run_etl(store, t, "g", names, until=at(3))
    assert first["build_method_coverage"]["rows"] == 1 and {r["status"] for r in first.values()} == {"SUCCESS"}
    assert etl.run_etl(store, t, "g", names, until=at(3))["build_method_coverage"]["status"] == "SKIPPED"
    again = etl.run_etl(store, t, "g", names, until=at(9), lookback=dt.timedelta(5))
    assert again["build_method_coverage"]["rows"] == 1
    etl.run_etl(full, t, "g", names, until=at(9))
    key = lambda s: sorted(repr((r.env_id, r.result, r.tag, r.probes)) for r in s.read("build_method_coverage").collect())
    assert key(store) == key(full) and ones(store, "build_method_coverage") == 4
    etl.run_etl(store, t, "g", names, until=at(9), full_refresh=True)
    assert key(store) == key(full)
    meta = {r.pipeline: r for r in store.read("etl_metadata").collect()}
    assert meta["build_method_coverage"].last_processed_at == at(9) and meta["build_method_coverage"].rows == 3


def test_a_failing_pipeline_keeps_its_watermark(spark, tmp_path):
    t = raw(spark, [(2, "1000", None)])
    store = Store(spark, f"file://{tmp_path}/s")
    t["definitions"] = t["definitions"].withColumn("test_name", F.raise_error(F.lit("boom")))
    out = etl.run_etl(store, t, "g", ["test_definitions", "test_sessions"], until=at(9))
    assert (out["test_definitions"]["status"], out["test_sessions"]["status"]) == ("FAILED", "SUCCESS")
    assert set(etl.watermarks(store, "g")) == {"test_sessions"} and store.read("test_sessions").count() == 1


def test_all_pipelines_run(spark, tmp_path):
    t = raw(spark, [(2, "1000", None), (3, "0110", "l"), (4, "0001", None, "s"), (4, "1001", None, "unknown")])
    t["requests"] = spark.createDataFrame([("g", "s", None, at(2))], "group_id string, session_id string, definition_id string, requested_at timestamp_ntz")
    store = Store(spark, f"file://{tmp_path}/s")
    out = etl.run_etl(store, t, "g", list(etl.PIPELINES), until=at(9))
    assert {k: v["error"] for k, v in out.items() if v["status"] != "SUCCESS"} == {}
    assert len(out) == 18 and ones(store, "definition_coverage") == 2
    # coverage of a session outside its tests counts for the session and its task; an unknown session is none
    got = sorted((r.result or "", r.tag or "", probes_of(r)) for r in store.read("session_coverage").collect())
    assert got == [("", "", 1), ("PASSED", "x", 6), ("PASSED", "y", 6)]
    assert sorted((r.task_id or "", probes_of(r)) for r in store.read("build_method_coverage").filter("result IS NULL").collect()) == [("", 9), ("task", 1)]
    assert [(r.build_id, r.session_id) for r in store.read("test_session_builds").collect()] == [("g:a:1", "s")]


def probes_of(r):
    return sum(w << 60 * k for k, w in enumerate(r.probes))


def test_coverage_needs_its_instance_and_method(spark):
    t = raw(spark, [(2, "1000", None)])
    assert extract.coverage(extract.Raw(t)).count() == 1
    for name in ("instances", "builds", "raw_methods"):
        assert extract.coverage(extract.Raw(t | {name: t[name].limit(0)})).count() == 0
    rule = spark.createDataFrame([("g", "a", None, "^c/")], "group_id string, app_id string, name_pattern string, classname_pattern string")
    assert extract.coverage(extract.Raw(t | {"rules": rule})).count() == 0


def test_rows_that_arrive_later_on_a_processed_day(spark, tmp_path):
    store, t = Store(spark, f"file://{tmp_path}/s"), raw(spark, [])
    launch = lambda *hours: spark.createDataFrame([("g", f"l{h}", "t", "s", "PASSED", h, at(5, h)) for h in hours], t["launches"].schema)
    for hours, until in (((1,), at(5, 2)), ((1, 3), at(5, 4)), ((1, 3, 5), at(6))):
        assert etl.run_etl(store, t | {"launches": launch(*hours)}, "g", ["test_launches"], until=until)["test_launches"]["rows"] == 1
    assert sorted(r.launch_id for r in store.read("test_launches").collect()) == ["l1", "l3", "l5"]


def test_lookback_delay_and_start(spark, tmp_path):
    store, t = Store(spark, f"file://{tmp_path}/s"), raw(spark, [(at(2, 1), "1000", None), (at(2, 5), "0100", None), (at(2, 7), "0010", None)])
    run = lambda **o: etl.run_etl(store, t, "g", ["build_method_coverage"], **o)["build_method_coverage"]
    assert run(now=at(2, 6), delay=dt.timedelta(hours=2), init=at(2))["rows"] == 1 and ones(store, "build_method_coverage") == 1
    assert run(now=at(2, 6), delay=dt.timedelta(hours=2))["status"] == "SKIPPED"
    assert run(until=at(2, 6))["rows"] == 1 and ones(store, "build_method_coverage") == 2
    t["raw_coverage"] = t["raw_coverage"].withColumn("probes", F.when(F.col("created_at") == F.lit("2024-01-02 05:00:00").cast("timestamp_ntz"), "0101").otherwise(F.col("probes")))
    assert run(until=at(2, 8))["rows"] == 1 and ones(store, "build_method_coverage") == 3
    assert run(until=at(2, 9), lookback=dt.timedelta(hours=4))["rows"] == 1 and ones(store, "build_method_coverage") == 4


def test_a_session_or_definition_has_its_own_watermark_and_rows(spark, tmp_path):
    store, t = Store(spark, f"file://{tmp_path}/s"), raw(spark, [(3, "0110", "l"), (3, "1000", "k")])
    t["launches"] = t["launches"].union(spark.createDataFrame([("g", "k", "u", "s", "PASSED", 5, at(2))], t["launches"].schema))
    t["definitions"] = t["definitions"].union(spark.createDataFrame([("g", "u", "p", "o", "junit", None, at(1))], t["definitions"].schema))
    run = lambda **o: etl.run_etl(store, t, "g", ["build_method_test_definition_coverage"], until=at(9), **o)["build_method_test_definition_coverage"]["status"]
    rows = lambda: sorted((r.definition_id, probes_of(r)) for r in store.read("definition_coverage").collect())
    assert run(session_id="s", definition_id="t") == "SUCCESS" and rows() == [("t", 6)]
    assert run(session_id="s", definition_id="u") == "SUCCESS" and rows() == [("t", 6), ("u", 8)]
    assert run(session_id="s", definition_id="t") == "SKIPPED" and run(session_id="s") == "SUCCESS" and run() == "SUCCESS"
    t["raw_coverage"] = t["raw_coverage"].filter("launch_id = 'k'")
    assert run(session_id="s", definition_id="t", full_refresh=True) == "SUCCESS" and rows() == [("u", 8)]
    with pytest.raises(ValueError):
        etl.run_etl(store, t, "g", ["test_launches"], session_id="s")


def test_the_last_of_repeated_rows_replaces(spark, tmp_path):
    store, t = Store(spark, f"file://{tmp_path}/s"), raw(spark, [])
    t["launches"] = spark.createDataFrame([("g", "l", "t", "s", r, 5, at(d)) for r, d in (("PASSED", 3), ("FAILED", 4), ("SKIPPED", 2))], t["launches"].schema)
    etl.run_etl(store, t, "g", ["test_launches"], until=at(9))
    assert [r.result for r in store.read("test_launches").collect()] == ["FAILED"]


def test_daily_fold_as_a_stream_drops_closed_days(spark, tmp_path):
    ddl = "group_id string, app_id string, method_id string, branch string, env_id string, result string, tag string, task_id string, at timestamp_ntz, probes string"
    row = lambda day, m, bits: ("g", "a", m, "main", "e", None, None, None, at(day, 5), bits)
    batches = [[row(1, "m", "100"), row(1, "m", "001"), row(1, "n", "1" * 70)], [row(1, "m", "010"), row(2, "m", "100")], [row(9, "m", "001")], [row(9, "m", "100"), row(9, "n", "0" * 69 + "1")]]
    store, state = Store(spark, f"file://{tmp_path}/s"), []
    for rows in batches:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        days = ingest_stream.daily_coverage(spark.readStream.schema(ddl).parquet(f"file://{tmp_path}/in"), 2)
        q = ingest_stream.upsert_changes(days, store, "method_daily_coverage", transform.DAY_KEYS, "replace", f"file://{tmp_path}/ck")
        q.awaitTermination()
        state.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert state[1] == max(state) > state[3] > state[2] > 0  # three open keys, then one of day 9 and two: days 1 and 2 are gone
    facts = spark.createDataFrame([r for b in batches for r in b], ddl).withColumn("day", F.to_date("at"))
    rows = lambda df: sorted((str(r.day), r.method_id, tuple(r.probes)) for r in df.collect())
    assert rows(store.read("method_daily_coverage")) == rows(transform.method_daily_coverage(facts))


def test_requests_meet_launches_by_all_of_their_keys(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    ts = "timestamp_ntz"
    t = {
        "raw_coverage": spark.createDataFrame([("g", "a", "b", "i", "m", "01", 2, f"l{k}", "x", at(1)) for k in range(4)], f"group_id string, app_id string, build_id string, instance_id string, method_id string, probes string, probes_count long, launch_id string, session_id string, created_at {ts}"),
        "raw_methods": spark.createDataFrame([("g", "a", "m", "c:m", "m", "c")], "group_id string, app_id string, method_id string, signature string, method_name string, class_name string"),
        "rules": spark.createDataFrame([], "group_id string, app_id string, name_pattern string, classname_pattern string"),
        "builds": spark.createDataFrame([("g", "a", "b", "main")], "group_id string, app_id string, build_id string, branch string"),
        "instances": spark.createDataFrame([("g", "a", "i", "e")], "group_id string, app_id string, instance_id string, env_id string"),
        "launches": spark.createDataFrame([("g", f"l{k}", f"d{k % 2}", f"s{k // 2}", "PASSED", at(1)) for k in range(4)], f"group_id string, launch_id string, definition_id string, session_id string, result string, created_at {ts}"),
        "definitions": spark.createDataFrame([("g", "d0", None), ("g", "d1", None)], "group_id string, definition_id string, tags string"),
        "sessions": spark.createDataFrame([("g", "s0", "t"), ("g", "s1", "t")], "group_id string, session_id string, task_id string"),
        "requests": spark.createDataFrame([("g", "s0", "d1", at(3)), ("g", "s1", "", at(4)), ("g", "s1", "d0", at(5)), ("g", "s1", None, at(2))], f"group_id string, session_id string, definition_id string, requested_at {ts}"),
    }
    got = extract.requested_coverage(extract.Raw(t))
    assert sorted((r.session_id, r.definition_id, r["at"].hour) for r in got.collect()) == [("s0", "d1", 3), ("s1", "d0", 5), ("s1", "d1", 4)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and " OR " in x and "rlike" not in x.lower()]
