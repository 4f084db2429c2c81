"""What queries make and shuffle, by the tables that are made and the exchanges of their plans."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from probelight.llm.common import settings
from probelight.operators import transform, upsert
from probelight.operators.upsert import Store
from probelight.plans import coverage, derive, end_to_end, etl_queries, ingest_queries, jobs, metrics
from probelight.plans.stored import Tables
from probelight.sources import payloads
from probelight.streaming import etl, ingest_stream

SF = "/root/testdata/sf0.001"


def _key(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def tables(spark, tmp_path):
    t = metrics.metrics(derive.raw(spark, SF))
    t.root = f"file://{tmp_path}/tables"
    return t


@pytest.mark.parametrize("pipeline", ["test_launches", "test_sessions", "test_definitions"])
def test_a_pipeline_makes_only_the_tables_it_reads(spark, tables, tmp_path, pipeline):
    out = etl.run_etl(Store(spark, f"file://{tmp_path}/s"), etl_queries.raw(tables), "g1", [pipeline], until=dt.datetime(2010, 1, 1))
    assert out[pipeline]["status"] == "SUCCESS" and out[pipeline]["rows"]
    assert not set(tables) & {"li", "m0", "m1", "raw_methods", "raw_coverage", "session_builds", "requests"}


def test_given_tables_stand_for_made_ones(tables):
    x = etl_queries.raw(tables)
    y = x | {"launches": x["launches"].limit(1)}
    assert y["launches"].count() == 1 and x["launches"].count() > 1 and y["sessions"].count() == x["sessions"].count() > 1


def test_facts_and_metric_tables_are_not_written(tables, tmp_path):
    assert tables["build_method_coverage"].filter("build_id = 'g1:app-0:1997'").count()
    assert {p.name for p in (tmp_path / "tables").iterdir()} == {"m0", "raw_methods", "raw_builds", "instances", "sessions"}


def test_folds_of_facts_add_no_exchange(spark, tables):
    """Facts come by method, of which all folds' keys have one."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    with settings(spark, conf):
        exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        for f, x in ((transform.build_method_coverage, "test_facts"), (transform.method_daily_coverage, "test_facts"), (transform.session_coverage, "plain_facts"), (transform.definition_coverage, "test_facts")):
            assert exchanges(f(tables[x], derive.WORDS)) == exchanges(tables[x])


def test_pipelines_fold_and_upsert_at_known_width(spark, tables, tmp_path, monkeypatch):
    """A fold and an upsert by OR take one shuffle each."""
    widths, plain = [], Store.upsert
    monkeypatch.setattr(Store, "upsert", lambda self, *a, **k: (widths.append(k.get("width")), plain(self, *a, **k))[1])
    name = "build_method_test_definition_coverage"
    etl_queries.run(Store(spark, f"file://{tmp_path}/s"), etl_queries.raw(tables), [name], until=dt.datetime(1996, 1, 1))
    assert widths == [derive.WORDS]
    ddl = "group_id string, k string, probes array<bigint>, updated_at_day string"
    old = spark.createDataFrame([("g", "a", [1, 0], "1"), ("g", None, [4, 4], "1"), ("g", "c", [1], "1")], ddl)
    new = spark.createDataFrame([("g", "a", [1, 0], "2"), ("g", None, [2, 0], "2"), ("g", None, [0, 1], "3"), ("g", "d", [7], "2")], ddl)
    rows = lambda **w: upsert.merged(old, new, ["group_id", "k"], "or", **w)
    assert sorted(map(str, rows(width=2).collect())) == sorted(map(str, rows().collect()))
    assert rows(width=2)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    with pytest.raises(Exception, match="unequal length"):
        upsert.merged(old, new.filter("k = 'd'").withColumn("k", F.lit("a")), ["group_id", "k"], "or", width=2).collect()


def test_an_upsert_by_or_takes_one_shuffle_with_its_layout(spark, tmp_path, monkeypatch):
    ddl = "group_id string, app_id string, build_id string, method_id string, day date, probes array<bigint>"
    rows = lambda n, bit: spark.createDataFrame([("g", "a", f"b{k % 3}", f"m{k}", dt.date(2024, 1 + k % 2, 5), [bit]) for k in range(n)], ddl)
    plans, plain = [], Store._write
    monkeypatch.setattr(Store, "_write", lambda self, t, df, by, *a: (plans.append((df._jdf.queryExecution().executedPlan().toString(), a)), plain(self, t, df, by, *a))[1])
    for table, keys in (("session_coverage", ["group_id", "app_id", "build_id", "method_id", "day"]), ("method_daily_coverage", ["group_id", "app_id", "build_id", "method_id", "day"])):
        one, two = Store(spark, f"file://{tmp_path}/one"), Store(spark, f"file://{tmp_path}/two")
        for new in (rows(40, 1), rows(60, 2)):
            one.upsert(table, new, keys, "or", width=1)
            two.upsert(table, new, keys, "or")
        assert _key(one.read(table)) == _key(two.read(table)) and one.read(table).count() == 60
        assert {tuple(r.probes) for r in one.read(table).filter("method_id = 'm1'").collect()} == {(3,)}
        for plan, laid_out in plans[::2]:
            assert laid_out == (True,) and plan.count("Exchange hashpartitioning") == 1
        assert len(list((tmp_path / "one" / table).rglob("part-*"))) <= 2 * 3 * upsert.SLICES
        plans.clear()


def test_a_stream_of_daily_coverage_rewrites_no_month(spark, tmp_path, monkeypatch):
    ddl = "group_id string, app_id string, method_id string, branch string, env_id string, result string, tag string, task_id string, at timestamp_ntz, day date, probes string, signature string"
    bits = ["100", "010", "001"]
    facts = spark.createDataFrame([("g", "a", f"m{k % 4}", "main", "e", None, None, None, dt.datetime(2024, 1 + k % 2, 5, k % 24), dt.date(2024, 1 + k % 2, 5), bits[k % 3], "s") for k in range(60)], ddl)
    t = Tables(spark, {}, f"file://{tmp_path}/t", {"plain_facts": facts.repartition(6)})
    monkeypatch.setattr(Store, "_touched", lambda *a: pytest.fail("rewritten"))
    rows = lambda df: sorted((str(r.day), r.method_id, tuple(r.probes)) for r in df.collect())
    assert rows(ingest_queries.daily_coverage_stream(t)) == rows(transform.method_daily_coverage(facts))


def test_orphans_go_with_one_reading_of_each_table(spark, tables):
    out = jobs.contents(jobs._orphans(tables), "method_daily_coverage", "mapping")
    assert len(re.findall(r"FileScan parquet .*lineitem", out._jdf.queryExecution().executedPlan().toString())) <= 3  # coverage without a test, and by tests for each table
    key = "group_id string, app_id string, method_id string"
    f, day = spark.createDataFrame, lambda n: dt.date(1997 + n, 6, 1)
    t = {
        "methods": f([("g", "a", m, f"s{m}", day(n)) for m, n in (("1", 0), ("2", 0), ("3", 1), ("4", 0))] + [("h", "a", "1", "s1", day(0))], f"{key}, signature string, created_day date"),
        "build_methods": f([("g", "a", "1"), ("g", "a", "1")], key),
        "method_daily_coverage": f([("g", "a", m, day(n)) for m in ("1", "2", "9", None) for n in (0, 1)] + [("g", "a", "9", None), ("h", "a", "9", day(0))], f"{key}, day date"),
        "mapping": f([("g", "a", s, day(n)) for s in ("s1", "s9", None) for n in (0, 1)], "group_id string, app_id string, signature string, updated_at_day date"),
    }
    got = jobs.orphan_clean_up(t, "g", F.to_date(F.lit("1998-01-01")))
    assert sorted(got["methods"].select("group_id", "method_id").collect()) == [("g", "1"), ("g", "3"), ("h", "1")]
    assert sorted((r.group_id, str(r.method_id), str(r.day)[:4]) for r in got["method_daily_coverage"].collect()) == [("g", "1", "1997"), ("g", "1", "1998"), ("g", "2", "1997"), ("g", "2", "1998"), ("g", "9", "1998"), ("g", "9", "None"), ("g", "None", "1998"), ("h", "9", "1997")]
    assert sorted((str(r.signature), r.updated_at_day.year) for r in got["mapping"].collect()) == [("None", 1998), ("s1", 1997), ("s1", 1998), ("s9", 1998)]


def test_a_stream_of_any_lateness_holds_no_state(spark, tmp_path):
    ddl = "group_id string, app_id string, method_id string, branch string, env_id string, result string, tag string, task_id string, at timestamp_ntz, probes string"
    facts = spark.createDataFrame([("g", "a", f"m{k % 4}", "main", None, None, None, None, dt.datetime(2024, 1 + k % 3, 5, k % 24), ("1" * 70, "0" * 69 + "1")[k % 2]) for k in range(70)], ddl)
    facts.repartition(7).write.parquet(f"file://{tmp_path}/in")
    store = Store(spark, f"file://{tmp_path}/s", deltas=("method_daily_coverage",), fan=2)
    for again in ("one", "two"):  # all over again changes nothing
        stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 2).parquet(f"file://{tmp_path}/in")
        q = ingest_stream.or_daily_coverage(stream, store, "method_daily_coverage", 2, f"file://{tmp_path}/{again}")
        q.awaitTermination()
        assert len(q.recentProgress) >= 4 and not q.lastProgress["stateOperators"]
        assert _key(store.read("method_daily_coverage")) == _key(transform.method_daily_coverage(facts.withColumn("day", F.to_date("at")))) != []
    with pytest.raises(Exception, match="unequal length"):
        store.upsert("method_daily_coverage", store.read("method_daily_coverage").withColumn("probes", F.slice("probes", 1, 1)), transform.DAY_KEYS, "or", width=2)
        store.read("method_daily_coverage").collect()


def test_records_are_written_compressed(tables, tmp_path, monkeypatch):
    monkeypatch.setattr(end_to_end.ingest_stream, "run", lambda *a: (_ for _ in ()).throw(InterruptedError))
    with pytest.raises(InterruptedError):
        end_to_end.loaded(tables)
    files = [p.name for p in (tmp_path / "tables").rglob("in/*") if p.name.startswith("part")]
    assert files and all(f.endswith(".json.gz") for f in files)


def test_records_are_parsed_once_and_not_cached(spark, tmp_path, monkeypatch):
    heads = {"groupId": "g", "appId": "a", "buildVersion": "1"}
    rows = [("builds", json.dumps(heads)), ("builds", "{"), (None, "{}"), ("nonsense", "{}"), ("builds-info", json.dumps(heads | {"branch": "b"})), ("coverage", None),
            ("coverage", json.dumps(heads | {"coverage": [{"signature": "s", "bodyChecksum": "1", "stringProbes": "01"}]})), ("heartbeats", '{"instanceId": 5, "status": "RUNNING", "x": 1}'), ("methods", '{"methods": 1}')]
    records = spark.createDataFrame([(k, v, dt.datetime(2024, 1, 1)) for k, v in rows], ingest_stream.RECORD)
    good, bad = payloads.split_records(records)
    with Store(spark, f"file://{tmp_path}/t").staged(payloads.parsed(records)) as staged:
        got, others = payloads.split_parsed(staged)
        assert {k: _key(x) for k, x in got.items()} == {k: _key(x) for k, x in good.items()} and got["coverage"].columns == good["coverage"].columns
        assert _key(others) == _key(bad) and others.count() >= 4
    assert not list((tmp_path / "t").iterdir())  # gone after use
    plan = payloads.parsed(records)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == len(payloads.SCHEMAS)
    cached, plain = [], Store.append
    monkeypatch.setattr(Store, "append", lambda self, *a: (cached.append(spark.sparkContext._jsc.getPersistentRDDs().size()), plain(self, *a)))
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    ingest_stream.write_batch(records, Store(spark, f"file://{tmp_path}/s"), "one", 0)
    assert cached == [before, before]


def test_payloads_of_methods_are_bounded(tables):
    """Also where all methods are of one class."""
    x = tables | {"m1": tables["m1"].withColumn("class_name", F.lit("c")), "ended_launches": end_to_end.ended_launches(tables)}
    methods = payloads.split_records(end_to_end.records(x).filter("key = 'methods'"))[0]["methods"]
    most, n = methods.agg(F.max(F.size("methods")), F.sum(F.size("methods"))).first()
    assert most <= 100 and n == tables["m1"].count()


@pytest.mark.parametrize("hours", [0, 5])
def test_told_coverage_is_the_join_with_methods(spark, tables, hours):
    li = tables["lineitem"].limit(500).withColumn("l_shipdate", F.col("l_shipdate") + F.expr(f"INTERVAL '1' HOUR * (l_linenumber % 2 * {hours})"))
    part = tables["part"].withColumn("p_brand", F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")))
    t = metrics.metrics(derive.raw(spark, SF)) | {"lineitem": li, "part": part}
    told = t["told_coverage"].filter("method_id IS NOT NULL")
    want = t["raw_coverage"].join(t["raw_methods"].select("app_id", "method_id", "signature", "body_checksum"), ["app_id", "method_id"])
    assert _key(told.select(want.columns)) == _key(want) != []
    assert hours or told._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_runs_keep_facts_and_folds_on_disk(spark, tables, tmp_path, monkeypatch):
    levels, plain = [], Store.upsert
    monkeypatch.setattr(Store, "upsert", lambda self, table, new, *a, **k: (levels.append(new.storageLevel), plain(self, table, new, *a, **k))[1])
    etl_queries.run(Store(spark, f"file://{tmp_path}/s"), etl_queries.raw(tables), ["build_method_coverage", "method_daily_coverage"], until=dt.datetime(1996, 1, 1))
    assert len(levels) == 2 and all(x.useDisk and not x.useMemory for x in levels)


@pytest.mark.parametrize("hours", [0, 5])
def test_planned_tables_have_the_rows_of_their_sql(spark, tmp_path, hours):
    """Also with unknown apps, days and parts, parts that differ or repeat under one key, and ship dates within the day."""
    given = {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in derive.GIVEN}
    li, part = given["lineitem"].limit(300), given["part"]
    odd = lambda df, c, k: df.withColumn(c, F.when(F.col("l_orderkey") % 7 == k, F.lit(None)).otherwise(F.col(c)))
    li = odd(odd(odd(li, "l_suppkey", 1), "l_shipdate", 2), "l_partkey", 3).withColumn("l_shipdate", F.col("l_shipdate") + F.expr(f"INTERVAL '1' HOUR * (l_linenumber % 2 * {hours})"))
    part = part.unionByName(part.limit(20)).unionByName(part.limit(20).withColumn("p_size", F.col("p_size") + 1)).unionByName(part.limit(5).withColumn("p_brand", F.lit(None).cast("string")))
    for n, df in (given | {"lineitem": li, "part": part}).items():
        df.write.parquet(f"file://{tmp_path}/in/{n}.parquet")
    t = derive.raw(spark, f"file://{tmp_path}/in")
    for n in ("raw_coverage", "raw_methods"):
        want = spark.sql(derive.RAW[n], **{x: t[x] for x in ("li", "m1", "lineitem", "part")})
        assert t[n].columns == want.columns and want.count()
        assert t[n].exceptAll(want).isEmpty() and want.exceptAll(t[n]).isEmpty()


def test_coverage_of_a_build_moves_its_days_once(spark, tables):
    """Daily coverage stays by method for the join with the build's methods, links of builds meet the methods once, later days aren't folded."""
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        n = lambda df: plan(df).count("Exchange hashpartitioning")
        build, days = "g1:app-0:1997", tables["method_daily_coverage"]
        made = lambda t: n(coverage.methods_of(t, [build]).drop("created_day"))
        assert made(tables) < made(tables | {"build_methods": tables["build_methods"]})
        wanted = coverage.methods_of(tables, [build]).select("build_id", *coverage.METHOD).withColumn("created_day", F.lit("1996-12-31").cast("date"))
        hit = coverage.days_before(tables, wanted, [], group_app=("g1", "app-0"), latest=dt.date(1997, 1, 1))
        assert n(hit) <= n(days) + n(wanted) + 1
        assert len(re.findall(r"1997-01-0[12]", hit._jdf.queryExecution().optimizedPlan().toString())) >= 2
        plain = coverage.days_before(tables, wanted, [])
        assert sorted(map(str, hit.collect())) == sorted(map(str, plain.collect())) != []


def test_given_links_of_builds_stand_for_the_raw_ones(tables):
    build = "g1:app-0:1997"
    assert tables["build_methods"].count() and coverage.methods_of(tables, [build]).count() > 1
    assert coverage.methods_of(tables | {"build_methods": tables["build_methods"].filter(F.col("build_id") == build).limit(1)}, [build]).count() == 1
