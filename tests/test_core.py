"""Scenarios of builds, methods, tests and coverage on small tables."""

import datetime as dt
import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from probelight.functions import formats, probes
from probelight.operators import transform, upsert
from probelight.plans import coverage, impact, ingest_queries, jobs, report, treemap
from probelight.sources import payloads

DAY = dt.date(2024, 1, 1)


class World:
    """Builds with methods, coverage by test, and the metric tables over them."""

    def __init__(self, spark):
        self.spark, self.builds, self.bm, self.cov, self.map = spark, [], [], [], []

    def build(self, n, **methods):
        """methods: name -> (version of its body, probes)."""
        self.builds.append((f"g:a:{n}", DAY + dt.timedelta(n)))
        self.bm += [(f"g:a:{n}", name, v, p) for name, (v, p) in methods.items()]
        return self

    def test(self, n, test, result="PASSED", **bits):
        for name, b in bits.items():
            v = next(v for b_, m, v, _ in self.bm if b_ == f"g:a:{n}" and m == name)
            self.cov.append((f"g:a:{n}", name, v, test, result, b, DAY + dt.timedelta(n)))
        return self

    def tables(self):
        s = self.spark
        bm = s.createDataFrame(self.bm, "build_id string, method_name string, v int, probes_count int").withColumns({"group_id": F.lit("g"), "app_id": F.lit("a"), "method_id": F.concat_ws("-", "method_name", "v"), "signature": F.concat(F.lit("c/K:"), "method_name", F.lit(":():void")), "class_name": F.lit("c/K"), "method_params": F.lit("()"), "return_type": F.lit("void"), "probes_count": F.col("probes_count").cast("long")})
        c = s.createDataFrame(self.cov, "build_id string, method_name string, v int, test string, result string, bits string, day date").withColumns({"group_id": F.lit("g"), "app_id": F.lit("a"), "method_id": F.concat_ws("-", "method_name", "v"), "signature": F.concat(F.lit("c/K:"), "method_name", F.lit(":():void")), "branch": F.lit("main"), "env_id": F.lit("e"), "tag": F.lit(None).cast("string"), "task_id": F.lit("t"), "definition_id": F.col("test"), "session_id": F.lit("s"), "probes": probes.to_words(F.col("bits"))})
        tests = sorted({x[3] for x in self.cov}) or ["none"]
        return {
            "builds": s.createDataFrame([(b, d, "g", "a") for b, d in self.builds], "build_id string, created_day date, group_id string, app_id string"),
            "methods": bm.drop("build_id", "v").distinct(), "build_methods": bm.select("build_id", "group_id", "app_id", "method_id"),
            "build_method_coverage": c.withColumnRenamed("day", "created_at_day"), "method_daily_coverage": c, "session_coverage": c, "definition_coverage": c,
            "mapping": c.filter("result = 'PASSED'").select("group_id", "app_id", "signature", "definition_id", "branch", "env_id", "task_id").distinct(),
            "definitions": s.createDataFrame([("g", t, "p", t, "junit", "x") for t in tests], "group_id string, definition_id string, test_path string, test_name string, test_runner string, tags string"),
            "launches": c.select("group_id", F.concat_ws("/", "build_id", "test").alias("launch_id"), "definition_id", F.concat(F.lit("s"), "build_id").alias("session_id"), "result").distinct(),
            "session_builds": s.createDataFrame([("g", "a", b, f"s{b}") for b, _ in self.builds], "group_id string, app_id string, build_id string, session_id string"),
        }


def report_of(w, build, base):
    return report.build_diff_report(w.tables(), f"g:a:{build}", f"g:a:{base}").first()


def test_diff_counts_and_tested_changes(spark):
    w = World(spark).build(1, m1=(1, 2), m2=(1, 3)).build(2, m2=(2, 3), m3=(1, 1), m4=(1, 4))
    w.test(2, "t", m2="001", m3="1")
    r = report_of(w, 2, 1)
    assert (r.new_methods, r.modified_methods, r.deleted_methods, r.tested_new, r.tested_modified) == (2, 1, 1, 1, 1)


def test_isolated_and_aggregated(spark):
    w = World(spark).build(1, m1=(1, 2), m2=(1, 3)).build(2, m1=(1, 2), m2=(2, 3), m3=(1, 1)).build(3, m1=(1, 2), m2=(2, 3), m3=(2, 1))
    w.test(2, "t", m2="100", m3="1").test(3, "t", m2="010")
    r = report_of(w, 3, 1)
    assert (r.isolated_ratio, r.aggregated_ratio) == (0.25, 0.5)


def test_impacted_results(spark):
    w = World(spark).build(1, m1=(1, 2), m2=(1, 3)).build(2, m1=(2, 2), m2=(2, 3))
    w.test(1, "t1", m1="11").test(1, "t2", m2="111").test(2, "t1", m1="11").test(2, "t2", "FAILED", m2="100")
    r = report_of(w, 2, 1)
    assert (r.impacted_tests, r.passed_impacted, r.failed_impacted) == (2, 1, 1)


@pytest.mark.parametrize(("second", "result", "status"), [
    ({"m1": (2, 2)}, "PASSED", "IMPACTED"), ({"m1": (1, 2)}, "PASSED", "NOT_IMPACTED"), ({"m9": (1, 1)}, "PASSED", "IMPACTED"), ({"m1": (2, 2)}, "FAILED", "UNKNOWN_IMPACT"),
])
def test_impact_truth_table(spark, second, result, status):
    w = World(spark).build(1, m1=(1, 2)).build(2, **second).test(1, "t", result, m1="10")
    assert [r.status for r in impact.impacted_tests(w.tables(), "g:a:2", "g:a:1", statuses=None).collect()] == [status]


def test_changes_kinds(spark):
    w = World(spark).build(1, m1=(1, 2), m4=(1, 4)).build(3, m1=(1, 2), m2=(1, 3))
    got = {r.method_name: r.change for r in coverage.changes(w.tables(), "g:a:3", "g:a:1", include_equal=True, include_deleted=True).collect()}
    assert got == {"m1": "equal", "m2": "new", "m4": "deleted"}
    same = coverage.changes(w.tables(), "g:a:3", "g:a:3").collect()
    assert {r.change for r in same} == {"new"}


def test_build_ids():
    assert formats.parse_build_id("g:a:1") == ("g", "a", "1")
    for bad in ("g:a", "g:a:1:2", "g::1"):
        with pytest.raises(ValueError):
            formats.parse_build_id(bad)


def test_probe_words(spark):
    rng = random.Random(2)
    bits = ["".join(rng.choice("01") for _ in range(n)) for n in (1, 59, 60, 61, 100, 120, 121)]
    df = spark.createDataFrame([(b, len(b)) for b in bits], "b string, n int").withColumn("w", probes.to_words(F.col("b")))
    for r in df.select("b", probes.to_bits(F.col("w"), F.col("n")).alias("back"), probes.popcount(F.col("w")).alias("ones")).collect():
        assert r.back == r.b and r.ones == r.b.count("1")
    pairs = [("k", "1" + "0" * 99), ("k", "0" * 99 + "1"), (None, "01"), (None, "10"), ("n", None)]
    d = spark.createDataFrame(pairs, "k string, b string").withColumn("probes", probes.to_words(F.col("b")))
    assert {r.k: r.c for r in probes.or_by(d.select("k", "probes"), ["k"]).select("k", probes.popcount(F.col("probes")).alias("c")).collect()} == {"k": 2, None: 2, "n": 0}


def test_unequal_probes_are_an_error(spark):
    d = spark.createDataFrame([("k", "101"), ("k", "10")], "k string, b string").withColumns({"probes": probes.to_words(F.col("b")), "n": F.length("b")})
    with pytest.raises(Exception, match="unequal"):
        probes.checked_or_by(d.select("k", "n", "probes"), ["k"], "n").collect()


def test_durations(spark):
    ms = [0, 5, 61_000, 90_061_001, None]
    df = spark.createDataFrame([(x,) for x in ms], "m long").select(formats.format_duration(F.col("m")).alias("a"), formats.format_duration_rounded(F.col("m")).alias("b"))
    assert [tuple(r) for r in df.collect()] == [("0ms", "0ms"), ("5ms", "5ms"), ("1m 1s", "1m"), ("1d 1h 1m 1s 1ms", "1d"), ("", "0ms")]


def test_checksums(spark):
    agg = lambda *x: spark.createDataFrame([(v,) for v in x], "c string").agg(formats.combined_checksum(F.col("c"))).first()[0]
    top = "1y2p0ij32e8e7"  # Long.MAX_VALUE
    assert agg("100", "200") == agg("200", "100") and agg("") == "0" and agg("a", "a") == "k"
    assert agg(top, "1") == "-1y2p0ij32e8e8"
    with pytest.raises(Exception, match="base-36"):
        agg("not-a-number!")


def test_build_validation(spark):
    bm = spark.createDataFrame([("b", "g", "a", m) for m in "xyz"], "build_id string, group_id string, app_id string, method_id string")
    m = spark.createDataFrame([("g", "a", k, c) for k, c in zip("xyz", ("100", "200", "300"))], "group_id string, app_id string, method_id string, body_checksum string")
    at = dt.datetime(2024, 1, 1)
    for n, c, minutes, want in ((3, "600", 1, "VALID"), (4, "600", 1, "PENDING"), (4, "600", 61, "INVALID"), (2, "600", 1, "INVALID"), (3, "601", 1, "INVALID"), (None, None, 1, "PENDING")):
        e = spark.createDataFrame([("b", n, c, at)], "build_id string, expected_count int, expected_checksum string, finalized_at timestamp_ntz")
        assert jobs.validate_builds(e, bm, m, F.lit(at + dt.timedelta(minutes=minutes)).cast("timestamp_ntz")).first().status == want


def recursive_treemap(methods):
    """Tree by recursion: single-child chains close up, but a class stays apart from its package."""
    root = {}
    for cls, leaf, n, c in methods:
        at = root
        for p in cls.split("/"):
            at = at.setdefault(p, {})
        at[leaf] = (n, c)

    out = []

    def total(x):
        return x if isinstance(x, tuple) else tuple(map(sum, zip(*(total(v) for v in x.values()))))

    def walk(name, path, parent, x):
        while isinstance(x, dict) and len(x) == 1:
            k, v = next(iter(x.items()))
            if isinstance(v, dict) and any(isinstance(y, tuple) for y in v.values()):
                break
            name, path, x = f"{name}/{k}", f"{path}/{k}", v
        out.append((name, path, parent, *total(x)))
        if isinstance(x, dict):
            for k, v in x.items():
                walk(k, f"{path}/{k}", path, v)

    for k, v in root.items():
        walk(k, k, None, v)
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_treemap_equals_recursion(spark, seed):
    rng = random.Random(seed)
    rows = {("/".join(f"{'pq'[rng.random() < 0.3]}{d}" for d in range(rng.randint(1, 4))) + "/C" + rng.choice("12"), f"m{rng.randint(1, 3)}", rng.randint(1, 9)) for _ in range(rng.randint(1, 12))}
    uniq = {(c, m): n for c, m, n in rows}
    rows = [(c, m, "()", "int", n, n // 2) for (c, m), n in uniq.items()]
    df = spark.createDataFrame(rows, "class_name string, method_name string, method_params string, return_type string, probes_count int, covered int")
    got = sorted(((r.name, r.full_name, r.parent, r.probes_count, r.covered_probes) for r in treemap.treemap(df).collect()), key=repr)
    assert got == recursive_treemap([(c, f"{m}() -> int", n, k) for c, m, _, _, n, k in rows])


def test_upsert_policies(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k string, v string, updated_at_day string")
    old, new = frame([("a", "1", "d2"), (None, "n", "d1")]), frame([("a", "2", "d1"), (None, "m", "d3"), ("b", "9", "d1")])
    get = lambda p, **o: {r.k: (r.v, r.updated_at_day) for r in upsert.merged(old, new, ["k"], p, **o).collect()}
    assert get("keep") == {"a": ("1", "d2"), None: ("n", "d1"), "b": ("9", "d1")}
    assert get("replace", columns=["v"]) == {"a": ("2", "d2"), None: ("m", "d1"), "b": ("9", "d1")}
    assert get("forward") == {"a": ("1", "d2"), None: ("n", "d3"), "b": ("9", "d1")}


def test_upserts_follow_an_order_and_guard_lengths(spark):
    rows = spark.createDataFrame([("a", "2", 2), ("a", "9", 1), ("b", "1", 5)], "k string, v string, at int")
    old = spark.createDataFrame([("b", "0")], "k string, v string")
    get = lambda p: {r.k: r.v for r in upsert.merged(old, rows, ["k"], p, order="at").collect()}
    assert get("replace") == {"a": "2", "b": "1"} and get("keep") == {"a": "9", "b": "0"}
    words = lambda w: spark.createDataFrame([("k", w, 1)], "k string, probes array<bigint>, updated_at_day int")
    with pytest.raises(Exception, match="unequal"):
        upsert.merged(words([1]), words([1, 1]), ["k"], "or").collect()


def test_retention_goes_by_updates(spark):
    f = spark.createDataFrame
    day = lambda n: DAY + dt.timedelta(n)
    cut = f([("g", day(5))], "group_id string, before date")
    t = {"builds": f([("g", "busy", day(1), day(9)), ("g", "idle", day(1), day(2)), ("h", "other", day(1), day(1))], "group_id string, build_id string, created_day date, updated_day date"),
         "methods": f([("g", "a", "old", day(1)), ("g", "a", "new", day(8)), ("g", "a", "held", day(1))], "group_id string, app_id string, method_id string, created_day date")}
    t |= {k: f([("g", "a", "busy", "held"), ("g", "a", "idle", "old")], "group_id string, app_id string, build_id string, method_id string") for k in jobs.METRIC_BY_BUILD}
    out = jobs.build_retention(t, cut)
    assert sorted(r.build_id for r in out["builds"].collect()) == ["busy", "other"] and [r.build_id for r in out["build_methods"].collect()] == ["busy"]
    assert sorted(r.method_id for r in out["methods"].collect()) == ["held", "new"]


def test_or_upsert_is_idempotent_and_commutes(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k string, b string, updated_at_day string").withColumn("probes", probes.to_words(F.col("b"))).drop("b")
    x, y = frame([("a", "100", "d1"), ("b", "1", "d1")]), frame([("a", "001", "d2"), ("b", "1", "d2")])
    get = lambda p, q: {r.k: (tuple(r.probes), r.updated_at_day) for r in upsert.merged(p, q, ["k"], "or").collect()}
    assert get(x, y) == {"a": ((5,), "d2"), "b": ((1,), "d1")} and get(x, x) == {"a": ((4,), "d1"), "b": ((1,), "d1")}
    assert {k: v[0] for k, v in get(y, x).items()} == {k: v[0] for k, v in get(x, y).items()}


def test_rules_pages_and_sorting(spark):
    with pytest.raises(ValueError):
        payloads.ignore_rule("g", "a")
    with pytest.raises(Exception):
        payloads.ignore_rule("g", "a", "(")
    assert payloads.ignore_rule("g", "a", "m.*")["classname_pattern"] is None
    df = spark.range(10)
    assert [r.id for r in report.page(df.orderBy("id"), 2, 4).collect()] == [4, 5, 6, 7]
    assert report.page_total(3, 2, 4, lambda: 1 / 0) == 7 and report.page_total(4, 1, 4, lambda: 10) == 10
    with pytest.raises(ValueError):
        report.ordered(df, [("x; drop", False)], ["id"])
    assert formats.method_pattern() is None and formats.method_pattern("com") == "com%:%:%:%" and formats.method_pattern(cls="C", name="m") == "C:m:%:%"


def test_refresh_status(spark):
    rows = [("g", s, d, 1.0, 2, e) for s, d, e in (("SUCCESS", "d1", None), ("FAILED", "d3", "x"), ("LOADING", "d2", "y"))]
    r = report.refresh_status(spark.createDataFrame(rows, "group_id string, status string, last_processed_at string, duration double, rows long, error string")).first()
    assert (r.status, r.last_processed_at, r.duration, r.rows, r.errors) == ("FAILED", "d3", 3.0, 6, "x; y")


def test_similar_builds(spark):
    w = World(spark).build(1, m1=(1, 2), m2=(1, 2)).build(2, m1=(1, 2), m2=(2, 2))
    r = coverage.similar_builds(w.tables() | {"builds": w.tables()["builds"].withColumn("branch", F.lit("main"))}, "g:a:2").first()
    assert (r.build_id, r.shared_methods, r.identity_ratio) == ("g:a:1", 1, 0.5)


def test_isolated_at_most_aggregated(spark):
    rng = random.Random(1)
    w = World(spark)
    for n in range(4):
        w.build(n, **{f"m{k}": (n // (k + 1), 5) for k in range(4)})
        for k, t in itertools.product(range(4), "xy"):
            w.test(n, t, **{f"m{k}": "".join(rng.choice("01") for _ in range(5))})
    for r in coverage.methods_with_coverage(w.tables(), ["g:a:2", "g:a:3"]).collect():
        assert 0 <= r.isolated_covered <= r.aggregated_covered <= r.probes_count


def test_or_upsert_keeps_all_bits_of_repeated_incoming_keys(spark):
    ddl = "k string, probes array<bigint>, updated_at_day int"
    rows = [("a", [1], 1), ("a", [2], 3), ("a", [4], 2), ("b", [8], 1), (None, [1], 1), (None, [2], 1)]
    new, old = spark.createDataFrame(rows, ddl), spark.createDataFrame([("b", [8], 0), ("c", [1], 0), (None, [4], 0)], ddl)
    fold = {}
    for k, p, d in rows:
        bits, day = fold.get(k, (0, 0))
        fold[k] = (bits | p[0], max(day, d))
    got = {r.k: (r.probes[0], r.updated_at_day) for r in upsert.merged(old.limit(0), new, ["k"], "or").collect()}
    assert got == fold
    got = {r.k: (r.probes[0], r.updated_at_day) for r in upsert.merged(old, new, ["k"], "or").collect()}
    assert got == {"a": (7, 3), "b": (8, 0), "c": (1, 0), None: (7, 1)}  # b's bits don't change, so its day stays


def test_or_by_in_one_shuffle(spark):
    df = spark.createDataFrame([("a", [1, 2]), ("a", [4, 8]), ("b", None), ("b", [3]), ("c", None), (None, [])], "k string, probes array<bigint>")
    wide = {r.k: r.probes for r in probes.or_by(df, ["k"], width=2).collect()}
    assert wide == {r.k: r.probes for r in probes.or_by(df, ["k"]).collect() if r.k is not None} | {None: []} and wide["a"] == [5, 10]
    with pytest.raises(Exception, match="more than 1 words"):
        probes.or_by(df, ["k"], width=1).collect()
    assert probes.or_by(df, ["k"], width=2)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_store_keeps_the_last_versions(spark, tmp_path):
    store = upsert.Store(spark, f"file://{tmp_path}", versions=2)
    for n in range(4):
        store.write("t", spark.range(n))
    assert store.read("t").count() == 3 and len([p for p in (tmp_path / "t").iterdir() if p.name != "_current"]) == 2
    store.upsert("t", spark.range(10, 12), ["id"], "keep", without=F.col("id") < 2)
    assert sorted(r.id for r in store.read("t").collect()) == [2, 10, 11]


def test_days_are_kept_by_month(spark, tmp_path):
    store = upsert.Store(spark, f"file://{tmp_path}")
    rows = lambda *r: spark.createDataFrame([("g", dt.date(2024, m, d), v) for m, d, v in r], "group_id string, day date, v long")
    for new in (rows((1, 1, 1), (1, 2, 1), (2, 1, 1)), rows((1, 2, 5), (1, 3, 5))):
        first = store._latest("method_daily_coverage")
        store.upsert("method_daily_coverage", new, ["group_id", "day"], "replace")
    last = store._latest("method_daily_coverage")["folders"]
    assert len(last) == 2 and len(set(last) & set(first["folders"])) == 1
    assert sorted((r.day.month, r.day.day, r.v) for r in store.read("method_daily_coverage").collect()) == [(1, 1, 1), (1, 2, 5), (1, 3, 5), (2, 1, 1)]


def test_an_upsert_rewrites_only_the_partitions_it_touches(spark, tmp_path):
    store = upsert.Store(spark, f"file://{tmp_path}", partitions={"t": ("g", "day")})
    rows = lambda *r: spark.createDataFrame([(g, d and dt.date(2024, 1, d), k, v) for g, d, k, v in r], "g string, day date, k long, v string")
    store.upsert("t", rows(("a/b=1", 1, 1, "x"), ("a/b=1", 2, 1, "x"), ("7", None, 1, "x")), ["g", "day", "k"], "replace")
    before = set(store._latest("t")["folders"])
    store.upsert("t", rows(("a/b=1", 2, 1, "y"), ("a/b=1", 2, 2, "z"), ("7", None, 2, "n")), ["g", "day", "k"], "replace")
    after = store._latest("t")["folders"]
    assert len(before) == 3 and len(after) == 3 and len(before & set(after)) == 1
    got = sorted((r.g, r.day and r.day.day, r.k, r.v) for r in store.read("t").filter("day IS NOT NULL").collect())
    assert got == [("a/b=1", 1, 1, "x"), ("a/b=1", 2, 1, "y"), ("a/b=1", 2, 2, "z")]
    assert sorted((r.k, r.v) for r in store.read("t").filter("day IS NULL AND g = '7'").collect()) == [(1, "x"), (2, "n")]
    store.delete("t", "k = 2 AND day IS NOT NULL")
    assert len(set(after) & set(store._latest("t")["folders"])) == 2 and store.read("t").count() == 4
    store.delete("t", "g IS NOT NULL")
    assert store.read("t").count() == 0 and store.read("t").columns == ["k", "v", "g", "day"]


def folder_bytes(path):
    return {f: f.stat().st_size for f in path.rglob("*") if f.is_file() and "_current" not in f.parts}


def test_a_log_takes_each_batch_once_and_writes_only_it(spark, tmp_path):
    store = upsert.Store(spark, f"file://{tmp_path}", versions=1, fan=4)
    rows = lambda n: spark.createDataFrame([("g", f"r{n}", dt.datetime(2024, 1 + n % 2, 1))], "group_id string, v string, created_at timestamp_ntz").coalesce(1)
    written, before = [], {}
    for n in range(11):
        store.append("method_coverage", rows(n), "s", n)
        store.append("method_coverage", rows(n), "s", n)  # a batch that is run again
        now = folder_bytes(tmp_path)
        written.append(sum(size for f, size in now.items() if f not in before))
        before = now
    assert sorted(r.v for r in store.read("method_coverage").collect()) == sorted(f"r{n}" for n in range(11))
    m = store._latest("method_coverage")
    assert len(m["folders"]) < 11 and max(m["levels"]) == 1  # four batches of a month became one folder, once
    plain = [w for n, w in enumerate(written) if n not in (6, 7)]  # the batches that didn't complete a tier
    assert max(plain) < 1.5 * min(plain)  # what a batch writes doesn't grow with what is there
    store.append("method_coverage", rows(1), "another stream", 0)
    assert store.read("method_coverage").count() == 12


def test_deltas_read_like_rewrites(spark, tmp_path):
    rng = random.Random(5)
    for case, (policy, columns) in enumerate((("replace", None), ("replace", ["v"]), ("keep", None), ("forward", None))):
        deltas = upsert.Store(spark, f"file://{tmp_path}/{case}/d", deltas=("t",), fan=3)
        whole = upsert.Store(spark, f"file://{tmp_path}/{case}/w", deltas=())
        for n in range(8):
            new = spark.createDataFrame([("g", rng.choice("abcd"), f"{n}{k}", f"d{rng.randint(0, 9)}", k) for k in range(3)] + [("g", None, str(n), "d0", 0)], "group_id string, k string, v string, updated_at_day string, at int")
            before = folder_bytes(tmp_path / str(case) / "d")
            for s in (deltas, whole):
                s.upsert("t", new, ["group_id", "k"], policy, columns, order="at")
            if n == 1:
                assert set(before) <= set(folder_bytes(tmp_path / str(case) / "d"))  # the first delta stays as it was
        rows = lambda s: sorted(map(repr, s.read("t").collect()))
        assert rows(deltas) == rows(whole) and len(deltas._latest("t")["folders"]) < 5
        for s in (deltas, whole):
            s.delete("t", "k = 'a'")
            s.upsert("t", spark.createDataFrame([("g", "b", "x", "d9", 1)], "group_id string, k string, v string, updated_at_day string, at int"), ["group_id", "k"], policy, columns, F.col("k") == "c", order="at")
        assert rows(deltas) == rows(whole)


def test_old_months_leave_the_manifest(spark, tmp_path):
    store = upsert.Store(spark, f"file://{tmp_path}")
    rows = [(g, dt.date(2024, m, d), m) for g in "gh" for m in (1, 2, 3) for d in (5, 20)]
    store.upsert("method_daily_coverage", spark.createDataFrame(rows, "group_id string, day date, v long"), ["group_id", "day"], "replace")
    before = store._latest("method_daily_coverage")["folders"]
    store.delete_before("method_daily_coverage", "day", {"g": dt.date(2024, 2, 10)})
    after = store._latest("method_daily_coverage")["folders"]
    assert len(before) == 6 and len(after) == 5 and len(set(before) & set(after)) == 4  # one month gone, one rewritten
    assert sorted((r.group_id, r.day) for r in store.read("method_daily_coverage").collect()) == sorted((g, d) for g, d, _ in rows if g == "h" or d >= dt.date(2024, 2, 10))
    store.delete_before("method_daily_coverage", "day", {"h": dt.date(2024, 3, 1)})
    assert len(store._latest("method_daily_coverage")["folders"]) == 3
    store.upsert("test_launches", spark.createDataFrame([("g", "a", dt.date(2024, 1, 1)), ("g", "b", dt.date(2024, 3, 1))], "group_id string, launch_id string, created_day date"), ["group_id", "launch_id"], "replace")
    store.delete_before("test_launches", "created_day", {"g": dt.date(2024, 2, 10)})
    assert [r.launch_id for r in store.read("test_launches").collect()] == ["b"]


def test_snapshots_stand_for_the_days_before(spark):
    rng = random.Random(9)
    w = World(spark)
    for n in (0, 40, 75, 200):
        w.build(n, m1=(1, 70), m2=(n // 50, 3))
    for n in (0, 40, 75, 200):
        for k in range(40):
            w.test(n, rng.choice("xy"), rng.choice(["PASSED", "FAILED"]), m1="".join(rng.choice("0000001") for _ in range(70)), m2=rng.choice(["100", "010", "001"]))
    t = w.tables()
    spread = t["method_daily_coverage"].withColumn("day", F.date_add("day", F.pmod(F.xxhash64("bits", "test"), F.lit(60)).cast("int")))
    t["method_daily_coverage"] = spread
    snaps = transform.coverage_snapshots(spread)
    builds = [f"g:a:{n}" for n in (0, 40, 75, 200)]
    rows = lambda x, **f: sorted((r.build_id, r.method_id, r.isolated_covered, r.aggregated_covered) for r in coverage.methods_with_coverage(x, builds, **f).collect())
    for f in ({}, {"results": ["PASSED"]}, {"period_from": DAY + dt.timedelta(50)}, {"smart_before_build": False}):
        assert rows(t, **f) == rows(t | {"coverage_snapshots": snaps}, **f)
    wanted = coverage.methods_of(t, builds).select("build_id", "group_id", "app_id", "method_id").join(t["builds"].select("build_id", "created_day"), "build_id")
    plain, fast = coverage.days_before(t, wanted, []).count(), coverage.days_before(t | {"coverage_snapshots": snaps}, wanted, []).count()
    assert fast < plain / 2  # a key's past is one row
    keys = [c for c in transform.DAY_KEYS if c != "day"]
    assert snaps.groupBy(*keys, "month").count().filter("count > 1").count() == 0


def test_class_vectors_of_many_methods_are_joined_and_cut_in_proportion(spark):
    n, width = 40_000, 60
    parts = spark.range(n).select(F.lit("c").alias("k"), (F.col("id") * (width + 1)).alias("pos"), F.expr(f"rpad(concat(bin(id), '1'), {width}, '0')").alias("bits"))
    begun = time.time()
    whole = probes.concat_by_position(parts, ["k"], "pos", "bits").withColumnRenamed("bits", "class_probes")
    m = parts.select("k", F.col("pos").cast("int").alias("probe_start_pos"), F.lit(width).alias("probes_count"), F.col("bits").alias("want"))
    got = probes.split_class_probes(whole, m, ["k"])
    assert got.filter("probes = want").count() == n
    assert time.time() - begun < 60


def test_joined_and_cut_class_vectors_equal_those_made_bit_by_bit(spark, monkeypatch):
    monkeypatch.setattr(probes, "BLOCK", 8)
    rnd, rows, want = random.Random(1), [], {}
    for k in range(20):
        mine = [(rnd.randrange(60), "".join(rnd.choice("01") for _ in range(rnd.randrange(12)))) for _ in range(rnd.randrange(1, 9))]
        rows += [(k, s, b) for s, b in mine]
        acc = ""
        for s, b in sorted(mine):
            acc = acc.ljust(s, "0") + b
        want[k] = acc
    got = probes.concat_by_position(spark.createDataFrame(rows, "k int, s int, b string"), ["k"], "s", "b")
    assert {r.k: r.b for r in got.collect()} == want
    cuts = [(k, s, n) for k in want for s in range(0, 70, 3) for n in (0, 1, 7, 8, 9, 20)]
    out = probes.split_class_probes(got.withColumnRenamed("b", "class_probes"), spark.createDataFrame(cuts, "k int, probe_start_pos int, probes_count int"), ["k"])
    assert sorted((r.k, r.probe_start_pos, r.probes_count, r.probes) for r in out.collect()) == sorted((k, s, n, x) for k, s, n in cuts if len(x := want[k][s : s + n]) == n and "1" in x)


def test_payloads_of_a_build_are_bounded(spark):
    n = 2500
    m1 = spark.range(n).selectExpr("'g:a:1' AS build_id", "'g' AS group_id", "'a' AS app_id", "id AS p_partkey", "'c/K' AS class_name", "concat('m', id) AS method_name", "'()' AS method_params", "'void' AS return_type", "1L AS probes_count", "'1' AS body_checksum")
    p = ingest_queries._methods({"m1": m1})
    assert p.agg(F.max(F.size("methods"))).first()[0] <= ingest_queries.A_PAYLOAD
    assert [x.count() for x in payloads.save_methods(p)] == [n, n]


def test_snapshots_of_a_known_width_are_the_same_with_one_shuffle(spark, tmp_path):
    rng = random.Random(3)
    w = World(spark).build(0, m1=(1, 70), m2=(1, 3))
    for _ in range(60):
        w.test(0, rng.choice("xy"), m1="".join(rng.choice("0000001") for _ in range(70)), m2=rng.choice(["100", "010", "001"]))
    daily = w.tables()["method_daily_coverage"].withColumn("day", F.date_add("day", F.pmod(F.xxhash64("bits", "test"), F.lit(200)).cast("int")))
    daily.write.parquet(f"{tmp_path}/daily")
    daily = spark.read.parquet(f"{tmp_path}/daily")  # constant keys would be folded away
    plain, wide = transform.coverage_snapshots(daily), transform.coverage_snapshots(daily, 2)
    rows = lambda df: sorted(map(repr, df.select(sorted(plain.columns)).collect()))
    assert rows(plain) == rows(wide) and plain.count() == len(rows(wide)) > 5
    assert wide._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
