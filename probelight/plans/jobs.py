"""Build validation, retention and deletion as keep-filters: each job returns the content that its tables should have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelight.functions.formats import combined_checksum
from probelight.operators.upsert import without_keys

from .coverage import links

Tables = dict[str, DataFrame]
METHOD = ["group_id", "app_id", "method_id"]
METRIC_BY_BUILD = ("build_method_coverage", "session_coverage", "definition_coverage", "session_builds", "build_methods")


def build_checksums(build_methods: DataFrame, methods: DataFrame) -> DataFrame:
    """Per build: methods_count and the combined checksum of its methods' bodies."""
    rows = build_methods.select("build_id", *METHOD).join(methods.select(*METHOD, "body_checksum"), METHOD)
    return rows.groupBy("build_id").agg(F.count("*").alias("methods_count"), combined_checksum(F.col("body_checksum")).alias("methods_checksum"))


def validate_builds(expected: DataFrame, build_methods: DataFrame, methods: DataFrame, now: Column, window_minutes: int = 60) -> DataFrame:
    """``expected`` (build_id, expected_count, expected_checksum, finalized_at) with status VALID, INVALID or PENDING."""
    got = build_checksums(build_methods, methods)
    n = F.coalesce("methods_count", F.lit(0))
    late = now > F.col("finalized_at") + F.expr(f"INTERVAL {window_minutes} MINUTES")
    status = (
        F.when(F.col("expected_count").isNull() | F.col("finalized_at").isNull(), "PENDING")
        .when(n < F.col("expected_count"), F.when(late, "INVALID").otherwise("PENDING"))
        .when(n > F.col("expected_count"), "INVALID")
        .when(F.coalesce("methods_checksum", F.lit("0")) == F.col("expected_checksum"), "VALID").otherwise("INVALID")
    )
    return expected.join(got, "build_id", "left").withColumn("status", status)


def cut_offs(settings: DataFrame, today: Column, column: str = "metrics_period_days") -> DataFrame:
    """(group_id, before): groups without a period are left out."""
    return settings.filter(F.col(column).isNotNull()).select("group_id", F.date_sub(today, F.col(column).cast("int")).alias("before"))


def older(df: DataFrame, cut: DataFrame, column: str) -> DataFrame:
    return df.join(cut, "group_id").filter(F.col(column) < F.col("before")).drop("before")


def younger(df: DataFrame, cut: DataFrame, column: str) -> DataFrame:
    """Rows that retention keeps: those of groups without a cut-off, and those not before it."""
    return df.join(cut, "group_id", "left").filter(F.col("before").isNull() | ~F.coalesce(F.col(column) < F.col("before"), F.lit(False))).drop("before").select(df.columns)


#: The day that the retention of a raw table goes by: builds that still get data are kept.
RAW_AGE = {"raw_coverage": "day", "instances": "created_day", "launches": "created_day", "sessions": "started_day", "raw_build_methods": "created_day", "builds": "updated_day"}


def raw_retention(t: Tables, cut: DataFrame) -> Tables:
    """Raw rows before the cut-off go, builds by their last update; definitions, methods and links of sessions are kept."""
    return t | {k: younger(t[k], cut, day) for k, day in RAW_AGE.items()}


def build_retention(t: Tables, cut: DataFrame) -> Tables:
    """Metric rows of builds without a recent update go, then old methods that no build has, then the builds."""
    old = older(t["builds"], cut, "updated_day").select("build_id")
    out = t | {k: without_keys(t[k], old, ["build_id"]) for k in METRIC_BY_BUILD}
    held = out["build_methods"].select(*METHOD).distinct()
    orphan = older(t["methods"], cut, "created_day").join(held, METHOD, "left_anti")
    return out | {"methods": without_keys(t["methods"], orphan, METHOD), "builds": without_keys(t["builds"], old, ["build_id"])}


def test_retention(t: Tables, cut: DataFrame) -> Tables:
    """Old launches; coverage and links of old sessions; coverage and mapping of definitions without a recent update."""
    old = older(t["sessions"], cut, "started_day").select("session_id")
    gone = older(t["definitions"], cut, "updated_day").select("definition_id")
    out = t | {"launches": younger(t["launches"], cut, "created_day"), "sessions": without_keys(t["sessions"], old, ["session_id"])}
    out |= {k: without_keys(t[k], old, ["session_id"]) for k in ("session_coverage", "definition_coverage", "session_builds")}
    return out | {"definition_coverage": without_keys(out["definition_coverage"], gone, ["definition_id"]), "mapping": without_keys(t["mapping"], gone, ["definition_id"]), "definitions": without_keys(t["definitions"], gone, ["definition_id"])}


def daily_retention(t: Tables, cut: DataFrame) -> Tables:
    return t | {"method_daily_coverage": younger(t["method_daily_coverage"], cut, "day")}


def _with_parent(df: DataFrame, old: Column, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that are not old or whose keys a parent has.  ``df`` is read once: a view is folded for each reading."""
    held = parents.select(*keys).distinct().withColumn("_held", F.lit(True))
    return df.join(held, keys, "left").filter(~F.coalesce(old, F.lit(False)) | F.col("_held").isNotNull()).select(df.columns)


def orphan_clean_up(t: Tables, group: str, before: Column) -> Tables:
    """Old rows of a group without a parent go; recent ones stay."""
    old = lambda day: (F.col("group_id") == group) & (F.col(day) < before)
    return t | {
        "methods": _with_parent(t["methods"], old("created_day"), t["build_methods"], METHOD),
        "method_daily_coverage": _with_parent(t["method_daily_coverage"], old("day"), t["methods"], METHOD),
        "mapping": _with_parent(t["mapping"], old("updated_at_day"), t["methods"], ["group_id", "app_id", "signature"]),
    }


def delete_build(t: Tables, build: str) -> Tables:
    gone = F.col("build_id") == build
    return t | {k: t[k].filter(~gone) for k in (*METRIC_BY_BUILD, "builds", "instances", "raw_build_methods", "raw_coverage")}


def delete_session(t: Tables, session: str) -> Tables:
    out = t | {k: t[k].filter(F.coalesce(F.col("session_id") != session, F.lit(True))) for k in ("session_coverage", "definition_coverage", "session_builds", "sessions", "launches")}
    ids = t["launches"].filter(F.col("session_id") == session).select("launch_id")
    return out | {"raw_coverage": t["raw_coverage"].join(ids, "launch_id", "left_anti").select(t["raw_coverage"].columns)}


def newest(metadata: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key the newest row."""
    from probelight.operators.transform import last_of

    return last_of(metadata, keys, order)


_METRIC = ["env_id", "result", "tag"]
#: What tells a row of each table from others.
KEYS = {
    "raw_coverage": ["build_id", "method_id", "instance_id", "day", "launch_id", "probes"], "launches": ["launch_id"], "sessions": ["session_id"], "raw_build_methods": ["build_id", "method_id"],
    "build_methods": ["build_id", "method_id"], "builds": ["build_id"], "methods": ["app_id", "method_id"], "session_builds": ["session_id", "build_id"],
    "build_method_coverage": ["build_id", "method_id", *_METRIC, "task_id"], "session_coverage": ["build_id", "method_id", "session_id", *_METRIC],
    "definition_coverage": ["build_id", "method_id", "session_id", "definition_id", "env_id", "result"], "definitions": ["definition_id"], "instances": ["instance_id"],
    "method_daily_coverage": ["app_id", "method_id", "day", "branch", *_METRIC, "task_id"], "mapping": ["app_id", "signature", "definition_id", "branch", "env_id", "task_id"],
}


def contents(t: Tables, *names: str) -> DataFrame:
    """(name, n, digest) of some tables, one row each: rows and the sum of their keys' hashes."""
    out = None
    for k in names:
        digest = F.conv(F.substring(F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in KEYS[k]))), 1, 8), 16, 10).cast("long")
        one = t[k].agg(F.count("*").alias("n"), F.coalesce(F.sum(digest), F.lit(0)).cast("long").alias("digest")).select(F.lit(k).alias("name"), "n", "digest")
        out = one if out is None else out.union(one)
    return out


def _cut(t: Tables, day: str) -> DataFrame:
    settings = t["builds"].select("group_id").distinct().withColumn("metrics_period_days", F.lit(90))
    return cut_offs(settings, F.date_add(F.to_date(F.lit(day)), 90))


_HASH = lambda name: f"('0x' || substr(md5(concat_ws('|', {', '.join(f'{c}::VARCHAR' for c in KEYS[name])})), 1, 8))::BIGINT"
_N = lambda name, q: f"SELECT '{name}' AS name, count(*) AS n, coalesce(sum({_HASH(name)}), 0)::BIGINT AS digest FROM {q}"
_CUT = "2000-01-01"
#: Builds by their last update or newest instance, as the metric table has it.
_SEEN = "(SELECT b.*, greatest(updated_at, (SELECT max(created_at) FROM instances i WHERE i.build_id = b.build_id))::DATE AS seen_day FROM builds b)"
_NEW = f"(SELECT build_id FROM {_SEEN} WHERE seen_day >= DATE '{_CUT}')"
_GONE = "(build_id LIKE '%:1997' OR build_id LIKE '%:1998')"
_HELD = f"(m.created_day >= DATE '1998-01-01' OR EXISTS (SELECT 1 FROM build_methods b WHERE NOT {_GONE} AND b.app_id = m.app_id AND b.method_id = m.method_id))"


def _orphans(t: Tables) -> Tables:
    t = t | {"build_methods": links(t).filter(f"NOT {_GONE}")}
    for _ in range(2):
        t = orphan_clean_up(t, "g1", F.to_date(F.lit("1998-01-01")))
    return t


def registered() -> dict:
    """name -> (job over derived tables, DuckDB query)."""
    age = lambda t: _cut(t, _CUT)
    expected = lambda t: build_checksums(t["raw_build_methods"], t["raw_methods"]).join(t["builds"].select("build_id", "y"), "build_id").select(
        "build_id", (F.col("methods_count") + F.when(F.col("y") % 3 == 0, 1).when(F.col("y") % 3 == 1, 0).otherwise(-1)).alias("expected_count"), F.col("methods_checksum").alias("expected_checksum"), F.to_timestamp_ntz(F.concat("y", F.lit("-01-01 00:00:00"))).alias("finalized_at"))
    return {
        "j1_build_validation": (
            lambda t: validate_builds(expected(t), t["raw_build_methods"], t["raw_methods"], F.to_timestamp_ntz(F.lit("1999-01-01 00:30:00"))).select("build_id", "methods_count", "status"),
            "SELECT b.build_id, count(*) AS methods_count, CASE WHEN y % 3 = 0 THEN CASE WHEN TIMESTAMP '1999-01-01 00:30:00' > b.created_day + INTERVAL 60 MINUTE THEN 'INVALID' ELSE 'PENDING' END WHEN y % 3 = 1 THEN 'VALID' ELSE 'INVALID' END AS status FROM raw_build_methods x JOIN builds b ON x.build_id = b.build_id GROUP BY b.build_id, y, b.created_day",
        ),
        "j2_combined_checksum": (
            lambda t: build_checksums(t["raw_build_methods"], t["raw_methods"]).select("build_id", F.conv("methods_checksum", 36, -10).cast("long").alias("total")),
            "SELECT build_id, sum(list_sum(list_transform(range(1, length(body_checksum) + 1), lambda i: (ascii(body_checksum[i]) - 48) * (36 ** (length(body_checksum) - i))::BIGINT)))::BIGINT AS total FROM raw_build_methods x JOIN raw_methods m ON x.app_id = m.app_id AND x.method_id = m.method_id GROUP BY build_id",
        ),
        "j3_raw_retention": (
            lambda t: contents(raw_retention(t | {"builds": t["raw_builds"], "instances": t["instances"].withColumn("created_day", F.to_date("created_at"))}, age(t)), *RAW_AGE),
            " UNION ALL ".join(_N(n, f"{n} WHERE {c} >= DATE '{_CUT}'") for n, c in (RAW_AGE | {"instances": "created_at::DATE"}).items()),
        ),
        "j4_build_retention": (
            lambda t: contents(build_retention(t, age(t)), "build_method_coverage", "session_coverage", "session_builds", "build_methods", "methods", "builds"),
            " UNION ALL ".join([*(_N(n, f"{q} WHERE build_id IN {_NEW}") for n, q in (("build_method_coverage", "bmc"), ("session_coverage", "bmsc"), ("session_builds", "session_builds"), ("build_methods", "build_methods"), ("builds", "builds"))), _N("methods", f"methods m WHERE created_day >= DATE '{_CUT}' OR EXISTS (SELECT 1 FROM build_methods b WHERE build_id IN {_NEW} AND b.app_id = m.app_id AND b.method_id = m.method_id)")]),
        ),
        "j5_test_retention": (
            lambda t: contents(test_retention(t, age(t)), "launches", "sessions", "session_coverage", "definition_coverage", "session_builds", "mapping", "definitions"),
            " UNION ALL ".join([_N("launches", f"launches WHERE created_day >= DATE '{_CUT}'"), *(_N(n, f"{q} x WHERE NOT EXISTS (SELECT 1 FROM sessions s WHERE s.session_id = x.session_id AND started_day < DATE '{_CUT}')") for n, q in (("sessions", "sessions"), ("session_coverage", "bmsc"), ("session_builds", "session_builds"))),
                                _N("definition_coverage", f"bmdc WHERE session_id IN (SELECT session_id FROM sessions WHERE started_day >= DATE '{_CUT}') AND definition_id IN (SELECT definition_id FROM definitions WHERE updated_day >= DATE '{_CUT}')"), *(_N(n, f"{n} WHERE definition_id IN (SELECT definition_id FROM definitions WHERE updated_day >= DATE '{_CUT}')") for n in ("mapping", "definitions"))]),
        ),
        "j6_daily_retention": (lambda t: contents(daily_retention(t, age(t)), "method_daily_coverage"), _N("method_daily_coverage", f"mdc WHERE day >= DATE '{_CUT}'")),
        "j7_orphan_clean_up": (  # two runs: the methods of one year's builds become orphans, then what hangs on them
            lambda t: contents(_orphans(t), "methods", "method_daily_coverage", "mapping"),
            " UNION ALL ".join([_N("methods", f"methods m WHERE {_HELD}"), _N("method_daily_coverage", f"mdc d WHERE day >= DATE '1998-01-01' OR EXISTS (SELECT 1 FROM methods m WHERE {_HELD} AND m.app_id = d.app_id AND m.method_id = d.method_id)"), _N("mapping", f"mapping d WHERE updated_at_day >= DATE '1998-01-01' OR EXISTS (SELECT 1 FROM methods m WHERE {_HELD} AND m.app_id = d.app_id AND m.signature = d.signature)")]),
        ),
        "j8_delete_build": (
            lambda t: contents(delete_build(t, "g1:app-0:1997"), "build_method_coverage", "build_methods", "builds", "raw_coverage"),
            " UNION ALL ".join(_N(n, f"{q} WHERE build_id <> 'g1:app-0:1997'") for n, q in (("build_method_coverage", "bmc"), ("build_methods", "build_methods"), ("builds", "builds"), ("raw_coverage", "raw_coverage"))),
        ),
        "j9_delete_session": (
            lambda t: contents(delete_session(t, "s1997-3"), "session_coverage", "session_builds", "launches", "raw_coverage"),
            " UNION ALL ".join([*(_N(n, f"{q} WHERE session_id <> 's1997-3'") for n, q in (("session_coverage", "bmsc"), ("session_builds", "session_builds"), ("launches", "launches"))), _N("raw_coverage", "raw_coverage WHERE launch_id IS NULL OR launch_id NOT IN (SELECT launch_id FROM launches WHERE session_id = 's1997-3')")]),
        ),
        "j10_cut_offs": (
            lambda t: cut_offs(t["builds"].select(F.col("build_id").alias("group_id"), F.when(F.col("y") > 1996, F.col("y") - 1990).alias("metrics_period_days")), F.to_date(F.lit("2002-01-01"))).select(F.col("group_id").alias("name"), F.col("before").cast("string").alias("before")),
            "SELECT build_id AS name, (DATE '2002-01-01' - (y - 1990)::INT)::VARCHAR AS before FROM builds WHERE y > 1996",
        ),
        "j11_newest_metadata": (
            lambda t: newest(t["launches"].select("definition_id", "launch_id", "result", F.col("duration")), ["definition_id"], "duration").select("definition_id", "launch_id", "duration"),
            "SELECT definition_id, launch_id, duration FROM (SELECT *, row_number() OVER (PARTITION BY definition_id ORDER BY duration DESC, launch_id DESC) AS k FROM launches) WHERE k = 1",
        ),
    }
