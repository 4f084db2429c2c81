"""All registered queries of the core, and DuckDB SQL with the same results."""

from __future__ import annotations

import functools
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelight.functions import probes
from probelight.operators import extract, transform, upsert

from . import coverage, end_to_end, etl_queries, impact, ingest_queries, jobs, report, treemap, views
from .derive import WORDS, raw
from .metrics import bits, metrics, sql
from .stored import tables

BUILD, BASE = "g1:app-0:1997", "g1:app-0:1996"
_Q: dict[str, tuple[Callable, str | None]] = {}


def _add(name: str, f: Callable[[dict[str, DataFrame]], DataFrame], query: str | None = None, *more: tuple[str, str]) -> None:
    """Registers a query over the metric tables, with DuckDB SQL over the same tables."""
    _Q[name] = (lambda spark, sf_dir: f(tables(spark, sf_dir, lambda: metrics(raw(spark, sf_dir)))), sql(query, *more) if query else None)


def _text(df: DataFrame, *days: str) -> DataFrame:
    return df.withColumns({d: F.col(d).cast("string") for d in days})


# --- coverage SQL -------------------------------------------------------------------------------------------------
def _f2(builds: str, base: str | None = None, where: str = "", smart: bool = True) -> tuple[tuple[str, str], ...]:
    new = f"AND NOT EXISTS (SELECT 1 FROM build_methods o WHERE o.build_id = '{base}' AND o.method_id = b.method_id)" if base else ""
    any_ = f"SELECT b.build_id, d.method_id, bit_or(d.probes) AS p FROM mdc d JOIN builds b ON d.app_id = b.app_id AND d.day <= b.created_day WHERE b.build_id IN ({builds}) {where} GROUP BY ALL" if smart else "SELECT NULL::VARCHAR AS build_id, NULL::VARCHAR AS method_id, NULL::BIT AS p"
    return (
        ("base", f"SELECT b.build_id, m.* FROM build_methods b JOIN methods m ON b.app_id = m.app_id AND b.method_id = m.method_id WHERE b.build_id IN ({builds}) {new}"),
        ("own", f"SELECT build_id, method_id, bit_or(probes) AS p FROM bmc d WHERE build_id IN ({builds}) {where} GROUP BY ALL"),
        ("anyc", any_),
        ("f2", """SELECT base.*, coalesce(bit_count(own.p), 0)::BIGINT AS isolated_covered,
          coalesce(bit_count(CASE WHEN own.p IS NULL THEN anyc.p WHEN anyc.p IS NULL THEN own.p ELSE own.p | anyc.p END), 0)::BIGINT AS aggregated_covered
          FROM base LEFT JOIN own ON base.build_id = own.build_id AND base.method_id = own.method_id LEFT JOIN anyc ON base.build_id = anyc.build_id AND base.method_id = anyc.method_id"""),
    )


_F2 = "SELECT build_id, signature, method_id, probes_count, isolated_covered, aggregated_covered, probes_count - isolated_covered AS isolated_missed, probes_count - aggregated_covered AS aggregated_missed, isolated_covered::DOUBLE / probes_count AS isolated_ratio, aggregated_covered::DOUBLE / probes_count AS aggregated_ratio FROM f2"
_F2_COLS = ["build_id", "signature", "method_id", "probes_count", "isolated_covered", "aggregated_covered", "isolated_missed", "aggregated_missed", "isolated_ratio", "aggregated_ratio"]
_CHANGES = ("ch", f"""SELECT signature, min(class_name) AS class_name, min(method_name) AS method_name,
  CASE WHEN count(DISTINCT m.method_id) > 1 THEN 'modified' WHEN count(*) > 1 THEN 'equal' WHEN bool_or(b.build_id = '{BUILD}') THEN 'new' ELSE 'deleted' END AS change
  FROM build_methods b JOIN methods m ON b.app_id = m.app_id AND b.method_id = m.method_id WHERE b.build_id IN ('{BUILD}', '{BASE}') GROUP BY signature""")  # fmt: skip
_PAIR = f"'{BUILD}', '{BASE}'"

_add("f1_methods", lambda t: coverage.get_methods(t, BUILD, class_like="com/Brand1%").select("build_id", "method_id", "signature", "class_name", "method_name", "probes_count"),
     f"SELECT build_id, m.method_id, signature, class_name, method_name, probes_count FROM build_methods b JOIN methods m ON b.app_id = m.app_id AND b.method_id = m.method_id WHERE build_id = '{BUILD}' AND class_name LIKE 'com/Brand1%'")
_add("f2_methods_with_coverage", lambda t: coverage.methods_with_coverage(t, [BUILD]).select(*_F2_COLS), _F2, *_f2(f"'{BUILD}'"))
_add("f2_methods_with_coverage_vs_baseline", lambda t: coverage.methods_with_coverage(t, [BUILD], BASE, env_ids=["A", "N"], results=["PASSED"]).select(*_F2_COLS), _F2, *_f2(f"'{BUILD}'", BASE, "AND d.env_id IN ('A', 'N') AND d.result IN ('PASSED')"))
_ROLL = "SELECT app_id, build_id, sum(probes_count)::BIGINT AS total_probes, count(*) AS total_methods, " + ", ".join(f"sum({k}_covered)::BIGINT AS {k}_covered, count(*) FILTER ({k}_covered > 0) AS {k}_covered_methods, (sum(probes_count) - sum({k}_covered))::BIGINT AS {k}_missed, sum({k}_covered)::DOUBLE / sum(probes_count) AS {k}_ratio" for k in ("isolated", "aggregated")) + " FROM f2 GROUP BY app_id, build_id"
_add("f3_builds_with_coverage", lambda t: coverage.builds_with_coverage(t, [BUILD, BASE]).drop("group_id"), _ROLL, *_f2(_PAIR))
_add("f3_builds_with_coverage_isolated", lambda t: coverage.builds_with_coverage(t, [BUILD, BASE], include_smart=False, tags=["t1"]).drop("group_id"), _ROLL, *_f2(_PAIR, None, "AND d.tag = 't1'", False))
_ALL = lambda t: sorted(r.build_id for r in t["builds"].filter("app_id = 'app-0'").select("build_id").collect())
_add("f3_all_builds_with_coverage", lambda t: coverage.builds_with_coverage(t, _ALL(t)).drop("group_id"), _ROLL, *_f2("SELECT build_id FROM builds WHERE app_id = 'app-0'"))
_add("f4_changes", lambda t: coverage.changes(t, BUILD, BASE, include_equal=True, include_deleted=True).select("signature", "class_name", "method_name", "change"), "SELECT * FROM ch", _CHANGES)
_add("f4_changes_without_baseline", lambda t: coverage.changes(t, BUILD, None).select("signature", "change"), f"SELECT DISTINCT signature, 'new' AS change FROM build_methods b JOIN methods m ON b.app_id = m.app_id AND b.method_id = m.method_id WHERE build_id = '{BUILD}'")
_add("f5_changes_with_coverage", lambda t: coverage.changes_with_coverage(t, BUILD, BASE, include_deleted=True).select("signature", "change", "isolated_covered", "aggregated_covered"),
     "SELECT ch.signature, change, isolated_covered, aggregated_covered FROM ch LEFT JOIN f2 ON ch.signature = f2.signature WHERE change <> 'equal'", _CHANGES, *_f2(f"'{BUILD}'", BASE))
_add("f6_similar_builds", lambda t: coverage.similar_builds(t, BUILD),
     f"""SELECT o.build_id, b.branch, count(DISTINCT o.method_id) AS shared_methods, (SELECT count(DISTINCT method_id) FROM build_methods WHERE build_id = '{BUILD}') AS total_methods,
     count(DISTINCT o.method_id)::DOUBLE / (SELECT count(DISTINCT method_id) FROM build_methods WHERE build_id = '{BUILD}') AS identity_ratio
     FROM build_methods o JOIN builds b ON b.build_id = o.build_id JOIN build_methods x ON x.build_id = '{BUILD}' AND x.method_id = o.method_id AND x.app_id = o.app_id
     WHERE o.build_id <> '{BUILD}' GROUP BY o.build_id, b.branch""")  # fmt: skip
_MAP = ("mp", "SELECT DISTINCT definition_id, signature FROM mapping WHERE app_id = 'app-0'")
_IMP = ("imp", """SELECT d.definition_id, d.test_path, d.test_name, count(DISTINCT CASE WHEN ch.signature IS NOT NULL THEN mp.signature END) AS impacted_methods,
  CASE WHEN count(mp.signature) = 0 THEN 'UNKNOWN_IMPACT' WHEN count(ch.signature) > 0 THEN 'IMPACTED' ELSE 'NOT_IMPACTED' END AS status
  FROM definitions d LEFT JOIN mp ON d.definition_id = mp.definition_id LEFT JOIN ch ON mp.signature = ch.signature AND ch.change <> 'equal' GROUP BY ALL""")  # fmt: skip
_add("f7_impacted_tests", lambda t: impact.impacted_tests(t, BUILD, BASE).select("definition_id", "test_path", "test_name", "impacted_methods", "status"), "SELECT * FROM imp WHERE status = 'IMPACTED'", _CHANGES, _MAP, _IMP)
_add("f7_impact_of_all_tests", lambda t: impact.impacted_tests(t, BUILD, BASE, statuses=None).select("definition_id", "test_path", "test_name", "impacted_methods", "status"), "SELECT * FROM imp", _CHANGES, _MAP, _IMP)
_add("f8_impacted_methods", lambda t: impact.impacted_methods(t, BUILD, BASE, tags=["t1", "b"]).select("signature", "change", "impacted_tests"),
     "SELECT ch.signature, change, count(DISTINCT definition_id) AS impacted_tests FROM ch JOIN mp ON ch.signature = mp.signature WHERE change <> 'equal' AND definition_id IN (SELECT definition_id FROM tags WHERE tag IN ('t1', 'b')) GROUP BY ALL", _CHANGES, _MAP)
SESSION, DEFINITION = "s1997-3", "d1"
for _n, _table, _src, _key in (("session", "session_coverage", "bmsc", "session_id"), ("definition", "definition_coverage", "bmdc", "definition_id")):
    _keys = "session_id" if _n == "session" else "session_id, definition_id"
    _j = (("base", _f2(f"'{BUILD}'")[0][1]), ("own", f"SELECT {_keys}, method_id, bit_or(probes) AS p FROM {_src} WHERE build_id = '{BUILD}' AND session_id = '{SESSION}' GROUP BY ALL"),
          ("m", f"SELECT base.*, {_keys}, coalesce(bit_count(p), 0)::BIGINT AS covered FROM base LEFT JOIN own ON base.method_id = own.method_id"))
    _add(f"f9_methods_by_{_n}", lambda t, x=_table, k=_keys: coverage.methods_by(t, x, BUILD, session=SESSION).select("signature", *k.split(", "), "probes_count", "covered", "missed", "ratio"),
         f"SELECT signature, {_keys}, probes_count, covered, probes_count - covered AS missed, covered::DOUBLE / probes_count AS ratio FROM m", *_j)
    _add(f"f10_builds_by_{_n}", lambda t, x=_table: coverage.builds_by(t, x, BUILD, session=SESSION).drop("group_id"),
         f"SELECT app_id, build_id, {_keys}, sum(probes_count)::BIGINT AS total_probes, count(*) AS total_methods, sum(covered)::BIGINT AS covered, count(*) FILTER (covered > 0) AS covered_methods, (sum(probes_count) - sum(covered))::BIGINT AS missed, sum(covered)::DOUBLE / sum(probes_count) AS ratio FROM m GROUP BY app_id, build_id, {_keys}", *_j)
_PERIODS = lambda t: t["builds"].select(F.col("build_id").alias("group_id"), F.when(F.year("created_day") % 2 == 0, F.year("created_day") - 1990).alias("metrics_period_days"))
_add("f13_metrics_period", lambda t: _text(report.metrics_period(_PERIODS(t), F.to_date(F.lit("2002-01-01"))).withColumnRenamed("group_id", "name"), "since"),
     "SELECT build_id AS name, CASE WHEN y % 2 = 0 THEN DATE '2002-01-01' - (y - 1990)::INT ELSE DATE '1900-01-01' END::VARCHAR AS since FROM builds")

# --- views --------------------------------------------------------------------------------------------------------
_FLAG = ("tl", "SELECT *, (result = 'PASSED')::INT AS passed, (result = 'FAILED')::INT AS failed, (result = 'SKIPPED')::INT AS skipped, (result = 'SMART_SKIPPED')::INT AS smart_skipped, (result <> 'FAILED')::INT AS success FROM launches")
_SUMS = ", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in views.FLAGS)
_RES = "CASE WHEN max(failed) > 0 THEN 'FAILED' WHEN max(passed) > 0 THEN 'PASSED' WHEN max(smart_skipped) > 0 THEN 'SMART_SKIPPED' WHEN max(skipped) > 0 THEN 'SKIPPED' ELSE 'UNKNOWN' END AS result"
_V2 = ("v2", f"SELECT d.definition_id, d.test_path, d.test_name, d.tags, count(*) AS launches, avg(coalesce(duration, 0)) AS avg_duration, {_SUMS}, sum(success)::DOUBLE / count(*) AS success_rate FROM definitions d LEFT JOIN tl ON d.definition_id = tl.definition_id GROUP BY ALL")
_DUR = "CASE WHEN duration = 0 THEN '0ms' ELSE concat_ws(' ', " + ", ".join(f"CASE WHEN {e} > 0 THEN ({e})::VARCHAR || '{u}' END" for u, e in (("d", "duration // 86400000"), ("h", "duration // 3600000 % 24"), ("m", "duration // 60000 % 60"), ("s", "duration // 1000 % 60"), ("ms", "duration % 1000"))) + ") END"
_add("v1_builds", lambda t: views.builds_with_statistics(t).select("build_id", "branch", F.array_join("app_env_ids", ",").alias("envs"), "total_classes", "total_methods", "total_probes"),
     """SELECT b.build_id, b.branch, (SELECT string_agg(DISTINCT env_id, ',' ORDER BY env_id) FROM instances i WHERE i.build_id = b.build_id) AS envs, count(DISTINCT class_name) AS total_classes, count(DISTINCT signature) AS total_methods, coalesce(sum(probes_count), 0)::BIGINT AS total_probes
     FROM builds b LEFT JOIN build_methods x ON b.build_id = x.build_id LEFT JOIN methods m ON x.app_id = m.app_id AND x.method_id = m.method_id GROUP BY b.build_id, b.branch""")  # fmt: skip
_add("v2_test_definitions", lambda t: views.definitions_with_statistics(t).select("definition_id", "launches", F.round("avg_duration", 4).alias("avg_duration"), *views.FLAGS, "success_rate"), f"SELECT definition_id, launches, round(avg_duration, 4) AS avg_duration, {', '.join(views.FLAGS)}, success_rate FROM v2", _FLAG, _V2)
_add("v3_test_sessions", lambda t: views.sessions_with_statistics(t).drop("group_id", "started_day"),
     f"""SELECT s.session_id, s.task_id, count(DISTINCT tl.definition_id) AS definitions, count(*) AS launches, {_RES.replace('max(', 'max(tl.')}, sum(coalesce(duration, 0))::BIGINT AS duration, {_SUMS.replace('sum(', 'sum(tl.')},
     sum(CASE WHEN tl.smart_skipped = 1 THEN round(v2.avg_duration)::BIGINT ELSE 0 END)::BIGINT AS time_saved, sum(tl.success)::DOUBLE / count(*) AS success_rate
     FROM sessions s LEFT JOIN tl ON s.session_id = tl.session_id LEFT JOIN v2 ON tl.definition_id = v2.definition_id GROUP BY s.session_id, s.task_id""", _FLAG, _V2)  # fmt: skip
_add("v4_test_files", lambda t: views.file_launches(t).drop("group_id"), f"SELECT test_path, session_id, count(DISTINCT d.definition_id) AS definitions, count(DISTINCT launch_id) AS launches, {_RES}, sum(coalesce(duration, 0))::BIGINT AS duration, {_SUMS} FROM definitions d LEFT JOIN tl ON d.definition_id = tl.definition_id GROUP BY test_path, session_id", _FLAG)
_add("v5_session_definitions", lambda t: views.session_definitions(t).drop("group_id"),
     f"SELECT *, {_DUR} AS duration_text FROM (SELECT session_id, d.definition_id, min(test_path) AS test_path, min(test_name) AS test_name, sum(coalesce(duration, 0))::BIGINT AS duration, {_RES}, replace(min(tags), ',', ', ') AS tags FROM tl JOIN definitions d ON tl.definition_id = d.definition_id GROUP BY session_id, d.definition_id)", _FLAG)

# --- extractors, transformers, pipelines --------------------------------------------------------------------------
SINCE, UNTIL = "1996-06-30 11:00:00", "1998-06-30 15:30:00"


def _between(c: str) -> str:
    return f"{c} > TIMESTAMP '{SINCE}' AND {c} <= TIMESTAMP '{UNTIL}'"


_BOUND = tuple(datetime.fromisoformat(x) for x in (SINCE, UNTIL))


_FACT = ["app_id", "build_id", "method_id", "env_id", "branch", "session_id", "task_id", "definition_id", "result", "tag", "day", "probes"]
_FACT_SQL = "app_id, build_id, method_id, env_id, branch, session_id, task_id, definition_id, result, tag, day::VARCHAR AS day, probes::VARCHAR AS probes"
_add("e1_builds", lambda t: extract.builds(extract.Raw(t), *_BOUND).select("build_id", "branch", F.array_join("app_env_ids", ",").alias("envs"), F.col("updated_at").cast("string").alias("updated_at")),
     f"SELECT build_id, branch, (SELECT string_agg(DISTINCT env_id, ',' ORDER BY env_id) FROM instances i WHERE i.build_id = b.build_id) AS envs, greatest(updated_at, (SELECT max(created_at) FROM instances i WHERE i.build_id = b.build_id AND {_between('created_at')}))::VARCHAR AS updated_at FROM builds b WHERE {_between('updated_at')}")
_add("e2_build_methods", lambda t: extract.build_methods(extract.Raw(t), *_BOUND).select("build_id", "method_id", "signature"),
     f"SELECT build_id, b.method_id, signature FROM build_methods b JOIN methods m ON b.app_id = m.app_id AND b.method_id = m.method_id WHERE {_between('created_at')}")
_add("e3_coverage", lambda t: _text(extract.coverage(extract.Raw(t), *_BOUND).select(*_FACT), "day"), f"SELECT {_FACT_SQL} FROM f3 WHERE {_between('seen_at')}")
_add("e4_test_launch_coverage", lambda t: _text(extract.test_launch_coverage(extract.Raw(t)).select(*_FACT), "day"), f"SELECT {_FACT_SQL} FROM f4")
_add("e5_requested_coverage", lambda t: _text(extract.requested_coverage(extract.Raw(t)).select(*_FACT), "day"),
     f"SELECT {_FACT_SQL} FROM f4 WHERE EXISTS (SELECT 1 FROM requests q WHERE q.session_id = f4.session_id AND (q.definition_id = '' OR q.definition_id = f4.definition_id))")
_add("e6_test_launches", lambda t: extract.test_launches(extract.Raw(t), *_BOUND).select("launch_id", "definition_id", "session_id", "result", "duration", *views.FLAGS), f"SELECT launch_id, definition_id, session_id, result, duration, {', '.join(f'{c}::BIGINT AS {c}' for c in views.FLAGS)} FROM tl WHERE {_between('created_at')}", _FLAG)
_add("e7_test_definitions", lambda t: extract.test_definitions(extract.Raw(t)).select("definition_id", "test_path", "test_name", "test_runner", "tags"), "SELECT definition_id, test_path, test_name, test_runner, tags FROM definitions")
_add("e8_test_sessions", lambda t: _text(extract.test_sessions(extract.Raw(t), *_BOUND).select("session_id", "task_id", "started_day"), "started_day"), f"SELECT session_id, task_id, started_day::VARCHAR AS started_day FROM sessions WHERE {_between('created_at')}")
_add("e9_test_session_builds", lambda t: extract.test_session_builds(extract.Raw(t)).select("session_id", "app_id", "build_id"), "SELECT session_id, app_id, build_id FROM session_builds")

def _cov(df: DataFrame) -> DataFrame:
    """Probe vectors as strings of 60 bits for each word."""
    return df.select(*(c for c in df.columns if c not in ("group_id", "probes")), probes.to_bits(F.col("probes"), F.size("probes") * probes.WORD).alias("bits"))


_BITS = bits("bit_or(probes)")
for _name, _f, _t, _days in (
    ("p9_build_method_coverage", lambda t: transform.build_method_coverage(t["plain_facts"], WORDS), "SELECT app_id, build_id, method_id, env_id, result, tag, task_id, max(day)::VARCHAR AS created_at_day, " + _BITS + " AS bits FROM f3 GROUP BY app_id, build_id, method_id, env_id, result, tag, task_id", ("created_at_day",)),
    ("p14_build_method_coverage_from_launches", lambda t: transform.build_method_coverage(t["test_facts"], WORDS), "SELECT app_id, build_id, method_id, env_id, result, tag, task_id, max(day)::VARCHAR AS created_at_day, " + _BITS + " AS bits FROM f4 GROUP BY app_id, build_id, method_id, env_id, result, tag, task_id", ("created_at_day",)),
    ("p10_method_daily_coverage", lambda t: transform.method_daily_coverage(t["plain_facts"], WORDS), "SELECT app_id, method_id, day::VARCHAR AS day, branch, env_id, result, tag, task_id, " + _BITS + " AS bits FROM f3 GROUP BY app_id, method_id, f3.day, branch, env_id, result, tag, task_id", ("day",)),
    ("p15_method_daily_coverage_from_launches", lambda t: transform.method_daily_coverage(t["test_facts"], WORDS), "SELECT app_id, method_id, day::VARCHAR AS day, branch, env_id, result, tag, task_id, " + _BITS + " AS bits FROM f4 GROUP BY app_id, method_id, f4.day, branch, env_id, result, tag, task_id", ("day",)),
    ("p13_session_coverage_from_launches", lambda t: transform.session_coverage(t["test_facts"], WORDS), "SELECT app_id, build_id, method_id, session_id, env_id, result, tag, max(day)::VARCHAR AS created_at_day, " + _BITS + " AS bits FROM f4 GROUP BY app_id, build_id, method_id, session_id, env_id, result, tag", ("created_at_day",)),
    ("p8_session_coverage", lambda t: transform.session_coverage(t["plain_facts"], WORDS), "SELECT app_id, build_id, method_id, session_id, env_id, result, tag, max(day)::VARCHAR AS created_at_day, " + _BITS + " AS bits FROM f3 WHERE session_id IS NOT NULL GROUP BY app_id, build_id, method_id, session_id, env_id, result, tag", ("created_at_day",)),
    ("p12_definition_coverage", lambda t: transform.definition_coverage(t["test_facts"], WORDS), "SELECT app_id, build_id, method_id, session_id, definition_id, env_id, result, created_at_day::VARCHAR AS created_at_day, " + bits("probes") + " AS bits FROM bmdc", ("created_at_day",)),
):
    _add(_name, lambda t, f=_f, d=_days: _text(_cov(f(t)), *d), _t)
_add("p17_test_to_code_mapping", lambda t: _text(transform.test_to_code_mapping(t["test_facts"]).drop("group_id"), "updated_at_day"), "SELECT app_id, signature, definition_id, branch, env_id, task_id, updated_at_day::VARCHAR AS updated_at_day FROM mapping")
_add("p18_session_builds_from_launches", lambda t: transform.has_session(t["test_facts"]).select("app_id", "build_id", "session_id").distinct(), "SELECT DISTINCT app_id, build_id, session_id FROM f4")
_add("p11_session_builds_from_coverage", lambda t: transform.has_session(t["plain_facts"]).select("app_id", "build_id", "session_id").distinct(), "SELECT DISTINCT app_id, build_id, session_id FROM f3 WHERE session_id IS NOT NULL")
_add("t9_chain", lambda t: transform.chain(transform.has_session_and_definition, transform.passed_only, transform.keep("tag IS NOT NULL"), lambda df: df.groupBy("app_id", "definition_id", "tag").agg(F.count_distinct("method_id").alias("n")))(t["test_facts"]),
     "SELECT app_id, definition_id, tag, count(DISTINCT method_id) AS n FROM f4 WHERE result = 'PASSED' AND tag IS NOT NULL GROUP BY ALL")
_add("p3_methods", lambda t: transform.last_of(extract.build_methods(extract.Raw(t)).select("app_id", "method_id", "signature", "probes_count", "at"), ["app_id", "method_id"], "at").drop("at"), "SELECT DISTINCT m.app_id, m.method_id, signature, probes_count FROM build_methods b JOIN methods m ON b.app_id = m.app_id AND b.method_id = m.method_id")

# --- upserts ------------------------------------------------------------------------------------------------------
_KEYS = transform.BUILD_KEYS


def _halves(t) -> tuple[DataFrame, DataFrame]:
    out = []
    for old in (True, False):
        f = t["plain_facts"].unionByName(t["test_facts"]).filter((F.month("day") <= 6) == old)
        out.append(transform.build_method_coverage(f, WORDS).withColumnRenamed("created_at_day", "updated_at_day"))
    return out[0], out[1]


_OR_SQL = "SELECT app_id, build_id, method_id, env_id, result, tag, task_id, max(day)::VARCHAR AS updated_at_day, " + _BITS + " AS bits FROM f34 GROUP BY app_id, build_id, method_id, env_id, result, tag, task_id"
_K = "app_id, build_id, method_id, env_id, result, tag, task_id"
_SAME = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in _K.split(", "))
_add("u4_or_upsert", lambda t: _text(_cov(upsert.merged(*_halves(t), _KEYS, "or", width=WORDS)), "updated_at_day"),
     f"SELECT {', '.join(f'coalesce(a.{k}, b.{k}) AS {k}' for k in _K.split(', '))}, (CASE WHEN a.d IS NULL OR (b.d IS NOT NULL AND a.p | b.p <> a.p) THEN b.d ELSE a.d END)::VARCHAR AS updated_at_day, {bits('CASE WHEN a.p IS NULL THEN b.p WHEN b.p IS NULL THEN a.p ELSE a.p | b.p END')} AS bits FROM h1 a FULL JOIN h2 b ON {_SAME}",
     *((n, f"SELECT {_K}, bit_or(probes) AS p, max(day) AS d FROM f34 WHERE month(day) {c} 6 GROUP BY {_K}") for n, c in (("h1", "<="), ("h2", ">"))))
_add("u4_or_upsert_of_repeated_keys", lambda t: _text(_cov(upsert.merged(_halves(t)[0].limit(0), _halves(t)[0].unionByName(_halves(t)[1]), _KEYS, "or", width=WORDS)), "updated_at_day"), _OR_SQL)


def _mapping_halves(t):
    f = t["test_facts"]
    return tuple(transform.test_to_code_mapping(f.filter((F.month("day") <= 6) == old)) for old in (True, False))


_add("u6_forward_upsert", lambda t: _text(upsert.merged(*_mapping_halves(t), transform.MAPPING_KEYS, "forward").drop("group_id"), "updated_at_day"), "SELECT app_id, signature, definition_id, branch, env_id, task_id, updated_at_day::VARCHAR AS updated_at_day FROM mapping")
_first = lambda t: t["raw_build_methods"].filter("created_day < DATE '1998-01-01'").join(t["raw_methods"], ["group_id", "app_id", "method_id"]).select("group_id", "app_id", "method_id", F.lit("old").alias("batch")).distinct()
_later = lambda t: t["raw_methods"].select("group_id", "app_id", "method_id", F.lit("new").alias("batch"))
_OLD = "EXISTS (SELECT 1 FROM raw_build_methods b WHERE b.app_id = m.app_id AND b.method_id = m.method_id AND b.created_day < DATE '1998-01-01')"
_add("u2_keep_upsert", lambda t: upsert.merged(_first(t), _later(t), ["group_id", "app_id", "method_id"], "keep").drop("group_id"), f"SELECT app_id, method_id, CASE WHEN {_OLD} THEN 'old' ELSE 'new' END AS batch FROM raw_methods m")
_add("u3_replace_upsert", lambda t: upsert.merged(_later(t), _first(t), ["group_id", "app_id", "method_id"], "replace").drop("group_id"), f"SELECT app_id, method_id, CASE WHEN {_OLD} THEN 'old' ELSE 'new' END AS batch FROM raw_methods m")
_LAST = lambda t: t["launches"].select("group_id", F.col("definition_id").alias("id"), "launch_id", "result", F.struct("created_at", "launch_id").alias("at"))
_add("u3_replace_upsert_of_repeated_keys", lambda t: upsert.merged(_LAST(t).drop("at").limit(0), _LAST(t), ["group_id", "id"], "replace", order="at").drop("group_id"), "SELECT definition_id AS id, arg_max(launch_id, (created_at, launch_id)) AS launch_id, arg_max(result, (created_at, launch_id)) AS result FROM launches GROUP BY definition_id")
_add("u7_delete_by_group", lambda t: upsert.without_keys(t["raw_methods"], t["rules"].select("group_id", "app_id").filter("app_id = 'app-1'"), ["group_id", "app_id"]).select("app_id", "method_id"), "SELECT app_id, method_id FROM raw_methods WHERE app_id <> 'app-1'")

# --- reports ------------------------------------------------------------------------------------------------------
_add("r1_applications", report.applications, "SELECT DISTINCT group_id, app_id FROM builds")
_add("r2_builds", lambda t: report.page(report.builds(t, branch="main", env_ids=["A"]).orderBy(*report.version_order(), "build_id"), 1, 5).select("build_id", "build_version"),
     "SELECT build_id, build_version FROM builds b WHERE branch = 'main' AND EXISTS (SELECT 1 FROM instances i WHERE i.build_id = b.build_id AND env_id = 'A') ORDER BY split_part(build_version, '.', 1), split_part(build_version, '.', 2), split_part(build_version, '.', 3), build_id LIMIT 5")
_FILTERS = (("none", {}, "true"), ("branch", {"branch": "dev"}, "branch = 'dev'"), ("commit", {"commit": "c1997"}, "commit_sha = 'c1997'"), ("app and version", {"app": "app-1", "version": "1998.3.0"}, "app_id = 'app-1' AND build_version = '1998.3.0'"), ("environment", {"env_ids": ["R"]}, "EXISTS (SELECT 1 FROM instances i WHERE i.build_id = b.build_id AND env_id = 'R')"))
_add("r17_optional_filters", lambda t: functools.reduce(DataFrame.unionByName, [report.builds(t, **f).select(F.lit(n).alias("given"), "build_id") for n, f, _ in _FILTERS]), " UNION ALL ".join(f"SELECT '{n}' AS given, build_id FROM builds b WHERE {q}" for n, _, q in _FILTERS))
_add("r3_builds_count", lambda t: report.builds(t, branch="main", env_ids=["A"]).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM builds b WHERE branch = 'main' AND EXISTS (SELECT 1 FROM instances i WHERE i.build_id = b.build_id AND env_id = 'A')")
_add("r4_build_exists", lambda t: report.build_exists(t, BUILD), f"SELECT build_id FROM builds WHERE build_id = '{BUILD}'")
_add("r5_coverage_page", lambda t: report.page(coverage.methods_with_coverage(t, [BUILD]).select("signature", "isolated_covered", "aggregated_covered").orderBy("signature"), 2, 50), "SELECT signature, isolated_covered, aggregated_covered FROM f2 ORDER BY signature LIMIT 50 OFFSET 50", *_f2(f"'{BUILD}'"))
for _n, _r, _page in (("session", "r6", lambda t: report.coverage_by_session(t, BUILD, SESSION, 1, 200)), ("definition", "r7", lambda t: report.coverage_by_definition(t, BUILD, DEFINITION, None, 1, 200))):
    _src, _if = ("bmsc", f"session_id = '{SESSION}'") if _n == "session" else ("bmdc", f"definition_id = '{DEFINITION}'")
    _add(f"{_r}_coverage_by_{_n}_page", _page, "SELECT build_id, signature, method_id, class_name, method_name, probes_count, " + ", ".join(f"c AS {k}_covered, probes_count - c AS {k}_missed, c::DOUBLE / probes_count AS {k}_ratio" for k in ("isolated", "aggregated")) + " FROM m ORDER BY signature, method_id LIMIT 200",
         _f2(f"'{BUILD}'")[0], ("own", f"SELECT method_id, bit_or(probes) AS p FROM {_src} WHERE build_id = '{BUILD}' AND {_if} GROUP BY ALL"), ("m", "SELECT base.*, coalesce(bit_count(p), 0)::BIGINT AS c FROM base LEFT JOIN own ON base.method_id = own.method_id"))
_add("r9_methods_count", lambda t: report.methods_count(t, BUILD), f"SELECT count(*) AS n FROM build_methods WHERE build_id = '{BUILD}'")
_add("f11_methods_of_a_definition", lambda t: coverage.methods_by(t, "definition_coverage", BUILD, definition=DEFINITION).select("signature", "definition_id", "covered", "missed"),
     "SELECT signature, definition_id, coalesce(bit_count(p), 0)::BIGINT AS covered, probes_count - coalesce(bit_count(p), 0)::BIGINT AS missed FROM base LEFT JOIN own ON base.method_id = own.method_id", _f2(f"'{BUILD}'")[0], ("own", f"SELECT method_id, definition_id, bit_or(probes) AS p FROM bmdc WHERE build_id = '{BUILD}' AND definition_id = '{DEFINITION}' GROUP BY ALL"))
_add("r8_changes_page", lambda t: report.page(coverage.changes_with_coverage(t, BUILD, BASE).select("signature", "change", "aggregated_covered").orderBy("signature"), 1, 100), "SELECT ch.signature, change, aggregated_covered FROM ch LEFT JOIN f2 ON ch.signature = f2.signature WHERE change IN ('new', 'modified') ORDER BY ch.signature LIMIT 100", _CHANGES, *_f2(f"'{BUILD}'", BASE))
_add("r10_changes_count", lambda t: coverage.changes(t, BUILD, BASE, include_deleted=True).groupBy("change").agg(F.count("*").alias("n")), "SELECT change, count(*) AS n FROM ch WHERE change <> 'equal' GROUP BY change", _CHANGES)
_add("r11_build_diff_report", lambda t: report.build_diff_report(t, BUILD, BASE),
     f"""SELECT (SELECT count(*) FROM ch WHERE change = 'new') AS new_methods, (SELECT count(*) FROM ch WHERE change = 'modified') AS modified_methods, (SELECT count(*) FROM ch WHERE change = 'deleted') AS deleted_methods,
     (SELECT count(*) FROM ch JOIN g2 ON ch.signature = g2.signature WHERE change = 'new' AND g2.aggregated_covered > 0) AS tested_new, (SELECT count(*) FROM ch JOIN g2 ON ch.signature = g2.signature WHERE change = 'modified' AND g2.aggregated_covered > 0) AS tested_modified,
     (SELECT sum(isolated_covered)::DOUBLE / sum(probes_count) FROM f2) AS isolated_ratio, (SELECT sum(aggregated_covered)::DOUBLE / sum(probes_count) FROM f2) AS aggregated_ratio,
     (SELECT count(*) FROM imp WHERE status = 'IMPACTED') AS impacted_tests, (SELECT count(*) FROM ir WHERE r = 'PASSED') AS passed_impacted, (SELECT count(*) FROM ir WHERE r = 'FAILED') AS failed_impacted""",
     _CHANGES, _MAP, _IMP, *_f2(f"'{BUILD}'", BASE), *((n.replace("own", "gown").replace("anyc", "gany").replace("base", "gbase").replace("f2", "g2"), q.replace("own.", "gown.").replace("FROM base LEFT JOIN own", "FROM gbase LEFT JOIN gown").replace("LEFT JOIN anyc", "LEFT JOIN gany").replace("anyc.", "gany.").replace("base.", "gbase.")) for n, q in _f2(f"'{BUILD}'", BASE, "AND d.result IN ('PASSED')")),
     ("ir", f"SELECT imp.definition_id, min(result) AS r FROM imp JOIN launches l ON imp.definition_id = l.definition_id WHERE status = 'IMPACTED' AND result IN ('PASSED', 'FAILED') AND session_id IN (SELECT session_id FROM session_builds WHERE build_id = '{BUILD}') GROUP BY imp.definition_id"))
_add("r12_impacted_tests_page", lambda t: report.page(report.ordered(impact.impacted_tests(t, BUILD, BASE).select("definition_id", "impacted_methods"), [("impacted_methods", True), ("definition_id", False)], ["impacted_methods", "definition_id"]), 1, 20), "SELECT definition_id, impacted_methods FROM imp WHERE status = 'IMPACTED' ORDER BY impacted_methods DESC, definition_id LIMIT 20", _CHANGES, _MAP, _IMP)
_add("r13_impacted_methods_page", lambda t: report.page(report.ordered(impact.impacted_methods(t, BUILD, BASE).select("signature", "impacted_tests"), [("impacted_tests", True), ("signature", False)], ["impacted_tests", "signature"]), 1, 20),
     "SELECT ch.signature, count(DISTINCT definition_id) AS impacted_tests FROM ch JOIN mp ON ch.signature = mp.signature WHERE change <> 'equal' GROUP BY ch.signature ORDER BY impacted_tests DESC, ch.signature LIMIT 20", _CHANGES, _MAP)

# --- jobs ---------------------------------------------------------------------------------------------------------
for _name, (_job, _query) in jobs.registered().items():
    _add(_name, _job, _query)

# treemaps: a recursive query is the oracle
_TREE = (
    ("leaf", "SELECT string_split(class_name, '/') AS dirs, method_name || '(' || trim(method_params, '()') || ') -> ' || return_type AS leaf, probes_count AS n, aggregated_covered AS c FROM f2"),
    ("nodes", """SELECT array_to_string(list_append(dirs, leaf)[1:i], '/') AS path, CASE WHEN i > 1 THEN array_to_string(list_append(dirs, leaf)[1:i - 1], '/') END AS up, list_append(dirs, leaf)[i] AS last, i > len(dirs) AS is_leaf, n, c
      FROM (SELECT *, unnest(range(1, len(dirs) + 2)) AS i FROM leaf)"""),
    ("tab", "SELECT path, up, last, is_leaf, sum(n)::BIGINT AS n, sum(c)::BIGINT AS c FROM nodes GROUP BY path, up, last, is_leaf"),
    ("kid", "SELECT up AS path, count(*) AS kids, bool_or(is_leaf) AS has_leaf FROM tab WHERE up IS NOT NULL GROUP BY up"),
    ("mk", "SELECT tab.*, (tab.up IS NOT NULL AND p.kids = 1 AND NOT coalesce(k.has_leaf, false)) AS merges FROM tab LEFT JOIN kid p ON tab.up = p.path LEFT JOIN kid k ON tab.path = k.path"),
)
_TREE_SQL = """SELECT name, path AS full_name, parent, CASE WHEN is_leaf THEN 'method' ELSE 'node' END AS type, n AS probes_count, c AS covered_probes, c::DOUBLE / n AS coverage_ratio
     FROM ch2 WHERE NOT EXISTS (SELECT 1 FROM mk x WHERE x.up = ch2.path AND x.merges)"""
_WALK = ("ch2", """
       SELECT * FROM (WITH RECURSIVE walk AS (
         SELECT path, last AS name, up AS parent, is_leaf, n, c FROM mk WHERE NOT merges
         UNION ALL
         SELECT m.path, w.name || '/' || m.last, w.parent, m.is_leaf, m.n, m.c FROM mk m JOIN walk w ON m.up = w.path WHERE m.merges
       ) SELECT * FROM walk)""")  # fmt: skip
_add("r14_treemap", lambda t: treemap.treemap(coverage.methods_with_coverage(t, [BUILD]), covered="aggregated_covered"), _TREE_SQL, *_f2(f"'{BUILD}'"), *_TREE, _WALK)
_LEAF15 = ("f15", "SELECT any_value(class_name) AS class_name, any_value(method_name) AS method_name, any_value(method_params) AS method_params, any_value(return_type) AS return_type, probes_count, aggregated_covered, signature FROM (SELECT ch.signature, m.class_name, m.method_name, m.method_params, m.return_type, coalesce(max(CASE WHEN b.build_id = '" + BUILD + "' THEN m.probes_count END), max(m.probes_count)) AS probes_count, coalesce(max(f2.isolated_covered), 0) AS aggregated_covered FROM ch JOIN methods m ON m.signature = ch.signature JOIN build_methods b ON b.method_id = m.method_id AND b.app_id = m.app_id LEFT JOIN f2 ON f2.signature = ch.signature WHERE change <> 'equal' AND b.build_id IN (" + _PAIR + ") GROUP BY ALL) GROUP BY signature, probes_count, aggregated_covered")
_add("r15_changes_treemap", lambda t: treemap.treemap(coverage.changes_with_coverage(t, BUILD, BASE, include_deleted=True), covered="isolated_covered"),
     _TREE_SQL, _CHANGES, *_f2(f"'{BUILD}'", BASE), _LEAF15, *((n, q.replace("FROM f2", "FROM f15")) for n, q in _TREE), _WALK)

# --- ingest and streams -------------------------------------------------------------------------------------------
for _name, (_job, _query, *_more) in (ingest_queries.REGISTERED | etl_queries.REGISTERED).items():
    _add(_name, _job, _query, *_more)
_add("s9_daily_coverage_stream", lambda t: _text(_cov(ingest_queries.daily_coverage_stream(t).withColumn("group_id", F.lit("g1"))), "day"), "SELECT app_id, method_id, day::VARCHAR AS day, branch, env_id, result, tag, task_id, " + _BITS + " AS bits FROM f3 GROUP BY app_id, method_id, f3.day, branch, env_id, result, tag, task_id")
_add("e2e_records_to_methods_with_coverage", lambda t: end_to_end.methods_with_coverage(t, BUILD).select(*_F2_COLS), _F2, *_f2(f"'{BUILD}'"))
_add("e2e_records_to_impact_of_all_tests", lambda t: end_to_end.impacted_tests(t, BUILD, BASE).select("definition_id", "test_path", "test_name", "impacted_methods", "status"), "SELECT * FROM imp", _CHANGES, _MAP, _IMP)
_add("e2e_refreshed_pipelines", end_to_end.refreshed, f"SELECT unnest([{', '.join(repr(p) for p in end_to_end.SCHEDULED)}]) AS pipeline, 'SUCCESS' AS status, '{etl_queries.END}' AS until")
_Q["i2_quarantine"] = (ingest_queries.quarantine, ingest_queries.QUARANTINE_SQL)
_Q["s9_daily_stream"] = (ingest_queries.daily_stream, ingest_queries.DAILY_SQL)


def queries() -> dict:
    return {k: f for k, (f, _) in _Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _Q.items() if s}
