"""Methods and builds with coverage, changes between builds, similar builds.

Coverage of a method counts in every build that holds the same method id: *isolated* coverage is that of the build
itself, *aggregated* coverage that of any build.  Both sides are OR-ed per (build, method) before the join, so their
fan-out never meets; filters go below the aggregation.  Probe counts are sums of popcounts, no vectors leave the plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelight.functions import probes
from probelight.functions.formats import among, parse_build_id, ratio, where_given

Tables = dict[str, DataFrame]
METHOD = ["group_id", "app_id", "method_id"]


def like(column: str, pattern: str | None) -> Column | None:
    return F.col(column).like(pattern) if pattern else None


def links(t: Tables) -> DataFrame:
    """Links of builds and methods for a join with ``methods``, which leaves ignored methods out: the raw ones unless others are given."""
    given = "build_methods" in t and "build_methods" not in getattr(t, "made", ())
    return t["build_methods"] if given or not has(t, "raw_build_methods") else t["raw_build_methods"]


def methods_of(t: Tables, builds: Sequence[str], package_like=None, class_like=None, name_like=None, signature_like=None) -> DataFrame:
    """Methods of builds, one row per (build, method)."""
    group, app, _ = parse_build_id(builds[0])
    bm = links(t).filter(F.col("build_id").isin(list(builds)) & (F.col("group_id") == group) & (F.col("app_id") == app)).select("build_id", *METHOD)
    m = where_given(t["methods"], like("class_name", package_like), like("class_name", class_like), like("method_name", name_like), like("signature", signature_like))
    return bm.join(m, METHOD)


def get_methods(t: Tables, build: str, package_like=None, class_like=None, name_like=None) -> DataFrame:
    return methods_of(t, [build], package_like, class_like, name_like)


def _covered(t: Tables, df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return probes.or_by(df.select(*keys, "probes"), keys, width=getattr(t, "width", None)).withColumnRenamed("probes", name)


def days_before(t: Tables, wanted: DataFrame, given: Sequence[Column | None], period_from=None, before_build: bool = True, group_app: tuple[str, str] | None = None, latest=None) -> DataFrame:
    """(build_id, method, probes): coverage of wanted (build, method, created_day) by any build, up to the build's day.

    ``group_app`` is the group and app of all wanted rows, ``latest`` their last day, if these are known; later days are
    left out before they are folded.

    With snapshots (``transform.coverage_snapshots``) a key's past is one row, that of the last month before the build's,
    and only the days of the build's own month are read beside it.  A period with a start needs the days themselves.
    """
    days = where_given(t["method_daily_coverage"], *given, F.col("day") >= F.lit(period_from) if period_from is not None else None)
    if one_app := group_app is not None:
        # both sides are of one group, so days that lie together by (app, method) stay where they are in the join
        days = days.filter((F.col("group_id") == group_app[0]) & (F.col("app_id") == group_app[1]))
    if not before_build:
        return days.select(*METHOD, "probes").join(wanted.drop("created_day"), METHOD)
    month = F.trunc("created_day", "month")
    if period_from is None and has(t, "coverage_snapshots"):
        past = where_given(t["coverage_snapshots"], *given).select(*METHOD, "month", "until", "probes")
        past = past.join(wanted.withColumn("_month", month), METHOD).filter("month < _month AND (until IS NULL OR until >= _month)")
        now = days.withColumn("_month", F.trunc("day", "month")).select(*METHOD, "_month", "day", "probes")
        now = now.join(wanted.withColumn("_month", month), [*METHOD, "_month"]).filter("day <= created_day")
        return past.select("build_id", *METHOD, "probes").unionByName(now.select("build_id", *METHOD, "probes"))
    if latest is not None:
        days = days.filter(F.col("day") <= F.lit(latest))
    near = days.select(*METHOD, "day", "probes").join(wanted.drop("group_id"), METHOD[1:]) if one_app else days.select(*METHOD, "day", "probes").join(wanted, METHOD)
    return near.filter("day <= created_day").select("build_id", *METHOD, "probes")


def has(t: Tables, name: str) -> bool:
    return name in t or name in getattr(t, "makers", ())


def methods_with_coverage(t: Tables, builds: Sequence[str], baseline: str | None = None, package_like=None, class_like=None, name_like=None, env_ids=None, branches=None, tags=None, task_ids=None, results=None, period_from=None, include_smart: bool = True, smart_before_build: bool = True) -> DataFrame:
    """Methods of ``builds`` (of which those new or modified against ``baseline``) with probe counts both ways."""
    if not builds:
        raise ValueError("a build is needed")
    base = methods_of(t, builds, package_like, class_like, name_like)
    if baseline:
        base = base.join(links(t).filter(F.col("build_id") == baseline).select(*METHOD), METHOD, "left_anti")
    given = [among("env_id", env_ids), among("tag", tags), among("task_id", task_ids), among("result", results)]
    since = lambda c: F.col(c) >= F.lit(period_from) if period_from is not None else None
    own = where_given(t["build_method_coverage"].filter(F.col("build_id").isin(list(builds))), *given, since("created_at_day"))
    out = base.join(_covered(t, own, ["build_id", *METHOD], "_own"), ["build_id", *METHOD], "left")
    if include_smart:
        days = t["builds"].select("build_id", "created_day")
        wanted = base.select("build_id", *METHOD).join(days, "build_id")
        latest = days.filter(F.col("build_id").isin(list(builds))).agg(F.max("created_day")).first()[0] if smart_before_build else None  # one row
        hit = days_before(t, wanted, [*given, among("branch", branches)], period_from, smart_before_build, parse_build_id(builds[0])[:2], latest)
        out = out.join(_covered(t, hit, ["build_id", *METHOD], "_any"), ["build_id", *METHOD], "left")
    else:
        out = out.withColumn("_any", F.lit(None).cast("array<bigint>"))
    n = F.col("probes_count")
    out = out.withColumns({"isolated_covered": probes.popcount(F.col("_own")), "aggregated_covered": probes.popcount(probes.merge(F.col("_own"), F.col("_any")))}).drop("_own", "_any")
    return out.withColumns({
        "isolated_missed": n - F.col("isolated_covered"), "aggregated_missed": n - F.col("aggregated_covered"),
        "isolated_ratio": ratio(F.col("isolated_covered"), n), "aggregated_ratio": ratio(F.col("aggregated_covered"), n)})


def _rollup(methods: DataFrame, keys: list[str], kinds: Sequence[str]) -> DataFrame:
    aggs = [F.sum("probes_count").alias("total_probes"), F.count("*").alias("total_methods")]
    for k in kinds:
        aggs += [F.sum(f"{k}_covered").alias(f"{k}_covered"), F.count_if(F.col(f"{k}_covered") > 0).alias(f"{k}_covered_methods")]
    out = methods.groupBy(*keys).agg(*aggs)
    return out.withColumns({x: v for k in kinds for x, v in ((f"{k}_missed", F.col("total_probes") - F.col(f"{k}_covered")), (f"{k}_ratio", ratio(F.col(f"{k}_covered"), F.col("total_probes"))))})


def builds_with_coverage(t: Tables, builds: Sequence[str], baseline: str | None = None, **filters) -> DataFrame:
    return _rollup(methods_with_coverage(t, builds, baseline, **filters), ["group_id", "app_id", "build_id"], ["isolated", "aggregated"])


def methods_by(t: Tables, table: str, build: str, session: str | None = None, definition: str | None = None, package_like=None, signature_like=None, env_ids=None, tags=None) -> DataFrame:
    """Methods of a build with the coverage of a test session (table session_coverage) or definition (definition_coverage)."""
    base = methods_of(t, [build], package_like=package_like, signature_like=signature_like)
    cov = t[table].filter(F.col("build_id") == build)
    cov = where_given(cov, F.col("session_id") == session if session else None, F.col("definition_id") == definition if definition else None, among("env_id", env_ids), among("tag", tags) if "tag" in cov.columns else None)
    keys = ["build_id", *METHOD, *(["session_id"] if session or table == "session_coverage" else []), *(["definition_id"] if table == "definition_coverage" else [])]
    out = base.join(_covered(t, cov, keys, "_own"), ["build_id", *METHOD], "left").withColumn("covered", probes.popcount(F.col("_own"))).drop("_own")
    return out.withColumns({"missed": F.col("probes_count") - F.col("covered"), "ratio": ratio(F.col("covered"), F.col("probes_count"))})


def builds_by(t: Tables, table: str, build: str, **filters) -> DataFrame:
    """The rollup of ``methods_by``; methods without coverage are in a row of their own, with a null session."""
    m = methods_by(t, table, build, **filters).withColumnRenamed("covered", "own_covered")
    keys = ["group_id", "app_id", "build_id", *(c for c in ("session_id", "definition_id") if c in m.columns)]
    return _rollup(m, keys, ["own"]).withColumnsRenamed({"own_covered": "covered", "own_covered_methods": "covered_methods", "own_missed": "missed", "own_ratio": "ratio"})


def changes(t: Tables, build: str, baseline: str | None, package_like=None, signature_like=None, exclude_signatures=None, class_name=None, signature=None, class_like=None, name_like=None, include_equal: bool = False, include_deleted: bool = False) -> DataFrame:
    """Signatures of two builds as new, modified, deleted or equal: one grouping of both builds' methods."""
    one = methods_of(t, [build, *([baseline] if baseline else [])])
    one = where_given(one, like("class_name", package_like), like("signature", signature_like), like("class_name", class_like), like("method_name", name_like), F.col("class_name") == class_name if class_name else None, F.col("signature") == signature if signature else None, ~F.col("signature").isin(list(exclude_signatures)) if exclude_signatures else None)
    target = F.col("build_id") == build
    of = lambda c: F.coalesce(F.max(F.when(target, F.col(c))), F.max(c)).alias(c)
    g = one.groupBy("group_id", "app_id", "signature").agg(F.count_distinct("method_id").alias("_ids"), F.count("*").alias("_rows"), F.max(target).alias("_target"), of("class_name"), of("method_name"), of("method_params"), of("return_type"), of("probes_count"))
    kind = F.when(F.col("_ids") > 1, "modified").when(F.col("_rows") > 1, "equal").when(F.col("_target"), "new").otherwise("deleted")
    out = g.withColumn("change", kind).drop("_ids", "_rows", "_target")
    gone = [k for k, w in (("equal", include_equal), ("deleted", include_deleted)) if not w]
    return out.filter(~F.col("change").isin(gone)) if gone else out


def changes_with_coverage(t: Tables, build: str, baseline: str | None, include_equal: bool = False, include_deleted: bool = False, package_like=None, class_like=None, name_like=None, **filters) -> DataFrame:
    """Changes with coverage; equal and deleted methods have none (null), as they aren't in the build against its baseline."""
    c = changes(t, build, baseline, package_like=package_like, class_like=class_like, name_like=name_like, include_equal=include_equal, include_deleted=include_deleted)
    cov = methods_with_coverage(t, [build], baseline, package_like, class_like, name_like, **filters)
    return c.join(cov.select("signature", *(x for x in cov.columns if x.startswith(("isolated", "aggregated")))), "signature", "left")


def similar_builds(t: Tables, build: str, branches=None) -> DataFrame:
    """Other builds of the app by the share of this build's methods that they hold unchanged."""
    group, app, _ = parse_build_id(build)
    bm = t["build_methods"].filter((F.col("group_id") == group) & (F.col("app_id") == app))
    mine = bm.filter(F.col("build_id") == build).select("method_id").distinct()
    total = mine.agg(F.count("*").alias("total_methods"))  # one row
    others = where_given(t["builds"].filter(F.col("build_id") != build), among("branch", branches)).select("build_id", "branch")
    shared = bm.join(mine, "method_id", "left_semi").groupBy("build_id").agg(F.count_distinct("method_id").alias("shared_methods"))
    return shared.join(others, "build_id").crossJoin(F.broadcast(total)).withColumn("identity_ratio", ratio(F.col("shared_methods"), F.col("total_methods")))
