"""Secret scan with corpus-wide ownership frequency, in Spark expressions only.

Base spans: each kind is a pattern whose matches, leftmost and not overlapping, alternate with the pieces that ``split``
leaves, so running lengths of both give the places; matches whose value is too short are dropped.  Running totals double
their reach in each step, so a text with n matches costs n log n.

Reuse: values travel.  Every run of a value's characters outside the base spans, of ``LEAST`` or more, is a candidate: the
run, its parts between ``=`` and ``/``, and what follows its first ``=``; dots that end a sentence don't count.  Candidates
whose SHA-256 equals that of a base value somewhere in the corpus are spans of kind ``reuse``.

Ownership: base and reused occurrences of a value are counted by distinct owners and repositories, in two aggregation
levels, so a value in a hot repository is combined before the shuffle.  A value of ``SHARED_OWNERS`` owners or
``SHARED_REPOS`` repositories is a widely copied example (``shared``); else it is ``live`` if it looks like a credential and
``placeholder`` if not.  Each span carries its value's verdict.

Values never leave the scan: what is written and shuffled are places, hashes and whether a value looks real.

Null or empty text has no spans.  Rows are told apart by a number of their own, so rows that repeat an id have their own
spans.  Rows with a null id count for owners and repositories, not for documents.  Null owners or repositories are one
name.  Very long texts are scanned whole.  Ties don't arise: spans sort by start, kind and end.  Of the input's columns
the id alone is returned, so no name can clash.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, running, table

#: (kind, pattern, group of the value, least length of the value); fixed values
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
REUSE, LEAST = "reuse", 12
#: Runs of a value's characters, and such runs between = and /.
RUNS = (r"[A-Za-z0-9+/_.=-]{12,}", r"[A-Za-z0-9+_.-]{12,}")
PLACEHOLDER = "(?i)example|sample|changeme|placeholder|your|xxxx|0000|1234"
SHARED_OWNERS, SHARED_REPOS, DISTINCT_CHARS = 2, 3, 8

PLACE = "array<struct<start:int,end:int,v:string>>"


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """(start, end, v) of all matches, v the group's text; positions in code points, end exclusive."""
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    values = F.regexp_extract_all(text, p, F.lit(group)) if group else F.array().cast("array<string>")
    found = F.struct(whole.alias("m"), values.alias("v"), F.split(text, pattern, -1).alias("g"))

    def places(x: Column) -> Column:
        sizes = F.transform(x["m"], lambda m, i: F.length(m) + F.length(F.get(x["g"], i)))
        one = lambda ends: F.transform(x["m"], lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), (F.get(x["v"], i) if group else m).alias("v")))
        return let(let(sizes, lambda s: running(s, lambda a, b: a + b)), one)

    return F.when(text.rlike(pattern), let(found, places)).otherwise(F.array().cast(PLACE))


def identity(value: Column) -> Column:
    """SHA-256 of a value, without dots at its end if enough is left."""
    bare = F.rtrim(value, F.lit("."))
    return F.sha2(F.when(F.length(bare) >= LEAST, bare).otherwise(value), 256)


def _of_kind(n: int, kind: str) -> Callable[[Column], Column]:
    real = lambda v: (F.size(F.array_distinct(F.split(v, ""))) >= DISTINCT_CHARS) & ~v.rlike(PLACEHOLDER)
    return lambda x: F.struct(x["start"].alias("start"), F.lit(n).alias("n"), x["end"].alias("end"), F.lit(kind).alias("kind"), identity(x["v"]).alias("h"), real(x["v"]).alias("looks"))


def _long(least: int) -> Callable[[Column], Column]:
    return lambda x: F.length(x["v"]) >= least


def _base(text: Column) -> Column:
    """All base spans, sorted: (start, n, end, kind, h, looks)."""
    return F.array_sort(F.concat(*(F.transform(F.filter(_matches(text, pattern, group), _long(least)), _of_kind(n, kind)) for n, (kind, pattern, group, least) in enumerate(KINDS))))


def _candidates(text: Column) -> Column:
    """(start, end, h) of all runs and parts that a value elsewhere may equal."""

    def ended(x: Column) -> Column:
        value = F.rtrim(x["v"], F.lit("."))
        return F.struct(x["start"].alias("start"), (x["start"] + F.length(value)).alias("end"), value.alias("v"))

    def after_sign(x: Column) -> Column:
        at = F.instr(x["v"], "=")
        return F.struct((x["start"] + at).alias("start"), x["end"].alias("end"), F.substr(x["v"], at + 1).alias("v"))

    def parts(runs: Column) -> Column:
        signed = F.transform(F.filter(runs, lambda x: F.contains(x["v"], F.lit("="))), after_sign)
        inner = F.when(F.exists(runs, lambda x: x["v"].rlike("[=/]")), F.concat(_matches(text, RUNS[1]), signed)).otherwise(F.array().cast(PLACE))
        long = F.filter(F.transform(F.concat(runs, inner), ended), _long(LEAST))
        hashed = F.array_sort(F.transform(long, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.sha2(x["v"], 256).alias("h"))))
        # equal neighbours instead of array_distinct, which compares every pair of structs
        return let(hashed, lambda s: F.filter(s, lambda x, i: (i == 0) | (x != F.get(s, i - 1))))

    return let(_matches(text, RUNS[0]), parts)


def _outside(base: Column, found: Column) -> Column:
    """Of ``found`` (start, end, h), those that no base span overlaps."""
    event = lambda x, is_base: F.struct(x["start"].alias("start"), F.lit(is_base).alias("b"), x["end"].alias("end"), (F.lit(None).cast("string") if is_base else x["h"]).alias("h"))
    events = F.array_sort(F.concat(F.transform(base, lambda x: event(x, True)), F.transform(found, lambda x: event(x, False))))

    def kept(e: Column) -> Column:
        ends = running(F.transform(e, lambda x: F.when(x["b"], x["end"]).otherwise(-1)), lambda a, b: F.greatest(a, b))
        starts = F.reverse(running(F.reverse(F.transform(e, lambda x: F.when(x["b"], x["start"]).otherwise((1 << 31) - 1))), lambda a, b: F.least(a, b)))
        rows = let(F.struct(ends.alias("e"), starts.alias("s")), lambda t: F.transform(e, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["h"].alias("h"), (~x["b"] & (F.get(t["e"], i) <= x["start"]) & (F.get(t["s"], i) >= x["end"])).alias("ok"))))
        return F.transform(F.filter(rows, lambda x: x["ok"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["h"].alias("h")))

    return F.when(F.size(base) == 0, found).otherwise(let(events, kept))


def scan(docs: DataFrame, id_col: str, text_col: str, owner: Column, repository: Column) -> DataFrame:
    """(row, id, owner, repo, base, bare): base spans and candidates for reuse, without text or values."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), name(owner).alias("owner"), name(repository).alias("repo"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    both = F.struct(_base(F.col("t")).alias("base"), _candidates(F.col("t")).alias("bare"))
    s = rows.select("row", "id", "owner", "repo", F.explode(F.array(both)).alias("s"))
    return s.select("row", "id", "owner", "repo", "s.base", _outside(F.col("s.base"), F.col("s.bare")).alias("bare"))


def ownership(occurrences: DataFrame) -> DataFrame:
    """Per value hash of (id, owner, repo, h, looks): n_docs, n_repos, n_owners and verdict."""
    fine = occurrences.groupBy("h", "owner", "repo").agg(F.count_distinct("id").alias("n_docs"), F.max("looks").alias("looks"))
    out = fine.groupBy("h").agg(F.sum("n_docs").alias("n_docs"), F.count_distinct("owner", "repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"), F.max("looks").alias("looks"))
    wide = (F.col("n_owners") >= SHARED_OWNERS) | (F.col("n_repos") >= SHARED_REPOS)
    return out.withColumn("verdict", F.when(wide, "shared").when(F.col("looks"), "live").otherwise("placeholder")).drop("looks")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """(id, spans): a row for each row of ``docs``, with (start, n, end, kind, verdict, n_docs, n_repos, n_owners), sorted."""
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    scanned = materialize(scan(docs, id_col, text_col, owner, repository), "secrets")
    base = scanned.select("row", "id", "owner", "repo", F.explode("base").alias("s")).select("row", "id", "owner", "repo", "s.*")
    values = materialize(base.select("h").distinct(), "secret-values")
    bare = scanned.select("row", "id", "owner", "repo", F.explode("bare").alias("s")).select("row", "id", "owner", "repo", "s.*")
    reused = bare.join(values, "h").select("row", "id", "owner", "repo", "start", F.lit(len(KINDS)).alias("n"), "end", F.lit(REUSE).alias("kind"), "h", F.lit(False).alias("looks"))
    found = materialize(base.select(*reused.columns).unionByName(reused), "secret-spans")
    judged = found.join(materialize(ownership(found), "secret-owners"), "h")
    one = F.struct("start", "n", "end", "kind", "verdict", "n_docs", "n_repos", "n_owners")
    by_row = judged.groupBy(F.col("row").alias("_row")).agg(F.array_sort(F.collect_list(one)).alias("spans"))
    out = scanned.select("row", "id").join(by_row, F.col("row") == F.col("_row"), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("spans", F.array().cast(by_row.schema["spans"].dataType)).alias("spans"))


def op2_secrets(spark, sf_dir):
    s, found = F.col("spans"), find_secrets(table(spark, sf_dir, "documents"))
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter(s, lambda x: x["kind"] != REUSE)
    count = lambda field, value: F.size(F.filter(s, lambda x: x[field] == value)).cast("long")
    return found.select(
        "doc_id", *(count("kind", k[0]).alias(f"n_{k[0]}") for k in KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(s).alias("spans"),
        F.array_join(F.transform(s, lambda x: x["verdict"]), ",").alias("verdicts"), count("verdict", "live").alias("n_live"), count("verdict", "shared").alias("n_shared"))


def _sql_places(pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT r, doc_id, source, lang, v[i] AS v, length(m[i]) AS len,
         (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT r, doc_id, source, lang, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS g FROM d))
  WHERE length(v[i]) >= {least}"""


_CUT = "rtrim(v, '.')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS source, concat_ws('/', source, lang) AS lang, coalesce(text, '') AS t FROM documents),
base AS ({" UNION ALL ".join(f"SELECT *, '{k}' AS kind, {n} AS n, sha256(CASE WHEN length({_CUT}) >= {LEAST} THEN {_CUT} ELSE v END) AS h FROM ({_sql_places(p, g, lo)})" for n, (k, p, g, lo) in enumerate(KINDS))}),
looks AS (SELECT h, max((len(list_distinct(string_split(v, ''))) >= {DISTINCT_CHARS} AND NOT regexp_matches(v, '{PLACEHOLDER}'))::INT) AS looks FROM base GROUP BY h),
runs AS ({_sql_places(RUNS[0], 0, LEAST)}), parts AS ({_sql_places(RUNS[1], 0, LEAST)}),
cand AS (
  SELECT DISTINCT r, doc_id, source, lang, s, length({_CUT}) AS len, sha256({_CUT}) AS h FROM (
    SELECT r, doc_id, source, lang, s, v FROM runs UNION ALL SELECT r, doc_id, source, lang, s, v FROM parts
    UNION ALL SELECT r, doc_id, source, lang, s + strpos(v, '='), substr(v, strpos(v, '=') + 1) FROM runs WHERE contains(v, '='))
  WHERE length({_CUT}) >= {LEAST}
), every AS (
  SELECT r, doc_id, source, lang, s, len, kind, n, h FROM base
  UNION ALL SELECT r, doc_id, source, lang, s, len, '{REUSE}', {len(KINDS)}, h FROM cand b WHERE h IN (SELECT h FROM looks)
    AND NOT EXISTS (SELECT 1 FROM base x WHERE x.r = b.r AND x.s < b.s + b.len AND b.s < x.s + x.len)
), vals AS (
  SELECT h, CASE WHEN count(DISTINCT source) >= {SHARED_OWNERS} OR count(DISTINCT (source, lang)) >= {SHARED_REPOS} THEN 'shared' WHEN any_value(looks) = 1 THEN 'live' ELSE 'placeholder' END AS verdict
  FROM every JOIN looks USING (h) GROUP BY h
), a AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || s || ':' || (s + len), ',' ORDER BY s, n, len) FILTER (n < {len(KINDS)}) AS base,
         string_agg(kind || ':' || s || ':' || (s + len), ',' ORDER BY s, n, len) AS spans, string_agg(verdict, ',' ORDER BY s, n, len) AS verdicts,
         count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'shared') AS n_shared
  FROM every JOIN vals USING (h) GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(verdicts, '') AS verdicts, coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared
FROM d LEFT JOIN a USING (r)
"""
