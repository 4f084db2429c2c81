"""Quality rules: a threshold table compiled into one projection.

Counts (words are runs without ASCII white space; null text has none): n_words, word_chars (code points in words),
n_symbols (characters of ``#*$%&|<>``), n_dup_lines (lines with a word that equal an earlier line), n_repeat_words (words
in 5-word windows that occur at least twice in the text), n_lines (lines with a word), n_stop_words (words that are in
``STOP_WORDS`` as they stand).  Windows are compared by a 64-bit hash of their words.
Each row of ``THRESHOLDS`` bounds one ratio of these counts; a document is kept if no base rule and no threshold fails.
The stop words' share is smoothed by one word, so the same rule holds at every length: a short text without any passes.

No user function, no shuffle: one scan.  Null and empty texts have no words and fail the base rule.  Very long texts are
counted whole.  Any other column may be null, repeated rows are judged alike, and there are no ties.  Input columns named
like an added column are replaced by it.  An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, free_name, table, without, words

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "are", "with", "as", "be", "by", "an",
    "der", "die", "das", "und", "ein", "eine", "den", "von", "zu", "mit", "sich", "auf", "für", "nicht", "des", "im",
    "le", "la", "les", "de", "des", "et", "en", "un", "une", "du", "que", "pour", "dans", "est", "par", "qui", "sur",
    "el", "los", "las", "del", "y", "con", "por", "para", "una", "su", "al", "no", "se", "lo",
)

#: (rule, numerator, denominator, least, most); None is no bound, and a ratio over nothing passes.
THRESHOLDS = (
    ("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    ("symbols_per_word", "n_symbols", "n_words", None, 0.25),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    ("stop_words", "n_stop_words + 1", "n_words", 0.02, None),
    ("words_per_line", "n_words", "n_lines", 1.5, None),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def _repeat_words(w: Column, h: Column) -> Column:
    """Words covered by windows (hashes ``h`` by start) that occur twice or more."""
    pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
    twice = lambda s: F.transform(
        F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])), lambda x: x["p"])
    # transform over a one-element array binds a value once, so that the sort isn't repeated for each element
    starts = F.get(F.transform(F.array(F.array_sort(pairs)), lambda s: F.array_sort(twice(s))), F.lit(0))
    cover = lambda p: F.aggregate(
        F.sequence(F.lit(1), F.size(p) - 1), F.lit(5), lambda acc, i: acc + F.least(F.lit(5), F.get(p, i) - F.get(p, i - 1)))
    count = F.get(F.transform(F.array(starts), lambda p: F.when(F.size(p) > 1, cover(p)).otherwise(0)), F.lit(0))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(count)


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` and the columns of COUNTS (long)."""
    docs = without(docs, *COUNTS)
    w, l, h, found = (free_name(docs, x) for x in ("_w", "_l", "_h", "_c"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    a = docs.withColumns({w: words(F.col(text_col)), l: F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WS)) != "")})
    window = lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(5)))
    b = a.withColumn(h, F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(0), F.size(w) - 5), window)).otherwise(F.array().cast("array<bigint>")))
    out = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", "")),
        "n_dup_lines": F.size(l) - F.size(F.array_distinct(l)),
        "n_repeat_words": _repeat_words(F.col(w), F.col(h)),
        "n_lines": F.size(l),
        "n_stop_words": F.size(F.filter(w, lambda x: x.isin(*dict.fromkeys(STOP_WORDS)))),
    }
    # exploding one struct keeps later filters above the counts: pushed below, they would repeat every expression
    counted = F.explode(F.array(F.struct(*(v.cast("long").alias(k) for k, v in out.items()))))
    names = [F.col(f"`{c}`") for c in docs.columns]
    return b.select(*names, counted.alias(found)).select(*names, f"{found}.*")


def compile_rules(thresholds=THRESHOLDS) -> dict[str, Column]:
    """A Boolean column for each threshold: true where it fails."""
    out = {}
    for name, over, under, least, most in thresholds:
        ratio = F.try_divide(F.expr(over).cast("double"), F.expr(under).cast("double"))
        bad = [*([ratio < least] if least is not None else []), *([ratio > most] if most is not None else [])]
        out[name] = F.coalesce(reduce(lambda x, y: x | y, bad), F.lit(False))
    return out


BASE = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def judge(docs: DataFrame, text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """``docs`` with COUNTS, base_failed, failed_rules (comma-joined names) and kept."""
    c = with_counts(without(docs, "base_failed", "failed_rules", "kept"), text_col)
    rules = compile_rules(thresholds)
    failed = F.concat_ws(",", *(F.when(v, F.lit(k)) for k, v in rules.items()))
    return c.withColumns({"base_failed": F.expr(BASE), "failed_rules": failed}).withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def op6_quality_rules(spark, sf_dir):
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *COUNTS, "base_failed", "failed_rules", "kept")


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT r, i, w[i:i+4] AS win FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (
    SELECT r, unnest(range(i, i + 5)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS k FROM g) WHERE k > 1
  ) GROUP BY r
), c AS (
  SELECT d.r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines,
         len(list_filter(w, lambda x: list_contains([{", ".join("'" + x + "'" for x in dict.fromkeys(STOP_WORDS))}], x))) AS n_stop_words
  FROM d LEFT JOIN rep USING (r)
), f AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, concat_ws(',',
    {", ".join("CASE WHEN " + " OR ".join([*([f"{a} / {b} < {lo}"] if lo is not None else []), *([f"{a} / {b} > {hi}"] if hi is not None else [])]) + f" THEN '{n}' END" for n, a0, b0, lo, hi in THRESHOLDS for a, b in [(f"({a0})::DOUBLE", f"nullif({b0}, 0)")])}) AS failed_rules
  FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, base_failed, failed_rules,
       (NOT base_failed AND failed_rules = '') AS kept
FROM f
"""
