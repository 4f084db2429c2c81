"""Probe vectors: '0101...' strings at the edges, arrays of 60-bit words inside.

Sixty bits keep clear of the sign bit.  OR is an ordinary ``bit_or`` aggregate by (key, word), so Spark combines rows
before the shuffle and no user function is needed; a popcount is ``sum(bit_count(word))``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = 60
#: Class vectors are cut at multiples of this, each piece twice as long, so a method of up to so many probes is in one piece.
BLOCK = 4096


def to_words(bits: Column) -> Column:
    """'0101...' to array<bigint>; null stays null, the empty string is no words."""
    return F.when(F.length(bits) > 0, F.transform(F.sequence(F.lit(0), F.ceil(F.length(bits) / WORD).cast("int") - 1), lambda i: F.conv(F.substr(bits, i * WORD + 1, F.lit(WORD)), 2, 10).cast("bigint"))).when(bits.isNotNull(), F.array().cast("array<bigint>"))


def to_bits(words: Column, n: Column) -> Column:
    """The string of ``n`` bits."""
    width = lambda i: F.least(F.lit(WORD), n.cast("int") - i * WORD)
    return F.array_join(F.transform(words, lambda w, i: F.lpad(F.conv(w.cast("string"), 10, 2), width(i), F.lit("0"))), "")


def popcount(words: Column) -> Column:
    """Set bits; null counts as none."""
    return F.coalesce(F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.bit_count(w)), F.lit(0).cast("long"))


def merge(a: Column, b: Column) -> Column:
    """Bitwise OR of two vectors; a null side gives the other."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0).cast("long")).bitwiseOR(F.coalesce(y, F.lit(0).cast("long")))))


def or_vector(words: Column, width: int) -> Column:
    """The aggregate of ``or_by`` at a known width: the OR of a group's vectors, null if it has none."""
    word = [F.bit_or(F.get(words, F.lit(k))) for k in range(width)]
    size = F.max(F.when(F.size(words) > width, F.raise_error(F.lit(f"a vector has more than {width} words")).cast("int")).otherwise(F.size(words)))
    return F.when(size.isNotNull(), F.slice(F.array(*word), F.lit(1), size))


def or_by(df: DataFrame, keys: list[str], words: str = "probes", width: int | None = None, **aggs: Column) -> DataFrame:
    """One row for each key (nulls group together): the OR of ``words`` and further aggregates.

    With ``width``, the most words that a vector has, all are combined in one aggregation with one shuffle; a longer
    vector is an error.  Without it words are grouped by place first.  Vectors of one key must be equally long;
    ``checked_or_by`` makes that an error.
    """
    if width is not None:
        return df.groupBy(*keys).agg(or_vector(F.col(words), width).alias(words), *(v.alias(k) for k, v in aggs.items()))
    parts = df.select(*keys, F.posexplode_outer(words).alias("_i", "_w"), *[c for c in df.columns if c not in keys and c != words])
    extra = {f"_{k}": v for k, v in aggs.items()}
    by_word = parts.groupBy(*keys, "_i").agg(F.bit_or("_w").alias("_w"), *(v.alias(k) for k, v in extra.items()))
    pair = F.when(F.col("_i").isNotNull(), F.struct("_i", "_w"))
    vector = F.transform(F.array_sort(F.collect_list(pair)), lambda s: s["_w"])
    outer = [F.max(f"_{k}").alias(k) for k in aggs]
    return by_word.groupBy(*keys).agg(F.when(F.count("_i") > 0, vector).alias(words), *outer)


def running_or(df: DataFrame, keys: list[str], order: str, words: str = "probes", width: int | None = None) -> DataFrame:
    """The rows with ``words`` OR-ed with those of all earlier rows of their key; one row for each key and ``order``.

    With ``width``, the most words that a vector has, rows that lie together by key stay where they are.
    """
    if width is not None:
        so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        word = [F.bit_or(F.get(words, k)).over(so_far) for k in range(width)]
        return df.filter(F.size(words) > 0).withColumn(words, F.slice(F.array(*word), F.lit(1), F.size(words)))
    w = Window.partitionBy(*keys, "_i").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rest = [c for c in df.columns if c not in (*keys, order, words)]
    parts = df.select(*keys, order, *rest, F.posexplode(words).alias("_i", "_w")).withColumn("_w", F.bit_or("_w").over(w))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_w"))), lambda x: x["_w"])
    return parts.groupBy(*keys, order).agg(vector.alias(words), *(F.first(c).alias(c) for c in rest)).select(df.columns)


def checked_or_by(df: DataFrame, keys: list[str], n: str, words: str = "probes", width: int | None = None, **aggs: Column) -> DataFrame:
    """As ``or_by``, but null vectors or unequal lengths (column ``n``) under one key raise an error."""
    null = F.col("_null")
    out = or_by(df.withColumns({"_len": F.col(n).cast("long"), "_null": F.col(words).isNull().cast("long")}), keys, words, width, low=F.min("_len"), high=F.max("_len"), nulls=F.max(null), **aggs)
    bad = (F.col("low") != F.col("high")) | (F.col("nulls") > 0)
    return out.withColumn(words, F.when(bad, F.raise_error(F.lit("probes of one key are null or of unequal length"))).otherwise(F.col(words))).drop("low", "high", "nulls")


def concat_by_position(df: DataFrame, keys: list[str], start: str, bits: str) -> DataFrame:
    """Bit strings joined in order of ``start``, gaps filled with zeros; null if one of them is.

    Where a string begins follows from running totals, so the work goes with the length of what is joined: before it are
    all earlier bits and the zeros of the widest lead that a start up to it has over the bits before that start.
    """
    rows = df.select(*keys, F.coalesce(F.col(start).cast("int"), F.lit(0)).alias("_s"), F.col(bits).alias("_b"))
    before = Window.partitionBy(*keys).orderBy("_s", "_b").rowsBetween(Window.unboundedPreceding, -1)
    to_here = before.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_bits", F.coalesce(F.sum(F.length("_b")).over(before), F.lit(0)))
    rows = rows.withColumn("_lead", F.greatest(F.lit(0), F.max(F.col("_s") - F.col("_bits")).over(to_here)))
    zeros = F.col("_lead") - F.coalesce(F.max("_lead").over(before), F.lit(0))
    rows = rows.select(*keys, (F.col("_bits") + F.col("_lead")).alias("_at"), "_s", F.concat(F.repeat(F.lit("0"), zeros.cast("int")), "_b").alias("_b"))
    pieces = F.array_sort(F.collect_list(F.struct("_at", "_s", "_b")))
    joined = F.when(F.count("_b") == F.count("*"), F.array_join(F.transform(pieces, lambda x: x["_b"]), ""))
    return rows.groupBy(*keys).agg(joined.alias(bits))


def split_class_probes(classes: DataFrame, methods: DataFrame, keys: list[str]) -> DataFrame:
    """Class-level bit strings cut into the slices of their methods (probe_start_pos, probes_count); slices must be whole and have a set bit.

    A method meets the piece of its class that it starts in, not the class's whole string; only methods of more than
    ``BLOCK`` probes, of which a class has few, meet that.
    """
    cut = lambda df, start: df.withColumn("probes", F.substr("class_probes", start + 1, F.col("probes_count")))
    block = F.floor(F.col("probe_start_pos") / BLOCK)
    pieces = F.regexp_extract_all("class_probes", F.lit(f"(?s)(?=(.{{1,{2 * BLOCK}}})).{{1,{BLOCK}}}"), F.lit(1))
    rest = [c for c in classes.columns if c not in (*keys, "class_probes")]
    blocks = classes.select(*keys, *rest, F.posexplode(pieces).alias("_block", "class_probes"))
    short = F.col("probes_count") <= BLOCK
    out = cut(blocks.join(methods.filter(short).withColumn("_block", block.cast("int")), [*keys, "_block"]), F.col("probe_start_pos") - F.col("_block") * BLOCK).drop("_block")
    out = out.unionByName(cut(classes.join(methods.filter(~short), keys), F.col("probe_start_pos")).select(out.columns))
    return out.filter((F.length("probes") == F.col("probes_count")) & F.col("probes").contains("1")).drop("class_probes")
