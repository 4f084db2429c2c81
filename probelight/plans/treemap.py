"""Coverage treemap without recursion.

Every method is put under all prefixes of its path; sums go bottom-up in one aggregation.  A node merges into its parent
if the parent has no other child and the node has no leaf child; since that is local, chains are closed by one join of
each node with its ancestors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelight.functions.formats import ratio


def treemap(methods: DataFrame, total: str = "probes_count", covered: str = "covered", root: str | None = None) -> DataFrame:
    """(name, full_name, parent, type, probes_count, covered_probes, coverage_ratio); null counts are zero, of equal leaves one counts."""
    leaf = F.concat(F.col("method_name"), F.lit("("), F.regexp_replace(F.coalesce("method_params", F.lit("")), r"^\(|\)$", ""), F.lit(") -> "), F.coalesce("return_type", F.lit("")))
    rows = methods.select(F.split("class_name", "/").alias("_dirs"), leaf.alias("_leaf"), F.coalesce(F.col(total), F.lit(0)).cast("long").alias("n"), F.coalesce(F.col(covered), F.lit(0)).cast("long").alias("c"))
    leaves = rows.groupBy("_dirs", "_leaf").agg(F.max(F.struct("n", "c")).alias("v")).select(F.concat("_dirs", F.array("_leaf")).alias("parts"), "v.n", "v.c")
    depth = F.size("parts")
    prefix = lambda i: F.array_join(F.slice("parts", F.lit(1), i), "/")
    up = F.transform(F.sequence(F.lit(1), depth), lambda i: F.struct(prefix(i).alias("path"), F.when(i > 1, prefix(i - 1)).alias("up"), i.alias("depth"), (i == depth).alias("leaf"), F.get("parts", i - 1).alias("last")))
    nodes = leaves.select("n", "c", F.explode(up).alias("x")).select("n", "c", "x.*")
    if root:
        nodes = nodes.filter(F.col("path").startswith(root)).withColumn("up", F.when(F.col("path") == root, None).otherwise(F.col("up")))
    table = nodes.groupBy("path").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.first("up").alias("up"), F.first("depth").alias("depth"), F.max("leaf").alias("leaf"), F.first("last").alias("last"))
    kids = table.filter("up IS NOT NULL").groupBy(F.col("up").alias("path")).agg(F.count("*").alias("kids"), F.max("leaf").alias("has_leaf"))
    full = table.join(kids, "path", "left").select("*").fillna(0, ["kids"]).withColumn("has_leaf", F.coalesce("has_leaf", F.lit(False)))
    parent = full.select(F.col("path").alias("up"), F.col("kids").alias("siblings"))
    marked = full.join(parent, "up", "left").withColumn("merges", F.col("up").isNotNull() & (F.coalesce("siblings", F.lit(0)) == 1) & ~F.col("has_leaf"))
    # a chain runs from its head (which doesn't merge) down to its tail (whose child, if any, doesn't merge)
    heads = marked.filter("NOT merges").select(F.col("path").alias("head"), F.col("up").alias("head_up"), F.col("depth").alias("head_depth"))
    parts = F.split("path", "/")
    up_paths = F.when(F.col("leaf"), F.array("path", "up")).otherwise(F.array("path"))
    own = marked.withColumn("_dirs", F.when(F.col("leaf"), F.split("up", "/")).otherwise(parts))
    chain = F.array_union(up_paths, F.transform(F.sequence(F.lit(1), F.size("_dirs")), lambda i: F.array_join(F.slice("_dirs", F.lit(1), i), "/")))
    found = own.select("path", F.explode(F.filter(chain, lambda p: p.isNotNull())).alias("head")).join(heads, "head")
    best = found.groupBy("path").agg(F.max(F.struct("head_depth", "head", "head_up")).alias("h")).select("path", "h.*")
    merging_child = marked.filter("merges").select(F.col("up").alias("path")).distinct()
    tails = marked.join(merging_child, "path", "left_anti").join(best, "path")
    # the parent's tail is the parent itself, since a head's parent has no merging child
    name = F.when(F.col("head") == F.col("path"), F.col("last")).otherwise(F.concat(F.when(F.col("head_up").isNull(), F.col("path")).otherwise(F.expr("substring(path, length(head_up) + 2)"))))
    return tails.select(name.alias("name"), F.col("path").alias("full_name"), F.col("head_up").alias("parent"), F.when(F.col("leaf"), "method").otherwise("node").alias("type"), F.col("n").alias("probes_count"), F.col("c").alias("covered_probes"), ratio(F.col("c"), F.col("n")).alias("coverage_ratio"))
