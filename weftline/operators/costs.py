"""Cost aggregation: predictors of targets, roll-ups over modules, ratios and the allocation of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import paths


def predictors(targets: DataFrame, symbols: DataFrame, events: DataFrame) -> DataFrame:
    """target, attr_ns, meta_ns, other_ns, symbol_count for each target; symbols: target, cost_ns; events: target, label, self_ns."""
    attr = symbols.groupBy("target").agg(F.sum("cost_ns").alias("attr_ns"), F.count("*").alias("symbol_count"))
    meta = paths.is_metadata(F.col("label"))
    sums = events.groupBy("target").agg(F.sum(F.when(meta, F.col("self_ns"))).alias("meta_ns"), F.sum(F.when(~meta, F.col("self_ns"))).alias("other_ns"))
    out = targets.select("target").join(attr, "target", "left").join(sums, "target", "left")
    return out.select("target", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("attr_ns", "meta_ns", "other_ns", "symbol_count")])


def module_rollup(symbols: DataFrame) -> DataFrame:
    """target_id, module_path, symbol_count, cost_ns over each module's subtree, the root ('') included. One row for a symbol and ancestor, summed before it moves."""
    parts = F.when(F.col("module_path") == "", F.array().cast("array<string>")).otherwise(F.split("module_path", "::"))
    depths = F.sequence(F.lit(0), F.size("parts"))
    up = symbols.select("target_id", "cost_ns", parts.alias("parts")).select("target_id", "cost_ns", F.explode(F.transform(depths, lambda d: F.array_join(F.slice("parts", 1, d), "::"))).alias("module_path"))
    return up.groupBy("target_id", "module_path").agg(F.count("*").alias("symbol_count"), F.sum("cost_ns").alias("cost_ns"))


def share(value: Column, by: list[str], fallback: Column | None = None) -> Column:
    """value over its sum in the group; the fallback, or equal parts, where the sum is not positive."""
    w = Window.partitionBy(*by)
    return F.when(F.sum(value).over(w) > 0, value / F.sum(value).over(w)).otherwise(fallback if fallback is not None else 1 / F.count("*").over(w))


# The labels whose time follows impls, and those whose time follows attributed time.
BY_IMPLS = ("compare_impl_item", "specialization_graph_of")
BY_ATTR = ("typeck", "mir_borrowck", "evaluate_obligation", "type_op_prove_predicate", "mir_built", "check_well_formed")


def group_ratios(groups: DataFrame) -> DataFrame:
    """Adds sym_ratio, attr_ratio, impl_ratio, dep_ratio. groups: graph, grp, symbol_count, impl_count, attr_ns, dep_count, all_deps.

    attr falls back to the symbols' ratio, impls too; dependencies give 1 for each group if there are none at all.
    """
    out = groups.withColumn("sym_ratio", share(F.col("symbol_count"), ["graph"]))
    out = out.withColumn("attr_ratio", share(F.col("attr_ns"), ["graph"], F.col("sym_ratio"))).withColumn("impl_ratio", share(F.col("impl_count"), ["graph"], F.col("sym_ratio")))
    return out.withColumn("dep_ratio", F.when(F.col("all_deps") > 0, F.col("dep_count") / F.col("all_deps")).otherwise(1.0))


def allocated(groups: DataFrame, events: DataFrame) -> DataFrame:
    """graph, grp, label, self_ns: each label's time over the groups by the ratio that its kind follows; zeros are dropped. groups have their ratios."""
    label = F.col("label")
    ratio = F.when(F.startswith(label, F.lit("metadata_")), F.col("dep_ratio")).when(label.isin(*BY_IMPLS), F.col("impl_ratio")).when(label.isin(*BY_ATTR), F.col("attr_ratio")).otherwise(F.col("sym_ratio"))
    out = events.join(groups, "graph").select("graph", "grp", "label", F.floor(F.col("self_ns") * ratio + 0.5).cast("long").alias("self_ns"))
    return out.filter("self_ns <> 0")


def proportional_share(total: Column, part: Column, whole: Column) -> Column:
    """total * part / whole, rounded down; 0 if part or whole is 0."""
    return F.when((part == 0) | (whole == 0), 0).otherwise(F.floor(total.cast("decimal(38,0)") * part / whole).cast("long"))


def with_library_cost(costs: DataFrame) -> DataFrame:
    """cost_ns of a `test` target without wall time gains the cost of its package's `lib`. costs: target_id, wall_ns, cost_ns."""
    libs = costs.filter(paths.target_key(F.col("target_id")) == "lib").select(paths.package(F.col("target_id")).alias("p"), F.col("cost_ns").alias("lib_ns"))
    out = costs.withColumn("p", paths.package(F.col("target_id"))).join(libs, "p", "left")
    gains = (paths.target_key(F.col("target_id")) == "test") & (F.col("wall_ns") == 0)
    return out.select("target_id", "wall_ns", (F.col("cost_ns") + F.when(gains, F.coalesce("lib_ns", F.lit(0))).otherwise(0)).alias("cost_ns"))


def symbol_breakdown(symbols: DataFrame, used: DataFrame, targets: DataFrame) -> DataFrame:
    """symbol, attr_ns, meta_ns, other_ns: a symbol's own time and its share of the target's, by the dependencies of the target that it names.

    symbols: symbol, target, cost_ns; used: symbol, dep (a target, once for each reference); targets: target, meta_ns, other_ns, deps (array). Targets without dependencies share nothing out.
    """
    s = symbols.join(targets, "target", "left")
    n = used.join(s.select("symbol", "deps"), "symbol").filter(F.array_contains("deps", F.col("dep"))).groupBy("symbol").agg(F.count("*").alias("n"))
    s = s.join(n, "symbol", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    whole = F.coalesce(F.size("deps"), F.lit(0))
    part = lambda c: F.coalesce(proportional_share(F.col(c), F.col("n"), whole), F.lit(0)).alias(c)
    return s.select("symbol", F.col("cost_ns").alias("attr_ns"), part("meta_ns"), part("other_ns"))


def with_extra_symbols(groups: DataFrame, whole: DataFrame) -> DataFrame:
    """groups (graph, grp, symbol_count) whose lowest group takes what the target has beyond all its groups. whole: graph, symbol_count."""
    sums = groups.groupBy("graph").agg(F.sum("symbol_count").alias("have"), F.min("grp").alias("low"))
    extra = whole.select("graph", F.col("symbol_count").alias("all")).join(sums, "graph").select("graph", "low", F.greatest(F.col("all") - F.col("have"), F.lit(0)).alias("extra"))
    return groups.join(extra, "graph", "left").withColumn("symbol_count", F.col("symbol_count") + F.when(F.col("grp") == F.col("low"), F.col("extra")).otherwise(0)).drop("low", "extra")
