"""Paths of symbols that move: from crates to targets, and into merged packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import paths


def retargeted(refs: DataFrame, mapping: DataFrame, symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """refs (package, dep: crate::rest) with path: [package/target]::rest.

    A reference to the own package goes to the target that has the symbol: the path itself, else the
    impl around it, else a module of that path, in this order; the smallest target among equals. All
    others go to the crate's target in the mapping; an unknown crate's stay as they are.
    symbols and modules: package, target, rest.
    """
    r = refs.select("package", "dep").distinct().withColumn("crate", F.regexp_extract("dep", "^(.*?)::", 1)).withColumn("rest", F.regexp_extract("dep", "(?s)^.*?::(.*)$", 1))
    r = r.join(mapping, "crate", "left").withColumn("mine", F.coalesce(paths.package(F.col("target_id")) == F.col("package"), F.lit(False)))
    outer = paths.impl_of(F.col("rest"))
    tries = r.filter("mine").select("package", "dep", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.lit("s").alias("kind"), F.col("rest").alias("at")), F.struct(F.lit(1).alias("rank"), F.lit("s").alias("kind"), outer.alias("at")), F.struct(F.lit(2).alias("rank"), F.lit("m").alias("kind"), F.col("rest").alias("at")))).alias("x")).select("package", "dep", "x.*")
    places = symbols.select("package", "target", F.col("rest").alias("at"), F.lit("s").alias("kind")).union(modules.select("package", "target", "rest", F.lit("m")))
    found = tries.join(places, ["package", "kind", "at"]).groupBy("package", "dep").agg(F.min(F.struct("rank", "target")).alias("m"))
    r = r.join(found, ["package", "dep"], "left")
    target = F.coalesce(F.concat("package", F.lit("/"), F.col("m.target")), "target_id")
    new = F.when(target.isNotNull(), F.concat(F.lit("["), target, F.lit("]::"), "rest")).otherwise(F.col("dep"))
    return refs.join(r.select("package", "dep", new.alias("path")), ["package", "dep"])


def merged_paths(symbols: DataFrame) -> DataFrame:
    """old, new: paths in merged packages. symbols: path, target_id, package (the merged one's name).

    A symbol keeps its place; symbols of one package with the same place go into a module that names the target they come from.
    """
    rest = paths.rest(F.col("path"))
    s = symbols.select("package", "target_id", F.col("path").alias("old"), F.coalesce(rest, F.regexp_extract("path", "(?s)^.*?::(.*)$", 1)).alias("rest"))
    clash = s.groupBy("package", "rest").agg(F.count("*").alias("n"))
    module, name = F.regexp_extract("rest", r"(?s)^(.*)::[^:]*$", 1), F.regexp_extract("rest", r"([^:]*)$", 1)
    aside = F.when(F.col("n") > 1, F.concat(F.lit("conflict_from_"), F.replace("target_id", F.lit("/"), F.lit("_"))))
    new = F.concat_ws("::", F.concat(F.lit("["), "package", F.lit("/synthetic]")), F.when(module != "", module), aside, name)
    return s.join(clash, ["package", "rest"]).select("old", new.alias("new"))


def renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    """src, dep with both ends under their new paths; an end that did not move stays."""
    a, b = names.select(F.col("old").alias("src"), F.col("new").alias("src_new")), names.select(F.col("old").alias("dep"), F.col("new").alias("dep_new"))
    out = edges.select("src", "dep").join(a, "src", "left").join(b, "dep", "left")
    return out.select(F.coalesce("src_new", "src").alias("src"), F.coalesce("dep_new", "dep").alias("dep")).distinct()


def merged_targets(symbols: DataFrame, edges: DataFrame, events: DataFrame) -> DataFrame:
    """target_id, symbol_count, attr_ns, meta_ns, other_ns, deps for each merged package.

    symbols: id, package, target_id, cost_ns; edges: s, t (s refers to t); events: target_id, meta_ns, other_ns. What cannot be split is taken from the
    package's largest constituent.
    """
    base = symbols.groupBy("package").agg(F.count("*").alias("symbol_count"), F.sum("cost_ns").alias("attr_ns"))
    parts = symbols.select("package", "target_id").distinct().join(events, "target_id", "left").groupBy("package").agg(F.coalesce(F.max("meta_ns"), F.lit(0)).alias("meta_ns"), F.coalesce(F.max("other_ns"), F.lit(0)).alias("other_ns"))
    a, b = symbols.select(F.col("id").alias("s"), "package"), symbols.select(F.col("id").alias("t"), F.col("package").alias("other"))
    deps = edges.join(a, "s").join(b, "t").filter("package <> other").groupBy("package").agg(F.sort_array(F.collect_set(F.concat("other", F.lit("/synthetic")))).alias("deps"))
    out = base.join(parts, "package").join(deps, "package", "left")
    return out.select(F.concat("package", F.lit("/synthetic")).alias("target_id"), "symbol_count", "attr_ns", "meta_ns", "other_ns", F.coalesce("deps", F.array().cast("array<string>")).alias("deps"))
