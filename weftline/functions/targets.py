"""Column functions that name targets: by file, by kind, by the compiler's flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMED = ("bin", "test", "example", "bench")


def by_file(stem: Column, crate: Column) -> Column:
    """The target key that a result file's stem stands for: `crate_bin_x` is bin/x, `crate_test` is test, any other stem is lib."""
    rest = F.when(F.startswith(stem, F.concat(crate, F.lit("_"))), stem.substr(F.length(crate) + 2, F.length(stem)))
    return F.coalesce(F.regexp_replace(rest, f"^({'|'.join(NAMED)})_", "$1/"), F.lit("lib"))


def by_kind(kind: Column, name: Column) -> Column:
    """lib, or kind/name; null for kinds that are no target, such as build scripts."""
    return F.when(kind.isin("lib", "proc-macro"), F.lit("lib")).when(kind.isin(*NAMED), F.concat(kind, F.lit("/"), name))


def crate_of(name: Column) -> Column:
    """A name as the compiler writes it."""
    return F.replace(name, F.lit("-"), F.lit("_"))


def metadata_only(emit: Column) -> Column:
    """Whether the emit list has metadata, and dep-info besides at most."""
    kinds = F.array_remove(F.transform(F.split(F.coalesce(emit, F.lit("")), ","), lambda k: F.trim(k)), "")
    return F.array_contains(kinds, "metadata") & F.forall(kinds, lambda k: k.isin("metadata", "dep-info"))


def kind_by_source(source: Column) -> Column:
    """test, example or bench by the folder of a named target's source; null elsewhere."""
    place = F.replace(source, F.lit("\\"), F.lit("/"))
    lies = lambda folder: F.contains(place, F.lit(f"/{folder}/")) | F.startswith(place, F.lit(f"{folder}/"))
    return F.when(lies("tests"), F.lit("test")).when(lies("examples"), F.lit("example")).when(lies("benches"), F.lit("bench"))


def crate_mapping(targets: DataFrame) -> DataFrame:
    """crate, target_id: which target a crate's name means. targets: package, kind, name.

    A library goes before other targets of the name, these before a package's own name; the first in order of (package, key) among equals.
    """
    key = by_kind(F.col("kind"), F.col("name"))
    rows = targets.select(crate_of(F.col("name")).alias("crate"), F.concat("package", F.lit("/"), key).alias("target_id"), F.when(key == "lib", 0).otherwise(1).alias("rank")).filter("target_id is not null")
    own = targets.select(crate_of(F.col("package")).alias("crate"), F.concat("package", F.lit("/lib")).alias("target_id"), F.lit(2).alias("rank"))
    return rows.union(own).groupBy("crate").agg(F.min(F.struct("rank", "target_id")).alias("m")).select("crate", "m.target_id")
