"""Compiler time attributed to symbols. events: thread, event_id, label, start_ns, end_ns, path (the symbol in the event's first argument, its raw path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import paths

from . import profile

#: A segment below the level of symbols: closures and the like, anonymous constants, lifetimes, generic parameters.
BELOW = r"^(?s:\{\{(?!impl\}\}|use\}\}).*|_|_\[.*\]|'.*|[A-Z])$"
ANONYMOUS = r"^(?s:_|_\[.*\])$"


def below_symbol(segment: Column) -> Column:
    return segment.rlike(BELOW)


def joined(segments: Column, n: Column) -> Column:
    return F.array_join(F.slice(segments, F.lit(1), F.greatest(n, F.lit(0))), "::")


def symbol_level(raw: Column) -> Column:
    """The path of the symbol that a raw path lies in; '' for what no symbol can be."""
    s = F.split(raw, "::", -1)
    anonymous = F.array_position(F.transform(s, lambda x: x.rlike(ANONYMOUS)), True)
    # an impl of a type without a name belongs to what is around the type
    nameless = F.array_position(F.transform(s, lambda x, i: below_symbol(x) & F.coalesce(F.startswith(F.get(s, i + 1), F.lit("{{impl}}")), F.lit(False))), True)
    keep = F.array_max(F.transform(s, lambda x, i: F.when((i == 0) | ~below_symbol(x), i + 1)))
    own, around = joined(s, keep), joined(s, keep - 1)
    method = F.regexp_extract(around, r"^((?s:.*)::\{\{impl\}\}(?:\[[^\]]*\](?s:.*)|$))", 1)
    inner = F.regexp_extract(around, r"^((?s:.*)::\{\{impl\}\}(?:\[[^\]]*\])?)", 1)
    block = F.regexp_extract(own, r"^((?s:.*?)\{\{impl\}\}(?:\[[^\]]*\])?)", 1)
    field = own.rlike(r"::[A-Z][^:]*::[a-z][^:]*$")  # a field belongs to its type
    plain = F.when(field, F.regexp_replace(own, r"::[^:]+$", "")).otherwise(own)
    named = F.when(method != "", inner).when(F.contains(own, F.lit("{{impl}}")), block).otherwise(plain)
    none = ~F.contains(raw, F.lit("::")) | raw.rlike(r"^(DefId\(|PseudoCanonicalInput|LocalModDefId)")
    return F.when(raw.isNull() | none, "").when(anonymous > 0, joined(s, (anonymous - 1).cast("int"))).when(nameless > 0, joined(s, (nameless - 1).cast("int"))).otherwise(named)


def local_path(raw: Column, prefix: Column) -> Column:
    """The symbol-level path if it begins with the prefix of the crate, else null."""
    path = symbol_level(raw)
    return F.when(F.startswith(path, prefix), path)


def ancestors(found: DataFrame, symbols: DataFrame, prefix: str) -> DataFrame:
    """path, ancestor: the longest proper prefix (in segments) of each path that is a symbol; null without one. found: path; symbols: path."""
    s = F.split("path", "::", -1)
    above = found.select("path").distinct().filter(F.startswith("path", F.lit(prefix)))
    tried = above.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda n: joined(s, n))).alias("up")).filter(F.length("up") > 0)
    hit = tried.join(symbols.select(F.col("path").alias("up")), "up").groupBy("path").agg(F.max(F.struct(F.length("up").alias("n"), "up")).alias("m"))
    return above.join(hit, "path", "left").select("path", F.col("m.up").alias("ancestor"))


def located(rows: DataFrame, symbols: DataFrame | None, prefix: str) -> DataFrame:
    """rows (raw) with path: the symbol of this crate that each raw path lies in, else null. symbols: path; without them every local path is one.

    A raw path is looked at once for each row: give the distinct ones and join the events to them.
    """
    out = rows.withColumn("path", local_path(F.col("raw"), F.lit(prefix)))
    if symbols is None:
        return out
    known = symbols.select(F.col("path").alias("known")).distinct()
    return out.join(known, out.path == F.col("known"), "left").withColumn("path", F.col("known")).drop("known")


def recorded(events: DataFrame) -> DataFrame:
    """event_id, label, self_ns, path: the event's own symbol, else that of the nearest event around it, else null. Events of the profiler itself are left out.

    Symbols come down to the events within in the pass that nests them, however deep they lie.
    """
    return profile.self_times(events).select("event_id", "label", "self_ns", "path").filter(~paths.is_self_profile(F.col("label")))


def attributed(rows: DataFrame) -> DataFrame:
    """path, label, self_ns: the sums; those without a path are the target's own."""
    return rows.groupBy("path", "label").agg(F.sum("self_ns").alias("self_ns"))


def rolled_up(costs: DataFrame, symbols: DataFrame, modules: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Costs (path, label, self_ns) of symbols, with those of other local paths moved to their ancestors; and what has none: kind (module, unmatched), path, self_ns.

    Paths of other crates stay as they are.
    """
    known = symbols.select(F.col("path").alias("known")).distinct()
    c = costs.join(known, F.col("path") == F.col("known"), "left")
    stay = F.col("known").isNotNull() | ~F.startswith("path", F.lit(prefix))
    lost = c.filter(~stay).select("path", "label", "self_ns")
    moved = lost.join(ancestors(lost, symbols, prefix), "path", "left")
    out = c.filter(stay).select("path", "label", "self_ns").union(moved.filter("ancestor is not null").select("ancestor", "label", "self_ns"))
    rest = moved.filter("ancestor is null").join(modules.select("path", F.lit("module").alias("kind")).distinct(), "path", "left")
    rest = rest.groupBy(F.coalesce("kind", F.lit("unmatched")).alias("kind"), "path").agg(F.sum("self_ns").alias("self_ns"))
    return out.groupBy("path", "label").agg(F.sum("self_ns").alias("self_ns")), rest


def event_times(symbols: DataFrame, costs: DataFrame) -> DataFrame:
    """symbols (path as cargo writes it) with events, a map of label to time: the costs of the path with _ for -. Null without any."""
    by = costs.groupBy("path").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "self_ns")))).alias("events")).withColumnRenamed("path", "key")
    return symbols.withColumn("key", F.replace("path", F.lit("-"), F.lit("_"))).join(by, "key", "left").drop("key")


def unmatched_lines(rest: DataFrame, package: str, target: str, crate: str) -> DataFrame:
    """line: package, target, crate, kind, path and milliseconds, with tabs between; tabs and line feeds of a path are spaces."""
    ms = F.format_string("%.6f", F.col("self_ns") / 1e6)
    return rest.select(F.concat_ws("\t", F.lit(package), F.lit(target), F.lit(crate), "kind", F.translate("path", "\t\n", "  "), ms).alias("line"))
