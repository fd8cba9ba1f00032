"""Column functions over target ids (package/target) and symbol paths ([package/target]::module::symbol)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def symbol_path(target_id: Column, module_path: Column, name: Column) -> Column:
    """[target]::module::name; without the module part at the root."""
    return F.concat_ws("::", F.concat(F.lit("["), target_id, F.lit("]")), F.when(module_path != "", module_path), name)


def prefix(path: Column) -> Column:
    """The bracketed prefix; null unless the path starts with one that :: follows."""
    return F.nullif(F.regexp_extract(path, r"^(\[[^\]]*\])::", 1), F.lit(""))


def rest(path: Column) -> Column:
    """What follows the prefix; null without one."""
    return F.when(prefix(path).isNotNull(), F.regexp_extract(path, r"^\[[^\]]*\]::(.*)$", 1))


def bracketed_target(path: Column) -> Column:
    """The text between the first [ and the next ]; null without them."""
    return F.when(path.rlike(r"\[[^\]]*\]"), F.regexp_extract(path, r"\[([^\]]*)\]", 1))


def target_id(text: Column) -> Column:
    """The text if it has a /, else null."""
    return F.when(F.instr(text, "/") > 0, text)


def package(target: Column) -> Column:
    """Before the first /."""
    return F.substring_index(target, "/", 1)


def target_key(target: Column) -> Column:
    """After the first /; it may hold more of them."""
    return F.when(F.instr(target, "/") > 0, target.substr(F.instr(target, "/") + 1, F.length(target)))


def segments(path: Column) -> Column:
    return F.split(rest(path), "::")


def module_of(path: Column) -> Column:
    s = segments(path)
    return F.array_join(F.slice(s, F.lit(1), F.size(s) - 1), "::")


def name_of(path: Column) -> Column:
    return F.element_at(segments(path), -1)


def child(module_path: Column, segment: Column) -> Column:
    return F.when(module_path == "", segment).otherwise(F.concat_ws("::", module_path, segment))


def parent(path: Column) -> Column:
    """A bracketed path without its last segment, if one is left after that; else null."""
    up = F.regexp_replace(path, r"::[^:]+$", "")
    return F.when(prefix(up).isNotNull() & (up != path), up)


def impl_of(path: Column) -> Column:
    """Up to the last {{impl}}[N] that a further segment follows; null without one."""
    return F.nullif(F.regexp_extract(path, r"^(.*\{\{impl\}\}\[[^\]]*\])::", 1), F.lit(""))


def crate_name(stem: Column) -> Column:
    """A file's stem without a -HEX end."""
    return F.regexp_replace(stem, "-[0-9A-Fa-f]*$", "")


def is_self_profile(label: Column) -> Column:
    return F.startswith(label, F.lit("self_profile_"))


def is_metadata(label: Column) -> Column:
    return F.startswith(label, F.lit("metadata_decode_"))
