"""Symbol graphs as JSON: read to flat tables, and written back.

A file holds packages -> targets -> timings, dependencies and a tree of modules with symbols.
Reading flattens each file in Python once (a module tree has no fixed schema); all else is tables.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

SYMBOL = "struct<target_id:string,module_path:string,name:string,path:string,file:string,symbol_type:string,kind:string,visibility:string,impl_name:string,anchors:array<string>,deps:array<string>,events:map<string,bigint>>"
TARGET = f"target_id string, wall_ns long, events map<string,bigint>, deps array<string>, symbols array<{SYMBOL}>"


def ns(ms) -> int:
    """Milliseconds as nanoseconds, to the nearest."""
    return int(float(ms) * 1_000_000 + 0.5)


def flattened(text: str):
    """Rows (target_id, wall_ns, events, deps, symbols) of one graph. Missing required fields raise KeyError."""
    for package, p in json.loads(text)["packages"].items():
        for key, t in p["targets"].items():
            target, timings, symbols = f"{package}/{key}", t["timings"], []
            todo = [("", t["root"])]
            while todo:
                path, m = todo.pop()
                for name, s in m["symbols"].items():
                    d, i = s.get("module_def"), s.get("impl")
                    if (d is None) == (i is None):
                        raise ValueError(f"{target}: {name} needs either module_def or impl")
                    full = "::".join([f"[{target}]", *([path] if path else []), name])
                    symbols.append({"target_id": target, "module_path": path, "name": name, "path": full, "file": s["file"], "symbol_type": "impl" if i else "module_def", "kind": d and d["kind"], "visibility": d and d.get("visibility", "non_public"), "impl_name": i and i["name"], "anchors": sorted(set(i.get("anchors", []))) if i else None, "deps": sorted(set(s.get("dependencies", []))), "events": {k: ns(v) for k, v in s.get("event_times_ms", {}).items()}})
                for name, sub in m.get("submodules", {}).items():
                    todo.append((f"{path}::{name}" if path else name, sub))
            yield {"target_id": target, "wall_ns": ns(timings.get("wall_time_ms", 0)), "events": {k: ns(v) for k, v in timings.get("event_times_ms", {}).items()}, "deps": sorted(set(t.get("dependencies", []))), "symbols": sorted(symbols, key=lambda s: s["path"])}


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """A row for each target of all files: target_id, wall_ns, events, deps, symbols (explode for a table of symbols)."""
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = [r for text in b["value"] for r in flattened(text)]
            yield pd.DataFrame(rows, columns=["target_id", "wall_ns", "events", "deps", "symbols"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, TARGET)


def nested(rows) -> dict:
    """The graph of some target rows as read_graph gives them; empty and default fields are left out."""
    ms = lambda events: {k: v / 1_000_000 for k, v in sorted(events.items())}
    packages: dict = {}
    for r in sorted(rows, key=lambda r: r["target_id"]):
        package, key = r["target_id"].split("/", 1)
        root = {"symbols": {}}
        for s in r["symbols"]:
            at = root
            for part in filter(None, s["module_path"].split("::")):
                at = at.setdefault("submodules", {}).setdefault(part, {"symbols": {}})
            one = {"file": s["file"]}
            if s["events"]:
                one["event_times_ms"] = ms(s["events"])
            if s["deps"]:
                one["dependencies"] = list(s["deps"])
            if s["symbol_type"] == "impl":
                one["impl"] = {"name": s["impl_name"]} | ({"anchors": list(s["anchors"])} if s["anchors"] else {})
            else:
                one["module_def"] = {"kind": s["kind"]} | ({"visibility": s["visibility"]} if s["visibility"] == "public" else {})
            at["symbols"][s["name"]] = one
        timings = ({"wall_time_ms": r["wall_ns"] / 1_000_000} if r["wall_ns"] else {}) | ({"event_times_ms": ms(r["events"])} if r["events"] else {})
        target = {"timings": timings} | ({"dependencies": list(r["deps"])} if r["deps"] else {}) | {"root": root}
        packages.setdefault(package, {"targets": {}})["targets"][key] = target
    return {"packages": packages}


def write_graph(targets: DataFrame, path: str) -> None:
    """One JSON document in one file on the driver: the exchange format is one document, so the graph has to fit it."""
    with open(path, "w") as f:
        json.dump(nested(r.asDict(recursive=True) for r in targets.toLocalIterator()), f, indent=2)
        f.write("\n")
