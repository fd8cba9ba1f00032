"""python -m weftline cost|schedule GRAPH.json [MODEL]: the validation table of a fitted model, or the schedule of targets."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import drawing
from weftline.operators import regression, schedule
from weftline.sources import cost_model, graph_json

X = ["attr_ms", "meta_ms", "other_ms"]


def predictors(targets: DataFrame) -> DataFrame:
    """target_id, attr_ms, meta_ms, other_ms, wall_ms, wall_ns, symbol_count of targets as read_graph gives them."""
    total = lambda of: F.aggregate(of, F.lit(0).cast("long"), lambda s, x: s + x) / 1e6
    meta = lambda k, v: F.startswith(k, F.lit("metadata_decode_"))
    own = F.flatten(F.transform("symbols", lambda s: F.map_values(s["events"])))
    return targets.select("target_id", total(own).alias("attr_ms"), total(F.map_values(F.map_filter("events", meta))).alias("meta_ms"), total(F.map_values(F.map_filter("events", lambda k, v: ~meta(k, v)))).alias("other_ms"), (F.col("wall_ns") / 1e6).alias("wall_ms"), "wall_ns", F.size("symbols").alias("symbol_count"))


def cost_report(targets: DataFrame, libraries_only: bool = False) -> list[str]:
    """The lines of the report; one for each target with wall time, so as many as the workspace has."""
    spark, rows = targets.sparkSession, predictors(targets).persist()
    sums = rows.agg(F.count("*").alias("n"), F.sum("symbol_count").alias("s"), F.sum((F.col("wall_ns") > 0).cast("int")).alias("w")).first()
    out = [f"Target count:    {sums.n}", f"Symbol count:    {sums.s or 0}"]
    fit = regression.robust(regression.fitting_rows(rows, libraries_only), X, "wall_ms")
    if sums.w:
        out += ["", f"Model validation ({sums.w} targets with profiling):", ""]
    if sums.w and fit:
        out += [f"{'Target':<35} {'Actual':>9} {'Predicted':>9} {'Delta':>9}  Out", "-" * 70]
        table = regression.validation(rows.withColumn("predicted", regression.prediction(X, fit["coefficients"])), fit["inlier_threshold"])
        out += [r.line for r in table.orderBy(F.desc("abs_error"), "target_id").toLocalIterator()]
    rows.unpersist()
    return out


def target_schedule(targets: DataFrame, model: list[float] | None, libraries_only: bool = True) -> DataFrame:
    """The schedule of the targets. Without a model one is fitted on libraries; if that cannot be, wall or attributed time counts."""
    rows = predictors(targets)
    if model is None:
        fit = regression.robust(regression.fitting_rows(rows, libraries_only), X, "wall_ms")
        model = fit and fit["coefficients"]
    costs = regression.target_costs(rows, X, model)
    nodes = costs.select(F.lit(0).cast("long").alias("graph"), F.col("target_id").alias("node"), F.greatest(F.round(F.col("cost_ms") * 1e6), F.lit(0)).cast("long").alias("cost_ns"))
    edges = targets.select(F.lit(0).cast("long").alias("graph"), F.explode("deps").alias("src"), F.col("target_id").alias("dst"))
    return schedule.schedule(nodes, edges)


def main() -> None:
    args = argparse.ArgumentParser(prog="weftline", description=__doc__)
    args.add_argument("what", choices=["cost", "schedule"])
    args.add_argument("graph")
    args.add_argument("model", nargs="?")
    a = args.parse_args()
    spark = SparkSession.builder.getOrCreate()
    targets = graph_json.read_graph(spark, a.graph)
    if a.what == "cost":
        print("\n".join(cost_report(targets)))
        return
    model = cost_model.read_model(spark, a.model).first() if a.model else None
    rows = target_schedule(targets, model and list(model)[:3])
    for r in rows.select("node", drawing.short_duration(F.col("start_ns") / 1e6).alias("start"), drawing.short_duration(F.col("finish_ns") / 1e6).alias("finish"), "critical").orderBy("start_ns", "node").toLocalIterator():
        print(f"{r.start:>9} {r.finish:>9} {'*' if r.critical else ' '} {r.node}")


if __name__ == "__main__":
    main()
