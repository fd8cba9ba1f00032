"""Queries over the derived workspace, and SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import paths
from weftline.operators import costs, graph, partition, profile, regression, rewire, schedule
from weftline.sources import workspace as ws

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = ws.SQL + sql
        return f

    return add


def one_graph(df: DataFrame) -> DataFrame:
    return df.withColumn("graph", F.lit(0).cast("long"))


def package_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return one_graph(ws.package_costs(spark, sf)), one_graph(ws.package_edges(spark, sf))


def scc_of(spark: SparkSession, sf: str) -> DataFrame:
    """node, graph (package), scc, cost_ns."""
    s = ws.symbols(spark, sf).select(F.col("id").alias("node"), F.col("pkg").alias("graph"), "cost_ns")
    return graph.strong_components(s, package_references(spark, sf))


def package_references(spark: SparkSession, sf: str) -> DataFrame:
    """graph (package), s, t: the references within each package, with those that tie impls to an anchor."""
    s = ws.symbols(spark, sf)
    inside = graph.intra_edges(ws.references(spark, sf), s.select(F.col("id").alias("node"), F.col("pkg").alias("graph")))
    return graph.with_back_edges(inside, s.filter("symbol_type = 'impl'").select(F.col("id").alias("impl")))


def scc_graph(spark: SparkSession, sf: str, scc: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Components and their edges within each package. scc: the components, if they are known."""
    scc = graph.cut(scc_of(spark, sf)) if scc is None else scc
    nodes = scc.groupBy("graph", F.col("scc").alias("node")).agg(F.sum("cost_ns").alias("cost_ns"))
    owner = scc.select("node", "scc", "graph")
    edges = graph.condensed_edges(ws.references(spark, sf), owner)
    tops = nodes.select("node", "graph")
    inner = graph.intra_edges(edges.select(F.col("src").alias("s"), F.col("dst").alias("t")), tops)
    return nodes, inner.select("graph", F.col("s").alias("src"), F.col("t").alias("dst"))


@query("SELECT id, path, target_id, module_path, name, symbol_type, cost_ns FROM sym")
def symbol_flatten(spark: SparkSession, sf: str) -> DataFrame:
    return ws.symbols(spark, sf).select("id", "path", "target_id", "module_path", "name", "symbol_type", "cost_ns")


@query("""SELECT id, regexp_extract(path, '^(\\[[^\\]]*\\])::', 1) AS prefix, 'pkg' || pkg AS package, 'lib' AS target_key, module_path AS module, name AS symbol,
 '[' || target_id || ']::' || module_path AS parent, target_id AS bracketed, CASE WHEN id % 7 = 0 THEN 'x::{{impl}}[' || id || ']' END AS impl FROM sym""")
def path_codec(spark: SparkSession, sf: str) -> DataFrame:
    s = ws.symbols(spark, sf)
    p, t = F.col("path"), paths.bracketed_target(F.col("path"))
    method = F.concat(F.lit("x::{{impl}}["), F.col("id").cast("string"), F.lit("]"), F.when(F.col("id") % 7 == 0, "::m").otherwise(""))
    return s.select("id", paths.prefix(p).alias("prefix"), paths.package(t).alias("package"), paths.target_key(t).alias("target_key"), paths.module_of(p).alias("module"), paths.name_of(p).alias("symbol"), paths.parent(p).alias("parent"), t.alias("bracketed"), paths.impl_of(method).alias("impl"))


@query(""", written AS (SELECT a.path AS src, CASE WHEN (s + t) % 11 = 0 THEN 'serde' WHEN (s + t) % 7 = 0 THEN b.path || '::x::y' WHEN (s + t) % 5 = 0 THEN b.path || '::x' ELSE b.path END AS dep,
  CASE WHEN (s + t) % 11 <> 0 AND (s + t) % 7 <> 0 THEN b.path END AS path FROM dep JOIN sym a ON a.id = s JOIN sym b ON b.id = t)
 SELECT DISTINCT src, dep, path FROM written WHERE path IS NOT NULL""")
def dep_resolve_fallback(spark: SparkSession, sf: str) -> DataFrame:
    sym = ws.symbols(spark, sf).select("id", "path")
    k = F.col("s") + F.col("t")
    written = F.when(k % 11 == 0, "serde").when(k % 7 == 0, F.concat("tp", F.lit("::x::y"))).when(k % 5 == 0, F.concat("tp", F.lit("::x"))).otherwise(F.col("tp"))
    e = ws.references(spark, sf).join(sym.select(F.col("id").alias("s"), F.col("path").alias("src")), "s").join(sym.select(F.col("id").alias("t"), F.col("path").alias("tp")), "t")
    return graph.resolved(e.select("src", written.alias("dep")).distinct(), sym, paths.parent)


def predictor_rows(spark: SparkSession, sf: str) -> DataFrame:
    s = ws.symbols(spark, sf).withColumnRenamed("pkg", "target")
    return costs.predictors(s.select("target").distinct(), s, ws.target_events(spark, sf).withColumnRenamed("pkg", "target"))


PREDICTORS = """, pred AS (SELECT n.node AS target, CAST(n.cost_ns AS BIGINT) AS attr_ns, CAST(coalesce((SELECT sum(self_ns) FROM ev WHERE ev.pkg = n.node AND label LIKE 'metadata\\_decode\\_%' ESCAPE '\\'), 0) AS BIGINT) AS meta_ns,
 CAST(coalesce((SELECT sum(self_ns) FROM ev WHERE ev.pkg = n.node AND label NOT LIKE 'metadata\\_decode\\_%' ESCAPE '\\'), 0) AS BIGINT) AS other_ns, (SELECT count(*) FROM sym WHERE sym.pkg = n.node) AS symbol_count FROM node n)"""


@query(PREDICTORS + " SELECT target, attr_ns, meta_ns, other_ns, symbol_count FROM pred")
def target_predictors(spark: SparkSession, sf: str) -> DataFrame:
    return predictor_rows(spark, sf)


@query(""" SELECT target_id, module_path, count(*) AS symbol_count, CAST(sum(cost_ns) AS BIGINT) AS cost_ns
 FROM (SELECT target_id, module_path, cost_ns FROM sym UNION ALL SELECT target_id, '', cost_ns FROM sym) GROUP BY ALL""")
def module_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return costs.module_rollup(ws.symbols(spark, sf))


@query(" SELECT src, dst FROM edge")
def package_edges(spark: SparkSession, sf: str) -> DataFrame:
    return ws.package_edges(spark, sf)


@query(""", indeg AS (SELECT t, count(*) AS n FROM dep GROUP BY t), ranked AS (SELECT s AS impl, dep.t AS anchor, coalesce(n, 0) AS in_degree,
 row_number() OVER (PARTITION BY s ORDER BY coalesce(n, 0), dep.t) AS k FROM dep LEFT JOIN indeg ON indeg.t = dep.t WHERE s % 7 = 0)
 SELECT impl, anchor, in_degree FROM ranked WHERE k = 1""")
def anchor_pick(spark: SparkSession, sf: str) -> DataFrame:
    e = ws.references(spark, sf)
    impls = ws.symbols(spark, sf).filter("symbol_type = 'impl'").select(F.col("id").alias("impl"))
    return graph.anchors(impls, e, e.select(F.col("s").alias("impl"), F.col("t").alias("anchor")))


@query(" SELECT scc, count(*) AS members, CAST(sum(cost_ns) AS BIGINT) AS cost_ns FROM scc GROUP BY scc")
def symbol_scc(spark: SparkSession, sf: str) -> DataFrame:
    return scc_of(spark, sf).groupBy("scc").agg(F.count("*").alias("members"), F.sum("cost_ns").alias("cost_ns"))


@query(" SELECT src, dst FROM sccedge")
def scc_dag_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.condensed_edges(ws.references(spark, sf), scc_of(spark, sf))


@query(" SELECT a, b FROM reach")
def reachability(spark: SparkSession, sf: str) -> DataFrame:
    return graph.closure(package_references(spark, sf).select(F.col("s").alias("src"), F.col("t").alias("dst")))


SCC_INNER = """, inner_edge AS (SELECT DISTINCT src, dst FROM sccedge WHERE src // 40 = dst // 40),
 far(a, b) AS (SELECT src, dst FROM inner_edge UNION SELECT f.a, e.dst FROM far f JOIN inner_edge e ON f.b = e.src)"""


@query(SCC_INNER + " SELECT src, dst FROM inner_edge e WHERE NOT EXISTS (SELECT 1 FROM inner_edge m JOIN far f ON f.a = m.dst WHERE m.src = e.src AND f.b = e.dst)")
def transitive_reduction(spark: SparkSession, sf: str) -> DataFrame:
    _, edges = scc_graph(spark, sf)
    edges = graph.cut(edges.select("src", "dst"))
    return graph.reduction(edges, graph.closure(edges))


@query(""", down(node) AS (SELECT node FROM node WHERE node % 10 = 7 UNION SELECT e.src FROM down d JOIN edge e ON e.dst = d.node) SELECT node FROM down""")
def downset(spark: SparkSession, sf: str) -> DataFrame:
    return graph.downset(graph.cut(ws.package_edges(spark, sf)), ws.package_costs(spark, sf).filter("node % 10 = 7"))


def passes_sql(node: str, edge: str, sched: str, rounds: int = 400) -> str:
    """Longest paths by as many rounds as a path has nodes at most (sf 0.1 has paths of 127 packages); every round has a row for each node."""
    half = lambda name, a, b: f"""{name}_e AS (SELECT {a} AS src, {b} AS dst FROM {edge} UNION ALL SELECT node, node FROM {node}),
 {name}(k, node, f) AS (SELECT 0, node, cost_ns FROM {node} UNION ALL SELECT {name}.k + 1, e.dst, CAST(max(n.cost_ns + CASE WHEN e.src = e.dst THEN 0 ELSE {name}.f END) AS BIGINT)
  FROM {name} JOIN {name}_e e ON e.src = {name}.node JOIN {node} n ON n.node = e.dst WHERE {name}.k < {rounds} GROUP BY {name}.k, e.dst)"""  # noqa: E731
    f, r = f"{sched}_f", f"{sched}_b"
    return f""", {half(f, "src", "dst")}, {half(r, "dst", "src")},
 {sched} AS (SELECT n.node, n.cost_ns, CAST(a.f - n.cost_ns AS BIGINT) AS start_ns, a.f AS finish_ns, CAST(b.f - n.cost_ns AS BIGINT) AS longest_from_ns,
  CAST((SELECT max(f) FROM {f} WHERE k = {rounds}) - a.f - b.f + n.cost_ns AS BIGINT) AS slack_ns FROM {node} n JOIN {f} a ON a.node = n.node AND a.k = {rounds} JOIN {r} b ON b.node = n.node AND b.k = {rounds})"""


PASSES = passes_sql("node", "edge", "sched")


@query(PASSES + " SELECT node, cost_ns, start_ns, finish_ns FROM sched")
def target_schedule_forward(spark: SparkSession, sf: str) -> DataFrame:
    return schedule.schedule(*package_graph(spark, sf)).select("node", "cost_ns", "start_ns", "finish_ns")


PREDS = """, fp AS (SELECT e.dst AS node, s.node AS p, row_number() OVER (PARTITION BY e.dst ORDER BY s.finish_ns DESC, s.node) AS k FROM edge e JOIN sched s ON s.node = e.src),
 bs AS (SELECT e.src AS node, s.node AS p, row_number() OVER (PARTITION BY e.src ORDER BY s.cost_ns + s.longest_from_ns DESC, s.node) AS k FROM edge e JOIN sched s ON s.node = e.dst)"""


@query(PASSES + PREDS + """ SELECT s.node, start_ns, finish_ns, longest_from_ns, slack_ns, slack_ns = 0 AS critical, fp.p AS forward_pred, bs.p AS backward_succ
 FROM sched s LEFT JOIN fp ON fp.node = s.node AND fp.k = 1 LEFT JOIN bs ON bs.node = s.node AND bs.k = 1""")
def target_schedule_full(spark: SparkSession, sf: str) -> DataFrame:
    return schedule.schedule(*package_graph(spark, sf)).drop("graph", "cost_ns")


@query(PASSES + """ SELECT max(finish_ns) AS critical_path_ns, CAST(sum(cost_ns) AS BIGINT) AS total_cost_ns, count(*) AS target_count, count(*) FILTER (slack_ns = 0) AS critical_count,
 round(sum(cost_ns) / max(finish_ns), 9) AS parallelism_ratio FROM sched""")
def schedule_summary(spark: SparkSession, sf: str) -> DataFrame:
    return schedule.summary(schedule.schedule(*package_graph(spark, sf))).drop("graph")


@query(PASSES + """ SELECT CAST(max(n) AS BIGINT) AS peak FROM (SELECT sum(d) OVER (ORDER BY tick) AS n FROM (SELECT tick, sum(d) AS d FROM (SELECT start_ns AS tick, 1 AS d FROM sched UNION ALL SELECT finish_ns, -1 FROM sched) GROUP BY tick))""")
def peak_parallelism(spark: SparkSession, sf: str) -> DataFrame:
    return schedule.peak(schedule.schedule(*package_graph(spark, sf))).select(F.col("peak").cast("long").alias("peak"))


@query()
def swim_lanes(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = package_graph(spark, sf)
    return schedule.lanes(schedule.schedule(nodes, edges), edges).drop("graph")


HEAT = SCC_INNER + """, sn AS (SELECT scc AS node, any_value(pkg) AS pkg, CAST(sum(cost_ns) AS BIGINT) AS cost_ns FROM scc GROUP BY scc),
 hf(k, node, f) AS (SELECT 0, node, cost_ns FROM sn UNION ALL SELECT hf.k + 1, e.dst, CAST(max(n.cost_ns + CASE WHEN e.src = e.dst THEN 0 ELSE hf.f END) AS BIGINT)
  FROM hf JOIN (SELECT src, dst FROM inner_edge UNION ALL SELECT node, node FROM sn) e ON e.src = hf.node JOIN sn n ON n.node = e.dst WHERE hf.k < 41 GROUP BY hf.k, e.dst),
 hb(k, node, f) AS (SELECT 0, node, cost_ns FROM sn UNION ALL SELECT hb.k + 1, e.src, CAST(max(n.cost_ns + CASE WHEN e.src = e.dst THEN 0 ELSE hb.f END) AS BIGINT)
  FROM hb JOIN (SELECT src, dst FROM inner_edge UNION ALL SELECT node, node FROM sn) e ON e.dst = hb.node JOIN sn n ON n.node = e.src WHERE hb.k < 41 GROUP BY hb.k, e.src)"""


@query(HEAT + """ SELECT sn.pkg AS graph, sn.node, CAST(hf.f - sn.cost_ns AS BIGINT) AS start_ns, hf.f AS finish_ns, CAST(max(hf.f) OVER (PARTITION BY sn.pkg) - hf.f - hb.f + sn.cost_ns AS BIGINT) AS slack_ns
 FROM sn JOIN hf ON hf.node = sn.node AND hf.k = 41 JOIN hb ON hb.node = sn.node AND hb.k = 41""")
def scc_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = scc_graph(spark, sf)
    return schedule.schedule(nodes, edges).select("graph", "node", "start_ns", "finish_ns", "slack_ns")


def scc_horizon_rows(spark: SparkSession, sf: str, scc: DataFrame | None = None) -> DataFrame:
    """Horizon of each component: the latest finish of the packages that it and those before it refer to. scc: the components, if they are known."""
    scc = graph.cut(scc_of(spark, sf)) if scc is None else scc
    nodes, edges = scc_graph(spark, sf, scc)
    finish = schedule.schedule(*package_graph(spark, sf)).select(F.col("node").alias("other"), "finish_ns")
    scc = scc.select(F.col("node").alias("s"), "graph", F.col("scc").alias("node"))
    out = ws.references(spark, sf).select("s", F.expr("t div 40").alias("other")).join(scc, "s").filter("other <> graph").join(finish, "other")
    own = out.groupBy("graph", "node").agg(F.max("finish_ns").alias("horizon"))
    return schedule.horizons(nodes, edges, own)


HORIZON = PASSES + HEAT + """, own AS (SELECT scc.scc AS node, max(sched.finish_ns) AS h FROM dep JOIN scc ON scc.id = dep.s JOIN sched ON sched.node = dep.t // 40 WHERE dep.t // 40 <> scc.pkg GROUP BY scc.scc),
 hz AS (SELECT sn.pkg AS graph, sn.node, CAST(greatest(coalesce(max(own.h), 0), coalesce((SELECT o.h FROM own o WHERE o.node = sn.node), 0)) AS BIGINT) AS horizon
  FROM sn LEFT JOIN far ON far.b = sn.node LEFT JOIN own ON own.node = far.a GROUP BY sn.pkg, sn.node)"""


@query(HORIZON + " SELECT graph, node, horizon FROM hz")
def scc_horizons(spark: SparkSession, sf: str) -> DataFrame:
    return scc_horizon_rows(spark, sf)


@query(HORIZON + " SELECT graph, node, dense_rank() OVER (PARTITION BY graph ORDER BY horizon) - 1 AS grp FROM hz")
def horizon_groups(spark: SparkSession, sf: str) -> DataFrame:
    return graph.dense_groups(scc_horizon_rows(spark, sf)).select("graph", "node", "grp")


def group_rows(spark: SparkSession, sf: str) -> DataFrame:
    """graph, grp and the sums that ratios need; a package's symbols fall into three groups by id here."""
    s = ws.symbols(spark, sf).withColumn("grp", F.col("id") % 3)
    g = s.groupBy(F.col("pkg").alias("graph"), "grp").agg(F.count("*").alias("symbol_count"), F.sum((F.col("symbol_type") == "impl").cast("long")).alias("impl_count"), F.sum("cost_ns").alias("attr_ns"))
    d = ws.references(spark, sf).select(F.expr("s div 40").alias("graph"), (F.col("s") % 3).alias("grp"), F.expr("t div 40").alias("other")).filter("graph <> other")
    used = d.groupBy("graph", "grp").agg(F.countDistinct("other").alias("dep_count"))
    every = d.groupBy("graph").agg(F.countDistinct("other").alias("all_deps"))
    g = g.join(used, ["graph", "grp"], "left").join(every, "graph", "left").na.fill(0, ["dep_count", "all_deps"])
    return costs.group_ratios(g)


RATIOS = """, gs AS (SELECT pkg AS graph, id % 3 AS grp, count(*) AS n, count(*) FILTER (symbol_type = 'impl') AS i, sum(cost_ns) AS a FROM sym GROUP BY ALL),
 gd AS (SELECT DISTINCT s // 40 AS graph, s % 3 AS grp, t // 40 AS other FROM dep WHERE s // 40 <> t // 40),
 gr AS (SELECT graph, grp, n / sum(n) OVER w AS sym_ratio, CASE WHEN sum(a) OVER w > 0 THEN a / sum(a) OVER w ELSE n / sum(n) OVER w END AS attr_ratio,
  CASE WHEN sum(i) OVER w > 0 THEN i / sum(i) OVER w ELSE n / sum(n) OVER w END AS impl_ratio,
  CASE WHEN (SELECT count(DISTINCT other) FROM gd WHERE gd.graph = gs.graph) > 0 THEN (SELECT count(DISTINCT other) FROM gd WHERE gd.graph = gs.graph AND gd.grp = gs.grp) / (SELECT count(DISTINCT other) FROM gd WHERE gd.graph = gs.graph) ELSE 1.0 END AS dep_ratio
  FROM gs WINDOW w AS (PARTITION BY graph))"""


@query(RATIOS + " SELECT graph, grp, round(sym_ratio, 9) AS sym_ratio, round(attr_ratio, 9) AS attr_ratio, round(impl_ratio, 9) AS impl_ratio, round(dep_ratio, 9) AS dep_ratio FROM gr")
def group_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return group_rows(spark, sf).select("graph", "grp", *[F.round(c, 9).alias(c) for c in ("sym_ratio", "attr_ratio", "impl_ratio", "dep_ratio")])


@query(RATIOS + """, es AS (SELECT pkg AS graph, label, CAST(sum(self_ns) AS BIGINT) AS ns FROM ev GROUP BY ALL), al AS (SELECT graph, grp, label,
 CAST(floor(ns * CASE WHEN label LIKE 'metadata\\_%' ESCAPE '\\' THEN dep_ratio ELSE sym_ratio END + 0.5) AS BIGINT) AS self_ns FROM es JOIN gr USING (graph)) SELECT graph, grp, label, self_ns FROM al WHERE self_ns <> 0""")
def event_allocation(spark: SparkSession, sf: str) -> DataFrame:
    events = ws.target_events(spark, sf).groupBy(F.col("pkg").alias("graph"), "label").agg(F.sum("self_ns").alias("self_ns"))
    return costs.allocated(group_rows(spark, sf), events)


X, Y = ["attr_ns", "meta_ns", "other_ns"], "wall_ns"


def fit_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Predictors in milliseconds, and a wall time that follows from them and the number of symbols."""
    p = predictor_rows(spark, sf)
    p = p.select("target", *[(F.col(c) / 1e6).alias(c) for c in X], "symbol_count")
    return p.withColumn(Y, 2 * F.col("attr_ns") + 3 * F.col("meta_ns") + F.col("other_ns") + F.col("target") % 7)


@query(PREDICTORS + """, m AS (SELECT attr_ns / 1e6 AS a, meta_ns / 1e6 AS b, other_ns / 1e6 AS c, 2 * attr_ns / 1e6 + 3 * meta_ns / 1e6 + other_ns / 1e6 + target % 7 AS y FROM pred),
 q AS (SELECT sum(a*a) aa, sum(a*b) ab, sum(a*c) ac, sum(b*b) bb, sum(b*c) bc, sum(c*c) cc, sum(a*y) ay, sum(b*y) by_, sum(c*y) cy FROM m),
 d AS (SELECT *, aa*(bb*cc-bc*bc) - ab*(ab*cc-bc*ac) + ac*(ab*bc-bb*ac) AS det FROM q)
 SELECT round((ay*(bb*cc-bc*bc) - ab*(by_*cc-bc*cy) + ac*(by_*bc-bb*cy)) / det, 4) AS coeff_attr, round((aa*(by_*cc-bc*cy) - ay*(ab*cc-bc*ac) + ac*(ab*cy-by_*ac)) / det, 3) AS coeff_meta,
 round((aa*(bb*cy-by_*bc) - ab*(ab*cy-by_*ac) + ay*(ab*bc-bb*ac)) / det, 3) AS coeff_other FROM d""")
def ols_fit(spark: SparkSession, sf: str) -> DataFrame:
    got = regression.ordinary(fit_rows(spark, sf), X, Y)
    c = got["coefficients"] if got else [0.0] * 3
    return spark.range(1).select(F.lit(round(c[0], 4)).alias("coeff_attr"), F.lit(round(c[1], 3)).alias("coeff_meta"), F.lit(round(c[2], 3)).alias("coeff_other"))


@query()
def robust_fit(spark: SparkSession, sf: str) -> DataFrame:
    got = regression.robust(fit_rows(spark, sf), X, Y)
    if not got:
        return spark.createDataFrame([], "coeff_attr double, coeff_meta double, coeff_other double, r_squared double, inlier_threshold double")
    return spark.createDataFrame([(*got["coefficients"], got["r_squared"], got["inlier_threshold"])], "coeff_attr double, coeff_meta double, coeff_other double, r_squared double, inlier_threshold double")


@query(PREDICTORS + """, r AS (SELECT target, attr_ns / 1e6 AS actual, 2 * (meta_ns / 1e6) AS predicted FROM pred)
 SELECT target, round(actual, 6) AS actual, round(predicted, 6) AS predicted, round(abs(actual - predicted), 6) AS abs_error, abs(actual - predicted) > 500 AS outlier FROM r""")
def rank_predictions(spark: SparkSession, sf: str) -> DataFrame:
    rows = predictor_rows(spark, sf).select("target", (F.col("attr_ns") / 1e6).alias("actual"), (F.col("meta_ns") / 1e6).alias("m"))
    got = regression.ranked(rows, F.col("actual"), 2 * F.col("m"), 500.0)
    return got.select("target", *[F.round(c, 6).alias(c) for c in ("actual", "predicted", "abs_error")], "outlier")


def profile_events(spark: SparkSession, sf: str) -> DataFrame:
    e = ws.table(spark, sf, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").alias("thread"), "event_id", F.col("event_type").alias("label"), us.alias("start_ns"), (us + F.round(F.col("value") * 60_000_000).cast("long")).alias("end_ns"))


PROFILE = """, pe AS (SELECT user_id AS thread, event_id, event_type AS label, epoch_us(ts) AS start_ns, epoch_us(ts) + CAST(round(value * 60000000) AS BIGINT) AS end_ns FROM events),
 par AS (SELECT c.event_id, p.event_id AS parent_id, row_number() OVER (PARTITION BY c.event_id ORDER BY p.start_ns DESC, p.end_ns, p.event_id DESC) AS k
  FROM pe c JOIN pe p ON p.thread = c.thread AND p.event_id <> c.event_id AND p.start_ns <= c.start_ns AND p.end_ns >= c.end_ns AND p.end_ns > c.start_ns
  AND (p.start_ns < c.start_ns OR p.end_ns > c.end_ns OR p.event_id < c.event_id)),
 kids AS (SELECT parent_id, sum(end_ns - start_ns) AS n FROM par JOIN pe USING (event_id) WHERE k = 1 GROUP BY parent_id)"""


@query(PROFILE + """ SELECT thread, pe.event_id, label, par.parent_id, CAST(greatest(0, end_ns - start_ns - coalesce(n, 0)) AS BIGINT) AS self_ns
 FROM pe LEFT JOIN par ON par.event_id = pe.event_id AND par.k = 1 LEFT JOIN kids ON kids.parent_id = pe.event_id""")
def profile_self_time(spark: SparkSession, sf: str) -> DataFrame:
    return profile.self_times(profile_events(spark, sf))


@query(PROFILE + " SELECT thread, CAST(max(end_ns) - min(start_ns) AS BIGINT) AS wall_ns FROM pe GROUP BY thread")
def profile_wall(spark: SparkSession, sf: str) -> DataFrame:
    e = profile_events(spark, sf)
    return profile.wall(e, profile.self_times(e))


@query(""", lib AS (SELECT 'pkg' || node || '/lib' AS target_id, node % 2 AS wall_ns, cost_ns FROM node), tst AS (SELECT 'pkg' || node || '/test' AS target_id, node % 3 AS wall_ns, cost_ns // 2 AS cost_ns, cost_ns AS lib_ns FROM node)
 SELECT target_id, wall_ns, cost_ns FROM lib UNION ALL SELECT target_id, wall_ns, cost_ns + CASE WHEN wall_ns = 0 THEN lib_ns ELSE 0 END FROM tst""")
def library_costs(spark: SparkSession, sf: str) -> DataFrame:
    n = ws.package_costs(spark, sf)
    name = lambda key: F.concat(F.lit("pkg"), F.col("node").cast("string"), F.lit("/" + key)).alias("target_id")
    return costs.with_library_cost(n.select(name("lib"), (F.col("node") % 2).alias("wall_ns"), "cost_ns").union(n.select(name("test"), F.col("node") % 3, F.expr("cost_ns div 2"))))


@query(" SELECT id, CAST(cost_ns * (id % 5) // 7 AS BIGINT) AS share_ns FROM sym")
def proportional_shares(spark: SparkSession, sf: str) -> DataFrame:
    return ws.symbols(spark, sf).select("id", costs.proportional_share(F.col("cost_ns"), F.col("id") % 5, F.lit(7)).alias("share_ns"))


@query(PASSES + " SELECT node, start_ns FROM sched WHERE slack_ns = 0")
def critical_targets(spark: SparkSession, sf: str) -> DataFrame:
    return schedule.schedule(*package_graph(spark, sf)).filter("critical").select("node", "start_ns")


def named_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    text = lambda c: F.col(c).cast("string").alias(c)
    s = ws.symbols(spark, sf)
    nodes = s.groupBy(F.col("pkg").cast("string").alias("node")).agg(F.sum("cost_ns").alias("cost_ns"), F.count("*").alias("symbol_count"))
    return nodes, ws.package_edges(spark, sf).select(text("src"), text("dst"))


def as_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    none = F.lit(None).cast("long")
    return nodes.select(F.col("node").alias("a"), F.lit(None).cast("string").alias("b"), "cost_ns", "symbol_count").union(edges.select("src", "dst", none, none))


@query()
def condense_partitions(spark: SparkSession, sf: str) -> DataFrame:
    scc = graph.cut(scc_of(spark, sf))
    nodes = one_graph(scc.groupBy(F.col("scc").alias("node")).agg(F.sum("cost_ns").alias("cost_ns")))
    edges = one_graph(graph.condensed_edges(ws.references(spark, sf), scc.select("node", "scc")))
    return partition.partitions(nodes, edges).select("node", "part")


SPLIT = SCC_INNER + """, moved(node) AS (SELECT DISTINCT scc FROM scc WHERE pkg = 3 AND scc % 10 = 4 UNION SELECT e.src FROM moved m JOIN inner_edge e ON e.dst = m.node),
 ms AS (SELECT CAST(coalesce(sum(cost_ns), 0) AS BIGINT) AS c, count(*) AS n FROM scc WHERE scc IN (SELECT node FROM moved)),
 nodes AS (SELECT CAST(pkg AS VARCHAR) AS a, CAST(sum(cost_ns) AS BIGINT) AS c, count(*) AS n FROM sym GROUP BY pkg), named AS (SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst FROM edge)"""


@query(SPLIT + """ SELECT a, CAST(NULL AS VARCHAR) AS b, CASE WHEN a = '3' THEN c - (SELECT c FROM ms) ELSE c END AS cost_ns, CASE WHEN a = '3' THEN n - (SELECT n FROM ms) ELSE n END AS symbol_count FROM nodes
 UNION ALL SELECT 'new', NULL, c, n FROM ms UNION ALL SELECT src, dst, NULL, NULL FROM (SELECT src, dst FROM named UNION SELECT src, 'new' FROM named WHERE dst = '3' UNION SELECT 'new', dst FROM named WHERE src = '3'
 UNION SELECT 'new', '3' WHERE EXISTS (SELECT 1 FROM inner_edge WHERE src IN (SELECT node FROM moved) AND dst NOT IN (SELECT node FROM moved)))""")
def apply_split(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = named_graph(spark, sf)
    scc = scc_of(spark, sf).filter("graph = 3")
    parts = graph.cut(scc.groupBy(F.col("scc").alias("node")).agg(F.sum("cost_ns").alias("cost_ns"), F.count("*").alias("symbol_count")))
    inner = graph.condensed_edges(ws.references(spark, sf), scc.select("node", "scc"))
    return as_rows(*rewire.split_target(nodes, edges, parts, graph.cut(inner), "3", "new", parts.filter("node % 10 = 4"))[:2])


SHATTER = HORIZON + """, grp AS (SELECT node, dense_rank() OVER (ORDER BY horizon) - 1 AS g FROM hz WHERE graph = 3), sg AS (SELECT scc.id, scc.cost_ns, g FROM scc JOIN grp ON grp.node = scc.scc),
 nm AS (SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst FROM edge)"""


@query(SHATTER + """ SELECT CAST(pkg AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS b, CAST(sum(cost_ns) AS BIGINT) AS cost_ns, count(*) AS symbol_count FROM sym WHERE pkg <> 3 GROUP BY pkg
 UNION ALL SELECT '3::group_' || g, NULL, CAST(sum(cost_ns) AS BIGINT), count(*) FROM sg GROUP BY g
 UNION ALL SELECT src, dst, NULL, NULL FROM (SELECT src, dst FROM nm WHERE src <> '3' AND dst <> '3' UNION SELECT '3::group_' || (SELECT max(g) FROM grp), dst FROM nm WHERE src = '3'
 UNION SELECT '3::group_' || b.g, '3::group_' || a.g FROM dep JOIN sg a ON a.id = s JOIN sg b ON b.id = t WHERE a.g <> b.g
 UNION SELECT CAST(t // 40 AS VARCHAR), '3::group_' || a.g FROM dep JOIN sg a ON a.id = s WHERE t // 40 <> 3 UNION SELECT '3::group_' || b.g, CAST(s // 40 AS VARCHAR) FROM dep JOIN sg b ON b.id = t WHERE s // 40 <> 3)""")
def shatter_graph(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = named_graph(spark, sf)
    scc = graph.cut(scc_of(spark, sf).filter("graph = 3"))
    grp = graph.dense_groups(scc_horizon_rows(spark, sf, scc)).select(F.col("node").alias("scc"), "grp")
    sym = graph.cut(scc.join(grp, "scc").select("node", "grp", "cost_ns"))
    groups = sym.groupBy("grp").agg(F.sum("cost_ns").alias("cost_ns"), F.count("*").alias("symbol_count"))
    e = ws.references(spark, sf)
    a, b = sym.select(F.col("node").alias("s"), F.col("grp").alias("to")), sym.select(F.col("node").alias("t"), F.col("grp").alias("at"))
    inner = e.join(a, "s").join(b, "t").select(F.col("at").alias("src"), F.col("to").alias("dst")).distinct()
    needs = e.join(a, "s").filter("t div 40 <> 3").select(F.col("to").alias("grp"), F.expr("string(t div 40)").alias("src")).distinct()
    used = e.join(b, "t").filter("s div 40 <> 3").select(F.col("at").alias("grp"), F.expr("string(s div 40)").alias("dst")).distinct()
    return as_rows(*rewire.shattered(nodes, edges, groups, inner, needs, used, "3"))


@query(""" SELECT symbol, CASE WHEN moved AND dep LIKE '[pkg3/lib]%' THEN '[new/lib]' || substr(dep, 11) ELSE dep END AS dep FROM (SELECT DISTINCT a.path AS symbol, b.path AS dep, b.pkg = 3 AND b.id % 2 = 0 AS moved FROM dep JOIN sym a ON a.id = s JOIN sym b ON b.id = t)""")
def export_split_deps(spark: SparkSession, sf: str) -> DataFrame:
    sym = ws.symbols(spark, sf)
    e = ws.references(spark, sf).join(sym.select(F.col("id").alias("s"), F.col("path").alias("symbol")), "s").join(sym.select(F.col("id").alias("t"), F.col("path").alias("dep")), "t").select("symbol", "dep")
    return rewire.moved_dependencies(e, sym.filter("pkg = 3 AND id % 2 = 0").select("path"), "pkg3/lib", "new/lib")
