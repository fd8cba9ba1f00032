"""Queries over names, attribution, charts and cost models of the derived workspace, and SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import drawing, paths, targets
from weftline.operators import attribution, costs, graph, regression, renaming, schedule
from weftline.sources import workspace as ws

from . import queries as q

query = q.query

STEPS = ", ".join(map(str, drawing.STEPS))


@query(q.PASSES + f""", c AS (SELECT *, CAST(floor(coalesce(220 * CAST(slack_ns AS DOUBLE) / (SELECT nullif(max(slack_ns), 0) FROM sched), 0) + 0.5) AS BIGINT) AS hue, slack_ns / 1e6 AS ms FROM sched)
 SELECT node, 'hsl(' || hue || ', 80%, 50%)' AS color,
  CAST(floor(255 * (0.5 - 0.4 * greatest(-1, least((hue / 30.0) % 12 - 3, 9 - (hue / 30.0) % 12, 1))) + 0.5) AS BIGINT) * 65536
  + CAST(floor(255 * (0.5 - 0.4 * greatest(-1, least((hue / 30.0 + 8) % 12 - 3, 9 - (hue / 30.0 + 8) % 12, 1))) + 0.5) AS BIGINT) * 256
  + CAST(floor(255 * (0.5 - 0.4 * greatest(-1, least((hue / 30.0 + 4) % 12 - 3, 9 - (hue / 30.0 + 4) % 12, 1))) + 0.5) AS BIGINT) AS rgb,
  CASE WHEN ms < 1000 THEN CAST(floor(ms + 0.5) AS BIGINT) || 'ms' WHEN ms < 60000 THEN printf('%.1f', floor(ms / 100 + 0.5) / 10) || 's' WHEN CAST(floor((ms / 1000) % 60 + 0.5) AS BIGINT) = 0 THEN CAST(floor(ms / 60000) AS BIGINT) || 'm'
   ELSE CAST(floor(ms / 60000) AS BIGINT) || 'm ' || CAST(floor((ms / 1000) % 60 + 0.5) AS BIGINT) || 's' END AS slack,
  CAST(coalesce((SELECT min(s) FROM (SELECT unnest([{STEPS}]) AS s) WHERE s >= 100 / (0.001 * (node % 7 + 1))), 600000) AS INTEGER) AS step,
  round(ms * 0.25, 6) AS x, node * 20 AS y, contains(lower('Pkg' || node), 'g1') AS found, node * 20 BETWEEN 40 AND 400 AND node BETWEEN 3 AND 30 AS inside FROM c""")
def chart_rows(spark: SparkSession, sf: str) -> DataFrame:
    s = schedule.schedule(*q.package_graph(spark, sf)).select("graph", "node", "slack_ns")
    s = s.join(s.groupBy("graph").agg(F.max("slack_ns").alias("most")), "graph")
    ms, color = F.col("slack_ns") / 1e6, drawing.slack_color(F.col("slack_ns"), F.col("most"))
    y = drawing.lane_to_y(F.col("node"), F.lit(20))
    return s.select("node", color.alias("color"), drawing.packed_rgb(color).alias("rgb"), drawing.short_duration(ms).alias("slack"), drawing.time_step(0.001 * (F.col("node") % 7 + 1)).alias("step"), F.round(drawing.time_to_x(ms, F.lit(0.25)), 6).alias("x"), y.alias("y"), drawing.matches(F.concat(F.lit("Pkg"), F.col("node").cast("string")), "G1").alias("found"), drawing.inside(F.col("node"), y, F.lit(3), F.lit(40), F.lit(30), F.lit(400)).alias("inside"))


@query(""" SELECT id, CASE WHEN symbol_type = 'impl' THEN 'impl' ELSE 'function' END AS label, CASE WHEN symbol_type = 'impl' THEN 'impl A&lt;&#39;x&gt; for ' || name ELSE name END AS shown,
 CASE WHEN symbol_type <> 'impl' AND id % 2 = 0 THEN '<span class="tree-vis">pub</span>' ELSE '' END AS badge, CASE WHEN length(path) <= 18 THEN path ELSE substr(path, 1, 15) || '...' END AS short FROM sym""")
def symbol_labels(spark: SparkSession, sf: str) -> DataFrame:
    s, kind = ws.symbols(spark, sf), F.col("symbol_type")
    shown = drawing.escaped(drawing.display_name(kind, F.col("name"), F.concat(F.lit("impl A<'x> for "), "name")))
    visible = F.when((kind != "impl") & (F.col("id") % 2 == 0), "public")
    return s.select("id", drawing.kind_label(kind, F.lit("Function")).alias("label"), shown.alias("shown"), drawing.badge(visible).alias("badge"), drawing.shortened(F.col("path"), 18).alias("short"))


@query(q.PASSES + q.PREDS + """, who AS (SELECT s.node, fp.p AS pred, bs.p AS succ FROM sched s LEFT JOIN fp ON fp.node = s.node AND fp.k = 1 LEFT JOIN bs ON bs.node = s.node AND bs.k = 1),
 up(node, d) AS (SELECT 3, 0 UNION ALL SELECT w.pred, d - 1 FROM up JOIN who w ON w.node = up.node WHERE w.pred IS NOT NULL),
 dn(node, d) AS (SELECT 3, 0 UNION ALL SELECT w.succ, d + 1 FROM dn JOIN who w ON w.node = dn.node WHERE w.succ IS NOT NULL)
 SELECT d - (SELECT min(d) FROM up) AS step, CAST(node AS BIGINT) AS node FROM (SELECT node, d FROM up UNION SELECT node, d FROM dn)""")
def path_through_package(spark: SparkSession, sf: str) -> DataFrame:
    return schedule.path_through(schedule.schedule(*q.package_graph(spark, sf)), 3).select("step", "node")


#: Raw paths as a profiler writes them, and what they stand for.
RAW = """, rawp AS (SELECT id, 'w::' || module_path || '::' || name AS own, 'w::' || module_path AS m, id % 12 AS k FROM sym),
 raws AS (SELECT id, own, m, k, CASE k WHEN 0 THEN own WHEN 1 THEN own || '::{{closure}}[1]' WHEN 2 THEN own || '::_[2]::x' WHEN 3 THEN m || '::{{impl}}[3]::go' WHEN 4 THEN 'DefId(0:1)::x' WHEN 5 THEN m || '::Type::field' WHEN 6 THEN 'alone'
  WHEN 7 THEN own || '::{{opaque}}::{{closure}}' WHEN 8 THEN own || '::T' WHEN 9 THEN m || '::_[1]::{{impl}}[2]::f' WHEN 10 THEN m || '::{{closure}}::{{impl}}::f' ELSE 'other::p' || id END AS raw,
  CASE WHEN k IN (0, 1, 2, 7, 8) THEN own WHEN k = 3 THEN m || '::{{impl}}[3]' WHEN k IN (4, 6) THEN '' WHEN k = 5 THEN m || '::Type' WHEN k IN (9, 10) THEN m ELSE 'other::p' || id END AS path FROM rawp)"""


def raw_paths(spark: SparkSession, sf: str) -> DataFrame:
    """id, own (path below the crate w), m (its module), raw."""
    s = ws.symbols(spark, sf)
    m = F.concat(F.lit("w::"), "module_path")
    own, k, with_ = F.concat(m, F.lit("::"), "name"), F.col("id") % 12, lambda a, b: F.concat(a, F.lit(b))
    forms = [own, with_(own, "::{{closure}}[1]"), with_(own, "::_[2]::x"), with_(m, "::{{impl}}[3]::go"), F.lit("DefId(0:1)::x"), with_(m, "::Type::field"), F.lit("alone"), with_(own, "::{{opaque}}::{{closure}}"), with_(own, "::T"), with_(m, "::_[1]::{{impl}}[2]::f"), with_(m, "::{{closure}}::{{impl}}::f"), F.concat(F.lit("other::"), "name")]
    return s.select("id", own.alias("own"), m.alias("m"), F.get(F.array(*forms), k.cast("int")).alias("raw"))


@query(RAW + " SELECT id, raw, path, CASE WHEN starts_with(path, 'w::') THEN path END AS local FROM raws")
def symbol_level_paths(spark: SparkSession, sf: str) -> DataFrame:
    r = raw_paths(spark, sf)
    return r.select("id", "raw", attribution.symbol_level(F.col("raw")).alias("path"), attribution.local_path(F.col("raw"), F.lit("w::")).alias("local"))


#: Nested events with a raw path each; parents as in profile_self_time.
NESTED = q.PROFILE + RAW + """, st AS (SELECT pe.event_id, par.parent_id, CASE WHEN pe.event_id % 5 = 0 THEN 'self_profile_x' ELSE label END AS label, CAST(greatest(0, end_ns - start_ns - coalesce(n, 0)) AS BIGINT) AS self_ns,
  CASE WHEN pe.event_id % 3 = 0 THEN raws.path END AS path FROM pe LEFT JOIN par ON par.event_id = pe.event_id AND par.k = 1 LEFT JOIN kids ON kids.parent_id = pe.event_id LEFT JOIN raws ON raws.id = pe.event_id % 200),
 known AS (SELECT own AS path FROM raws WHERE id % 2 = 0), loc AS (SELECT event_id, parent_id, label, self_ns, CASE WHEN path IN (SELECT path FROM known) THEN path END AS path FROM st),
 climb(event_id, up, path) AS (SELECT event_id, CASE WHEN path IS NULL THEN parent_id END, path FROM loc UNION ALL SELECT c.event_id, CASE WHEN l.path IS NULL THEN l.parent_id END, l.path FROM climb c JOIN loc l ON l.event_id = c.up),
 rec AS (SELECT loc.event_id, label, self_ns, (SELECT max(c.path) FROM climb c WHERE c.event_id = loc.event_id) AS path FROM loc WHERE NOT starts_with(label, 'self_profile_'))"""


def located_events(spark: SparkSession, sf: str) -> DataFrame:
    """Profile events, every third with the symbol of the raw path whose id is the event's modulo 200."""
    raw, i = raw_paths(spark, sf), F.col("event_id")
    used = raw.filter("id > -200 and id < 200").select(F.col("id").alias("r"), "raw")  # all remainders
    at = attribution.located(used, raw.filter("id % 2 = 0").select(F.col("own").alias("path")), "w::").drop("raw")
    e = q.profile_events(spark, sf).withColumn("label", F.when(i % 5 == 0, "self_profile_x").otherwise(F.col("label")))
    return e.join(F.broadcast(at), (i % 200 == F.col("r")) & (i % 3 == 0), "left").drop("r")


@query(NESTED + " SELECT path, label, CAST(sum(self_ns) AS BIGINT) AS self_ns FROM rec GROUP BY path, label")
def event_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return attribution.attributed(attribution.recorded(located_events(spark, sf)))


#: Costs of paths around the symbols: their own, below one, in a module, of another crate.
LOST = RAW + """, cost AS (SELECT CASE id % 4 WHEN 0 THEN own WHEN 1 THEN 'w::' || 'm' || (id // 10) || '::p' || (id - 1) || '::inner::deep' WHEN 2 THEN m ELSE 'other::x' END AS path, 'l' || id % 3 AS label, id * 10 AS self_ns FROM raws),
 known AS (SELECT own AS path FROM raws WHERE id % 4 = 0), place AS (SELECT path, label, self_ns, CASE WHEN path IN (SELECT path FROM known) OR NOT starts_with(path, 'w::') THEN path
  WHEN ends_with(path, '::inner::deep') AND replace(path, '::inner::deep', '') IN (SELECT path FROM known) THEN replace(path, '::inner::deep', '') END AS spot FROM cost)"""


def lost_costs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    r, k = raw_paths(spark, sf), F.col("id") % 4
    below = F.concat(F.lit("w::m"), F.expr("id div 10").cast("string"), F.lit("::p"), (F.col("id") - 1).cast("string"), F.lit("::inner::deep"))
    path = F.when(k == 0, F.col("own")).when(k == 1, below).when(k == 2, F.col("m")).otherwise("other::x")
    c = r.select(path.alias("path"), F.concat(F.lit("l"), (F.col("id") % 3).cast("string")).alias("label"), (F.col("id") * 10).alias("self_ns"))
    return attribution.rolled_up(c, r.filter("id % 4 = 0").select(F.col("own").alias("path")), r.select(F.col("m").alias("path")), "w::")


@query(LOST + " SELECT spot AS path, label, CAST(sum(self_ns) AS BIGINT) AS self_ns FROM place WHERE spot IS NOT NULL GROUP BY spot, label")
def rolled_up_costs(spark: SparkSession, sf: str) -> DataFrame:
    return lost_costs(spark, sf)[0]


@query(LOST + """ SELECT 'p' || chr(9) || 'lib' || chr(9) || 'c' || chr(9) || CASE WHEN path IN (SELECT m FROM raws) THEN 'module' ELSE 'unmatched' END || chr(9) || path || chr(9) || printf('%.6f', sum(self_ns) / 1e6) AS line FROM place WHERE spot IS NULL GROUP BY path""")
def unmatched_report(spark: SparkSession, sf: str) -> DataFrame:
    return attribution.unmatched_lines(lost_costs(spark, sf)[1], "p", "lib", "c")


@query(LOST + """ SELECT id, list_sort(list(label || '=' || ns) FILTER (label IS NOT NULL)) AS events FROM raws LEFT JOIN (SELECT spot, label, CAST(sum(self_ns) AS BIGINT) AS ns FROM place GROUP BY ALL) ON spot = own GROUP BY id""")
def symbol_event_times(spark: SparkSession, sf: str) -> DataFrame:
    s = raw_paths(spark, sf).select("id", F.replace("own", F.lit("_"), F.lit("-")).alias("path"))
    got = attribution.event_times(s, lost_costs(spark, sf)[0])
    return got.select("id", F.transform(F.map_entries("events"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))).alias("events"))


@query(""" SELECT id, CASE id % 6 WHEN 0 THEN 'lib' WHEN 1 THEN 'bin/x' || id WHEN 2 THEN 'test' WHEN 3 THEN 'test/x' || id WHEN 4 THEN 'bench/x' ELSE 'lib' END AS by_file,
 CASE id % 5 WHEN 0 THEN 'lib' WHEN 1 THEN 'lib' WHEN 2 THEN 'bin/n' || id WHEN 3 THEN 'example/n' || id END AS by_kind, id % 3 = 1 AS metadata_only,
 CASE id % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'bench' WHEN 2 THEN 'example' END AS by_source FROM sym""")
def target_keys(spark: SparkSession, sf: str) -> DataFrame:
    i, text = F.col("id"), F.col("id").cast("string")
    pick = lambda n, *of: F.get(F.array(*of), (i % n).cast("int"))
    join = lambda *of: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in of])
    stem = pick(6, F.lit("c"), join("c_bin_x", text), F.lit("c_test"), join("c_test_x", text), F.lit("c_bench_x"), F.lit("other_bin_x"))
    kind = pick(5, *map(F.lit, ("lib", "proc-macro", "bin", "example", "custom-build")))
    emit = pick(3, *map(F.lit, ("metadata,link", " metadata , dep-info", "dep-info")))
    source = pick(4, *map(F.lit, ("a/tests/x.rs", "benches/x.rs", "a\\examples\\x.rs", "a/src/x.rs")))
    return ws.symbols(spark, sf).select("id", targets.by_file(stem, F.lit("c")).alias("by_file"), targets.by_kind(kind, join("n", text)).alias("by_kind"), targets.metadata_only(emit).alias("metadata_only"), targets.kind_by_source(source).alias("by_source"))


MAPPING = """, tg AS (SELECT DISTINCT 'pkg-' || pkg AS package, 'lib' AS kind, 'pkg-' || pkg AS name FROM sym WHERE pkg % 3 <> 0 UNION SELECT DISTINCT 'pkg-' || pkg, 'bin', 'tool-' || pkg % 4 FROM sym UNION SELECT DISTINCT 'pkg-' || pkg, 'custom-build', 'b' FROM sym),
 mp AS (SELECT crate, target_id FROM (SELECT *, row_number() OVER (PARTITION BY crate ORDER BY r, target_id) AS k FROM (SELECT replace(name, '-', '_') AS crate, CASE kind WHEN 'lib' THEN package || '/lib' ELSE package || '/bin/' || name END AS target_id, CASE kind WHEN 'lib' THEN 0 ELSE 1 END AS r FROM tg WHERE kind <> 'custom-build'
  UNION SELECT replace(package, '-', '_'), package || '/lib', 2 FROM tg)) WHERE k = 1)"""


def mapping(spark: SparkSession, sf: str) -> DataFrame:
    p = ws.symbols(spark, sf).select("pkg").distinct().select("pkg", F.concat(F.lit("pkg-"), F.col("pkg").cast("string")).alias("package"))
    lib = p.filter("pkg % 3 <> 0").select("package", F.lit("lib").alias("kind"), F.col("package").alias("name"))
    tool = p.select("package", F.lit("bin"), F.concat(F.lit("tool-"), (F.col("pkg") % 4).cast("string")))
    return targets.crate_mapping(lib.union(tool).union(p.select("package", F.lit("custom-build"), F.lit("b"))))


@query(MAPPING + " SELECT crate, target_id FROM mp")
def crate_mapping(spark: SparkSession, sf: str) -> DataFrame:
    return mapping(spark, sf)


@query(MAPPING + """, ref AS (SELECT DISTINCT 'pkg-' || a.pkg AS package, b.pkg AS bp, b.id AS bid, CASE WHEN (s + t) % 5 = 0 THEN 'serde::x' WHEN (s + t) % 5 = 1 THEN 'pkg_' || b.pkg || '::' || b.module_path ELSE 'pkg_' || b.pkg || '::' || b.module_path || '::' || b.name END AS dep FROM dep JOIN sym a ON a.id = s JOIN sym b ON b.id = t)
 SELECT DISTINCT package, dep, CASE WHEN dep = 'serde::x' THEN dep WHEN package <> 'pkg-' || bp THEN '[pkg-' || bp || '/lib]' || substr(dep, position('::' IN dep))
  WHEN dep NOT LIKE '%::p%' THEN '[pkg-' || bp || '/' || (SELECT min(CASE WHEN x.id % 2 = 0 THEN 'lib' ELSE 'test' END) FROM sym x WHERE x.module_path = split_part(dep, '::', 2)) || ']' || substr(dep, position('::' IN dep))
  ELSE '[pkg-' || bp || '/' || CASE WHEN bid % 2 = 0 THEN 'lib' ELSE 'test' END || ']' || substr(dep, position('::' IN dep)) END AS path FROM ref""")
def retargeted_paths(spark: SparkSession, sf: str) -> DataFrame:
    s = ws.symbols(spark, sf)
    a, b = s.select(F.col("id").alias("s"), F.col("pkg").alias("ap")), s.select(F.col("id").alias("t"), F.col("pkg").alias("bp"), "module_path", "name")
    name, k = lambda c: F.concat(F.lit("pkg-"), F.col(c).cast("string")), (F.col("s") + F.col("t")) % 5
    crate = F.concat(F.lit("pkg_"), F.col("bp").cast("string"), F.lit("::"), "module_path")
    refs = ws.references(spark, sf).join(a, "s").join(b, "t").select(name("ap").alias("package"), F.when(k == 0, "serde::x").when(k == 1, crate).otherwise(F.concat(crate, F.lit("::"), "name")).alias("dep")).distinct()
    at = s.select(name("pkg").alias("package"), F.when(F.col("id") % 2 == 0, "lib").otherwise("test").alias("target"), "module_path", "name")
    return renaming.retargeted(refs, mapping(spark, sf), at.select("package", "target", F.concat("module_path", F.lit("::"), "name").alias("rest")), at.select("package", "target", F.col("module_path").alias("rest")).distinct())


MERGED = """, mg AS (SELECT id, 'group' || pkg % 5 AS package, target_id, cost_ns, '[' || target_id || ']::m::p' || id % 50 AS old, 'p' || id % 50 AS n FROM sym),
 mn AS (SELECT old, '[' || package || '/synthetic]::m::' || CASE WHEN count(*) OVER (PARTITION BY package, n) > 1 THEN 'conflict_from_' || replace(target_id, '/', '_') || '::' ELSE '' END || n AS new FROM mg)"""


def merged_symbols(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("["), "target_id", F.lit("]::m::p"), (F.col("id") % 50).cast("string"))
    return ws.symbols(spark, sf).select("id", F.concat(F.lit("group"), (F.col("pkg") % 5).cast("string")).alias("package"), "target_id", "cost_ns", path.alias("path"))


@query(MERGED + " SELECT old, new FROM mn")
def merged_paths(spark: SparkSession, sf: str) -> DataFrame:
    return renaming.merged_paths(merged_symbols(spark, sf))


@query(MERGED + " SELECT DISTINCT a.new AS src, b.new AS dep FROM dep JOIN mg x ON x.id = s JOIN mg y ON y.id = t JOIN mn a ON a.old = x.old JOIN mn b ON b.old = y.old")
def merged_references(spark: SparkSession, sf: str) -> DataFrame:
    m = merged_symbols(spark, sf)
    e = ws.references(spark, sf).join(m.select(F.col("id").alias("s"), F.col("path").alias("src")), "s").join(m.select(F.col("id").alias("t"), F.col("path").alias("dep")), "t")
    return renaming.renamed(e, renaming.merged_paths(m))


@query(q.PREDICTORS + MERGED + """ SELECT package || '/synthetic' AS target_id, count(*) AS symbol_count, CAST(sum(cost_ns) AS BIGINT) AS attr_ns, max(meta_ns) AS meta_ns, max(other_ns) AS other_ns,
 coalesce((SELECT list_sort(list(DISTINCT y.package || '/synthetic')) FROM dep JOIN mg x ON x.id = s JOIN mg y ON y.id = t WHERE x.package = mg.package AND y.package <> x.package), []) AS deps FROM mg JOIN pred ON 'pkg' || pred.target || '/lib' = target_id GROUP BY package""")
def synthetic_targets(spark: SparkSession, sf: str) -> DataFrame:
    p = q.predictor_rows(spark, sf).select(ws.target_of(F.col("target")).alias("target_id"), "meta_ns", "other_ns")
    return renaming.merged_targets(merged_symbols(spark, sf), ws.references(spark, sf), p)


@query(""" SELECT a.path AS symbol, list_sort(list(b.target_id)) AS targets FROM dep JOIN sym a ON a.id = s JOIN sym b ON b.id = t WHERE a.pkg <> b.pkg GROUP BY a.path""")
def external_targets(spark: SparkSession, sf: str) -> DataFrame:
    s = ws.symbols(spark, sf)
    d = ws.references(spark, sf).join(s.select(F.col("id").alias("s"), F.col("path").alias("symbol"), F.concat(F.lit("["), "target_id", F.lit("]")).alias("prefix")), "s").join(s.select(F.col("id").alias("t"), F.col("path").alias("dep")), "t")
    return graph.external_targets(d)


@query(q.PREDICTORS + """, td AS (SELECT DISTINCT dst AS pkg, src AS dep FROM edge), used AS (SELECT s, count(*) AS n FROM dep WHERE t // 40 <> s // 40 GROUP BY s), nd AS (SELECT pkg, count(*) AS n FROM td GROUP BY pkg)
 SELECT id AS symbol, sym.cost_ns AS attr_ns, CAST(coalesce(meta_ns * used.n // nd.n, 0) AS BIGINT) AS meta_ns, CAST(coalesce(other_ns * used.n // nd.n, 0) AS BIGINT) AS other_ns FROM sym JOIN pred ON pred.target = pkg LEFT JOIN used ON used.s = id LEFT JOIN nd ON nd.pkg = sym.pkg""")
def symbol_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    s = ws.symbols(spark, sf).select(F.col("id").alias("symbol"), F.col("pkg").alias("target"), "cost_ns")
    deps = ws.package_edges(spark, sf).groupBy(F.col("dst").alias("target")).agg(F.collect_set("src").alias("deps"))
    t = q.predictor_rows(spark, sf).select("target", "meta_ns", "other_ns").join(deps, "target", "left")
    used = ws.references(spark, sf).filter("t div 40 <> s div 40").select(F.col("s").alias("symbol"), F.expr("t div 40").alias("dep"))
    return costs.symbol_breakdown(s, used, t)


@query(""" SELECT pkg AS graph, id % 3 AS grp, count(*) + CASE WHEN id % 3 = (SELECT min(y.id % 3) FROM sym y WHERE y.pkg = sym.pkg) THEN 5 ELSE 0 END AS symbol_count FROM sym GROUP BY pkg, id % 3""")
def groups_with_extras(spark: SparkSession, sf: str) -> DataFrame:
    s = ws.symbols(spark, sf)
    return costs.with_extra_symbols(s.groupBy(F.col("pkg").alias("graph"), (F.col("id") % 3).alias("grp")).agg(F.count("*").alias("symbol_count")), s.groupBy(F.col("pkg").alias("graph")).agg((F.count("*") + 5).alias("symbol_count")))


#: Wall times that follow from the predictors; every fifth target has none, and one in three is a test.
FIT = q.PREDICTORS + """, fm AS (SELECT 'pkg' || target || CASE WHEN target % 3 = 1 THEN '/test' ELSE '/lib' END AS target_id, attr_ns / 1e6 AS a, meta_ns / 1e6 AS b, other_ns / 1e6 AS c,
  CASE WHEN target % 5 = 4 THEN 0 ELSE 2 * (attr_ns / 1e6) + 3 * (meta_ns / 1e6) + other_ns / 1e6 + target % 7 END AS y FROM pred)"""
MODEL = [2.0, 2.5, 1.5]


def fit_targets(spark: SparkSession, sf: str) -> DataFrame:
    p = q.predictor_rows(spark, sf).select("target", *[(F.col(c) / 1e6).alias(c) for c in q.X])
    name = F.concat(F.lit("pkg"), F.col("target").cast("string"), F.when(F.col("target") % 3 == 1, "/test").otherwise("/lib"))
    wall = F.when(F.col("target") % 5 == 4, 0.0).otherwise(2 * F.col("attr_ns") + 3 * F.col("meta_ns") + F.col("other_ns") + F.col("target") % 7)
    return p.select(name.alias("target_id"), *q.X, wall.alias("wall_ms"), wall.alias("wall_ns"))


@query(FIT + " SELECT target_id, y AS wall_ms FROM fm WHERE y > 0 AND target_id LIKE '%/lib'")
def fitting_rows(spark: SparkSession, sf: str) -> DataFrame:
    return regression.fitting_rows(fit_targets(spark, sf), True).select("target_id", "wall_ms")


@query(FIT + """, q AS (SELECT sum(a*a) aa, sum(a*b) ab, sum(a*c) ac, sum(b*b) bb, sum(b*c) bc, sum(c*c) cc, sum(a*y) ay, sum(b*y) by_, sum(c*y) cy FROM fm WHERE y > 0),
 d AS (SELECT *, aa*(bb*cc-bc*bc) - ab*(ab*cc-bc*ac) + ac*(ab*bc-bb*ac) AS det FROM q),
 k AS (SELECT (ay*(bb*cc-bc*bc) - ab*(by_*cc-bc*cy) + ac*(by_*bc-bb*cy)) / det AS x, (aa*(by_*cc-bc*cy) - ay*(ab*cc-bc*ac) + ac*(ab*cy-by_*ac)) / det AS z, (aa*(bb*cy-by_*bc) - ab*(ab*cy-by_*ac) + ay*(ab*bc-bb*ac)) / det AS w FROM d)
 SELECT round(1 - sum((y - x*a - z*b - w*c) * (y - x*a - z*b - w*c)) / sum(y*y), 6) AS r_squared FROM fm, k WHERE y > 0""")
def ols_r2(spark: SparkSession, sf: str) -> DataFrame:
    got = regression.ordinary(regression.fitting_rows(fit_targets(spark, sf), False), q.X, "wall_ms")
    return spark.createDataFrame([(round(got["r_squared"], 6),)] if got else [], "r_squared double")


@query(FIT + " SELECT target_id, round(CASE WHEN y > 0 THEN y ELSE a END, 6) AS effective, round(2 * a + 2.5 * b + 1.5 * c, 6) AS modelled FROM fm")
def target_costs(spark: SparkSession, sf: str) -> DataFrame:
    t = fit_targets(spark, sf)
    a, b = regression.target_costs(t, q.X, None), regression.target_costs(t, q.X, MODEL).withColumnRenamed("cost_ms", "modelled")
    return a.join(b, "target_id").select("target_id", F.round("cost_ms", 6).alias("effective"), F.round("modelled", 6).alias("modelled"))


def seconds(x: str) -> str:
    """SQL for a duration in text, from milliseconds."""
    s = f"CAST(floor((floor(abs({x}) + 0.5) + 500) / 1000) AS BIGINT)"
    unit = lambda v, u: f"CASE WHEN {v} > 0 THEN {v} || '{u}' END"
    return f"CASE WHEN floor(abs({x}) + 0.5) = 0 THEN '0s' ELSE CASE WHEN {x} < 0 THEN '-' ELSE '' END || CASE WHEN floor(abs({x}) + 0.5) < 1000 THEN CAST(floor(abs({x}) + 0.5) AS BIGINT) || 'ms' ELSE concat_ws(' ', {unit(f'({s} // 3600)', 'h')}, {unit(f'({s} // 60 % 60)', 'm')}, {unit(f'({s} % 60)', 's')}) END END"


@query(FIT + f""", pr AS (SELECT target_id, y, 2 * a + 2.5 * b + 1.5 * c AS p FROM fm WHERE y > 0)
 SELECT target_id, round(abs(p - y), 6) AS abs_error, rpad(target_id, 35, ' ') || ' ' || lpad({seconds("y")}, 9, ' ') || ' ' || lpad({seconds("p")}, 9, ' ') || ' ' || lpad({seconds("(p - y)")}, 9, ' ') || ' ' || CASE WHEN abs(p - y) > 500 THEN '  *' ELSE '   ' END AS line FROM pr""")
def validation_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = fit_targets(spark, sf).withColumn("predicted", regression.prediction(q.X, MODEL))
    return regression.validation(rows, 500.0).select("target_id", F.round("abs_error", 6).alias("abs_error"), "line")


#: The shattered graph of shatter_graph, and its schedule.
SHATTERED = q.SHATTER + """, sx AS (SELECT CAST(pkg AS VARCHAR) AS node, CAST(sum(cost_ns) AS BIGINT) AS cost_ns FROM sym WHERE pkg <> 3 GROUP BY pkg UNION ALL SELECT '3::group_' || g, CAST(sum(cost_ns) AS BIGINT) FROM sg GROUP BY g),
 se AS (SELECT src, dst FROM nm WHERE src <> '3' AND dst <> '3' UNION SELECT '3::group_' || (SELECT max(g) FROM grp), dst FROM nm WHERE src = '3'
 UNION SELECT '3::group_' || b.g, '3::group_' || a.g FROM dep JOIN sg a ON a.id = s JOIN sg b ON b.id = t WHERE a.g <> b.g
 UNION SELECT CAST(t // 40 AS VARCHAR), '3::group_' || a.g FROM dep JOIN sg a ON a.id = s WHERE t // 40 <> 3 UNION SELECT '3::group_' || b.g, CAST(s // 40 AS VARCHAR) FROM dep JOIN sg b ON b.id = t WHERE s // 40 <> 3)""" + q.passes_sql("sx", "se", "ssched")


@query(SHATTERED + " SELECT node, cost_ns, start_ns, finish_ns, slack_ns FROM ssched")
def shatter_schedule(spark: SparkSession, sf: str) -> DataFrame:
    rows = graph.cut(q.shatter_graph(spark, sf))
    nodes = q.one_graph(rows.filter("b is null").select(F.col("a").alias("node"), "cost_ns"))
    edges = q.one_graph(rows.filter("b is not null").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return schedule.schedule(nodes, edges).select("node", "cost_ns", "start_ns", "finish_ns", "slack_ns")


@query(""" SELECT id, '[' || target_id || ']::' || module_path || '::' || name AS path, 'pkg' || pkg || '/lib' AS target, module_path || '::' || name AS inner_path, name = 'p0' AS self_profile FROM sym""")
def path_builders(spark: SparkSession, sf: str) -> DataFrame:
    s = ws.symbols(spark, sf)
    label = F.when(F.col("name") == "p0", "self_profile_x").otherwise("typeck")
    return s.select("id", paths.symbol_path(F.col("target_id"), F.col("module_path"), F.col("name")).alias("path"), paths.target_id(F.col("target_id")).alias("target"), paths.child(F.col("module_path"), F.col("name")).alias("inner_path"), paths.is_self_profile(label).alias("self_profile"))
