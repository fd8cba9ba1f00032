"""A build workspace derived from the order tables, for checking operators against SQL.

A part is a symbol; ten parts are a module and forty a package. Returned line items of small
quantity are references: up to 12 within the block of ten (so cycles stay in a block), from 13
to 16 to a smaller part (so packages form an acyclic graph). Events are compiler time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def target_of(pkg):
    return F.concat(F.lit("pkg"), pkg.cast("string"), F.lit("/lib"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, pkg, block, target_id, module_path, name, path, symbol_type, cost_ns."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    p = p.withColumn("pkg", F.expr("id div 40")).withColumn("block", F.expr("id div 10"))
    p = p.withColumn("target_id", target_of(F.col("pkg"))).withColumn("module_path", F.concat(F.lit("m"), F.col("block").cast("string"))).withColumn("name", F.concat(F.lit("p"), F.col("id").cast("string")))
    path = F.concat(F.lit("["), "target_id", F.lit("]::"), "module_path", F.lit("::"), "name")
    return p.select("id", "pkg", "block", "target_id", "module_path", "name", path.alias("path"), F.when(F.col("id") % 7 == 0, "impl").otherwise("module_def").alias("symbol_type"), (F.col("p_size").cast("long") * 1000000).alias("cost_ns"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s, t: symbol s refers to symbol t (dependent, dependency); distinct, no loops."""
    l = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A' AND l_partkey > 0 AND l_quantity <= 16 AND (l_quantity <= 12 OR l_quantity >= 13)")
    t = F.when(F.col("l_quantity") <= 12, F.expr("(l_partkey div 10) * 10 + (l_orderkey + l_linenumber) % 10")).otherwise(F.expr("(l_partkey * 7 + l_orderkey) % l_partkey"))
    e = l.select(F.col("l_partkey").alias("s"), t.alias("t")).filter("s <> t").distinct()
    ids = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    e = e.join(ids.withColumnRenamed("id", "s"), "s", "left_semi")
    return e.join(ids.withColumnRenamed("id", "t"), "t", "left_semi").select("s", "t")


def target_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pkg, label, self_ns: unattributed time of a target by label."""
    e = table(spark, sf_dir, "events")
    label = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("metadata_decode_"), "event_type")).otherwise(F.col("event_type"))
    return e.select((F.col("user_id") % 50).alias("pkg"), label.alias("label"), F.round(F.col("value") * 1000).cast("long").alias("self_ns"))


def package_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node (package), cost_ns."""
    return symbols(spark, sf_dir).groupBy(F.col("pkg").alias("node")).agg(F.sum("cost_ns").alias("cost_ns"))


def package_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: package src has to be built before package dst."""
    return references(spark, sf_dir).select(F.expr("t div 40").alias("src"), F.expr("s div 40").alias("dst")).filter("src <> dst").distinct()


#: The same tables in SQL.
SQL = """WITH RECURSIVE sym AS (
 SELECT p_partkey AS id, p_partkey // 40 AS pkg, p_partkey // 10 AS block, 'pkg' || (p_partkey // 40) || '/lib' AS target_id,
  'm' || (p_partkey // 10) AS module_path, 'p' || p_partkey AS name,
  '[pkg' || (p_partkey // 40) || '/lib]::m' || (p_partkey // 10) || '::p' || p_partkey AS path,
  CASE WHEN p_partkey % 7 = 0 THEN 'impl' ELSE 'module_def' END AS symbol_type, CAST(p_size AS BIGINT) * 1000000 AS cost_ns FROM part),
raw AS (SELECT DISTINCT l_partkey AS s, CASE WHEN l_quantity <= 12 THEN (l_partkey // 10) * 10 + (l_orderkey + l_linenumber) % 10
  ELSE (l_partkey * 7 + l_orderkey) % l_partkey END AS t FROM lineitem
 WHERE l_returnflag = 'A' AND l_partkey > 0 AND l_quantity <= 16 AND (l_quantity <= 12 OR l_quantity >= 13)),
dep AS (SELECT s, t FROM raw WHERE s <> t AND s IN (SELECT id FROM sym) AND t IN (SELECT id FROM sym)),
ev AS (SELECT user_id % 50 AS pkg, CASE WHEN event_id % 3 = 0 THEN 'metadata_decode_' || event_type ELSE event_type END AS label,
  CAST(round(value * 1000) AS BIGINT) AS self_ns FROM events),
node AS (SELECT pkg AS node, CAST(sum(cost_ns) AS BIGINT) AS cost_ns FROM sym GROUP BY pkg),
edge AS (SELECT DISTINCT t // 40 AS src, s // 40 AS dst FROM dep WHERE t // 40 <> s // 40),
home AS (SELECT s, t FROM dep WHERE s // 40 = t // 40),
backs AS (SELECT s, t, row_number() OVER (PARTITION BY s ORDER BY n, t) AS k FROM home JOIN (SELECT t, count(*) AS n FROM home GROUP BY t) USING (t) WHERE s % 7 = 0),
intra AS (SELECT s, t FROM home UNION SELECT t, s FROM backs WHERE k = 1),
reach(a, b) AS (SELECT s, t FROM intra UNION SELECT r.a, i.t FROM reach r JOIN intra i ON r.b = i.s),
scc AS (SELECT id, pkg, cost_ns, least(id, coalesce((SELECT min(r.b) FROM reach r JOIN reach q ON q.a = r.b AND q.b = r.a WHERE r.a = sym.id), id)) AS scc FROM sym),
sccedge AS (SELECT DISTINCT b.scc AS src, a.scc AS dst FROM dep JOIN scc a ON a.id = s JOIN scc b ON b.id = t WHERE a.scc <> b.scc)
"""
