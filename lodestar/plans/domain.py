"""The engine's domain tables as views of the test tables.

Modules are suppliers; their dependencies are successions of suppliers within an order; files are documents; symbols are
conversation turns and parts; documentation states come from labels; change events from events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KIND_OF_EVENT = {"signup": "create", "view": "modify", "click": "modify", "error": "delete", "purchase": "rename"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def successions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) for every supplier that follows another within an order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return li.select(F.col("l_suppkey").alias("src"), F.lead("l_suppkey").over(w).alias("dst")).filter("dst is not null")


def candidate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return successions(spark, sf_dir).filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every succession between two suppliers once, with an edge_id in order of (src, dst)."""
    return candidate_edges(spark, sf_dir).select((F.col("src") * 1_000_000 + F.col("dst")).alias("edge_id"), "src", "dst")


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, hierarchy (region, nation, supplier), tags, key, layer (an account balance bucket)."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    j = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.col("s_suppkey").alias("id"), F.array("r_name", "n_name", "s_name").alias("hierarchy"), F.array("r_name", "n_name").alias("tags"), F.concat_ws("/", "r_name", "n_name", "s_name").alias("key"), F.floor(F.col("s_acctbal") / 2000).cast("int").alias("layer"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), F.col("text").alias("content"), "lang", "source")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for p in KIND_OF_EVENT.items() for x in p])[F.col("event_type")]
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("src/u"), F.col("user_id").cast("string")).alias("path"), kind.alias("kind"), "ts")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the report of each year (y): customers whose orders of it total over 400,000; suppressed where the customer owes money."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    total = o.groupBy(F.year("o_orderdate").alias("y"), "o_custkey").agg(F.sum("o_totalprice").alias("total")).filter("total > 400000")
    j = total.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.select("y", F.concat(F.lit("customer|"), F.col("o_custkey").cast("string")).alias("finding_key"), F.col("c_mktsegment").alias("rule_id"), F.lit("1.0.0").alias("rule_version"), F.when(F.col("c_acctbal") < 0, "suppressed").otherwise("active").alias("status"), F.when(F.col("total") > 900000, "error").otherwise("warning").alias("severity"))


#: The same tables for the SQL counterparts.
SQL = {
    "cand": """
nx AS (SELECT l_suppkey AS s, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS t FROM lineitem),
cand AS (SELECT s AS src, t AS dst, count(*) AS n FROM nx WHERE t IS NOT NULL AND s <> t GROUP BY s, t)""",
    "top": """
ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS r FROM cand),
top AS (SELECT src * 1000000 + dst AS edge_id, src, dst FROM ranked WHERE r = 1)""",
    "all_edges": """
top AS (SELECT src * 1000000 + dst AS edge_id, src, dst FROM cand)""",
    "modules": """
modules AS (SELECT s_suppkey AS id, r_name, n_name, s_name, r_name || '/' || n_name || '/' || s_name AS key, CAST(floor(s_acctbal / 2000) AS INTEGER) AS layer
            FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "files": """
files AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.md' AS path, text AS content, lang, source FROM documents)""",
    "events": """
ev AS (SELECT event_id AS seq, 'src/u' || user_id AS path, ts,
              CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'rename' ELSE 'modify' END AS kind FROM events)""",
    "scc": """
reach(a, b) AS (SELECT src, dst FROM top UNION SELECT a, dst FROM reach JOIN top ON b = src),
scc AS (SELECT s_suppkey AS id, coalesce(least(s_suppkey, (SELECT min(r.b) FROM reach r WHERE r.a = s_suppkey AND EXISTS (SELECT 1 FROM reach q WHERE q.a = r.b AND q.b = s_suppkey))), s_suppkey) AS component FROM supplier),
cyc AS (SELECT component, count(*) AS size FROM scc GROUP BY component HAVING count(*) > 1),
fb AS (SELECT max(edge_id) AS edge_id FROM top JOIN scc ON id = src JOIN cyc USING (component) GROUP BY component),
kept AS (SELECT * FROM top WHERE edge_id NOT IN (SELECT edge_id FROM fb)),
walk(id, layer) AS (SELECT s_suppkey, 0 FROM supplier WHERE s_suppkey NOT IN (SELECT src FROM kept) UNION ALL SELECT src, layer + 1 FROM walk JOIN kept ON dst = id)""",
    "findings": """
tot AS (SELECT o_custkey, year(o_orderdate) AS y, sum(o_totalprice) AS total FROM orders GROUP BY ALL HAVING sum(o_totalprice) > 400000),
find AS (SELECT 'customer|' || o_custkey AS finding_key, y, c_mktsegment AS rule_id, CASE WHEN c_acctbal < 0 THEN 'suppressed' ELSE 'active' END AS status,
                CASE WHEN total > 900000 THEN 'error' ELSE 'warning' END AS severity FROM tot JOIN customer ON o_custkey = c_custkey)""",
}


def sql(names: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(SQL[n] for n in names.split()) + "\n" + body
