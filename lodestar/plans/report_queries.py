"""Registered queries over quality reports, baselines, capabilities, index facts and events, with their DuckDB counterparts.

A report is a year: its findings are customers by their largest order of it; coverage follows from the findings' rules and
scopes. Files are documents, symbols conversation turns, metrics parts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import quality, reports, search
from lodestar.plans import domain as D
from lodestar.plans.domain import table
from lodestar.plans.queries import query

BASE = """WITH f AS (
  SELECT 'report:' || y AS report_id, 'f|' || o_custkey || '|' || y AS finding_id, 'customer|' || o_custkey AS finding_key, 'n' || c_nationkey AS scope_id,
    CASE WHEN o_custkey % 2 = 0 THEN 'file' ELSE 'symbol' END AS kind, CAST(o_custkey AS VARCHAR) AS subject, c_mktsegment AS rule_id, '1.0.0' AS rule_version,
    CASE WHEN total > 400000 THEN 'error' WHEN total > 200000 THEN 'warning' ELSE 'info' END AS severity, CASE WHEN c_acctbal < 0 THEN 'suppressed' ELSE 'active' END AS status
  FROM (SELECT o_custkey, year(o_orderdate) AS y, max(o_totalprice) AS total FROM orders GROUP BY ALL) JOIN customer ON o_custkey = c_custkey),
cov AS (SELECT report_id, rule_id, rule_version, CASE WHEN count(*) % 3 = 0 THEN 'partial' ELSE 'observed' END AS status, list_sort(list(DISTINCT 'scope:' || scope_id || ':' || report_id)) AS evidence FROM f GROUP BY ALL),
sure AS (SELECT rule_id, rule_version FROM cov GROUP BY ALL HAVING bool_and(status = 'observed'))"""


def findings(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    j = o.groupBy("o_custkey", F.year("o_orderdate").cast("string").alias("y")).agg(F.max("o_totalprice").alias("total")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_custkey").cast("string")
    return j.select(
        F.concat(F.lit("report:"), "y").alias("report_id"), F.concat(F.lit("f|"), key, F.lit("|"), "y").alias("finding_id"), F.concat(F.lit("customer|"), key).alias("finding_key"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("scope_id"),
        F.when(F.col("o_custkey") % 2 == 0, "file").otherwise("symbol").alias("kind"), key.alias("subject"), F.col("c_mktsegment").alias("rule_id"), F.lit("1.0.0").alias("rule_version"),
        F.when(F.col("total") > 400000, "error").when(F.col("total") > 200000, "warning").otherwise("info").alias("severity"), F.when(F.col("c_acctbal") < 0, "suppressed").otherwise("active").alias("status"),
    )


def coverage(spark, sf):
    evidence = F.array_sort(F.collect_set(F.concat_ws(":", F.lit("scope"), "scope_id", "report_id")))
    return findings(spark, sf).groupBy("report_id", "rule_id", "rule_version").agg(F.when(F.count("*") % 3 == 0, "partial").otherwise("observed").alias("status"), evidence.alias("evidence"))


@query(BASE + "SELECT finding_id, scope_id, kind, subject, rule_id, severity FROM f WHERE severity = 'error' AND status = 'active' ORDER BY scope_id, kind, subject, rule_id, severity, finding_key, finding_id LIMIT 50 OFFSET 10")
def finding_query(spark, sf):
    own = reports.filter_findings(findings(spark, sf), severity="error", status="active")
    return search.page(own, reports.FINDING_ORDER, 10, 50).select("finding_id", "scope_id", "kind", "subject", "rule_id", "severity")


@query(BASE + "SELECT finding_id, status FROM f WHERE kind = 'file' AND subject = '10' AND rule_version = '1.0.0'")
def finding_query_by_file(spark, sf):
    return reports.filter_findings(findings(spark, sf), file="10", rule_version="1.0.0").select("finding_id", "status")


@query(BASE + "SELECT report_id, rule_id, status, CAST(len(evidence) AS BIGINT) AS n FROM cov WHERE len(list_filter(evidence, lambda e: starts_with(e, 'scope:n3:') AND ends_with(e, ':report:1995'))) > 0")
def coverage_query(spark, sf):
    return reports.filter_coverage(coverage(spark, sf), scope_id="n3", snapshot_id="report:1995").select("report_id", "rule_id", "status", F.size("evidence").cast("long").alias("n"))


@query(BASE + """SELECT report_id, count(*) AS findings, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'suppressed') AS suppressed, count(*) FILTER (status = 'resolved') AS resolved,
  arg_max(severity, CASE severity WHEN 'info' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END) AS worst FROM f GROUP BY report_id HAVING bool_or(scope_id = 'n3')""")
def report_list(spark, sf):
    f, c = findings(spark, sf), coverage(spark, sf)
    return reports.reports_of_scope(reports.report_summary(f), f, c, "n3")


@query(BASE + """SELECT finding_id, CAST(c_custkey % 50 + 1 AS BIGINT) AS first_line, CAST(least(c_custkey % 50 + 1 + c_custkey % 300, c_custkey % 50 + 120) AS BIGINT) AS last_line, c_custkey % 300 >= 120 AS truncated
FROM f JOIN customer ON subject = CAST(c_custkey AS VARCHAR)""")
def finding_evidence(spark, sf):
    k = F.col("c_custkey")
    spans = table(spark, sf, "customer").select(k.cast("string").alias("subject"), (k % 50 + 1).alias("first_line"), (k % 50 + 1 + k % 300).alias("last_line"))
    return reports.finding_evidence(findings(spark, sf), spans).select("finding_id", "first_line", "last_line", "truncated")


GATE = """WITH req AS (SELECT p_brand AS rule_id, p_name AS capability, min(p_partkey) AS ord FROM part GROUP BY ALL),
s AS (SELECT rule_id, capability, ord, CASE WHEN capability = 'red ring' THEN 'partial' WHEN starts_with(capability, 'small') OR starts_with(capability, 'red') THEN NULL WHEN ends_with(capability, 'widget') THEN 'unknown'
      WHEN ends_with(capability, 'ring') THEN 'not_evaluable' ELSE 'unsupported' END AS status FROM req)
SELECT rule_id, arg_min(capability, ord) AS capability, arg_min(status, ord) AS status FROM s WHERE status IS NOT NULL GROUP BY rule_id"""


@query(GATE)
def capability_gate(spark, sf):
    p = table(spark, sf, "part")
    required = p.groupBy(F.col("p_brand").alias("rule_id"), F.col("p_name").alias("capability")).agg(F.min("p_partkey").alias("ord"))
    names = p.select(F.col("p_name").alias("capability")).distinct()
    has = names.filter("startswith(capability, 'small') or startswith(capability, 'red')")
    return reports.capability_gate(required, has, names.filter("endswith(capability, 'widget')").withColumn("status", F.lit("unknown")), names.filter("endswith(capability, 'ring')"), names.filter("capability = 'red ring'"))


@query("""SELECT p_brand AS rule_id, count(*) AS subjects, count(*) FILTER (p_size > 10) AS evaluated,
  CASE WHEN p_brand = 'Brand#1' THEN 'unsupported' WHEN count(*) FILTER (p_size > 10) < count(*) THEN 'partial' ELSE 'observed' END AS status FROM part GROUP BY p_brand""")
def source_rule_coverage(spark, sf):
    n = table(spark, sf, "part").groupBy(F.col("p_brand").alias("rule_id")).agg(F.count("*").alias("subjects"), F.count_if(F.col("p_size") > 10).alias("evaluated"))
    return n.withColumn("status", reports.source_rule_coverage(F.when(F.col("rule_id") == "Brand#1", "unsupported"), F.col("subjects"), F.col("evaluated")))


@query(BASE + "SELECT finding_id, rule_id || '|1.0.0|' || scope_id || '|' || kind || '|' || CASE WHEN kind = 'file' THEN finding_key ELSE subject END || '|' || severity AS stable_key FROM f")
def stable_finding_keys(spark, sf):
    f = findings(spark, sf).withColumn("own_key", F.when(F.col("kind") == "file", F.col("finding_key")).otherwise(""))
    return f.select("finding_id", reports.stable_finding_key(["rule_id", "rule_version", "scope_id", "kind", "subject", "severity"], "own_key", "subject").alias("stable_key"))


@query(BASE + """, r AS (SELECT report_id, count(*) AS findings, sha256(string_agg(concat_ws('|', scope_id, kind, subject, rule_id, severity, finding_key, finding_id, status), chr(10)
  ORDER BY scope_id, kind, subject, rule_id, severity, finding_key, finding_id, status)) AS digest FROM f GROUP BY report_id)
SELECT report_id, findings, digest, 'evaluation:' || substr(digest, 1, 16) AS evaluation_id FROM r""")
def report_identity(spark, sf):
    return reports.normalized_report(findings(spark, sf))


BAD = BASE + """, g AS (SELECT finding_id, rule_id, rule_version, CASE WHEN CAST(subject AS BIGINT) % 50 = 0 THEN 'open' ELSE status END AS status, severity FROM f
  UNION ALL SELECT finding_id, rule_id, '2.0.0', status, severity FROM f WHERE CAST(subject AS BIGINT) % 40 = 1)"""


@query(BAD + """SELECT 'duplicate' AS problem, finding_id AS id FROM g GROUP BY finding_id HAVING count(*) > 1 UNION ALL SELECT 'enum', finding_id FROM g WHERE status = 'open'
UNION ALL SELECT 'no_coverage', finding_id FROM g WHERE rule_version = '2.0.0' UNION ALL SELECT 'coverage_enum', rule_id FROM cov WHERE rule_id = 'BUILDING' AND status = 'partial'""")
def report_validation(spark, sf):
    f = findings(spark, sf)
    g = f.withColumn("status", F.when(F.col("subject").cast("long") % 50 == 0, "open").otherwise(F.col("status")))
    other = f.filter(F.col("subject").cast("long") % 40 == 1).withColumn("rule_version", F.lit("2.0.0"))
    cov = coverage(spark, sf)
    odd = cov.withColumn("status", F.when((F.col("rule_id") == "BUILDING") & (F.col("status") == "partial"), "none").otherwise(F.col("status")))
    return reports.report_violations(g.unionByName(other), odd)


ENTRIES = """WITH e AS (SELECT p_brand AS baseline_id, p_partkey AS ord, 'k' || p_size AS finding_key, p_type AS rule_id, CASE WHEN p_partkey % 31 = 0 THEN '' ELSE '1.' || p_size % 3 END AS rule_version, 'profile' AS profile_id,
  CASE WHEN p_partkey % 37 = 0 THEN ' ' ELSE p_name END AS reason FROM part)"""


@query(ENTRIES + """, o AS (SELECT *, lag((baseline_id, finding_key, rule_id, rule_version)) OVER (PARTITION BY baseline_id ORDER BY ord) AS before FROM e)
SELECT 'incomplete' AS problem, finding_key FROM e WHERE trim(reason) = '' OR rule_version = '' UNION ALL SELECT 'duplicate', finding_key FROM e GROUP BY baseline_id, finding_key, rule_id, rule_version HAVING count(*) > 1
UNION ALL SELECT 'order', finding_key FROM o WHERE before > (baseline_id, finding_key, rule_id, rule_version)""")
def baseline_validation(spark, sf):
    p = F.col("p_partkey")
    e = table(spark, sf, "part").select(
        F.col("p_brand").alias("baseline_id"), p.alias("ord"), F.concat(F.lit("k"), F.col("p_size").cast("string")).alias("finding_key"), F.col("p_type").alias("rule_id"),
        F.when(p % 31 == 0, "").otherwise(F.concat(F.lit("1."), (F.col("p_size") % 3).cast("string"))).alias("rule_version"), F.lit("profile").alias("profile_id"), F.when(p % 37 == 0, " ").otherwise(F.col("p_name")).alias("reason"),
    )
    return reports.baseline_violations(e, ["baseline_id", "finding_key", "rule_id", "rule_version"])


@query(BASE + "SELECT finding_id, rule_id FROM f JOIN (SELECT report_id, rule_id, rule_version FROM cov WHERE status = 'observed') USING (report_id, rule_id, rule_version) WHERE f.status = 'active'")
def baseline_candidates(spark, sf):
    return reports.baseline_candidates(findings(spark, sf), coverage(spark, sf), ["report_id"]).select("finding_id", "rule_id")


@query("""WITH r AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '1.0.' || p_size WHEN 2 THEN CAST(p_size AS VARCHAR) ELSE '2.x' || p_size || '-rc' END AS revision FROM part)
SELECT revision, CASE WHEN revision = '' THEN '1.0.0' WHEN starts_with(revision, '1.0.') THEN '1.0.' || (CAST(substr(revision, 5) AS INTEGER) + 1) WHEN ends_with(revision, '-rc') THEN revision || '.1' ELSE CAST(CAST(revision AS INTEGER) + 1 AS VARCHAR) END AS next FROM r""")
def baseline_revision(spark, sf):
    n, text = F.col("p_size") % 4, F.col("p_size").cast("string")
    r = table(spark, sf, "part").select(F.when(n == 0, "").when(n == 1, F.concat(F.lit("1.0."), text)).when(n == 2, text).otherwise(F.concat(F.lit("2.x"), text, F.lit("-rc"))).alias("revision")).distinct()
    return r.withColumn("next", reports.next_revision(F.col("revision")))


@query(BASE + """, b AS (SELECT DISTINCT finding_key, 'old' AS reason FROM f WHERE status = 'suppressed'), a AS (SELECT DISTINCT finding_key, 'new' AS reason FROM f WHERE severity = 'error')
SELECT finding_key, reason, '1.0.1' AS revision FROM (SELECT * FROM b UNION ALL SELECT * FROM a WHERE finding_key NOT IN (SELECT finding_key FROM b))""")
def baseline_append(spark, sf):
    f = findings(spark, sf)
    old = f.filter("status = 'suppressed'").select("finding_key", F.lit("old").alias("reason")).distinct()
    return reports.append_baseline(old, f.filter("severity = 'error'").select("finding_key", F.lit("new").alias("reason")), "1.0.0", "1.0.0")


@query("SELECT p_partkey AS metric_fact_id FROM part WHERE p_type = 'ECONOMY' AND p_name LIKE 'red %' AND p_size > 5 AND p_brand IN (SELECT DISTINCT p_brand FROM part WHERE p_size = 1)")
def eligible_metrics(spark, sf):
    p = table(spark, sf, "part")
    unit = F.split("p_name", " ")[0]
    m = p.select(F.col("p_partkey").alias("metric_fact_id"), F.col("p_type").alias("metric_id"), unit.alias("unit"), F.when(F.col("p_size") > 5, "observed").otherwise("partial").alias("status"), F.col("p_brand").alias("scope_id"), F.lit("s").alias("snapshot_id"))
    snapshots = p.filter("p_size = 1").select(F.col("p_brand").alias("scope_id"), F.lit("s").alias("snapshot_id")).distinct()
    return reports.eligible_metrics(m, snapshots, "ECONOMY", "red").select("metric_fact_id")


@query("SELECT l_orderkey AS finding_id, string_agg(DISTINCT p_type || '@' || p_brand, ',' ORDER BY p_type || '@' || p_brand) AS versions FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
def formula_versions(spark, sf):
    f = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("finding_id")).agg(F.collect_set("l_partkey").alias("metric_refs"))
    m = table(spark, sf, "part").select(F.col("p_partkey").alias("metric_fact_id"), F.col("p_type").alias("metric_id"), F.col("p_brand").alias("formula_version"))
    return reports.formula_versions(f, m).withColumn("versions", F.array_join("versions", ","))


SPANS = """WITH s AS (SELECT conv_id, turn, 'c' || conv_id AS file_id, turn AS start_line, turn + conv_id % 3 - 1 AS end_line, conv_id % 5 AS start_column, turn % 7 AS end_column, turn * 10 AS start_byte, turn * 10 + conv_id % 40 - 2 AS end_byte,
  CASE WHEN conv_id % 11 = 0 THEN 'short' ELSE sha256(text) END AS hash FROM conversations)"""


def _spans(spark, sf):
    c, t = F.col("conv_id"), F.col("turn")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("c"), c.cast("string")).alias("file_id"), t.alias("start_line"), (t + c % 3 - 1).alias("end_line"), (c % 5).alias("start_column"), (t % 7).alias("end_column"), (t * 10).alias("start_byte"), (t * 10 + c % 40 - 2).alias("end_byte"),
        F.when(c % 11 == 0, "short").otherwise(F.sha2("text", 256)).alias("hash"),
    )


@query(SPANS + """SELECT conv_id, turn, coalesce(file_id <> '' AND start_line >= 1 AND start_column >= 1 AND end_column >= 1 AND start_byte >= 0 AND end_byte >= start_byte
  AND (end_line > start_line OR end_line = start_line AND end_column >= start_column) AND regexp_matches(hash, '^[0-9a-f]{64}$'), false) AS valid FROM s""")
def span_validation(spark, sf):
    s = _spans(spark, sf)
    return s.select("conv_id", "turn", reports.valid_span({c: F.col(c) for c in s.columns}).alias("valid"))


@query(SPANS + ", fl AS (SELECT file_id, max(hash) AS hash, max(end_byte) - 20 AS bytes FROM s GROUP BY file_id) SELECT conv_id, turn FROM s JOIN fl USING (file_id, hash) WHERE end_byte <= bytes + 20")
def body_spans(spark, sf):
    s = _spans(spark, sf)
    files = s.groupBy("file_id").agg(F.max("hash").alias("hash"), F.max("end_byte").alias("bytes"))
    return reports.body_spans(s, files).select("conv_id", "turn")


@query("SELECT p_partkey FROM part WHERE p_type = 'ECONOMY' OR starts_with(CASE p_size % 3 WHEN 0 THEN 'go:method:x' WHEN 1 THEN 'go:type' ELSE 'py:function' END, 'go:method')")
def callable_symbols(spark, sf):
    n = F.col("p_size") % 3
    kind = F.when(n == 0, "go:method:x").when(n == 1, "go:type").otherwise("py:function")
    return table(spark, sf, "part").filter(reports.is_callable(F.when(F.col("p_type") == "ECONOMY", "callable").otherwise("type"), kind)).select("p_partkey")


@query("""WITH st AS (SELECT source AS capability, count(*) AS eligible, count(*) FILTER (n_chars > 900) AS observed, count(*) FILTER (lang IS NULL AND n_chars > 15000) AS failures, bool_or(source LIKE '%1') AS unsupported FROM documents GROUP BY source),
n AS (SELECT count(*) AS n FROM documents), r AS (SELECT DISTINCT source AS capability FROM documents UNION ALL SELECT 'source:files' UNION ALL SELECT 'source:other')
SELECT capability, CASE WHEN capability = 'source:files' THEN 'observed' WHEN failures > 0 THEN 'partial' WHEN observed > 0 AND observed < eligible THEN 'partial' WHEN coalesce(observed, 0) = 0 AND coalesce(unsupported, false) THEN 'unsupported' ELSE 'observed' END AS status,
  CASE WHEN capability = 'source:files' THEN n ELSE coalesce(eligible, n) END AS eligible, CASE WHEN capability = 'source:files' THEN n ELSE coalesce(observed, 0) END AS observed FROM r LEFT JOIN st USING (capability), n""")
def capability_build(spark, sf):
    d = table(spark, sf, "documents")
    stats = d.groupBy(F.col("source").alias("capability")).agg(F.count("*").alias("eligible"), F.count_if(F.col("n_chars") > 900).alias("observed"), F.count_if(F.col("lang").isNull() & (F.col("n_chars") > 15000)).alias("failures"), F.bool_or(F.col("source").endswith("1")).alias("unsupported"))
    requested = d.select(F.col("source").alias("capability")).distinct().union(spark.createDataFrame([("source:files",), ("source:other",)], "capability string"))
    return reports.capability_coverage(requested, stats, d.count())


INDEX = """WITH fl AS (SELECT doc_id AS file_id, doc_id % 40 AS lines, CASE WHEN doc_id % 97 = 0 THEN 'x' ELSE sha256(coalesce(text, '')) END AS hash FROM documents UNION ALL SELECT doc_id, 1, sha256('') FROM documents WHERE doc_id % 200 = 3),
sy AS (SELECT p_partkey AS symbol_id, p_partkey * 3 AS file_id, p_size - 1 AS start_line, p_size + p_partkey % 5 - 1 AS end_line FROM part), dc AS (SELECT doc_id AS documentation_id, doc_id * 2 AS symbol_id FROM labels)"""


@query(INDEX + """SELECT 'file_duplicate' AS problem, CAST(file_id AS VARCHAR) AS id FROM fl GROUP BY file_id HAVING count(*) > 1 UNION ALL SELECT 'documentation_duplicate', CAST(documentation_id AS VARCHAR) FROM dc GROUP BY documentation_id HAVING count(*) > 1
UNION ALL SELECT 'symbol_file', CAST(symbol_id AS VARCHAR) FROM sy WHERE file_id NOT IN (SELECT file_id FROM fl) UNION ALL SELECT 'documentation_symbol', CAST(documentation_id AS VARCHAR) FROM dc WHERE symbol_id NOT IN (SELECT symbol_id FROM sy)
UNION ALL SELECT 'symbol_span', CAST(symbol_id AS VARCHAR) FROM sy JOIN fl USING (file_id) WHERE start_line < 1 OR end_line < start_line OR end_line > lines UNION ALL SELECT 'file_hash', CAST(file_id AS VARCHAR) FROM fl WHERE hash = 'x'""")
def index_validation(spark, sf):
    d, p, i = table(spark, sf, "documents"), table(spark, sf, "part"), F.col("doc_id")
    files = d.select(i.alias("file_id"), (i % 40).alias("lines"), F.when(i % 97 == 0, "x").otherwise(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("hash"))
    files = files.union(d.filter(i % 200 == 3).select("doc_id", F.lit(1).cast("long"), F.sha2(F.lit(""), 256)))
    symbols = p.select(F.col("p_partkey").alias("symbol_id"), (F.col("p_partkey") * 3).alias("file_id"), (F.col("p_size") - 1).alias("start_line"), (F.col("p_size") + F.col("p_partkey") % 5 - 1).alias("end_line"))
    return reports.index_violations(files, symbols, table(spark, sf, "labels").select(i.alias("documentation_id"), (i * 2).alias("symbol_id")))


@query("SELECT l_partkey AS reference_id, count(DISTINCT l_suppkey) AS modules, count(DISTINCT l_orderkey) AS relationships, count(DISTINCT l_shipdate) AS sources, min(l_suppkey) AS first_module FROM lineitem GROUP BY l_partkey")
def reference_accumulators(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("reference_id"), F.col("l_suppkey").alias("module_id"), F.col("l_orderkey").alias("relationship_id"), F.col("l_shipdate").alias("source_id"))
    return reports.reference_accumulators(e)


@query(D.sql("cand all_edges", """, fb AS (SELECT unnest([src, dst]) AS id FROM top WHERE edge_id % 1009 = 0)
SELECT s_nationkey AS node, CASE WHEN bool_or(s_acctbal < -900) THEN 'cycle' WHEN bool_or(s_suppkey IN (SELECT id FROM fb)) THEN 'feedback' ELSE 'none' END AS state FROM supplier GROUP BY s_nationkey"""))
def node_cycle_state(spark, sf):
    s, e = table(spark, sf, "supplier"), D.all_edges(spark, sf)
    nodes = s.select(F.col("s_nationkey").alias("node"), F.col("s_suppkey").alias("id"))
    return reports.node_cycle_state(nodes, e, s.filter("s_acctbal < -900").select(F.col("s_suppkey").alias("id")), e.filter("edge_id % 1009 = 0"))


@query(BASE + "SELECT count(*) AS total, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'error') AS error FROM f")
def diagnostic_summary(spark, sf):
    return reports.diagnostic_summary(findings(spark, sf))


@query("SELECT p_partkey AS source_id, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) OR p_partkey IN (SELECT event_id FROM events WHERE event_type = 'error')")
def evidence_links(spark, sf):
    a = table(spark, sf, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("source_id"))
    b = table(spark, sf, "events").filter("event_type = 'error'").select(F.col("event_id").alias("source_id"))
    return reports.evidence_links(table(spark, sf, "part").select(F.col("p_partkey").alias("source_id"), "p_name"), a, b)


@query("""WITH e AS (SELECT event_id AS sequence, lower(trim(CASE event_type WHEN 'signup' THEN ' CREATE' WHEN 'view' THEN 'Modify' WHEN 'error' THEN 'overflow ' ELSE event_type END)) AS kind, CASE WHEN user_id % 9 = 0 THEN '' ELSE 'u' || user_id END AS path FROM events)
SELECT sequence, kind, path, sha256(concat_ws('|', kind, path, CAST(sequence AS VARCHAR))) AS event_group_id FROM e WHERE kind IN ('create', 'modify', 'delete', 'rename', 'overflow', 'error') AND (path <> '' OR kind IN ('overflow', 'error'))""")
def event_normalization(spark, sf):
    t, u = F.col("event_type"), F.col("user_id")
    kind = F.when(t == "signup", " CREATE").when(t == "view", "Modify").when(t == "error", "overflow ").otherwise(t)
    e = table(spark, sf, "events").select(F.col("event_id").alias("sequence"), kind.alias("kind"), F.when(u % 9 == 0, "").otherwise(F.concat(F.lit(" u"), u.cast("string"))).alias("path"))
    return reports.normalized_events(e)


@query("""WITH d AS (SELECT l_suppkey % 50 AS type_id, count(DISTINCT l_suppkey) AS derived_count FROM lineitem GROUP BY 1)
SELECT l_suppkey AS type_id, count(DISTINCT l_linenumber) AS member_count, count(DISTINCT l_partkey) AS dependency_count, count(DISTINCT CASE WHEN l_partkey % 3 <> 0 THEN l_partkey END) AS concrete_dependency_count, max(coalesce(derived_count, 0)) AS derived_count
FROM lineitem LEFT JOIN d ON type_id = l_suppkey GROUP BY l_suppkey""")
def type_facts(spark, sf):
    li, s = table(spark, sf, "lineitem"), F.col("l_suppkey")
    members = li.select(s.alias("type_id"), F.col("l_linenumber").alias("member"), F.col("l_partkey").alias("target"), (F.col("l_partkey") % 3 == 0).alias("interface"))
    return reports.type_facts(members, li.select(s.alias("type_id"), (s % 50).alias("base")))


@query("SELECT p_name AS metric, p_brand AS subject, arg_min(p_size, p_partkey) AS value FROM part GROUP BY ALL")
def first_metric(spark, sf):
    m = table(spark, sf, "part").select(F.col("p_name").alias("metric"), F.col("p_brand").alias("subject"), F.col("p_partkey").alias("metric_fact_id"), F.col("p_size").alias("value"))
    return quality.first_metric(m).select("metric", "subject", "value")
