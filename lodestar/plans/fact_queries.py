"""Registered queries over facts by subject, with their DuckDB counterparts.

Documentation is conversation turns, of files (whole conversations) and symbols (their turns); modules, files and symbols are
the suppliers, parts and orders of lineitem; diagnostics and states come from events.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import ids
from lodestar.operators import facts, model, planning, search
from lodestar.plans.domain import table
from lodestar.plans.queries import query

DOCS = """WITH d AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn = 0 THEN 'file' WHEN turn = 2 THEN 'module' ELSE 'symbol' END AS subject_kind, CASE WHEN turn = 0 THEN 'c' || conv_id ELSE 'c' || conv_id || '.' || turn END AS subject_id,
  role AS status, CASE WHEN turn % 3 = 0 THEN '' ELSE 'note ' || conv_id || ' on ' || role END AS normalized, 'raw ' || conv_id || ' of ' || turn AS raw FROM conversations)"""


def documentation(spark, sf):
    conv, turn = (F.col(c).cast("string") for c in ("conv_id", "turn"))
    own = F.concat(F.lit("c"), conv)
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") == 0, "file").when(F.col("turn") == 2, "module").otherwise("symbol").alias("subject_kind"), F.when(F.col("turn") == 0, own).otherwise(F.concat(own, F.lit("."), turn)).alias("subject_id"),
        F.col("role").alias("status"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit("note "), conv, F.lit(" on "), "role")).alias("normalized"), F.concat(F.lit("raw "), conv, F.lit(" of "), turn).alias("raw"),
    )


@query(DOCS + " SELECT id, subject_id FROM d WHERE contains(lower(status), 'user') AND contains(lower(coalesce(nullif(normalized, ''), raw)), '7 o')")
def find_documentation(spark, sf):
    return documentation(spark, sf).filter(facts.documentation_filter(status="USER", text="7 O")).select("id", "subject_id")


@query(DOCS + " SELECT id, subject_id FROM d WHERE subject_id IN ('c1', 'c2.1', 'c3.9') ORDER BY id LIMIT 50")
def documentation_of_subjects(spark, sf):
    return search.page(documentation(spark, sf).filter(facts.documentation_filter(["c1", "c2.1", "c3.9"])), ["id"]).select("id", "subject_id")


@query(DOCS + " SELECT id, subject_kind FROM d WHERE (subject_kind = 'file' AND CAST(substr(subject_id, 2) AS BIGINT) % 3 = 0) OR (subject_kind = 'symbol' AND status = 'assistant')")
def documentation_by_subject(spark, sf):
    c = table(spark, sf, "conversations")
    files = c.filter("conv_id % 3 = 0").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("file_id"))
    symbols = c.filter("role = 'assistant'").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("symbol_id"))
    return facts.documentation_of(documentation(spark, sf), files, symbols).select("id", "subject_kind")


RELATIONS = """WITH rel AS (SELECT 'contains' AS category, 'module' AS from_kind, 's' || l_suppkey AS src, 'file' AS to_kind, 'p' || l_partkey AS dst FROM lineitem
  UNION ALL SELECT CASE l_returnflag WHEN 'R' THEN 'declares' WHEN 'A' THEN 'contains' ELSE 'references' END, 'file', 'p' || l_partkey, 'symbol', 'o' || l_orderkey FROM lineitem),
mf AS (SELECT DISTINCT dst AS id FROM rel WHERE from_kind = 'module' AND src IN (SELECT 's' || s_suppkey FROM supplier WHERE s_nationkey = 3))"""


def relations(spark, sf):
    li = table(spark, sf, "lineitem")
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    own = li.select(F.lit("contains").alias("category"), F.lit("module").alias("from_kind"), key("s", "l_suppkey").alias("src"), F.lit("file").alias("to_kind"), key("p", "l_partkey").alias("dst"))
    kind = F.when(F.col("l_returnflag") == "R", "declares").when(F.col("l_returnflag") == "A", "contains").otherwise("references")
    return own.unionByName(li.select(kind.alias("category"), F.lit("file").alias("from_kind"), key("p", "l_partkey").alias("src"), F.lit("symbol").alias("to_kind"), key("o", "l_orderkey").alias("dst")))


def files_of_nation(spark, sf, requested=None):
    modules = table(spark, sf, "supplier").filter("s_nationkey = 3").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    return facts.module_files(relations(spark, sf), modules, requested)


@query(RELATIONS + " SELECT id FROM mf UNION SELECT 'p' || p_partkey FROM part WHERE p_size = 7")
def module_files(spark, sf):
    return files_of_nation(spark, sf, table(spark, sf, "part").filter("p_size = 7").select(F.concat(F.lit(" p"), F.col("p_partkey").cast("string")).alias("id")))


@query(RELATIONS + " SELECT DISTINCT dst AS id FROM rel WHERE from_kind = 'file' AND category <> 'references' AND src IN (SELECT id FROM mf)")
def module_symbols(spark, sf):
    return facts.file_symbols(relations(spark, sf), files_of_nation(spark, sf))


@query("SELECT p_partkey AS id, p_name AS name, CAST(NULL AS VARCHAR) AS member_count, CAST(NULL AS VARCHAR) AS hierarchy_depth FROM part")
def compact_symbols(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("member_count"), F.col("p_retailprice").cast("string").alias("hierarchy_depth"))
    return facts.compact_symbols(p)


@query("""SELECT o_orderkey AS ref, k.kind, CASE k.kind WHEN 'file' THEN CASE WHEN o_custkey % 5 <> 0 THEN 'F' || o_custkey END WHEN 'module' THEN 'scope-1::' || 'm%2F' || o_custkey ELSE 'm/' || o_custkey END AS id
FROM orders JOIN (VALUES (0, 'file'), (1, 'module'), (2, 'reference')) k(n, kind) ON o_orderkey % 3 = n""")
def projection_references(spark, sf):
    o, n = table(spark, sf, "orders"), F.col("o_orderkey") % 3
    key = F.concat(F.lit("m/"), F.col("o_custkey").cast("string"))
    refs = o.select(F.col("o_orderkey").alias("ref"), F.when(n == 0, "file").when(n == 1, "module").otherwise("reference").alias("kind"), key.alias("id"))
    files = o.filter("o_custkey % 5 <> 0").select(key.alias("id"), F.concat(F.lit("F"), F.col("o_custkey").cast("string")).alias("new_id")).distinct()
    return facts.rekeyed(refs, "scope-1", {"file": files})


@query("""SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'p/' || p_size || '.py' WHEN 1 THEN 'app/p/' || p_size || '.py' WHEN 2 THEN 'app' ELSE 'p/' || p_size || '.py' END AS path FROM part""")
def aggregate_paths(spark, sf):
    n, size = F.col("p_size") % 4, F.col("p_size").cast("string")
    root = F.when(n == 0, " ").when(n == 3, "./").otherwise("lib\\..\\app")
    own = F.when(n == 2, "./.").otherwise(F.concat(F.lit("./p/./"), size, F.lit(".py")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), facts.aggregate_path(root, own).alias("path"))


@query("""SELECT o_orderkey AS id FROM orders WHERE (o_custkey, o_orderkey % 40) IN (SELECT l_partkey, l_linenumber FROM lineitem) OR (o_custkey, o_orderkey % 40) IN (SELECT p_partkey, p_size FROM part)""")
def indexed_spans(spark, sf):
    def spans(df, file, line, **more):
        return df.select(F.col(file).cast("string").alias("file_id"), F.expr(line).cast("int").alias("start"), (F.expr(line) + 1).cast("int").alias("end"), F.lit("utf-8").alias("coordinates"), *[F.col(v).alias(k) for k, v in more.items()])

    o, li, p = (table(spark, sf, t) for t in ("orders", "lineitem", "part"))
    return facts.indexed_spans(spans(o, "o_custkey", "o_orderkey % 40", id="o_orderkey"), [spans(li, "l_partkey", "l_linenumber"), spans(p, "p_partkey", "p_size")]).select("id")


@query("""WITH k AS (SELECT l_partkey AS id, min(l_suppkey % 3) AS a, max(l_suppkey % 3) AS b FROM lineitem WHERE l_quantity > 30 GROUP BY l_partkey)
SELECT p_partkey AS entity_id, CASE WHEN a = b THEN 's' || a END AS snapshot_id, CASE WHEN a IS NULL THEN 'missing' WHEN a < b THEN 'ambiguous' ELSE 'found' END AS status FROM part LEFT JOIN k ON p_partkey = id""")
def owning_snapshots(spark, sf):
    known = table(spark, sf, "lineitem").filter("l_quantity > 30").select(F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("snapshot_id"), F.col("l_partkey").alias("entity_id"))
    return facts.owning_snapshot(table(spark, sf, "part").select(F.col("p_partkey").alias("entity_id")), known)


@query("""WITH v AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'integer' WHEN 1 THEN 'decimal' WHEN 2 THEN 'boolean' WHEN 3 THEN 'text' ELSE 'other' END AS kind, p_size % 4 AS f, p_size FROM part)
SELECT id, kind, CASE WHEN f IN (0, 1) THEN CAST(p_size AS VARCHAR) END AS as_integer, CASE f WHEN 0 THEN p_size WHEN 1 THEN p_size WHEN 2 THEN p_size + 0.5 END::DOUBLE AS as_decimal,
  (kind = 'integer' AND f < 2) OR (kind = 'decimal' AND f < 3) OR (kind = 'text' AND f = 3) AS valid FROM v""")
def metric_values(spark, sf):
    k, f, n = F.col("p_partkey") % 5, F.col("p_size") % 4, F.col("p_size").cast("string")
    kind = F.when(k == 0, "integer").when(k == 1, "decimal").when(k == 2, "boolean").when(k == 3, "text").otherwise("other")
    json = F.when(f == 0, n).when(f == 1, F.concat(n, F.lit(".0"))).when(f == 2, F.concat(n, F.lit(".5"))).otherwise(F.concat(F.lit('"'), n, F.lit('"')))
    v = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), kind.alias("kind"), json.alias("json"))
    return v.select("id", "kind", facts.integer_value(F.col("json")).cast("string").alias("as_integer"), facts.decimal_value(F.col("json")).alias("as_decimal"), facts.valid_metric_value(F.col("kind"), F.col("json")).alias("valid"))


def references(spark, sf):
    scope = F.when(F.col("p_size") % 5 == 0, "standard_library").when(F.col("p_size") % 5 == 1, "external").when(F.col("p_size") % 5 == 2, "dynamic").otherwise(F.concat(F.lit("own"), (F.col("p_size") % 5).cast("string")))
    return table(spark, sf, "part").select(F.concat(F.lit("ref:"), F.col("p_partkey").cast("string")).alias("reference_id"), F.col("p_name").alias("name"), scope.alias("scope"))


SCOPES = "WITH r AS (SELECT 'ref:' || p_partkey AS id, p_name AS name, CASE p_size % 5 WHEN 0 THEN 'standard_library' WHEN 1 THEN 'external' WHEN 2 THEN 'dynamic' ELSE 'own' || p_size % 5 END AS scope FROM part)"


@query(SCOPES + """ SELECT DISTINCT 'reference-boundary:' || scope AS node_id, CASE scope WHEN 'standard_library' THEN 'Standard library' WHEN 'external' THEN 'External references' WHEN 'dynamic' THEN 'Dynamic references' ELSE scope || ' references' END AS label, scope FROM r""")
def reference_boundaries(spark, sf):
    return facts.reference_nodes(references(spark, sf), "aggregated")


@query(SCOPES + " SELECT id AS node_id, name AS label, scope FROM r WHERE scope IN ('external', 'dynamic')")
def reference_nodes(spark, sf):
    return facts.reference_nodes(references(spark, sf), "expanded", ["external", "dynamic"])


@query(SCOPES + """ SELECT 0 AS section, 's' || s_suppkey AS id, s_name AS description FROM supplier UNION ALL SELECT 1, 'o' || o_orderkey, o_orderpriority FROM orders UNION ALL SELECT 2, 'n' || n_nationkey, n_name FROM nation
UNION ALL SELECT 3, 'e' || event_id, event_type FROM events UNION ALL SELECT 4, 'reference-detail:' || id, name FROM r""")
def reading_order(spark, sf):
    shown = [("supplier", "s", "s_suppkey", "s_name"), ("orders", "o", "o_orderkey", "o_orderpriority"), ("nation", "n", "n_nationkey", "n_name"), ("events", "e", "event_id", "event_type")]
    parts = [table(spark, sf, t).select(F.concat(F.lit(k), F.col(i).cast("string")).alias("id"), F.col(label).alias("label")) for t, k, i, label in shown]
    return facts.reading_order(*parts, references(spark, sf).select(F.col("reference_id").alias("id"), F.col("name").alias("label")))


@query("""WITH g AS (SELECT DISTINCT event_type, user_id, user_id % 50 AS p FROM events), s AS (SELECT p_size % 60 AS p, list_sort(list(DISTINCT 'p' || p_partkey)) AS ids FROM part GROUP BY ALL)
SELECT 'model:diagnostic:' || substr(sha256(concat_ws(chr(0), 'diagnostic', event_type, 'warning', 'seen', CAST(user_id AS VARCHAR), 'src/' || p, '')), 1, 16) AS id, 'src/' || p AS path, coalesce(len(ids), 0) AS n, ids[1] AS first FROM g LEFT JOIN s USING (p)""")
def diagnostic_sources(spark, sf):
    e = table(spark, sf, "events")
    found = e.select(F.col("event_type").alias("code"), F.lit("warning").alias("severity"), F.lit("seen").alias("message"), F.col("user_id").cast("string").alias("subject"), F.concat(F.lit(" ./src/"), (F.col("user_id") % 50).cast("string")).alias("path"), F.lit("").alias("position"))
    p = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("source_id"), F.concat(F.lit("src/x/../"), (F.col("p_size") % 60).cast("string")).alias("path"))
    return facts.attached_diagnostics(found, p).select("id", "path", F.size("source_ids").cast("long").alias("n"), F.get("source_ids", F.lit(0)).alias("first"))


@query("""SELECT DISTINCT o_orderkey AS diagnostic_id, s_nationkey AS node FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
UNION SELECT o_orderkey, s_nationkey FROM orders JOIN supplier ON o_custkey = s_suppkey""")
def diagnostic_nodes(spark, sf):
    o, li, s = (table(spark, sf, t) for t in ("orders", "lineitem", "supplier"))
    found = o.select(F.col("o_orderkey").alias("diagnostic_id"), F.array("o_orderkey").alias("source_ids"), F.col("o_custkey").alias("subject"))
    return facts.diagnostic_nodes(found, li.select(F.col("l_orderkey").alias("source_id"), F.col("l_suppkey").alias("module")).distinct(), s.select(F.col("s_suppkey").alias("module"), F.col("s_nationkey").alias("node")))


@query("SELECT code, message FROM (SELECT event_type AS code, 'event ' || event_id AS message FROM events ORDER BY event_id LIMIT 199) UNION ALL SELECT 'diagnostics_truncated', 'Additional diagnostics were omitted.'")
def bounded_diagnostics(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("code"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"))
    return facts.bounded_diagnostics(e, ["event_id"])


@query("""WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 50 END AS s, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 170 END AS e, CASE WHEN o_custkey % 2 = 0 THEN 5 END AS ss, o_custkey % 7 AS n FROM orders),
b AS (SELECT *, coalesce(s, ss, 1) AS f, coalesce(e, coalesce(s, ss, 1) + 18) AS l FROM a)
SELECT id, f AS first, l AS last, CASE WHEN s < 1 OR e < 1 THEN 'not_positive' WHEN f < 1 OR l < f THEN 'invalid' WHEN l - f >= 120 THEN 'too_large' WHEN n = 0 THEN 'empty' END AS problem FROM b""")
def line_ranges(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    r = facts.line_range(F.when(k % 3 > 0, k % 50), F.when(k % 4 > 0, k % 170), F.when(c % 2 == 0, 5), F.lit(None).cast("int"), c % 7)
    return table(spark, sf, "orders").select(k.alias("id"), r.alias("r")).select("id", F.col("r.first").cast("long").alias("first"), F.col("r.last").cast("long").alias("last"), "r.problem")


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN CASE WHEN user_id % 2 = 0 THEN 'updating' ELSE 'initializing' END WHEN event_type = 'error' THEN 'input_unstable' WHEN value > 50 THEN 'stale' WHEN user_id % 2 = 0 THEN 'current' ELSE 'initializing' END AS status FROM events""")
def freshness_states(spark, sf):
    kind = F.col("event_type")
    return table(spark, sf, "events").select("event_id", facts.freshness(F.col("user_id") % 2 == 0, kind == "view", kind == "error", F.col("value") > 50).alias("status"))


#: Every year's report against the one before.
@query("""WITH i AS (SELECT DISTINCT year(o_orderdate) AS y, month(o_orderdate) % 5 AS part, o_orderpriority AS rule, CASE WHEN year(o_orderdate) % 3 = 0 THEN 'X' ELSE o_orderstatus END AS version FROM orders),
s AS (SELECT y, list_sort(list(DISTINCT rule || version)) AS ids FROM i GROUP BY y)
SELECT y, a.ids IS NOT DISTINCT FROM b.ids AS compatible FROM (SELECT y + 1 AS y, ids FROM s) a FULL JOIN s b USING (y)""")
def report_compatibility(spark, sf):
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("y"), "o_orderpriority", F.when(F.year("o_orderdate") % 3 == 0, "X").otherwise(F.col("o_orderstatus")).alias("version"))
    return facts.compatible(o.withColumn("y", F.col("y") + 1), o, ["o_orderpriority", "version"], ["y"])


@query("""SELECT event_id, CASE event_type WHEN 'signup' THEN 'planned' WHEN 'purchase' THEN 'done' END AS state, CASE WHEN json_extract_string(props, '$.k') = '26' THEN 'false' END AS visible FROM events""")
def concept_rules(spark, sf):
    from lodestar.operators.knowledge import metadata_equals

    return table(spark, sf, "events").select("event_id", facts.state_mapping(F.col("event_type"), {"signup": "planned", "purchase": "done"}).alias("state"), facts.visibility(metadata_equals(F.col("props"), "k", 26.0), False).cast("string").alias("visible"))


@query("""SELECT c_custkey AS id, concat_ws(';', CASE WHEN c_custkey % 3 > 0 THEN 'title=Name:' || c_name END, CASE WHEN c_custkey % 4 > 0 THEN 'type=Type:' || substr(repeat(c_mktsegment || ' ', 9), 1, 48) END) AS fields FROM customer""")
def node_fields(spark, sf):
    k = F.col("c_custkey")
    own = facts.node_fields([("title", "Name", F.when(k % 3 > 0, F.col("c_name"))), ("type", "Type", F.when(k % 4 > 0, F.repeat(F.concat("c_mktsegment", F.lit(" ")), F.lit(9))).otherwise(" "))])
    text = F.array_join(F.transform(own, lambda f: F.concat(f["source"], F.lit("="), f["label"], F.lit(":"), f["value"])), ";")
    return table(spark, sf, "customer").select(k.alias("id"), text.alias("fields"))


@query("""WITH w(capability) AS (VALUES ('source:public-symbol.documentation'), ('source:file.line_count'), ('source:callable.depth'), ('source:roles'), ('source:visibility')),
m AS (SELECT DISTINCT CASE p_size % 10 WHEN 1 THEN 'source:visibility' WHEN 2 THEN 'source:declarations' WHEN 3 THEN 'source:imports' ELSE 'source:other' || p_size END AS c FROM part)
SELECT capability, CASE capability WHEN 'source:public-symbol.documentation' THEN EXISTS (FROM m WHERE c IN ('source:documentation', 'source:visibility')) WHEN 'source:file.line_count' THEN EXISTS (FROM m WHERE c IN (capability, 'source:size', 'source:files'))
  WHEN 'source:callable.depth' THEN EXISTS (FROM m WHERE c IN (capability, 'source:callable.metrics', 'source:declarations')) ELSE EXISTS (FROM m WHERE c = capability) END AS mentioned FROM w""")
def capability_mentions(spark, sf):
    wanted = spark.createDataFrame([("source:" + c,) for c in ("public-symbol.documentation", "file.line_count", "callable.depth", "roles", "visibility")], "capability string")
    n, size = F.col("p_size") % 10, F.col("p_size").cast("string")
    name = F.when(n == 1, "source:visibility").when(n == 2, "source:declarations").when(n == 3, "source:imports").otherwise(F.concat(F.lit("source:other"), size))
    return facts.mentioned(wanted, table(spark, sf, "part").select(name.alias("capability")))


#: Conditions around an import, by size: version checks, constants, names, chains of them.
CONDITION = """CASE p_size % 6 WHEN 0 THEN '' WHEN 1 THEN 'if sys.version_info >= (3, ' || p_size % 15 || '):' WHEN 2 THEN 'if True: -> elif sys.version_info < (3, ' || p_size % 15 || '):'
  WHEN 3 THEN 'if TYPE_CHECKING:' WHEN 4 THEN 'if TYPE_CHECKING: -> if False:' ELSE 'if sys.version_info != (3, 9): -> if os.name:' END"""
STATE = """CASE p_size % 6 WHEN 0 THEN true WHEN 1 THEN 10 >= p_size % 15 WHEN 2 THEN 10 < p_size % 15 WHEN 4 THEN false END"""


@query(f"SELECT p_partkey AS id, CAST({STATE} AS VARCHAR) AS holds FROM part")
def python_conditions(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), facts.python_condition(F.expr(CONDITION), F.lit(10)).cast("string").alias("holds"))


@query(f"""WITH o AS (SELECT p_brand AS package, p_name AS imported, CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE '' END AS alias, 'm' || p_size % 3 AS module, {STATE} AS state, p_size % 6 > 0 AS cond, p_partkey AS ord FROM part WHERE p_partkey % 9 > 0)
SELECT package, CASE WHEN alias = '' THEN imported ELSE alias END AS name, arg_min(module, ord) AS module, min(module) < max(module) AS ambiguous, NOT bool_or(NOT cond OR coalesce(state, false)) AS conditional FROM o WHERE coalesce(state, true) GROUP BY ALL""")
def python_reexports(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    state = facts.python_condition(F.expr(CONDITION), F.lit(10))
    o = p.select(F.col("p_brand").alias("package"), F.when(k % 9 == 0, "*").otherwise(F.col("p_name")).alias("imported"), F.when(k % 4 == 0, F.col("p_type")).otherwise("").alias("alias"), F.concat(F.lit("m"), (F.col("p_size") % 3).cast("string")).alias("module"), state.alias("state"), (F.col("p_size") % 6 > 0).alias("conditional"), k.alias("ord"))
    return facts.reexports(o, "ord")


@query("SELECT user_id, event_type AS k, arg_min(CAST(value AS VARCHAR), event_id) AS v FROM (SELECT user_id, event_id, event_type, CAST(value * 100 AS BIGINT) AS value FROM events) GROUP BY user_id, event_type")
def metadata_merge(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.create_map("event_type", F.round(F.col("value") * 100).cast("long").cast("string")).alias("metadata"))
    return model.merge_metadata(e, "user_id", "event_id", "metadata").select("user_id", F.explode("metadata").alias("k", "v"))


@query("SELECT 'north::' || 'c%2F' || c_custkey AS id, 'north' AS scope_id FROM customer WHERE c_nationkey < 12 UNION ALL SELECT 'south::' || 'c%2F' || c_custkey, 'south' FROM customer WHERE c_nationkey > 9")
def combined_scopes(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", F.concat(F.lit("c/"), F.col("c_custkey").cast("string")).alias("id"))
    return model.union_of_scopes([("north", c.filter("c_nationkey < 12").select("id")), ("south", c.filter("c_nationkey > 9").select("id"))], ["id"])


@query("""WITH s AS (SELECT c_custkey AS root, CASE c_custkey % 3 WHEN 0 THEN 'cli' WHEN 1 THEN 'assignment' ELSE 'automatic' END AS source, c_nationkey AS place FROM customer), p AS (SELECT *, CASE source WHEN 'cli' THEN 3 WHEN 'assignment' THEN 2 ELSE 1 END AS priority FROM s WHERE place % 4 > 0 OR source <> 'cli')
SELECT place, root, priority FROM p QUALIFY priority = max(priority) OVER (PARTITION BY place)""")
def selection_priority(spark, sf):
    k = F.col("c_custkey") % 3
    s = table(spark, sf, "customer").select(F.col("c_custkey").alias("root"), F.when(k == 0, "cli").when(k == 1, "assignment").otherwise("automatic").alias("source"), F.col("c_nationkey").alias("place"))
    return planning.consolidate(s.filter("place % 4 > 0 or source <> 'cli'"), ["place"]).select("place", "root", "priority")


@query("SELECT p_partkey AS id, 'metric:' || substr(sha256(concat_ws(chr(0), p_brand, p_type, CAST(p_size AS VARCHAR))), 1, 24) AS metric FROM part")
def metric_ids(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("metric:"), ids.digest_part("p_brand", "p_type", "p_size")).alias("metric"))


@query("""SELECT o_custkey AS id, list_sort(list(DISTINCT o_orderstatus) FILTER (o_orderstatus <> 'O')) IS NOT DISTINCT FROM list_sort(list(DISTINCT CASE WHEN o_totalprice > 100000 THEN 'F' ELSE 'P' END)) AS same FROM orders GROUP BY o_custkey""")
def same_sets(spark, sf):
    shown = F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderstatus"))
    g = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set(shown).alias("a"), F.collect_set(F.when(F.col("o_totalprice") > 100000, "F").otherwise("P")).alias("b"))
    return g.select("id", model.same_set(model.sorted_distinct(F.col("a"), drop_empty=True), F.col("b")).alias("same"))


@query("""WITH RECURSIVE up(id, top, path) AS (SELECT s_suppkey, s_suppkey // 2, [s_suppkey // 2, s_suppkey] FROM supplier WHERE s_suppkey > 0 UNION ALL SELECT id, top // 2, list_prepend(top // 2, path) FROM up WHERE top > 0)
SELECT id, array_to_string(path, '>') AS path FROM up WHERE top = 0 UNION ALL SELECT 0, '0'""")
def breadcrumbs(spark, sf):
    from lodestar.operators import graph

    parents = table(spark, sf, "supplier").filter("s_suppkey > 0").select(F.col("s_suppkey").alias("child"), F.expr("s_suppkey div 2").alias("parent"))
    return graph.paths_to_roots(parents).select("id", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query("""SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'File' WHEN 1 THEN 'Callable' ELSE 'Subject' END || ' has ' || p_size || CASE p_size % 3 WHEN 0 THEN ' lines' WHEN 1 THEN ' nesting depth' ELSE ' methods' END || '; ' ||
CASE p_partkey % 4 WHEN 0 THEN 'configured maximum is 20' WHEN 1 THEN 'configured maximum is 20 or less' WHEN 2 THEN 'configured value must not be 20' ELSE 'configured limit is 20' END AS message FROM part""")
def threshold_messages(spark, sf):
    n, k = F.col("p_size") % 3, F.col("p_partkey") % 4
    rule = F.when(n == 0, "source:file.max-lines").when(n == 1, "source:callable.max-nesting-depth").otherwise("own")
    operator = F.when(k == 0, "greater_than").when(k == 1, "less_or_equal").when(k == 2, "not_equal").otherwise("other")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), facts.threshold_message(rule, F.lit("unit:methods"), F.col("p_size"), operator, F.lit(20)).alias("message"))


@query("""WITH s AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 5 = 0 THEN 'x' ELSE '00' END || o_custkey AS a, CAST(o_orderkey % 700 AS VARCHAR) AS b FROM orders)
SELECT id, CASE WHEN starts_with(a, 'x') THEN a < b ELSE CAST(a AS BIGINT) < CAST(b AS BIGINT) END AS less FROM s""")
def sequence_order(spark, sf):
    a = F.concat(F.when(F.col("o_custkey") % 5 == 0, "x").otherwise("00"), F.col("o_custkey").cast("string"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), facts.sequence_less(a, (F.col("o_orderkey") % 700).cast("string")).alias("less"))


@query("""SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN p_brand || ' || windows' ELSE CASE WHEN p_brand < 'cgo' THEN p_brand || ' || windows;cgo' ELSE 'cgo;' || p_brand || ' || windows' END END AS constraints FROM part""")
def build_constraints(spark, sf):
    n, brand = F.col("p_size") % 3, F.concat(F.lit("//go:build "), "p_brand", F.lit(" || windows \n"))
    content = F.when(n == 0, F.concat(F.lit("package a\n"), brand)).when(n == 1, F.concat(F.lit("// about\r\n\r\n"), brand, F.lit("package a\n// +build late\n"))).otherwise(F.concat(F.lit("  // +build cgo\n"), brand))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(facts.build_constraints(content), ";").alias("constraints"))


@query("""SELECT 'model:relation:' || substr(sha256(concat_ws(chr(0), 'relation', lang, 'module-file', source, CAST(doc_id AS VARCHAR))), 1, 16) AS relation_id, source AS module_id, doc_id AS file_id, CAST(strlen(text) AS BIGINT) AS end_byte,
  CAST(len(string_split(text, chr(10))) AS BIGINT) AS end_line, CAST(strlen(string_split(text, chr(10))[-1]) + 1 AS BIGINT) AS end_column FROM documents WHERE source <> 'src3' AND text IS NOT NULL""")
def module_file_relations(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null")
    own = facts.module_file_relations(d.select(F.col("lang").alias("scope_id"), F.when(F.col("source") != "src3", F.col("source")).alias("module_id"), F.col("doc_id").alias("file_id"), F.col("text").alias("content")))
    return own.select("relation_id", "module_id", "file_id", *[F.col(c).cast("long").alias(c) for c in ("end_byte", "end_line", "end_column")])


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE 'observed' END AS status, 'syntax' AS basis, CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'extractor:source-index' END AS provider, '1.0.0' AS provider_version,
  CASE WHEN p_size % 4 = 0 THEN 'e' || p_size ELSE 'scope:s:' || p_brand END AS evidence FROM part""")
def metric_provenance(spark, sf):
    n = F.col("p_size")
    own = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), "p_brand", F.when(n % 3 == 0, F.col("p_brand")).when(n % 3 == 1, "").alias("status"), F.lit("").alias("basis"), F.when(n % 2 == 0, F.col("p_type")).otherwise("").alias("provider"),
        F.lit(None).cast("string").alias("provider_version"), F.when(n % 4 == 0, F.array(F.concat(F.lit("e"), n.cast("string")))).when(n % 4 == 1, F.expr("cast(array() as array<string>)")).alias("evidence_ids"),
    )
    out = facts.with_provenance(own, "syntax", "extractor:source-index", "1.0.0", F.concat(F.lit("scope:s:"), "p_brand"))
    return out.select("id", "status", "basis", "provider", "provider_version", F.array_join("evidence_ids", ",").alias("evidence"))


@query("SELECT l_suppkey AS owner, count(DISTINCT l_partkey) AS dependencies, count(DISTINCT l_partkey) FILTER (l_partkey % 3 > 0) AS concrete FROM lineitem GROUP BY l_suppkey")
def dependency_counts(spark, sf):
    return facts.dependency_counts(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("name"), (F.col("l_partkey") % 3 == 0).alias("interface")))


@query("""SELECT c_custkey AS id, CASE WHEN c_nationkey % 3 = 0 THEN 'result' WHEN c_nationkey % 2 = 0 THEN 'manifest' ELSE 'job' END AS analyzer, CASE WHEN c_nationkey % 3 = 0 THEN c_name WHEN c_nationkey % 2 = 0 THEN c_mktsegment ELSE 'v1' END AS version FROM customer""")
def scope_summaries(spark, sf):
    def part(name, given, version):
        return F.struct(F.when(given, name).otherwise("").alias("analyzer"), F.when(given, name).otherwise("").alias("id"), version.alias("version")).alias(name)

    n = F.col("c_nationkey")
    jobs = table(spark, sf, "customer").select("c_custkey", part("result", n % 3 == 0, F.col("c_name")), part("manifest", n % 2 == 0, F.col("c_mktsegment")), part("job", F.lit(True), F.lit("v1")))
    return jobs.select(F.col("c_custkey").alias("id"), *facts.analyzer_of(["analyzer", "version"], ["result", "manifest", "job"]))


@query("""SELECT c_custkey AS use_id, CASE c_custkey % 5 WHEN 0 THEN 'n' || n_nationkey WHEN 1 THEN 'r' || r_regionkey WHEN 4 THEN 'n' || n_nationkey END AS module, CASE c_custkey % 5 WHEN 2 THEN 'standard_library' WHEN 3 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'external' ELSE 'unresolved' END ELSE 'local' END AS scope
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def rust_uses(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    places = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    region, nation = F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    modules = r.select(region.alias("module_id"), F.col("r_name").alias("key")).unionByName(places.select(nation.alias("module_id"), F.concat_ws("::", "r_name", "n_name").alias("key")))
    k = F.col("c_custkey") % 5
    path = F.when(k == 0, F.concat_ws("::", F.lit("crate"), "r_name", "n_name", F.lit("Item"))).when(k == 1, F.concat_ws("::", F.lit("super"), F.lit("super"), "r_name", F.lit("missing")))
    path = path.when(k == 2, "std::fs").when(k == 3, F.concat(F.lit("dep_"), F.col("c_nationkey").cast("string"))).otherwise("self")
    c = table(spark, sf, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    uses = c.select(F.col("c_custkey").alias("use_id"), nation.alias("module_id"), F.when(~k.isin(2, 3), F.array("r_name", "n_name")).otherwise(F.expr("cast(array() as array<string>)")).alias("module_path"), path.alias("path"), F.lit("own").alias("package"))
    crates = n.filter("n_nationkey % 2 = 0").select(F.concat(F.lit("dep-"), F.col("n_nationkey").cast("string")).alias("name"))
    return facts.resolved_uses(uses, modules, crates).select("use_id", F.col("module_id_used").alias("module"), "scope")
