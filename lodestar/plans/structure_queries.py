"""Registered queries over inherited options, bounded projections and package exports, with their DuckDB counterparts.

Suppliers are profiles and concepts: supplier n inherits from suppliers n / 2 and n / 3 and stands below n / 8; what follows
another within an order is related to it. Parts are packages, whose exports are nested JSON of their columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import exports, inheritance, projection, validation
from lodestar.operators.index import SourceIndex
from lodestar.operators.tables import shared_path, written
from lodestar.plans import domain as D
from lodestar.plans.domain import sql, table
from lodestar.plans.queries import WITHOUT_SQL, query
from lodestar.sources import cargo, rust, trees
from lodestar.streaming import watch

#: Every seventh supplier also names a base that does not exist, and 1 and 5 inherit from each other.
PROFILES = """
bases AS (SELECT s_suppkey AS id, 1 AS ord, s_suppkey // 2 AS base FROM supplier WHERE s_suppkey > 1 UNION ALL SELECT s_suppkey, 2, s_suppkey // 3 FROM supplier WHERE s_suppkey > 2
          UNION ALL SELECT s_suppkey, 3, -s_suppkey FROM supplier WHERE s_suppkey % 7 = 0 UNION ALL SELECT 1, 1, 5),
own AS (SELECT s_suppkey AS id, 'nation' AS key, CAST(s_nationkey AS VARCHAR) AS value FROM supplier WHERE s_nationkey % 3 = 0
        UNION ALL SELECT s_suppkey, 'balance', CAST(CAST(floor(s_acctbal / 1000) AS BIGINT) AS VARCHAR) FROM supplier WHERE s_acctbal < 3000 UNION ALL SELECT s_suppkey, 'name', CASE WHEN s_suppkey % 10 = 4 THEN NULL ELSE s_name END FROM supplier WHERE s_suppkey % 5 = 4),
way(root, node, steps, trail) AS (
  SELECT s_suppkey, s_suppkey, CAST([] AS INTEGER[]), [s_suppkey] FROM supplier
  UNION ALL SELECT root, base, list_append(steps, CAST(-ord AS INTEGER)), list_append(trail, base) FROM way JOIN bases ON id = node WHERE base > 0 AND NOT list_contains(trail, base)),
first AS (SELECT root, node, min(steps) AS steps FROM way GROUP BY ALL)"""


def _profiles(spark, sf):
    s = table(spark, sf, "supplier")
    key = F.col("s_suppkey")
    base = lambda ord_, where, to: s.filter(where).select(key.alias("id"), F.lit(ord_).alias("ord"), to.alias("base"))
    bases = base(1, "s_suppkey > 1", F.floor(key / 2)).unionByName(base(2, "s_suppkey > 2", F.floor(key / 3))).unionByName(base(3, "s_suppkey % 7 = 0", -key)).unionByName(base(1, "s_suppkey = 1", F.lit(5).cast("long")))
    own = lambda where, name, value: s.filter(where).select(key.alias("id"), F.lit(name).alias("key"), value.alias("value"))
    options = own("s_nationkey % 3 = 0", "nation", F.col("s_nationkey").cast("string")).unionByName(own("s_acctbal < 3000", "balance", F.floor(F.col("s_acctbal") / 1000).cast("string")))
    options = options.unionByName(own("s_suppkey % 5 = 4", "name", F.when(key % 10 != 4, F.col("s_name"))))
    return D.vertices(spark, sf), bases, options


@query("WITH RECURSIVE " + PROFILES + """,
met AS (SELECT root, key, value, o.id AS origin, len(steps) AS depth, row_number() OVER (PARTITION BY root, key ORDER BY steps) AS r FROM first JOIN own o ON o.id = node)
SELECT root AS id, key, value, origin, CAST(depth AS INTEGER) AS depth FROM met WHERE r = 1""")
def profile_options(spark, sf):
    return inheritance.effective_options(*_profiles(spark, sf))[0]


@query("WITH RECURSIVE " + PROFILES + """,
bad AS (SELECT root FROM first JOIN bases ON id = node WHERE base < 0 UNION SELECT root FROM way JOIN bases ON id = node WHERE list_contains(trail, base))
SELECT s_suppkey AS id, CASE WHEN s_suppkey IN (SELECT root FROM bad) THEN 'invalid' ELSE 'valid' END AS status FROM supplier""")
def profile_states(spark, sf):
    nodes, bases, _ = _profiles(spark, sf)
    return inheritance.profile_states(nodes, inheritance.inherited_nodes(nodes, bases)[1])


FOREST = """,
concept AS (SELECT s_suppkey AS id, s_acctbal >= 1000 OR s_acctbal IS NULL AS visible, nullif(s_suppkey // 8, 0) AS parent FROM supplier),
links AS (SELECT 'depends_on' AS kind, src * 1000000 + dst AS relationship_id, src, dst, false AS contains FROM cand UNION ALL SELECT 'contains', id, parent, id, true FROM concept WHERE parent IS NOT NULL),
walk(id, visible, depth, path) AS (SELECT id, visible, 0, [id] FROM concept WHERE parent IS NULL UNION ALL SELECT c.id, c.visible, depth + 1, list_append(path, c.id) FROM walk w JOIN concept c ON c.parent = w.id WHERE depth < 2),
ranked AS (SELECT *, row_number() OVER (ORDER BY path) AS r FROM walk WHERE visible),
shown AS (SELECT * FROM ranked WHERE r <= 40),
possible AS (SELECT *, row_number() OVER (ORDER BY kind, relationship_id) AS r FROM links WHERE src IN (SELECT id FROM shown) AND dst IN (SELECT id FROM shown))"""


def _projection(spark, sf):
    s = table(spark, sf, "supplier")
    concepts = s.select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") >= 1000).alias("visible"))
    parents = s.filter("s_suppkey >= 8").select(F.col("s_suppkey").alias("child"), F.floor(F.col("s_suppkey") / 8).alias("parent"))
    links = D.all_edges(spark, sf).select(F.lit("depends_on").alias("kind"), F.col("edge_id").alias("relationship_id"), "src", "dst", F.lit(False).alias("contains"))
    links = links.unionByName(parents.select(F.lit("contains").alias("kind"), F.col("child").alias("relationship_id"), F.col("parent").alias("src"), F.col("child").alias("dst"), F.lit(True).alias("contains")))
    return projection.bounded_projection(concepts, parents, links, depth=2, max_nodes=40, max_relationships=150)


@query(sql("cand", "").rstrip().replace("WITH", "WITH RECURSIVE", 1) + FOREST + "\nSELECT id, depth, CAST(r - 1 AS INTEGER) AS place FROM shown")
def projection_nodes(spark, sf):
    return _projection(spark, sf).nodes


@query(sql("cand", "").rstrip().replace("WITH", "WITH RECURSIVE", 1) + FOREST + "\nSELECT kind, relationship_id, src, dst, CAST(r - 1 AS INTEGER) AS place FROM possible WHERE r <= 150")
def projection_relationships(spark, sf):
    return _projection(spark, sf).relationships


@query(sql("cand", "").rstrip().replace("WITH", "WITH RECURSIVE", 1) + FOREST + """,
n AS (SELECT (SELECT count(*) FROM shown) AS visible_nodes, (SELECT count(*) FROM concept) AS concepts, (SELECT count(*) FROM possible WHERE r <= 150) AS visible_relationships, (SELECT count(*) FROM links) AS links,
  (SELECT max(path) FROM walk) > (SELECT max(path) FROM shown) AS later, (SELECT count(*) FROM possible) > 150 AS relationships_cut)
SELECT visible_nodes, concepts - visible_nodes AS hidden_nodes, visible_relationships, links - visible_relationships AS hidden_relationships, visible_nodes = 40 AND later AS nodes_cut, relationships_cut,
  CASE WHEN visible_nodes = 40 AND later OR relationships_cut THEN 'truncated' ELSE 'ready' END AS status FROM n""")
def projection_counts(spark, sf):
    return _projection(spark, sf).counts


@query("""WITH r AS (SELECT p_partkey AS request_id, p_size % 5 AS shape, p_size % 3 AS runtime, p_name AS name, p_brand AS brand FROM part)
SELECT request_id, CASE shape
  WHEN 0 THEN './' || name || '.js'
  WHEN 1 THEN CASE WHEN runtime = 1 THEN './cjs/' || brand || '.cjs' ELSE './esm/' || brand || '.mjs' END
  WHEN 2 THEN CASE WHEN runtime = 1 THEN './lib/' || brand || '/index.cjs' ELSE './lib/' || brand || '/index.js' END
  WHEN 3 THEN './' || brand || '.d.ts' END AS target FROM r""")
def package_exports(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("request_id"), (F.col("p_size") % 5).alias("shape"), F.element_at(F.array(F.lit("esm"), F.lit("cjs"), F.lit("auto")), (F.col("p_size") % 3 + 1).cast("int")).alias("runtime"), "p_name", "p_brand")
    quoted = lambda *parts: F.concat(F.lit('"'), *parts, F.lit('"'))
    json = (
        F.when(F.col("shape") == 0, F.concat(F.lit('[{"browser": 1}, null, {"default": '), quoted(F.lit("./"), F.col("p_name"), F.lit(".js")), F.lit("}]")))
        .when(F.col("shape") == 1, F.lit('{"./features/*": null, "./*": {"types": {}, "import": "./esm/*.mjs", "require": ["./cjs/*.cjs"]}}'))
        .when(F.col("shape") == 2, F.lit('{".": "./never.js", "./*": {"node": {"browser": "./no.js"}, "default": {"require": "./lib/*/index.cjs", "import": "./lib/*/index.js"}}, "./*/x": "./no.js"}'))
        .when(F.col("shape") == 3, F.concat(F.lit('{"default": "./late.js", "types": '), quoted(F.lit("./"), F.col("p_brand"), F.lit(".d.ts")), F.lit("}")))
        .otherwise(F.lit('{"./other": "./other.js", "./oth*er": "./o.js"}'))
    )
    return exports.package_exports(p.select("request_id", json.alias("exports"), F.concat(F.lit("./"), "p_brand").alias("subpath"), "runtime"))


TREE = """, f AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'node_modules/' WHEN doc_id % 11 = 1 THEN 'Build/' ELSE '' END || path AS path, coalesce(strlen(content), 0) AS bytes FROM files WHERE doc_id IS NOT NULL)"""


@query(sql("files", "").rstrip() + TREE + "\nSELECT path, bytes, split_part(path, '/', 1) AS top FROM f WHERE path NOT LIKE 'node_modules/%' AND path NOT LIKE 'Build/%'")
def tree_scan(spark, sf):
    """The documents as a tree of files in the shared folder, read back by the tree source."""
    f = D.files(spark, sf).filter("doc_id is not null")
    prefix = F.when(F.col("doc_id") % 11 == 0, "node_modules/").when(F.col("doc_id") % 11 == 1, "Build/").otherwise("")
    root = shared_path(spark, "tree")
    trees.write_tree(f.select(F.concat(prefix, "path").alias("path"), "content"), root).write.format("noop").mode("overwrite").save()
    return trees.scan(spark, root).select("path", "bytes", F.split("path", "/")[0].alias("top"))


def watch_plans(spark, sf):
    """The events as a stream of changes, a session for each remainder of the user by 50; purchases rename, errors end builds.
    SQL has no counterpart of the fold over a session's state; tests/test_watch.py holds it against brute force."""
    e = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/event[s].parquet")  # a pattern: the source takes no single file
    user = F.pmod("user_id", F.lit(50))
    kind = F.when(F.col("event_type") == "error", "built").otherwise(F.element_at(F.create_map(*[F.lit(x) for p in D.KIND_OF_EVENT.items() for x in p]), F.col("event_type")))
    path = F.concat(F.lit("src/u"), F.col("user_id").cast("string"))
    own = e.select(user.cast("string").alias("session"), F.col("event_id").alias("seq"), path.alias("path"), F.when(F.col("event_type") == "purchase", F.concat(path, F.lit(".old"))).alias("old_path"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    return watch.drained(watch.rebuild_plans(own, "0 seconds", debounce_ms=3_600_000, gaps=False), shared_path(spark, "watch"))


WITHOUT_SQL["watch_plans"] = watch_plans


#: Supplier n is the module s<n>: every third a folder with mod.rs, some with #[path], for tests alone, or without a file.
RUST = """WITH RECURSIVE m AS (SELECT s_suppkey AS id, s_suppkey // 8 AS parent, 's' || s_suppkey AS name FROM supplier WHERE s_suppkey > 0 AND s_suppkey % 11 <> 5),
place AS (SELECT *, CASE WHEN id % 7 = 3 THEN '/odd_' || id || '.rs' WHEN id % 3 = 0 THEN '/' || name || '/mod.rs' ELSE '/' || name || '.rs' END AS tail FROM m),
walk(id, module, dir, file) AS (SELECT CAST(0 AS BIGINT), '', 'k/src', 'k/src/lib.rs'
  UNION ALL SELECT p.id, w.module || CASE WHEN w.module = '' THEN '' ELSE '::' END || p.name, w.dir || '/' || p.name, w.dir || p.tail FROM walk w JOIN place p ON p.parent = w.id WHERE p.id % 13 <> 6)"""


def _rust_files(spark, sf):
    s = table(spark, sf, "supplier").filter("s_suppkey > 0").select(F.col("s_suppkey").alias("id"), F.floor(F.col("s_suppkey") / 8).alias("parent"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("name"))
    key = F.col("id").cast("string")
    item = F.concat(F.when(F.col("id") % 7 == 3, F.concat(F.lit('#[path = "odd_'), key, F.lit('.rs"]\n'))).otherwise(""), F.when(F.col("id") % 11 == 5, F.lit("#[cfg(test)]\n")).otherwise(""), F.lit("pub mod "), "name", F.lit("; // mod no;\n"))
    content = s.groupBy("parent").agg(F.array_join(F.array_sort(F.collect_list(F.struct("id", item.alias("text"))))["text"], "").alias("content"))  # eight at most
    up = F.transform(F.reverse(F.filter(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.floor(F.col("id") / F.pow(F.lit(8.0), k)).cast("long")), lambda x: x > 0)), lambda x: F.concat(F.lit("s"), x.cast("string")))
    folder = F.concat_ws("/", F.lit("k/src"), F.slice(up, F.lit(1), F.greatest(F.size(up) - 1, F.lit(0))))
    file = F.when(F.col("id") % 7 == 3, F.concat(F.lit("odd_"), key, F.lit(".rs"))).when(F.col("id") % 3 == 0, F.concat("name", F.lit("/mod.rs"))).otherwise(F.concat("name", F.lit(".rs")))
    own = s.filter("id % 13 <> 6").select("id", F.concat(folder, F.lit("/"), file).alias("path")).unionByName(spark.range(1).select("id", F.lit("k/src/lib.rs").alias("path")))
    return own.join(content.withColumnRenamed("parent", "id"), "id", "left").select("path", F.coalesce("content", F.lit("// empty")).alias("content"))


def _rust_tree(spark, sf):
    files = _rust_files(spark, sf)
    return rust.module_tree(files, files.filter("path = 'k/src/lib.rs'").select(F.lit("k").alias("crate"), F.lit("k").alias("folder"), F.col("path").alias("file")))


@query(RUST + "\nSELECT module, file, CASE WHEN id = 0 THEN 'crate' ELSE 'file_module' END AS kind FROM walk")
def rust_modules(spark, sf):
    return _rust_tree(spark, sf)[0].select(F.array_join("module", "::").alias("module"), "file", "kind")


@query(RUST + "\nSELECT w.file, 'source_missing' AS code, CASE WHEN p.id % 7 = 3 THEN 'odd_' || p.id || '.rs' ELSE p.name END AS subject FROM walk w JOIN place p ON p.parent = w.id WHERE p.id % 13 = 6")
def rust_module_diagnostics(spark, sf):
    return _rust_tree(spark, sf)[1].select("file", "code", "subject")


#: Files are documents, in a batch for each source and language; each has a symbol on line 1 + doc_id % 9, if it has so many.
INDEX = sql("files", "").rstrip() + """,
f AS (SELECT source || '/' || lang AS batch, doc_id, source, lang, CASE WHEN coalesce(content, '') = '' THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + CAST(NOT suffix(content, chr(10)) AS BIGINT) END AS lines FROM files WHERE doc_id IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL),
bad AS (SELECT batch, count(*) AS facts, count(*) FILTER (1 + doc_id % 9 > lines + 6) AS wrong FROM f GROUP BY batch)"""


def _index(spark, sf):
    from lodestar.functions.text import physical_lines

    f = D.files(spark, sf).filter("doc_id is not null and source is not null and lang is not null")
    key = F.col("doc_id").cast("string")
    f = f.select(F.concat_ws("/", "source", "lang").alias("batch"), F.concat(F.lit("f"), key).alias("file_id"), "path", physical_lines(F.coalesce("content", F.lit(""))).alias("n"), F.col("doc_id").alias("id"), F.concat(F.lit("s"), key).alias("symbol_id"))
    line = 1 + F.col("id") % 9
    symbols = f.select("batch", "symbol_id", "file_id", F.concat(F.lit("k"), (F.col("id") % 100).cast("string")).alias("key"), line.alias("line"), line.alias("end_line"))
    relations = f.filter("id % 4 = 0").select("batch", F.concat(F.lit("r"), F.col("id").cast("string")).alias("relation_id"), F.col("symbol_id").alias("from_id"), F.concat(F.lit("k"), (F.col("id") % 130).cast("string")).alias("to_key"))
    index = SourceIndex(spark, shared_path(spark, "index"))
    index.append("all", {"files": f.select("batch", "file_id", "path", (F.col("n") + 6).alias("lines")), "symbols": symbols, "relations": relations})
    return index


@query(INDEX + "\nSELECT lang AS capability, count(*) AS batches, count(*) FILTER (wrong = 0) AS committed, CAST(coalesce(sum(total) FILTER (wrong = 0), 0) AS BIGINT) AS facts, CASE WHEN count(*) FILTER (wrong = 0) = count(*) THEN 'observed' WHEN count(*) FILTER (wrong = 0) > 0 THEN 'partial' ELSE 'not_evaluable' END AS status\nFROM (SELECT split_part(f.batch, '/', 2) AS lang, wrong, 2 * count(*) + count(*) FILTER (doc_id % 4 = 0) AS total FROM f JOIN bad USING (batch) GROUP BY f.batch, wrong) GROUP BY lang")
def index_coverage(spark, sf):
    return _index(spark, sf).coverage(F.split("batch", "/")[1])


@query(INDEX + """,
s AS (SELECT doc_id, 'k' || doc_id % 100 AS key FROM f JOIN bad USING (batch) WHERE wrong = 0),
k AS (SELECT key, count(*) AS n, min('s' || doc_id) AS one FROM s GROUP BY key)
SELECT 'r' || doc_id AS relation_id, 'k' || doc_id % 130 AS to_key, CASE WHEN n = 1 THEN one END AS to_id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status
FROM s LEFT JOIN k ON k.key = 'k' || doc_id % 130 WHERE doc_id % 4 = 0""")
def index_relations(spark, sf):
    return _index(spark, sf).relations().drop("from_id")


#: Five parts are the bindings of a profile; the catalogue has the types in version 1.0.0, those with an E apart.
VALIDATION = """WITH b AS (SELECT 'profile:' || p_partkey // 5 AS profile_id, p_partkey AS ord, p_partkey % 10 AS k, 'type:' || replace(p_type, ' ', '_') AS rule_id, CASE WHEN p_size % 9 = 0 THEN '2.0.0' WHEN p_size % 11 = 0 THEN 'two' ELSE '1.0.0' END AS rule_version,
  p_size, contains(p_type, 'E') AS lacking, p_partkey % 7 = 0 AS fatal FROM part),
known AS (SELECT DISTINCT rule_id FROM b WHERE NOT lacking),
n AS (SELECT *, row_number() OVER (PARTITION BY profile_id, rule_id, rule_version ORDER BY ord) AS nth, rule_id IN (SELECT rule_id FROM known) AS named FROM b),
c AS (SELECT *, CASE WHEN nth > 1 THEN 'duplicate_rule' WHEN rule_version = 'two' THEN 'rule_identity' WHEN NOT named THEN 'rule_unknown' WHEN rule_version = '2.0.0' THEN 'rule_unsupported' END AS code FROM n)
SELECT profile_id, ord, code, '' AS field FROM c WHERE code IS NOT NULL
UNION ALL SELECT profile_id, ord, 'severity', '' FROM c WHERE code IS NULL AND fatal
UNION ALL SELECT profile_id, ord, 'payload', '' FROM c WHERE code IS NULL AND k = 6
UNION ALL SELECT profile_id, ord, 'schema', '' FROM c WHERE code IS NULL AND k = 7
UNION ALL SELECT profile_id, ord, 'missing_field', 'limit' FROM c WHERE code IS NULL AND k = 5
UNION ALL SELECT profile_id, ord, 'unknown_field', 'more' FROM c WHERE code IS NULL AND k = 4
UNION ALL SELECT profile_id, ord, 'bad_value', 'limit' FROM c WHERE code IS NULL AND (k = 3 OR k NOT IN (5, 6, 7) AND p_size > 40)"""


@query(VALIDATION)
def profile_problems(spark, sf):
    k, size = F.col("p_partkey") % 10, F.col("p_size")
    limit = F.concat(F.lit('{"limit": '), size.cast("string"), F.lit("}"))
    payload = F.when(k == 3, '{"limit": "many"}').when(k == 4, F.concat(F.lit('{"more": [1], "limit": '), size.cast("string"), F.lit(".0}"))).when(k == 5, "{}").when(k == 6, "[1]").otherwise(limit)
    p = table(spark, sf, "part")
    rule_id = F.concat(F.lit("type:"), F.translate("p_type", " ", "_"))
    version = F.when(size % 9 == 0, "2.0.0").when(size % 11 == 0, "two").otherwise("1.0.0")
    own = F.concat(F.lit("profile:"), F.floor(F.col("p_partkey") / 5).cast("string"))
    bindings = p.select(own.alias("profile_id"), F.col("p_partkey").alias("ord"), rule_id.alias("rule_id"), version.alias("rule_version"), F.when(F.col("p_partkey") % 7 == 0, "fatal").otherwise("").alias("severity"), F.when(k == 7, "p:other").otherwise("p:limit").alias("namespace"), F.lit("1").alias("schema_version"), payload.alias("payload"))
    rules = p.filter(~F.contains("p_type", F.lit("E"))).select(rule_id.alias("rule_id"), F.lit("1.0.0").alias("rule_version"), F.lit("p:limit").alias("namespace"), F.lit("1").alias("schema_version")).distinct()
    fields = rules.select("rule_id", "rule_version", F.lit("limit").alias("field"), F.lit("integer").alias("kind"), F.lit(True).alias("required"), F.lit(1.0).alias("minimum"), F.lit(40.0).alias("maximum"), F.expr("cast(null as array<string>)").alias("allowed"))
    profiles = bindings.select("profile_id", F.lit("1.0.0").alias("profile_version"), F.lit("1.0.0").alias("schema_version")).distinct()
    return validation.profile_problems(profiles, bindings, rules, fields)


#: Customers are crates below the crates folder of a workspace; one in five is excluded by its name, one in seven has no lib.rs.
CARGO = """WITH c AS (SELECT c_custkey AS id, 'crates/' || CASE WHEN c_custkey % 5 = 0 THEN 'old' ELSE 'c' END || c_custkey AS folder, 'p' || c_custkey AS package, c_nationkey, c_custkey % 7 = 0 AS bare FROM customer)"""


def _cargo_files(spark, sf):
    k = F.col("c_custkey")
    key = k.cast("string")
    folder = F.concat(F.lit("crates/"), F.when(k % 5 == 0, "old").otherwise("c"), key)
    bins = F.when(k % 3 == 0, F.concat(F.lit('[[bin]]\nname = "tool'), key, F.lit('"\n'))).otherwise("")
    needs = F.concat(F.lit("[dependencies]\nshared = { workspace = true, features = ['n"), F.col("c_nationkey").cast("string"), F.lit("'] }\nown = '"), (k % 4).cast("string"), F.lit("'\n"))
    manifest = F.concat(F.lit('[package]\nname = "p'), key, F.lit('"\n'), bins, needs)
    c = table(spark, sf, "customer")
    part = lambda where, name, content: c.filter(where).select(F.concat(folder, F.lit("/"), name).alias("path"), content.alias("content"))
    root = spark.range(1).select(F.lit("Cargo.toml").alias("path"), F.lit('[workspace]\nmembers = ["crates/*"]\nexclude = ["crates/old*"]\n[workspace.dependencies]\nshared = { version = "9", path = "crates/c1", features = ["base"] }\n').alias("content"))
    tool = F.concat(F.lit("src/bin/tool"), key, F.lit(".rs"))
    return root.unionByName(part("true", F.lit("Cargo.toml"), manifest)).unionByName(part("c_custkey % 7 <> 0", F.lit("src/lib.rs"), F.lit(""))).unionByName(part("c_custkey % 6 = 0", tool, F.lit(""))).unionByName(part("c_custkey % 4 = 1", F.lit("src/main.rs"), F.lit("")))


@query(CARGO + """ SELECT folder, package AS name, 'lib' AS kind, folder || '/src/lib.rs' AS file FROM c WHERE NOT bare UNION ALL SELECT folder, 'tool' || id, 'bin', folder || '/src/bin/tool' || id || '.rs' FROM c WHERE id % 6 = 0
UNION ALL SELECT folder, package, 'bin', folder || '/src/main.rs' FROM c WHERE id % 4 = 1 AND id % 3 <> 0""")
def cargo_targets(spark, sf):
    files = _cargo_files(spark, sf)
    return cargo.targets(cargo.manifests(files), files)[0].drop("package")


@query(CARGO + """, m AS (SELECT *, id % 5 <> 0 AS member FROM c)
SELECT folder, 'shared' AS name, CASE WHEN member THEN '9' END AS version, CASE WHEN member THEN 'crates/c1' END AS folder_used, CASE WHEN member THEN 'base,n' || c_nationkey ELSE 'n' || c_nationkey END AS features FROM m
UNION ALL SELECT folder, 'own', CAST(id % 4 AS VARCHAR), NULL, '' FROM m""")
def cargo_dependencies(spark, sf):
    found = written(cargo.manifests(_cargo_files(spark, sf)))
    return cargo.dependencies(found, cargo.workspace_members(found)[0]).select("folder", "name", "version", "folder_used", F.array_join("features", ",").alias("features"))
