"""Facts by subject: documentation, membership, spans, references, diagnostics, typed values and source paths.

All of it is column expressions and equality joins; what can meet a hot key is reduced to distinct pairs before it is
collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.functions.ids import percent_encoded, stable_id
from lodestar.functions.paths import cleaned

#: Counts of a symbol that only a request for structural facts returns.
STRUCTURAL = (
    "structural_facts", "member_count", "method_count", "dependency_count", "concrete_dependency_count", "interface_method_count", "type_switch_count", "hierarchy_depth",
    "derived_type_count", "abstraction_count",
)
#: Titles of the boundaries that gather references by scope.
BOUNDARY_TITLES = {"standard_library": "Standard library", "external": "External references", "unresolved": "Unresolved references", "dynamic": "Dynamic references"}
#: The most diagnostics of a projection; lines of an excerpt by default beyond its first, and at most.
MOST_DIAGNOSTICS, EXCERPT_REST, EXCERPT_MOST = 200, 18, 120
#: Aliases under which other capabilities vouch for one.
PUBLIC_DOCUMENTATION, PUBLIC_ALIASES = "source:public-symbol.documentation", ("source:documentation", "source:visibility")
LINE_COUNT, LINE_ALIASES = "source:file.line_count", ("source:size", "source:files")
CALLABLE_PREFIX, CALLABLE_ALIASES = "source:callable.", ("source:callable.metrics", "source:declarations")

SPAN = ["file_id", "start", "end", "coordinates"]
JSON_STRING = r'\A"(?:[^"\\\x00-\x1F]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*+"\z'
JSON_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


def documentation_filter(subjects: list[str] = (), status: str = "", text: str = "", case_sensitive: bool = False) -> Column:
    """Conditions on subject_id, status, and the normalized text (the raw one where that is empty or null)."""
    out = F.lit(True)
    if subjects:
        out = out & F.col("subject_id").isin(*subjects)
    if status:
        out = out & T.contains(F.col("status"), status, case_sensitive)
    if text:
        out = out & T.contains(F.coalesce(F.nullif(F.col("normalized"), F.lit("")), F.col("raw")), text, case_sensitive)
    return out


def documentation_of(docs: DataFrame, files: DataFrame, symbols: DataFrame, others: bool = False) -> DataFrame:
    """Documentation (subject_kind, subject_id, ...) of the given files (file_id) and symbols (symbol_id); that of other kinds
    of subject only if no condition was asked (`others`)."""
    of_files = docs.filter("subject_kind = 'file'").join(files.select(F.col("file_id").alias("subject_id")), "subject_id", "left_semi")
    of_symbols = docs.filter("subject_kind = 'symbol'").join(symbols.select(F.col("symbol_id").alias("subject_id")), "subject_id", "left_semi")
    out = of_files.unionByName(of_symbols)
    return out.unionByName(docs.filter("coalesce(subject_kind not in ('file', 'symbol'), true)")) if others else out


def module_files(relations: DataFrame, modules: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(id): files that relations (category, from_kind, src, to_kind, dst) say the modules (id) contain, with the requested `files`."""
    own = relations.filter("category = 'contains' and from_kind = 'module' and to_kind = 'file'").join(modules.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    if files is not None:
        own = own.unionByName(files.select(F.trim("id").alias("id")).filter("id <> ''"))
    return own.distinct()


def file_symbols(relations: DataFrame, files: DataFrame) -> DataFrame:
    """(id): symbols that the files (id) contain or declare."""
    own = relations.filter("category in ('contains', 'declares') and from_kind = 'file' and to_kind = 'symbol'")
    return own.join(files.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()


def compact_symbols(symbols: DataFrame, projection: list[str] = ()) -> DataFrame:
    """Symbols whose structural counts are null unless `projection` asks for structural_facts."""
    if "structural_facts" in projection:
        return symbols
    return symbols.withColumns({c: F.lit(None).cast(symbols.schema[c].dataType) for c in STRUCTURAL if c in symbols.columns})


def rekeyed(refs: DataFrame, scope: str, maps: dict[str, DataFrame]) -> DataFrame:
    """References (kind, id) in a combined projection: ids from the kind's map (id, new_id), null if it lacks them; a
    module's is put in the scope's namespace; other kinds keep theirs."""
    table = reduce(DataFrame.unionByName, [m.select(F.lit(k).alias("kind"), "id", "new_id") for k, m in sorted(maps.items())])
    id_ = F.when(F.col("kind") == "module", F.concat(F.lit(f"{scope}::"), percent_encoded(F.col("id")))).when(F.col("kind").isin(*maps), F.col("new_id")).otherwise(F.col("id"))
    return refs.join(table, ["kind", "id"], "left").withColumn("id", id_).drop("new_id")


def normalized_path(path: Column) -> Column:
    """Slashes, no `./` in front, `.` and `..` resolved; an empty path is `.`."""
    slashed = F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), r"^\./", "")
    return F.when(slashed == "", ".").otherwise(cleaned(slashed))


def aggregate_path(root: Column, path: Column) -> Column:
    """A path below its project's root, as seen from the repository."""
    root, path = normalized_path(root), normalized_path(path)
    return F.when(root == ".", path).when(path == ".", root).otherwise(cleaned(F.concat_ws("/", root, path)))


def indexed_spans(targets: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """Targets that equal, in file, ends and coordinates, a span of one of the tables."""
    known = reduce(DataFrame.unionByName, [t.select(*SPAN) for t in tables])
    return targets.join(known, SPAN, "left_semi")


def owning_snapshot(entities: DataFrame, known: DataFrame) -> DataFrame:
    """Each entity (entity_id) with the one snapshot that `known` (snapshot_id, entity_id) holds it in: status found,
    missing or ambiguous."""
    n = known.groupBy("entity_id").agg(F.min("snapshot_id").alias("least"), F.max("snapshot_id").alias("most"))
    out = entities.join(n, "entity_id", "left")
    status = F.when(F.col("least").isNull(), "missing").when(F.col("least") < F.col("most"), "ambiguous").otherwise("found")
    return out.withColumn("status", status).withColumn("snapshot_id", F.when(F.col("status") == "found", F.col("least"))).drop("least", "most")


def decimal_value(json: Column) -> Column:
    """The finite number that a JSON text is; null for anything else."""
    d = F.when(json.rlike(JSON_NUMBER), json.try_cast("double"))
    return F.when(F.abs(d) < float("inf"), d)


def integer_value(json: Column) -> Column:
    """The integer that a JSON number is (2 and 2.0, not 2.5 nor "2"); null for anything else, and beyond 64 bits."""
    whole = F.regexp_extract(json, r"^(-?(?:0|[1-9][0-9]*))(?:\.0+)?$", 1)
    d, exact = decimal_value(json), json.try_cast("decimal(38,9)")  # of numbers with an exponent or a fraction
    return F.when(whole != "", whole.try_cast("bigint")).when((d == F.floor(d)) & (exact == F.floor(exact)), exact.cast("decimal(38,0)").cast("string").try_cast("bigint"))


def valid_metric_value(kind: Column, json: Column) -> Column:
    """Whether a value, as JSON, is of the kind it claims."""
    out = F.when(kind == "integer", integer_value(json).isNotNull()).when(kind == "decimal", decimal_value(json).isNotNull())
    out = out.when(kind == "boolean", json.isin("true", "false")).when(kind == "text", json.rlike(JSON_STRING))
    return F.coalesce(out, F.lit(False))


def reference_nodes(references: DataFrame, visibility: str, scopes: list[str] = ()) -> DataFrame:
    """(node_id, label, scope) that stand for references (reference_id, name, scope): one each where expanded, one a scope
    where aggregated, none where hidden; scopes given are the only ones."""
    own = references.filter(F.col("scope").isin(*scopes)) if scopes else references
    if visibility == "aggregated":
        titles = F.create_map(*[F.lit(x) for pair in BOUNDARY_TITLES.items() for x in pair])
        label = F.coalesce(titles[F.col("scope")], F.concat("scope", F.lit(" references")))
        return own.select("scope").distinct().select(F.concat(F.lit("reference-boundary:"), "scope").alias("node_id"), label.alias("label"), "scope")
    nodes = own.groupBy(F.col("reference_id").alias("node_id")).agg(F.min("name").alias("label"), F.min("scope").alias("scope"))
    return nodes if visibility == "expanded" else nodes.filter(F.lit(False))


def reading_order(nodes: DataFrame, relationships: DataFrame, cycles: DataFrame, diagnostics: DataFrame, references: DataFrame) -> DataFrame:
    """(section, id, description) of all that a scene shows (id, label), to be read by section and id: nodes, relationships,
    cycles, diagnostics, references."""
    parts = [t.select(F.lit(i).alias("section"), "id", F.col("label").alias("description")) for i, t in enumerate((nodes, relationships, cycles, diagnostics))]
    last = references.select(F.lit(4).alias("section"), F.concat(F.lit("reference-detail:"), "id").alias("id"), F.col("label").alias("description"))
    return reduce(DataFrame.unionByName, [*parts, last])


def attached_diagnostics(diagnostics: DataFrame, sources: DataFrame) -> DataFrame:
    """Diagnostics (code, severity, message, subject, path, position) once each, by stable id, with the sorted ids of the
    sources (source_id, path) at their path."""
    path = F.when(F.trim("path") == "", "").otherwise(cleaned(F.trim("path")))
    own = diagnostics.withColumn("path", path).withColumn("id", stable_id("diagnostic", "code", "severity", "message", "subject", "path", "position"))
    own = own.dropDuplicates(["id"])
    at = sources.select("source_id", path.alias("path")).distinct().groupBy("path").agg(F.array_sort(F.collect_list("source_id")).alias("source_ids"))
    return own.join(at, "path", "left").withColumn("source_ids", F.coalesce("source_ids", F.expr("cast(array() as array<string>)")))


def diagnostic_nodes(diagnostics: DataFrame, module_sources: DataFrame, placed: DataFrame) -> DataFrame:
    """(diagnostic_id, node) for diagnostics (diagnostic_id, source_ids, subject): the nodes of the modules that name one of
    its sources (module_sources: source_id, module), and that of the module it is about (placed: module, node)."""
    by_source = diagnostics.select("diagnostic_id", F.explode("source_ids").alias("source_id")).join(module_sources, "source_id").select("diagnostic_id", "module")
    direct = diagnostics.select("diagnostic_id", F.col("subject").alias("module"))
    return by_source.unionByName(direct).join(placed, "module").select("diagnostic_id", "node").distinct()


def bounded_diagnostics(diagnostics: DataFrame, order: list[str], most: int = MOST_DIAGNOSTICS) -> DataFrame:
    """(code, message) of all diagnostics in `order`, or, of more than `most`, the first most - 1 and one that says so."""
    first = diagnostics.orderBy(*order).limit(most + 1)
    ranked = first.agg(F.array_sort(F.collect_list(F.struct(*order, "code", "message"))).alias("all"))  # most + 1 rows at most
    own = F.transform("all", lambda r: F.struct(r["code"].alias("code"), r["message"].alias("message")))
    last = F.array(F.struct(F.lit("diagnostics_truncated").alias("code"), F.lit("Additional diagnostics were omitted.").alias("message")))
    return ranked.select(F.inline(F.when(F.size(own) > most, F.concat(F.slice(own, 1, most - 1), last)).otherwise(own)))


def line_range(start: Column, end: Column, source_start: Column, source_end: Column, lines: Column) -> Column:
    """struct(first, last, problem) of an excerpt: what is asked, else the source's own, else the top and 18 lines more."""
    first = F.coalesce(start, source_start, F.lit(1))
    last = F.coalesce(end, source_end, first + EXCERPT_REST)
    problem = F.when((start < 1) | (end < 1), "not_positive").when((first < 1) | (last < first), "invalid").when(last - first + 1 > EXCERPT_MOST, "too_large").when(lines == 0, "empty")
    return F.struct(first.alias("first"), last.alias("last"), problem.alias("problem"))


def freshness(ready: Column, building: Column, unstable: Column, stale: Column) -> Column:
    """State of a session: whether a revision is ready, one is being built, its input moves, or it is behind."""
    return F.when(building, F.when(ready, "updating").otherwise("initializing")).when(unstable, "input_unstable").when(stale, "stale").when(ready, "current").otherwise("initializing")


def compatible(previous: DataFrame, current: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """One row (one for each `by`): whether two reports have the same set of identities (provider, rule and formula `columns`)."""
    both = previous.select(*by, *columns, F.lit(1).alias("side")).unionByName(current.select(*by, *columns, F.lit(2).alias("side")))
    each = both.groupBy(*by, *columns).agg(F.count_distinct("side").alias("sides"))
    return each.groupBy(*by).agg(F.coalesce(F.min("sides") == 2, F.lit(True)).alias("compatible"))


def state_mapping(state: Column, mapping: dict[str, str]) -> Column:
    """The effective state that a declared one maps to; null if it is empty or not mapped."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[state] if mapping else F.lit(None).cast("string")


def visibility(matched: Column, visible: bool = True) -> Column:
    """Three-valued: what the rule says where its metadata matched, null where it has nothing to say."""
    return F.when(matched, F.lit(visible))


def node_fields(fields: list[tuple[str, str, Column]], most: int = 48) -> Column:
    """Array of (source, label, value) of the configured fields that are not blank, their values cut to `most` characters."""
    each = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(label).alias("label"), F.substring(v.cast("string"), 1, most).alias("value")) for s, label, v in fields])
    return F.filter(each, lambda f: F.trim(F.coalesce(f["value"], F.lit(""))) != "")


def mentioned(wanted: DataFrame, mentions: DataFrame) -> DataFrame:
    """Capabilities (capability) with `mentioned`: a descriptor, coverage row or metric of any snapshot (mentions:
    capability) names it, or one of those that vouch for it."""
    c = F.col("capability")
    names = F.when(c == PUBLIC_DOCUMENTATION, F.lit(list(PUBLIC_ALIASES))).when(c == LINE_COUNT, F.lit([LINE_COUNT, *LINE_ALIASES]))
    names = names.when(F.startswith(c, F.lit(CALLABLE_PREFIX)), F.concat(F.array(c), F.lit(list(CALLABLE_ALIASES)))).otherwise(F.array(c))
    met = wanted.select("capability", F.explode(names).alias("name")).join(mentions.select(c.alias("name")).distinct(), "name", "left_semi").select("capability").distinct()
    return wanted.join(met.withColumn("mentioned", F.lit(True)), "capability", "left").withColumn("mentioned", F.coalesce("mentioned", F.lit(False)))


def python_condition(condition: Column, minor: Column) -> Column:
    """true, false or null (unknown) of a chain of conditions around an import, given the minor version of Python 3 (null: unknown)."""

    def judged(part: Column) -> Column:
        own = F.trim(F.regexp_replace(F.trim(part), ":$", ""))
        bare = F.trim(F.regexp_replace(own, r"^(if|elif) ", ""))
        pattern = r"^sys\.version_info\s*(>=|>|<=|<|==|!=)\s*\(\s*3\s*,\s*([0-9]+)\s*\)"
        sign, n = F.regexp_extract(bare, pattern, 1), F.regexp_extract(bare, pattern, 2).try_cast("int")
        compared = F.when(sign == ">=", minor >= n).when(sign == ">", minor > n).when(sign == "<=", minor <= n).when(sign == "<", minor < n).when(sign == "==", minor == n).when(sign == "!=", minor != n)
        return F.when(F.lower(own).isin("if true", "elif true"), True).when(F.lower(own).isin("if false", "elif false"), False).otherwise(compared)

    parts = F.transform(F.split(condition, " -> "), judged)
    return F.when(condition == "", True).otherwise(F.aggregate(parts, F.lit(True), lambda a, b: a & b))


def reexports(observations: DataFrame, order: str) -> DataFrame:
    """(package, name, module, ambiguous, conditional) from imports that a package gives out again (package, imported, alias,
    module, state, conditional): the first module by `order`; conditional unless one of them surely holds."""
    own = observations.filter("coalesce(imported, '') not in ('', '*') and coalesce(state, true)")
    own = own.withColumn("name", F.coalesce(F.nullif(F.col("alias"), F.lit("")), F.col("imported"))).withColumn("sure", ~F.col("conditional") | F.coalesce("state", F.lit(False)))
    out = own.groupBy("package", "name").agg(F.min_by("module", order).alias("module"), F.min("module").alias("low"), F.max("module").alias("high"), F.bool_or("sure").alias("sure"))
    return out.select("package", "name", "module", (F.col("low") < F.col("high")).alias("ambiguous"), (~F.col("sure")).alias("conditional"))


#: Subject and unit that a rule's message names, and how it names the limit.
MESSAGE_SUBJECTS = {
    "source:file.max-lines": ("File", "lines"), "source:callable.max-lines": ("Callable", "lines"),
    "source:callable.max-cyclomatic-complexity": ("Callable", "complexity"), "source:callable.max-nesting-depth": ("Callable", "nesting depth"),
}
MESSAGE_LIMITS = {
    "greater_than": "configured maximum is {}", "greater_or_equal": "configured minimum is {}", "less_than": "configured condition is less than {}",
    "less_or_equal": "configured maximum is {} or less", "equal": "configured value is {}", "not_equal": "configured value must not be {}",
}


def threshold_message(rule: Column, unit: Column, observed: Column, operator: Column, limit: Column) -> Column:
    """What a finding says of the value observed and of the limit that it broke."""
    subject, measure = F.lit("Subject"), F.regexp_replace(unit, "^unit:", "")
    for id_, (s, m) in MESSAGE_SUBJECTS.items():
        subject, measure = F.when(rule == id_, s).otherwise(subject), F.when(rule == id_, m).otherwise(measure)
    bound = F.lit("configured limit is {}")
    for name, text in MESSAGE_LIMITS.items():
        bound = F.when(operator == name, text).otherwise(bound)
    bound = F.replace(bound, F.lit("{}"), limit.cast("string"))
    return F.concat(subject, F.lit(" has "), observed.cast("string"), F.lit(" "), measure, F.lit("; "), bound)


def sequence_less(left: Column, right: Column) -> Column:
    """Order of event sequence numbers: as numbers if both are whole numbers of 64 bits without sign, else as texts."""
    a, b = (F.when(x.rlike("^[0-9]+$"), F.regexp_replace(x, "^0+(?=[0-9])", "")) for x in (left, right))
    a, b = (F.when((F.length(x) < 20) | (F.length(x) == 20) & (x <= str(2**64 - 1)), F.lpad(x, 20, "0")) for x in (a, b))
    return F.coalesce(a < b, left < right)


def build_constraints(content: Column, most: int = 100) -> Column:
    """Sorted build constraints from the comments that a Go file starts with, within its first `most` lines."""
    lines = F.transform(F.slice(T.split_lines(content), 1, most), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    code = F.array_position(F.transform(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("//"))), True)
    head = F.when(code == 0, lines).when(code == 1, F.expr("cast(array() as array<string>)")).otherwise(F.slice(lines, F.lit(1), (code - 1).cast("int")))
    forms = r"^(//go:build |// \+build )"
    return F.array_sort(F.transform(F.filter(head, lambda x: x.rlike(forms)), lambda x: F.trim(F.regexp_replace(x, forms, ""))))


def module_file_relations(files: DataFrame) -> DataFrame:
    """A `contains` relation, with the span of the whole file, from the module of each file (scope_id, module_id, file_id,
    content); files without a module have none."""
    own = files.filter("coalesce(module_id, '') <> ''")
    text = T.unified_newlines(F.col("content"))
    rest = F.substring_index(text, "\n", -1)
    line = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    id_ = stable_id("relation", "scope_id", F.lit("module-file"), "module_id", "file_id")
    return own.select(id_.alias("relation_id"), F.lit("contains").alias("category"), "module_id", "file_id", F.octet_length("content").alias("end_byte"), line.alias("end_line"), (F.octet_length(rest) + 1).alias("end_column"))


def with_provenance(facts_: DataFrame, basis: str, provider: str, version: str, evidence: Column | None = None) -> DataFrame:
    """status, basis, provider, provider_version where they are empty, and evidence_ids: a null list is empty, an empty one
    takes `evidence`, if given."""
    usual = {"status": "observed", "basis": basis, "provider": provider, "provider_version": version}
    ids = F.coalesce("evidence_ids", F.expr("cast(array() as array<string>)"))
    if evidence is not None:
        ids = F.when(F.size(ids) == 0, F.array(evidence)).otherwise(ids)
    return facts_.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v)) for c, v in usual.items()} | {"evidence_ids": ids})


def dependency_counts(dependencies: DataFrame) -> DataFrame:
    """Per type (owner): distinct types that it depends on (name), and those of them that are no interface."""
    each = dependencies.groupBy("owner", "name").agg(F.bool_or("interface").alias("interface"))
    return each.groupBy("owner").agg(F.count("*").alias("dependencies"), F.count_if(~F.col("interface")).alias("concrete"))


def analyzer_of(columns: list[str], sources: list[str]) -> list[Column]:
    """The named columns of the first of `sources` (structs, the best first) whose id is not empty, the last one else."""
    picked = []
    for c in columns:
        out = F.col(f"{sources[-1]}.{c}")
        for s in reversed(sources[:-1]):
            out = F.when(F.coalesce(F.col(f"{s}.id"), F.lit("")) != "", F.col(f"{s}.{c}")).otherwise(out)
        picked.append(out.alias(c))
    return picked


#: Crates of the standard library.
STANDARD_CRATES = ("std", "core", "alloc", "proc_macro", "test")


def resolved_uses(uses: DataFrame, modules: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Rust `use` paths (use_id, module_id, module_path array, path, package) with what they name: module_id_used and scope
    (local, standard_library, external, unresolved).

    A path is tried from the crate's root (`crate`, the package's own name), from its module (`self`), from an outer one
    (`super`), else as it is and from every enclosing module, the nearest first; each of these by its longest prefix that
    is a module (modules: module_id, key `a::b`). `dependencies` (name) are the crates that the project declares.
    """
    part, here = F.split("path", "::"), F.col("module_path")
    supers = F.expr("(length(regexp_extract(path, '^((super(::|$))*)', 1)) + 2) div 7").cast("int")
    tail = F.slice(part, F.lit(2), F.greatest(F.size(part), F.lit(1)))
    none = F.expr("cast(array() as array<string>)")
    base = F.slice(here, F.lit(1), F.greatest(F.size(here) - supers, F.lit(0)))
    beyond = F.slice(part, supers + 1, F.size(part))

    def tried(path: Column, least: Column) -> Column:
        return F.struct(path.alias("path"), least.cast("int").alias("least"))

    from_root = F.array(tried(tail, F.when(F.size(tail) == 0, 0).otherwise(1)))
    cargo_name = lambda c: F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit("-"))
    first = F.when(cargo_name(part[0]) == cargo_name(F.col("package")), from_root).otherwise(F.array(tried(part, F.lit(1))))
    enclosing = F.transform(F.reverse(F.sequence(F.lit(0), F.size(here))), lambda n: tried(F.concat(F.slice(here, F.lit(1), n), part), F.lit(1)))
    relative = part[0].isin("crate", "self", "super")
    tries = F.when(part[0] == "crate", from_root).when(part[0] == "self", F.array(tried(F.concat(here, tail), F.size(here) + F.when(F.size(tail) > 0, 1).otherwise(0))))
    tries = tries.when(part[0] == "super", F.when(F.size(beyond) > 0, F.array(tried(F.concat(base, beyond), F.size(base) + 1)))).otherwise(F.concat(first, enclosing))
    each = uses.filter("path <> ''").select("use_id", "module_id", F.posexplode(tries).alias("place", "t"))
    each = each.select("use_id", "module_id", "place", "t.path", F.explode(F.expr("if(t.least > size(t.path), array(), sequence(t.least, size(t.path)))")).alias("size"))
    each = each.select("use_id", "module_id", "place", "size", F.array_join(F.when(F.col("size") > 0, F.slice("path", F.lit(1), F.col("size"))).otherwise(none), "::").alias("key"))
    met = each.join(modules.select("key", F.col("module_id").alias("module_id_used")), "key").filter("size > 0 or module_id <> module_id_used")
    best = met.groupBy("use_id").agg(F.min_by("module_id_used", F.struct("place", -F.col("size"))).alias("module_id_used"))
    known = dependencies.select(cargo_name(F.col("name")).alias("crate")).distinct().withColumn("declared", F.lit(True))
    out = uses.withColumn("crate", cargo_name(part[0])).join(best, "use_id", "left").join(known, "crate", "left")
    scope = F.when(F.col("module_id_used").isNotNull(), "local").when(relative, "unresolved").when(F.lower(F.trim(part[0])).isin(*STANDARD_CRATES), "standard_library").when(F.col("declared"), "external").otherwise("unresolved")
    return out.select("use_id", "module_id_used", scope.alias("scope"))
