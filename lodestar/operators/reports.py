"""Quality reports as tables: queries over findings and coverage, identity and validation, baselines, capabilities, facts.

Findings have finding_id, finding_key, scope_id, kind, subject, rule_id, rule_version, severity, status; coverage has
rule_id, rule_version, status and evidence, an array of ids `scope:<scope>:...:<snapshot>`. Validations give a row per
violation, so a table that is right gives none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.quality import SEVERITIES, severity_rank

#: Order of findings, states of findings and of coverage, kinds of watch events.
FINDING_ORDER = ["scope_id", "kind", "subject", "rule_id", "severity", "finding_key", "finding_id"]
FINDING_STATES = ("active", "suppressed", "resolved")
COVERAGE_STATES = ("observed", "partial", "unsupported", "unknown", "not_evaluable")
WATCH_KINDS = ("create", "modify", "delete", "rename", "overflow", "error")


def filter_findings(findings: DataFrame, file: str | None = None, **equal: str) -> DataFrame:
    """Findings that meet all given selectors (columns by name); `file` selects subjects of kind file."""
    if "severity" in equal and equal["severity"] not in SEVERITIES or "status" in equal and equal["status"] not in FINDING_STATES:
        raise ValueError("unknown severity or status")
    own = reduce(lambda df, kv: df.filter(F.col(kv[0]) == kv[1]), equal.items(), findings)
    return own if file is None else own.filter((F.col("kind") == "file") & (F.col("subject") == file))


def from_source(evidence: Column, scope_id: str = "", snapshot_id: str = "") -> Column:
    """One evidence id has both the scope's prefix and the snapshot's suffix; without either all rows do."""
    if not scope_id and not snapshot_id:
        return F.lit(True)
    return F.exists(evidence, lambda e: (F.startswith(e, F.lit(f"scope:{scope_id}:")) if scope_id else F.lit(True)) & (F.endswith(e, F.lit(f":{snapshot_id}")) if snapshot_id else F.lit(True)))


def filter_coverage(coverage: DataFrame, rule_id: str = "", scope_id: str = "", snapshot_id: str = "") -> DataFrame:
    own = coverage.filter(F.col("rule_id") == rule_id) if rule_id else coverage
    return own.filter(from_source(F.col("evidence"), scope_id, snapshot_id))


def reports_of_scope(reports: DataFrame, findings: DataFrame, coverage: DataFrame, scope_id: str) -> DataFrame:
    """Reports (report_id) with a finding in the scope, or coverage evidence of it."""
    by_finding = findings.filter(F.col("scope_id") == scope_id).select("report_id")
    by_coverage = coverage.filter(from_source(F.col("evidence"), scope_id)).select("report_id")
    return reports.join(by_finding.unionByName(by_coverage).distinct(), "report_id", "left_semi")


def report_summary(findings: DataFrame) -> DataFrame:
    """Counts of each report's findings by state, and its worst severity."""
    worst = F.max_by("severity", severity_rank(F.col("severity")))
    return findings.groupBy("report_id").agg(F.count("*").alias("findings"), *[F.count_if(F.col("status") == s).alias(s) for s in FINDING_STATES], worst.alias("worst"))


def finding_evidence(findings: DataFrame, spans: DataFrame, max_lines: int = 120) -> DataFrame:
    """Findings with the spans (subject, first_line, last_line) of their subjects, none longer than `max_lines`."""
    cut = spans.select("subject", "first_line", F.least("last_line", F.col("first_line") + max_lines - 1).alias("last_line"), (F.col("last_line") - F.col("first_line") >= max_lines).alias("truncated"))
    return findings.join(cut, "subject", "left")


def capability_gate(required: DataFrame, available: DataFrame, declared: DataFrame, mentioned: DataFrame, failures: DataFrame) -> DataFrame:
    """Per rule, the first required capability (by ord) that does not pass, with the status that follows.

    A failed provider gives partial; an available capability passes; else a declared status holds; a capability that is
    mentioned only is not_evaluable; one that nothing names is unsupported. Rules of which all pass have no row.
    """
    j = required.join(failures.select("capability", F.lit(True).alias("failed")).distinct(), "capability", "left")
    for name, df in (("has", available), ("said", mentioned)):
        j = j.join(df.select("capability").distinct().withColumn(name, F.lit(True)), "capability", "left")
    j = j.join(declared.groupBy("capability").agg(F.min("status").alias("declared")), "capability", "left")
    status = F.when(F.col("failed"), "partial").when(F.col("has"), None).when(F.col("declared").isNotNull(), F.col("declared")).when(F.col("said"), "not_evaluable").otherwise("unsupported")
    open_ = j.withColumn("status", status).filter("status is not null")
    return open_.groupBy("rule_id").agg(F.min_by("capability", "ord").alias("capability"), F.min_by("status", "ord").alias("status"))


def source_rule_coverage(declared: Column, subjects: Column, evaluated: Column) -> Column:
    """The declared state of a rule's capability, corrected by how many subjects had an observed metric."""
    state = F.coalesce(declared, F.lit("observed"))
    return F.when((state == "observed") & (evaluated < subjects), "partial").otherwise(state)


def stable_finding_key(parts: list[str], stable_key: str, subject: str) -> Column:
    """The joined identity of a finding: given parts around the subject's stable key, or its id where that is empty."""
    own = F.when(F.coalesce(F.col(stable_key), F.lit("")) != "", F.col(stable_key)).otherwise(F.col(subject))
    return F.concat_ws("|", *[own if p == "subject" else F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])


def normalized_report(findings: DataFrame) -> DataFrame:
    """One row per report: its findings in canonical order, as a digest, and the report's identity from it."""
    row = F.struct(*[F.col(c).cast("string").alias(c) for c in FINDING_ORDER], "status")
    joined = F.array_join(F.transform(F.array_sort(F.collect_set(row)), lambda r: F.concat_ws("|", *[r[c] for c in (*FINDING_ORDER, "status")])), "\n")
    out = findings.groupBy("report_id").agg(F.countDistinct(row).alias("findings"), F.sha2(joined, 256).alias("digest"))
    return out.withColumn("evaluation_id", F.concat(F.lit("evaluation:"), F.substring("digest", 1, 16)))


def report_violations(findings: DataFrame, coverage: DataFrame) -> DataFrame:
    """(problem, id): unknown states and severities, doubled ids, findings of rules without coverage."""
    double = findings.groupBy("finding_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate").alias("problem"), F.col("finding_id").alias("id"))
    state = findings.filter(~F.col("status").isin(*FINDING_STATES) | (severity_rank(F.col("severity")) < 0)).select(F.lit("enum"), "finding_id")
    orphan = findings.join(coverage.select("rule_id", "rule_version").distinct(), ["rule_id", "rule_version"], "left_anti").select(F.lit("no_coverage"), "finding_id")
    bad = coverage.filter(~F.col("status").isin(*COVERAGE_STATES)).select(F.lit("coverage_enum"), "rule_id")
    return double.union(state).union(orphan).union(bad)


def baseline_violations(entries: DataFrame, keys: list[str]) -> DataFrame:
    """(problem, finding_key): incomplete entries, doubled ones, and those out of canonical order (ord is the file's)."""
    blank = F.lit(False)
    for c in ("finding_key", "rule_id", "profile_id", "reason"):
        blank = blank | (F.trim(F.coalesce(F.col(c), F.lit(""))) == "")
    incomplete = entries.filter(blank | ~F.coalesce(F.rlike("rule_version", F.lit(r"^[0-9A-Za-z][0-9A-Za-z.+-]*$")), F.lit(False))).select(F.lit("incomplete").alias("problem"), "finding_key")
    double = entries.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate"), "finding_key")
    before = F.lag(F.struct(*keys)).over(Window.partitionBy("baseline_id").orderBy("ord"))
    unordered = entries.withColumn("before", before).filter(F.col("before") > F.struct(*keys)).select(F.lit("order"), "finding_key")
    return incomplete.union(double).union(unordered)


def baseline_candidates(findings: DataFrame, coverage: DataFrame, by: list[str] = ()) -> DataFrame:
    """Findings that may enter a baseline: active, and every coverage row of their exact rule (within `by`) observed, one at least."""
    sure = coverage.groupBy(*by, "rule_id", "rule_version").agg(F.bool_and(F.col("status") == "observed").alias("sure")).filter("sure").drop("sure")
    return findings.filter(F.col("status") == "active").join(sure, [*by, "rule_id", "rule_version"], "left_semi")


def next_revision(revision: Column) -> Column:
    """1.0.0 after none; the last numeric part plus one; `.1` after a revision that ends otherwise."""
    r = F.trim(F.coalesce(revision, F.lit("")))
    head, last = F.regexp_extract(r, r"^(.*\.)?(\d+)$", 1), F.regexp_extract(r, r"^(.*\.)?(\d+)$", 2)
    return F.when(r == "", "1.0.0").when(last != "", F.concat(head, (last.cast("decimal(20,0)") + 1).cast("decimal(20,0)").cast("string"))).otherwise(F.concat(r, F.lit(".1")))


def append_baseline(baseline: DataFrame, additions: DataFrame, revision: str, expected: str) -> DataFrame:
    """Entries of the next revision; the caller must have seen the present one. Entries that are there already stay as they are."""
    if revision != expected:
        raise ValueError(f"the baseline is at revision {revision}, not {expected}")
    new = additions.join(baseline.select("finding_key"), "finding_key", "left_anti").dropDuplicates(["finding_key"])
    return baseline.unionByName(new, allowMissingColumns=True).withColumn("revision", next_revision(F.lit(revision)))


def eligible_metrics(metrics: DataFrame, snapshots: DataFrame, metric_id: str, unit: str) -> DataFrame:
    """Observed metrics of one kind and unit whose scope and snapshot are known, by id."""
    own = metrics.filter((F.col("metric_id") == metric_id) & (F.col("unit") == unit) & (F.col("status") == "observed"))
    return own.join(snapshots.select("scope_id", "snapshot_id"), ["scope_id", "snapshot_id"], "left_semi")


def formula_versions(findings: DataFrame, metrics: DataFrame) -> DataFrame:
    """(finding_id, versions): sorted distinct `metric@formula` of the metrics a finding refers to (metric_refs)."""
    refs = findings.select("finding_id", F.explode("metric_refs").alias("metric_fact_id")).distinct()
    met = refs.join(metrics.select("metric_fact_id", F.concat_ws("@", "metric_id", "formula_version").alias("v")), "metric_fact_id")
    return met.groupBy("finding_id").agg(F.array_sort(F.collect_set("v")).alias("versions"))


def valid_span(span: dict[str, Column]) -> Column:
    """Coordinates in order, lines and columns from 1, offsets from 0, a hash of 64 lower-case hex digits."""
    s = span
    order = (s["end_line"] > s["start_line"]) | ((s["end_line"] == s["start_line"]) & (s["end_column"] >= s["start_column"]))
    numbers = (s["start_line"] >= 1) & (s["start_column"] >= 1) & (s["end_column"] >= 1) & (s["start_byte"] >= 0) & (s["end_byte"] >= s["start_byte"])
    return F.coalesce((s["file_id"] != "") & order & numbers & F.rlike(s["hash"], F.lit("^[0-9a-f]{64}$")), F.lit(False))


def body_spans(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols (file_id, hash, end_byte ...) whose file is there with that hash and holds the span."""
    own = files.select("file_id", F.col("hash").alias("file_hash"), F.col("bytes").alias("file_bytes"))
    return symbols.join(own, "file_id").filter((F.col("hash") == F.col("file_hash")) & (F.col("end_byte") <= F.col("file_bytes"))).drop("file_hash", "file_bytes")


def is_callable(category: Column, kind: Column) -> Column:
    return (category == "callable") | F.startswith(kind, F.lit("go:function")) | F.startswith(kind, F.lit("go:method"))


def capability_coverage(requested: DataFrame, stats: DataFrame, files: int) -> DataFrame:
    """Per requested capability: status, eligible and observed counts. `stats` has observed, eligible, failures, unsupported.

    Without stats all files are eligible; files and sizes are always observed for all of them.
    """
    j = requested.join(stats, "capability", "left").withColumns({c: F.coalesce(c, F.lit(files if c == "eligible" else 0).cast("long")) for c in ("eligible", "observed", "failures")})
    status = F.when(F.col("capability").isin("source:files", "source:size"), "observed").when(F.col("failures") > 0, "partial").when((F.col("observed") > 0) & (F.col("observed") < F.col("eligible")), "partial").when((F.col("observed") == 0) & F.coalesce("unsupported", F.lit(False)), "unsupported").otherwise("observed")
    whole = F.col("capability").isin("source:files", "source:size")
    return j.select("capability", status.alias("status"), *[F.when(whole, F.lit(files)).otherwise(F.col(c)).cast("long").alias(c) for c in ("eligible", "observed")])


def index_violations(files: DataFrame, symbols: DataFrame, documentation: DataFrame) -> DataFrame:
    """(problem, id) of an index's facts: doubled ids, references to nothing, spans outside their file, bad digests."""
    out = []
    for name, df, key in (("file", files, "file_id"), ("symbol", symbols, "symbol_id"), ("documentation", documentation, "documentation_id")):
        out.append(df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(f"{name}_duplicate").alias("problem"), F.col(key).cast("string").alias("id")))
    out.append(symbols.join(files, "file_id", "left_anti").select(F.lit("symbol_file"), F.col("symbol_id").cast("string")))
    out.append(documentation.join(symbols, "symbol_id", "left_anti").select(F.lit("documentation_symbol"), F.col("documentation_id").cast("string")))
    out.append(symbols.join(files.select("file_id", "lines"), "file_id").filter("start_line < 1 or end_line < start_line or end_line > lines").select(F.lit("symbol_span"), F.col("symbol_id").cast("string")))
    out.append(files.filter(~F.rlike("hash", F.lit("^[0-9a-f]{64}$"))).select(F.lit("file_hash"), F.col("file_id").cast("string")))
    return reduce(DataFrame.union, out)


def reference_accumulators(edges: DataFrame) -> DataFrame:
    """Per reference: how many modules and relationships lead to it, from how many sources, and the least of each."""
    return edges.groupBy("reference_id").agg(F.countDistinct("module_id").alias("modules"), F.countDistinct("relationship_id").alias("relationships"), F.countDistinct("source_id").alias("sources"), F.min("module_id").alias("first_module"))


def node_cycle_state(nodes: DataFrame, edges: DataFrame, cyclic: DataFrame, feedback: DataFrame) -> DataFrame:
    """(node, state): cycle if a module of the node is in one, else feedback if one touches a feedback edge, else none."""
    ends = edges.join(feedback.select("edge_id"), "edge_id", "left_semi").select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("touches", F.lit(True))
    j = nodes.join(cyclic.select("id").distinct().withColumn("in_cycle", F.lit(True)), "id", "left").join(ends, "id", "left")
    state = F.when(F.bool_or(F.coalesce("in_cycle", F.lit(False))), "cycle").when(F.bool_or(F.coalesce("touches", F.lit(False))), "feedback").otherwise("none")
    return j.groupBy("node").agg(state.alias("state"))


def diagnostic_summary(diagnostics: DataFrame) -> DataFrame:
    """One row: diagnostics by severity."""
    return diagnostics.agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("info", "warning", "error")])


def evidence_links(sources: DataFrame, *uses: DataFrame) -> DataFrame:
    """Sources (source_id) that one of the tables of uses refers to, once each."""
    return sources.join(reduce(DataFrame.union, [u.select("source_id") for u in uses]).distinct(), "source_id", "left_semi")


def normalized_events(events: DataFrame) -> DataFrame:
    """Watch events (kind, path, sequence) with trimmed, lower-case kinds and an identity; those of unknown kind, or
    without a path where the kind needs one, are left out."""
    kind, path = F.lower(F.trim("kind")), F.trim(F.coalesce("path", F.lit("")))
    own = events.withColumns({"kind": kind, "path": path}).filter(F.col("kind").isin(*WATCH_KINDS) & ((F.col("path") != "") | F.col("kind").isin("overflow", "error")))
    return own.withColumn("event_group_id", F.sha2(F.concat_ws("|", "kind", "path", F.col("sequence").cast("string")), 256))


def type_facts(members: DataFrame, embeds: DataFrame) -> DataFrame:
    """Counts per type from members (type_id, member, target, interface) and embeds (type_id, base): members, distinct
    dependencies, those on concrete types, and types derived from it."""
    own = members.groupBy("type_id").agg(F.countDistinct("member").alias("member_count"), F.countDistinct("target").alias("dependency_count"), F.countDistinct(F.when(~F.col("interface"), F.col("target"))).alias("concrete_dependency_count"))
    derived = embeds.groupBy(F.col("base").alias("type_id")).agg(F.countDistinct("type_id").alias("derived_count"))
    return own.join(derived, "type_id", "left").withColumn("derived_count", F.coalesce("derived_count", F.lit(0)).cast("long"))
