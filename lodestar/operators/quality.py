"""Quality rules as data: metrics in, findings and coverage out; baselines, comparisons and exit policies on top.

A missing input never looks like a pass: every rule gives a coverage row, and its status says what was observed.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.paths import matches_glob

#: Comparisons, severities by rank, and the triggers of the structural signals (indicator, least value).
OPERATORS = {
    "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b, "eq": lambda a, b: a == b, "neq": lambda a, b: a != b,
}
SEVERITIES = ("info", "warning", "error", "blocker")
SIGNALS = {
    "srp": {"member_count": 10, "dependency_count": 3},
    "ocp": {"type_switch_count": 1},
    "lsp": {"hierarchy_depth": 2, "derived_count": 1},
    "isp": {"interface_method_count": 8},
    "dip": {"concrete_dependency_count": 3},
}
#: Rule, metric, default limit and severity; all compare with gt.
RULES = {
    "source:file.max-lines": ("file_lines", 500, "warning"),
    "source:callable.max-lines": ("callable_lines", 50, "warning"),
    "source:callable.max-cyclomatic-complexity": ("complexity", 10, "warning"),
    "source:callable.max-nesting-depth": ("nesting", 4, "warning"),
    "architecture:module.max-efferent-coupling": ("efferent", 10, "warning"),
    "architecture:module.max-afferent-coupling": ("afferent", 10, "warning"),
}


def severity_rank(c: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for i, s in enumerate(SEVERITIES) for x in (s, i)])[c], F.lit(-1))


@dataclass
class Threshold:
    rule_id: str
    metric: str
    limit: int
    operator: str = "gt"
    severity: str = "warning"

    def __post_init__(self) -> None:
        if self.operator not in OPERATORS or self.severity not in SEVERITIES or self.limit < 0:
            raise ValueError(f"{self.rule_id}: unknown operator or severity, or a negative limit")


def threshold_rule(rule_id: str, limit: int | None = None, operator: str = "gt") -> Threshold:
    """A registered rule, with its default limit unless another is given."""
    metric, default, severity = RULES[rule_id]
    return Threshold(rule_id, metric, default if limit is None else limit, operator, severity)


def threshold_findings(metrics: DataFrame, rule: Threshold) -> DataFrame:
    """Findings of one rule over metrics (subject, metric, value)."""
    own = metrics.filter((F.col("metric") == rule.metric) & F.col("value").isNotNull())
    return own.filter(OPERATORS[rule.operator](F.col("value"), F.lit(rule.limit))).select(F.lit(rule.rule_id).alias("rule_id"), "subject", F.col("value").cast("long").alias("observed"), F.lit(rule.limit).cast("long").alias("limit"), F.lit(rule.severity).alias("severity"))


def rule_coverage(subjects: DataFrame, metrics: DataFrame, rule: Threshold) -> DataFrame:
    """One row: eligible subjects, evaluated ones, and the status that follows."""
    own = metrics.filter((F.col("metric") == rule.metric) & F.col("value").isNotNull()).select("subject").distinct().withColumn("seen", F.lit(1))
    n = subjects.select("subject").join(own, "subject", "left").agg(F.count("*").alias("eligible"), F.count("seen").alias("evaluated"))
    status = F.when(F.col("evaluated") == F.col("eligible"), "observed").when(F.col("evaluated") == 0, "not_evaluable").otherwise("partial")
    return n.select(F.lit(rule.rule_id).alias("rule_id"), "eligible", "evaluated", status.alias("status"))


def merged_status(status: Column, absorbing: bool = True) -> Column:
    """Equal states stay; unknown absorbs all, then not_evaluable; any other mix is partial."""
    same = F.min(status) == F.max(status)
    out = F.when(same, F.min(status))
    if absorbing:
        out = out.when(F.bool_or(status == "unknown"), "unknown").when(F.bool_or(status == "not_evaluable"), "not_evaluable")
    return out.otherwise("partial")


def merge_coverage(coverage: DataFrame, keys: list[str], counters: list[str], order: str) -> DataFrame:
    """One row per key: merged status, null-aware sums, the first reason by `order`, united evidence."""
    reason = F.when(F.col("reason") != "", F.col("reason"))
    return coverage.groupBy(*keys).agg(merged_status(F.col("status")).alias("status"), *[F.sum(c).alias(c) for c in counters], F.coalesce(F.min_by(reason, F.when(reason.isNotNull(), F.col(order))), F.lit("")).alias("reason"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))


def merge_capabilities(coverage: DataFrame) -> DataFrame:
    """Per capability; an empty status is neutral, any disagreement is partial; providers are united."""
    status = F.when(F.col("status") != "", F.col("status"))
    return coverage.groupBy("capability").agg(F.coalesce(merged_status(status, absorbing=False), F.lit("")).alias("status"), F.array_sort(F.collect_set("provider")).alias("providers"))


def documentation(symbols: DataFrame, docs: DataFrame) -> DataFrame:
    """Symbols (symbol_id, scope, public) with a state: their first documentation record's status, or unknown."""
    first = docs.groupBy("symbol_id").agg(F.min_by("status", "ord").alias("state"))
    return symbols.join(first, "symbol_id", "left").withColumn("state", F.coalesce("state", F.lit("unknown")))


def documentation_coverage(states: DataFrame) -> DataFrame:
    """Counters, ratio (0 where nothing is supported) and coverage state per scope."""
    n = states.filter("public").groupBy("scope").agg(F.count("*").alias("eligible"), F.count_if(F.col("state") != "unknown").alias("supported"), F.count_if(F.col("state") == "present").alias("documented"))
    ratio = F.when(F.col("supported") == 0, 0.0).otherwise(F.col("documented") / F.col("supported"))
    status = F.when(F.col("supported") == F.col("eligible"), "observed").when(F.col("supported") == 0, "not_evaluable").otherwise("partial")
    return n.select("scope", "eligible", "supported", "documented", ratio.alias("ratio"), status.alias("status"))


def unpivot_counts(subjects: DataFrame, id_: str, counts: list[str]) -> DataFrame:
    """Nullable count columns as metric rows; null (not observed) and negative counts give none."""
    long = subjects.select(id_, *[F.col(c).cast("long").alias(c) for c in counts]).unpivot([id_], counts, "metric", "value")
    return long.filter("value >= 0").withColumnRenamed(id_, "subject")


def signal_findings(metrics: DataFrame, signals: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """(rule_id, subject): all indicators of a signal must be present and reach their least value."""
    signals = signals or SIGNALS
    names = sorted({m for need in signals.values() for m in need})
    wide = metrics.groupBy("subject").pivot("metric", names).agg(F.max("value"))
    parts = []
    for rule, need in sorted(signals.items()):
        met = reduce(lambda a, b: a & b, [F.coalesce(F.col(m) >= n, F.lit(False)) for m, n in need.items()])
        parts.append(wide.filter(met).select(F.lit(f"signal:solid.{rule}").alias("rule_id"), "subject"))
    return reduce(DataFrame.unionByName, parts)


@dataclass
class Selector:
    """Any of: ids, tags, globs on the stable key, layers. One without fields matches nothing."""

    ids: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    globs: list[str] = field(default_factory=list)
    layers: list[int] = field(default_factory=list)

    def matches(self, prefix: str) -> Column:
        out = F.lit(False)
        if self.ids:
            out = out | F.col(f"{prefix}_id").isin(*self.ids)
        if self.tags:
            out = out | F.arrays_overlap(F.col(f"{prefix}_tags"), F.lit(self.tags))
        for g in self.globs:
            out = out | matches_glob(F.col(f"{prefix}_key"), g)
        if self.layers:
            out = out | F.col(f"{prefix}_layer").isin(*self.layers)
        return F.coalesce(out, F.lit(False))


def with_ends(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Edges with id, tags, key and layer of both ends as src_* and dst_*."""
    for end in ("src", "dst"):
        m = modules.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("tags", "key", "layer")])
        edges = edges.join(m, end).withColumn(f"{end}_id", F.col(end))
    return edges


def forbidden_dependencies(edges: DataFrame, constraints: dict[str, tuple[Selector, Selector]]) -> DataFrame:
    """(constraint_id, edge_id) for every edge (with_ends) from one selector to the other. A constraint is a predicate,
    so the edges are read once and there is no join with the constraints."""
    hits = F.array_compact(F.array(*[F.when(a.matches("src") & b.matches("dst"), F.lit(k)) for k, (a, b) in sorted(constraints.items())]))
    return edges.select(F.explode(hits).alias("constraint_id"), "edge_id")


def layer_violations(edges: DataFrame, direction: str) -> DataFrame:
    """Edges against the allowed direction: higher_to_lower flags src below dst, lower_to_higher the opposite."""
    bad = {"higher_to_lower": "src_layer < dst_layer", "lower_to_higher": "src_layer > dst_layer"}[direction]
    return edges.filter(bad).select("edge_id", "src_layer", "dst_layer")


def suppress(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings with status: suppressed where a baseline entry has the same key, rule, versions and formula set."""
    keys = ["finding_key", "rule_id", "rule_version", "profile_id", "profile_version"]
    versions = F.array_sort(F.array_distinct("formula_versions"))
    entry = baseline.withColumn("fv", versions).groupBy(*keys, "fv").agg(F.min("entry_id").alias("entry_id"))
    out = findings.withColumn("fv", versions).join(entry, [*keys, "fv"], "left").drop("fv")
    return out.withColumn("status", F.when(F.col("entry_id").isNotNull(), "suppressed").otherwise("active"))


def merge_baseline(baseline: DataFrame, additions: DataFrame, by: list[str] = ()) -> DataFrame:
    """All entries with their origin: kept, existing (added again unchanged), added, or conflict (other reason or owner). Entries
    of different `by` never meet."""
    a = additions.select(*by, "finding_key", F.col("reason").alias("new_reason"), F.col("owner").alias("new_owner"))
    both = baseline.join(a, [*by, "finding_key"], "full")
    origin = F.when(F.col("reason").isNull() & F.col("owner").isNull(), "added").when(F.col("new_reason").isNull() & F.col("new_owner").isNull(), "kept").when(F.col("reason").eqNullSafe(F.col("new_reason")) & F.col("owner").eqNullSafe(F.col("new_owner")), "existing").otherwise("conflict")
    return both.select(*by, "finding_key", F.coalesce("reason", "new_reason").alias("reason"), F.coalesce("owner", "new_owner").alias("owner"), origin.alias("origin"))


def compare_reports(previous: DataFrame, current: DataFrame, coverage: DataFrame, by: list[str] = ()) -> DataFrame:
    """(`by`, finding_key, change) of the reports of each `by`: suppressed, added (new, or suppressed before), unchanged, resolved.

    A finding that is gone is resolved only if every coverage row of its exact rule version is observed; else it is
    not reported.
    """
    sure = coverage.groupBy("rule_id", "rule_version").agg(F.bool_and(F.col("status") == "observed").alias("sure"))
    p = previous.select(*by, "finding_key", F.col("rule_id").alias("p_rule"), F.col("rule_version").alias("p_version"), F.col("status").alias("p_status"))
    c = current.select(*by, "finding_key", F.col("status").alias("c_status"))
    both = p.join(c, [*by, "finding_key"], "full").join(sure.withColumnsRenamed({"rule_id": "p_rule", "rule_version": "p_version"}), ["p_rule", "p_version"], "left")
    change = F.when(F.col("c_status") == "suppressed", "suppressed").when(F.col("c_status").isNotNull() & (F.col("p_status").isNull() | (F.col("p_status") == "suppressed")), "added").when(F.col("c_status").isNull() & F.coalesce("sure", F.lit(False)), "resolved").when(F.col("c_status").isNotNull(), "unchanged")
    return both.select(*by, "finding_key", change.alias("change")).filter("change is not null")


def exit_policy(findings: DataFrame, minimum: str, statuses: list[str], by: list[str] = ()) -> DataFrame:
    """One row (one for each `by`), triggered: any finding of at least that severity in one of the statuses."""
    hit = (severity_rank(F.col("severity")) >= SEVERITIES.index(minimum)) & F.col("status").isin(*statuses)
    return findings.groupBy(*by).agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("triggered"))


def first_metric(metrics: DataFrame) -> DataFrame:
    """The first metric (by metric_fact_id) of each metric and subject."""
    w = Window.partitionBy("metric", "subject").orderBy("metric_fact_id")
    return metrics.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def fold_status(status: Column) -> Column:
    """Status of a run: complete if all jobs are, failed or cancelled if all are, else partial."""
    return F.when(F.bool_and(status == "complete"), "complete").when(F.bool_and(status == "failed"), "failed").when(F.bool_and(status == "cancelled"), "cancelled").when(F.bool_or(status.isin("complete", "partial")), "partial").otherwise("failed")


class Catalog:
    """Registered metric providers and rules by (id, version). Registering the same object again is harmless; another
    object under a taken name is an error."""

    def __init__(self) -> None:
        self.providers: dict[tuple[str, str], object] = {}
        self.rules: dict[tuple[str, str], object] = {}
        self.gives: dict[tuple[str, str], frozenset[str]] = {}
        self.needs: dict[tuple[str, str], frozenset[str]] = {}

    @staticmethod
    def _add(where: dict, id_: str, version: str, value: object) -> None:
        if where.setdefault((id_, version), value) is not value:
            raise ValueError(f"{id_} {version} is registered already")

    def provider(self, id_: str, version: str, compute, gives: list[str] = ()) -> None:
        """`compute` makes metrics of a context; `gives` names them, none: any."""
        self._add(self.providers, id_, version, compute)
        self.gives[id_, version] = frozenset(gives)

    def rule(self, id_: str, version: str, evaluate, needs: list[str] = ()) -> None:
        """`evaluate` makes findings of a context and all metrics; `needs` names those that it reads, none: any."""
        self._add(self.rules, id_, version, evaluate)
        self.needs[id_, version] = frozenset(needs)

    def run(self, context: dict[str, DataFrame]) -> tuple[DataFrame | None, list[dict], list[dict]]:
        """Findings of all rules (None if no provider gave metrics), the rules' coverage and the diagnostics.

        A provider that fails takes only its own metrics away: rules that need none of them are observed all the same, the
        others partial where some other provider gives what they need, else not_evaluable.
        """
        batches, failed, diagnostics = {}, set(), []
        for key, compute in self.providers.items():
            try:
                batches[key] = compute(context)
            except (KeyError, ValueError, TypeError, AnalysisException) as e:
                failed.add(key)
                diagnostics.append({"code": "provider_failed", "provider": key[0], "version": key[1], "message": f"{type(e).__name__}: {str(e).splitlines()[0][:200] if str(e) else ''}"})
        metrics = reduce(DataFrame.unionByName, batches.values()) if batches else None
        coverage = []
        for key in self.rules:
            serve = [p for p in self.providers if not self.gives[p] or not self.needs[key] or self.gives[p] & self.needs[key]]
            lost = [p for p in serve if p in failed]
            status = "observed" if serve and not lost else "partial" if len(lost) < len(serve) else "not_evaluable"
            coverage.append({"rule_id": key[0], "rule_version": key[1], "status": status, "reason": ", ".join(p[0] for p in lost)})
        able = [self.rules[c["rule_id"], c["rule_version"]] for c in coverage if c["status"] != "not_evaluable"]
        findings = reduce(DataFrame.unionByName, [rule(context, metrics) for rule in able]) if able and metrics is not None else None
        return findings, coverage, diagnostics

    def evaluate(self, context: dict[str, DataFrame]) -> DataFrame:
        """The findings of run()."""
        findings, _, diagnostics = self.run(context)
        if findings is None:
            raise ValueError("no provider gave metrics" + "".join(f"; {d['provider']}: {d['message']}" for d in diagnostics))
        return findings


def default_catalog() -> Catalog:
    catalog = Catalog()
    for rule_id in RULES:
        catalog.rule(rule_id, "1.0.0", lambda _, metrics, r=rule_id: threshold_findings(metrics, threshold_rule(r)))
    return catalog
