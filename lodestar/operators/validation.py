"""Validation of quality profiles before anything is evaluated: identities, bindings against the catalogue, typed parameters.

Profiles come as tables, so all of them are checked at once: profiles (profile_id, profile_version, schema_version), bindings
(profile_id, ord, rule_id, rule_version, severity, namespace, schema_version, payload as JSON), and of the catalogue rules
(rule_id, rule_version, namespace, schema_version) and fields (rule_id, rule_version, field, kind, required, minimum, maximum,
allowed: array or null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.facts import decimal_value, integer_value
from lodestar.operators.quality import SEVERITIES
from lodestar.operators.tables import written

#: Fixed value: the schema that profiles follow.
SCHEMA_VERSION = "1.0.0"
#: Rules that must agree in a parameter.
COUPLING, POLICY = ("architecture:module.max-efferent-coupling", "architecture:module.max-afferent-coupling"), "external_policy"


def is_namespaced(c: Column) -> Column:
    """A name with something on either side of its first colon and no white space or NUL; null is none."""
    return F.coalesce(F.rlike(F.trim(c), F.lit(r"\A[^\x00\r\n\t :]+:[^\x00\r\n\t ]+\z")), F.lit(False))


def is_version(c: Column) -> Column:
    """Digits, dots, hyphens and plus signs, after a `v` or not."""
    return F.coalesce(F.rlike(F.trim(c), F.lit(r"\Av?[0-9.+-]+\z")), F.lit(False))


def fits(kind: Column, value: Column, minimum: Column, maximum: Column, allowed: Column) -> Column:
    """Whether a variant is of a field's kind, within its range, and one of the allowed values (if there are any)."""
    text, shape = F.to_json(value), F.schema_of_variant(value)
    number = F.when(kind == "integer", integer_value(text).cast("double")).when(kind == "decimal", decimal_value(text))
    within = number.isNotNull() & (minimum.isNull() | (number >= minimum)) & (maximum.isNull() | (number <= maximum))
    members = F.coalesce(F.try_variant_get(value, "$", "array<string>"), F.expr("cast(array() as array<string>)"))
    listed = shape.isin("ARRAY<STRING>", "ARRAY<VOID>") & F.forall(members, lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))
    plain = F.try_variant_get(value, "$", "string")
    ok = F.when(kind.isin("integer", "decimal"), within).when(kind == "string", shape == "STRING").when(kind == "boolean", shape == "BOOLEAN").when(kind == "string_list", listed)
    chosen = F.when(allowed.isNull() | (F.size(allowed) == 0), True).when(kind == "string_list", F.forall(members, lambda x: F.array_contains(allowed, x))).otherwise(F.array_contains(allowed, plain))
    return F.coalesce(ok & chosen, F.lit(False))


def parameter_problems(bindings: DataFrame, rules: DataFrame, fields: DataFrame) -> DataFrame:
    """(profile_id, ord, code, field) of bindings whose rule and version are registered. Codes: `schema` for another namespace or
    version than the rule's, else `payload` for no object, else `missing_field`, `bad_value` and `unknown_field`."""
    spark, rule, own = bindings.sparkSession, ["rule_id", "rule_version"], ["profile_id", "ord"]
    known = rules.select(*rule, F.col("namespace").alias("want"), F.col("schema_version").alias("want_version"))
    b = bindings.join(known, rule).withColumn("v", F.try_parse_json("payload"))
    same = F.col("namespace").eqNullSafe(F.col("want")) & F.col("schema_version").eqNullSafe(F.col("want_version"))
    state = F.when(~same, "schema").when(~F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False)), "payload").otherwise("")
    b = b.withColumn("state", state)
    whole = b.filter("state <> ''").select(*own, F.col("state").alias("code"), F.lit("").alias("field"))
    good = b.filter("state = ''").select(*own, *rule, "v")
    given = good.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(*own, *rule, F.col("key").alias("field"), "value")
    met = given.join(fields.withColumn("listed", F.lit(True)), [*rule, "field"], "left")
    code = F.when(F.col("listed").isNull(), "unknown_field").when(~fits(F.col("kind"), F.col("value"), F.col("minimum"), F.col("maximum"), F.col("allowed")), "bad_value")
    wrong = met.select(*own, code.alias("code"), "field").filter("code is not null")
    lacking = good.select(*own, *rule).join(fields.filter("required").select(*rule, "field"), rule).join(given.select(*own, "field"), [*own, "field"], "left_anti")
    return whole.unionByName(wrong).unionByName(lacking.select(*own, F.lit("missing_field").alias("code"), "field"))


def profile_problems(profiles: DataFrame, bindings: DataFrame, rules: DataFrame, fields: DataFrame) -> DataFrame:
    """(profile_id, ord, code, field) of what is wrong with each profile; ord is null for the profile itself.

    Codes of a profile: `schema_version`, `profile_id`, `profile_version`. Of a binding, the first that holds: `duplicate_rule`
    (the same rule and version once more), `rule_identity`, `rule_unknown`, `rule_unsupported` (no such version); of those whose
    rule is found also `severity` and what parameter_problems() tells; and `external_policy` where rules of coupling differ from
    the first of them. A null profile_id in bindings belongs to no profile.
    """
    p = profiles.select("profile_id", F.explode(F.filter(F.array(F.when(~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION)), "schema_version"), F.when(~(is_namespaced(F.col("profile_id")) & F.startswith("profile_id", F.lit("profile:"))) | F.col("profile_id").isNull(), "profile_id"), F.when(~is_version(F.col("profile_version")), "profile_version")), lambda x: x.isNotNull())).alias("code"))
    none = F.lit(None).cast("long").alias("ord"), F.lit("").alias("field")
    whole = p.select("profile_id", none[0], "code", none[1])
    rule = ["rule_id", "rule_version"]
    trimmed = bindings.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in rule}).withColumn("ord", F.col("ord").cast("long"))
    nth = F.row_number().over(Window.partitionBy("profile_id", *rule).orderBy("ord"))
    names = rules.select("rule_id").distinct().withColumn("named", F.lit(True))
    found = trimmed.withColumn("nth", nth).join(rules.select(*rule, F.lit(True).alias("found")), rule, "left").join(names, "rule_id", "left")
    code = F.when(F.col("nth") > 1, "duplicate_rule").when(~is_namespaced(F.col("rule_id")) | ~is_version(F.col("rule_version")), "rule_identity").when(F.col("found").isNull(), F.when(F.col("named"), "rule_unsupported").otherwise("rule_unknown"))
    judged = written(found.withColumn("code", code))
    able = judged.filter("code is null")
    out = whole.unionByName(judged.filter("code is not null").select("profile_id", "ord", "code", none[1]))
    severity = F.coalesce("severity", F.lit(""))
    out = out.unionByName(able.filter((severity != "") & ~severity.isin(*SEVERITIES)).select("profile_id", "ord", F.lit("severity").alias("code"), none[1]))
    out = out.unionByName(parameter_problems(able.select(*bindings.columns), rules, fields).select("profile_id", "ord", "code", "field"))
    policy = F.try_variant_get(F.try_parse_json("payload"), f"$.{POLICY}", "string")
    coupling = judged.filter(F.col("rule_id").isin(*COUPLING) & (F.schema_of_variant(F.try_variant_get(F.try_parse_json("payload"), f"$.{POLICY}", "variant")) == "STRING")).select("profile_id", "ord", policy.alias("policy"))
    first = coupling.filter("policy <> ''").groupBy("profile_id").agg(F.min_by(F.struct("policy", "ord"), "ord").alias("first"))
    differs = coupling.join(first, "profile_id").filter("ord > first.ord and policy <> first.policy")
    return out.unionByName(differs.select("profile_id", "ord", F.lit(POLICY).alias("code"), none[1]))
