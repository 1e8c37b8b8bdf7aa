"""Profile validation against a case for each rule."""

import json

from pyspark.sql import functions as F

from lodestar.operators import validation as V

PROFILES = "profile_id string, profile_version string, schema_version string"
BINDINGS = "profile_id string, ord int, rule_id string, rule_version string, severity string, namespace string, schema_version string, payload string"
FIELDS = "rule_id string, rule_version string, field string, kind string, required boolean, minimum double, maximum double, allowed array<string>"
EFFERENT, AFFERENT = V.COUPLING


def test_identities(spark):
    names = {"a:b": True, ":b": False, "a:": False, "ab": False, "a:b c": False, " a:b ": True, "a:b:c": True, "": False, None: False}
    versions = {"1.0.0": True, "v1": True, "v": False, "1.x": False, " 2 ": True, "1 2": False, None: False, "2026-08": True}
    got = spark.createDataFrame([(n,) for n in names], "c string").select("c", V.is_namespaced(F.col("c")).alias("ok")).collect()
    assert {r.c: r.ok for r in got} == names
    got = spark.createDataFrame([(n,) for n in versions], "c string").select("c", V.is_version(F.col("c")).alias("ok")).collect()
    assert {r.c: r.ok for r in got} == versions


def test_problems(spark):
    profiles = spark.createDataFrame([("profile:a", "1.0.0", "1.0.0"), ("bad", "one", "2.0.0"), ("profile:b", "v2", "1.0.0"), (None, "1", "1.0.0")], PROFILES)
    rules = spark.createDataFrame([("r:size", "1.0.0", "p:size", "1"), (EFFERENT, "1", "p:c", "1"), (AFFERENT, "1", "p:c", "1")], "rule_id string, rule_version string, namespace string, schema_version string")
    fields = spark.createDataFrame([
        ("r:size", "1.0.0", "limit", "integer", True, 1.0, 100.0, None), ("r:size", "1.0.0", "ratio", "decimal", False, 0.0, 1.0, None), ("r:size", "1.0.0", "on", "boolean", False, None, None, None),
        ("r:size", "1.0.0", "tags", "string_list", False, None, None, None), ("r:size", "1.0.0", "mode", "string", False, None, None, ["strict", "lax"]), ("r:size", "1.0.0", "odd", "no_such_kind", False, None, None, None),
        (EFFERENT, "1", "external_policy", "string", False, None, None, []), (AFFERENT, "1", "external_policy", "string", False, None, None, []),
    ], FIELDS)
    given = [
        ({"limit": 5, "ratio": 0.5, "on": True, "tags": ["x"], "mode": "lax"}, set()), ({"limit": 2.0, "tags": []}, set()), ({}, {("missing_field", "limit")}), ({"limit": 0}, {("bad_value", "limit")}), ({"limit": 2.5}, {("bad_value", "limit")}),
        ({"limit": "5"}, {("bad_value", "limit")}), ({"limit": 1, "ratio": 1.5, "on": "true"}, {("bad_value", "ratio"), ("bad_value", "on")}), ({"limit": 1, "tags": ["x", " "]}, {("bad_value", "tags")}), ({"limit": 1, "tags": [1]}, {("bad_value", "tags")}),
        ({"limit": 1, "mode": "other"}, {("bad_value", "mode")}), ({"limit": 1, "more": None}, {("unknown_field", "more")}), ({"limit": 1, "odd": 1}, {("bad_value", "odd")}), ([1], {("payload", "")}), ("text", {("payload", "")}), ({"limit": None}, {("bad_value", "limit")}),
    ]
    rows, want = [], set()
    for i, (payload, codes) in enumerate(given):
        rows.append((f"profile:{i}", i, "r:size", " 1.0.0", None, "p:size", "1", json.dumps(payload)))
        want |= {(f"profile:{i}", i, *c) for c in codes}
    fine = json.dumps({"limit": 1})
    rows += [("profile:x", 0, "r:size", "1.0.0", "info", "p:size", "1", fine), ("profile:x", 1, "r:size", "1.0.0", "never", "p:size", "1", "{}"), ("profile:x", 2, "r size", "1", "", "", "", fine), ("profile:x", 3, "r:none", "1", "", "", "", fine), ("profile:x", 4, "r:size", "2", "", "", "", fine)]
    rows += [("profile:y", 0, "r:size", "1.0.0", "fatal", "p:other", "1", fine), ("profile:z", 0, "r:size", "1.0.0", "", "p:size", "1", "{not json"), ("profile:w", 0, "r:size", "1.0.0", "", "p:size", "1", None)]
    want |= {("profile:x", 1, "duplicate_rule", ""), ("profile:x", 2, "rule_identity", ""), ("profile:x", 3, "rule_unknown", ""), ("profile:x", 4, "rule_unsupported", ""), ("profile:y", 0, "severity", ""), ("profile:y", 0, "schema", ""), ("profile:z", 0, "payload", ""), ("profile:w", 0, "payload", "")}
    rows += [("profile:p", 0, EFFERENT, "1", "", "p:c", "1", '{"external_policy": "include"}'), ("profile:p", 1, AFFERENT, "1", "", "p:c", "1", '{"external_policy": "exclude"}'), ("profile:q", 0, EFFERENT, "1", "", "p:c", "1", '{"external_policy": "include"}'), ("profile:q", 1, AFFERENT, "1", "", "p:c", "1", '{"external_policy": "include"}')]
    want |= {("profile:p", 1, "external_policy", "")}
    want |= {("bad", None, c, "") for c in ("schema_version", "profile_id", "profile_version")} | {(None, None, "profile_id", "")}
    got = [tuple(r) for r in V.profile_problems(profiles, spark.createDataFrame(rows, BINDINGS), rules, fields).collect()]
    assert set(got) == want and len(got) == len(want)
    empty = V.profile_problems(profiles.limit(0), spark.createDataFrame([], BINDINGS), rules, fields)
    assert empty.count() == 0
