import pytest
from pyspark.sql import functions as F

from lodestar.functions import ids, paths
from lodestar.functions import text as T


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column).head()[0]


@pytest.mark.parametrize(("text", "physical", "split"), [("", 0, 1), ("a", 1, 1), ("a\n", 1, 2), ("a\r\nb", 2, 2), ("a\rb\r", 2, 3), ("\n\n", 2, 3)])
def test_the_two_line_rules(spark, text, physical, split):
    assert one(spark, text, T.physical_lines(F.col("v"))) == physical
    assert one(spark, text, F.size(T.split_lines(F.col("v")))) == split


def test_truncation_and_matches(spark):
    assert one(spark, "aé日", T.truncate_utf8(F.col("v"), F.lit(4))) == "aé"
    found = one(spark, "éX xx", T.matches(F.col("v"), "x", case_sensitive=False))
    assert [(m["start"], m["end"]) for m in found] == [(2, 3), (4, 5), (5, 6)]
    literal = one(spark, "é.a.a..", T.literal_matches(F.col("v"), ".a"))
    assert [(m["start"], m["end"]) for m in literal] == [(2, 4), (4, 6)]
    for needle in ("\\E", "\\Qa\\E", "[(", "a b\t#", "é|日", "\\", "$^"):
        text = f"é{needle}x{needle}{needle}"
        n = len(needle.encode())
        assert [(m["start"], m["end"]) for m in one(spark, text, T.literal_matches(F.col("v"), needle))] == [(s, s + n) for s in (2, 3 + n, 3 + 2 * n)]
    for bad in (" ", "x" * 600):
        with pytest.raises(ValueError):
            T.matches(F.col("v"), bad)
    with pytest.raises(ValueError):
        T.matches(F.col("v"), "(?=a)", regex=True)


def test_globs():
    import re

    hit = lambda rx, p: bool(rx and re.search(rx, p))
    assert hit(paths.single_level_regex("a/*.go"), "a/x.go") and not hit(paths.single_level_regex("a/*"), "a/b/c")
    assert hit(paths.single_level_regex("[^a]?"), "bc") and paths.single_level_regex("[a") is None and paths.single_level_regex("a\\") is None
    deep = paths.deep_regex
    assert hit(deep("**/*.go"), "x.go") and hit(deep("**/*.go"), "a/b/x.go") and hit(deep("excluded/**"), "excluded/a/b") and hit(deep("src"), "src/a.go") and not hit(deep("src"), "srcs/a.go")


def test_identities(spark):
    assert one(spark, "a b~*./-_é", ids.percent_encoded(F.col("v"))) == "a%20b~%2A.%2F-_%C3%A9"
    assert one(spark, None, ids.stable_id("m", F.col("v"), F.lit("x"))) == one(spark, "", ids.stable_id("m", F.col("v"), F.lit("x")))
    assert one(spark, "a/b/c", F.array_join(paths.ancestors(F.col("v")), ",")) == ".,a,a/b"
    for path, good in (("a/b", True), ("", False), ("/a", False), ("C:/a", False), ("../a", False), ("a/../b", False)):
        assert one(spark, path, paths.repository_relative(F.col("v"))) is good
    assert one(spark, "a\\b/../c", paths.cleaned(F.col("v"))) == "a/c"
    assert one(spark, "a/NODE_modules/x", paths.in_excluded_directory(F.col("v"))) is True
