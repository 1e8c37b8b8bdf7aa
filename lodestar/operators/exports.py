"""Selection of a package's export for a subpath and a runtime, as rounds over nested JSON values.

Every candidate value carries the places it was chosen at, so what a depth-first search would meet first is the least
list of places. A round takes all values that are no strings apart: a list into its members, a map of subpaths into those
that match, a map of conditions into those that hold. Strings are answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators.tables import written

#: Conditions in the order in which they are tried.
CONDITIONS = {"cjs": ("types", "require", "node", "default", "import"), "esm": ("types", "import", "node", "default", "require"), "auto": ("types", "import", "require", "node", "default")}


def captured(pattern: Column, text: Column) -> Column:
    """What `*` of a pattern stands for in a text that matches it; '' for an equal text without `*`; null if it does not match."""
    at = F.instr(pattern, "*")
    before, after = F.substring(pattern, F.lit(1), at - 1), F.substring(pattern, at + 1, F.length(pattern))
    long = F.length(text) >= F.length(before) + F.length(after)
    middle = F.substring(text, F.length(before) + 1, F.length(text) - F.length(before) - F.length(after))
    wild = F.when(long & F.startswith(text, before) & F.endswith(text, after), middle)
    return F.when(at == 0, F.when(pattern == text, F.lit(""))).otherwise(wild)


def condition_place(runtime: Column, key: Column) -> Column:
    """The place of a condition for a runtime (unknown ones as `auto`), null if it never holds."""
    orders = {name: F.create_map(*[F.lit(x) for i, c in enumerate(order) for x in (c, i)]) for name, order in CONDITIONS.items()}
    return F.when(runtime == "cjs", orders["cjs"][key]).when(runtime == "esm", orders["esm"][key]).otherwise(orders["auto"][key])


def members(df: DataFrame, spark: SparkSession) -> DataFrame:
    """`df` with a row (pos, key, value) for each member of its column v, a list or a map."""
    return df.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))


def package_exports(requests: DataFrame) -> DataFrame:
    """(request_id, target) for requests (request_id, exports, subpath, runtime): the first string that the search meets, with
    `*` replaced by what the subpath's pattern caught; null if there is none or `exports` is no JSON.

    A map with a key that starts with a dot holds subpaths: the equal one is tried first, then longer before shorter, then
    by name. Any other map holds conditions.
    """
    spark = requests.sparkSession
    start = requests.select("request_id", "subpath", F.coalesce("runtime", F.lit("auto")).alias("runtime"), F.try_parse_json("exports").alias("v"), F.expr("cast(array() as array<int>)").alias("places"), F.expr("cast(array() as array<string>)").alias("caught"))
    left, answers = start.filter("v is not null"), []
    columns = ("request_id", "subpath", "runtime", "v", "places", "caught")
    while True:
        # a variant is written as its JSON text
        left = written(left.withColumn("kind", F.regexp_extract(F.schema_of_variant("v"), r"^[A-Z]+", 0)).withColumn("v", F.to_json("v"))).withColumn("v", F.parse_json("v"))
        answers.append(left.filter("kind = 'STRING'").select("request_id", "places", "caught", F.variant_get("v", "$", "string").alias("target")))
        nested = left.filter("kind in ('ARRAY', 'OBJECT')")
        if nested.isEmpty():
            break
        each = members(nested.withColumn("dotted", F.exists(F.coalesce(F.json_object_keys(F.to_json("v")), F.expr("cast(array() as array<string>)")), lambda k: F.startswith(k, F.lit(".")))), spark)
        capture = captured(F.col("key"), F.col("subpath"))
        by_length = Window.partitionBy("request_id", "places").orderBy(F.col("key") != F.col("subpath"), F.desc(F.length("key")), "key")
        paths = each.filter("kind = 'OBJECT' and dotted").withColumn("capture", capture).withColumn("place", F.row_number().over(by_length)).filter("capture is not null")
        plain = each.filter("kind = 'ARRAY' or not dotted").withColumn("place", F.when(F.col("kind") == "ARRAY", F.col("pos")).otherwise(condition_place(F.col("runtime"), F.col("key")))).filter("place is not null")
        step = lambda df, caught: df.select("request_id", "subpath", "runtime", F.col("value").alias("v"), F.concat("places", F.array(F.col("place").cast("int"))).alias("places"), caught.alias("caught"))
        left = step(paths, F.concat(F.array("capture"), "caught")).unionByName(step(plain, F.col("caught"))).select(*columns)
    first = answers[0]
    for more in answers[1:]:
        first = first.unionByName(more)
    best = first.groupBy("request_id").agg(F.min_by(F.struct("target", "caught"), "places").alias("b"))
    # the innermost subpath's capture is put in first
    target = F.aggregate("b.caught", F.col("b.target"), lambda acc, c: F.replace(acc, F.lit("*"), c))
    return requests.select("request_id").join(best.select("request_id", target.alias("target")), "request_id", "left")
