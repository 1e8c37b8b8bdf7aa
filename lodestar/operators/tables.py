"""Tables written between the rounds of an iterative operator."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pairs of a key up to which a join leaves them to one task, about.
CELL_PAIRS = 1 << 22


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one (spark.checkpoint.dir), deleted when the application ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = got.get() if got.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: executors share no folder")
        root = "file:///tmp/checkpoints"
    path = f"{root.rstrip('/')}/lodestar/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame) -> DataFrame:
    """`df` as Parquet in the shared folder, read again: no lineage, and it survives executors."""
    path = shared_path(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_large_groups(many: DataFrame, few: DataFrame, key: str, by: str, other: str, most: int = CELL_PAIRS) -> DataFrame:
    """many JOIN few on `key`, where keys repeat on both sides: the pairs of a key that gives more than `most` are a grid, dealt
    out by hashes of column `by` of `many` and `other` of `few`, about `most` to a cell. Cells meet by shuffle, in partitions that
    follow their number: Spark judges both sides as they were before their rows were repeated, and would broadcast them through
    the driver or put a huge result into a handful of tasks. Both sides are read twice."""
    m, f = (df.groupBy(key).agg(F.count("*").cast("double").alias(n)) for df, n in ((many, "m"), (few, "f")))
    cells = F.ceil(F.col("m") * F.col("f") / most)
    wide = F.ceil(F.least(F.col("m"), F.sqrt(cells * F.col("m") / F.col("f"))))
    pairs = F.col("m") * F.col("f")
    sizes = written(m.join(f, key).select(key, pairs.alias("__pairs"), wide.alias("__wide"), F.ceil(cells / wide).alias("__high")))
    parts = max(1, math.ceil(2 * (sizes.agg(F.sum("__pairs")).first()[0] or 0) / most))
    large = sizes.filter(F.col("__pairs") > most).drop("__pairs")
    wide, high = (F.coalesce(n, F.lit(1).cast("long")) for n in ("__wide", "__high"))
    zero, one, grid = F.lit(0).cast("long"), F.lit(1).cast("long"), F.broadcast(large)  # each row stands for more than `most` pairs
    left = many.join(grid, key, "left").select(*many.columns, F.pmod(F.xxhash64(by), wide).alias("__i"), F.explode(F.sequence(zero, high - one)).alias("__j"))
    right = few.join(grid, key, "left").select(*few.columns, F.explode(F.sequence(zero, wide - one)).alias("__i"), F.pmod(F.xxhash64(other), high).alias("__j"))
    on = [key, "__i", "__j"]
    return left.repartition(parts, *on).join(right.repartition(parts, *on).hint("merge"), on).drop("__i", "__j")
