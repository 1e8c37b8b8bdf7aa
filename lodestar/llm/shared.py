"""What the operators share: tables written to the shared folder, joins that look at a size before they broadcast."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its written table has at most so many bytes of Parquet.
BROADCAST_BYTES = 4 << 20
#: Rows and bytes of an Arrow batch.
ROWS_A_BATCH, BATCH_BYTES = 1000, 8 << 20
#: A key is heavy if it has one in HEAVY_KEYS of all rows, and HEAVY_ROWS at least: so there are never more than HEAVY_KEYS.
HEAVY_KEYS, HEAVY_ROWS = 1000, 500


def spark_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset (tests), one under /tmp."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = got.get() if got.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: executors share no folder")
        found = "file:///tmp/checkpoints"
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the application ends."""
    path = f"{shared_dir(spark)}/lodestar/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Table:
    """A DataFrame written as Parquet and read again: lineage is cut, and a lost executor loses nothing of it."""

    def __init__(self, df: DataFrame, name: str) -> None:
        self.spark = df.sparkSession
        self.path = scratch(self.spark, name)
        self.schema = df.schema
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(self.schema).parquet(self.path)

    @property
    def bytes(self) -> int:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()

    def maybe_broadcast(self, limit: int = BROADCAST_BYTES) -> DataFrame:
        """The table, with a broadcast hint if it is small enough; else a shuffled join takes it."""
        return F.broadcast(self.df) if self.bytes <= limit else self.df

    def drop(self) -> None:
        drop(self.spark, self.path)


def heavy_limit(rows: int | None) -> int:
    """Rows from which a key is heavy."""
    return max(HEAVY_ROWS, -(-(rows or 0) // HEAVY_KEYS))


def heavy_keys(counts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """The heavy ones of `keys`, unique rows of `counts` with the number `n` of rows that hold them; HEAVY_KEYS at most."""
    return counts.filter(F.col(n) >= heavy_limit(counts.agg(F.sum(n)).head()[0])).select(*keys)


def join_heavy(many: DataFrame, few: DataFrame, keys: list[str], heavy: DataFrame, by: str) -> DataFrame:
    """many JOIN few on `keys`, of which `few` has a row each: rows of heavy keys are dealt out by a hash of column `by`,
    and the few rows that they meet are repeated for each share."""
    shares = max(8, int(many.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    marked = F.broadcast(heavy.withColumn("__heavy", F.lit(True)))  # HEAVY_KEYS rows at most
    left = many.join(marked, keys, "left").withColumn("__share", F.when(F.col("__heavy"), F.pmod(F.xxhash64(by), F.lit(shares))).otherwise(F.lit(0).cast("long"))).drop("__heavy")
    right = few.join(marked, keys, "left").withColumn("__share", F.explode(F.when(F.col("__heavy"), F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))).drop("__heavy")
    return left.join(right, [*keys, "__share"]).drop("__share")


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ROWS_A_BATCH rows and about BATCH_BYTES, unless the session has limits of its own: whole texts go
    through them, and each is held by the JVM and by a Python worker at once."""
    for key, usual, own in (("maxRecordsPerBatch", "10000", ROWS_A_BATCH), ("maxBytesPerBatch", None, BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name) or ""
        if now and (now == usual or usual is None and int(re.sub(r"\D", "", now) or 0) >= 64 << 20):
            spark.conf.set(name, str(own))


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """`df` with its columns renamed to c0, c1 ... by position, and their names: dots, capitals and repeated names in them
    never meet an operator's own columns."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), df.columns


def place(names: list[str], name: str) -> int:
    """Where the column `name` stands: written just so, else the first that differs in capitals only."""
    for same in (str, str.lower):
        for i, c in enumerate(names):
            if same(c) == same(name):
                return i
    raise ValueError(f"there is no column {name} among {names}")


def without_columns(df: DataFrame, *gone: str) -> DataFrame:
    """`df` without the columns of these names, in whatever capitals."""
    plain, names = numbered(df)
    keep = [i for i, c in enumerate(names) if c.lower() not in gone]
    return plain.select(*[f"c{i}" for i in keep]).toDF(*[names[i] for i in keep])


def strip_to(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; what else a table holds never meets the operator's own column names."""
    small_batches(df.sparkSession)
    plain, names = numbered(df)
    return plain.select(*[F.col(f"c{place(names, c)}").cast(t).alias(c) for c, t in types.items()])
