"""A source index built from batches of facts: each batch is taken whole or not at all.

An append writes the facts of its batches, partitioned by batch, below a folder of its own; then it validates what was
written, all batches at once; then a manifest with the verdict on each batch is put in place by one rename. Readers see
the batches that a manifest calls committed and nothing else, so an append that dies leaves nothing behind that counts,
and an append of the same name is not made twice.

A batch may stand on facts of earlier appends, not on those of other batches of its own.

Facts: files (batch, file_id, path, lines), symbols (batch, symbol_id, file_id, key, line, end_line) and relations (batch,
relation_id, from_id, to_key); a relation names its target by a key, which is looked up among the symbols of all batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.tables import written
from lodestar.streaming.events import snapshot_digest

SHAPES = {
    "files": "batch string, file_id string, path string, lines long",
    "symbols": "batch string, symbol_id string, file_id string, key string, line long, end_line long",
    "relations": "batch string, relation_id string, from_id string, to_key string",
}
IDS = {"files": "file_id", "symbols": "symbol_id", "relations": "relation_id"}
MANIFEST = "append string, batch string, status string, facts long, problems map<string,long>"


class SourceIndex:
    """The index in `folder`, which the driver and all executors reach."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> DataFrame:
        """append, batch, status (committed, rejected), facts, problems (code: number) of every batch so far."""
        if not self.fs.exists(self.path(f"{self.folder}/manifests")):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{self.folder}/manifests")

    def facts(self, name: str) -> DataFrame:
        """The facts of a kind, of committed batches only, in no order."""
        if not self.fs.exists(self.path(f"{self.folder}/data/{name}")):
            return self.spark.createDataFrame([], SHAPES[name]).withColumn("append", F.lit(""))
        own = self.spark.read.schema(SHAPES[name] + ", append string").parquet(f"{self.folder}/data/{name}")
        return own.join(self.manifest().filter("status = 'committed'").select("append", "batch"), ["append", "batch"], "left_semi").select(*[c.split()[0] for c in SHAPES[name].split(", ")], "append")

    def append(self, name: str, batches: dict[str, DataFrame]) -> DataFrame:
        """Takes the batches of facts under the name of an append; their part of the manifest. A name that is there already
        keeps what it has. Facts without a batch are refused."""
        if "/" in name or name.startswith((".", "_")):
            raise ValueError(f"{name} does not name an append")
        done = f"{self.folder}/manifests/{name}.parquet"
        if not self.fs.exists(self.path(done)):
            own = {}
            for kind, shape in SHAPES.items():
                columns = [c.split() for c in shape.split(", ")]
                df = batches.get(kind)
                df = self.spark.createDataFrame([], shape) if df is None else df.select(*[F.col(c).cast(t) for c, t in columns])
                named = F.when(F.col("batch").isNotNull(), F.col("batch")).otherwise(F.raise_error(F.lit("a fact without a batch")))
                to = f"{self.folder}/data/{kind}/append={name}"
                df.withColumn("batch", named).write.mode("overwrite").partitionBy("batch").parquet(to)
                own[kind] = self.spark.read.schema(shape).parquet(to)
            self.judged(name, own).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/tried/{name}")  # a row a batch
            self.fs.mkdirs(self.path(f"{self.folder}/manifests"))
            if not self.fs.rename(self.path(f"{self.folder}/tried/{name}"), self.path(done)):
                raise OSError(f"the manifest {done} could not be put in place")
        return self.manifest().filter(F.col("append") == name)

    def judged(self, name: str, own: dict[str, DataFrame]) -> DataFrame:
        """The manifest of an append from its written facts."""
        problems = []

        def found(df: DataFrame, code: str) -> None:
            problems.append(df.select("batch", F.lit(code).alias("code")))

        for kind, key in IDS.items():
            found(own[kind].filter(F.col(key).isNull() | (F.col(key) == "")), f"{kind}:no_id")
            # of the batches with an id, those that hold it twice and all but the first; and all, if it is in the index already
            count = own[kind].filter(F.col(key).isNotNull()).groupBy(key, "batch").agg(F.count("*").alias("n"))
            first = count.groupBy(key).agg(F.min("batch").alias("first"))
            found(count.join(first, key).filter("n > 1 or batch > first"), f"{kind}:repeated_id")
            found(count.join(self.facts(kind).select(key), key, "left_semi"), f"{kind}:known_id")
        # a batch stands on its own facts and on what is committed, never on another batch that may fail
        files = own["files"].select("batch", "file_id", "lines")
        old = self.facts("files").select("file_id", F.col("lines").alias("old_lines"))
        placed = own["symbols"].join(files, ["batch", "file_id"], "left").join(old, "file_id", "left").withColumn("room", F.coalesce("lines", "old_lines"))
        found(placed.filter("room is null"), "symbols:no_file")
        found(placed.filter("line is null or end_line is null or line < 1 or end_line < line or end_line > room"), "symbols:bad_span")
        ends = own["relations"].join(own["symbols"].select("batch", F.col("symbol_id").alias("from_id")), ["batch", "from_id"], "left_anti")
        found(ends.join(self.facts("symbols").select(F.col("symbol_id").alias("from_id")), "from_id", "left_anti"), "relations:no_source")
        each = problems[0]
        for p in problems[1:]:
            each = each.unionByName(p)
        bad = each.groupBy("batch", "code").agg(F.count("*").alias("n")).groupBy("batch").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("problems"))  # a few codes
        sizes = None
        for df in own.values():
            n = df.groupBy("batch").agg(F.count("*").alias("n"))
            sizes = n if sizes is None else sizes.unionByName(n)
        sizes = sizes.groupBy("batch").agg(F.sum("n").alias("facts"))
        none = F.expr("cast(map() as map<string,long>)")
        return sizes.join(bad, "batch", "left").select(F.lit(name).alias("append"), "batch", F.when(F.col("problems").isNull(), "committed").otherwise("rejected").alias("status"), "facts", F.coalesce("problems", none).alias("problems"))

    def relations(self) -> DataFrame:
        """Committed relations with to_id, the one symbol with their target's key, and status: resolved, missing or ambiguous."""
        keys = self.facts("symbols").groupBy("key").agg(F.count("*").alias("n"), F.min("symbol_id").alias("to_id")).withColumnRenamed("key", "to_key")
        status = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("resolved")
        return self.facts("relations").join(keys, "to_key", "left").select("relation_id", "from_id", "to_key", F.when(F.col("n") == 1, F.col("to_id")).alias("to_id"), status.alias("status"))

    def coverage(self, capability: Column) -> DataFrame:
        """capability, batches, committed, facts (committed ones) and status by what `capability` makes of a batch: observed if all
        its batches were taken, partial if some were, not_evaluable if none was."""
        taken = F.col("status") == "committed"
        n = self.manifest().groupBy(capability.alias("capability")).agg(F.count("*").alias("batches"), F.count_if(taken).alias("committed"), F.coalesce(F.sum(F.when(taken, F.col("facts"))), F.lit(0)).alias("facts"))
        return n.withColumn("status", F.when(F.col("committed") == F.col("batches"), "observed").when(F.col("committed") > 0, "partial").otherwise("not_evaluable"))

    def digest(self) -> str:
        """One digest of all committed facts, whatever batches and appends they came in."""
        parts = []
        for kind, key in IDS.items():
            f = self.facts(kind).drop("append", "batch")
            parts.append(f.select(F.concat(F.lit(f"{kind}/"), F.col(key)).alias("path"), F.sha2(F.to_json(F.struct(*sorted(f.columns))), 256).alias("hash")))
        return snapshot_digest(written(parts[0].unionByName(parts[1]).unionByName(parts[2]))).head()["digest"]
