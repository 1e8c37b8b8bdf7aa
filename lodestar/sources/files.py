"""File trees, JSON models and NDJSON as DataFrames; atomic writes."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.ids import percent_encoded
from lodestar.functions.paths import in_excluded_directory
from lodestar.functions.text import physical_lines

#: Languages by suffix, root markers with their weight, largest NDJSON frame.
LANGUAGES = {"go": "go", "py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "rs": "rust", "clj": "clojure", "cljs": "clojure", "cljc": "clojure", "md": "markdown"}
MARKERS = {"go.mod": 1.0, "go.work": 0.9, "pyproject.toml": 1.0, "setup.cfg": 0.9, "setup.py": 0.8, "tsconfig.json": 1.0, "package.json": 0.6, "Cargo.toml": 1.0, "deps.edn": 1.0, "project.clj": 0.9, "shadow-cljs.edn": 0.8}
MAX_FRAME = 8 << 20


def language_of(path):
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.create_map(*[F.lit(x) for p in LANGUAGES.items() for x in p])[suffix], F.lit("unknown"))


def role_of(path):
    return F.when(F.rlike(path, F.lit(r"(^|/)(tests?|__tests__)/|_test\.[a-z]+$|(^|/)test_[^/]*\.py$|\.(test|spec)\.[jt]sx?$")), "test").when(F.rlike(path, F.lit(r"(^|/)(examples?|samples?)/")), "example").otherwise("source")


def tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, content) of the files below `root`, a URI or path, without excluded directories; content as text."""
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(base)
    prefix = base.split(":", 1)[-1].lstrip("/")
    path = F.regexp_replace(F.col("path"), f"^[a-z]+:/*\\Q{prefix}\\E/", "")
    return raw.select(path.alias("path"), F.decode("content", "UTF-8").alias("content")).filter(~in_excluded_directory(F.col("path")))


def file_facts(files: DataFrame) -> DataFrame:
    """Lines, bytes, hash, language, role and an opaque id of each file."""
    return files.select("path", physical_lines(F.col("content")).alias("lines"), F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("hash"), language_of(F.col("path")).alias("language"), role_of(F.col("path")).alias("role"), F.concat(F.lit("file:"), percent_encoded(F.col("path"))).alias("file_id"))


def root_candidates(files: DataFrame) -> DataFrame:
    """(root, markers, confidence) of directories that hold a marker file."""
    name = F.element_at(F.split("path", "/"), -1)
    root = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(".")
    weight = F.create_map(*[F.lit(x) for p in MARKERS.items() for x in p])[name]
    return files.select(root.alias("root"), name.alias("marker"), weight.alias("weight")).filter("weight is not null").groupBy("root").agg(F.array_sort(F.collect_set("marker")).alias("markers"), F.max("weight").alias("confidence"))


def read_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line under an explicit schema; malformed lines and lines over the frame limit fail."""
    lines = spark.read.text(path)
    small = lines.select(F.when(F.octet_length("value") <= MAX_FRAME, F.col("value")).otherwise(F.raise_error(F.lit("a frame is too long"))).alias("value")).filter("value <> ''")
    return small.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_model(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)


def profiles(documents: DataFrame) -> DataFrame:
    """(path, id, version, status) of JSON documents (path, content): invalid, duplicate (id and version repeat) or valid."""
    from pyspark.sql import Window

    d = documents.select("path", F.get_json_object("content", "$.id").alias("id"), F.get_json_object("content", "$.version").alias("version"))
    n = F.count("*").over(Window.partitionBy("id", "version"))
    return d.withColumn("status", F.when(F.col("id").isNull() | F.col("version").isNull(), "invalid").when(n > 1, "duplicate").otherwise("valid"))


def write_json(path: str, value: object, overwrite: bool = False) -> str:
    """Canonical JSON, written beside its place and renamed; an existing file is kept unless `overwrite`."""
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    text = json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")) + "\n"
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    handle, name = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(name, path)
    return text
