"""A live session: immutable revisions of a table, published when its content changed."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class RevisionStore:
    """Revisions as Parquet partitions; a revision equal to the last by its digest is not published again.

    A revision counts once its digest stands beside it, put in place by a rename. A store that opens a folder goes on after
    the revisions that it finds there.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.revisions: list[str] = []
        while self._fs.exists(self._digest(len(self.revisions) + 1)):
            self.revisions.append(spark.read.text(self._digest(len(self.revisions) + 1).toString()).head()[0])
        self._changed = threading.Condition()

    def _digest(self, revision: int):
        return self._path(f"{self.path}/digests/{revision}.txt")

    def publish(self, rows: DataFrame, digest: str) -> int:
        with self._changed:
            if not self.revisions or self.revisions[-1] != digest:
                n = len(self.revisions) + 1
                rows.write.mode("overwrite").parquet(f"{self.path}/revision={n}")  # at most what died before it had its digest
                self._fs.mkdirs(self._digest(n).getParent())
                beside = self._path(f"{self.path}/digests/{n}.part")
                out = self._fs.create(beside, True)
                out.write(bytearray(digest.encode()))
                out.close()
                if not self._fs.rename(beside, self._digest(n)):
                    raise OSError(f"revision {n} is there already")
                self.revisions.append(digest)
                self._changed.notify_all()
            return len(self.revisions)

    def read(self, revision: int | None = None) -> DataFrame:
        """The latest revision, or a given one."""
        n = len(self.revisions) if revision is None else revision
        if not 1 <= n <= len(self.revisions):
            raise LookupError(f"no revision {n}")
        return self.spark.read.parquet(f"{self.path}/revision={n}")

    def wait(self, revision: int, seconds: float) -> bool:
        with self._changed:
            return self._changed.wait_for(lambda: len(self.revisions) >= revision, seconds)


class LiveSession:
    """Rebuilds a table when its input's digest changes.

    `digest` gives the input's digest, `build` the table. The digest is taken before and after a build, which is tried
    again if they differ; one build runs at a time, and further requests wait for it.
    """

    def __init__(self, store: RevisionStore, digest: Callable[[], str], build: Callable[[], DataFrame], retries: int = 2) -> None:
        self.store, self.digest, self.build, self.retries = store, digest, build, retries
        self.input: str | None = None
        self._one = threading.Lock()

    def ensure_current(self, seconds: float = 5.0) -> int:
        end = time.monotonic() + seconds
        with self._one:
            for _ in range(self.retries + 1):
                before = self.digest()
                if before == self.input and self.store.revisions:
                    return len(self.store.revisions)
                rows = self.build()
                content = rows.agg(F.sha2(F.concat_ws(",", F.count("*").cast("string"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).cast("string")), 256)).head()[0]
                if self.digest() == before:
                    self.input = before
                    return self.store.publish(rows, content)
                if time.monotonic() > end:
                    break
        raise TimeoutError("the input does not stop changing")

    def query(self, consistency: str = "latest_ready", revision: int | None = None) -> DataFrame:
        if consistency == "require_current":
            self.ensure_current()
        elif consistency == "specific_revision" and revision is None:
            raise ValueError("a revision must be given")
        return self.store.read(revision if consistency == "specific_revision" else None)
