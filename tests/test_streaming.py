import datetime as dt

from pyspark.sql import functions as F

from lodestar.streaming import events as E
from lodestar.streaming.session import LiveSession, RevisionStore

T0 = dt.datetime(2024, 1, 1)
ROWS = [(1, "a", "create"), (2, "a", "modify"), (3, "b", "create"), (4, "b", "delete"), (5, "c", "delete"), (6, "c", "create"), (8, "d", "modify"), (9, "d", "rename"), (10, "b", "create"), (10, "b", "create")]


def events(spark):
    return spark.createDataFrame([(s, p, k, T0 + dt.timedelta(seconds=s * (10 if s > 5 else 1))) for s, p, k in ROWS], "seq long, path string, kind string, ts timestamp")


def test_coalescing(spark):
    got = {r.path: (r.kind, r.first_seq, r.last_seq) for r in E.coalesced(events(spark)).collect()}
    assert got == {"a": ("create", 1, 2), "b": ("create", 3, 10), "c": ("modify", 5, 6), "d": ("rename", 8, 9)}
    assert [(r.before, r.seq) for r in E.sequence_gaps(events(spark)).collect()] == [(6, 8)]


def test_stream_as_batch(spark, tmp_path):
    df = events(spark).dropDuplicates(["seq"])
    for i, part in enumerate((df.filter("seq <= 4"), df.filter("seq > 4"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert i < 2
    read = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = E.coalesced_stream(read).writeStream.format("memory").queryName("pending").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    last = {}
    for r in spark.sql("SELECT * FROM pending").collect():
        if r.last_seq >= last.get(r.path, (None, -1))[1]:
            last[r.path] = (r.kind, r.last_seq)
    assert {p: k for p, (k, _) in last.items() if k} == {r.path: r.kind for r in E.coalesced(df).collect()}


def test_debounced_stream(spark, tmp_path):
    df = events(spark).dropDuplicates(["seq"]).withColumn("root", F.lit("r"))
    late = spark.createDataFrame([(99, "z", "modify", T0 + dt.timedelta(hours=3), "r")], df.schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = E.debounced_stream(read, "15 seconds", "1 minute", ["root"]).writeStream.format("memory").queryName("groups").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    stream = {tuple(r) for r in spark.sql("SELECT events, paths, first_seq, last_seq FROM groups").collect()}
    assert stream == {tuple(r) for r in E.debounced(df, "15 seconds").select("events", "paths", "first_seq", "last_seq").collect()}


def test_rescan_and_diff(spark):
    e = spark.createDataFrame([("g", 1, "a", "create"), ("g", 2, "", "overflow"), ("h", 3, "b", "modify")], "g string, seq long, path string, kind string")
    assert {r.g: (r.rescan, r.pending) for r in E.needs_rescan(e, ["g"]).collect()} == {"g": (True, 1), "h": (False, 1)}
    a, b = (spark.createDataFrame(x, "path string, content string") for x in ([("a", "1"), ("b", "2")], [("b", "3"), ("c", "4")]))
    assert {tuple(r) for r in E.snapshot_diff(E.fingerprints(a), E.fingerprints(b)).collect()} == {("a", "delete"), ("b", "modify"), ("c", "create")}
    assert E.snapshot_digest(E.fingerprints(a)).head() == E.snapshot_digest(E.fingerprints(a.repartition(3))).head() != E.snapshot_digest(E.fingerprints(b)).head()


def test_revisions(spark, tmp_path):
    state = {"n": 1}
    session = LiveSession(RevisionStore(spark, str(tmp_path / "rev")), lambda: str(state["n"]), lambda: spark.range(min(state["n"], 2)).withColumn("x", F.lit(1)))
    assert session.ensure_current() == 1 and session.ensure_current() == 1
    state["n"] = 2
    assert session.query("require_current").count() == 2 and session.query("specific_revision", 1).count() == 1
    state["n"] = 3  # the same content: no new revision
    assert session.ensure_current() == 2 and session.store.wait(2, 0.1) and not session.store.wait(3, 0.1)
