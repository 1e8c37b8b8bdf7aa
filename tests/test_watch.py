"""The watch loop: the rules of one session, and the stream against them, in one batch and in many."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestar.streaming import watch as W
from lodestar.streaming.events import fingerprints

SCHEMA = "session string, seq long, path string, old_path string, kind string, ts timestamp"
T0 = dt.datetime(2024, 1, 1)


def run(events, **more):
    """Plans of one session's events (ms, seq, path, old path, kind), to the end of all debounce times."""
    own, out = W.Watch(**({"debounce_ms": 100} | more)), []
    for e in events:
        out += own.add(*e)
    return out + own.due(10**12)


def test_rules():
    assert run([(0, 1, "a", None, "create"), (1, 2, "a", None, "modify")]) == [("selective", "", ["a"], 1, 2, 101)]
    assert run([(0, 1, "a", None, "create"), (1, 2, "a", None, "delete")]) == []
    assert [p[:2] for p in run([(0, 2, "a", None, "modify"), (1, 4, "b", None, "modify")])] == [("full_rescan", "watch_sequence_gap")]
    assert [p[:3] for p in run([(0, 1, "b", "", "rename")])] == [("full_rescan", "ambiguous_rename", ["b"])]
    assert [p[:3] for p in run([(0, 1, "b", "a", "rename")])] == [("selective", "", ["a", "b"])]
    assert [p[:3] for p in run([(0, 1, "a", None, "modify"), (1, 2, "b", None, "modify")], most=1)] == [("full_rescan", "pending_event_limit_exceeded", [])]
    assert [p[:2] for p in run([(0, 1, None, None, "overflow"), (1, 2, None, None, "error")])] == [("full_rescan", "overflow")]
    own = W.Watch(100)
    assert own.add(0, 1, "a", None, "create") == [] and own.due(99) == [] and len(own.due(100)) == 1


def test_one_build_at_a_time():
    built = (None, None, None, "built")
    got = run([(0, 1, "a", None, "modify"), (200, 2, "b", None, "modify"), (400, *built), (450, 3, "c", None, "modify"), (600, 4, "d", None, "create"), (800, *built), (900, *built), (950, 5, "e", None, "modify")])
    assert got == [
        ("selective", "", ["a"], 1, 1, 100), ("selective", "", ["b"], 2, 2, 400), ("full_rescan", "changes_arrived_during_build", ["c", "d"], 3, 4, 800), ("selective", "", ["e"], 5, 5, 1050),
    ]


def random_events(seed):
    r, at, out = random.Random(seed), 0, []
    seqs = dict.fromkeys("xyz", 0)
    for _ in range(300):
        at += r.choice([1, 20, 50, 90, 150, 400])
        s = r.choice("xyyz")
        seqs[s] += r.choice([1] * 30 + [0, 3])
        kind = r.choice(["create", "modify", "modify", "delete", "rename", "built", "built", *(["overflow", "odd"] if r.random() < 0.1 else [])])
        out.append((s, seqs[s], r.choice("abcdef"), r.choice("abc") if kind == "rename" and r.random() < 0.7 else None, kind, at))
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_stream(spark, tmp_path, parts):
    data = random_events(parts)
    frame = lambda rows: spark.createDataFrame([(*e[:5], T0 + dt.timedelta(milliseconds=e[5])) for e in rows], SCHEMA).coalesce(1)
    end = [("end", None, None, None, "built", data[-1][5] + 60_000)]  # lets the watermark pass all timers
    size = -(-len(data) // parts)
    chunks = [data[i : i + size] for i in range(0, len(data), size)]
    for c in [*chunks, end, [("end", None, None, None, "built", data[-1][5] + 120_000)]]:
        frame(c).write.mode("append").parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = W.drained(W.rebuild_plans(read, debounce_ms=100, most=5), str(tmp_path / "out"))
    want = []
    for s in "xyz":
        base = int(T0.replace(tzinfo=dt.UTC).timestamp() * 1000)
        want += [(s, *p[:5], p[5]) for p in run([(base + e[5], e[1], e[2], e[3], e[4]) for e in data if e[0] == s], most=5)]
    rows = [(r.session, r.mode, r.reason, list(r.paths), r.first_seq, r.last_seq, r.ms) for r in got.withColumn("ms", F.unix_millis("at")).collect()]
    key = lambda x: (x[0], x[-1], str(x))
    assert sorted(rows, key=key) == sorted(want, key=key) and len(want) > 10
    assert {r[2] for r in rows} >= {"changes_arrived_during_build", "watch_sequence_gap"}


def test_reconciliation(spark):
    a, b = (fingerprints(spark.createDataFrame(x, "path string, content string")) for x in ([("a", "1"), ("b", "2")], [("b", "3"), ("c", "4")]))
    assert [tuple(r) for r in W.reconciliation(a, b).collect()] == [("full_rescan", "periodic_reconciliation_changed", ["a", "b", "c"])]
    assert W.reconciliation(a, a).count() == 0


def test_query(spark, sf_dir):
    """watch_plans over the whole table against the fold of each session, up to the last watermark."""
    import __spark_entry__ as entry
    from lodestar.plans.domain import KIND_OF_EVENT

    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "user_id", "event_type", "unix_millis(cast(ts as timestamp)) as ms").collect()
    sessions = {}
    for r in rows:
        path = f"src/u{r.user_id}"
        kind = "built" if r.event_type == "error" else KIND_OF_EVENT[r.event_type]
        sessions.setdefault(str(r.user_id % 50), []).append((r.ms, r.event_id, path, f"{path}.old" if r.event_type == "purchase" else None, kind))
    last, want = max(r.ms for r in rows), []
    for s, events in sessions.items():
        own = W.Watch(3_600_000, gaps=False)
        found = [p for e in sorted(events) for p in own.add(*e)] + own.due(last)
        want += [(s, *p[:5], p[5]) for p in found]
    got = [(r.session, r.mode, r.reason, list(r.paths), r.first_seq, r.last_seq, r.ms) for r in entry.queries()["watch_plans"](spark, sf_dir).withColumn("ms", F.unix_millis("at")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and got
