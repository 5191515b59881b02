import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from quarry.plans import logic
from quarry.sources import documents
from quarry.streaming import machine, progress, watching

MESSAGES = ["open", "load", "loaded", "change", "fail", "close", "noise", None]
START = datetime.datetime(2024, 1, 1)
SCHEMA = "key string, message string, ts timestamp, seq long"


def messages(n, keys, seed):
    r = random.Random(seed)
    return [(r.choice(keys), r.choice(MESSAGES), START + datetime.timedelta(seconds=i // 2), i) for i in range(n)]


def folded(rows):
    """Brute force: the steps of each key in order."""
    state, steps = {}, []
    for key, message, ts, seq in sorted(rows, key=lambda x: (x[2], x[3])):
        before = state.get(key, machine.PROJECT.start)
        after, commands = machine.PROJECT.update(message, before)
        state[key] = after
        steps.append((key, seq, message, before, after, json.dumps(commands)))
    return state, steps


def test_machine():
    m = machine.PROJECT
    assert m.update("open", "Unloaded") == ("Loading", ("read-config", "load")) and m.update("open", "Ready") == ("Ready", ())
    assert m.subscriptions("Ready") == ["change", "close"] and m.change("noise") == tuple(range(len(m.states)))


def test_final_states_of_a_hot_key(spark):
    rows = messages(3000, ["hot"] * 8 + ["a", "b", "c"], 1) + [(None, "open", START, 1), ("lone", None, None, None)]
    got = {r["key"]: (r["state"], r["n"]) for r in machine.final_states(spark.createDataFrame(rows, SCHEMA).repartition(5), machine.PROJECT).collect()}
    want, steps = folded([r for r in rows if r[0] and r[2]])
    assert got == {k: (s, sum(x[0] == k for x in steps)) for k, s in want.items()} | {"lone": ("Unloaded", 1)}
    assert machine.final_states(spark.createDataFrame([], SCHEMA), machine.PROJECT).count() == 0


def test_stream_equals_the_fold_over_shuffled_batches_and_restarts(spark, tmp_path):
    rows = messages(400, ["a", "b", "c"], 2)
    shuffled = [rows[i : i + 100] for i in range(0, 400, 100)]
    for part in shuffled:  # out of order within what may be late
        random.Random(3).shuffle(part)
    last = [("end", "open", START + datetime.timedelta(hours=2), 9_999)]

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = machine.transitions(stream, machine.PROJECT, late="10 minutes")
        q = machine.started(out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True), spark)
        q.awaitTermination()

    put = lambda i, part: spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    (tmp_path / "in").mkdir()

    def add(i, part):
        put(f"../parts/{i}", part)
        for f in (tmp_path / f"parts/{i}").glob("*.parquet"):
            f.rename(tmp_path / f"in/{i}-{f.name}")

    for i, part in enumerate(shuffled[:2]):
        add(i, part)
    run()
    for i, part in enumerate([*shuffled[2:], last], 2):  # state comes back from the checkpoint
        add(i, part)
    run()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("key", "seq", "message", "before", "after", "commands").collect())
    assert [(k, n, m or "", b, a, c) for k, n, m, b, a, c in got] == sorted((k, n, m or "", b, a, c) for k, n, m, b, a, c in folded(rows)[1])


def test_idle_keys_expire(spark, tmp_path):
    rows = [("a", "open", START, 1), ("b", "open", START + datetime.timedelta(hours=3), 2), ("c", "open", START + datetime.timedelta(hours=9), 3)]
    (tmp_path / "in").mkdir()
    for i, row in enumerate(rows):
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        for f in (tmp_path / f"p{i}").glob("*.parquet"):
            f.rename(tmp_path / f"in/{i}.parquet")
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        out = machine.transitions(stream, machine.PROJECT, late="1 minute", idle_ms=3_600_000)
        machine.started(out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True), spark).awaitTermination()
    got = sorted((r["key"], r["message"], r["before"], r["after"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert ("a", "expired", "Loading", "Unloaded") in got and ("a", "open", "Unloaded", "Loading") in got and not any(k == "c" for k, *_ in got)


EVENTS = "event_type string, path string, new_path string, ts timestamp"


def event(kind, path, ms, new=None):
    return (kind, path, new, START + datetime.timedelta(milliseconds=ms))


def test_bursts_become_one_event(spark):
    rows = [event("created", "a", 0), event("modified", "a", 50), event("modified", "a", 50), event("modified", "a", 500), event("deleted", "a", 560), event("renamed", "b", 0, "c"), event("odd", "d", 0),
        event("modified", None, 0), ("modified", "e", None, None), event("modified", "x.bak", 0)]
    got = sorted((r["path"], r["kind"], r["n"]) for r in watching.settled(spark.createDataFrame(rows, EVENTS), ignore=["*.bak"]).collect())
    assert got == [("a", "deleted", 2), ("a", "modified", 2), ("b", "deleted", 1), ("c", "modified", 1)]


def test_watching_decodes_what_changed(spark, tmp_path):
    root, events = tmp_path / "docs", tmp_path / "events"
    root.mkdir(), events.mkdir()
    text = lambda *names: json.dumps(logic.document(names))
    (root / "a.json").write_text(text("fee", "zone"))
    (root / "b.json").write_text(text("zone"))
    store = watching.Store(spark, f"file://{root}", f"file://{tmp_path / 'store'}")

    def say(i, *rows):
        (events / f"{i}.json").write_text("\n".join(json.dumps({"event_type": k, "path": p, "new_path": n, "ts": ts.isoformat()}) for k, p, n, ts in rows))
        stream = spark.readStream.schema(EVENTS).json(f"file://{events}")
        watching.watch(watching.settled(stream, late="10 seconds"), store, f"file://{tmp_path / 'c'}").trigger(availableNow=True).start().awaitTermination()

    say(0, event("created", "a.json", 0), event("created", "b.json", 10), event("created", "b.json", 10), event("created", "z.json", 20_000))
    now = lambda: sorted((r["path"], r["name"]) for r in store.current().where("family = 'value'").select("path", "name").collect())
    assert now() == [("a.json", "fee"), ("a.json", "zone"), ("b.json", "zone")]
    (root / "a.json").write_text(text("spread"))
    # b is touched, not changed; an event far too late is dropped; z, which never was there, is settled now.
    say(1, event("modified", "a.json", 40_000), event("modified", "b.json", 40_000), event("deleted", "b.json", 1_000), event("created", "y.json", 80_000))
    assert now() == [("a.json", "spread"), ("b.json", "zone")]
    written = [sorted({r["path"] for r in spark.read.parquet(f"file://{d}").collect()}) for d in sorted((tmp_path / "store").glob("refresh=*"), key=lambda d: int(d.name[8:]))]
    assert written[0] == ["a.json", "b.json"] and written[-1] == ["a.json"], "b was not decoded again"
    (root / "b.json").unlink()
    say(2, event("deleted", "b.json", 100_000), event("created", "x.json", 200_000))
    assert now() == [("a.json", "spread")]
    number = 1 + max(int(d.name[8:]) for d in (tmp_path / "store").glob("refresh=*"))
    store.compact(number)
    assert now() == [("a.json", "spread")] and [d.name for d in (tmp_path / "store").glob("*e*")] == [f"refresh={number}"]


def test_progress_of_batches_and_streams(spark, tmp_path):
    found = spark.createDataFrame([("a", json.dumps(logic.document())), ("b", "{")], "path string, content string")
    rows, watch = progress.observed(documents.definitions(documents.documents(found)), "decode", progress.decoding_metrics())
    n = rows.where("error IS NULL").count()
    first, second = (json.loads(r["line"]) for r in progress.result_lines(spark, watch, "decoded").orderBy("ord").collect())
    assert first == {"type": "progress", "message": "decoded", "definitions": n, "errors": 1, "modules": 1} and second == {"type": "result", "success": False}

    said = progress.ProgressLines(spark, f"file://{tmp_path / 'said'}")
    spark.streams.addListener(said)
    try:
        (tmp_path / "in").mkdir()
        (tmp_path / "in/a.json").write_text("{}\n{}\n")
        stream = spark.readStream.schema("x string").json(str(tmp_path / "in")).observe("seen", F.count("*").alias("n"))
        stream.writeStream.format("noop").queryName("told").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        import time

        for _ in range(100):
            if any('"result"' in x for x in said.lines):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(said)
    lines = spark.read.json(f"file://{tmp_path / 'said'}").collect()
    assert sorted(r["type"] for r in lines) == ["progress", "progress", "result"]
    assert next(r for r in lines if r["rows"] == 2)["metrics"]["seen"]["n"] == 2


@pytest.mark.parametrize("late", ["1 hour"])
def test_rows_without_key_or_time_take_no_part(spark, tmp_path, late):
    spark.createDataFrame([(None, "open", START, 1), ("a", "open", None, 1)], SCHEMA).write.parquet(str(tmp_path / "in"))
    out = machine.transitions(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), machine.PROJECT, late=late)
    machine.started(out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True), spark).awaitTermination()
    assert spark.read.schema("key string").parquet(str(tmp_path / "out")).count() == 0
