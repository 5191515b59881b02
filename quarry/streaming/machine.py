"""Keyed state machines: the same table of steps folds a batch of messages and keeps state over a stream of them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Machine:
    """``steps[state][message]`` is the next state and the commands that the step gives; a message without a step changes nothing.

    ``start`` is every key's first state. A machine is configuration: a few states, sent to every task.
    """

    start: str
    steps: dict[str, dict[str, tuple[str, tuple[str, ...]]]]

    @property
    def states(self) -> list[str]:
        told = {self.start, *self.steps, *(to for by in self.steps.values() for to, _ in by.values())}
        return sorted(told)

    def update(self, message: str, state: str) -> tuple[str, tuple[str, ...]]:
        return self.steps.get(state, {}).get(message, (state, ()))

    def subscriptions(self, state: str) -> list[str]:
        """Messages that change something in a state."""
        return sorted(self.steps.get(state, {}))

    def change(self, message: str) -> tuple[int, ...]:
        """A message as a function: the number of the next state for the number of each state."""
        at = {s: i for i, s in enumerate(self.states)}
        return tuple(at[self.update(message, s)[0]] for s in self.states)


def final_states(messages: DataFrame, machine: Machine) -> DataFrame:
    """``(key, state, n)`` of ``messages(key, message, ts, seq)`` after all of a key's messages, by ts, then seq; n is their number.

    Messages are functions from states to states, and composing those is associative: messages are dealt by ranges of
    (key, ts, seq), each task composes its stretch of a key into one function, and a key's few functions are composed in
    order. So a key with a third of all messages is as many stretches as it fills partitions. Null messages change
    nothing but count; rows without key are left out; rows that tie in ts and seq count each, their order is by message.
    """
    rows = messages.where("key IS NOT NULL").select("key", "message", "ts", "seq")
    order = ["key", "ts", "seq", "message"]
    kind = rows.schema["key"].dataType.simpleString()
    same = tuple(range(len(machine.states)))

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {m: machine.change(m) for by in machine.steps.values() for m in by}
        now, first, f, n, at = None, 0, same, 0, 0
        out: list[tuple] = []
        key_type = None
        for b in batches:
            key_type = b.schema.field(0).type
            for key, message in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        out.append((now, first, list(f), n))
                    now, first, f, n = key, at, same, 0
                g = known.get(message)
                f = f if g is None else tuple(g[s] for s in f)
                n += 1
                at += 1
        if now is not None:
            out.append((now, first, list(f), n))
        if key_type is not None:
            keys, places, functions, counts = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(places, pa.int64()), pa.array(functions, pa.list_(pa.int32())), pa.array(counts, pa.int64())], names=["key", "at", "f", "n"])

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = dealt.mapInArrow(compose, f"key {kind}, at long, f array<int>, n long").withColumn("task", F.spark_partition_id())
    listed = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("task", "at", "f"))).alias("parts"), F.sum("n").alias("n"))
    start, names = machine.states.index(machine.start), F.array(*map(F.lit, machine.states))
    state = F.aggregate("parts", F.lit(start), lambda s, p: F.get(p["f"], s))
    return listed.select("key", F.get(names, state).alias("state"), "n")


#: Messages that one element of a key's pending list holds.
BLOCK = 4096


def blocks(rows: list[tuple]) -> list[tuple[str]]:
    """Messages (at, seq, message) as elements of a pending list, as JSON."""
    return [(json.dumps(rows[at : at + BLOCK]),) for at in range(0, len(rows), BLOCK)]


class Fold(StatefulProcessor):
    """Keeps a key's state, and its messages until the watermark passed them, so that they are taken in the order of time.

    State: ``model`` (the state and the last time taken), ``pending`` (messages not yet taken, in blocks of ``BLOCK``, as each
    element of a list costs a way to the state store). A timer stands at the time
    of the first pending message; when the watermark passes it, all that it passed are taken by time, then seq. A key
    whose last message lies ``idle_ms`` behind the watermark is forgotten, which gives a last row with message ``expired``.
    """

    def __init__(self, machine: Machine, idle_ms: int) -> None:
        self.machine, self.idle_ms = machine, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.model = handle.getValueState("model", "state string, last long")
        self.pending = handle.getListState("pending", "block string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = [r for part in rows for r in zip(part["at"].tolist(), part["seq"].tolist(), part["message"].astype(object).where(part["message"].notna(), None).tolist(), strict=True)]
        if found:  # what was pending before has its own timer
            self.pending.appendList(blocks(found))
            self.handle.registerTimer(int(min(r[0] for r in found)) + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        state, last = self.model.get() if self.model.exists() else (self.machine.start, 0)
        waiting = [tuple(r) for held in self.pending.get() for r in json.loads(held[0])] if self.pending.exists() else []
        due = sorted((r for r in waiting if r[0] < passed), key=lambda r: (r[0], r[1], r[2] or ""))
        out, said = [], {}
        for at, seq, message in due:
            before, (state, commands) = state, self.machine.update(message, state)
            if commands not in said:
                said[commands] = json.dumps(commands)
            out.append((key[0], at, seq, message, before, state, said[commands]))
            last = at
        if due:
            later = [r for r in waiting if r[0] >= passed]
            if later:
                self.pending.put(blocks(later))
                self.handle.registerTimer(min(r[0] for r in later) + 1)
            else:
                self.pending.clear()
            self.model.update((state, last))
            self.handle.registerTimer(last + self.idle_ms)
        elif not waiting and self.model.exists() and last + self.idle_ms <= passed:
            out.append((key[0], last + self.idle_ms, None, "expired", state, self.machine.start, "[]"))
            self.model.clear()
        columns = ["key", "at", "seq", "message", "before", "after", "commands"]
        yield pd.DataFrame(out, columns=columns).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def transitions(messages: DataFrame, machine: Machine, late: str = "1 hour", idle_ms: int = 365 * 86_400_000) -> DataFrame:
    """Streaming ``(key, at, seq, message, before, after, commands)``: each step of each key, once, in the order of time.

    ``messages(key, message, ts timestamp, seq)`` may come in any order up to ``late`` behind the newest; what is later
    is dropped by the watermark, as ever. A step is given when the watermark passed it; at is the message's time in
    milliseconds, commands a JSON list. State lives in RocksDB (``started`` sets that) and survives restarts by the
    query's checkpoint. Rows without key or time are left out.
    """
    kind = messages.schema["key"].dataType.simpleString()
    rows = messages.where("key IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    rows = rows.select("key", "message", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), "ts", F.unix_millis("ts").alias("at"))
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Fold(machine, idle_ms), outputStructType=f"key {kind}, at long, seq long, message string, before string, after string, commands string", outputMode="Append", timeMode="EventTime")


def started(writer, spark):
    """Start a stream's writer with the state store that keyed state needs; the session's own setting stays as it was."""
    was = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return writer.start()
    finally:
        spark.conf.set(PROVIDER, was) if was else spark.conf.unset(PROVIDER)


#: Projects as a machine: what each message does in each state, and what is to be done then.
PROJECT = Machine("Unloaded", {
    "Unloaded": {"open": ("Loading", ("read-config", "load"))},
    "Loading": {"loaded": ("Ready", ("notify",)), "fail": ("Error", ("notify",)), "close": ("Unloaded", ("drop",))},
    "Ready": {"change": ("Stale", ("notify",)), "close": ("Unloaded", ("drop",))},
    "Stale": {"load": ("Loading", ("load",)), "close": ("Unloaded", ("drop",))},
    "Error": {"load": ("Loading", ("load",)), "close": ("Unloaded", ("drop",)), "change": ("Stale", ())},
})
