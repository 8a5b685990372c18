"""Replay of call logs in the order of their event time, whatever order they arrive in: a stateful operator with keyed state, timers and a watermark."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from ..operators.replay import Tools, canonical

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SNAPSHOT = "episode long, seq long, snapshot_id long, success boolean, result string, state string"


@contextmanager
def _conf(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Fold(StatefulProcessor):
    """Events of an episode wait in a list until the watermark passes them; a timer then applies those due, by (time, seq).

    The list is read and written as a whole, and a timer is set for the first event that waits, so an episode asks the state
    store as often a batch, whatever its events. An event that is delivered twice while it waits is one event. State: the episode's state as JSON and the number of its snapshots."""

    def __init__(self, tools: Tools, initial: str):
        self.tools, self.initial = tools, initial

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state string, snapshots long")
        self.waiting = handle.getListState("waiting", "us long, seq long, tool string, args string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r.us, r.seq, r.tool, r.args) for r in rows]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(us for us, *_ in new) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        import json

        mark = timerValues.getCurrentWatermarkInMs()
        held = {(us, seq): (tool, args) for us, seq, tool, args in self.waiting.get()} if self.waiting.exists() else {}
        # one expired timer applies all that is due, so the others of the batch find nothing
        due = sorted(k for k in held if k[0] // 1000 < mark)
        if not due:
            return
        todo = {k: held.pop(k) for k in due}
        if held:
            self.waiting.put([(*k, *v) for k, v in held.items()])
            self.handle.registerTimer(min(held)[0] // 1000 + 1)
        else:
            self.waiting.clear()
        text, n = self.state.get() if self.state.exists() else (self.initial, 0)
        state = json.loads(text)
        for (_, seq), (tool, args) in todo.items():
            ok, result, state = self.tools.run(tool, state, json.loads(args) if args else {})
            n += 1
            yield Row(episode=key[0], seq=seq, snapshot_id=n, success=ok, result=result if isinstance(result, str) else canonical(result), state=canonical(state))
        self.state.update((canonical(state), n))

    def close(self) -> None:
        pass


def replayed(events: DataFrame, tools: Tools, initial: dict, delay: str) -> DataFrame:
    """A stream of SNAPSHOT rows of the stream events(episode, seq, ts, tool, args): each event applied once, by (ts, seq), when the
    watermark has passed it. Events that arrive later than ``delay`` behind the latest are left out, see ``left_out``."""
    e = events.withWatermark("ts", delay).select("episode", "seq", "ts", F.unix_micros("ts").alias("us"), "tool", "args").where("episode is not null and ts is not null and seq is not null")
    return e.groupBy("episode").transformWithState(Fold(tools, canonical(initial)), SNAPSHOT, "Append", "EventTime")


def run_available(spark: SparkSession, source: str, schema: str, tools: Tools, initial: dict, folder: str, delay: str) -> DataFrame:
    """All snapshots under ``folder``/out after what lies in ``source`` now has gone by. Started again, it goes on from its checkpoint."""
    with _conf(spark, "spark.sql.streaming.stateStore.providerClass", PROVIDER):
        q = replayed(spark.readStream.schema(schema).parquet(source), tools, initial, delay).writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(SNAPSHOT).parquet(f"{folder}/out")


def left_out(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(episode, seq) of events that no snapshot holds: late ones, and those the watermark hasn't passed yet."""
    return events.select("episode", "seq").distinct().join(snapshots.select("episode", "seq"), ["episode", "seq"], "left_anti")


def windowed(events: DataFrame, width: str, delay: str) -> DataFrame:
    """A stream of (start_us, tool, n, units) of the stream events(ts, tool, units): a window is given once, when the watermark has passed its end."""
    r = events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "tool").agg(F.count("*").alias("n"), F.sum("units").alias("units"))
    return r.select(F.unix_micros("w.start").alias("start_us"), "tool", "n", "units")


def run_windows(spark: SparkSession, source: str, schema: str, folder: str, width: str, delay: str) -> DataFrame:
    """All closed windows under ``folder``/out after what lies in ``source`` now has gone by."""
    q = windowed(spark.readStream.schema(schema).parquet(source), width, delay).writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("start_us long, tool string, n long, units long").parquet(f"{folder}/out")
