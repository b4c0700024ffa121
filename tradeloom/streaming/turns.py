"""The turns of a run as a stream of events: state by entity and metric, in a state store, turned by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.simulate import _TOTALS, _edges, _pairs, _shocks, changes, propagate, totals
from ..plans.registry import query
from ..plans.storage import scratch, written

EVENT = "branch int, entity string, metric string, turn int, value double, change double, at timestamp"
STATE = "branch int, turn int, entity string, metric string, value double, affected boolean"
#: Milliseconds of a turn; turn n is over at n of them after 1970.
TURN = 3_600_000


class Turns(StatefulProcessor):
    """The values of one entity's metric, turn by turn.

    A baseline event (with ``value``) begins it and sets a timer at the end of each of its turns; change events wait for their turn. When the watermark passes a turn's end, all that
    belongs to it is there: the turn's value is given out, the baseline times 1 + the last change. After its last turn the state is dropped. State is two rows and one for each waiting change.
    """

    def __init__(self, turns: int):
        self.turns = turns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "value double, change double, next int")
        self.waiting = handle.getMapState("waiting", "turn int", "change double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for events in rows:
            for turn, value, change in zip(events["turn"].tolist(), events["value"].tolist(), events["change"].tolist()):
                if not pd.isna(value) and not self.held.exists():
                    self.held.update((value, None, 1))
                    for t in range(1, self.turns + 1):
                        self.handle.registerTimer(t * TURN)
                if not pd.isna(change):
                    self.waiting.updateValue((int(turn),), (change,))
        yield pd.DataFrame(columns=["branch", "turn", "entity", "metric", "value", "affected"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = []
        if self.held.exists():
            value, change, turn = self.held.get()
            while turn * TURN <= expiredTimerInfo.getExpiryTimeInMs():  # turns are taken in order, whichever timer comes first
                affected = self.waiting.containsKey((turn,))
                if affected:
                    change = self.waiting.getValue((turn,))[0]
                    self.waiting.removeKey((turn,))
                rows.append((key[0], turn, key[1], key[2], value if change is None else max(0.0, value * (1 + change)), affected))
                turn += 1
            if turn > self.turns:
                self.held.clear()
                self.waiting.clear()
            else:
                self.held.update((value, change, turn))
        yield pd.DataFrame(rows, columns=["branch", "turn", "entity", "metric", "value", "affected"])

    def close(self) -> None:
        pass


def turn_states(events: DataFrame, turns: int) -> DataFrame:
    """``branch``, ``turn``, ``entity``, ``metric``, ``value``, ``affected`` as a stream of a stream of events; a change that comes after its turn is over changes nothing. An event of a
    later turn moves the watermark. The session must keep state in RocksDB (see ``stream_session``)."""
    keyed = events.withWatermark("at", "0 seconds").groupBy("branch", "entity", "metric")
    return keyed.transformWithStateInPandas(Turns(turns), outputStructType=STATE, outputMode="Append", timeMode="EventTime")


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of its own with the state store that timers need; the caller's session stays as it is."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


def run_turns(spark: SparkSession, folder: str, target: str, checkpoint: str, turns: int):
    """Read the folder's new events, give out the turns that are over, and stop. Started again with the same checkpoint, it goes on where it stopped."""
    events = stream_session(spark).readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(folder)
    return turn_states(events, turns).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def turn_events(nodes: DataFrame, changed: DataFrame, turns: int) -> DataFrame:
    """Events of baselines (``branch``, ``entity``, ``metric``, ``value``), of changes (``branch``, ``turn``, ``entity``, ``metric``, ``change``), and one after the last turn that ends it."""
    within = lambda turn, share: F.timestamp_millis(((turn - 1 + share) * TURN).cast("long")).alias("at")
    none = lambda name: F.lit(None).cast("double").alias(name)
    first = nodes.select("branch", "entity", "metric", F.lit(1).alias("turn"), "value", none("change"), within(F.lit(1), 0.25))
    later = changed.select("branch", "entity", "metric", "turn", none("value"), "change", within(F.col("turn"), 0.5))
    end = nodes.sparkSession.range(1).select(F.lit(0).alias("branch"), F.lit("").alias("entity"), F.lit("").alias("metric"), F.lit(turns + 1).alias("turn"), none("value"), none("change"), within(F.lit(turns + 1), 0.5))
    return first.unionByName(later).unionByName(end).select(*(c.split()[0] for c in EVENT.split(", ")))


@query(_TOTALS)
def stream_turn_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of three turns, the second of them shocked, as a stream that is stopped after the first turn's events and goes on from its checkpoint."""
    pairs = _pairs(spark, sf_dir)
    s = _shocks(spark, turn=2)
    ch = written(changes(propagate(_edges(pairs), s, 2), s), "changes")
    side = lambda c, m: pairs.groupBy(F.col(c).alias("entity")).agg((F.sum("cents") / F.lit(100.0)).alias("value")).select(F.lit(1).alias("branch"), F.col("entity").cast("string").alias("entity"), F.lit(m).alias("metric"), "value")
    nodes = side("src", "SUPPLY").unionByName(side("dst", "DEMAND"))
    events = written(turn_events(nodes, ch.select("branch", F.col("entity").cast("string").alias("entity"), "metric", "turn", "change"), 3), "turn-events")
    folder, target, checkpoint = (scratch(spark, f"turns-{x}") for x in ("in", "out", "checkpoint"))
    for some in ("turn = 1", "turn = 2", "turn > 2"):
        events.where(some).coalesce(1).write.mode("append").parquet(folder)
        if some != "turn = 2":
            run_turns(spark, folder, target, checkpoint, 3).awaitTermination()
    state = spark.read.schema(STATE).parquet(target)
    return totals(state, ch).select("turn", F.round("supply", 0).alias("supply"), F.round("demand", 0).alias("demand"), "affected")
