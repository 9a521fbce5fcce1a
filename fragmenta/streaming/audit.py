"""Audit and monitoring as streams: node reputation as keyed state, liveness and audits by micro-batch, snapshots.

The model works in processing time. Writes are idempotent by key, so a batch that is tried again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import audit, health, reports
from ..schema import ALPHA, FIRST_SCORE, THRESHOLD
from ..sources import tables


def scores(log: DataFrame, alpha: float = ALPHA, first: float = FIRST_SCORE) -> DataFrame:
    """(node, score, n) of nodes that a batch of (seq, node, success) tells of; a node's state never expires."""

    def update(key, frames, state: GroupState):
        score, n = state.get if state.exists else (first, 0)
        rows = pd.concat(list(frames))
        for ok in rows.sort_values("seq")["success"]:
            score, n = alpha * float(ok) + (1 - alpha) * score, n + 1
        state.update((float(score), n))
        yield pd.DataFrame({"node": [key[0]], "score": [float(score)], "n": [n]})

    return log.select("seq", "node", "success").groupBy("node").applyInPandasWithState(update, "node long, score double, n long", "score double, n long", "update", GroupStateTimeout.NoTimeout)


def windowed(log: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Observations and failures by window of event time; an extension, as the model itself has no event time."""
    counts = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size))
    return counts.agg(F.count("*").alias("n"), F.count_if(~F.col("success")).alias("n_failed")).select(F.col("window.start").alias("begin"), "n", "n_failed")


class Monitor:
    """What one look after the other tells: who came back or died, which layers run low.

    State is the set of live nodes of the look before, kept as a table under `state`.
    """

    def __init__(self, spark: SparkSession, state: str, stats: DataFrame, threshold: int = 0):
        self.spark, self.state, self.stats, self.threshold = spark, state, stats, threshold
        self.last: int | None = None

    def tick(self, live: DataFrame, number: int) -> DataFrame:
        """(event, node, object_id, channel, layer, margin) of look `number`; the first one tells only of low margins."""
        now = live.select("node").distinct()
        now.write.mode("overwrite").parquet(f"{self.state}/live-{number}")
        now = self.spark.read.parquet(f"{self.state}/live-{number}")
        low = self.stats.filter(F.col("margin") <= self.threshold).select(F.lit("low_margin").alias("event"), F.lit(None).cast("int").alias("node"), "object_id", "channel", "layer", "margin")
        if self.last is not None:
            changed = audit.changes(self.spark.read.parquet(f"{self.state}/live-{self.last}"), now)
            none = [F.lit(None).cast(low.schema[c].dataType).alias(c) for c in ("object_id", "channel", "layer", "margin")]
            low = changed.select(F.col("change").alias("event"), F.col("node").cast("int").alias("node"), *none).unionByName(low)
        self.last = number
        return low

    def start(self, pings: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Looks at a stream of (node, ping_ok), one micro-batch each, and appends events; each batch has a folder of its own, so trying again replaces it."""

        def look(batch: DataFrame, number: int) -> None:
            self.tick(batch.filter("ping_ok"), number).write.mode("overwrite").parquet(f"{out}/tick={number}")

        writer = pings.writeStream.foreachBatch(look).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def monitor(spark: SparkSession, state: str, grid: DataFrame, alive: DataFrame, threshold: int = 0) -> Monitor:
    return Monitor(spark, state, health.layer_statistics(grid, alive), threshold)


def _by_batch(ticks: DataFrame, look: Callable[[int], None], checkpoint: str, every: str | None) -> StreamingQuery:
    writer = ticks.writeStream.foreachBatch(lambda _, number: look(number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class Auditor:
    """Tick after tick: fragments drawn at random are asked for, and the scores of their nodes go on.

    Events and scores of each tick have folders of their own under `state`, so that a tick that is tried again starts where it did.
    """

    def __init__(self, spark: SparkSession, state: str, catalog: DataFrame, expected: DataFrame, nodes: DataFrame, shards: DataFrame, samples: int = 16, seed: int = 1, threshold: float = THRESHOLD):
        self.spark, self.state, self.tables, self.samples, self.seed, self.threshold = spark, state, (catalog, expected, nodes, shards), samples, seed, threshold

    def scores(self, number: int) -> DataFrame:
        """(node, score) after a tick; none before the first."""
        return tables.read_or_empty(self.spark, f"{self.state}/scores-{number}", "node int, score double")

    def tick(self, number: int) -> DataFrame:
        """Events of a tick, see audit.tick."""
        catalog, expected, nodes, shards = self.tables
        before, at = self.scores(number - 1), f"{self.state}/events/tick={number}"
        drawn = audit.samples(catalog, expected, self.samples, f"{self.seed}-{number}")
        audit.tick(drawn, nodes, shards, before, self.threshold).write.mode("overwrite").parquet(at)
        events = self.spark.read.parquet(at)
        audit.updated(before, events).write.mode("overwrite").parquet(f"{self.state}/scores-{number}")
        return events

    def start(self, ticks: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """A tick per micro-batch of any stream, such as Spark's rate source."""
        return _by_batch(ticks, self.tick, checkpoint, every)


def snapshots(ticks: DataFrame, look: Callable[[], DataFrame], out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """What look gives at each micro-batch, such as catalog.statistics, as JSON lines in a folder per tick."""
    return _by_batch(ticks, lambda number: reports.as_json(look()).write.mode("overwrite").text(f"{out}/tick={number}"), checkpoint, every)
