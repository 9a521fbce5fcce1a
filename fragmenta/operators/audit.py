"""Audit of nodes: outcomes, reputation as an exponential mean, and what changed between two looks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ALPHA, FIRST_SCORE, THRESHOLD
from .placement import rendezvous_place
from .store import content_hash


def outcome(reachable: Column, known: Column, found_hash: Column, expected: Column, well_formed: Column = None) -> Column:
    """Pass, MissingShard, HashMismatch, Unreachable or ProtocolError."""
    out = F.when(~reachable, "Unreachable")
    if well_formed is not None:
        out = out.when(~well_formed, "ProtocolError")
    return out.when(~known, "MissingShard").when(found_hash != expected, "HashMismatch").otherwise("Pass")


def reputation(log: DataFrame, order: list[str], alpha: float = ALPHA, first: float = FIRST_SCORE) -> DataFrame:
    """(node, score, n) after all of a node's observations (node, success) in order.

    The mean's weights are powers of 1 - alpha by distance from the end, so it is a plain sum. Ranking sorts a node's log in
    one task, which spills, but nothing holds it whole.
    """
    w = Window.partitionBy("node").orderBy(*(F.desc(c) for c in order))
    aged = log.withColumn("age", F.row_number().over(w) - 1)
    weight = F.pow(F.lit(1 - alpha), F.col("age"))
    out = aged.groupBy("node").agg(F.sum(F.when(F.col("success"), alpha * weight).otherwise(0.0)).alias("s"), F.count("*").alias("n"))
    return out.select("node", (F.pow(F.lit(1 - alpha), F.col("n")) * first + F.col("s")).alias("score"), "n")


def scores_after(log: DataFrame, order: list[str], alpha: float = ALPHA, first: Column | float = FIRST_SCORE) -> DataFrame:
    """log with score_after, the running mean of each node; first may be a column, the same in all of a node's rows.

    Within a block of a node's log the mean is a running sum of growing weights. Blocks are so long that what lies before the last
    one weighs under 1e-60 and is left out, so that weights stay within doubles at any length of the log.
    """
    keep, i, b = 1 - alpha, "__turn", "__block"
    size = max(int(60 / -math.log10(keep)), 1) if 0 < keep < 1 else 1
    rows = log.withColumn(i, F.row_number().over(Window.partitionBy("node").orderBy(*order)))
    rows = rows.withColumns({b: F.floor((F.col(i) - 1) / size), i: F.pmod(F.col(i) - 1, F.lit(size)) + 1})
    start = first if isinstance(first, Column) else F.lit(float(first))
    inside = Window.partitionBy("node", b).orderBy(i)
    grown = F.sum(F.when(F.col("success"), alpha * F.pow(F.lit(keep), -F.col(i))).otherwise(0.0)).over(inside) * F.pow(F.lit(keep), F.col(i))
    rows = rows.withColumn("__own", grown).withColumn("__start", start)
    ends = rows.filter(F.col(i) == size).select("node", (F.col(b) + 1).alias(b), F.when(F.col(b) == 0, F.col("__own") + F.col("__start") * keep**size).otherwise(F.col("__own")).alias("__before"))
    out = rows.join(ends, ["node", b], "left")
    before = F.when(F.col(b) == 0, F.col("__start")).otherwise(F.col("__before"))
    return out.withColumn("score_after", F.col("__own") + F.pow(F.lit(keep), F.col(i)) * before).select(*log.columns, "score_after")


#: Hex digits of a hash by which objects are dealt to be counted off side by side, and of one that a draw takes (60 bits).
DEALT, DRAWN = 3, 15


def _drawn(seed: int | str, what: str) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("-", F.lit(str(seed)), F.col("draw").cast("string"), F.lit(what)), 256), 1, DRAWN), 16, 10).cast("long")


def samples(catalog: DataFrame, expected: DataFrame, n: int, seed: int | str) -> DataFrame:
    """(draw, path, object_id, channel, layer, idx, hash) of n draws, with replacement, from catalog (path, object_id, channels, nlayers).

    An object is drawn first, then a channel and a layer, then one of the hashes expected (object_id, channel, layer, idx, hash; idx from 0 without gaps) there;
    a draw that meets a layer without any is spent. Objects are numbered by shares of a hash of their path: only shares that were drawn from are put in order.
    Sizes of shares and the layers drawn, a row a draw at most, are collected at once, so that catalog is read twice and expected once.
    """
    dealt = catalog.select("path", "object_id", "channels", "nlayers").withColumn("part", F.substring(F.sha2("path", 256), 1, DEALT))
    w = Window.orderBy("part")  # at most 16 ** DEALT rows
    spark = catalog.sparkSession
    parts = spark.createDataFrame(dealt.groupBy("part").agg(F.count("*").alias("size")).collect(), "part string, size long").withColumns({"upto": F.sum("size").over(w), "total": F.sum("size").over(Window.partitionBy())})
    draws = spark.range(n).withColumnRenamed("id", "draw")
    total = parts.select("total").limit(1)
    draws = draws.crossJoin(F.broadcast(total)).withColumn("at", F.pmod(_drawn(seed, "object"), F.col("total")))
    spot = draws.join(F.broadcast(parts.select("part", "size", "upto")), (F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("size")))
    spot = spot.select("draw", "part", (F.col("at") - F.col("upto") + F.col("size") + 1).alias("turn"))
    ranked = dealt.join(F.broadcast(spot.select("part").distinct()), "part", "left_semi").withColumn("turn", F.row_number().over(Window.partitionBy("part").orderBy("path")))
    found = spot.join(ranked, ["part", "turn"]).filter("channels > 0 and nlayers > 0")
    found = found.withColumns({"channel": F.pmod(_drawn(seed, "channel"), F.col("channels")).cast("int"), "layer": F.pmod(_drawn(seed, "layer"), F.col("nlayers")).cast("int")})
    key = ["object_id", "channel", "layer"]
    types = "draw long, path string, object_id long, channel int, layer int"
    found = spark.createDataFrame(found.select("draw", "path", *key).collect(), types)
    held = expected.select(*key, "idx", "hash").join(F.broadcast(found.select(*key).distinct()), key, "left_semi")
    held = held.withColumns({"idx": F.col("idx").cast("long"), "n": F.count("*").over(Window.partitionBy(*key))})
    out = held.join(F.broadcast(found), key).filter(F.col("idx") == F.pmod(_drawn(seed, "hash"), F.col("n")))
    return out.select("draw", "path", *key, "idx", "hash")


def tick(drawn: DataFrame, nodes: DataFrame, shards: DataFrame, scores: DataFrame, threshold: float = THRESHOLD, alpha: float = ALPHA, first: float = FIRST_SCORE) -> DataFrame:
    """drawn (see samples) with node, outcome, score_after and low_score.

    The node is the one that placement over all nodes (node, admin_killed) names; it passes if it holds (node, object_id, channel, layer, hash, payload) a fragment
    under the hash whose content has it. Scores go on from scores (node, score), in the order of draws.
    """
    key = ["node", "object_id", "channel", "layer", "hash"]
    asked = rendezvous_place(drawn, nodes).join(nodes.select("node", "admin_killed"), "node")
    held = shards.join(F.broadcast(asked.select(*key).distinct()), key, "left_semi").groupBy(*key).agg(F.min(content_hash(F.col("payload"))).alias("content"))
    seen = asked.join(held, key, "left")
    seen = seen.withColumn("outcome", outcome(~F.col("admin_killed"), F.col("content").isNotNull(), F.col("content"), F.col("hash")))
    seen = seen.withColumn("success", F.col("outcome") == "Pass").join(scores.select("node", F.col("score").alias("first")), "node", "left")
    seen = scores_after(seen.withColumn("first", F.coalesce("first", F.lit(first))), ["draw"], alpha, F.col("first"))
    return seen.select(*drawn.columns, "node", "outcome", "score_after", (F.col("score_after") < threshold).alias("low_score"))


def updated(scores: DataFrame, events: DataFrame) -> DataFrame:
    """(node, score) after a tick's events."""
    last = events.groupBy("node").agg(F.max_by("score_after", "draw").alias("score"))
    return scores.select("node", "score").join(last.select("node"), "node", "left_anti").unionByName(last)


def live_by_reputation(live: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """Live nodes whose score reaches the threshold; an unknown node scores 0."""
    return live.join(scores.select("node", "score"), "node", "left").filter(F.coalesce("score", F.lit(0.0)) >= threshold).drop("score")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(node, change) between two sets of live nodes: revived or died."""
    back = after.join(before, "node", "left_anti").select("node", F.lit("revived").alias("change"))
    gone = before.join(after, "node", "left_anti").select("node", F.lit("died").alias("change"))
    return back.unionByName(gone)


def changes_by_tick(ticks: DataFrame) -> DataFrame:
    """(tick, node, change) from (tick, node, live): each look against the one before; the first tells nothing."""
    w = Window.partitionBy("node").orderBy("tick")
    seen = ticks.withColumn("was", F.lag("live").over(w)).filter("was is not null and was <> live")
    return seen.select("tick", "node", F.when(F.col("live"), "revived").otherwise("died").alias("change"))
