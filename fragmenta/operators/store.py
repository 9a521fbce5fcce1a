"""Fragments at rest (node, object_id, channel, layer, hash, payload): look-ups, deletion, gathering of layers, payloads by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["object_id", "channel", "layer"]


def get(shards: DataFrame, object_id: int, channel: int, layer: int) -> DataFrame:
    """All fragments of one layer, in no order."""
    return shards.filter((F.col("object_id") == object_id) & (F.col("channel") == channel) & (F.col("layer") == layer))


def by_hash(shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (object_id, channel, layer, hash, ..) with node and payload of the fragment that has this hash, that of the smallest node; nulls without one."""
    key = [*KEY, "hash"]
    held = shards.join(wanted.select(*key).distinct(), key, "left_semi")
    one = held.groupBy(*key).agg(F.min(F.struct("node", "payload")).alias("at"))
    return wanted.join(one, key, "left").select(wanted.columns + [F.col("at.node").alias("node"), F.col("at.payload").alias("payload")])


def purged(shards: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left without the objects' fragments, and (object_id, n) of those that go, 0 for an object that has none."""
    gone = objects.select("object_id").distinct()
    counts = shards.groupBy("object_id").agg(F.count("*").alias("n"))
    return shards.join(gone, "object_id", "left_anti").select(shards.columns), gone.join(counts, "object_id", "left").fillna(0, ["n"])


def wiped(shards: DataFrame, node: int) -> DataFrame:
    return shards.filter(F.col("node") != node)


def gather(shards: DataFrame, live: DataFrame) -> DataFrame:
    """Fragments on live nodes."""
    return shards.join(live.select("node"), "node", "left_semi").select(shards.columns)


def content_hash(payload: Column) -> Column:
    return F.sha2(payload, 256)


def payloads(places: DataFrame, expected: DataFrame, shards: DataFrame) -> DataFrame:
    """places (object_id, channel, layer, idx) with hash, state, node and payload: BadRequest where nothing is planned, else found or lost."""
    planned = places.join(expected.select(*KEY, "idx", "hash"), [*KEY, "idx"], "left")
    found = by_hash(shards, planned)
    state = F.when(F.col("hash").isNull(), "BadRequest").when(F.col("payload").isNull(), "lost").otherwise("found")
    return found.withColumn("state", state)


def zoomed(found: DataFrame, size: int = 64) -> DataFrame:
    """found with size_bytes, and preview: the first bytes of the payload in hex."""
    return found.withColumns({"size_bytes": F.octet_length("payload"), "preview": F.lower(F.hex(F.substring("payload", 1, size)))})


def corrupted(shards: DataFrame, which: Column) -> DataFrame:
    """Fragments of which some have the first byte of their payload inverted, under the hash that they had; for studies and tests."""
    digits = F.hex("payload")
    first = F.lpad(F.hex(255 - F.conv(F.substring(digits, 1, 2), 16, 10).cast("long")), 2, "0")
    turned = F.unhex(F.concat(first, F.substring(digits, 3, 1 << 30)))
    return shards.withColumn("payload", F.when(which & (F.octet_length("payload") > 0), turned).otherwise(F.col("payload")))
