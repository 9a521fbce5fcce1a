"""Similarity of objects: sketches of texts, fingerprints of signals, differences of chunks, shared fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import jaccard
from ..schema import FINGERPRINT


def top_similar(objects: DataFrame, target: str, n: int = 10) -> DataFrame:
    """The n objects of the target's kind most like it by sketch: path, similarity; ties by path.

    Objects that share no sketch value score 0 and need no join, but are kept, so that n are found. One row, the
    target's, is sent to all.
    """
    one = objects.filter(F.col("path") == target).select(F.col("sketch").alias("t"), F.col("kind").alias("k")).limit(1)
    found = objects.filter(F.col("path") != target).join(F.broadcast(one), F.col("kind") == F.col("k"))
    return found.select("path", jaccard(F.col("t"), F.col("sketch")).alias("similarity")).orderBy(F.desc("similarity"), "path").limit(n)


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)


def l1_percent(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - distance / (255.0 * FINGERPRINT)) * 100))


def nearest(objects: DataFrame, target, n: int) -> DataFrame:
    """The n fingerprints (id, fp) nearest to that of id `target`, by distance, then id."""
    one = objects.filter(F.col("id") == target).select(F.col("fp").alias("t")).limit(1)
    found = objects.filter(F.col("id") != target).crossJoin(F.broadcast(one)).withColumn("distance", l1(F.col("t"), F.col("fp")).cast("int"))
    return found.select("id", "distance", l1_percent(F.col("distance")).alias("similarity_pct")).orderBy("distance", "id").limit(n)


def fingerprint(shards: DataFrame) -> DataFrame:
    """(object_id, fp) from systematic fragments (object_id, idx, bytes) of the first channel and layer: 16 byte means, 0 where one is missing.

    Of fragments with one index the last row by hash counts.
    """
    mean = F.when(F.size("bytes") > 0, F.expr("aggregate(bytes, 0L, (s, x) -> s + x) div size(bytes)")).otherwise(0)
    one = shards.filter(F.col("idx") < FINGERPRINT).groupBy("object_id", "idx").agg(F.max_by(mean, "hash").alias("m"))
    slots = one.groupBy("object_id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "m"))).alias("by"))
    return slots.select("object_id", F.transform(F.sequence(F.lit(0), F.lit(FINGERPRINT - 1)), lambda i: F.coalesce(F.try_element_at("by", i), F.lit(0)).cast("int")).alias("fp"))


def diff_cells(a: DataFrame, b: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by.., channel, layer, idx, is_common) of hashes (by.., channel, layer, idx, hash, k): the systematic places that both have."""
    key = [*by, "channel", "layer", "idx"]
    both = a.select(*key, F.col("hash").alias("ha"), F.col("k").alias("ka")).join(b.select(*key, F.col("hash").alias("hb"), F.col("k").alias("kb")), key)
    return both.filter(F.col("idx") < F.least("ka", "kb")).select(*key, (F.col("ha") == F.col("hb")).alias("is_common"))


def chunk_diff(a: DataFrame, b: DataFrame, by: list[str] = ()) -> DataFrame:
    """Cells summed up per (by.., channel, layer): n_common and n_total."""
    return diff_cells(a, b, by).groupBy(*by, "channel", "layer").agg(F.count_if("is_common").alias("n_common"), F.count("*").alias("n_total"))


def overlaps(hashes: DataFrame, target) -> DataFrame:
    """What other objects share with the target: id, common (their rows whose hash the target has), total_b and percent of the target's rows; by common, then id."""
    own = hashes.filter(F.col("id") == target)
    others = hashes.filter(F.col("id") != target)
    common = others.join(own.select("hash").distinct(), "hash", "left_semi").groupBy("id").agg(F.count("*").alias("common"))
    totals = others.groupBy("id").agg(F.count("*").alias("total_b"))
    rows = own.agg(F.count("*").alias("n"))
    found = common.join(totals, "id").crossJoin(F.broadcast(rows))
    return found.select("id", "common", "total_b", (F.col("common") * 100 / F.col("n")).alias("percent")).orderBy(F.desc("common"), "id")
