"""Signals: layers of transform coefficients, their energy, and what a progressive read gives."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import haar
from ..schema import LEVELS, N_PER_LAYER, NLAYERS, REDUNDANCY, K


def transformed(signals: DataFrame, n: int, levels: int = LEVELS) -> DataFrame:
    """signals (id, values) with coeffs, the 1-D transform of their first n values."""
    return signals.withColumn("coeffs", haar.forward_array(n, levels)(F.col("values").cast("array<double>")))


def coefficients(signals: DataFrame, n: int, levels: int = LEVELS) -> DataFrame:
    """(id, i, layer, c), one row per coefficient."""
    rows = transformed(signals, n, levels).select("id", F.posexplode("coeffs").alias("i", "c"))
    return rows.select("id", "i", haar.layer_column(F.col("i"), n, levels).alias("layer"), "c")


def layer_energy(signals: DataFrame, n: int, levels: int = LEVELS) -> DataFrame:
    return coefficients(signals, n, levels).groupBy("id", "layer").agg(F.sum(F.col("c") * F.col("c")).alias("energy"), F.count("*").alias("n"))


def progressive_psnr(signals: DataFrame, n: int, peak: float, levels: int = LEVELS) -> DataFrame:
    """(id, max_layer, mse, psnr) of reading no layer above max_layer. The transform keeps energy, so what is left out is the error."""
    energy = layer_energy(signals, n, levels)
    reads = signals.sparkSession.range(levels + 1).select(F.col("id").cast("int").alias("max_layer"))
    lost = energy.crossJoin(F.broadcast(reads)).groupBy("id", "max_layer").agg((F.sum(F.when(F.col("layer") > F.col("max_layer"), F.col("energy")).otherwise(0.0)) / n).alias("mse"))
    return lost.withColumn("psnr", psnr(F.col("mse"), peak))


def degradation(signals: DataFrame, n: int, peak: float, survivals: tuple[int, ...], seed: int, n_per_layer: tuple[int, ...] = N_PER_LAYER, k: int = K) -> DataFrame:
    """(id, percent, mse, psnr) of reads when each fragment survives with that many percent, drawn by hash: a layer with fewer than k left reads as zeros."""
    spark = signals.sparkSession
    planned = spark.createDataFrame([(p, layer, i) for p in survivals for layer, m in enumerate(n_per_layer) for i in range(m)], "percent int, layer int, i int")
    drawn = F.conv(F.substring(F.sha2(F.concat_ws("-", F.lit(str(seed)), F.col("percent").cast("string"), F.col("layer").cast("string"), F.col("i").cast("string")), 256), 1, 8), 16, 10).cast("long") % 100
    kept = planned.groupBy("percent", "layer").agg((F.count_if(drawn < F.col("percent")) >= k).alias("ok"))  # a row per percent and layer
    lost = layer_energy(signals, n, len(n_per_layer) - 1).join(F.broadcast(kept), "layer").groupBy("id", "percent").agg((F.sum(F.when(F.col("ok"), 0.0).otherwise(F.col("energy"))) / n).alias("mse"))
    return lost.withColumn("psnr", psnr(F.col("mse"), peak))


def psnr(mse: Column, peak: float = 255.0) -> Column:
    """Decibels; 99 where nothing differs."""
    return F.when(mse < 1e-9, 99.0).otherwise(10 * F.log10(F.lit(peak * peak) / mse))


def layer_plan(width: int, height: int = 1, levels: int = LEVELS, k: int = K, redundancy: tuple[float, ...] = REDUNDANCY) -> pd.DataFrame:
    """layer, n_shards, sym_len and positions of a plane; a signal (height 1) is cut to a multiple of 2 to the levels."""
    step = 1 << levels
    if height == 1:
        width = width // step * step
    if width <= 0 or width % step or height > 1 and height % step:
        raise ValueError(f"{width} x {height} is no multiple of {step}")
    y, x = np.divmod(np.arange(width * height), width)
    layer = haar.layer_1d(x, width, levels) if height == 1 else haar.layer_2d(x, y, width, height, levels)
    rows = [(n, int(k * redundancy[n] + 0.5), -(-int((layer == n).sum()) * 4 // k), np.flatnonzero(layer == n).tolist()) for n in range(min(levels + 1, NLAYERS))]
    return pd.DataFrame(rows, columns=["layer", "n_shards", "sym_len", "positions"])


def layer_bytes(signals: DataFrame, plan: pd.DataFrame, width: int, height: int = 1, levels: int = LEVELS) -> DataFrame:
    """(id, channel, layer, data): float32 coefficients of each layer, little endian, of signals (id, channel, values)."""
    positions = {int(r.layer): np.array(r.positions) for r in plan.itertuples()}

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                plane = np.array(r[2], np.float32)[: width * height]
                c = haar.forward_1d(plane, levels) if height == 1 else haar.forward_2d(plane.reshape(height, width), levels).ravel()
                out += [(r[0], r[1], layer, c[at].astype("<f4").tobytes()) for layer, at in positions.items()]
            yield pd.DataFrame(out, columns=["id", "channel", "layer", "data"])

    return signals.select(F.col("id").cast("long"), F.col("channel").cast("int"), "values").mapInPandas(run, "id long, channel int, layer int, data binary")


def restored(layers: DataFrame, plan: pd.DataFrame, width: int, height: int = 1, levels: int = LEVELS) -> DataFrame:
    """(id, channel, values) from the layers at hand (id, channel, layer, data); coefficients of others, and of null data, are 0."""
    positions = {int(r.layer): np.array(r.positions) for r in plan.itertuples()}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = np.zeros(width * height, np.float32)
        for r in pdf.itertuples():
            if r.data is not None:
                at = positions[int(r.layer)]
                c[at] = np.frombuffer(r.data, "<f4")[: len(at)]
        plane = haar.inverse_1d(c, levels) if height == 1 else haar.inverse_2d(c.reshape(height, width), levels).ravel()
        return pd.DataFrame({"id": [pdf["id"].iloc[0]], "channel": [pdf["channel"].iloc[0]], "values": [plane]})

    return layers.groupBy("id", "channel").applyInPandas(run, "id long, channel int, values array<float>")
