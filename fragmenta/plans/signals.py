"""Queries over signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import haar
from ..operators import signals as ops
from ..operators import similarity
from ..schema import FINGERPRINT, LEVELS
from ..sources import tables

SIZE = 64


def haar1d_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.coefficients(tables.signals(spark, sf_dir), SIZE)
    return found.select("id", "i", "layer", F.round("c", 6).alias("c"))


def haar_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step of the transform over rows instead of arrays: neighbours are brought together by half their place."""
    rows = tables.signals(spark, sf_dir).select("id", F.posexplode("values").alias("i", "v"))
    pairs = rows.groupBy("id", F.floor(F.col("i") / 2).cast("int").alias("i")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("i") % 2 == 1, F.col("v"))).alias("b"))
    a, b, root = F.col("a").cast("double"), F.col("b").cast("double"), F.sqrt(F.lit(2.0))
    return pairs.select("id", "i", F.round((a + b) / root, 6).alias("mean"), F.round((a - b) / root, 6).alias("detail"))


def layer_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.layer_energy(tables.signals(spark, sf_dir), SIZE)
    return found.withColumn("energy", F.round("energy", 6))


def progressive_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.progressive_psnr(tables.signals(spark, sf_dir), SIZE, 1.0)
    return found.select("id", "max_layer", F.round("mse", 8).alias("mse"), F.round("psnr", 4).alias("psnr"))


def _fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as bytes, half a byte range at 0; means of 16 strips."""
    step = SIZE // FINGERPRINT
    byte = lambda x: F.least(F.greatest(F.floor((x.cast("double") + 1) * 127.5), F.lit(0)), F.lit(255))
    strips = F.transform(F.sequence(F.lit(0), F.lit(FINGERPRINT - 1)), lambda i: F.aggregate(F.slice("bytes", i * step + 1, step), F.lit(0).cast("long"), lambda s, x: s + x))
    rows = tables.signals(spark, sf_dir).withColumn("bytes", F.transform("values", byte))
    return rows.select("id", F.transform(strips, lambda s: F.floor(s / step).cast("int")).alias("fp"))


def fingerprint_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    hexes = F.array_join(F.transform("fp", lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")
    return _fingerprints(spark, sf_dir).select("id", hexes.alias("fingerprint"))


def nearest_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.nearest(_fingerprints(spark, sf_dir), 0, 10).withColumn("similarity_pct", F.round("similarity_pct", 4))


def layer_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of each layer of a 64 x 64 plane."""
    i = spark.range(SIZE * SIZE).select((F.col("id") % SIZE).alias("x"), F.floor(F.col("id") / SIZE).alias("y"))
    layer = F.greatest(haar.layer_column(F.col("x"), SIZE, LEVELS), haar.layer_column(F.col("y"), SIZE, LEVELS))
    return i.groupBy(layer.alias("layer")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (haar1d_embeddings, haar_step, layer_energy, progressive_psnr, fingerprint_embeddings, nearest_fingerprints, layer_sizes)}


def _level(source: str, n: int, last: bool) -> str:
    """Rows (id, i, v) with the first n replaced by means and details, the rest as they are."""
    return f"""SELECT id, CASE WHEN i >= {n} THEN i ELSE o * {n // 2} + i // 2 END AS i, CASE WHEN i >= {n} THEN v WHEN o = 0 THEN (v + w) / sqrt(2.0::DOUBLE) ELSE (w - v) / sqrt(2.0::DOUBLE) END AS v
        FROM (SELECT id, i, v, i % 2 AS o, CASE WHEN i % 2 = 0 THEN lead(v) OVER (PARTITION BY id ORDER BY i) ELSE lag(v) OVER (PARTITION BY id ORDER BY i) END AS w FROM ({source}))"""


_ROWS = "SELECT vec_id AS id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings"
_COEFFS = _level(_level(_level(_ROWS, 64, False), 32, False), 16, True)
_LAYERED = f"c AS (SELECT id, i, CASE WHEN i >= 32 THEN 3 WHEN i >= 16 THEN 2 WHEN i >= 8 THEN 1 ELSE 0 END AS layer, v FROM ({_COEFFS}))"
_FP = """
    r AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings),
    f AS (SELECT id, i // 4 AS slot, sum(least(greatest(floor((v + 1) * 127.5::DOUBLE), 0), 255))::BIGINT // 4 AS b FROM r GROUP BY ALL)"""

ORACLE = {
    "haar1d_embeddings": f"WITH {_LAYERED} SELECT id, i::INT AS i, layer::INT AS layer, round(v, 6) AS c FROM c",
    "haar_step": f"""
        WITH r AS ({_ROWS}), p AS (SELECT id, i // 2 AS i, max(v) FILTER (i % 2 = 0) AS a, max(v) FILTER (i % 2 = 1) AS b FROM r GROUP BY ALL)
        SELECT id, i::INT AS i, round((a + b) / sqrt(2.0::DOUBLE), 6) AS mean, round((a - b) / sqrt(2.0::DOUBLE), 6) AS detail FROM p""",
    "layer_energy": f"WITH {_LAYERED} SELECT id, layer::INT AS layer, round(sum(v * v), 6) AS energy, count(*) AS n FROM c GROUP BY ALL",
    "progressive_psnr": f"""
        WITH {_LAYERED}, m AS (SELECT id, unnest(range(4)) AS max_layer FROM (SELECT DISTINCT id FROM c)),
        e AS (SELECT m.id, max_layer, sum(CASE WHEN layer > max_layer THEN v * v ELSE 0 END) / 64 AS mse FROM m JOIN c ON c.id = m.id GROUP BY ALL)
        SELECT id, max_layer::INT AS max_layer, round(mse, 8) AS mse, round(CASE WHEN mse < 1e-9 THEN 99 ELSE 10 * log10(1 / mse) END, 4) AS psnr FROM e""",
    "fingerprint_embeddings": f"WITH {_FP} SELECT id, string_agg(lpad(lower(to_hex(b)), 2, '0'), '' ORDER BY slot) AS fingerprint FROM f GROUP BY id",
    "nearest_fingerprints": f"""
        WITH {_FP}, d AS (SELECT a.id, sum(abs(a.b - t.b))::INT AS distance FROM f a JOIN f t ON t.id = 0 AND t.slot = a.slot WHERE a.id <> 0 GROUP BY a.id)
        SELECT id, distance, round(greatest(0, least(100, (1 - distance / 4080.0::DOUBLE) * 100)), 4) AS similarity_pct FROM d ORDER BY distance, id LIMIT 10""",
    "layer_sizes": """
        WITH p AS (SELECT i % 64 AS x, i // 64 AS y FROM range(4096) t(i)), g AS (SELECT greatest(x, y) AS m FROM p)
        SELECT CASE WHEN m >= 32 THEN 3 WHEN m >= 16 THEN 2 WHEN m >= 8 THEN 1 ELSE 0 END AS layer, count(*) AS n FROM g GROUP BY ALL""",
}
