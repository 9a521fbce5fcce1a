"""Queries over coded fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coding, escrow
from ..schema import K
from ..sources import tables

#: Coded fragments of the relational encoder, and symbols it codes over.
CODED, SYMBOLS = 2, 8


def gf_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.gf_products(spark)


def rlnc_encode_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of fragments of each benchmark text, coded over eight symbols with coefficients that follow a rule."""
    data = tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("object_id"), F.encode("text", "utf-8").alias("b"))
    size = F.greatest(F.ceil(F.octet_length("b") / SYMBOLS), F.lit(1)).cast("int")
    rows = data.select("object_id", size.alias("size"), F.posexplode(coding.byte_values("b")).alias("p", "value"))
    symbols = rows.select("object_id", F.floor(F.col("p") / F.col("size")).cast("int").alias("i"), (F.col("p") % F.col("size")).alias("pos"), "value")
    grid = data.select("object_id", F.explode(F.sequence(F.lit(0), F.lit(CODED - 1))).alias("idx")).select("*", F.explode(F.sequence(F.lit(0), F.lit(SYMBOLS - 1))).alias("i"))
    coeffs = grid.withColumn("c", ((F.col("object_id") + F.col("idx") * 31 + F.col("i") * 17 + 1) % 256).cast("int"))
    return coding.encode_relational(symbols, coeffs)


def _shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.objects(spark, sf_dir).select(F.col("doc_id").alias("object_id"), "text", F.xxhash64("doc_id").alias("seed"))
    return coding.encode_texts(docs)


def rlnc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts again, from the fragments that are left after the first four are lost."""
    found = coding.decode_texts(_shards(spark, sf_dir).filter("idx >= 4"))
    return found.select(F.col("object_id").alias("doc_id"), "text", "holes")


def decode_with_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts from systematic fragments alone, of which the first three are lost."""
    found = coding.decode_texts(_shards(spark, sf_dir).filter(f"idx between 3 and {K - 1}"))
    return found.select(F.col("object_id").alias("doc_id"), F.sha2("text", 256).alias("text_sha"), "holes")


def shard_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct byte values and share of zeros of each fragment of the benchmark texts, systematic and coded."""
    data = tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("object_id"), "text", F.col("item_id").alias("seed"))
    rows = coding.encode_texts(data).select("object_id", "idx", coding.is_systematic(F.col("coeffs")).alias("systematic"), F.explode(coding.byte_values("payload")).alias("b"))
    return rows.groupBy("object_id", "idx", "systematic").agg(F.count_distinct("b").alias("n_distinct"), F.round(F.avg((F.col("b") == 0).cast("int")), 6).alias("zero_share"))


def systematic_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the benchmark's fragments hold a symbol as it is."""
    data = tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("object_id"), "text", F.col("item_id").alias("seed"))
    rows = coding.encode_texts(data)
    return rows.select("object_id", "idx", coding.systematic_index(F.col("coeffs")).alias("symbol")).filter("symbol is not null")


def escrow_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets from three of five shares, the first two lost."""
    data = tables.table(spark, sf_dir, "benchmark").select(F.encode("text", "utf-8").alias("data"), F.lit("text/plain").alias("content_type"), F.col("item_id").cast("string").alias("filename"))
    shares = escrow.split(data.dropDuplicates(["data"]), 3, 5)
    found = escrow.recover(shares.filter("shard_idx >= 2"))
    return found.select(F.decode("data", "utf-8").alias("text"), "error")


QUERIES = {f.__name__: f for f in (gf_products, rlnc_encode_relational, rlnc_roundtrip, decode_with_holes, shard_entropy, systematic_shards, escrow_roundtrip)}

_GF = """
    e AS (SELECT 0 AS i, 1 AS x UNION ALL SELECT i + 1, CASE WHEN x >= 128 THEN xor(x * 2, 285) ELSE x * 2 END FROM e WHERE i < 254),
    gf AS (SELECT l.x AS a, r.x AS b, p.x AS p FROM e l, e r JOIN e p ON p.i = (l.i + r.i) % 255)"""
_PIECES = f"""
    x AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents),
    q AS (SELECT *, (3 * n) // {K} AS p FROM x),
    b AS (SELECT doc_id, h, n, p + CASE WHEN NOT (p < n AND substr(h, 2 * p + 1, 2) BETWEEN '80' AND 'BF') THEN 0 WHEN NOT (p + 1 < n AND substr(h, 2 * p + 3, 2) BETWEEN '80' AND 'BF') THEN 1
                                     WHEN NOT (p + 2 < n AND substr(h, 2 * p + 5, 2) BETWEEN '80' AND 'BF') THEN 2 ELSE 3 END AS beg FROM q)"""
_LOST = " || ".join(f"encode(chr(10) || '[--missing chunk #{i} not recoverable--]' || chr(10))" for i in range(3))

ORACLE = {
    "gf_products": f"""
        WITH RECURSIVE {_GF} SELECT a, b, p FROM gf UNION ALL SELECT 0, i::INT, 0 FROM range(256) t(i) UNION ALL SELECT i::INT, 0, 0 FROM range(1, 256) t(i)""",
    "rlnc_encode_relational": f"""
        WITH RECURSIVE {_GF},
        x AS (SELECT item_id AS object_id, regexp_extract_all(hex(encode(text)), '..') AS l FROM benchmark),
        y AS (SELECT object_id, greatest((len(l) + {SYMBOLS - 1}) // {SYMBOLS}, 1) AS size, unnest(l) AS v, unnest(range(len(l))) AS p FROM x),
        s AS (SELECT object_id, p // size AS i, p % size AS pos, ('0x' || v)::INT AS value FROM y),
        t AS (SELECT s.object_id, idx, pos, value, (s.object_id + idx * 31 + i * 17 + 1) % 256 AS c FROM s, range({CODED}) r(idx))
        SELECT object_id, idx::INT AS idx, pos::INT AS pos, bit_xor(coalesce(gf.p, 0))::INT AS value FROM t LEFT JOIN gf ON gf.a = c AND gf.b = value GROUP BY ALL""",
    "rlnc_roundtrip": "SELECT doc_id, text, 0 AS holes FROM documents",
    "decode_with_holes": f"WITH {_PIECES} SELECT doc_id, sha256({_LOST} || unhex(substr(h, 2 * beg + 1))) AS text_sha, 3 AS holes FROM b",
    "systematic_shards": f"SELECT item_id AS object_id, i::INT AS idx, i::INT AS symbol FROM benchmark, range({K}) t(i)",
    "escrow_roundtrip": "SELECT DISTINCT text, NULL::VARCHAR AS error FROM benchmark",
}
