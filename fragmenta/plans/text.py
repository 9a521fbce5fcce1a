"""Queries over text objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import similarity
from ..schema import K, TAG
from ..sources import tables

TARGET = 0


def minhash_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.sketched(tables.objects(spark, sf_dir))
    return found.select("doc_id", F.posexplode("sketch").alias("idx", "hash"))


def similar_documents_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.sketched(tables.objects(spark, sf_dir))
    target = F.col("doc_id") == TARGET
    # The target's path is that of one document, so it is a value, not a table.
    path = tables.objects(spark, sf_dir).filter(target).select("path").first()
    return similarity.top_similar(found, path.path if path else "").withColumn("similarity", F.round("similarity", 6))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K pieces of each text, on character borders: doc_id, idx, data."""
    docs = tables.objects(spark, sf_dir).select("doc_id", F.encode("text", "utf-8").alias("b")).withColumn("n", F.octet_length("b"))
    inside = lambda p: f"(({p}) < n and hex(substring(b, int({p}) + 1, 1)) between '80' and 'BF')"
    at = f"(i * n) div {K}"
    border = f"{at} + case when i = 0 or i = {K} or not {inside(at)} then 0 when not {inside(at + ' + 1')} then 1 when not {inside(at + ' + 2')} then 2 else 3 end"
    docs = docs.withColumn("at", F.expr(f"transform(sequence(0, {K}), i -> int({border}))"))
    rows = docs.select("doc_id", "b", "at", F.explode(F.sequence(F.lit(0), F.lit(K - 1))).alias("idx"))
    return rows.select("doc_id", "idx", F.expr("substring(b, at[idx] + 1, at[idx + 1] - at[idx])").alias("data"))


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("doc_id", "idx", F.octet_length("data").cast("long").alias("chunk_len"), F.sha2("data", 256).alias("chunk_sha"))


def text_cid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.objects(spark, sf_dir)
    cid = hashing.text_cid(F.col("text"), F.lit("text/plain; charset=utf-8"))
    return docs.select("doc_id", cid.alias("cid")).withColumn("object_id", hashing.object_id(F.col("cid")))


def shard_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of each chunk as the systematic fragment that holds it."""
    unit = F.expr(f"unhex(concat(repeat('00', idx), '01', repeat('00', {K - 1} - idx)))")
    return chunks(spark, sf_dir).select("doc_id", "idx", hashing.shard_hash(unit, F.col("data")).alias("hash"))


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by content: id, idx, hash; empty ones say nothing."""
    return chunks(spark, sf_dir).filter(F.octet_length("data") > 0).select(F.col("doc_id").alias("id"), "idx", F.sha2("data", 256).alias("hash"))


def chunk_diff_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the next id."""
    rows = _hashes(spark, sf_dir).withColumns({"channel": F.lit(0), "layer": F.lit(0), "k": F.lit(K)})
    a, b = rows.withColumnRenamed("id", "a"), rows.withColumn("a", F.col("id") - 1)
    out = similarity.chunk_diff(a, b, ["a"])
    return out.select("a", "n_common", "n_total", F.round(F.col("n_common") * 100 / F.col("n_total"), 4).alias("percent"))


def shard_overlap_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What other documents share with one that has a copy, the smallest id among them."""
    rows = _hashes(spark, sf_dir)
    shared = rows.groupBy("hash").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi")
    target = shared.agg(F.min("lo").alias("t")).first().t
    return similarity.overlaps(rows, target if target is not None else -1).withColumn("percent", F.round("percent", 4))


def dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hashes(spark, sf_dir)
    out = rows.agg(F.count("*").alias("chunks_total"), F.count_distinct("hash").alias("chunks_unique"), F.count_distinct("id").alias("objects"))
    return out.withColumn("dedup_percent", F.round((1 - F.col("chunks_unique") / F.col("chunks_total")) * 100, 2))


def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct byte values of each page's contents, and the share of zero bytes; a row each, so nothing is shuffled. Pages without bytes have no row."""
    pages = tables.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all(F.hex(F.encode("html", "utf-8")), F.lit("(..)"), F.lit(1)).alias("b")).filter(F.size("b") > 0)
    zeros = F.size(F.filter("b", lambda x: x == "00"))
    return pages.select("page_id", F.size(F.array_distinct("b")).cast("long").alias("n_distinct"), F.round(zeros / F.size("b"), 6).alias("share"))


def merkle_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = shard_hashes(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("xs"))
    return leaves.select("doc_id", hashing.merkle_root_hex(F.col("xs.hash")).alias("root"))


def sketch_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.sketched(tables.objects(spark, sf_dir))
    return found.select("doc_id", hashing.sketch_preview(F.col("sketch")).alias("preview"))


QUERIES = {f.__name__: f for f in (minhash_documents, similar_documents_top10, text_chunks, text_cid, shard_hashes, chunk_diff_documents, shard_overlap_documents, dedup_stats, byte_histogram, merkle_roots, sketch_previews)}

_HEX = lambda kind: (f"{TAG}-{kind}-v1\0").encode().hex()
_STEPS = ["SELECT doc_id, i, n, b1, b2, b3, b4, ((xor(2166136261::BIGINT, b0)) * 16777619) & 4294967295 AS h FROM w"]
for _i in range(1, 5):
    _STEPS.append(f"SELECT doc_id, i, n, b1, b2, b3, b4, CASE WHEN b{_i} IS NULL THEN h ELSE ((xor(h, b{_i})) * 16777619) & 4294967295 END AS h FROM ({_STEPS[-1]})")
_SKETCH = f"""
    x AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS l FROM documents WHERE text <> ''),
    y AS (SELECT doc_id, len(l) AS n, unnest(l) AS v, unnest(range(len(l))) AS i FROM x),
    z AS (SELECT doc_id, n, i, ('0x' || v)::BIGINT AS b0 FROM y),
    w AS (SELECT *, lead(b0, 1) OVER s AS b1, lead(b0, 2) OVER s AS b2, lead(b0, 3) OVER s AS b3, lead(b0, 4) OVER s AS b4 FROM z WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
    f AS ({_STEPS[-1]}),
    d AS (SELECT DISTINCT doc_id, h FROM f WHERE i <= greatest(n - 5, 0)),
    sk AS (SELECT doc_id, h, row_number() OVER (PARTITION BY doc_id ORDER BY h) - 1 AS idx FROM d QUALIFY idx < 64)"""
_CHUNKS = f"""
    x AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents),
    p AS (SELECT *, unnest(range({K + 1})) AS i FROM x),
    q AS (SELECT *, (i * n) // {K} AS p FROM p),
    r AS (SELECT *, p + CASE WHEN i = 0 OR i = {K} OR NOT (p < n AND substr(h, 2 * p + 1, 2) BETWEEN '80' AND 'BF') THEN 0
                     WHEN NOT (p + 1 < n AND substr(h, 2 * p + 3, 2) BETWEEN '80' AND 'BF') THEN 1
                     WHEN NOT (p + 2 < n AND substr(h, 2 * p + 5, 2) BETWEEN '80' AND 'BF') THEN 2 ELSE 3 END AS beg FROM q),
    s AS (SELECT doc_id, i, h, beg, lead(beg) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM r),
    chunks AS (SELECT doc_id, i::INT AS idx, upto - beg AS len, unhex(substr(h, 2 * beg + 1, 2 * (upto - beg))) AS data FROM s WHERE i < {K})"""
_SHARD = f"sha256(unhex('{_HEX('shard')}') || unhex('0010') || unhex(lpad(to_hex(len), 8, '0')) || unhex(repeat('00', idx) || '01' || repeat('00', {K - 1} - idx)) || data)"

ORACLE = {
    "minhash_documents": f"WITH {_SKETCH} SELECT doc_id, idx::INT AS idx, h AS hash FROM sk",
    "similar_documents_top10": f"""
        WITH {_SKETCH}, l AS (SELECT doc_id, list(h ORDER BY h) AS sketch FROM sk GROUP BY doc_id),
        o AS (SELECT d.doc_id, d.lang AS kind, d.lang || '/' || d.source || '/doc_' || d.doc_id || '.txt' AS path, coalesce(l.sketch, []) AS sketch FROM documents d LEFT JOIN l USING (doc_id)),
        t AS (SELECT sketch AS t, kind AS k, path AS tp FROM o WHERE doc_id = {TARGET}),
        j AS (SELECT path, t, sketch, least(64, len(t), len(sketch)) AS n FROM o JOIN t ON kind = k AND path <> tp),
        u AS (SELECT *, list_sort(list_distinct(list_concat(t, sketch)))[:n] AS u FROM j)
        SELECT path, round(CASE WHEN n > 0 THEN len(list_intersect(list_intersect(u, t), sketch)) / len(u) ELSE 0 END, 6)::DOUBLE AS similarity
        FROM u ORDER BY similarity DESC, path LIMIT 10""",
    "text_chunks": f"WITH {_CHUNKS} SELECT doc_id, idx, len AS chunk_len, sha256(data) AS chunk_sha FROM chunks",
    "text_cid": f"""
        WITH c AS (SELECT doc_id, sha256(unhex('{_HEX("text")}') || encode(text) || encode('text/plain; charset=utf-8')) AS cid FROM documents),
        v AS (SELECT *, ('0x' || substr(cid, 1, 16))::UBIGINT AS u FROM c)
        SELECT doc_id, cid, (CASE WHEN u >= 9223372036854775808 THEN u::HUGEINT - 18446744073709551616 ELSE u::HUGEINT END)::BIGINT AS object_id FROM v""",
    "shard_hashes": f"WITH {_CHUNKS} SELECT doc_id, idx, {_SHARD} AS hash FROM chunks",
    "chunk_diff_documents": f"""
        WITH {_CHUNKS}, c AS (SELECT * FROM chunks WHERE len > 0)
        SELECT x.doc_id AS a, count(*) FILTER (x.data = y.data) AS n_common, count(*) AS n_total, round(count(*) FILTER (x.data = y.data) * 100 / count(*), 4) AS percent
        FROM c x JOIN c y ON y.doc_id = x.doc_id + 1 AND y.idx = x.idx GROUP BY x.doc_id""",
    "shard_overlap_documents": f"""
        WITH {_CHUNKS}, c AS (SELECT doc_id AS id, sha256(data) AS hash FROM chunks WHERE len > 0),
        t AS (SELECT min(lo) AS t FROM (SELECT min(id) AS lo FROM c GROUP BY hash HAVING min(id) < max(id)))
        SELECT id, count(*) FILTER (hash IN (SELECT hash FROM c WHERE id = (SELECT t FROM t))) AS common, count(*) AS total_b,
               round(common * 100 / (SELECT count(*) FROM c WHERE id = (SELECT t FROM t)), 4) AS percent
        FROM c WHERE id <> (SELECT t FROM t) GROUP BY id HAVING common > 0""",
    "dedup_stats": f"""
        WITH {_CHUNKS}, c AS (SELECT doc_id AS id, sha256(data) AS hash FROM chunks WHERE len > 0)
        SELECT count(*) AS chunks_total, count(DISTINCT hash) AS chunks_unique, count(DISTINCT id) AS objects, round((1 - count(DISTINCT hash) / count(*)) * 100, 2) AS dedup_percent FROM c""",
    "byte_histogram": """
        WITH b AS (SELECT page_id, unnest(regexp_extract_all(hex(encode(html)), '..')) AS b FROM pages)
        SELECT page_id, count(DISTINCT b) AS n_distinct, round(avg((b = '00')::INT), 6) AS share FROM b GROUP BY page_id""",
    "merkle_roots": f"""
        WITH RECURSIVE {_CHUNKS}, l AS (SELECT doc_id, idx, {_SHARD} AS hash FROM chunks),
        a AS (SELECT doc_id, idx // 2 AS idx, sha256(unhex('{_HEX("pair")}') || unhex(string_agg(hash, '' ORDER BY idx))) AS hash FROM l GROUP BY doc_id, idx // 2),
        b AS (SELECT doc_id, idx // 2 AS idx, sha256(unhex('{_HEX("pair")}') || unhex(string_agg(hash, '' ORDER BY idx))) AS hash FROM a GROUP BY doc_id, idx // 2),
        c AS (SELECT doc_id, idx // 2 AS idx, sha256(unhex('{_HEX("pair")}') || unhex(string_agg(hash, '' ORDER BY idx))) AS hash FROM b GROUP BY doc_id, idx // 2)
        SELECT doc_id, sha256(unhex('{_HEX("pair")}') || unhex(string_agg(hash, '' ORDER BY idx))) AS root FROM c GROUP BY doc_id""",
    "sketch_previews": f"""
        WITH {_SKETCH} SELECT doc_id, string_agg(lpad(lower(to_hex(h)), 8, '0'), ' ' ORDER BY idx) FILTER (idx < 8) || CASE WHEN count(*) > 8 THEN ' …' ELSE '' END AS preview
        FROM sk GROUP BY doc_id""",
}
