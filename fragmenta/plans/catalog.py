"""Queries over the catalog of objects and what the HTTP side makes of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, web
from ..operators import catalog as ops
from ..sources import tables

ROOT = "en"
# Endings, headers and bodies that queries try one after the other, by id.
ENDINGS = ("pdf", "md", "tar.gz", "HTML", "json", "zip", "txt", "db")
HEADERS = ("bytes=0-99", "bytes=100-", "bytes=-50", "bytes=0-0,5-9", "items=1-2", "", "bytes=9999999-", "bytes=5-2", "bytes=-0", "bytes=x-2")
SHAPES = ("", "/{}", "{}/", "a//{}", "a/./{}", "a/../{}", "long", "{}")
HEADS = ("89504e470d0a1a0a", "ffd8ffe0", "664c6143", "49443303", "", "fffe00", "424d", "")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.objects(spark, sf_dir).select("doc_id", "path", F.lit("text").alias("kind"))


def _one_of(i: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (i % len(values) + 1).cast("int"))


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return _entries(spark, sf_dir).select("path", paths.parent(p).alias("parent"), paths.basename(p).alias("basename"), F.size(paths.segments(p)).alias("depth"), F.array_join(paths.ancestors(p), "|").alias("ancestors"))


def path_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("s"))
    path = F.when(F.col("doc_id") % 8 == 6, F.concat(F.lit("ü/"), F.repeat(F.lit("é"), 128))).otherwise(F.replace(_one_of(F.col("doc_id"), SHAPES), F.lit("{}"), F.col("s")))
    return rows.select("doc_id", paths.violation(path).alias("violation"))


def reserved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "documents").select("doc_id", F.concat(_one_of(F.col("doc_id"), (*paths.RESERVED, "data", "helpful")), F.lit("/"), "source").alias("path"))
    return rows.select("doc_id", paths.is_reserved(F.col("path")).alias("reserved"), paths.is_valid_put(F.col("path")).alias("valid"))


def missing_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.missing_ancestors(_entries(spark, sf_dir))


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _entries(spark, sf_dir)
    return entries.select("path", "kind").unionByName(ops.missing_ancestors(entries).select("path", "kind"))


def list_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.list_dir(_catalog(spark, sf_dir), f"{ROOT}/src0")


def list_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.children(_catalog(spark, sf_dir))


def rename_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.rename(_catalog(spark, sf_dir), ROOT, "english")


def count_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.count_by_kind(_catalog(spark, sf_dir))


def mime_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("."), _one_of(F.col("doc_id"), ENDINGS))
    rows = tables.table(spark, sf_dir, "documents").select("doc_id", name.alias("name"))
    return rows.select("doc_id", web.opaque_type(F.col("name")).alias("opaque"), web.text_type(F.col("name")).alias("text"))


def kind_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.unhex(_one_of(F.col("doc_id"), HEADS)), F.encode("text", "utf-8"))
    return tables.table(spark, sf_dir, "documents").select("doc_id", web.kind_of(body).alias("kind"))


def http_range_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("b"), _one_of(F.col("doc_id"), HEADERS).alias("header"))
    rows = rows.withColumn("r", web.parse_range(F.col("header"), F.octet_length("b").cast("long")))
    cut = F.expr("case when r.outcome = 'Range' then substring(b, int(r.first) + 1, int(r.last - r.first + 1)) when r.status = 200 then b else unhex('') end")
    return rows.select("doc_id", "r.outcome", "r.status", F.sha2(cut, 256).alias("body_sha"))


def html_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "pages").select("page_id", F.sha2(web.html_escape(F.col("html")), 256).alias("escaped_sha"))


def url_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs encoded as a form field and decoded again."""
    return tables.table(spark, sf_dir, "pages").select("page_id", web.form_decode(F.replace(F.replace("url", F.lit("/"), F.lit("%2F")), F.lit("-"), F.lit("+"))).alias("url"))


def object_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a catalog page shows: name, planned fragments, and a state by size."""
    rows = tables.objects(spark, sf_dir)
    n = F.octet_length("text")
    return rows.select("path", F.substring(F.sha2("text", 256), 1, 12).alias("cid"), F.lit(24).alias("n_shards"), web.margin_state(n - 1000).alias("state"), web.share_label(F.floor(n / 100) / 10).alias("share"))


def prometheus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat, nodes = _catalog(spark, sf_dir), tables.nodes(spark, sf_dir)
    stats = cat.agg(F.count("*").alias("objects_total"), F.count_if(F.col("kind") == "text").alias("texts_total")).crossJoin(nodes.agg(F.count("*").alias("nodes_total"), F.count_if(~F.col("admin_killed")).alias("nodes_live")))
    return ops.prometheus(stats, ["objects_total", "texts_total", "nodes_total", "nodes_live"])


QUERIES = {
    f.__name__: f
    for f in (
        path_parts, path_validate, reserved_names, missing_ancestors, list_dir, list_all, rename_prefix, count_by_kind, mime_guess, kind_sniff, http_range_slices, html_escaped, url_forms, object_cards, prometheus_lines,
    )
}

_C = "c AS (SELECT doc_id, lang, source, lang || '/' || source || '/doc_' || doc_id || '.txt' AS path FROM documents)"
_ALL = f"{_C}, a AS (SELECT path, 'text' AS kind FROM c UNION ALL SELECT DISTINCT lang, 'directory' FROM c UNION ALL SELECT DISTINCT lang || '/' || source, 'directory' FROM c)"


def _pick(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + f"][doc_id % {len(values)} + 1]"


_OPAQUE = "CASE ext " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in web.OPAQUE_TYPES.items()) + " ELSE 'application/octet-stream' END"
_TEXT = "CASE ext " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in web.TEXT_TYPES.items()) + " ELSE 'text/plain; charset=utf-8' END"

ORACLE = {
    "path_parts": f"WITH {_C} SELECT path, lang || '/' || source AS parent, 'doc_' || doc_id || '.txt' AS basename, 3 AS depth, lang || '|' || lang || '/' || source AS ancestors FROM c",
    "path_validate": """
        SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'Empty' WHEN 1 THEN 'LeadingSlash' WHEN 2 THEN 'TrailingSlash' WHEN 3 THEN 'EmptySegment' WHEN 4 THEN 'DotSegment' WHEN 5 THEN 'DotDotSegment' WHEN 6 THEN 'SegmentTooLong' END AS violation
        FROM documents""",
    "reserved_names": "SELECT doc_id, doc_id % 15 < 13 AS reserved, doc_id % 15 >= 13 AS valid FROM documents",
    "missing_ancestors": f"""
        WITH {_C}, d AS (SELECT DISTINCT lang AS path FROM c UNION SELECT DISTINCT lang || '/' || source FROM c),
        v AS (SELECT path, ('0x' || substr(sha256(unhex('{b"fragmenta-dir-v1".hex()}00') || encode(path)), 1, 16))::UBIGINT AS u FROM d)
        SELECT path, (CASE WHEN u >= 9223372036854775808 THEN u::HUGEINT - 18446744073709551616 ELSE u::HUGEINT END)::BIGINT AS object_id, 'directory' AS kind FROM v""",
    "list_dir": f"WITH {_C} SELECT 'doc_' || doc_id || '.txt' AS name, path, 'text' AS kind FROM c WHERE lang = '{ROOT}' AND source = 'src0'",
    "list_all": f"WITH {_ALL} SELECT CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS directory, regexp_extract(path, '[^/]*$') AS name, kind FROM a",
    "rename_prefix": f"WITH {_ALL} SELECT CASE WHEN path = '{ROOT}' OR starts_with(path, '{ROOT}/') THEN 'english' || substr(path, {len(ROOT) + 1}) ELSE path END AS path, kind FROM a",
    "count_by_kind": f"WITH {_ALL} SELECT k AS kind, count(a.kind) AS n FROM (SELECT unnest(['image', 'text', 'audio', 'opaque', 'directory']) AS k) LEFT JOIN a ON a.kind = k GROUP BY k",
    "mime_guess": f"WITH e AS (SELECT doc_id, regexp_extract(lower({_pick(ENDINGS)}), '[^.]*$') AS ext FROM documents) SELECT doc_id, {_OPAQUE} AS opaque, {_TEXT} AS text FROM e",
    "kind_sniff": "SELECT doc_id, ['image', 'image', 'audio', 'audio', 'text', 'opaque', 'image', 'text'][doc_id % 8 + 1] AS kind FROM documents",
    "http_range_slices": """
        WITH x AS (SELECT doc_id, doc_id % 10 AS m, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents),
        r AS (SELECT *, CASE WHEN m = 3 THEN 'Multiple' WHEN m IN (4, 9) THEN 'Malformed' WHEN m = 5 THEN 'NoRange' WHEN m IN (6, 8) THEN 'Unsatisfiable'
                             WHEN m = 7 THEN 'Unsatisfiable' WHEN m = 1 AND n <= 100 OR n = 0 THEN 'Unsatisfiable' ELSE 'Range' END AS outcome FROM x)
        SELECT doc_id, outcome, CASE outcome WHEN 'Range' THEN 206 WHEN 'Unsatisfiable' THEN 416 ELSE 200 END AS status,
               sha256(unhex(CASE WHEN outcome = 'Unsatisfiable' THEN '' WHEN outcome <> 'Range' THEN h WHEN m = 0 THEN substr(h, 1, 200) WHEN m = 1 THEN substr(h, 201) ELSE right(h, 100) END)) AS body_sha
        FROM r""",
    "html_escaped": """SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;')) AS escaped_sha FROM pages""",
    "url_forms": "SELECT page_id, replace(url, '-', ' ') AS url FROM pages",
    "object_cards": f"""
        WITH {_C}, d AS (SELECT path, sha256(text) AS s, octet_length(encode(text)) AS n FROM c JOIN documents USING (doc_id))
        SELECT path, substr(s, 1, 12) AS cid, 24 AS n_shards, CASE WHEN n < 1000 THEN 'bad' WHEN n = 1000 THEN 'partial' ELSE 'ok' END AS state,
               format('{{:.1f}}%', (n // 100) / 10) AS share FROM d""",
    "prometheus_lines": f"""
        WITH {_ALL}, n AS (SELECT s_acctbal < 0 AS k FROM supplier),
        l AS (SELECT 'fragmenta_objects_total ' || (SELECT count(*) FROM a) AS line UNION ALL SELECT 'fragmenta_texts_total ' || (SELECT count(*) FROM a WHERE kind = 'text')
              UNION ALL SELECT 'fragmenta_nodes_total ' || (SELECT count(*) FROM n) UNION ALL SELECT 'fragmenta_nodes_live ' || (SELECT count(*) FROM n WHERE NOT k))
        SELECT line FROM l""",
}
