"""Taking objects in, and what a read of one is answered with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, paths, web


def ingest(catalog: DataFrame, puts: DataFrame) -> DataFrame:
    """Outcome of each of puts (seq, path, body) against catalog (path, object_id, kind): seq, path, status, kind, content_type, cid, object_id, replaces, current.

    status is stored or the refusal: BadRequest (empty body, broken path, missing parent), AlreadyExists (a directory is there) or NotADirectory.
    Of puts to one path each replaces the one before it, whose fragments are to be purged; the last one is current.
    Kinds go by signature, as no decoder is at hand; ids of images and sounds are those of their bytes.
    """
    at = catalog.select(F.col("path"), F.col("object_id").alias("was"), F.col("kind").alias("there"))
    above = catalog.select(F.col("path").alias("parent"), F.col("kind").alias("parent_kind"))
    rows = puts.select("seq", "path", "body").withColumn("parent", paths.parent(F.col("path"))).join(at, "path", "left").join(above, "parent", "left")
    size = F.coalesce(F.octet_length("body"), F.lit(0))
    refused = (
        F.when((size == 0) | F.col("path").isNull() | paths.violation(F.col("path")).isNotNull(), "BadRequest")
        .when(F.col("there") == "directory", "AlreadyExists")
        .when(F.col("parent").isNotNull() & F.col("parent_kind").isNull(), "BadRequest")
        .when(F.col("parent").isNotNull() & (F.col("parent_kind") != "directory"), "NotADirectory")
    )
    rows = rows.withColumn("refused", refused)
    kind = web.kind_of(F.col("body"))
    taken = rows.filter("refused is null").withColumn("kind", kind)
    taken = taken.withColumn("content_type", F.when(F.col("kind") == "text", web.text_type(F.col("path"))).otherwise(web.opaque_type(F.col("path"))))
    cid = F.when(F.col("kind") == "text", hashing.text_cid(F.col("body").cast("string"), F.col("content_type"))).otherwise(hashing.opaque_cid(F.encode("content_type", "utf-8").cast("string"), F.col("body")))
    taken = taken.withColumn("cid", cid).withColumn("object_id", hashing.object_id(F.col("cid"))).drop("body")
    # Only ids and sizes are sorted by path, not contents.
    w = Window.partitionBy("path").orderBy("seq")
    taken = taken.select(
        "seq", "path", F.lit("stored").alias("status"), "kind", "content_type", "cid", "object_id",
        F.coalesce(F.lag("object_id").over(w), F.col("was")).alias("replaces"), F.lead("seq").over(w).isNull().alias("current"),
    )
    return taken.unionByName(rows.filter("refused is not null").select("seq", "path", F.col("refused").alias("status")), allowMissingColumns=True)


def entries(outcomes: DataFrame) -> DataFrame:
    """Rows (path, object_id, kind, content_type, cid) that a catalog takes over from ingest."""
    return outcomes.filter("status = 'stored' and current").select("path", "object_id", "kind", "content_type", "cid")


def preview_refusal(kind: Column) -> Column:
    """Why a read up to some layer is refused; null where it is possible."""
    return F.when(kind.isin("text", "opaque"), "PreviewUnsupported").when(kind == "directory", "IsDirectory")


def transport(kind: Column, content_type: Column, max_layer: Column) -> Column:
    """What a read is answered with, as a struct of error and content_type: media are decoded to PNG and WAV, others go as they came."""
    error = F.when(kind == "directory", "IsDirectory").when(max_layer.isNotNull(), preview_refusal(kind))
    as_type = F.when(kind == "image", "image/png").when(kind == "audio", "audio/wav").otherwise(content_type)
    return F.struct(error.alias("error"), F.when(error.isNull(), as_type).alias("content_type"))
