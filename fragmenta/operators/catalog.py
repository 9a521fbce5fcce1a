"""Catalog operators: listing, directories, renames, upserts, statistics and reports as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, paths

KINDS = ("image", "text", "audio", "opaque", "directory")


class CatalogError(ValueError):
    """A refused operation; kind is NotFound, NotADirectory, IsDirectory, BadRequest or Conflict."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind


def _kind(catalog: DataFrame, path: str) -> str | None:
    row = catalog.filter(F.col("path") == path).select("kind").first()
    return row.kind if row else None


def _checked(spark, path: str) -> None:
    broken = spark.range(1).select(paths.violation(F.lit(path)).alias("v")).first().v
    if broken:
        raise CatalogError("BadRequest", f"{path!r}: {broken}")


def missing_ancestors(catalog: DataFrame) -> DataFrame:
    """Directories that entries imply and the catalog lacks: path, object_id, kind."""
    implied = catalog.filter("kind <> 'directory'").select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    lacking = implied.join(catalog.select("path"), "path", "left_anti")
    return lacking.select("path", hashing.directory_id(F.col("path")).alias("object_id"), F.lit("directory").alias("kind"))


def directory_row(catalog: DataFrame, path: str) -> DataFrame:
    """A directory's row in the catalog's schema: nothing but its path, id, kind and type."""
    fixed = {"path": F.lit(path), "object_id": hashing.directory_id(F.lit(path)), "kind": F.lit("directory"), "content_type": F.lit("inode/directory")}
    fields = [fixed.get(f.name, F.lit(0 if f.dataType.simpleString() in ("int", "smallint", "bigint") else None)).cast(f.dataType).alias(f.name) for f in catalog.schema]
    return catalog.sparkSession.range(1).select(*fields)


def upsert(catalog: DataFrame, rows: DataFrame) -> DataFrame:
    return catalog.join(rows.select("path"), "path", "left_anti").select(catalog.columns).unionByName(rows.select(catalog.columns))


def remove(catalog: DataFrame, path: str) -> DataFrame:
    kind = _kind(catalog, path)
    if kind is None:
        raise CatalogError("NotFound", path)
    if kind == "directory":
        raise CatalogError("IsDirectory", path)
    return catalog.filter(F.col("path") != path)


def purge(shards: DataFrame, object_id: int, live: DataFrame) -> DataFrame:
    """Fragments without those of an object on live nodes."""
    gone = live.select("node").withColumn("object_id", F.lit(object_id))
    return shards.join(F.broadcast(gone), ["node", "object_id"], "left_anti").select(shards.columns)


def mkdir(catalog: DataFrame, path: str) -> DataFrame:
    _checked(catalog.sparkSession, path)
    if _kind(catalog, path):
        raise CatalogError("Conflict", path)
    above = path.rpartition("/")[0]
    if above and _kind(catalog, above) != "directory":
        raise CatalogError("NotFound" if _kind(catalog, above) is None else "NotADirectory", above)
    return catalog.unionByName(directory_row(catalog, path))


def rmdir(catalog: DataFrame, path: str) -> DataFrame:
    kind = _kind(catalog, path)
    if kind != "directory":
        raise CatalogError("NotFound" if kind is None else "NotADirectory", path)
    if not catalog.filter(paths.is_below(F.col("path"), F.lit(path))).limit(1).isEmpty():
        raise CatalogError("Conflict", f"{path} is not empty")
    return catalog.filter(F.col("path") != path)


def renamed(path: Column, old: str, new: str) -> Column:
    """A path under old, moved under new; others as they are."""
    moved = F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))
    return F.when((path == old) | paths.is_below(path, F.lit(old)), moved).otherwise(path)


def rename(catalog: DataFrame, old: str, new: str) -> DataFrame:
    """Moves an entry with all below it; ids stay."""
    _checked(catalog.sparkSession, new)
    if _kind(catalog, old) is None:
        raise CatalogError("NotFound", old)
    if new == old or new.startswith(old + "/"):
        raise CatalogError("BadRequest", f"{new} lies in {old}")
    above = new.rpartition("/")[0]
    if above and _kind(catalog, above) != "directory":
        raise CatalogError("NotFound" if _kind(catalog, above) is None else "NotADirectory", above)
    after = catalog.withColumn("path", renamed(F.col("path"), old, new))
    if not after.groupBy("path").count().filter("count > 1").limit(1).isEmpty():
        raise CatalogError("Conflict", new)
    return after


def list_dir(catalog: DataFrame, directory: str) -> DataFrame:
    """Immediate children as (name, path, kind), directories first, then by name."""
    if directory:
        kind = _kind(catalog, directory)
        if kind != "directory":
            raise CatalogError("NotFound" if kind is None else "NotADirectory", directory)
    prefix = f"{directory}/" if directory else ""
    inside = catalog.filter(F.startswith("path", F.lit(prefix))).withColumn("name", F.substring("path", len(prefix) + 1, 1 << 30))
    return inside.filter(~F.contains("name", F.lit("/"))).select("name", "path", "kind").orderBy(F.col("kind") != "directory", "name")


def children(catalog: DataFrame) -> DataFrame:
    """All directories' listings at once: (directory, name, kind), '' for the top."""
    return catalog.select(F.coalesce(paths.parent(F.col("path")), F.lit("")).alias("directory"), paths.basename(F.col("path")).alias("name"), "kind")


def count_by_kind(catalog: DataFrame) -> DataFrame:
    """Objects of each of the five kinds, with zeros."""
    kinds = catalog.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    return kinds.join(catalog.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").fillna(0, ["n"])


def statistics(catalog: DataFrame, layers: DataFrame, shard_hashes: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: objects, planned fragments and their bytes, distinct hashes, deduplicated share in percent, nodes and live nodes."""
    known = layers.dropDuplicates(["object_id", "layer"])
    planned = catalog.filter("kind <> 'directory'").join(known, "object_id").agg(
        F.coalesce(F.sum(F.col("n_shards") * F.col("channels")), F.lit(0)).alias("shards_total"),
        F.coalesce(F.sum(F.col("n_shards") * F.col("channels") * (F.col("sym_len") + F.col("k"))), F.lit(0)).alias("bytes_total"),
    )
    unique = shard_hashes.agg(F.count_distinct("hash").alias("shards_unique"))
    cluster = nodes.agg(F.count("*").alias("nodes_total"), F.count_if(~F.col("admin_killed")).alias("nodes_live"))
    objects = catalog.agg(F.count("*").alias("objects_total"), *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS))
    ratio = F.when(F.col("shards_total") > 0, F.round((1 - F.col("shards_unique") / F.col("shards_total")) * 100, 2)).otherwise(0.0)
    return objects.crossJoin(planned).crossJoin(unique).crossJoin(cluster).withColumn("dedup_percent", ratio)  # one row each


def prometheus(stats: DataFrame, names: list[str], prefix: str = "fragmenta") -> DataFrame:
    """Gauges as text lines, one for each of the named columns."""
    lines = F.explode(F.array(*(F.concat(F.lit(f"{prefix}_{n} "), F.col(n).cast("string")) for n in names)))
    return stats.select(lines.alias("line"))


def cards(catalog: DataFrame, layers: DataFrame) -> DataFrame:
    """What a catalog page shows of each entry: name, kind, type, number of fragments, first digits of its content id."""
    total = layers.dropDuplicates(["object_id", "layer"]).groupBy("object_id").agg(F.sum("n_shards").alias("n"))
    rows = catalog.join(total, "object_id", "left")
    return rows.select(F.col("path").alias("name"), "kind", "content_type", F.coalesce(F.col("n") * F.col("channels"), F.lit(0)).alias("n_shards"), F.substring(F.lower(F.hex("data_cid")), 1, 12).alias("cid"))


def insert_shards(shards: DataFrame, rows: DataFrame) -> DataFrame:
    """The new rows among `rows`: a fragment that a node holds under its key already is not stored again."""
    key = ["node", "object_id", "channel", "layer", "hash"]
    return rows.dropDuplicates(key).join(shards.select(*key), key, "left_anti").select(rows.columns)
