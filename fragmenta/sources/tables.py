"""The driver's tables, read as the data model's: objects, nodes, fragments, audit logs and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, or an empty one where nothing is stored yet. While a new one is being put in its place, or was not because the writer died, the old one counts."""
    fs, at = _files(spark, path)
    for there in (path, f"{path}.old", path):  # the new one may come, and the old one go, between the first two looks
        if fs.exists(at(there)):
            return spark.read.schema(schema).parquet(there)
    return empty(spark, schema)


def write_atomic(df: DataFrame, path: str) -> None:
    """Writes beside the table, then puts the new folder in its place; read_or_empty finds the old or the new one whenever the writer is stopped.

    One writer at a time. What reads the old table's files while they go has to be run again.
    """
    fs, at = _files(df.sparkSession, path)
    new, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(new)
    if fs.exists(at(path)):
        # Without the table itself, the old one is the only copy and stays.
        fs.delete(at(old), True)
        if not fs.rename(at(path), at(old)):
            raise OSError(f"can't move {path}")
    if not fs.rename(at(new), at(path)):
        raise OSError(f"can't move {new}")
    fs.delete(at(old), True)


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text objects: doc_id, path, text, kind (their language)."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat("lang", F.lit("/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select("doc_id", path.alias("path"), "text", F.col("lang").alias("kind"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as nodes, in the zone of their nation's region; one in debt is taken out of service."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("supplier").join(F.broadcast(t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("s_suppkey").cast("int").alias("node"), F.col("s_name").alias("addr"), F.col("n_regionkey").cast("int").alias("zone"), (F.col("s_acctbal") < 0).alias("admin_killed"))


def planned_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as fragments of orders: object_id, channel 0, layer, node, lost."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("object_id"), F.lit(0).alias("channel"), F.pmod(F.col("l_linenumber") - 1, F.lit(4)).cast("int").alias("layer"), F.col("l_suppkey").cast("int").alias("node"), (F.col("l_returnflag") == "R").alias("lost"))


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations of nodes: seq, ts, node, success."""
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("node"), (F.col("event_type") != "error").alias("success"), "event_type")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as signals of one channel."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(0).alias("channel"), F.col("embedding").alias("values"))


def sketched(objects: DataFrame) -> DataFrame:
    return objects.withColumn("sketch", hashing.minhash("text")).drop("text")
