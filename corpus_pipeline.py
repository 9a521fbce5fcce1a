"""From raw documents to encoded training text, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a DataFrame that is written as
Parquet and read again for the next. All but the last return the columns of documents, and any others that they are given, whatever these are
called. Null texts count as empty; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmenta.llm import bpe, quality
from fragmenta.llm.common import aside, fresh, held_out, materialize, table
from fragmenta.llm.line_dedup import dedup_lines
from fragmenta.llm.minhash_dedup import near_duplicates
from fragmenta.llm.mixing import ADDED, mix
from fragmenta.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts; it learns from the labels that aren't held out."""
    labels = table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, "quality", held_out(F.col("doc_id"), 5, 0))
    own, names = aside(docs, ("score", "predicted"))
    return quality.score(own, model).filter("predicted = 1").drop("score", "predicted").withColumnsRenamed(names).select(docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least ten of them hold; n_chars is counted again."""
    own, names = aside(docs, ("n_lines", "n_dropped"))
    out = dedup_lines(own).drop("n_lines", "n_dropped").withColumnsRenamed(names)
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out).select(docs.columns)


#: Share of a sketch that two documents must agree on: at a similarity of 0.8 fewer than 15 of 32 do in less than one of 10^5 pairs.
AGREE = 0.46


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard of 0.8 over runs of five words), that of the smallest id; of rows that repeat its id, one."""
    kept = near_duplicates(docs, words=5, percent=80, agree=AGREE).filter("kept").select("doc_id").distinct()
    known = docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi").select(docs.columns)
    repeated = materialize(known.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "repeated_ids")
    if not repeated.isEmpty():
        row = fresh("row", docs.columns)
        once = known.join(repeated, "doc_id", "left_semi")
        once = once.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias(row)).select(f"{row}.*")
        known = known.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(once)
    return known.unionByName(docs.filter("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    own, names = aside(docs, ADDED)
    mixed = mix(own, F.array("source")).filter("copies > 0")
    again = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(fresh("again", mixed.columns))
    return mixed.select("*", again).drop(*ADDED).withColumnsRenamed(names).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the ids of the text, with their number."""
    encoded = bpe.encode(docs.select("doc_id", "source", "text"), tokenizer_path())
    return encoded.select("doc_id", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [("quality classifier", keep_quality), ("line dedup", drop_common_lines), ("near-duplicate documents", drop_near_duplicates), ("mixing sources", mix_sources), ("BPE encoding", encode)]

#: A compression classifier is beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
