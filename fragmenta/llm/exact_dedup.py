"""Exact dedup by content-defined chunk recipes, in DataFrame functions alone.

A text without white space is cut where its own characters say so. Chunks are brought together once,
by content, which verifies their identifiers; a document then is the ordered list of its chunks'
identifiers, and only these lists are grouped and joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS_BYTES, materialize

#: Chunks have at least 256 and at most 4096 code points, but for a text's last.
LEAST, MOST = 256, 4096


def _letters(rest: int) -> str:
    """A class of the code points below U+0100, without white space, that leave this rest modulo 8.

    Java tests these with one look into a bitmap; a text of others alone is cut at the greatest length.
    """
    return "[" + "".join(f"\\x{{{c:x}}}" for c in range(0x21, 0x100) if c % 8 == rest) + "]"


def chunk_pattern(least: int = LEAST, most: int = MOST) -> str:
    """A chunk ends behind three characters of rests 1, 4 and 5, or 4, 5 and 1 (about one place in 150), or at its greatest length."""
    end = _letters(1) + _letters(4) + _letters(5)
    return f"(?s).{{{least},{most - 3}}}?{end}|.{{1,{most}}}"


def chunk_id(chunk: Column, bits: int = 96) -> Column:
    """96 bits of hash; fewer in tests, to see equal hashes of different chunks."""
    if bits < 32:
        return F.struct(F.lit(0).cast("long").alias("a"), (F.hash(chunk) % (1 << bits)).alias("b"))
    return F.struct(F.xxhash64(chunk).alias("a"), F.hash(chunk).alias("b"))


def dedup_exact(docs: DataFrame, least: int = LEAST, most: int = MOST, bits: int = 96) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; null is empty, and empty texts are equal. The row
    with the most code points in its original text stays, then the smallest doc_id (null last); of rows
    repeated in all of this, one. keep_id is null where that row has no id. Other columns are not read.
    """
    norm = F.coalesce("text", F.lit(""))
    for blank in WS_BYTES.decode():
        norm = F.replace(norm, F.lit(blank))
    texts = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("points"), norm.alias("norm"))
    cut = F.regexp_extract_all("norm", F.lit(chunk_pattern(least, most)), F.lit(0))
    chunked = texts.withColumn("chunks", F.when(F.col("norm") == "", F.array().cast("array<string>")).otherwise(cut))

    # Verified identifiers: all contents of a hash meet here, each moved once, and different ones are counted.
    contents = chunked.select(F.explode("chunks").alias("chunk")).groupBy(chunk_id(F.col("chunk"), bits).alias("id"), "chunk").agg(F.count("*").alias("n"))
    clash = materialize(contents.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "chunk_clashes")

    rows = chunked.withColumns({"row": F.monotonically_increasing_id(), "sha": F.sha2("norm", 256)}).drop("norm")
    if clash.isEmpty():
        recipe = F.transform("chunks", lambda c: F.struct(chunk_id(c, bits).alias("id"), F.lit(0).alias("rank")))
        rows = rows.withColumn("recipe", recipe).drop("chunks")
    else:
        # Different chunks of one hash: a rank by content tells them apart.
        rows = materialize(rows, "chunked")
        ranks = contents.join(clash, "id").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("chunk")) - 1).select("id", "chunk", "rank")
        parts = rows.select("row", F.posexplode("chunks").alias("pos", "chunk")).withColumn("id", chunk_id(F.col("chunk"), bits))
        parts = parts.join(ranks, ["id", "chunk"], "left").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", F.struct("id", F.coalesce("rank", F.lit(0)).alias("rank")).alias("x")))).alias("xs"))
        none = F.array().cast("array<struct<id:struct<a:bigint,b:int>,rank:int>>")
        rows = rows.drop("chunks").join(parts.select("row", F.col("xs.x").alias("recipe")), "row", "left").withColumn("recipe", F.coalesce("recipe", none))
    rows = materialize(rows, "recipes")
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row")))
    groups = materialize(rows.groupBy("recipe").agg(F.count("*").alias("group_size"), best.alias("best")), "recipe_groups")
    return rows.join(groups, "recipe").select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256"))
