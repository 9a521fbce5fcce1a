"""Line dedup: lines that many documents hold are dropped everywhere.

Lines are exploded to 128-bit hashes of their normalised form, documents are counted per hash, the
hashes over the threshold go back to the documents that hold them, and each text is put together
again by position. Only hashes are shuffled by line; each text moves once, by its document.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from .common import WS_BYTES, fresh, materialize, text_slices


def _key(line: bytes, min_chars: int) -> bytes | None:
    """Hash of a line stripped of white space, A-Z in lower case (bytes.lower() leaves other letters); None if too short."""
    line = line.strip(WS_BYTES).lower()
    if len(line) < min_chars or len(line) < 4 * min_chars and len(line.decode()) < min_chars:
        return None
    return xxh3_128_digest(line)


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, key): the keys of each row's lines, once a row."""

    def keys(batches):
        for batch in batches:
            ids, out_ids, out = batch.column(0).to_pylist(), [], []
            for i, text in zip(ids, batch.column(1)):
                raw = text.as_py()
                found = {_key(x, min_chars) for x in raw.encode().split(b"\n")} if raw else ()
                for k in found:
                    if k is not None:
                        out_ids.append(i)
                        out.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(out_ids, batch.schema.field(0).type), pa.array(out, pa.binary())], names=["doc_id", "key"])

    kind = docs.schema["doc_id"].dataType
    return docs.select("doc_id", "text").mapInArrow(keys, T.StructType([T.StructField("doc_id", kind), T.StructField("key", T.BinaryType())]))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with the lines dropped whose key at least min_docs documents hold.

    The text is replaced, and n_lines (before) and n_dropped are added, in place of columns of these names; other columns stay as they are.
    Null or empty text is one empty line, kept, as ''. Rows that share a doc_id count as one document;
    so do rows without one. Keys of fewer than min_chars code points are never dropped. A text all of
    whose lines go is ''. An empty table gives an empty table.
    """
    docs = docs.drop("n_lines", "n_dropped")
    own, dropped = fresh("id", docs.columns), fresh("hot", docs.columns)
    pairs = materialize(line_keys(docs, min_chars), "line_keys")
    holders = pairs.groupBy("key", "doc_id").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("n"))
    hot = materialize(holders.filter(F.col("n") >= min_docs).select("key"), "hot_lines")
    by_doc = pairs.join(hot, "key").groupBy("doc_id").agg(F.collect_set("key").alias(dropped)).withColumnRenamed("doc_id", own)
    joined = docs.join(by_doc, docs.doc_id.eqNullSafe(by_doc[own]), "left").drop(own)
    names, at = docs.columns, docs.columns.index("text")

    def kept(batches):
        for batch in batches:
            for a, b, texts in text_slices(batch.column(at)):
                part = batch.slice(a, b - a)
                n_lines, n_dropped, out = [], [], []
                for text, drop in zip(texts, part.column(len(names)).to_pylist()):
                    if not drop or not text:
                        out.append(text or "")
                        n_lines.append((text or "").count("\n") + 1)
                        n_dropped.append(0)
                        continue
                    drop = set(drop)
                    lines = text.encode().split(b"\n")
                    keep = [x for x in lines if (k := _key(x, min_chars)) is None or k not in drop]
                    out.append(b"\n".join(keep).decode())
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(keep))
                columns = [part.column(i) if i != at else pa.array(out, pa.string()) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    fields = [T.StructField(f.name, f.dataType) for f in docs.schema]
    schema = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.select(*names, dropped).mapInArrow(kept, schema)

