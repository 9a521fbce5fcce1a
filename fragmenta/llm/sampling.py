"""Bounded samples of labelled documents for training on the driver."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, text_slices


#: Characters of a piece of a text that is longer than the bound.
PIECE = 1000


def labelled(docs: DataFrame, labels: DataFrame, label: str, out: Column, per_class: int, mixed: int, seed: int) -> DataFrame:
    """(kind, o, doc_id, y, text) of labelled documents with whole texts, as a written table.

    At most per_class documents of each label (kinds 0 and 1) and `mixed` of both as they come, of the rows whose id isn't
    held out (`out` over doc_id). These bounds hold at every size; (o, doc_id) is a fixed random order. Null labels are
    left out; of rows that share an id the smallest text and label count; null texts are empty.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~out).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"))
    pick = lambda df, kind, n: df.withColumn("o", F.xxhash64(F.lit(f"{seed} {kind}"), "doc_id")).orderBy("o", "doc_id").limit(n).select("doc_id", "y", F.lit(kind).alias("kind"), "o")
    parts = [*(pick(known.filter(F.col("y") == y), str(y), per_class) for y in (0, 1)), pick(known, "mixed", mixed)]
    sample = parts[0].unionByName(parts[1]).unionByName(parts[2])
    # Bounded by the parameters above, so it can be sent to all executors.
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    return materialize(found.groupBy("kind", "o", "doc_id", "y").agg(F.min("text").alias("text")), "labelled")


def pieces(text: str, chars: int, seed: str) -> str:
    """The text, or of a longer one as many pieces from anywhere in it, in order, as `chars` characters hold."""
    if len(text) <= chars:
        return text
    step = min(PIECE, chars)
    starts = range(0, len(text), step - 1)
    chosen = sorted(random.Random(seed).sample(starts, min(chars // step, len(starts))))
    return "\n".join(text[i : i + step - 1] for i in chosen)


def examples(sample: DataFrame, chars: int, seed: int) -> dict[str, list[str]]:
    """Texts of kinds 0 and 1, cut to pieces of `chars` characters together, in their fixed order."""
    schema = sample.select("kind", "o", "doc_id", "text").schema

    def run(batches):
        for batch in batches:
            kind, o, doc_id, text = batch.columns
            cut = [pieces(t, chars, f"{seed} {i}") for t, i in zip(text.to_pylist(), o.to_pylist())]
            yield pa.RecordBatch.from_arrays([kind, o, doc_id, pa.array(cut, pa.string())], names=schema.names)

    rows = sample.filter("kind <> 'mixed'").select(schema.names).mapInArrow(run, schema).collect()
    out: dict[str, list[str]] = {"0": [], "1": []}
    for r in sorted(rows, key=lambda r: (r.o, r.doc_id)):
        out[r.kind].append(r.text)
    return out


def measured(sample: DataFrame, measure) -> tuple[np.ndarray, np.ndarray]:
    """Features of whole texts of kind mixed, a row each, and their labels, in their fixed order; measure maps texts to rows of features."""
    schema = T.StructType([*sample.select("o", "doc_id", "y").schema, T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            *head, text = batch.columns
            x = []
            for _, _, texts in text_slices(text):
                x += measure(texts).tolist()
            yield pa.RecordBatch.from_arrays([*head, pa.array(x, pa.list_(pa.float64()))], names=schema.names)

    rows = sample.filter("kind = 'mixed'").select("o", "doc_id", "y", "text").mapInArrow(run, schema).collect()
    rows.sort(key=lambda r: (r.o, r.doc_id))
    return np.array([r.x for r in rows], dtype=float), np.array([r.y for r in rows], dtype=float)


class Logistic:
    """Logistic regression over the products of up to two features, with standardised columns and an L2 penalty."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, square: bool = True):
        self.square = square
        wide = self._wide(x)
        self.mean, self.scale = wide.mean(axis=0), wide.std(axis=0) + 1e-9
        self.mean[0], self.scale[0] = 0, 1
        a, w = (wide - self.mean) / self.scale, np.zeros(wide.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty * np.eye(len(w)), a.T @ (p - y) + penalty * w)
            w -= step * min(1, 5 / max(np.abs(step).max(), 1e-12))
        self.w = w

    def _wide(self, x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        more = [x[:, i] * x[:, j] for i in range(n) for j in range(i, n)] if self.square else []
        return np.column_stack([np.ones(len(x)), x, *more])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self._wide(x) - self.mean) / self.scale @ self.w, -30, 30)))
