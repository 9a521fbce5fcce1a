"""Quality by compression: how much better a dictionary of good text packs a document than one of bad text.

Two zstandard dictionaries are trained on samples of good and bad labelled text. A document is compressed in
blocks of fixed size with either, and its sizes, normalised by its length, are calibrated to a
probability by a logistic regression on a third sample.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from .common import free, text_slices
from .sampling import Logistic, examples, labelled, measured

BLOCK, DICTIONARY, LEVEL = 1024, 112 << 10, 3
#: Bounds of the training sample: documents per label for the dictionaries, documents to calibrate on, characters of each for the dictionaries, blocks for a dictionary.
PER_CLASS, MIXED, CHARS, BLOCKS = 600, 3500, 20_000, 8000


def blocks(text: str | None) -> list[bytes]:
    data = (text or "").encode()
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


@dataclass
class Model:
    """Dictionaries and calibration; without these (too few labels) the share of label 1."""

    share: float = 0.5
    good: bytes | None = None
    bad: bytes | None = None
    calibrate: Logistic | None = None

    def compressors(self):
        out = []
        for data in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def scores(self, texts: list[str | None], compressors=None) -> np.ndarray:
        if self.calibrate is None:
            return np.full(len(texts), self.share)
        return self.calibrate(sizes(texts, *(compressors or self.compressors()))) if texts else np.empty(0)


def sizes(texts: list[str | None], good, bad) -> np.ndarray:
    """Normalised compressed sizes of each text: difference by length and by size, either size, blocks by length. Empty text counts as one byte."""
    rows = []
    for text in texts:
        parts = blocks(text)
        n = max(sum(map(len, parts)), 1)
        g, b = sum(len(good.compress(x)) for x in parts), sum(len(bad.compress(x)) for x in parts)
        rows.append(((b - g) / n, (b - g) / max(g, b, 1), g / n, b / n, 100 * len(parts) / n))
    return np.array(rows, dtype=float).reshape(-1, 5)


def train(sample: dict[str, list[str]]) -> Model:
    """The dictionaries of good ("1") and bad ("0") texts; no calibration yet."""
    data = []
    for kind in ("1", "0"):
        parts = [x for text in sample[kind] for x in blocks(text)]
        random.Random(5).shuffle(parts)
        try:
            data.append(zstandard.train_dictionary(DICTIONARY, parts[:BLOCKS]).as_bytes())
        except zstandard.ZstdError:  # too little text to train on: the text itself serves
            data.append(b"".join(parts)[-DICTIONARY:] or b"\0" * 8)
    return Model(0.5, *data)


def fit(docs: DataFrame, labels: DataFrame, label: str, out: Column, seed: int = 3) -> Model:
    """Trains on a bounded sample (PER_CLASS, MIXED, CHARS above) of documents with a label that aren't held out.

    Dictionaries are of pieces from anywhere in the texts; the calibration measures whole texts, as scores do.
    """
    sample = labelled(docs, labels, label, out, PER_CLASS, MIXED, seed)
    texts = examples(sample, CHARS, seed)
    if not texts["0"] or not texts["1"]:
        free(sample)
        return Model(1.0 if texts["1"] else 0.0 if texts["0"] else 0.5)
    model = train(texts)
    x, y = measured(sample, lambda part: sizes(part, *model.compressors()))
    free(sample)
    model.share = float(y.mean())
    if 0 < model.share < 1:
        model.calibrate = Logistic(x, y)
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from the threshold on) added.

    Whole texts are compressed; null and empty texts get a score too, that of no blocks. Repeated rows score alike. Without labels of
    both kinds every score is the share of label 1, 0.5 without any. Columns named score or predicted are replaced.
    """
    docs = docs.drop("score", "predicted")
    names, at = docs.columns, docs.columns.index("text")

    def run(batches):
        compressors = model.compressors() if model.calibrate else None
        for batch in batches:
            found = np.clip(np.concatenate([np.empty(0), *(model.scores(texts, compressors) for _, _, texts in text_slices(batch.column(at)))]), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64()), pa.array((found >= threshold).astype("i4"))], names=[*names, "score", "predicted"])

    fields = [T.StructField(f.name, f.dataType) for f in docs.schema]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
