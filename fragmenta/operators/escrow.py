"""K-of-N escrow: secrets split into coded shares and recovered from any K of them. The first K shares hold the data in the clear."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.galois import MUL, combine, inverse
from ..functions.rng import XorShift
from ..schema import MOST_SHARES, SHARES, TAG
from .coding import decode, split_symbols


def identity(k: int, n: int, mime: str, data: bytes) -> tuple[bytes, int]:
    """An escrow's id and the seed of its coefficients; its file name doesn't matter."""
    h = hashlib.sha256(f"{TAG}-escrow-v1\0".encode() + k.to_bytes(4, "big") + n.to_bytes(4, "big") + mime.encode() + data).digest()
    return h[:16], int.from_bytes(h[16:24], "big")


def draw(k: int, n: int, rng: XorShift) -> np.ndarray:
    """Coefficients of n <= 256 shares of which any k are independent: unit vectors, then a Cauchy matrix at drawn points with drawn factors."""
    points = list(range(256))
    for i in range(n):
        j = i + rng.byte() % (256 - i)
        points[i], points[j] = points[j], points[i]
    factor = np.array([1 + rng.byte() % 255 for _ in range(n)])
    out = np.zeros((n, k), np.uint8)
    out[range(k), range(k)] = 1
    for i in range(k, n):
        out[i] = [MUL[MUL[factor[i], factor[j]], inverse(points[i] ^ points[j])] for j in range(k)]
    return out


def split(secrets: DataFrame, k: int, n: int) -> DataFrame:
    """n shares of each secret (data, content_type, filename), any row to n rows."""
    if not 1 <= k <= n <= MOST_SHARES:
        raise ValueError(f"1 <= k <= n <= {MOST_SHARES} does not hold for k={k}, n={n}")

    def run(batches):
        for batch in batches:
            for data, mime, name in zip(*(batch.column(i).to_pylist() for i in range(3))):
                escrow, seed = identity(k, n, mime or "", data)
                coeffs = draw(k, n, XorShift(seed))
                payload = combine(coeffs, split_symbols(data, k))
                rows = [(escrow, i, n, k, len(data), mime, name, c.tobytes(), p.tobytes()) for i, (c, p) in enumerate(zip(coeffs, payload))]
                kinds = (pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in SHARES.split(", ")])

    return secrets.select("data", "content_type", "filename").mapInArrow(run, SHARES)


def recover(shares: DataFrame) -> DataFrame:
    """(escrow_id, data, error) from the shares at hand, in the order of `pos` if there is one.

    Of shares with one index the first counts, and of these the first k. Errors: MixedParameters, NotEnough, Dependent.
    """
    pos = F.col("pos") if "pos" in shares.columns else F.col("shard_idx")
    first = shares.withColumn("pos", pos).withColumn("turn", F.row_number().over(Window.partitionBy("escrow_id", "shard_idx").orderBy("pos"))).filter("turn = 1")
    first = first.withColumn("nth", F.row_number().over(Window.partitionBy("escrow_id").orderBy("pos"))).filter(F.col("nth") <= MOST_SHARES)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("nth")
        k, out, error = int(pdf["total_k"].iloc[0]), None, None
        if pdf["total_k"].nunique() > 1 or pdf["total_n"].nunique() > 1:
            error = "MixedParameters"
        elif len(pdf) < k:
            error = "NotEnough"
        else:
            rows = [np.array([np.frombuffer(x, np.uint8) for x in pdf[c].iloc[:k]]) for c in ("coeffs", "payload")]
            found = decode(*rows, k)
            out, error = (None, "Dependent") if found is None else (found.tobytes()[: int(pdf["real_len"].iloc[0])], None)
        return pd.DataFrame({"escrow_id": [pdf["escrow_id"].iloc[0]], "data": [out], "error": [error]})

    return first.groupBy("escrow_id").applyInPandas(run, "escrow_id binary, data binary, error string")
