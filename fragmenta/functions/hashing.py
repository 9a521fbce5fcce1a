"""Content ids, fragment hashes, Merkle trees and FNV-1a."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import SHINGLE, SKETCH, TAG

# Fixed values of FNV-1a over 32 bits.
FNV_SEED, FNV_PRIME = 0x811C9DC5, 0x01000193


def tag(kind: str) -> Column:
    """Every hash starts with the kind of thing it is of, ended by a zero byte."""
    return F.to_binary(F.lit((f"{TAG}-{kind}-v1\0").encode().hex()), F.lit("hex"))


def big_endian(value: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def sha256_hex(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def shard_hash(coeffs: Column, payload: Column) -> Column:
    """Hex hash of a fragment: tag, lengths (2 and 4 bytes), coefficients, payload."""
    return sha256_hex(tag("shard"), big_endian(F.octet_length(coeffs), 2), big_endian(F.octet_length(payload), 4), coeffs, payload)


def text_cid(text: Column, mime: Column) -> Column:
    return sha256_hex(tag("text"), F.encode(text, "utf-8"), F.encode(mime, "utf-8"))


def opaque_cid(mime: Column, body: Column) -> Column:
    return sha256_hex(tag("opaque"), F.encode(mime, "utf-8"), body)


def escrow_id(k: Column, n: Column, mime: Column, data: Column) -> Column:
    """First half names the escrow, the next eight bytes seed its coefficients."""
    return sha256_hex(tag("escrow"), big_endian(k, 4), big_endian(n, 4), F.encode(mime, "utf-8"), data)


def object_id(cid_hex: Column) -> Column:
    """First eight bytes of a content id as a signed long."""
    return F.conv(F.substring(cid_hex, 1, 16), 16, -10).cast("long")


def directory_id(path: Column) -> Column:
    return object_id(sha256_hex(tag("dir"), F.encode(path, "utf-8")))


def signal_cid(planes: list[np.ndarray], width: int, height: int, levels: int, k: int) -> bytes:
    """Content id of float32 planes: tag, channels, size, levels, k, samples in little endian."""
    h = hashlib.sha256(f"{TAG}-signal-v1\0".encode() + struct.pack(">BIIBH", len(planes), width, height, levels, k))
    for p in planes:
        h.update(np.asarray(p, "<f4").tobytes())
    return h.digest()


def audio_cid(planes: list[np.ndarray], k: int, mime: str) -> bytes:
    n = len(planes[0]) if planes else 0
    return hashlib.sha256(f"{TAG}-audio-v1\0".encode() + struct.pack(">HQB", k, n, len(planes)) + mime.encode() + b"".join(np.asarray(p, "<f4").tobytes() for p in planes)).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Binary tree over hashes; an odd last one is paired with itself, none give zeros, one is its own root."""
    level = list(leaves)
    if not level:
        return bytes(32)
    pair = f"{TAG}-pair-v1\0".encode()
    while len(level) > 1:
        level = [hashlib.sha256(pair + a + b).digest() for a, b in zip(level[::2], [*level[1::2], *level[-1:][: len(level) % 2]])]
    return level[0]


def merkle_root_hex(leaves: Column) -> Column:
    """Root over an ordered array of hex hashes, level by level; null for a null array."""

    def level(a: Column) -> Column:
        both = lambda i: F.concat(F.unhex(F.get(a, 2 * i)), F.unhex(F.coalesce(F.get(a, 2 * i + 1), F.get(a, 2 * i))))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 2).cast("int")), lambda i: sha256_hex(tag("pair"), both(i)))

    levels = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(F.size(leaves))).cast("int"), F.lit(1)))
    root = F.aggregate(levels, leaves, lambda a, _: F.when(F.size(a) > 1, level(a)).otherwise(a))
    return F.when(F.size(leaves) == 0, "00" * 32).when(leaves.isNotNull(), F.get(root, F.lit(0)))


def fnv1a(data: bytes) -> int:
    h = FNV_SEED
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFF
    return h


def sketch(text: str | None, size: int = SHINGLE, k: int = SKETCH) -> np.ndarray:
    """The k smallest distinct hashes of a text's byte shingles; a shorter text is one shingle, an empty one none."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    if not len(raw):
        return np.empty(0, np.int64)
    if len(raw) < size:
        return np.array([fnv1a(raw.tobytes())])
    h = np.full(len(raw) - size + 1, FNV_SEED, np.uint64)
    for i in range(size):
        h = ((h ^ raw[i : len(raw) - size + 1 + i]) * np.uint64(FNV_PRIME)) & np.uint64(0xFFFFFFFF)
    return np.unique(h)[:k].astype(np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def minhash(text: pd.Series) -> pd.Series:
    return text.map(sketch)


def jaccard(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimate from two sketches: of the union's smallest, as many as the smaller sketch has, the share in both; 0 if either is empty."""
    n = F.least(F.lit(k), F.size(a), F.size(b))
    both = F.slice(F.array_sort(F.array_union(a, b)), 1, n)
    shared = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(n > 0, shared / F.size(both)).otherwise(0.0)


def sketch_preview(a: Column, n: int = 8) -> Column:
    """First values in hex; more are hinted at."""
    shown = F.array_join(F.transform(F.slice(a, 1, n), lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), " ")
    return F.concat(shown, F.when(F.size(a) > n, " …").otherwise(""))
