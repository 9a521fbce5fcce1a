"""Binary records of the store: fragments, shares and whitelists, written and read in Arrow batches."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import shard_hash
from ..schema import SHARES, TAG

SHARD_MAGIC, SHARE_MAGIC, LIST_MAGIC = (f"{TAG[:4].upper()}-{x}".encode() for x in ("S1", "E1", "W1"))


class BadRecord(ValueError):
    """A record with another magic, or that ends too early or too late."""


class _Reader:
    def __init__(self, data: bytes, magic: bytes):
        if not data.startswith(magic):
            raise BadRecord("another magic")
        self.data, self.at = data, len(magic)

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise BadRecord("truncated")
        self.at += n
        return out

    def number(self, size: int) -> int:
        return int.from_bytes(self.take(size), "big")

    def block(self, size: int) -> bytes:
        return self.take(self.number(size))


def _block(data: bytes, size: int) -> bytes:
    return len(data).to_bytes(size, "big") + data


def encode_shard(object_id: int, channel: int, layer: int, coeffs: bytes, payload: bytes) -> bytes:
    return SHARD_MAGIC + struct.pack(">qBB", object_id, channel, layer) + _block(coeffs, 2) + _block(payload, 4)


def decode_shard(data: bytes) -> tuple[int, int, int, bytes, bytes]:
    r = _Reader(data, SHARD_MAGIC)
    return (*struct.unpack(">qBB", r.take(10)), r.block(2), r.block(4))


def encode_share(escrow_id: bytes, idx: int, n: int, k: int, real_len: int, mime: str, name: str, coeffs: bytes, payload: bytes) -> bytes:
    head = escrow_id + struct.pack(">IIIQ", idx, n, k, real_len)
    return SHARE_MAGIC + head + _block((mime or "").encode(), 2) + _block((name or "").encode(), 2) + _block(coeffs, 2) + _block(payload, 4)


def decode_share(data: bytes) -> tuple:
    r = _Reader(data, SHARE_MAGIC)
    return (r.take(16), *struct.unpack(">IIIQ", r.take(20)), r.block(2).decode(), r.block(2).decode(), r.block(2), r.block(4))


def encode_whitelist(entries: list[tuple[str, bytes, int]]) -> bytes:
    """(addr, 32-byte key, zone) of each node."""
    return LIST_MAGIC + len(entries).to_bytes(4, "big") + b"".join(_block(a.encode(), 2) + key + bytes([zone]) for a, key, zone in entries)


def decode_whitelist(data: bytes) -> list[tuple[str, bytes, int]]:
    r = _Reader(data, LIST_MAGIC)
    out = [(r.block(2).decode(), r.take(32), r.number(1)) for _ in range(r.number(4))]
    if r.at != len(data):
        raise BadRecord("trailing bytes")
    return out


def _decoded(files: DataFrame, decode: Callable[[bytes], tuple], kinds: list[pa.DataType], schema: str, skip_bad: bool) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(0):
                try:
                    rows.append(decode(x.as_py()))
                except (BadRecord, UnicodeDecodeError):
                    if not skip_bad:
                        raise
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return files.select("content").mapInArrow(run, schema)


def read_shards(spark: SparkSession, folder: str, pattern: str = "*.shard", skip_bad: bool = True) -> DataFrame:
    """Fragments under a folder of files, hashed again; files that are broken are skipped or stop the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    rows = _decoded(files, decode_shard, [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()], "object_id long, channel int, layer int, coeffs binary, payload binary", skip_bad)
    return rows.withColumn("hash", shard_hash(F.col("coeffs"), F.col("payload")))


def read_shares(spark: SparkSession, folder: str, pattern: str = "*.share", skip_bad: bool = True) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]
    return _decoded(files, decode_share, kinds, SHARES, skip_bad)


def discovered(nodes: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Nodes (node, addr, ping_ok, auth_ok) that are listed, answer and prove who they are; of entries of one address the first by key counts."""
    first = whitelist.groupBy("addr").agg(F.min_by("zone", "key").alias("listed_zone"))
    return nodes.join(F.broadcast(first), "addr").filter("ping_ok and auth_ok")
