"""Manifests: an object's whole description as one binary record, by a layout that is written once and read both ways."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..schema import TAG
from .records import BadRecord, _block, _Reader

# Fixed values of the record: numbers are big-endian; places of these names are their codes.
KINDS = ("image", "text", "audio", "opaque", "directory")
PLACEMENTS = ("round_robin", "rendezvous", "zone_aware")

#: First bytes of a record; the legacy one is read, never written.
MAGIC, LEGACY = (f"{TAG[:4].upper()}-{x}\0".encode() for x in ("M7", "M6"))


class Codec(NamedTuple):
    """write (value, record) and read (reader, record so far); sizes may depend on earlier fields."""

    write: Callable[[object, dict], bytes]
    read: Callable[[_Reader, dict], object]


def number(size: int, signed: bool = False) -> Codec:
    return Codec(lambda v, _: int(v).to_bytes(size, "big", signed=signed), lambda r, _: int.from_bytes(r.take(size), "big", signed=signed))


def code(names: tuple[str, ...]) -> Codec:
    def read(r: _Reader, _: dict) -> str:
        if (at := r.number(1)) >= len(names):
            raise BadRecord(f"unknown code {at}, not among {names}")
        return names[at]

    return Codec(lambda v, _: bytes([names.index(v)]), read)


TEXT = Codec(lambda v, _: _block(v.encode(), 2), lambda r, _: r.block(2).decode())
HASH = Codec(lambda v, _: bytes(v), lambda r, _: r.take(32))


def counted(of: Codec) -> Codec:
    """Any number of values behind their count."""
    return Codec(lambda v, row: len(v).to_bytes(4, "big") + b"".join(of.write(x, row) for x in v), lambda r, row: [of.read(r, row) for _ in range(r.number(4))])


def times(field: str | Callable[[dict], int], of: Codec) -> Codec:
    """As many values as an earlier field says."""
    size = field if callable(field) else lambda row: row[field]

    def write(v, row: dict) -> bytes:
        if len(v) != size(row):
            raise BadRecord(f"{len(v)} values where {size(row)} are due")
        return b"".join(of.write(x, row) for x in v)

    return Codec(write, lambda r, row: [of.read(r, row) for _ in range(size(row))])


#: Fields in the order of the record, with their type as a column.
LAYOUT: tuple[tuple[str, Codec, str, pa.DataType], ...] = (
    ("object_id", number(8, True), "long", pa.int64()),
    ("k", number(2), "int", pa.int32()),
    ("nlayers", number(1), "int", pa.int32()),
    ("channels", number(1), "int", pa.int32()),
    ("width", number(4), "long", pa.int64()),
    ("height", number(4), "long", pa.int64()),
    ("levels", number(1), "int", pa.int32()),
    ("placement", code(PLACEMENTS), "string", pa.string()),
    ("n_per_layer", times("nlayers", number(4)), "array<long>", pa.list_(pa.int64())),
    ("sym_len", times("nlayers", number(4)), "array<long>", pa.list_(pa.int64())),
    ("positions", times("nlayers", counted(number(4))), "array<array<long>>", pa.list_(pa.list_(pa.int64()))),
    ("nodes", counted(TEXT), "array<string>", pa.list_(pa.string())),
    ("zones", times(lambda row: len(row["nodes"]), number(1)), "array<int>", pa.list_(pa.int32())),
    ("data_cid", HASH, "binary", pa.binary()),
    ("merkle_root", HASH, "binary", pa.binary()),
    ("shard_hashes", times("channels", times("nlayers", counted(HASH))), "array<array<array<binary>>>", pa.list_(pa.list_(pa.list_(pa.binary())))),
    ("kind", code(KINDS), "string", pa.string()),
    ("content_type", TEXT, "string", pa.string()),
    ("chunk_lens", counted(number(4)), "array<long>", pa.list_(pa.int64())),
    ("audio_sample_rate", number(4), "long", pa.int64()),
    ("text_minhash", counted(number(4)), "array<long>", pa.list_(pa.int64())),
)
SCHEMA = ", ".join(f"{name} {sql}" for name, _, sql, _ in LAYOUT)


def encode(row: dict, magic: bytes = MAGIC) -> bytes:
    return magic + b"".join(codec.write(row[name], row) for name, codec, _, _ in LAYOUT)


def decode(data: bytes, magics: tuple[bytes, ...] = (MAGIC, LEGACY)) -> dict:
    """The fields of a record; BadRecord for another magic, an unknown kind or placement, or one that ends too early."""
    r, row = _Reader(data, next((m for m in magics if data.startswith(m)), magics[0])), {}
    for name, codec, _, _ in LAYOUT:
        row[name] = codec.read(r, row)
    return row


def encoded(manifests: DataFrame) -> DataFrame:
    """(object_id, record) of manifests, whose columns are those of SCHEMA."""
    names = [name for name, *_ in LAYOUT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_pydict({"object_id": pa.array([x["object_id"] for x in rows], pa.int64()), "record": pa.array([encode(x) for x in rows], pa.binary())})

    return manifests.select(*names).mapInArrow(run, "object_id long, record binary")


def decoded(records: DataFrame, column: str = "record", skip_bad: bool = False) -> DataFrame:
    """Manifests from a column of records; broken ones stop the query or are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(0):
                try:
                    rows.append(decode(x.as_py() or b""))
                except (BadRecord, UnicodeDecodeError):
                    if not skip_bad:
                        raise
            yield pa.RecordBatch.from_arrays([pa.array([x[name] for x in rows], kind) for name, _, _, kind in LAYOUT], names=[name for name, *_ in LAYOUT])

    return records.select(column).mapInArrow(run, SCHEMA)


def read_manifests(spark: SparkSession, folder: str, pattern: str = "*", skip_bad: bool = False) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return decoded(files, "content", skip_bad)
