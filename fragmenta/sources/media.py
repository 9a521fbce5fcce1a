"""Media in and out: WAV and PNG by the standard library, synthetic planes, resampling and thumbnails."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def encode_wav(channels: list[np.ndarray], rate: int) -> bytes:
    """16-bit PCM: clamped samples times 32767, cut to whole numbers, interleaved."""
    data = np.stack([np.trunc(np.clip(np.asarray(c, np.float32), -1, 1) * np.float32(32767)).astype("<i2") for c in channels], axis=1).tobytes()
    n = len(channels)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, n, rate, rate * n * 2, n * 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def decode_wav(data: bytes) -> tuple[list[np.ndarray], int]:
    """Samples from -1 to 1 and the rate; of more than two channels the even ones are averaged to the left, the odd ones to the right."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no WAV")
    at, form, body = 12, None, b""
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        part = data[at + 8 : at + 8 + size]
        form, body = (struct.unpack("<HHIIHH", part[:16]), body) if kind == b"fmt " else (form, part if kind == b"data" else body)
        at += 8 + size + size % 2
    if form is None:
        raise ValueError("no format")
    code, n, rate, _, _, bits = form
    if code == 3:
        x = np.frombuffer(body, f"<f{bits // 8}").astype(np.float32)
    elif bits == 8:
        x = (np.frombuffer(body, np.uint8).astype(np.float32) - 128) / 128
    elif bits == 24:
        raw = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((raw[:, 2] << 24) | (raw[:, 1] << 16) | (raw[:, 0] << 8)) >> 8).astype(np.float32) / 8388608
    else:
        x = np.frombuffer(body, f"<i{bits // 8}").astype(np.float32) / float(1 << (bits - 1))
    x = x[: len(x) // n * n].reshape(-1, n)
    return ([x[:, i] for i in range(n)] if n <= 2 else [x[:, ::2].mean(axis=1), x[:, 1::2].mean(axis=1)]), rate


def encode_png(pixels: np.ndarray) -> bytes:
    """8-bit gray (h, w) or colour (h, w, 3)."""
    h, w = pixels.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), pixels.astype(np.uint8).reshape(h, -1)], axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def to_pixels(planes: list[np.ndarray], width: int, height: int) -> np.ndarray:
    return np.stack([np.clip(np.rint(np.asarray(p).reshape(height, width)), 0, 255) for p in planes], axis=2).astype(np.uint8)


def thumbnail(data: bytes) -> np.ndarray:
    """Bytes as a square of gray pixels, filled up with zeros."""
    side = max(1, math.isqrt(len(data) - 1) + 1 if data else 1)
    out = np.zeros(side * side, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(side, side)


def fit_square(pixels: np.ndarray, width: int, height: int) -> list[np.ndarray]:
    """Planes of the middle square, averaged by boxes, or the nearest pixel where the frame is finer."""
    h, w = pixels.shape[:2]
    side = min(h, w)
    square = pixels[(h - side) // 2 : (h - side) // 2 + side, (w - side) // 2 : (w - side) // 2 + side].astype(np.float64)
    cut = lambda n: [(i * side // n, max((i + 1) * side // n, i * side // n + 1)) for i in range(n)]
    ys, xs = cut(height), cut(width)
    return [np.array([[square[a:b, c:d, ch].mean() for c, d in xs] for a, b in ys], np.float32).ravel() for ch in range(3)]


def synthetic(spark: SparkSession, width: int, height: int) -> DataFrame:
    """A smooth test pattern as rows (channel, y, x, value) from 0 to 255, of rings, rays and a ramp."""
    i = spark.range(width * height).select((F.col("id") % width).alias("x"), F.floor(F.col("id") / width).alias("y"))
    dx, dy = F.col("x") / width - 0.5, F.col("y") / height - 0.5
    r, a = F.sqrt(dx * dx + dy * dy), F.atan2(dy, dx)
    value = F.when(F.col("channel") == 0, 127.5 + 127.5 * F.sin(40 * r)).when(F.col("channel") == 1, 127.5 + 127.5 * F.cos(8 * a)).otherwise(255.0 * F.col("x") / width)
    return i.crossJoin(F.broadcast(spark.range(3).select(F.col("id").cast("int").alias("channel")))).select("channel", "y", "x", value.alias("value"))
