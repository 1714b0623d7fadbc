"""Unsigned integers as compressed planes of bytes."""

from __future__ import annotations

import struct

import numpy as np
import zstandard


def pack(values: np.ndarray) -> bytes:
    values = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return struct.pack("<IB", len(values), width) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<IB", blob)
    raw = zstandard.ZstdDecompressor().decompress(blob[5:], max_output_size=max(1, n * width))
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()
