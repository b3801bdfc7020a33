"""Object transport frames: a 128-byte header, then the compressed body.

Header: a magic of 8 bytes, the raw length as a little-endian number of 8
bytes, the SHA-256 of the raw bytes, zeros.  The body is one zstandard frame.
"""

from __future__ import annotations

import hashlib
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER = 128
LEVEL = 3


def encode(magic: bytes):
    """Column function: bytes to a frame; null stays null."""
    if len(magic) != 8:
        raise ValueError("the magic has 8 bytes")

    @F.pandas_udf("binary")
    def run(data: pd.Series) -> pd.Series:
        import zstandard

        engine = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=True)

        def frame(x: bytes | None) -> bytes | None:
            if x is None:
                return None
            x = bytes(x)
            return (magic + struct.pack("<Q", len(x)) + hashlib.sha256(x).digest()).ljust(HEADER, b"\0") + engine.compress(x)

        return data.map(frame, na_action="ignore")

    return run


def decode(magic: bytes):
    """Column function: a frame to (data, error); damage is named, never passed on."""

    @F.pandas_udf("data binary, error string")
    def run(frames: pd.Series) -> pd.DataFrame:
        import zstandard

        engine = zstandard.ZstdDecompressor()

        def one(x: bytes | None) -> tuple[bytes | None, str | None]:
            if x is None:
                return None, None
            x = bytes(x)
            if len(x) < HEADER or x[:8] != magic:
                return None, "header"
            size = struct.unpack("<Q", x[8:16])[0]
            try:
                data = engine.decompress(x[HEADER:], max_output_size=size)
            except zstandard.ZstdError:
                return None, "frame"
            if len(data) != size:
                return None, "length"
            return (data, None) if hashlib.sha256(data).digest() == x[16:48] else (None, "digest")

        return pd.DataFrame([one(x) for x in frames], columns=["data", "error"])

    return run


def encrypted(frame: Column, key: Column, iv: Column, bound_to: Column) -> Column:
    """AES-GCM over a frame, bound to the object's id."""
    return F.aes_encrypt(frame, key, F.lit("GCM"), F.lit("DEFAULT"), iv, bound_to)


def decrypted(data: Column, key: Column, bound_to: Column) -> Column:
    return F.aes_decrypt(data, key, F.lit("GCM"), F.lit("DEFAULT"), bound_to)
