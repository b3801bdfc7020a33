"""Key derivation and part digests."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PART = 4 * 1024 * 1024
ROUNDS = 600_000


def part_digests(data: Column, part: int = PART) -> Column:
    """MD5 of every part of a BINARY, in order; one part for an empty one."""
    count = F.greatest(F.ceil(F.octet_length(data) / part), F.lit(1))
    return F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda k: F.md5(data.substr((k * part + 1).cast("int"), F.lit(part))))


def derive_key(rounds: int = ROUNDS, length: int = 32):
    """Column function (password, salt): PBKDF2 with HMAC-SHA-256; null if either is."""

    @F.pandas_udf("binary")
    def run(password: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or s is None else hashlib.pbkdf2_hmac("sha256", p.encode(), bytes(s), rounds, length) for p, s in zip(password, salt, strict=True)])

    return run


def sign(key: bytes):
    """Column function: HMAC-SHA-256 of a BINARY in hex; null stays null."""

    @F.pandas_udf("string")
    def run(data: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else hmac.new(key, bytes(d), "sha256").hexdigest() for d in data])

    return run
