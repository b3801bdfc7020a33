"""Runs of a mapped stream in their packed binary form.

Each run starts with a byte: its low half is the width of the length, its high
half the width of the signed change of position (0: a hole); a zero byte ends
the list.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

SCHEMA = "array<struct<vcn: bigint, length: bigint, lcn: bigint>>"


def parse(data: bytes) -> list[tuple[int, int, int | None]] | None:
    """(vcn, length, lcn) of every run; None for a list that is cut short, empty or negative."""
    runs, at, vcn, lcn = [], 0, 0, 0
    while True:
        if at >= len(data):
            return None
        if not data[at]:
            return runs or None
        width, move = data[at] & 15, data[at] >> 4
        end = at + 1 + width + move
        length = int.from_bytes(data[at + 1 : at + 1 + width], "little")
        if not 1 <= width <= 8 or move > 8 or end > len(data) or not 0 < length < 1 << 62:
            return None
        if move:
            lcn += int.from_bytes(data[at + 1 + width : end], "little", signed=True)
            if lcn < 0:
                return None
        runs.append((vcn, length, lcn if move else None))
        vcn, at = vcn + length, end


def runs():
    """Column function: the runs of a BINARY, null where it is damaged."""

    @F.pandas_udf(SCHEMA)
    def run(data: pd.Series) -> pd.Series:
        out = []
        for d in data:
            found = None if d is None else parse(bytes(d))
            out.append(None if found is None else [{"vcn": v, "length": n, "lcn": p} for v, n, p in found])
        return pd.Series(out)

    return run
