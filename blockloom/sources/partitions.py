"""Partition tables of binary volume images, one image a row.

Sector 0 holds a protective boot record; sector 1 a header that names where the
entries are.  Header and entries carry CRC-32 sums; entries must not overlap.  Where the
image holds the second copy of header and entries, it must be sound and equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECTOR = 512


def read_entries(image: bytes) -> list[tuple[int, int, int, str | None]]:
    """(index, first, last, error) of the partitions; one row with an error for a damaged table."""
    import struct
    import zlib

    def bad(why: str) -> list[tuple[int, int, int, str | None]]:
        return [(-1, -1, -1, why)]

    if len(image) < 2 * SECTOR or image[510:512] != b"\x55\xaa" or image[450] != 0xEE:
        return bad("boot record")
    head = image[SECTOR : 2 * SECTOR]
    if head[:8] != b"EFI PART":
        return bad("header")
    size, crc = struct.unpack_from("<II", head, 12)
    if not 92 <= size <= SECTOR or zlib.crc32(head[:16] + bytes(4) + head[20:size]) != crc:
        return bad("header sum")
    start, count, width, entries_crc = struct.unpack_from("<QIII", head, 72)
    body = image[start * SECTOR : start * SECTOR + count * width]
    if width < 128 or len(body) != count * width or zlib.crc32(body) != entries_crc:
        return bad("entries sum")
    second = struct.unpack_from("<Q", head, 32)[0]  # where the copy of the header is
    if second > 1 and (second + 1) * SECTOR <= len(image):
        copy = image[second * SECTOR : (second + 1) * SECTOR]
        if copy[:8] != b"EFI PART" or zlib.crc32(copy[:16] + bytes(4) + copy[20:size]) != struct.unpack_from("<I", copy, 16)[0]:
            return bad("backup header")
        at, *same = struct.unpack_from("<QIII", copy, 72)
        if same != [count, width, entries_crc] or copy[56:72] != head[56:72] or image[at * SECTOR : at * SECTOR + count * width] != body:
            return bad("backup entries")
    found = []
    for k in range(count):
        entry = body[k * width : (k + 1) * width]
        if entry[:16] != bytes(16):
            found.append((k, *struct.unpack_from("<QQ", entry, 32), None))
    ordered = sorted(found, key=lambda e: e[1])
    if any(b[1] <= a[2] for a, b in zip(ordered, ordered[1:], strict=False)) or any(e[2] < e[1] for e in found):
        return bad("overlap")
    return found


def partitions(images: DataFrame, key: str, data: str) -> DataFrame:
    """(key, partition, first_sector, last_sector, error) of every image; null images have no rows."""
    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *entry) for k, image in zip(pdf["key"], pdf["data"], strict=True) for entry in read_entries(bytes(image))]
            yield pd.DataFrame(rows, columns=["key", "partition", "first_sector", "last_sector", "error"])

    rows = images.filter(F.col(data).isNotNull()).select(F.col(key).alias("key"), F.col(data).alias("data"))
    return rows.mapInPandas(run, f"key {kind}, partition int, first_sector long, last_sector long, error string").withColumnRenamed("key", key)
