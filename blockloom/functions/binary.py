"""Little-endian numbers, position-bound tags and digests over BINARY columns.

``reverse`` on BINARY reverses characters, not bytes, so bytes are turned round
as pairs of hex digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def swap_bytes(hex_text: Column, width: int) -> Column:
    """Hex digits of at most ``width`` bytes with the order of the bytes turned round."""
    return F.concat(*(F.substring(hex_text, 2 * k + 1, 2) for k in reversed(range(width))))


def le_hex(value: Column, width: int) -> Column:
    """A non-negative number as ``width`` little-endian bytes in hex."""
    return swap_bytes(F.lpad(F.hex(value), 2 * width, "0"), width)


def le_number(data: Column, start: int, width: int) -> Column:
    """The little-endian number in ``width`` bytes from ``start`` (from 1); wide enough for any u64."""
    digits = swap_bytes(F.hex(F.substring(data, start, width)), width)
    return F.conv(digits, 16, 10).cast("decimal(20,0)")


def bound_tag(object_id: Column, page: Column, version: Column, data: Column) -> Column:
    """First 16 bytes, in hex, of the SHA-256 of id, page, version and data: a copy elsewhere does not verify."""
    body = F.concat(F.unhex(F.hex(object_id)), F.unhex(le_hex(page, 8)), F.unhex(le_hex(version, 8)), data)
    return F.substring(F.sha2(body, 256), 1, 32)


def partition_guid(disk: Column, index: Column) -> Column:
    """First 16 bytes, in hex, of the SHA-256 of the disk's 16 bytes and the entry's number."""
    return F.substring(F.sha2(F.concat(disk, F.unhex(le_hex(index, 4))), 256), 1, 32)


CONFIG_MAGIC, CONFIG_PAGE, CONFIG_DIGEST = "4F445634504C4E31", 4096, 32  # fixed values: magic in hex, bytes of the page and of its digest


def config_verdict(page: Column) -> Column:
    """format, checksum, length or ok for a configuration page: magic, length, text, zeros, digest of all before it."""
    size = le_number(page, 9, 4)
    body = F.substring(page, 1, CONFIG_PAGE - CONFIG_DIGEST)
    return (
        F.when(F.hex(F.substring(page, 1, 8)) != CONFIG_MAGIC, "format")
        .when(F.sha2(body, 256) != F.lower(F.hex(F.substring(page, CONFIG_PAGE - CONFIG_DIGEST + 1, CONFIG_DIGEST))), "checksum")
        .when(size > CONFIG_PAGE - 48, "length")
        .otherwise("ok")
    )


def config_text(page: Column) -> Column:
    return F.decode(page.substr(F.lit(17), le_number(page, 9, 4).cast("int")), "UTF-8")


def ranged_read(used: Column, start: Column, length: Column) -> Column:
    """``length`` bytes from ``start`` (from 0) of an object whose used bytes are followed by zeros."""
    there = F.greatest(F.lit(0), F.least(length, F.octet_length(used) - start)).cast("int")
    found = F.when(there > 0, used.substr((start + 1).cast("int"), there)).otherwise(F.unhex(F.lit("")))
    return F.concat(found, F.unhex(F.repeat(F.lit("00"), (length - there).cast("int"))))
