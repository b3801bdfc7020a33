"""Sorted numpy arrays as shuffle payloads and as memory-mapped files."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np


def squeeze(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys as byte planes of their differences, which shuffle compression shrinks."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8", copy=False)
    return gaps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view("<u8"), dtype=np.uint64)


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of their counts (each 1 if there are none)."""
    if not len(keys):
        return keys, np.zeros(0, dtype=np.int64)
    if counts is None:
        keys = np.sort(keys)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[starts], np.diff(np.r_[starts, len(keys)])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(counts, starts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values (fixed constants of a common 64-bit finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard by the keys' upper bits, ascending with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions in their given order) of each shard that occurs."""
    if len(shard) and shard.min() >= -1 and shard.max() < 32_000:
        shard = shard.astype(np.int16)  # sorted by radix
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.r_[True, shard[order][1:] != shard[order][:-1]]) if len(order) else np.zeros(0, dtype=int)
    for at in np.split(order, cuts[1:]) if len(order) else []:
        yield int(shard[at[0]]), at


def local_path(url: str) -> str:
    """The path under which every worker sees a shared folder."""
    parts = urlparse(url)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a shared folder that executors mount (file:), not {url}")
    return parts.path


def write_array(folder: str, name: str, array: np.ndarray) -> None:
    """Write a file in one step, so a repeated task leaves the same file."""
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, f"{folder}/{name}.npy")


def map_array(folder: str, name: str) -> np.ndarray:
    return np.load(f"{folder}/{name}.npy", mmap_mode="r")
