"""Derived states, labels and gates shown to users of the catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1024 * 1024


def first_match(rules: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first rule that holds; a rule that is unknown does not."""
    return reduce(lambda rest, r: F.when(F.coalesce(r[0], F.lit(False)), r[1]).otherwise(rest), reversed(rules), F.lit(otherwise))


def first_tag(tags: Column, priority: list[str]) -> Column:
    """The first of a user's ordered tags that the row has, null if it has none."""
    return F.get(F.filter(F.array(*[F.lit(p) for p in priority]), lambda p: F.array_contains(tags, p)), 0)


def labelled(value: Column, labels: dict[str, str]) -> Column:
    """A label from a dictionary; the value itself where there is none."""
    pairs = [x for k, v in labels.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[value], value)


def valid_cache_limit(limit: Column) -> Column:
    """No limit (0), or 64 MiB to 8 TiB in steps of 4 MiB."""
    return (limit == 0) | (limit.between(64 * MIB, 8 * MIB * MIB) & (limit % (4 * MIB) == 0))


MOST_PENDING = 32  # evictions that may be waiting for readers


def eviction_gate(limit: Column, online: Column, ready: Column, available: Column, restoring: Column, used: Column, pending: Column) -> Column:
    """Why a cache is not trimmed now; null when it is."""
    return first_match(
        [
            (limit == 0, "unlimited"),
            (~online, "offline"),
            (~ready, "source_not_ready"),
            (~available, "provider_unavailable"),
            (restoring, "restore_incomplete"),
            (used <= limit, "within_limit"),
            (pending >= MOST_PENDING, "active_readers"),
        ]
    ).cast("string")


def prepare_stage(preparing: Column, sealed: Column, tails: Column, seeding: Column, processed: Column, changed: Column) -> Column:
    """Stage of a job that is being prepared: tails are sealed, then pages indexed, then the root written."""
    return first_match([(~preparing, "ready"), (sealed < tails, "sealing"), (seeding | (processed < changed), "indexing")], "root")


def restore_phase(phase: Column, work: Column) -> Column:
    """Phase shown for a restore: while it builds, data is verified and all else indexed; before, objects are downloaded."""
    return first_match([((phase == "building") & (work == "data"), "verifying"), (phase == "building", "indexing")], "downloading")


def quota_eligible(limit: Column, online: Column, eviction_ready: Column, source_ready: Column, origin_ready: Column, over: Column) -> Column:
    """Whether a disk's limit is to be enforced; where readiness is not told, a ready source or origin counts."""
    return (limit > 0) & online & F.coalesce(eviction_ready, source_ready | origin_ready) & (over > 0)
