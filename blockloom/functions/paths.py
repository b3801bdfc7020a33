"""Object, commit and directory paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPONENT = "^[A-Za-z0-9_-]{2,128}$"
COMMIT = "^([0-9]{20})-([A-Za-z0-9_-]{2,128})[.]json$"


def object_path(root: Column, object_id: Column) -> Column:
    """Objects fan out by the first two characters of their id."""
    return F.concat(root, F.lit("/objects/"), F.substring(object_id, 1, 2), F.lit("/"), object_id)


def commit_name(generation: Column, root: Column) -> Column:
    return F.concat(F.lpad(generation.cast("string"), 20, "0"), F.lit("-"), root, F.lit(".json"))


def parent(path: Column) -> Column:
    """Everything before the last slash; the root for a name at the top."""
    return F.when(path.rlike("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def is_component(name: Column) -> Column:
    return name.rlike(COMPONENT)
