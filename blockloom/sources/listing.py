"""A paged directory listing as a Spark data source.

Pages are JSON files ``<directory>/<page>.json`` in a folder that executors
see, each a list of entries in ascending order of path.  The reader checks what
a client of a paged service must: entries ascend, none comes twice, each lies in
its directory, and a short page ends the listing.
"""

from __future__ import annotations

import json
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, length long, is_directory boolean, remote_id string, provider_checksum string"


class ListingError(ValueError):
    pass


def checked(directory: str, pages: list[list[dict]], page_size: int) -> list[tuple]:
    """Entries of one directory's pages, in order."""
    rows, last = [], ""
    for n, page in enumerate(pages):
        if n and len(pages[n - 1]) < page_size:
            raise ListingError(f"{directory}: a page after the last one")
        for e in page:
            if os.path.dirname(e["path"]) != directory:
                raise ListingError(f"{directory}: foreign entry {e['path']}")
            if e["path"] <= last:
                raise ListingError(f"{directory}: {e['path']} after {last}")
            last = e["path"]
            rows.append((e["path"], e.get("length"), e.get("is_directory", False), e.get("remote_id"), e.get("provider_checksum")))
    return rows


class _Directory(InputPartition):
    def __init__(self, name: str, files: list[str]):
        super().__init__(name)
        self.name, self.files = name, files


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.page_size = options["path"], int(options.get("pagesize", "1000"))

    def partitions(self) -> list[_Directory]:
        found = []
        for folder, _, names in sorted(os.walk(self.root)):
            pages = sorted((n for n in names if n.endswith(".json")), key=lambda n: int(n[:-5]))
            if pages:
                name = "/" + os.path.relpath(folder, self.root).replace(os.sep, "/")
                found.append(_Directory(name, [os.path.join(folder, n) for n in pages]))
        return found

    def read(self, partition: _Directory):
        pages = []
        for file in partition.files:
            with open(file, encoding="utf-8") as f:
                pages.append(json.load(f))
        yield from checked(partition.name, pages, self.page_size)


class PagedListing(DataSource):
    """``spark.dataSource.register(PagedListing)``, then ``spark.read.format("paged_listing").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
