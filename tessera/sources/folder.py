"""A folder as a stream of listings: each batch tells path, time and size of every file there.

Spark's own file streams tell of a path once, so that neither changed nor deleted files are seen; a listing
tells of all of them, and keyed state finds what is new.  Contents are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


def listing(root: str) -> Iterator[tuple[str, float, int]]:
    """(path below ``root``, mtime, size) of all files, hidden ones left out; nothing if there is no folder."""
    from pyarrow import fs

    if "://" in root or root.startswith("file:"):
        system, base = fs.FileSystem.from_uri(root)
    else:
        system, base = fs.LocalFileSystem(), root
    base = base.rstrip("/")
    for info in system.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True)):
        path = info.path[len(base) + 1 :]
        if info.type == fs.FileType.File and not any(part.startswith((".", "_")) for part in path.split("/")):
            yield path, info.mtime_ns // 1_000_000 / 1000, info.size


class Listings(SimpleDataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:
        return {"turn": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        return iter([*listing(self.root)]), {"turn": start["turn"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """A batch that runs again sees the folder as it is now; state finds what that changes."""
        return iter([*listing(self.root)])


class FolderListing(DataSource):
    """``spark.readStream.format("folder_listing").load(root)``."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return "path string, mtime double, size long"

    def simpleStreamReader(self, schema: object) -> Listings:
        return Listings(self.options["path"])
