"""The processed mirror as files: a text and a sidecar of metadata for each document.

``spark.read.format("mirror").load(root)`` gives (target_file, project, build, document_type, content, sidecar);
filters on project, build and document_type are looked up in the folders, so that others are not listed.
``df.write.format("mirror").mode(...).save(root)`` writes both files of each row.  Tasks write next to the
mirror, and only when all of them are done are files moved to their places; a write that fails leaves
the mirror as it was.  ``overwrite`` replaces what the mirror held, ``append`` the files of the same names.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

PREFIX, SIDECAR = "data/processed/", ".meta.json"
SCHEMA = "target_file string, project string, build string, document_type string, content string, sidecar string"
PARTS = ("project", "build", "document_type")
#: Files of a partition of a read.
PER_TASK = 500
#: The folder, below the mirror, of writes that are not done.
STAGING = ".staging"


def opened(root: str):
    """(file system, path) of a folder, local or by URI."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
    return system, base.rstrip("/")


def scope_of(path: str) -> tuple[str, str, str]:
    """(project, build, document type) of a path below the mirror: two folders of an enterprise document,
    three of others; what is missing is empty."""
    folders = path.split("/")[:-1]
    own = [folders[0], folders[0], *folders[1:2]] if len(folders) == 2 else folders[:3]
    return tuple([*own, "", "", ""][:3])


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class MirrorReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership of the scope's parts choose folders; all else stays with Spark."""
        for given in filters:
            if isinstance(given, (EqualTo, In)) and len(given.attribute) == 1 and given.attribute[0] in PARTS:
                values = {given.value} if isinstance(given, EqualTo) else set(given.value)
                own = self.wanted.setdefault(given.attribute[0], values)
                self.wanted[given.attribute[0]] = own & values
            else:
                yield given

    def fits(self, scope: tuple[str, ...]) -> bool:
        return all(value in self.wanted.get(name, {value}) for name, value in zip(PARTS, scope, strict=True))

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, base = opened(self.root)
        found: list[str] = []

        def walk(folder: str, names: tuple[str, ...]) -> None:
            for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if info.base_name.startswith("."):
                    continue
                if info.type == fs.FileType.Directory:
                    below = (*names, info.base_name)
                    # Folders that no filter lets through are not listed: a project of the wrong name, and of a
                    # deeper path any part that is settled.
                    if "project" in self.wanted and below[0] not in self.wanted["project"]:
                        continue
                    if len(below) >= 3 and not self.fits(below[:3]):
                        continue
                    walk(info.path, below)
                elif not info.base_name.endswith(SIDECAR) and self.fits(scope_of(info.path[len(base) + 1 :])):
                    found.append(info.path)

        walk(base, ())
        found.sort()
        return [Files(found[at : at + PER_TASK]) for at in range(0, len(found), PER_TASK)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        from pyarrow import fs

        system, base = opened(self.root)
        sidecars = {i.path for i in system.get_file_info([p + SIDECAR for p in partition.paths]) if i.type == fs.FileType.File} if partition.paths else set()
        for path in partition.paths:
            with system.open_input_stream(path) as file:
                content = file.read().decode("utf-8", "replace")
            sidecar = None
            if path + SIDECAR in sidecars:
                with system.open_input_stream(path + SIDECAR) as file:
                    sidecar = file.read().decode("utf-8", "replace")
            name = path[len(base) + 1 :]
            yield (PREFIX + name, *scope_of(name), content, sidecar)


@dataclass
class Staged(WriterCommitMessage):
    """What a task wrote: the folder of its files, and their names below the mirror."""

    folder: str
    names: list[str]


def checked(name: str | None) -> str:
    """A target file's path below the mirror; names that leave it are refused."""
    path = (name or "").removeprefix(PREFIX)
    if not path or path.startswith("/") or posixpath.normpath(path) != path or any(p.startswith(".") for p in path.split("/")):
        raise ValueError(f"not a file of the mirror: {name!r}")
    return path


class MirrorWriter(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool, columns: list[str]):
        self.root, self.overwrite, self.job = root, overwrite, uuid.uuid4().hex
        self.columns = columns
        if missing := {"target_file", "content"} - set(columns):
            raise ValueError(f"a mirror needs the columns {', '.join(sorted(missing))}")

    def write(self, iterator: Iterator) -> Staged:
        """Every attempt of a task has a folder of its own, so one that died disturbs no other."""
        system, base = opened(self.root)
        folder, names = f"{base}/{STAGING}/{self.job}/{uuid.uuid4().hex}", []
        for row in iterator:
            name = checked(row["target_file"])
            system.create_dir(posixpath.dirname(f"{folder}/{name}"), recursive=True)
            with system.open_output_stream(f"{folder}/{name}") as file:
                file.write((row["content"] or "").encode("utf-8"))
            if "sidecar" in self.columns and row["sidecar"] is not None:
                with system.open_output_stream(f"{folder}/{name}{SIDECAR}") as file:
                    file.write(row["sidecar"].encode("utf-8"))
            names.append(name)
        return Staged(folder, names)

    def commit(self, messages: list[Staged | None]) -> None:
        from pyarrow import fs

        system, base = opened(self.root)
        names = [name for m in messages if m for name in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have the same target file")
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if info.base_name != STAGING:
                    system.delete_dir(info.path) if info.type == fs.FileType.Directory else system.delete_file(info.path)
        for message in filter(None, messages):
            for name in message.names:
                target = f"{base}/{name}"
                system.create_dir(posixpath.dirname(target), recursive=True)
                # The sidecar goes first: a text without one is ingested again, never taken for current.
                sidecar = system.get_file_info(f"{message.folder}/{name}{SIDECAR}").type == fs.FileType.File
                if system.get_file_info(target + SIDECAR).type == fs.FileType.File:
                    system.delete_file(target + SIDECAR)
                if system.get_file_info(target).type == fs.FileType.File:
                    system.delete_file(target)
                system.move(f"{message.folder}/{name}", target)
                if sidecar:
                    system.move(f"{message.folder}/{name}{SIDECAR}", target + SIDECAR)
        self._sweep(system, base)

    def abort(self, messages: list[Staged | None]) -> None:
        self._sweep(*opened(self.root))

    def _sweep(self, system, base: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{base}/{STAGING}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{STAGING}/{self.job}")
        if not system.get_file_info(fs.FileSelector(f"{base}/{STAGING}", allow_not_found=True)) and system.get_file_info(f"{base}/{STAGING}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{STAGING}")


class Mirror(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mirror"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> MirrorReader:
        return MirrorReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> MirrorWriter:
        return MirrorWriter(self.options["path"], overwrite, schema.names)
