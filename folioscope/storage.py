"""Small control files on any Hadoop file system: resolved roots, reading, creation that only one writer can win."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


def qualified(spark: SparkSession, root: str) -> tuple[str, str, str]:
    """(scheme, authority, path) of a folder given bare or as a URI; a bare one belongs to the session's default file system. Nothing in it is taken as a pattern."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(root)
    uri = p.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    return uri.getScheme() or "file", uri.getAuthority() or "", uri.getPath()


class Folder:
    """JSON files below a folder. Files are never changed after they are made."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        scheme, _, at = qualified(spark, self.root)
        self._local = at if scheme == "file" else None

    def at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def make(self, name: str) -> None:
        self._fs.mkdirs(self.at(name))

    def names(self, name: str) -> list[str]:
        p = self.at(name)
        return [s.getPath().getName() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def read(self, name: str) -> dict:
        stream = self._fs.open(self.at(name))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        self._fs.delete(self.at(name), True)

    def create(self, name: str, data: dict) -> bool:
        """Make a file if there is none of that name; False if another writer was first. It appears whole or not at all.

        A draft is written and then given its name: by a hard link on a local file system, where a rename would replace the other's file, else by a rename, which file systems
        with atomic renames refuse if the name is taken.
        """
        folder, base = name.rsplit("/", 1) if "/" in name else ("", name)
        draft = f"{folder}/.{base}-{uuid.uuid4().hex}".lstrip("/")
        out = self._fs.create(self.at(draft), True)
        out.write(bytearray(json.dumps(data).encode()))
        out.close()
        if self._local is None:
            if self._fs.exists(self.at(name)) or not self._fs.rename(self.at(draft), self.at(name)):
                self.remove(draft)
                return False
            return True
        try:
            os.link(f"{self._local}/{draft}", f"{self._local}/{name}")
            return True
        except FileExistsError:
            return False
        finally:
            self.remove(draft)


class Versions:
    """Numbered JSON files 1, 2, …: the highest is in force. A number can be taken once."""

    def __init__(self, folder: Folder, name: str):
        self.folder, self.name = folder, name
        folder.make(name)

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.folder.names(self.name) if n.endswith(".json") and n[:-5].isdigit())

    def head(self) -> int:
        return max(self.numbers(), default=0)

    def read(self, number: int) -> dict:
        return self.folder.read(f"{self.name}/{number}.json")

    def take(self, number: int, data: dict) -> bool:
        return self.folder.create(f"{self.name}/{number}.json", data)
