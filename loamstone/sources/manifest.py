"""Numbered versions of a table's state, published whole and by one writer each.

A version is a small JSON file below a folder that all writers share. Publishing creates it under its
number only if there is none; where the reply of that step is lost, the file itself tells whose it is.
Readers take the highest number. Versions far behind the last one are deleted, so listings stay short.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession

#: Versions kept behind the last one, for readers that still work on them.
KEPT = 20


class Store:
    """Files of the shared folder, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at(self.path).getFileSystem(self._conf)

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def names(self, folder: str) -> list[str]:
        where = self._at(self.at(folder))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(self.at(name)))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(self.at(name)), True)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(self.at(name)))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, content: str) -> bool:
        """Create a file whole, or not at all if there is one of that name; content must differ from any other writer's."""
        part = self._at(self.at(f"parts/{uuid.uuid4().hex}"))
        out = self._fs.create(part, False)
        out.write(bytearray(content.encode()))
        out.close()
        try:
            self._fs.mkdirs(self._at(self.at(name)).getParent())
            self._put(part, self._at(self.at(name)))
        except Exception:
            if not self.exists(name):
                raise
            return self.read(name) == content
        finally:
            self._fs.delete(part, False)
        return True

    def _put(self, part, to) -> None:
        """Give a file its name, which must be free."""
        if self._at(self.path).toUri().getScheme() in (None, "file"):
            os.link(part.toUri().getPath(), to.toUri().getPath())
        else:
            jvm = self.spark.sparkContext._jvm
            none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self._conf).rename(part, to, none)


class Manifest:
    """The versions of one table's state."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.store = Store(spark, path)

    def last(self) -> tuple[int, dict]:
        """Number and content of the last version; 0 and nothing before the first."""
        numbers = [int(n) for n in self.store.names("versions") if n.isdigit()]
        if not numbers:
            return 0, {}
        n = max(numbers)
        return n, json.loads(self.store.read(f"versions/{n:012d}"))["content"]

    def publish(self, version: int, content: dict) -> bool:
        """Make content that version; False if another writer's is there."""
        if not self.store.create(f"versions/{version:012d}", json.dumps({"writer": uuid.uuid4().hex, "content": content})):
            return False
        for n in self.store.names("versions"):
            if n.isdigit() and int(n) <= version - KEPT:
                self.store.delete(f"versions/{n}")
        return True
