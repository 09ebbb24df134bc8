"""The file operations that a store needs besides Spark's, on any file system that Hadoop knows."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..schema import Conflict, IOFailure


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.conf, self.gateway = spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.fs = self.path("").getFileSystem(self.conf)
        base = self.fs.makeQualified(self.path("")).toUri()
        #: The folder on this machine's own disk, if it is there.
        self.local = base.getPath() if base.getScheme() == "file" else None

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return sorted(n for s in self.fs.listStatus(p) if not (n := s.getPath().getName()).startswith(".")) if self.fs.exists(p) else []

    def ages(self, folder: str, now: float) -> dict[str, float]:
        """Seconds since each entry of a folder was last changed."""
        p = self.path(folder)
        return {s.getPath().getName(): now - s.getModificationTime() / 1000 for s in self.fs.listStatus(p)} if self.fs.exists(p) else {}

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self.path(name)).getLength()

    def publish(self, name: str, text: str) -> None:
        """The whole text under its name or nothing at all; a Conflict if the name is taken. It is written aside and closed, then moved
        to its name: by a link on a local disk, by a rename that replaces nothing elsewhere."""
        folder, _, last = name.rpartition("/")
        aside = f"{folder}/.tmp-{uuid.uuid4().hex}-{last}"
        try:
            out = self.fs.create(self.path(aside), False)
            out.write(bytearray(text.encode()))
            out.close()
            if self.local is not None:
                os.link(f"{self.local}/{aside}", f"{self.local}/{name}")
            else:
                self._rename(aside, name)
        except FileExistsError as e:
            raise Conflict(f"{name} is taken: another writer has committed; open the store again") from e
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"{name} is taken: another writer has committed; open the store again") from e
            raise IOFailure(f"{name} cannot be written") from e
        except OSError as e:
            raise IOFailure(f"{name} cannot be written") from e
        finally:
            self.delete(aside)

    def _rename(self, old: str, new: str) -> None:
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.gateway.new_array(kind, 1)
        options[0] = kind.NONE  # replaces nothing
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.path(old), self.path(new), options)

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)
