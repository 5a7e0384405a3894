"""Small files through Hadoop's file system interface, published whole and once."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Files:
    """Files below a folder.  ``reads`` and ``writes`` name what was touched."""

    def __init__(self, spark: SparkSession, base: str):
        self.base, self.jvm = base.rstrip("/"), spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.fs = self.path("").getFileSystem(self.conf)
        self.root = self.fs.makeQualified(self.path("")).toUri().getPath()
        self.local = self.fs.getScheme() == "file"
        self.reads: list[str] = []
        self.writes: list[str] = []

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def _here(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str) -> bool:
        return os.path.exists(self._here(name)) if self.local else self.fs.exists(self.path(name))

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        self.reads.append(name)
        if self.local:
            with open(self._here(name), encoding="utf-8") as f:
                return f.read()
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _staged(self, name: str, text: str) -> str:
        tmp = f"{name}.{uuid.uuid4().hex}.tmp"
        if self.local:
            os.makedirs(os.path.dirname(self._here(name)), exist_ok=True)
            with open(self._here(tmp), "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            return tmp
        stream = self.fs.create(self.path(tmp), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return tmp

    def _unstage(self, tmp: str) -> None:
        if self.local:
            os.unlink(self._here(tmp))
        else:
            self.fs.delete(self.path(tmp), False)

    def publish(self, name: str, text: str) -> bool:
        """Make a file that was not there, whole; False if it is there already.

        Of several writers one wins: a local file gets its name by a hard link, any other
        by a rename that does not overwrite, both of which the file system does in one
        step (an object store's connector has to offer such a rename).  A crash before that
        step leaves a temporary file only, which nobody reads."""
        tmp = self._staged(name, text)
        try:
            if self.local:
                os.link(self._here(tmp), self._here(name))
            else:
                options = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
                kind = self.gateway.new_array(options, 1)
                kind[0] = options.NONE
                context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
                context.rename(self.fs.makeQualified(self.path(tmp)), self.fs.makeQualified(self.path(name)), kind)
        except FileExistsError:
            return False
        except Exception as e:  # py4j wraps FileAlreadyExistsException
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            self._unstage(tmp)
        self.writes.append(name)
        return True

    def list(self, folder: str) -> list[str]:
        """Names of all files below a folder."""
        if not self.exists(folder):
            return []
        if self.local:
            top = self._here(folder)
            return sorted(os.path.join(os.path.relpath(d, top), f).removeprefix("./") for d, _, names in os.walk(top) for f in names)
        found, it = [], self.fs.listFiles(self.path(folder), True)
        root = f"{self.root}/{folder}".rstrip("/")
        while it.hasNext():
            found.append(it.next().getPath().toUri().getPath()[len(root) + 1 :])
        return sorted(found)

    def names(self, folder: str) -> list[str]:
        """Names of the files directly in a folder."""
        if not self.exists(folder):
            return []
        if self.local:
            with os.scandir(self._here(folder)) as found:
                return sorted(x.name for x in found if x.is_file())
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder)) if s.isFile())

    def folders(self, folder: str) -> list[str]:
        """Names of the folders directly in a folder."""
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder)) if s.isDirectory())

    def size(self, name: str) -> int:
        """Bytes of a file or of all below a folder."""
        return self.fs.getContentSummary(self.path(name)).getLength() if self.exists(name) else 0

    def delete(self, name: str) -> bool:
        return self.fs.delete(self.path(name), True)


class Register:
    """Named values that move by compare-and-set.  A value's versions are files ``1.json``,
    ``2.json``, ...; the next one can be published once."""

    def __init__(self, files: Files, folder: str):
        self.files, self.folder = files, folder

    def _versions(self, name: str) -> list[int]:
        return sorted(int(x[:-5]) for x in self.files.names(f"{self.folder}/{name}") if x.endswith(".json") and x[:-5].isdigit())

    def get(self, name: str) -> tuple[int, str | None]:
        """The latest version, 0 for none, and its text."""
        versions = self._versions(name)
        return (versions[-1], self.files.read(f"{self.folder}/{name}/{versions[-1]}.json")) if versions else (0, None)

    def put(self, name: str, after: int, text: str) -> bool:
        """The version after ``after``; False if another writer has made it."""
        return self.files.publish(f"{self.folder}/{name}/{after + 1}.json", text)

    def names(self) -> list[str]:
        return sorted({x.rsplit("/", 1)[0] for x in self.files.list(self.folder) if x.endswith(".json") and "/" in x})

    def forget(self, name: str, keep: int = 1) -> None:
        """Drop old versions.  Only while nobody writes: a writer that read an old version
        must find the next one taken."""
        for v in self._versions(name)[:-keep]:
            self.files.delete(f"{self.folder}/{name}/{v}.json")
