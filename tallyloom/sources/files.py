"""Small files on whatever store the session uses: whole, or not there at all."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from contextlib import suppress
from typing import Any

from pyspark.sql import SparkSession

# Bytes per checksum of a local store.
SUM_BYTES = 512


def _place(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The store of a path and the path as the store knows it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def _sums(data: bytes) -> bytes:
    """What a local store keeps beside a file to notice damage when it is read."""
    parts = [data[at : at + SUM_BYTES] for at in range(0, len(data), SUM_BYTES)]
    return struct.pack(f">4si{len(parts)}I", b"crc\0", SUM_BYTES, *map(zlib.crc32, parts))


class Folder:
    """A folder whose store is looked up once, for many small files.

    A folder of a local store is written to by this process itself: through
    the store, a file takes two processes that set permissions and a dozen calls.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, spark._jvm.org.apache.hadoop.fs.Path
        self._system, self._place = _place(spark, path)
        self._settings = self._system.getDefaultReplication(self._place), self._system.getDefaultBlockSize(self._place)
        # The local folder once it is there; "" if the files are not local.
        self._local: str | None = None if self._system.getUri().getScheme() == "file" else ""

    def _seen(self, make: bool = False) -> str | None:
        """The folder for this process; nothing if it is not local, not there yet or not to be seen from here."""
        if self._local is None and (make and self._system.mkdirs(self._place) or self._system.exists(self._place)):
            path = self._system.makeQualified(self._place).toUri().getPath()
            self._local = path if os.path.isdir(path) else ""
        return self._local

    def names(self) -> list[str]:
        """Sorted names; none if the folder does not exist."""
        if folder := self._seen():
            return sorted(name for name in os.listdir(folder) if not (name.startswith(".") and name.endswith(".crc")))
        if not self._system.exists(self._place):
            return []
        jvm = self._spark._jvm
        paths = jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(self._system.listStatus(self._place))
        if not len(paths):
            return []
        # All in one call. A name holds no slash, so it does not hold what stands between two of them.
        above = paths[0].getParent().toString().rstrip("/") + "/"
        listed = jvm.org.apache.commons.lang3.ArrayUtils.toString(paths)
        return sorted(listed[1 + len(above) : -1].split(f",{above}"))

    def holds(self, name: str) -> bool:
        if folder := self._seen():
            return os.path.exists(f"{folder}/{name}")
        return self._system.exists(self._path(self._place, name))

    def write(self, name: str, text: str, replace: bool = False) -> None:
        """Write a file under a passing name and rename it; an existing one raises unless it is to be replaced."""
        if not replace and (folder := self._seen(make=True)):
            return self._write_local(folder, name, text.encode())
        passing, place = self._path(self._place, f".{uuid.uuid4().hex}"), self._path(self._place, name)
        # Without a permission of its own: a local store would start a process for each file to set it.
        out = self._system.create(passing, None, True, 4096, *self._settings, None)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if replace and self._system.exists(place):
            self._replace(passing, place)
        elif self._system.exists(place) or not self._system.rename(passing, place):
            # Some stores rename over a file, the others refuse it themselves.
            self._system.delete(passing, False)
            raise FileExistsError(f"{place} is there already")

    def _write_local(self, folder: str, name: str, data: bytes) -> None:
        """The files that the local store would write; of two runs that write one at the same time, the second raises."""
        place, passing = f"{folder}/{name}", f"{folder}/.{uuid.uuid4().hex}"
        sums = f"{passing}.crc"
        try:
            for path, content in ((passing, data), (sums, _sums(data))):
                with open(path, "xb") as file:
                    file.write(content)
            try:
                # Unlike a rename, a link refuses a name that is there.
                os.link(passing, place)
            except OSError:
                if os.path.exists(place):
                    raise FileExistsError(f"{place} is there already") from None
                # A file system without links.
                os.rename(passing, place)
            os.rename(sums, f"{folder}/.{name}.crc")
        finally:
            for path in (passing, sums):
                with suppress(FileNotFoundError):
                    os.unlink(path)

    def _replace(self, passing: Any, place: Any) -> None:
        jvm = self._spark._jvm
        conf = self._spark._jsparkSession.sessionState().newHadoopConf()
        passing, place = self._system.makeQualified(passing), self._system.makeQualified(place)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(passing.toUri(), conf)
        options = self._spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        try:
            context.rename(passing, place, options)
        except Exception:
            self._system.delete(passing, False)
            raise


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Sorted names in a folder; none if it does not exist."""
    return Folder(spark, folder).names()


def write_text(spark: SparkSession, path: str, text: str, replace: bool = False) -> None:
    """One file by the rules of ``Folder.write``."""
    folder, _, name = path.rpartition("/")
    Folder(spark, folder).write(name, text, replace)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]
