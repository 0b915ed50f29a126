"""Leases of load runs: who is at work on which contents, and who is lost.

A run takes the next number in a folder that all runs of a database share, by
creating a file that must not exist yet, and then writes down the contents it
is going to load. It waits for runs with smaller numbers that want one of them,
so of several runs that want a content the first has it and the others find it
loaded. While a run works it renews its lease; one that has not done so for
``seconds`` is lost, and others need not wait for it any longer. A run that was
only slow notices before and after it publishes that its lease is gone.
"""

from __future__ import annotations

import os
import threading
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyarrow import fs as arrow_fs
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ledgerline.sources.files import open_path

SECONDS = 300.0
POLL = 0.2


class LeaseLost(RuntimeError):
    """Another run has taken this one for lost."""


class Folder:
    """Small files in a folder that all drivers see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        system, inside = open_path(self.path) if self.path.startswith(("/", "file:")) else (None, None)
        self._local = inside if isinstance(system, arrow_fs.LocalFileSystem) else None
        self._fs.mkdirs(self._hadoop(self.path))

    def of(self, name: str) -> str:
        return f"{self.path}/{name}"

    def create(self, name: str) -> bool:
        """Create a file; False if there is one. Only one of several callers gets True."""
        if self._local is not None:  # Hadoop's local file system tests and creates in two steps
            try:
                os.close(os.open(f"{self._local}/{name}", os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return False
            return True
        try:
            self._fs.create(self._hadoop(self.of(name)), False).close()
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def touch(self, name: str) -> None:
        self._fs.create(self._hadoop(self.of(name)), True).close()

    def names(self) -> dict[str, float]:
        """Name and time of change (seconds) of each entry."""
        found = self._fs.listStatus(self._hadoop(self.path))
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in found}

    def remove(self, name: str) -> None:
        self._fs.delete(self._hadoop(self.of(name)), True)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder with all it holds, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Lease:
    """The right to load some contents; a context in which it is renewed."""

    def __init__(self, folder: Folder, seconds: float = SECONDS):
        self.folder, self.seconds = folder, seconds
        self._own = uuid.uuid4().hex
        self._stop = threading.Event()
        self._beats = threading.Thread(target=self._renew, daemon=True)
        self.number = 1 + max((int(n.partition(".")[0]) for n in folder.names() if n[0].isdigit()), default=0)
        while not folder.create(f"{self.number:012}.run"):
            self.number += 1
        # The name tells a run from another that has the number of one that is gone.
        folder.touch(self._name(self._own))

    def _name(self, kind: str) -> str:
        return f"{self.number:012}.{kind}"

    def __enter__(self) -> Lease:
        self._beats.start()
        return self

    def __exit__(self, *_) -> None:
        self._stop.set()
        if self.held():
            for kind in (self._own, "claims", "claimed", "run"):
                self.folder.remove(self._name(kind))

    def _renew(self) -> None:
        while not self._stop.wait(self.seconds / 4):
            if self.held():
                self.folder.touch(self._name(self._own))

    def held(self) -> bool:
        return self._name(self._own) in self.folder.names()

    def check(self) -> None:
        if not self.held():
            raise LeaseLost("the lease of this run has run out")

    def claim(self, contents: DataFrame) -> None:
        """Write down the ``contents`` (any columns, the same in all runs) and
        wait until no run with a smaller number wants one of them."""
        contents.write.mode("overwrite").parquet(self.folder.of(self._name("claims")))
        self.folder.touch(self._name("claimed"))
        wants: dict[int, bool] = {}
        while waiting := [n for n in self._live() if n < self.number and wants.get(n, True)]:
            for n in waiting:
                if n not in wants and f"{n:012}.claimed" in self.folder.names():
                    try:
                        theirs = contents.sparkSession.read.schema(contents.schema).parquet(self.folder.of(f"{n:012}.claims"))
                        wants[n] = not contents.join(theirs, contents.columns, "left_semi").isEmpty()
                    except (PySparkException, Py4JJavaError):
                        if f"{n:012}.claimed" in self.folder.names():
                            raise
                        wants[n] = False  # it ended while its claims were read
            self.check()
            if any(wants.get(n, True) for n in waiting):
                time.sleep(POLL)

    def _live(self) -> list[int]:
        """Runs that hold a lease. What lost ones left in the folder goes."""
        names = self.folder.names()
        beats: dict[int, float] = {}
        for name, changed in names.items():
            if name[0].isdigit():
                number = int(name.partition(".")[0])
                beats[number] = max(beats.get(number, 0), changed)
        late = time.time() - self.seconds
        for number in [n for n, at in beats.items() if at < late and n != self.number]:
            for name in sorted(n for n in names if n.startswith(f"{number:012}.")):
                self.folder.remove(name)
            del beats[number]
        return sorted(beats)
