"""Folders of kept tables under `spark.checkpoint.dir`, with a manifest and a lease.

A run writes its kept frames into a folder of its own and releases it at the end. The folder's
manifest (`_run.json`: kind, application, lease, tables) is written anew whenever a table is
added, and by a heartbeat while the run lives, so its modification time shows that the run is
alive. A run that died leaves its folder behind; any later run clears folders whose lease has
run out. Times are those of the storage, never of a machine's clock.
"""

from __future__ import annotations

import contextlib
import json
import threading
import uuid
import weakref
from collections.abc import Callable, Iterator

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from fanscope.session import checkpoint_root

#: Seconds after its last sign of life at which a run's folder may be cleared, and after its last
#: use at which a folder that later runs may reuse may be.
RUN_LEASE_S, REUSE_LEASE_S = 24 * 3600, 30 * 24 * 3600
MANIFEST = "_run.json"


class _Store:
    """The file system that holds a path, through the Hadoop client that Spark itself uses."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self.path_of = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.read_all = jvm.org.apache.commons.io.IOUtils.toByteArray

    def write(self, path: str, text: str) -> None:
        with contextlib.closing(self.fs.create(self.path_of(path), True)) as out:
            out.write(text.encode())

    def read(self, path: str) -> str | None:
        if not self.fs.exists(self.path_of(path)):
            return None
        with contextlib.closing(self.fs.open(self.path_of(path))) as found:
            return bytes(self.read_all(found)).decode()

    def modified(self, path: str) -> float | None:
        if not self.fs.exists(self.path_of(path)):
            return None
        return self.fs.getFileStatus(self.path_of(path)).getModificationTime() / 1000

    def folders(self, path: str) -> list[str]:
        if not self.fs.exists(self.path_of(path)):
            return []
        return [s.getPath().getName() for s in self.fs.listStatus(self.path_of(path)) if s.isDirectory()]

    def delete(self, path: str) -> None:
        self.fs.delete(self.path_of(path), True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is no such file."""
    return _Store(spark, path).read(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    _Store(spark, path).write(path, text)


def runs_root(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/runs"


class RunFolder:
    """A folder for one run's tables. `name` makes it one that later runs find and reuse; such a
    folder isn't released, but its lease ends."""

    def __init__(self, spark: SparkSession, kind: str, name: str | None = None, lease_s: float | None = None):
        self.spark, self.kind = spark, kind
        self.lease_s = lease_s if lease_s is not None else RUN_LEASE_S if name is None else REUSE_LEASE_S
        self.reused = name is not None
        self.path = f"{runs_root(spark)}/{kind}-{name or uuid.uuid4().hex}"
        self.tables: list[str] = []
        self._at_release: list[Callable[[], object]] = []
        self._store = _Store(spark, self.path)
        self._lock, self._ended = threading.Lock(), threading.Event()
        self.renew()
        clear_dead(spark, self._store.modified(f"{self.path}/{MANIFEST}"))
        beat = threading.Thread(target=_heartbeat, args=(weakref.ref(self), self._ended, self.lease_s / 4), daemon=True)
        beat.start()

    def renew(self) -> None:
        """Write the manifest anew."""
        with self._lock:
            if not self._ended.is_set():
                self._store.write(f"{self.path}/{MANIFEST}", json.dumps(
                    {"kind": self.kind, "application": self.spark.sparkContext.applicationId,
                     "lease_s": self.lease_s, "tables": self.tables}))

    def table(self, name: str) -> str:
        """The path for a table of this name."""
        if name not in self.tables:
            self.tables.append(name)
        self.renew()
        return f"{self.path}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """`df` written here and read back."""
        path = self.table(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def at_release(self, action: Callable[[], object]) -> None:
        self._at_release.append(action)

    def release(self) -> None:
        """Delete the folder, unless later runs may reuse it; its tables can't be read after that."""
        with self._lock:
            if self._ended.is_set():
                return
            self._ended.set()
        for action in self._at_release:
            action()
        if not self.reused:
            self._store.delete(self.path)


def _heartbeat(folder: weakref.ref, ended: threading.Event, every_s: float) -> None:
    while not ended.wait(every_s):
        held = folder()
        if held is None:
            return
        try:
            held.renew()
        except (Py4JError, OSError):  # the session has ended
            return


def clear_dead(spark: SparkSession, now: float | None = None) -> list[str]:
    """Delete run folders whose lease has run out by `now` (the storage's time; by default that of a
    file written for this). Returns their names."""
    root = runs_root(spark)
    store = _Store(spark, root)
    if now is None:
        probe = f"{root}/_now-{uuid.uuid4().hex}"
        store.write(probe, "")
        now = store.modified(probe)
        store.delete(probe)
    gone = []
    for name in store.folders(root):
        path = f"{root}/{name}"
        try:
            told = store.read(f"{path}/{MANIFEST}")
            seen = store.modified(f"{path}/{MANIFEST}") or store.modified(path)
            lease_s = json.loads(told)["lease_s"] if told else RUN_LEASE_S
        except (Py4JError, ValueError):  # another run deletes or writes it just now
            continue
        if seen is not None and now - seen > lease_s:
            store.delete(path)
            gone.append(name)
    return gone


@contextlib.contextmanager
def run_folder(spark: SparkSession, kind: str) -> Iterator[RunFolder]:
    """A run's folder, released at the end of the block, however it ends."""
    folder = RunFolder(spark, kind)
    try:
        yield folder
    finally:
        folder.release()
