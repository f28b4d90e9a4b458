"""Tables written between steps.

A step that several later steps read is written once as Parquet into the shared folder the cluster
names in ``spark.checkpoint.dir``. That cuts the lineage, survives the loss of executors, and lets
every later read prune columns.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid
from collections import Counter
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

DONE = "_done"

_own: list[str] = []
# Areas by their owner: the process, then the open runs.
_open: list[list] = [[]]


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    A master on one machine without that setting gets one temporary folder for the process, removed
    at its end. The setting itself is never changed.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="run-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of ``path``, and the path itself as it names it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def mark_done(spark: SparkSession, path: str) -> None:
    """Put the marker that says a folder is whole; readers of tables pass over its name."""
    system, where = file_system(spark, f"{path}/{DONE}")
    system.create(where, True).close()


def is_done(spark: SparkSession, path: str) -> bool:
    system, where = file_system(spark, f"{path}/{DONE}")
    return system.exists(where)


class StageArea:
    """Named tables of one run. A name that is saved again gets a new folder.

    An area belongs to the :func:`stage_run` that is open when it is made, which deletes its tables at
    the end; without one, they go when the process ends. Used in a ``with`` statement, or closed by
    hand, the area deletes them earlier. An area that backs a result which is read later must stay open
    until then.

    With ``folder``, the area is that very folder and outlives the process: tables that an earlier
    process finished there are read, not written again, as long as the same names are saved in the same
    order from the same sources. Only closing it deletes them.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, folder: str | None = None):
        self.spark = spark
        self.kept = folder is not None
        self.root = folder or f"{root or shared_folder(spark)}/stages-{uuid.uuid4().hex}"
        self.tables: dict[str, DataFrame] = {}
        self._saved: Counter[str] = Counter()
        # Held for the end of the process, when the session may have been stopped.
        self._system, self._where = file_system(spark, self.root)
        if not self.kept:
            _open[-1].append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table."""
        path = f"{self.root}/{name}-{self._saved[name]}"
        self._saved[name] += 1
        if not (self.kept and is_done(self.spark, path)):
            df.write.mode("overwrite").parquet(path)
            if self.kept:
                mark_done(self.spark, path)
        self.tables[name] = self.spark.read.schema(df.schema).parquet(path)
        return self.tables[name]

    def close(self) -> None:
        """Delete what this area wrote, through the file system of its folder."""
        self._system.delete(self._where, True)
        self.tables.clear()
        self._saved.clear()
        for areas in _open:
            if self in areas:
                areas.remove(self)

    def __enter__(self) -> StageArea:
        return self

    def __exit__(self, *_) -> None:
        self.close()


@contextmanager
def stage_run():
    """Owner of the areas that are made inside: their tables are deleted when it ends, also by an error.

    Read or write the results of queries inside it. Runs can be nested; each deletes its own areas.
    """
    areas: list[StageArea] = []
    _open.append(areas)
    try:
        yield
    finally:
        _open.remove(areas)
        _close_all(areas)


def _close_all(areas: list[StageArea]) -> None:
    for area in list(areas):
        area.close()
        if area in areas:
            areas.remove(area)


@atexit.register
def _close_open() -> None:
    """What no run owned goes with the process, if its JVM can still be asked."""
    for areas in _open:
        with suppress(Exception):
            _close_all(areas)


def sweep(spark: SparkSession, hours: float, root: str | None = None) -> list[str]:
    """Delete the stage folders of lost processes: those in which nothing was written for ``hours``.

    Choose more hours than the longest job between two writes of a run. Returns the deleted folders.
    """
    system, where = file_system(spark, root or shared_folder(spark))
    oldest = time.time() * 1000 - hours * 3_600_000
    gone = []
    for entry in system.listStatus(where) if system.exists(where) else []:
        path = entry.getPath()
        if not (entry.isDirectory() and path.getName().startswith("stages-")):
            continue
        tables = [t.getModificationTime() for t in system.listStatus(path)]
        if max([entry.getModificationTime(), *tables]) < oldest:
            system.delete(path, True)
            gone.append(path.getName())
    return gone


def run_folder(out: str, run_id: str) -> str:
    """Where the results of one run of a report lie."""
    return f"{out}/run-{run_id}"


def latest_run(spark: SparkSession, out: str) -> str | None:
    """The id of the complete run that was finished last. A run is complete when its manifest is."""
    system, where = file_system(spark, out)
    finished = []
    for entry in system.listStatus(where) if system.exists(where) else []:
        name = entry.getPath().getName()
        marker = file_system(spark, f"{out}/{name}/manifest/{DONE}")[1]
        if name.startswith("run-") and system.exists(marker):
            finished.append((system.getFileStatus(marker).getModificationTime(), name[len("run-") :]))
    return max(finished)[1] if finished else None


def read_result(spark: SparkSession, out: str, name: str, run_id: str | None = None) -> DataFrame:
    """A result, or the ``manifest``, of the latest complete run of a report or of the given one."""
    run_id = run_id or latest_run(spark, out)
    if run_id is None or not is_done(spark, f"{run_folder(out, run_id)}/manifest"):
        raise ValueError(f"{out} has no complete run" + (f" {run_id}" if run_id else ""))
    return spark.read.parquet(f"{run_folder(out, run_id)}/{name}")
