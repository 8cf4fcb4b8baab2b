"""Intermediate tables in the folder that driver and executors share.

Iterative operators cut lineage by writing a table and reading it again: the
files survive a lost executor, which cached blocks do not.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
#: Folders of every Workspace that an application has made.
_roots: dict[str, list[str]] = {}


#: Folders made since the innermost `scope` began.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, the folders of all Workspaces made inside; what is to be kept must have been written elsewhere by then."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        kept = _roots.get(spark.sparkContext.applicationId, [])
        for root in made:
            _delete(spark, root)
            if root in kept:
                kept.remove(root)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> int:
    """Delete all that Workspaces of this application have left, results that are still read lazily included; how many folders."""
    roots = _roots.pop(spark.sparkContext.applicationId, [])
    for root in roots:
        _delete(spark, root)
    return len(roots)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where that is unset and all executors are on this machine."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = sc.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="hoplite-")
    return _own_dirs[app]


class Workspace:
    """Named Parquet tables of one operator run.

    Used as a context manager it deletes, at the end, every table but those
    named in ``keep``; results that the caller still reads lazily stay until `release`.
    """

    def __init__(self, spark: SparkSession, label: str, keep: tuple[str, ...] = ()):
        self.spark = spark
        self.keep = keep
        self.root = f"{shared_dir(spark)}/hoplite-{label}-{uuid.uuid4().hex}"
        _roots.setdefault(spark.sparkContext.applicationId, []).append(self.root)
        if (made := _made.get()) is not None:
            made.append(self.root)
        self._tables: list[str] = []

    @property
    def alive(self) -> bool:
        """Whether nobody has released the folder."""
        return self.root in _roots.get(self.spark.sparkContext.applicationId, [])

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the table read back, with the same schema even if empty."""
        df.write.mode("overwrite").parquet(self.path(name))
        self._tables.append(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def add(self, df: DataFrame, name: str) -> DataFrame:
        """Append ``df`` to a table, made if there is none, and return all of it."""
        df.write.mode("append").parquet(self.path(name))
        if name not in self._tables:
            self._tables.append(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables through the file system that holds them."""
        for name in names:
            _delete(self.spark, self.path(name))
            if name in self._tables:
                self._tables.remove(name)

    def __enter__(self) -> "Workspace":
        return self

    def __exit__(self, kind, *_rest) -> None:
        self.drop(*[t for t in list(self._tables) if kind is not None or t not in self.keep])


def within(df: DataFrame, bound: int) -> bool:
    """Whether ``df`` has at most ``bound`` rows, found without reading more than that many."""
    return df.limit(bound + 1).count() <= bound
