"""Session settings and the two ways this package leaves data on shared storage."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidyshelf", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and UTC timestamps."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _local_root(spark.sparkContext.applicationId)


@functools.cache
def _local_root(application: str) -> str:
    return tempfile.mkdtemp(prefix="tidyshelf-")


_scopes: list[str] = []


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, in the application's own subfolder and that of an open scope."""
    inner = "".join(f"/{s}" for s in _scopes)
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}{inner}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder, wherever Spark can reach it; none there is fine."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """The names of what lies in a folder; none if it is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a folder lies at a path, wherever Spark can reach it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def read_small(spark: SparkSession, path: str) -> str:
    """The text of a small file, read by the driver."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    source = files.open(at)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that appears as a whole; False, and nothing is changed, if there is one already."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    at = hadoop.Path(path)
    files = at.getFileSystem(conf)
    draft = hadoop.Path(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex}")
    out = files.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        to = files.makeQualified(at)
        hadoop.FileContext.getFileContext(to.toUri(), conf).rename(files.makeQualified(draft), to, spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
    except Py4JJavaError as error:
        files.delete(draft, False)
        if not files.exists(at):
            raise
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


@contextmanager
def pinned(spark: SparkSession) -> Iterator[None]:
    """A scope for pinned tables: all that is pinned inside is removed at its end.

    Write the result inside the scope; frames that read pinned tables are of no use after it.
    """
    name = f"scope-{uuid.uuid4().hex}"
    _scopes.append(name)
    inner = "/".join(_scopes)
    try:
        yield
    finally:
        _scopes.remove(name)
        remove(spark, f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{inner}")


def pin(df: DataFrame, label: str = "pinned") -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from the files.

    Freezes values that another evaluation could give differently, cuts the lineage, and lets a
    lost executor be replaced without recomputing. Parquet keeps column pruning for later reads.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
