"""Tables in the folder that the driver and all executors see."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


@functools.lru_cache(maxsize=1)
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="chronolake-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder of our own, on one machine only: elsewhere it would be one folder for
    each machine, which is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


#: Paths written inside each kept_only() that is under way, the innermost last.
_scopes: list[list[str]] = []


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: its lineage is cut, and it survives the loss of any executor.

    The table stays until the folder is cleaned by whoever owns it, as a plan read later may still need it; but see kept_only.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/chronolake-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end."""
    _scopes.append([])
    try:
        yield
    finally:
        dropped(spark, _scopes.pop())


def kept_only(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """written(make()), after which the tables that make() wrote on its way are deleted."""
    before = len(_scopes)
    _scopes.append([])
    try:
        df = make()
        _scopes.append([])
        out = written(df)
        gone, made = _scopes[before:]
    finally:
        del _scopes[before:]
    if _scopes:
        _scopes[-1].extend(made)
    dropped(spark, gone)
    return out
