"""Sessions, and the package on the executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once an application, so that tasks can import it wherever the driver runs."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    path = os.path.join(tempfile.mkdtemp(), "moundline_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def scratch(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where none is set: a temporary one in local mode, as in tests, and an error on a cluster, whose machines would not see each other's."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("moundline.scratch", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="moundline-")
        spark.conf.set("moundline.scratch", found)
    return found.rstrip("/")


#: Paths that this process has written to in the scratch folder and not released.
LEFT: list[str] = []


def temporary(spark: SparkSession, name: str) -> str:
    """A path of its own in the scratch folder, that release() deletes."""
    LEFT.append(f"{scratch(spark)}/{name}-{uuid.uuid4().hex}")
    return LEFT[-1]


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the scratch folder, read again: what several results are made of is computed once."""
    path = temporary(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of code from which on the JVM runs a method without compiling it.
HUGE_METHOD = 8_000


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark fuses the operators of a stage only where the JVM still compiles the method that this makes: tables of many computed columns exceed that."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(HUGE_METHOD, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Deletes all that is behind earlier results in the scratch folder; call it once those are saved."""
    while LEFT:
        delete(spark, LEFT.pop())


def local(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("moundline").config("spark.sql.shuffle.partitions", partitions).config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
