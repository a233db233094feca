"""Session helpers shared by the library, its tests and the driver entry."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_OWN: dict[str, str] = {}
_SCRATCH: dict[str, SparkSession] = {}


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("typeloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so Python workers import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="typeloom"), "typeloom_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, f"{root.name}/{path.relative_to(root)}")
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="typeloom-shared")
    return _OWN[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; deleted at the end of the application."""
    path = f"{shared_dir(spark)}/typeloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    _SCRATCH[path] = spark
    return path


def drop_scratch(path: str) -> None:
    """Delete a scratch path now; harmless if it is gone or the session has ended."""
    spark = _SCRATCH.pop(path, None)
    if spark is None:
        return
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be over; then nothing is left to do
        pass


@atexit.register
def _drop_all() -> None:
    for path in list(_SCRATCH):
        drop_scratch(path)


def staged(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: lineage is cut, lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
