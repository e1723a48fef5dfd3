"""Session defaults shared by the entry point, the tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "verdigris", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with AQE, UTC and Arrow; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("VERDIGRIS_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once for a session."""
    sc = spark.sparkContext
    if getattr(sc, "_verdigris_package", None) is None:
        top = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="verdigris-")) / "verdigris_package.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(top.rglob("*.py")):
                z.write(file, file.relative_to(top.parent))
        sc.addPyFile(str(archive))
        sc._verdigris_package = archive


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: the one of spark.checkpoint.dir.

    Without that setting: a temporary folder in local mode; on a cluster an error, since parts
    in machines' own folders could not be read again.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_verdigris_scratch", None)
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = sc._verdigris_scratch = "file://" + tempfile.mkdtemp(prefix="verdigris-")
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    made(spark).append(path)
    return path


def made(spark: SparkSession) -> list[str]:
    """Paths given out in this session and not removed, oldest first."""
    sc = spark.sparkContext
    if getattr(sc, "_verdigris_made", None) is None:
        sc._verdigris_made = []
    return sc._verdigris_made


def removed(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete the session's own scratch tables given out from a place on, but those to keep; results that read them are gone."""
    paths = made(spark)
    for path in [p for p in paths[since:] if p not in keep]:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
        paths.remove(path)


def table(spark: SparkSession, sf_dir: str, name: str):
    """One input table, read through Spark so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
