"""Session defaults, and shipping this package to executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def local_session(app: str = "tessel", cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that tests and benchmarks use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Make this package importable by Python workers, once for each SparkContext.

    A driver may have found the package by a path that workers don't share, so it is zipped and added as a file.
    """
    context = spark.sparkContext
    if getattr(context, "_tessel_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    top = os.path.dirname(here)
    fd, path = tempfile.mkstemp(prefix="tessel-", suffix=".zip")
    os.close(fd)
    atexit.register(lambda: os.path.exists(path) and os.remove(path))
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, top))
    context.addPyFile(path)
    context._tessel_shipped = True
