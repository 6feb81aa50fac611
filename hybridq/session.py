"""Session helpers: a session for tests and local runs; a cluster brings its own."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def local_session(cores: str = "8", name: str = "hybridq") -> SparkSession:
    build = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.files.openCostInBytes", "128k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    return build.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Where it is unset, one machine must do all the work (master `local[...]`); then a folder
    of that machine serves.  On a cluster executors couldn't see such a folder, so the
    setting is asked for.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="run-")
    return _LOCAL_ROOTS[context.applicationId]


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="ship-")
    made = shutil.make_archive(
        os.path.join(folder, "hybridq"), "zip", root_dir=os.path.dirname(here), base_dir=os.path.basename(here)
    )
    context.addPyFile(made)
    _SHIPPED.add(context.applicationId)
