"""The package's modules for the workers of a cluster."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_shipped: set[str] = set()


def ship(spark: SparkSession, *modules: str) -> None:
    """Send the package, and single ``modules`` beside it, to all executors, once an application.

    Workers get the archive from Spark itself, so no path of the driver has to exist elsewhere.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="kithwork-modules-")  # the driver serves the archive from here as long as it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "kithwork_modules.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for at, _, files in os.walk(os.path.join(ROOT, "kithwork")):
            for name in files:
                if name.endswith(".py"):
                    archive.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), ROOT))
        for name in modules:
            if os.path.exists(os.path.join(ROOT, name)):
                archive.write(os.path.join(ROOT, name), name)
    context.addPyFile(path)
    _shipped.add(context.applicationId)
