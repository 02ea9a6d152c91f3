"""Make the package importable by the Python workers of every executor.

UDF closures refer to functions and classes of this package by module name, so executors must be able to
import it.  `ship` zips the package once per application and registers it with `SparkContext.addPyFile`
(the equivalent of `spark-submit --py-files`); the file server distributes it and puts it on the workers'
path.  Registered queries call it; library users call it once after creating their session.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

_shipped: set[str] = set()


def _zip_package(dest_dir: str) -> str:
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    path = os.path.join(dest_dir, "tremor.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    return path


def ship(spark) -> None:
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _shipped:
        return
    # a driver-side build artifact (like a --py-files archive), served to executors by the file server
    sc.addPyFile(_zip_package(tempfile.mkdtemp(prefix="tremor-pkg-")))
    _shipped.add(app)
