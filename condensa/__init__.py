"""Corpora of paired long and short texts on Spark."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

_shipped: set[str] = set()


def ship(spark) -> None:
    """Send this package to the session's Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="condensa-code-")  # read by the driver's own file server only
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    root = os.path.dirname(os.path.abspath(__file__))
    with zipfile.ZipFile(f"{folder}/condensa.zip", "w") as z:
        for at, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    z.write(path, os.path.join("condensa", os.path.relpath(path, root)))
    context.addPyFile(f"{folder}/condensa.zip")
    _shipped.add(context.applicationId)
