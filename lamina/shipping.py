"""Gives executors this repository's modules where they cannot import them.

A cluster job gets them by ``--py-files`` or PYTHONPATH. A session without either, started
from another folder, gets a zip archive that Spark's own file server hands out.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark import SparkContext

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(sc: SparkContext) -> bool:
    """Adds the archive, once a context, unless workers find the modules by PYTHONPATH or the working folder; says whether it did."""
    paths = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if any(p and os.path.realpath(p) == os.path.realpath(ROOT) for p in paths) or getattr(sc, "_lamina_shipped", False):
        return False
    path = os.path.join(tempfile.mkdtemp(prefix="lamina-"), "lamina.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(os.path.join(ROOT, "lamina")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, ROOT))
    sc.addPyFile(path)
    sc._lamina_shipped = True
    return True
