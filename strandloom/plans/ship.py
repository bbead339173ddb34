"""Makes the package importable on executors that don't share the driver's search path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

import strandloom

_sent: set[str] = set()


def ship(spark) -> None:
    """Sends the package once for each application; Spark distributes the archive."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    _sent.add(sc.applicationId)
    top = os.path.dirname(os.path.abspath(strandloom.__file__))
    path = os.path.join(tempfile.mkdtemp(), "strandloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("strandloom", os.path.relpath(full, top)))
    sc.addPyFile(path)


def shipped(query: Callable) -> Callable:
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    run.__wrapped__ = query
    return run
