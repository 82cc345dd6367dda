"""The package inside tasks."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark import SparkContext

_shipped: set[str] = set()


def ship_package(sc: SparkContext) -> None:
    """Let this machine's worker processes import the package, wherever the driver found it.

    On a cluster that is up to the submission (``--py-files`` or an installed package).
    """
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if sc.applicationId in _shipped or not sc.master.startswith("local") or not os.path.isdir(package):
        return
    parent, name = os.path.split(package)
    sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="seqcast-"), name), "zip", parent, name))
    _shipped.add(sc.applicationId)
