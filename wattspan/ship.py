"""The package itself as a zip that workers import from.

Without it workers need the package on their own path: an installed wheel, ``--py-files`` or PYTHONPATH.
"""

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from wattspan.durable import file_system, scratch_path

_shipped: set[str] = set()


def package_zip() -> bytes:
    """All modules of the package, with paths that start at its name."""
    root, out = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as held:
        for path in sorted(root.rglob("*.py")):
            held.write(path, path.relative_to(root.parent).as_posix())
    return out.getvalue()


def ship_package(spark: SparkSession) -> None:
    """Give the package to the workers of a session, once: a zip in the shared folder."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    path = scratch_path(spark, "code") + "/wattspan.zip"
    system, where = file_system(spark, path)
    stream = system.create(where)
    stream.write(bytearray(package_zip()))
    stream.close()
    context.addPyFile(path)
    _shipped.add(context.applicationId)
