"""Helpers around the Spark session."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from .tables import shared_dir

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable in Python workers, once per application: as an archive
    in the shared folder, unless the workers' path has the package already."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        root = Path(__file__).resolve().parent
        if str(root.parent) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w") as z:
                for f in sorted(root.rglob("*.py")):
                    z.write(f, f.relative_to(root.parent))
            to = f"{shared_dir(spark)}/code-{uuid.uuid4().hex}/{root.name}.zip"
            path = sc._jvm.org.apache.hadoop.fs.Path(to)
            out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
            out.write(bytearray(held.getvalue()))
            out.close()
            sc.addPyFile(to)
    return spark
