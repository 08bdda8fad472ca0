"""Makes the package importable in Python workers."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from .storage import put_bytes, shared_dir

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application, by way of the shared folder.

    It also turns off the partitioning that Spark 4.1 claims for unions, with which
    adaptive execution can fail ("Can't zip RDDs with unequal numbers of partitions").
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as out:
            for p in sorted([*root.rglob("*.py"), *root.rglob("*.dat")]):
                out.write(p, p.relative_to(root.parent))
        path = f"{shared_dir(spark)}/{root.name}-{uuid.uuid4().hex}.zip"
        put_bytes(spark, path, packed.getvalue())
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark
