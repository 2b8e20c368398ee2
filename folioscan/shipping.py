"""Makes the package importable on executors, wherever the driver imported it from, and bounds what they exchange with Python."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bounds of batches of rows, one value for all queries of a session that sets none: bytes of an Arrow batch between
#: Spark and a Python worker, and rows that the Parquet reader decodes at a time, as texts are long.
BOUNDS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 20), "spark.sql.parquet.columnarReaderBatchSize": "512"}


def ship(spark: SparkSession) -> None:
    """Send a zip of this package to the executors, once per application; bound batches where the session doesn't."""
    sc = spark.sparkContext
    own = spark.conf.getAll
    for name, value in BOUNDS.items():
        if name not in own:
            spark.conf.set(name, value)
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="folioscan-ship-")) / "folioscan.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)
