"""Makes this package importable on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Of a batch that Python gets; rows of long texts would else come 10,000 at a time.
BATCH_BYTES = 4 << 20
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the session's executors, once (needless where it is installed on them), and bound its Arrow batches."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    spark.conf.set(_BATCH_BYTES, BATCH_BYTES)
    path = Path(tempfile.mkdtemp(prefix="cytoframe-ship-")) / "cytoframe.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(_PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
