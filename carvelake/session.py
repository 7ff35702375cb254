"""Sessions, and getting this package to the executors."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Spark's own default of 64 MB a batch is several times that in a Python worker, and each task has one or two of them.
BATCH, SPARK_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"
#: The JVM never compiles methods beyond 8000 bytes of bytecode; Spark's own limit lets whole stages of many rules become such methods, which are then interpreted row by row.
HUGE, SPARK_HUGE, COMPILED = "spark.sql.codegen.hugeMethodLimit", "65535", "8000"


def session(app: str = "carvelake", **conf: str) -> SparkSession:
    """A session with the settings that the operators expect; cluster sizes come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    for k, v in {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.skewJoin.enabled": "true"}.items() | conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors' Python workers, once for each application, and bounds Arrow batches and generated methods unless the user has."""
    if spark.conf.get(BATCH) == SPARK_BATCH:
        spark.conf.set(BATCH, BATCH_BYTES)
    if spark.conf.get(HUGE) == SPARK_HUGE:
        spark.conf.set(HUGE, COMPILED)
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for p in sorted(root.rglob("*")):
                if p.is_file() and "__pycache__" not in p.parts:
                    z.write(p, f"{root.name}/{p.relative_to(root)}")
        path = os.path.join(tempfile.mkdtemp(prefix="carvelake-ship-"), "carvelake.zip")
        Path(path).write_bytes(data.getvalue())
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    return spark
