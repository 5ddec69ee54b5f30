"""What every query needs of its session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Rows in a batch for Python, where the session has Spark's default: texts are long, and a batch is held several times over.
BATCH_ROWS, SPARKS_BATCH_ROWS = "1000", "10000"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, so that their Python workers can import it wherever it is installed."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == SPARKS_BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark-package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
    sc._tidemark_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
