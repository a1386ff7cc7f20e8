"""What operators share: stages that are read more than once."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """The package is sent to the executors once, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="plumewire-")) / f"{root.name}-operators.zip"
    with zipfile.ZipFile(target, "w") as z:
        for part in ("__init__.py", "functions", "operators"):
            for f in sorted([root / part] if part.endswith(".py") else (root / part).rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def _folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  A folder of this machine's own serves only where Spark is on one machine."""
    if not spark.sparkContext.getCheckpointDir():
        where, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if not where:
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = "file://" + tempfile.mkdtemp(prefix="plumewire-")
        spark.sparkContext.setCheckpointDir(where)
    return spark.sparkContext.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """The rows written to the folder of ``spark.checkpoint.dir`` and read from there, in their partitions: a lost executor
    costs a read."""
    _folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As ``kept``, in columns: terms and numbers take a fraction of the space, and a reader takes the columns it needs."""
    path = f"{_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of the largest table and shuffled bytes that a task of a join takes.
ROWS, BYTES = 125_000, 4 << 20


def dealt_finely(spark: SparkSession, rows: int) -> None:
    """The session's shuffles have partitions in proportion to ``rows``, so that a task's memory stays as it is when the
    tables grow; small ones are still put together, up to ``BYTES``.  The session keeps this; it never has fewer."""
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(BYTES))
