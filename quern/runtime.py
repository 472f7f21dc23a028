"""What operators need of a session: the package on the executors, and written tables in the shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
ROOT = str(PACKAGE.parent)
#: Rows and bytes of an Arrow batch at most; one row that is longer is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_written: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


def local(spark: SparkSession) -> bool:
    """Whether the executors are threads of this machine's driver."""
    return spark.sparkContext.master.split("[")[0] == "local"


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package: from its folder where they run beside the driver, else from an archive that Spark hands to every executor, once for an application. Arrow batches of more than BATCH_ROWS rows or BATCH_BYTES, of which the executor and its workers hold several copies, are made that small for the session."""
    context = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if context._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) not in range(1, BATCH_BYTES + 1):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if local(spark):
        env = context.environment
        if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    elif context.applicationId not in _shipped:
        archive = Path(tempfile.mkdtemp(prefix="quern-")) / f"{PACKAGE.name}.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(PACKAGE.rglob("*.py")):
                z.write(p, p.relative_to(PACKAGE.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Unset, a temporary one serves in local mode; a cluster's executors could not see that, so there it is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", found)
        _written.append((spark, found))
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, tag: str = "table") -> DataFrame:
    """df as a table in the shared folder, read back: it cuts lineage, survives lost executors, and nothing above it is computed twice."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for spark, path in _written:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; the cluster's cleaner owns the folder then
            break


atexit.register(_clean)
