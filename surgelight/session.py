"""Session settings, the helpers that cut lineage, and the shipping of this package to the executors."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_SHIPPED: set[str] = set()


def build_session(app: str = "surgelight", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; every value can be overridden by keyword."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app).config(map=settings)
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that later stages survive the loss of an executor.

    The folder is the one the cluster names in ``spark.checkpoint.dir`` (see ``shared_folder``).
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names. Only a local master (tests on one machine) may leave it unset; a cluster without one is an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder and context.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return folder or os.path.join(tempfile.gettempdir(), "surgelight-checkpoints")


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read again.

    Results are lazy, so the table must outlive the caller; it is removed when the driver ends.
    """
    spark = df.sparkSession
    path = temporary_folder(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def temporary_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/surgelight-{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a folder at once."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, once for each application: as an archive in the shared folder that Spark hands out."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root, packed = Path(__file__).parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.writestr(zipfile.ZipInfo(f"{root.name}/{path.relative_to(root).as_posix()}"), path.read_bytes())
    data = packed.getvalue()
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/surgelight-{hashlib.sha256(data).hexdigest()[:16]}-{uuid.uuid4().hex[:8]}.zip")
    fs = target.getFileSystem(context._jsc.hadoopConfiguration())
    out = fs.create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    fs.deleteOnExit(target)
    context.addPyFile(fs.makeQualified(target).toString())
    _SHIPPED.add(context.applicationId)


def map_arrow(df: DataFrame, function: Callable, schema: StructType | str) -> DataFrame:
    """``df.mapInArrow`` with this package shipped first."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
