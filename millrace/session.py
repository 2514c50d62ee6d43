"""Session settings shared by tests, bench and queries."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: What every session of this library needs; everything else is left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, name: str = "millrace") -> SparkSession:
    """A local session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def prepared(spark: SparkSession) -> SparkSession:
    """Apply the settings that query semantics depend on to a session made elsewhere, and let its workers find this package."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    send_package(spark)
    return spark


def send_package(spark: SparkSession) -> None:
    """Give the workers a copy of this package, once for a context, unless they look where it lies: through PYTHONPATH, or by the working directory of a local session."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(sc, "_millrace_sent", False):
        return
    sc._millrace_sent = True
    looked = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in looked or sc.master.startswith("local[") and Path.cwd() == root:
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((root / "millrace").rglob("*.py")):
            z.write(f, f.relative_to(root))
    with_shared_folder(spark)
    target = f"{sc._jsc.sc().getCheckpointDir().get()}/millrace-{uuid.uuid4().hex}.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(packed.getvalue()))
    out.close()
    _removed_at_end(spark, target)
    sc.addPyFile(target)


def with_shared_folder(spark: SparkSession) -> SparkSession:
    """Make checkpoint() usable: the folder that the cluster names in spark.checkpoint.dir, or, only where that is unset and the session is local, a temporary one. A cluster without a shared folder is refused with RuntimeError."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        if not named:
            named = tempfile.mkdtemp(prefix="millrace-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return spark


def _removed_at_end(spark: SparkSession, path: str) -> None:
    """Let the session's end remove what it put into the shared folder."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)


def cut(df: DataFrame) -> DataFrame:
    """Write a DataFrame to the shared checkpoint folder and go on from there, so that a lost executor costs no recomputation and no plan is run twice."""
    with_shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which the session's end removes."""
    path = f"{with_shared_folder(spark).sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    _removed_at_end(spark, path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like cut(), but as a compressed table, for rows that are many. It stays in the shared folder until the session ends."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")
