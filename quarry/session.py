"""Session helpers: a local session for tests/bench and lineage cutting.

On a cluster the session comes from the caller; nothing here overrides settings that are
already present. ``spark.checkpoint.dir`` is read from the session; a scratch folder is only
chosen when the setting is absent and the master is local (tests).
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "quarry", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench (``local[N]``)."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app_name)
    conf = dict(_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
    conf[SPREAD] = cpus
    conf["spark.driver.memory"] = os.environ.get("QUARRY_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for reliable checkpoints and intermediate tables.

    Uses the context's checkpoint dir or ``spark.checkpoint.dir``. Only a ``local`` master gets
    a fresh scratch folder when neither is set; elsewhere executors would not see it, so the
    missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="quarry-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the checkpoint folder for a written intermediate table."""
    import uuid

    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"


def store(df: DataFrame, name: str = "table") -> DataFrame:
    """Write an intermediate table as Parquet in the shared folder and reread it: lineage is
    cut, lost executors cost nothing, and later scans read only the columns they need."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing lazy depends on any more."""
    for df in tables:
        remove_path(df.sparkSession, df._stored_path)


def remove_path(spark: SparkSession, path: str) -> None:
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hp, True)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable on executors (Python workers unpickle our functions by
    module path): zip the package once per SparkContext and ``addPyFile`` it."""
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out_dir = tempfile.mkdtemp(prefix="quarry-pyfiles-")
    zpath = os.path.join(out_dir, "quarry.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, _dirs, files in os.walk(pkg_dir):
            if "__pycache__" in dirpath:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)


#: partitions that CPU-heavy queries deal their input to; unset: the scan's own splits
SPREAD = "spark.quarry.spread"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows out to as many partitions as the session's ``spark.quarry.spread`` names,
    by ``keys``. Unset, as for inputs of many splits, rows stay where they are. The local
    session sets it, since its test tables are single files."""
    n = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(n), *keys) if n else df
