"""Session construction and the shared checkpoint location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every session we build carries.  AQE re-plans joins from runtime
# sizes (broadcast only when the measured side is small), coalesces tiny
# shuffle partitions and splits skewed join partitions.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "railyard", extra: dict | None = None) -> SparkSession:
    """Local/test session.  On a cluster, use the cluster's session instead and
    only make sure ``spark.sql.session.timeZone`` is ``UTC``."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and stream checkpoints.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset a
    local session gets one under the system temp folder; a cluster session is
    an error, as its executors share no such folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "railyard-ckpt-" + uuid.uuid4().hex[:8])
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint root (never machine-local
    on a cluster, because the root comes from the cluster's setting)."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that is used more than once to the shared folder and read
    it back: its lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete what ``stored`` has written for this frame, which nothing reads
    any more."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``railyard`` importable in Python workers (needed by operators
    that run pandas code: their functions refer to module-level helpers).

    Zips the package once per SparkContext on the driver and registers it
    with ``addPyFile``; Spark's file server hands it to every executor, so no
    executor reads a driver path.  A stateful stream also starts a Python
    process beside the driver, which gets no such files; it finds the package
    by ``PYTHONPATH``.  The zip goes under the checkpoint root
    when that is a local folder, else in the driver's own temp folder.  On a
    cluster that already ships the package (``--py-files``) this is harmless.
    """
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    known = sc.environment.get("PYTHONPATH", "")
    sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [os.path.dirname(pkg_dir), known]))
    root = checkpoint_root(spark)
    local_root = root[len("file:"):] if root.startswith("file:") else root
    if "://" not in root and os.path.isabs(local_root):
        out_dir = os.path.join(local_root, "pyfiles-" + uuid.uuid4().hex[:12])
        os.makedirs(out_dir, exist_ok=True)
    else:
        out_dir = tempfile.mkdtemp(prefix="railyard-pyfiles-")
    zpath = os.path.join(out_dir, "railyard.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg_dir):
            if "__pycache__" in root:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)
