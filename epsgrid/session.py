"""Session helpers: one place for the Spark settings the engine relies on.

The engine never starts a UI or any other server.  Scratch output (written
intermediate tables, checkpoints) goes under the folder the cluster names in
``spark.checkpoint.dir``; a private folder is created only when that setting is
missing, which is the case in local tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def get_spark(master: str | None = None, app: str = "epsgrid",
              shuffle_partitions: int | None = None,
              conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediates.

    Read from the session; only when nothing is configured (local tests)
    a private folder is created and registered.
    """
    sc = spark.sparkContext
    d = None
    try:
        d = sc.getCheckpointDir()
    except Exception:  # pragma: no cover - older API
        d = None
    if not d:
        d = sc.getConf().get("spark.checkpoint.dir", None)
        if not d:
            try:
                d = spark.conf.get("spark.checkpoint.dir")
            except Exception:
                d = None
        if not d:
            master = sc.master or ""
            if not master.startswith("local"):
                raise RuntimeError(
                    "spark.checkpoint.dir is not set; a shared folder is required on a cluster")
            d = tempfile.mkdtemp(prefix="epsgrid-ckpt-", dir="/tmp")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "epsgrid-scratch", f"{name}-{uuid.uuid4().hex[:12]}")


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``epsgrid`` importable in Python workers (once per application).

    Operators that run Python on executors (``applyInPandas``,
    ``mapInPandas``) pickle functions of this package by reference.  The
    package is zipped on the driver and registered with ``addPyFile``; Spark
    serves the file to every executor, which puts it on the workers' path.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out_dir = tempfile.mkdtemp(prefix="epsgrid-pyfiles-")
    zpath = os.path.join(out_dir, "epsgrid.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)
